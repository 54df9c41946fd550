"""How many of all near-copy pairs of the given documents end in one class, counted over all pairs."""

from collections import defaultdict

import numpy as np

from conftest import SF_DIR
from fairline.llm import near_dup
from fairline.llm.text import keyed


def test_recall_over_all_pairs_of_the_given_documents(spark):
    """Pairs that share a shingle are all there are at any similarity above 0; each is measured, none sampled."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = near_dup.Shingles(near_dup.inverse_frequencies(keyed(docs, "doc_id", "text")))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    held = dict(zip(texts, map(made.of, made.words(list(texts.values()))), strict=True))
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs, "doc_id").collect()}
    owners, common = defaultdict(list), defaultdict(float)
    for key, (shingles, weights) in held.items():
        for s, w in zip(shingles.tolist(), weights.tolist(), strict=True):
            for other, theirs in owners[s]:
                common[other, key] += min(w, theirs)
            owners[s].append((key, w))
    total = {k: w.sum() for k, (_, w) in held.items()}
    near = [(a, b) for (a, b), c in common.items() if c >= near_dup.SIMILARITY * (total[a] + total[b] - c) - 1e-9]
    met = np.mean([found[a] == found[b] for a, b in near]) if near else 1.0
    print(f"{len(near)} near pairs of {len(common)} that share a shingle, recall {met:.4f}")
    assert near and met >= 0.99
    root = {k: k for k in texts}
    for a, b in near:  # classes of the true pairs
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(k):
        return k if root[k] == k else top(root[k])

    wrong = sum(found[k] != top(k) for k, (shingles, _) in held.items() if len(shingles))
    assert wrong <= 0.01 * len(texts)
