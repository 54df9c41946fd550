"""The opN_ queries against plain Python: their own digests, hold-outs, limits and verdicts, nulls included."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_DIR
from fairline.llm import queries
from fairline.session import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents with rows without text or key, copies, and a text that fails and one that passes by its lines."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    hand = [(900_001, None), (900_002, ""), (None, "no key here"), (900_003, "same line of words\n" * 30), (900_003, "same line of words\n" * 30),
            (900_004, "call +1 (415) 555-0199 or a.b@c-d.org, 10.0.0.1, 4111 1111 1111 1111; 999.1.1.1 " * 2), (900_005, "été <|endoftext|> " * 700)]
    return given.select("doc_id", "text").union(spark.createDataFrame(hand, "doc_id long, text string")).selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "char_length(text) AS n_chars")


@pytest.fixture(scope="module")
def folder(spark, docs):
    path = f"{shared_folder(spark)}/text-queries"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_op1_holds_out_by_the_remainder_and_cuts_at_the_score(spark, folder, texts):
    df = queries.op1_quality_classifier(spark, folder)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert rows_of(df, "doc_id", "held_out") == sorted(((k, remainder(k, 4) == 2) for k, _ in texts), key=str)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in df.collect())


def test_op2_counts_and_base_verdict(spark, folder, texts):
    def counts(text):
        words = WORD.findall(text)
        seen = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + d for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for d in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed

    df = queries.op2_quality_rules(spark, folder)
    got = rows_of(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((k, *counts(t)) for k, t in texts), key=str)
    assert not any(r["kept"] for r in df.where("base_failed").collect()) and df.where("kept").count() > 0


def base_spans(text):
    card = lambda s: 16 <= len(s) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    forms = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: card(digits(s))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)}
    return [(kind, m.start(), m.end()) for kind, (form, fits) in forms.items() for m in re.finditer(form, text) if fits(m.group())]


def test_op4_base_spans(spark, folder, texts):
    def answer(text):
        found = base_spans(text)
        n = Counter(kind for kind, _, _ in found)
        return *(n[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()

    df = queries.op4_pii(spark, folder)
    assert rows_of(df, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(((k, *answer(t)) for k, t in texts), key=str)
    spans = {}
    for r in df.collect():
        spans.setdefault(r["doc_id"], []).append(set(r["spans"].split(",")))
    assert all(any({f"{k}:{a}:{b}" for k, a, b in base_spans(t)} <= s for s in spans[key]) for key, t in texts)


def test_op5_counts_and_limit(spark, folder, texts):
    plain = Tokenizer.from_file(str(public_tokenizers.path(queries.BYTE_BPE)))
    want = [(k, len(t.encode()), n := len(plain.encode(t, add_special_tokens=False).ids), n > 1024) for k, t in texts]
    assert rows_of(queries.op5_token_counts(spark, folder), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_op6_base_score_and_hold_out(spark, folder, texts):
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t)] + [None]
    seen = Counter(w for k, t in texts if remainder(k, 7) != 2 for w in low(t))
    total, size = sum(seen.values()), len(seen)
    want = {}
    for k, t in texts:
        words = low(t)
        score = sum(math.log10((seen[w] + 1) / (total + 1 * (size + 1))) for w in words)
        want.setdefault(k, []).append((remainder(k, 7) == 2, len(words), sum(w in seen for w in words), total, score))
    got = {}
    for r in queries.op6_lm_scoring(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:6])
        assert r["score"] <= 0
    assert got.keys() == want.keys()
    for k, rows in want.items():
        for mine, theirs in zip(sorted(got[k]), sorted(rows), strict=True):
            assert mine[:4] == theirs[:4] and mine[4] == pytest.approx(theirs[4], rel=1e-9)


def test_op7_pieces_and_no_more_sequences_than_first_fit(spark, folder, texts):
    plain, size = Tokenizer.from_file(str(public_tokenizers.path(queries.WORD_BPE))), 2048
    want, lengths = [], []
    for k, t in texts:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), size):
            piece = np.array(ids[i:i + size], "<u4")
            want.append((k, i // size, i, len(piece), zlib.crc32(piece.tobytes())))
            lengths.append(len(piece))
    df = queries.op7_best_fit_packing(spark, folder)
    assert rows_of(df, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    room = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, free in enumerate(room) if free >= n), None)
        if at is None:
            room.append(size - n)
        else:
            room[at] -= n
    assert df.select("sequence_id").distinct().count() <= len(room) + 1


@pytest.mark.parametrize("name", ["op9_wavelet_tokens", "op10_trie_bpe"])
def test_ids_and_digests(spark, folder, texts, name):
    df = getattr(queries, name)(spark, folder)
    if name.startswith("op9"):
        plain = Tokenizer.from_file(str(public_tokenizers.path(queries.BYTE_BPE)))
        want, start = [], 0
        for k, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert rows_of(df, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
        return
    plain = Tokenizer.from_file(str(public_tokenizers.path(queries.WORD_BPE)))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids
        want.append((k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(plain.decode(ids, skip_special_tokens=False).encode())))
    assert rows_of(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
