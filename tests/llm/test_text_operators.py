import hashlib
import re
import zlib
from collections import Counter
from math import exp, lgamma, log, log10

import numpy as np
import public_tokenizers
import pytest

from fairline.llm import bpe, cleaning, ctw, near_dup, packing, pii, quality, token_counts, topk, wavelet
from fairline.llm.text import keyed, read_source, tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"Leeds drew {n} with Hull at the old ground" for n in range(400)) + "."
TEXTS = [None, "", "  \n\t ", "Leeds beat Hull 2-1 at home, mail ref.1@fa.example.com now.", "Leeds beat Hull 2-1 at home, mail ref.1@fa.example.com now.",
         LONG, LONG + " The end came late.", "it's <|endoftext|> I'LL we've  they'd", "Σίσυφος İstanbul ǅ 日本語 テスト。 a\xa0b \x85 \x1c \x00 d é", "!!!! ???",
         "Home 1.90 | Draw 3.40 | Away 4.20 | Over 2.5 | Under 2.5", "x" * 3000]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(n, t, f"k{n}", "L", 1.0) for n, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", "L", None), (None, "no key", None, None, None)]
    return spark.createDataFrame(data, "match_id bigint, text string, key string, class string, n double")


@pytest.fixture(scope="module")
def none(rows):
    return rows.limit(0)


def by_text(rows, found, *columns):
    """Values of each distinct key; keys of TEXTS are their places."""
    return {r["match_id"]: tuple(r[c] for c in columns) for r in found.collect() if r["match_id"] is not None}


def ids_of(path, text):
    return tokenizer(read_source(path)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts_equal_the_library(rows, none):
    found = token_counts.count_tokens(rows, BYTE)
    got = by_text(rows, found, "n_bytes", "n_tokens")
    assert got == {n: (len((t or "").encode()), len(ids_of(BYTE, t))) for n, t in enumerate(TEXTS)}
    assert found.count() == len(TEXTS) + 2 and token_counts.count_tokens(none, BYTE).count() == 0


def test_trie_encoding_equals_the_library(rows, none):
    tok = tokenizer(read_source(WORD))
    got = by_text(rows, bpe.encode(rows, WORD), "ids", "decoded")
    for n, t in enumerate(TEXTS):
        want = ids_of(WORD, t)
        assert got[n] == (want, tok.decode(want, skip_special_tokens=False))
    digests = by_text(rows, bpe.encode(rows, WORD, digests=True), "n_tokens", "ids_sha256")
    assert digests[3][1] == hashlib.sha256(np.array(ids_of(WORD, TEXTS[3]), "<u4").tobytes()).hexdigest()
    assert bpe.encode(none, WORD).count() == 0
    back = bpe.decode(bpe.encode(rows, WORD), WORD)
    assert by_text(rows, back, "decoded") == {n: (d[1],) for n, d in got.items()}


def test_capitals_with_small_letters_above_the_fast_range(spark):
    capitals = [chr(c) for c in range(0x80, 0x250) if max(chr(c).lower()) >= "\u0250"]
    assert len(capitals) >= 23 and "\u018f" in capitals
    texts = [f"{c}li went home, a{c}{c} too" for c in capitals] + ["STRA\u1e9eE \u2c7eli \u212aelvin", "\u00c9li \u0178s"]
    words = bpe.Words(read_source(WORD))
    tok = tokenizer(read_source(WORD))
    back = {c: b for b, c in bpe.byte_letters().items()}
    for t in texts:
        want = [bytes(map(back.__getitem__, w)).decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(t))]
        assert words.of(t) == want, t
    frame = spark.createDataFrame(list(enumerate(texts)), "match_id bigint, text string")
    assert by_text(None, bpe.encode(frame, WORD), "ids") == {n: (ids_of(WORD, t),) for n, t in enumerate(texts)}
    packed = {r["match_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(frame, WORD, 256).collect()}
    assert packed == {n: (len(ids_of(WORD, t)) + 1, crc([*ids_of(WORD, t), 0])) for n, t in enumerate(texts)}


def test_wavelet_answers_as_the_plain_sequence():
    ids = np.random.default_rng(3).integers(0, 50_257, 10_007)
    ids[:300] = 7
    tree = wavelet.Wavelet.build(ids, 16)
    tree = wavelet.Wavelet.from_bytes(tree.length, tree.zeros, tree.to_bytes())
    at = np.arange(0, len(ids), 13)
    assert (tree.decode() == ids).all() and (tree.access(at) == ids[at]).all()
    assert tree.count(7, 100, 5000) == (ids[100:5000] == 7).sum() and (tree.find(7) == np.flatnonzero(ids == 7)).all()
    assert tree.count(1 << 20) == 0 and len(tree.find(1 << 20)) == 0


def test_token_files_give_the_ids_back(rows, none, spark, tmp_path):
    path = str(tmp_path / "tokens")
    wavelet.write_tokens(rows, path, BYTE, shard_tokens=500)
    got = wavelet.read_tokens(spark, path).orderBy("start").collect()
    order = sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda x: x[0])
    want = [ids_of(BYTE, "no key") + [0], *(ids_of(BYTE, t) + [0] for _, t in order)]
    assert [r["ids"] for r in got] == want
    assert [r["start"] for r in got] == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]
    every = np.concatenate(want)
    assert sorted(r["position"] for r in wavelet.find_token(spark, path, 0).collect()) == np.flatnonzero(every == 0).tolist()
    assert wavelet.store(none, BYTE).count() == 0


def test_packing_cuts_and_seats_every_piece(rows, none):
    found = packing.pack(rows, WORD, 256).collect()
    bins, whole = {}, Counter()
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["match_id"] is not None and r["match_id"] != 3:
            ids = [*ids_of(WORD, TEXTS[r["match_id"]]), 0]
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == 256 * r["piece"] and crc(part) == r["ids_crc32"] and len(part) == r["length"]
            whole[r["match_id"]] += r["length"]
    assert all(whole[n] == len(ids_of(WORD, t)) + 1 for n, t in enumerate(TEXTS) if n != 3)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(none, WORD).count() == 0


def test_plan_uses_every_piece_and_few_sequences():
    lengths = np.minimum(2048, np.maximum(1, np.random.default_rng(1).lognormal(6, 1.2, 20_000))).astype(int)
    counts = Counter(lengths.tolist())
    used = Counter()
    patterns = packing.plan(counts)
    for pattern, times in patterns:
        assert sum(pattern) <= 2048
        for x in pattern:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in patterns) <= 1.01 * -(-lengths.sum() // 2048)
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_line_rules(rows, none):
    got = by_text(rows, cleaning.clean(rows), "n_words", "word_chars", "n_symbols", "base_failed", "kept", "navigation_lines")
    for n, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[n][:3] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
    assert got[10][5] == 1 and got[0][3] and not got[0][4]
    assert cleaning.clean(none).count() == 0


def test_repeated_words_and_verdict():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = [bytes([97 + c]) for c in rng.integers(0, 3, rng.integers(0, 30))]
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
        assert cleaning.repeated_words(words) == len(inside)
    prose = "\n".join(" ".join(f"w{n * k % 97}" for k in range(1, 9)) + f", and {n} won." for n in range(1, 30))
    menu = "\n".join("Home | Odds | Live | Scores | Login" for _ in range(3))
    assert cleaning.inspect(prose + "\n" + menu)[6] and "Login" not in cleaning.inspect(prose + "\n" + menu)[-1]
    assert not cleaning.inspect(" | ".join(f"team{n}" for n in range(200)))[6]


def test_base_spans_equal_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = np.random.default_rng(6)
    for letters in ("ab1.@-+ ", "0123456789- .", "+0123 ().-a"):
        for _ in range(3000):
            t = "".join(rng.choice(list(letters), rng.integers(0, 40)))
            want = [("email", *m.span()) for m in email.finditer(t)]
            want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
            want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
            want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
            assert pii.base_spans(t) == want


def test_contexts_of_seeds_find_unseen_identifiers(spark, rows, none):
    data = [(n, f"Please call tel no +44 20 7946 0{n}11 today.") for n in range(100, 130)] + [(1, "Please call tel no 0207-946-0999 today."), (2, "Score was 123456 there.")]
    found = by_text(None, pii.find(spark.createDataFrame(data, "match_id bigint, text string")), "n_phone", "spans")
    assert [s["kind"] for s in found[1][1]] == ["phone"] and found[1][0] == 0 and found[2][1] == []
    assert by_text(rows, pii.find(rows), "n_email")[3] == (1,)
    masked = {r["key"]: r["text"] for r in pii.redact(rows).collect()}
    assert "<EMAIL>" in masked["k3"] and masked["k0"] == ""
    assert pii.find(none).count() == 0


def test_discovered_instances_prove_further_contexts(spark):
    """Only 'tel no' has seeds; each later context is proved by what the one before it found, through more links than ROUNDS."""
    ways = ["tel no", "reach me", "ring us", "voice line", "desk line", "night line"]
    lines, held = [f"tel no +44 20 7946 {n:04d} now" for n in range(4000)], []
    for n, way in enumerate(ways):
        fresh = [f"0207-{n}-{m:05d}" for m in range(4 ** (5 - n))]
        lines += [f"{way} {x} now" for x in held + fresh]
        held = fresh
    lines += ["scored at 99999-1 then"]
    found = pii.find(spark.createDataFrame(list(enumerate(lines)), "match_id bigint, text string")).collect()
    missed = [lines[r["match_id"]] for r in found if not r["spans"]]
    assert missed == ["scored at 99999-1 then"]


def test_candidates_are_whole_runs_with_their_contexts():
    for way in ("(243) 555-5526", "020 7946 0999", "3782 822463 10005", "(243)5555526", "0207.946.0999", "+1 (20) 55", "x" * 70 + "@localhost", "7" * 80):
        for text in (f"call tel no {way} now", f"call tel no {way}.", f"call tel no: {way}", f"call tel no {way}, (or) 12"):
            taken = pii.base_spans(text)
            got = [(p, i, text[a:b]) for k, p, i, a, b in pii.candidates(text, taken) if not k]
            assert got == [("tel no", way, way)], text
    assert [c[1:3] for c in pii.candidates("see tel no (020 7946 0999) now", [])] == [("no (", "020 7946 0999")]
    assert [c[2] for c in pii.candidates("at tel no 020 7946 0999x 12345 67", [])] == ["020 7946", "12345 67"]
    assert [c[2] for c in pii.candidates("of tel no 12345,67890 in 2019. 12 men", [])] == ["12345,67890"]
    text = "at tel no 020 7946 97.51.17.173 now"
    assert [c[:3] for c in pii.candidates(text, pii.base_spans(text))] == [("ip", "020 7946", "97.51.17.173"), ("", "tel no", "020 7946")]
    for n in (39, 40, 41, 250):
        one, other = ("tel " + c + "o" * n for c in "ab")
        assert pii.words_before(one + " x", n + 6) != pii.words_before(other + " x", n + 6)


def test_contexts_asked_in_order_equal_those_asked_alone():
    rng = np.random.default_rng(9)
    for _ in range(300):
        t = "".join(rng.choice(list("aB1@.( ") + ["word" * 60, "  "], rng.integers(0, 30), p=[.15, .15, .15, .1, .1, .1, .1, .1, .05]))
        context = pii.Contexts(t)
        assert [context.before(n) for n in range(len(t) + 1)] == [pii.words_before(t, n) for n in range(len(t) + 1)]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(8)
    data = [(n, rng.normal(0, 1, 6).round(1).tolist()) for n in range(150)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (3, [0.5] * 6)]
    frame = spark.createDataFrame(data, "match_id bigint, probs array<double>")
    got = topk.nearest(frame, frame.where("match_id % 5 = 0"), 7, row_block=40, query_block=16).collect()
    fine = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v in data if k < 200]
    for q, w in fine:
        if q % 5 == 0:
            want = sorted(((-int(w @ v), k) for k, v in fine if k != q))[:7]
            mine = sorted((r["rank"], -r["score"], r["match_id"]) for r in got if r["query_id"] == q)
            assert [(s, k) for _, s, k in mine] == want
    assert topk.nearest(frame.limit(0), frame, 7).count() == 0


def test_topk_adds_common_terms_at_once_and_stays_exact(spark):
    """Weights whose sums pass 2**53 are added as whole numbers; a term that few rows have keeps its posting list."""
    random = np.random.default_rng(3)
    terms = random.integers(-60, 60, (3, 64))
    terms[2, 3:] = 0
    assert topk.common_terms(terms, terms).tolist() == [True, True, False]
    assert topk.common_terms(terms << 30, terms << 30).tolist() == [False] * 3
    for scale in (1.0, 2.0 ** 18 + 1):
        rows = [(i, [float(x) * scale for x in column]) for i, column in enumerate(terms.T)]
        frame = spark.createDataFrame(rows, "match_id long, probs array<double>")
        got = [(r.query_id, r.match_id, r.score) for r in topk.nearest(frame, frame.where("match_id < 5"), 4).orderBy("query_id", "rank").collect()]
        whole = [[int(64 * x) for x in v] for _, v in rows]
        score = lambda q, i: sum(a * b for a, b in zip(whole[q], whole[i], strict=True))
        assert got == [(q, i, score(q, i)) for q in range(5) for i in sorted(set(range(64)) - {q}, key=lambda i: (-score(q, i), i))[:4]]  # noqa: B023


def brute_trees(texts, train, depth=ctw.DEPTH):
    def coded(t):
        d = [255] * depth + list(t) + [255]
        for i in range(depth, len(d)):
            yield tuple(d[i - 1 - k] for k in range(depth)), d[i]

    counts, kids = {}, {}
    for t, use in zip(texts, train, strict=True):
        for ctx, s in coded(t) if use else ():
            for d in range(depth + 1):
                p = 1
                for b in range(8):
                    bit = s >> (7 - b) & 1
                    counts.setdefault((ctx[:d], p), [0, 0])[bit] += 1
                    p = 2 * p + bit
    for ctx, p in counts:
        if ctx:
            kids.setdefault((ctx[:-1], p), []).append((ctx, p))

    def kt(a, b):
        return lgamma(a + .5) + lgamma(b + .5) - 2 * lgamma(.5) - lgamma(a + b + 1)

    def weighted(ctx, p):
        a, b = counts.get((ctx, p), (0, 0))
        return kt(a, b) if len(ctx) == depth else np.logaddexp(kt(a, b), sum(weighted(*k) for k in kids.get((ctx, p), []))) - log(2)

    def one(ctx, p, d=0):
        a, b = counts.get((ctx[:d], p), (0, 0))
        e = (b + .5) / (a + b + 1)
        if d == depth:
            return e
        stay = exp(kt(a, b) - log(2) - weighted(ctx[:d], p))
        return stay * e + (1 - stay) * one(ctx, p, d + 1)

    out = []
    for t in texts:
        total = 0.0
        for ctx, s in coded(t):
            p = 1
            for b in range(8):
                bit = s >> (7 - b) & 1
                q = one(ctx, p)
                total += log10(q if bit else 1 - q)
                p = 2 * p + bit
        out.append(total)
    return out


def test_context_trees_equal_brute_force(spark, rows, none):
    data = [(0, "Abracadabra the cat", True), (1, None, True), (2, "the cat sat", True), (3, "abraé", False), (4, "the cat sat", None)]
    got = {r["match_id"]: r for r in ctw.score(spark.createDataFrame(data, "match_id bigint, text string, train boolean"), "train").collect()}
    texts = [ctw.lowered(t or "") for _, t, _ in data]
    for n, want in enumerate(brute_trees(texts, [bool(u) for *_, u in data])):
        assert got[n]["score"] == pytest.approx(want, abs=1e-9)
    tokens = Counter(w for t, (*_, u) in zip(texts, data, strict=True) if u for w in [*t.split(), "end"])
    n_all, v = sum(tokens.values()), len(tokens)
    for n, t in enumerate(texts):
        words = [*t.split(), "end"]
        assert got[n]["base_score"] == pytest.approx(sum(log10((tokens[w] + 1) / (n_all + v + 1)) for w in words))
        assert (got[n]["n_tokens"], got[n]["n_known"], got[n]["train_tokens"]) == (len(words), sum(tokens[w] > 0 for w in words), n_all)
    assert ctw.score(rows.selectExpr("*", "true AS train"), "train").count() == len(TEXTS) + 2
    assert ctw.score(none.selectExpr("*", "true AS train"), "train").count() == 0


@pytest.mark.parametrize("small, tiled", [(384, 3072), (3, 1000), (2, 2)])  # whole buckets, tiles, rare shingles
def test_classes_equal_brute_force(spark, rows, none, monkeypatch, small, tiled):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "TILED", tiled)
    rng = np.random.default_rng(9)
    words = [f"w{n}" for n in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choice(words, 120).tolist()
        for edits in (0, 0, 1, 2, 4, 9, 20):
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    data = [(n, t) for n, t in enumerate(texts)] + [(500, None), (501, ""), (502, "one two"), (503, "one two"), (504, "one three")]
    frame = spark.createDataFrame(data, "match_id bigint, text string")
    got = by_text(None, near_dup.classes(frame), "class_id")
    made = near_dup.Shingles(near_dup.inverse_frequencies(keyed(frame, "match_id", "text")))
    held = {k: made.of(w) for (k, _), w in zip(data, made.words([t or "" for _, t in data]), strict=True)}
    top, data_of = {k: k for k in held}, {k: t or "" for k, t in data}

    def root(k):
        return k if top[k] == k else root(top[k])

    for i in held:
        for j in held:
            if i < j and near_dup.similarity(held[i], held[j]) >= 0.8:
                top[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {k: (root(k),) for k in held}
    for i in held:  # texts this alike always share one of their rarest shingles
        for j in held:
            if i < j and len(held[i][0]) and near_dup.similarity(held[i], held[j]) >= 0.8:
                a, b = (set(made.rarest(made.words([data_of[k]])[0], 0.8).tolist()) for k in (i, j))
                assert a & b and len(a) < max(3, 0.35 * len(held[i][0]))
    kept = [r["match_id"] for r in near_dup.keep_one(frame).collect()]
    assert sorted(kept) == sorted({root(k) for k in held})
    assert near_dup.classes(rows).count() == len(TEXTS) + 2 and near_dup.classes(none).count() == 0


def test_machine_uses_the_pair_identity_and_learns(spark, rows, none):
    rng = np.random.default_rng(2)
    machine = quality.Machine(0.1, rng.normal(size=9), rng.normal(size=(9, 3)))
    x = np.array([[0, 1, 2.0], [0, 4, -1.0], [0, 8, .5], [1, 3, 1.0]])
    raw, _ = machine.raw(x[:, 0].astype(int), x[:, 1].astype(int), x[:, 2], 2)
    pairs = sum(x[i, 2] * x[j, 2] * machine.factors[int(x[i, 1])] @ machine.factors[int(x[j, 1])] for i in range(3) for j in range(i))
    assert raw[0] == pytest.approx(0.1 + sum(machine.weight[int(f)] * v for _, f, v in x[:3]) + pairs)
    good = [(n, f"The visitors of town {n} held on in round {n}, and won. Late goals made it {n} points.") for n in range(60)]
    bad = [(100 + n, "WIN!! " * (20 + n)) for n in range(60)]
    frame = spark.createDataFrame(good + bad, "match_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in good + bad if k % 3] + [(1, None)], "match_id bigint, label int")
    scores = by_text(None, quality.score(frame, quality.fit(frame, labels)), "score")
    assert all((s[0] >= 0.7) == (k < 100) for k, s in scores.items())
    assert quality.score(rows, quality.fit(rows, labels.limit(0))).count() == len(TEXTS) + 2 and quality.score(none, machine).count() == 0
