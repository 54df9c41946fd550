"""Near copies: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.ctw import Words, lowered, owners, padded
from fairline.llm.text import KEY, TEXT, key_type, keyed, map_batches, once, slices
from fairline.session import ship_package, stage

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
#: Word document frequencies are counted per hash bucket, so their table has a fixed size.
DF_BITS = 18
#: Members up to which a bucket's pairs of different classes are all compared in one task, and of a tile of larger ones.
SMALL = 384
#: Members up to which tiles are the cheaper way: a tiled member is sent n / SMALL times; those of larger buckets meet by their rarest shingles.
TILED = SMALL * BANDS // 2
SHINGLES_AT_ONCE = 1 << 16
CHARS_AT_ONCE = 500_000
STEPS = 1 << 16

MIX_A, MIX_B, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def gamma_steps() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of equal steps, by bisection on 1 - (1 + x) exp(-x)."""
    want = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < want
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


class Shingles:
    """The weighted shingles of texts: five words, or all words of a shorter text, in ASCII lower case.

    A shingle weighs its count in the text times the mean of its words' inverse document frequencies,
    1 + ln(N / df) / (2 ln N): from 1 for words of every document to 1.5 for those of one.
    """

    def __init__(self, idf: np.ndarray | None = None):
        self.idf, self.named = idf, once("near words", "", Words)

    def names(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' names of all texts in turn, and how many each text has."""
        data, _, sizes = padded([lowered(t) for t in texts], 1)
        starts, names = self.named.of(data)
        return mixed(names.view(np.uint64)), np.bincount(owners(starts, sizes, 1), minlength=len(texts))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        names, sizes = self.names(texts)
        ends = np.cumsum(sizes).tolist()
        return [names[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and their weights."""
        distinct, unit, counts = self.units(words)
        return distinct, counts * unit

    def rarest(self, words: np.ndarray, least: float) -> np.ndarray:
        """The shingles with the heaviest words, until what is left of the text's weight is under ``least`` of it.

        The order (weight of one occurrence, then hash) is the same in every text. Texts of ``least`` similarity share at
        least that part of the heavier one's weight, so the lists of two such texts have a shingle in common.
        """
        distinct, unit, counts = self.units(words)
        order = np.lexsort((distinct, -unit))
        taken = np.cumsum((counts * unit)[order])
        return distinct[order][:np.searchsorted(taken, taken[-1] * (1 - least + 1e-6), side="right") + 1] if len(taken) else distinct

    def units(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, the weight of one occurrence, and the occurrences."""
        n = min(WORDS, len(words))
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
        m = len(words) - n + 1
        value = self.idf[(words >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        hashed, weight = np.zeros(m, np.uint64), np.zeros(m)
        for i in range(n):
            hashed = (hashed + words[i:m + i]) * BASE
            hashed ^= hashed >> np.uint64(27)
            weight += value[i:m + i]
        distinct, first, counts = np.unique(mixed(hashed), return_index=True, return_counts=True)
        return distinct, weight[first] / n, counts


class Sampler:
    """Consistent weighted samples of many texts at once, joined to band signatures.

    Per sample, a shingle's r, c (Gamma(2,1)) and beta (uniform) come from its hash; with t = floor(ln w / r + beta)
    the least ln c - r (t - beta + 1) wins, and the sample is the winner and its t. Two texts agree in a sample with the
    probability of their weighted Jaccard similarity.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        steps = gamma_steps()
        self.r, self.inverse, self.log_c = steps.astype(np.float32), (1 / steps).astype(np.float32), np.log(steps).astype(np.float32)
        self.seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def signatures(self, hashes: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """(texts, bands); every text needs a shingle."""
        sizes = np.array([len(h) for h in hashes])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        every, log_w = np.concatenate(hashes), np.log(np.concatenate(weights)).astype(np.float32)
        place = np.arange(len(every), dtype=np.int64)
        out = np.empty((len(sizes), self.bands), np.uint64)
        for band in range(self.bands):
            joined = np.full(len(sizes), band + 1, np.uint64)
            for row in range(self.rows):
                x = (every ^ self.seeds[band * self.rows + row]) * MIX_A
                x ^= x >> np.uint64(32)
                x *= MIX_B
                at = (x >> np.uint64(48)).astype(np.int64)
                beta = (x & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0 ** -24)
                t = np.floor(log_w * self.inverse[at] + beta)
                cost = self.log_c[((x >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)] - self.r[at] * (t - beta + np.float32(1))
                bits = cost.view(np.int32).astype(np.int64)
                ordered = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)  # integers in the order of the floats
                best = np.minimum.reduceat((ordered << 31) | place, starts) & ((1 << 31) - 1)
                joined = mixed(joined ^ every[best] + t[best].astype(np.int64).astype(np.uint64))
            out[:, band] = joined
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of smaller weights over the sum of larger ones; two empty texts are alike."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    union = float(a[1].sum() + b[1].sum()) - common
    return common / union if union else 1.0


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """The IDF of each hash bucket of words, over all rows of (key, text): 2**DF_BITS numbers at most reach the driver."""
    size = 1 << DF_BITS

    def step(batches):
        made, counts, rows = Shingles(), np.zeros(size, np.int64), 0
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            rows += len(all_texts)
            for a, b in slices(all_texts, CHARS_AT_ONCE):
                names, sizes = made.names(all_texts[a:b])
                cells = np.unique((np.repeat(np.arange(b - a), sizes) << DF_BITS) | (names >> np.uint64(64 - DF_BITS)).astype(np.int64))
                counts += np.bincount(cells & (size - 1), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([rows, *counts[used]], pa.int64())], names=["bucket", "n"])

    found = map_batches(texts, step, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    held = np.ones(size)
    n = max(2, int(found.loc[found["bucket"] == -1, "n"].sum()))
    words = found[found["bucket"] >= 0]
    held[words["bucket"].to_numpy()] = np.maximum(1, words["n"].to_numpy())
    return 1 + np.log(n / np.minimum(held, n)) / (2 * np.log(n))


def signed(texts: DataFrame, shared) -> DataFrame:
    """(key, digest, weight, bands): the sum of a text's weights and its band signatures, none for a text without words."""
    def step(batches):
        made = Shingles(shared.value)
        sampler = once("sampler", f"{BANDS} {ROWS}", Sampler)
        for batch in batches:
            all_texts = batch.column(2).to_pylist()
            weight, bands = np.zeros(len(all_texts)), [[]] * len(all_texts)
            for a, b in slices(all_texts, CHARS_AT_ONCE):
                held, at, total = [], [], 0
                for i, words in enumerate(made.words(all_texts[a:b]), a):
                    if len(words):
                        held.append(made.of(words))
                        at.append(i)
                        weight[i] = held[-1][1].sum()
                        total += len(held[-1][0])
                    if held and (total >= SHINGLES_AT_ONCE or i == b - 1):
                        found = sampler.signatures(*map(list, zip(*held, strict=True))).view(np.int64)
                        for k, row in zip(at, found.tolist(), strict=True):
                            bands[k] = row
                        held, at, total = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["key", "digest", "weight", "bands"])

    digested = texts.select("key", F.md5("text").alias("digest"), "text")
    return map_batches(digested, step, f"key {key_type(texts, 'key')}, digest string, weight double, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """The (a, b) pairs of digests whose texts are similar enough; ``texts`` holds (digest, text), a row each."""
    def step(batches):
        made, kept = Shingles(shared.value), OrderedDict()

        def shingles(digest, text):
            if digest not in kept:
                kept[digest] = made.of(made.words([text])[0])
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[digest]

        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            good = [similarity(shingles(*x), shingles(*y)) >= least - 1e-9 for x, y in zip(zip(a, left, strict=True), zip(b, right, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    both = (pairs.join(texts.withColumnsRenamed({"digest": "a", "text": "left"}), "a")
            .join(texts.withColumnsRenamed({"digest": "b", "text": "right"}), "b").select("a", "b", "left", "right"))
    return map_batches(both, step, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected group of (a, b) links.

    Each round takes the least root among the neighbours and then the root's root, so paths shrink fast; the loop ends when
    a round changes nothing. Every round is written to the shared folder.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "link-edges")
    roots = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "link-roots")
    while True:
        near = edges.join(roots, edges["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        closer = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = stage(closer.join(jump, "next").select("node", "was", F.least("next", "far").alias("root")), "link-roots")
        roots = moved.select("node", "root")
        if not moved.where("root <> was").head(1):
            return roots


def classed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the class of each digest; those without a link are their own."""
    return members.join(roots.withColumnsRenamed({"node": "digest", "root": "class"}), "digest", "left").withColumn(
        "class", F.coalesce("class", "digest"))


def pivot_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of each bucket's first member with all members of other classes, and the members without those pivots.

    ``members``: (bucket, digest, weight, class). Pairs whose weights alone rule the similarity out are left out.
    """
    first = Window.partitionBy("bucket").orderBy("digest")
    heads = members.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    heads = stage(heads.select("bucket", F.col("digest").alias("pivot"), F.col("weight").alias("pivot_weight"), F.col("class").alias("pivot_class")),
                  "near-heads")
    wide = F.greatest("weight", "pivot_weight")
    pairs = (members.join(heads, "bucket").where("class <> pivot_class and digest <> pivot")
             .where(F.least("weight", "pivot_weight") >= (SIMILARITY - 1e-6) * wide)
             .select(F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b")).distinct())
    rest = members.drop("class").join(heads.select("bucket", F.col("pivot").alias("digest")), ["bucket", "digest"], "left_anti")
    return pairs, rest


def bucket_links(members: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """(a, b) links among the members of buckets: a text comes to its bucket, and its pairs of other classes are compared there.

    A bucket of n > ``SMALL`` members is dealt over tiles of about that many, and a task compares two tiles (or one with itself).
    """
    ship_package(members.sparkSession)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        made, out = Shingles(shared.value), []
        low, high = group["low"].iat[0], group["high"].iat[0]
        rows = sorted(zip(group["tile"], group["digest"], group["class"], group["text"], strict=True))
        held = [made.of(w) for w in made.words([r[3] for r in rows])]
        _, kind = np.unique([r[2] for r in rows], return_inverse=True)  # classes that links of this bucket join become one
        sizes = np.array([len(h) for h, _ in held])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        known, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        weights, total, dense = np.concatenate([w for _, w in held]), np.array([w.sum() for _, w in held]), np.zeros(len(known))
        first = sum(r[0] == low for r in rows)
        for j in range(0 if low == high else first, len(rows)):
            before = j if low == high else first  # of one tile all earlier texts, of two the whole other tile, at once
            if (kind[:before] == kind[j]).all():
                continue
            mine, end = slice(starts[j], starts[j + 1]), starts[before]
            dense[place[mine]] = weights[mine]
            common = np.add.reduceat(np.minimum(weights[:end], dense[place[:end]]), starts[:before])
            dense[place[mine]] = 0
            for i in np.flatnonzero(common >= (least - 1e-9) * (total[:before] + total[j] - common)):
                if kind[i] != kind[j]:
                    out.append((rows[i][1], rows[j][1]))
                    kind[kind == kind[j]] = kind[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    tiles = F.ceil(F.col("n") / SMALL)
    dealt = (members.join(texts, "digest").withColumn("tile", F.pmod(F.xxhash64("digest"), tiles))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))))
    dealt = dealt.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "digest", "class", "text")
    return dealt.groupBy("bucket", "low", "high").applyInPandas(compare, "a string, b string")


def rare_buckets(members: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """(bucket, digest, weight): large buckets' members put together anew, by each of their rarest shingles that several have.

    Two members of ``least`` similarity share one of these shingles, so no pair is lost.
    """
    def step(batches):
        made = Shingles(shared.value)
        for batch in batches:
            digests, all_texts, weights = (batch.column(i) for i in range(3))
            for a, b in slices(all_texts.to_pylist(), CHARS_AT_ONCE):
                held = [made.rarest(w, least) for w in made.words(all_texts[a:b].to_pylist())]
                at = pa.array(np.repeat(np.arange(a, b), [len(h) for h in held]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), digests.take(at), weights.take(at)],
                                                 names=["bucket", "digest", "weight"])

    wanted = members.select("digest", "weight").dropDuplicates(["digest"])
    found = stage(map_batches(texts.join(wanted, "digest").select("digest", "text", "weight"), step, "bucket bigint, digest string, weight double"), "near-rare")
    several = stage(found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-several")
    return found.join(several, "bucket")


def classes(rows: DataFrame, key: str = KEY, text: str = TEXT, least: float = SIMILARITY) -> DataFrame:
    """(key, ``class_id``, ``digest``, ``class``) for every row: rows in one class are linked by near copies of ``least`` similarity.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text.
    ``class_id`` is the least key of the class (null if all its keys are null), ``digest`` the text's MD5 and
    ``class`` the least digest of the class. Equal texts are one class; a text without words is linked to equal texts only. Null texts are empty. Repeated rows each give a row, other
    columns are ignored, an empty frame gives an empty frame.

    Equal texts meet once, by digest. Buckets (band, signature) of different texts are compared in rounds until none holds
    two classes with a pair left: each first through one pivot, which links what is really alike, then small ones
    whole in one task and middling ones tile by tile; what is left of larger ones meets in buckets of its rarest shingles, which lose no
    pair. So no large bucket's pairs are ever spread out whole, and a pair has the same chance in a bucket of any size:
    similarity s shares one of 16 bands with probability 1 - (1 - s**3)**16, 0.99999 at 0.8.
    """
    spark = rows.sparkSession
    texts = keyed(rows, key, text)
    shared = spark.sparkContext.broadcast(inverse_frequencies(texts))
    marks = stage(signed(texts, shared), "near-marks")
    one = stage(marks.groupBy("digest").agg(F.min("key").alias("least_key"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "near-texts")
    spread = one.select("digest", "weight", F.posexplode("bands").alias("band", "signature")).select(
        F.xxhash64("band", "signature").alias("bucket"), "digest", "weight")
    several = stage(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-several")
    members = stage(spread.join(several, "bucket"), "near-members")
    wanted = stage(members.select("digest").distinct(), "near-wanted")
    bodies = stage(texts.select(F.md5("text").alias("digest"), "text").dropDuplicates(["digest"]).join(wanted, "digest"), "near-bodies")
    roots = spark.createDataFrame([], "node string, root string")
    links, rounds = None, 0
    while True:
        now = stage(classed(members, roots), "near-classed")
        live = stage(now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
                     .where("low <> high").select("bucket", "n"), "near-live")
        if not live.head(1):
            break
        now = stage(now.join(live, "bucket"), "near-open")
        if rounds == 0:  # one pivot for each: what is really alike is linked, and most buckets are done
            pairs, members = pivot_pairs(now.drop("n"))
            found = verified(stage(pairs, "near-pairs"), bodies, shared, least)
        elif rounds == 1:
            found = bucket_links(now.where(F.col("n") <= TILED), bodies, shared, least)
            large = now.where(F.col("n") > TILED).drop("class", "n")
            members = rare_buckets(large, bodies, shared, least) if large.head(1) else large
        else:
            found, members = bucket_links(now, bodies, shared, least), now.limit(0).drop("class", "n")
        found, members, rounds = stage(found, "near-links"), stage(members, "near-rest"), rounds + 1
        if found.head(1):
            links = found if links is None else links.union(found)
            roots = components(links)
    named = stage(classed(one.select("digest", "least_key"), roots), "near-named")
    ids = stage(named.groupBy("class").agg(F.min("least_key").alias("class_id")), "near-ids")
    final = named.select("digest", "class").join(ids, "class").select("digest", "class_id", "class")
    return marks.select("key", "digest").join(final, "digest").select(F.col("key").alias(key), "class_id", "digest", "class")


def keep_one(rows: DataFrame, key: str = KEY, text: str = TEXT, least: float = SIMILARITY) -> DataFrame:
    """``rows`` with one row of each class: that of the least key (null keys last, then the least digest)."""
    found = classes(rows, key, text, least)
    first = (found.where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class", "class_id")
             .agg(F.min("digest").alias("kept_digest")).select(F.col("class_id").alias("kept_key"), "kept_digest"))
    first = stage(first, "near-kept")
    digest = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("rest"), F.col(f"`{key}`").alias("key"), digest.alias("digest"))
    kept = whole.join(first, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("digest") == F.col("kept_digest")))
    again = Window.partitionBy("kept_key", "kept_digest").orderBy("key")
    return kept.withColumn("n", F.row_number().over(again)).where("n = 1").select("rest.*")
