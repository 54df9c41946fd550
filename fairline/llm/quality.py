"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.cleaning import repeated_words
from fairline.llm.text import KEY, TEXT, Memo, key_type, map_batches, once, slices
from fairline.session import stage

WORD_BITS = 14
STEPS = 12          # of each statistic, one feature per step
RANK = 8
SAMPLE_ROWS = 6_000  # the most labelled rows that the fit reads
SAMPLE_BYTES = 64_000_000  # features of the sampled rows in the fit, 8 bytes each: rows are taken whole, by hash, until they reach it
ROUNDS, RATE, DECAY = 60, 0.08, 1e-4
STATISTICS = ("words", "word_length", "distinct", "repeated", "stuttered", "dup_lines", "ended_lines", "symbols", "bars", "shouts",
              "capitals", "digits", "line_words")
METADATA_BINS = 64
#: Steps' upper ends: shares in fixed steps, sizes in powers of two.
SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
SIZES = 2.0 ** np.arange(1, STEPS)
WIDTHS = np.array([1.5, 2.5, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 14])


def n_features(n_metadata: int) -> int:
    return (1 << WORD_BITS) + len(STATISTICS) * STEPS + n_metadata * METADATA_BINS


def statistics(text: str, words: list[bytes]) -> list[int]:
    """The step of each statistic, in the order of ``STATISTICS``."""
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    chars = max(1, len(text))
    shares = {
        "distinct": len(set(words)) / n,
        "repeated": repeated_words(words) / n,
        "stuttered": sum(map(bytes.__eq__, words, words[1:])) / n,
        "dup_lines": 1 - len(set(lines)) / m,
        "ended_lines": sum(x.rstrip()[-1] in ".!?…\"'”»)" for x in lines) / m,
        "symbols": min(1.0, 4 * sum(map(text.count, "#*$%&<>")) / n),
        "bars": min(1.0, text.count("|") / n),
        "shouts": min(1.0, text.count("!!") / n),
        "capitals": sum(map(bytes.isupper, words)) / n,
        "digits": min(1.0, 5 * sum(map(text.count, "0123456789")) / chars),
    }
    sizes = {"words": (SIZES * 8, len(words)), "word_length": (WIDTHS, sum(map(len, words)) / n), "line_words": (SIZES, len(words) / m)}
    return [int(np.searchsorted(*sizes[s])) if s in sizes else int(np.searchsorted(SHARES, shares[s])) for s in STATISTICS]


def learn_words(words: list[bytes]) -> dict[bytes, int]:
    return {w: zlib.crc32(w) >> (32 - WORD_BITS) for w in words}


class Features:
    """Sparse rows: (row, feature, value) of texts and their metadata numbers."""

    def __init__(self):
        self.memo = Memo(learn_words)

    def of(self, texts: list[str], metadata: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = [t.encode().split() for t in texts]
        get = self.memo.of(lists).__getitem__
        sizes = np.array([len(x) for x in lists], np.int64)
        hashed = np.fromiter(chain.from_iterable(map(get, x) for x in lists), np.int64, int(sizes.sum()))
        cells, counts = np.unique((np.repeat(np.arange(len(texts)), sizes) << WORD_BITS) | hashed, return_counts=True)
        row, feature = cells >> WORD_BITS, cells & ((1 << WORD_BITS) - 1)
        norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, len(texts)))
        value = counts / norm[row]
        first = 1 << WORD_BITS
        wide = len(STATISTICS) * STEPS
        more = []
        for i, (text, words) in enumerate(zip(texts, lists, strict=True)):
            more += [(i, first + s * STEPS + step) for s, step in enumerate(statistics(text, words))]
            for j, column in enumerate(metadata):
                x = column[i]
                step = 0 if x is None or x != x else 1 + min(METADATA_BINS - 2, int(np.log2(1 + abs(x))))
                more.append((i, first + wide + j * METADATA_BINS + step))
        extra = np.array(more, np.int64).reshape(-1, 2)
        row, feature = np.concatenate([row, extra[:, 0]]), np.concatenate([feature, extra[:, 1]])
        value = np.concatenate([value, np.ones(len(extra))])
        order = np.argsort(row, kind="stable")
        return row[order], feature[order], value[order]


class Machine:
    """score = sigmoid(bias + sum w x + sum over pairs <v_i, v_j> x_i x_j), in time linear in the features present.

    The pairs' sum is half of (sum v x) squared minus sum (v x) squared, per factor.
    """

    def __init__(self, bias: float, weight: np.ndarray, factors: np.ndarray):
        self.bias, self.weight, self.factors = bias, weight, factors

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.searchsorted(row, np.arange(n))  # every row has its statistics, so none is empty
        raw = self.bias + np.add.reduceat(self.weight[feature] * value, starts)
        sums = np.empty((n, self.factors.shape[1]))
        for f, factor in enumerate(self.factors.T):  # one at a time, so that memory doesn't grow with their number
            vx = factor[feature] * value
            sums[:, f] = np.add.reduceat(vx, starts)
            raw += 0.5 * (sums[:, f] ** 2 - np.add.reduceat(vx * vx, starts))
        return raw, sums

    def scores(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, feature, value, n)[0], -40, 40)))

    @classmethod
    def fit(cls, row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, n_all: int) -> Machine:
        """Full-batch Adam on the log loss, classes weighing alike; the same rows give the same machine."""
        used, local = np.unique(feature, return_inverse=True)
        n, m = len(label), len(used)
        seed = np.random.default_rng(20240229)
        made = cls(0.0, np.zeros(m), seed.normal(0, 0.03, (m, RANK)))
        share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
        moments = [np.zeros(1 + m + m * RANK), np.zeros(1 + m + m * RANK)]
        for step in range(1, ROUNDS + 1):
            raw, sums = made.raw(row, local, value, n)
            error = share * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label)
            e = error[row] * value
            g_weight = np.bincount(local, e, m) + DECAY * made.weight
            own = np.bincount(local, error[row] * value * value, m)
            g_factors = np.stack([np.bincount(local, e * sums[row, f], m) for f in range(RANK)], axis=1)
            g_factors += DECAY * made.factors - own[:, None] * made.factors
            gradient = np.concatenate([[error.sum()], g_weight, g_factors.ravel()])
            moments[0] = 0.9 * moments[0] + 0.1 * gradient
            moments[1] = 0.99 * moments[1] + 0.01 * gradient ** 2
            move = RATE * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-9)
            made.bias -= move[0]
            made.weight -= move[1:1 + m]
            made.factors -= move[1 + m:].reshape(m, RANK)
        weight, factors = np.zeros(n_all), np.zeros((n_all, RANK))
        weight[used], factors[used] = made.weight, made.factors
        return cls(made.bias, weight, factors)


def chosen(rows: DataFrame, key: str, text: str, metadata: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                       *(F.col(f"`{c}`").cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)))


def fit(rows: DataFrame, labels: DataFrame, key: str = KEY, text: str = TEXT, label: str = "label", metadata: tuple[str, ...] = (),
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Fit the machine on at most ``sample_rows`` of the labelled rows (label 0 or 1), those whose keys hash lowest.

    Sampled rows are taken whole, in the order of a hash, for as long as their features fit ``sample_bytes`` (one
    row always is), which is what bounds the driver; no row's words are cut. Null texts count as empty.

    Rows without a label and labels that are null take no part; a key labelled twice counts once, with its higher label.
    With no labelled row at all the machine scores everything 0.5.
    """
    marks = (labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull())
             .groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("mark")))
    marks = marks.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    texts = chosen(rows, key, text, metadata).join(F.broadcast(marks), "key")  # at most ``sample_rows`` rows

    def step(batches):
        made = Features()
        for batch in batches:
            all_texts, marks_ = batch.column(1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            meta = [batch.column(2 + j).to_pylist() for j in range(len(metadata))]
            for a, b in slices(all_texts):
                row, feature, value = made.of(all_texts[a:b], [m[a:b] for m in meta])
                starts = np.searchsorted(row, np.arange(b - a + 1))
                parts = []
                for i in range(b - a):
                    f, v = feature[starts[i]:starts[i + 1]], value[starts[i]:starts[i + 1]]
                    parts.append((f.astype("<i4").tobytes(), v.astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks_[a:b], pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
                    names=["mark", "feature", "value"])

    order = (F.xxhash64("feature", "value"), "mark")
    sample = stage(map_batches(texts, step, "mark int, feature binary, value binary").orderBy(*order).limit(sample_rows)
                   .withColumn("place", F.monotonically_increasing_id()), "quality-sample")
    sizes = sample.select("place", F.octet_length("feature") + F.octet_length("value")).orderBy("place").collect()  # at most ``sample_rows`` numbers
    ends = np.cumsum([size for _, size in sizes])
    taken = max(int(np.searchsorted(ends, sample_bytes, side="right")), 1)
    found = sample.where(F.col("place") <= sizes[taken - 1][0]).orderBy("place").collect() if sizes else []
    n_all = n_features(len(metadata))
    if not found:
        return Machine(0.0, np.zeros(n_all), np.zeros((n_all, RANK)))
    features = [np.frombuffer(r["feature"], "<i4") for r in found]
    row = np.repeat(np.arange(len(found)), [len(f) for f in features])
    value = np.concatenate([np.frombuffer(r["value"], "<f4") for r in found]).astype(float)
    return Machine.fit(row, np.concatenate(features).astype(np.int64), value, np.array([r["mark"] for r in found], float), n_all)


def score(rows: DataFrame, machine: Machine, key: str = KEY, text: str = TEXT, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``score``) from 0 to 1 for every whole text; higher: label 1 is likelier.

    General: the reference has no prose records, so ``rows`` is any frame with a key, a text and, if
    wanted, numeric ``metadata``. Null texts count as empty and still get a score, null or NaN metadata has a step of its
    own, repeated rows each give a row, other columns are ignored. No shuffle; the machine is of fixed size and is broadcast.
    """
    shared = rows.sparkSession.sparkContext.broadcast((machine.bias, machine.weight.astype(np.float32), machine.factors.astype(np.float32)))

    def step(batches):
        made, found = once("features", "", Features), Machine(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            meta = [batch.column(2 + j).to_pylist() for j in range(len(metadata))]
            out = [np.zeros(0)]
            for a, b in slices(texts):
                out.append(found.scores(*made.of(texts[a:b], [m[a:b] for m in meta]), b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], names=[key, "score"])

    return map_batches(chosen(rows, key, text, metadata), step, f"`{key}` {key_type(rows, key)}, score double")
