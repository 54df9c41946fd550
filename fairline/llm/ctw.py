"""Language-model scores by context-tree weighting over byte contexts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.text import KEY, TEXT, key_type, map_batches, once
from fairline.session import ship_package, stage

DEPTH = 5
#: Contexts of up to this many bytes are few enough to be weighted on the driver: 65,793 contexts at most.
TOP = 2
EDGE = 255  # stands around every text; UTF-8 never holds it
BLOCK_BYTES = 100_000_000
PART_BYTES = 1_000_000
WORD_FLAG = 1 << 63
LN2 = np.log(2.0)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def log_factorials(n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """ln of the products 0.5 * 1.5 * ... (k terms) and of k!, for k below n."""
    k = np.arange(n - 1)
    return np.concatenate([[0], np.cumsum(np.log(k + 0.5))]), np.concatenate([[0], np.cumsum(np.log(k + 1.0))])


HALVES, WHOLES = log_factorials()


def stirling(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for large x."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov estimate of a bit sequence with these counts."""
    def halves(k):
        return np.where(k < len(HALVES), HALVES[np.minimum(k, len(HALVES) - 1)], stirling(np.maximum(k, 1) + 0.5) - 0.5 * np.log(np.pi))
    n = zeros + ones
    return halves(zeros) + halves(ones) - np.where(n < len(WHOLES), WHOLES[np.minimum(n, len(WHOLES) - 1)], stirling(np.maximum(n, 1) + 1.0))


def bit_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the bit decomposition: (context << 8 | place in the bit tree, zeros, ones), from sorted context << 8 | byte.

    The place is 1 for a byte's first bit and 2p + bit below place p, so a byte's bits pass the places 1, 2-3, 4-7, ...
    """
    parts = []
    for b in range(8):
        place = (1 << b) | ((keys & 255) >> (8 - b))
        node = (keys >> 8 << 8) | place
        bit = (keys >> (7 - b)) & 1
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        ones = np.add.reduceat(counts * bit, starts) if len(starts) else counts[:0]
        both = np.add.reduceat(counts, starts) if len(starts) else counts[:0]
        parts.append((node[starts], both - ones, ones))
    node, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(node, kind="stable")
    return node[order], zeros[order], ones[order]


class Level:
    """The nodes of one context depth: counts, ln P_w, and the share that stays at the node."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """``below``: per node, the sum of ln P_w over its children; None at the greatest depth."""
        self.node, self.zeros, self.ones = node, zeros, ones
        kt = log_kt(zeros, ones)
        if below is None:
            self.weighted, self.stay = kt, np.ones(len(node))
        else:
            self.weighted = np.logaddexp(kt, below) - LN2
            self.stay = np.exp(kt - LN2 - self.weighted)
        self.estimate = (ones + 0.5) / (zeros + ones + 1.0)  # of a one

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, zeros, ones, sum of ln P_w) one byte of context up; the farthest byte is the lowest of the context."""
        up, at = np.unique((self.node >> 16 << 8) | (self.node & 255), return_inverse=True)
        sums = [np.bincount(at, x, len(up)) for x in (self.zeros, self.ones, self.weighted)]
        return up, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]

    def mixed(self, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, P(one) mixed over the depths down to this one, weight left for greater depths)."""
        if above is None:
            return self.node, self.stay * self.estimate, 1 - self.stay
        at = np.searchsorted(above[0], (self.node >> 16 << 8) | (self.node & 255))
        return self.node, above[1][at] + above[2][at] * self.stay * self.estimate, above[2][at] * (1 - self.stay)


def tree_up(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels from ``depth`` to ``top`` + 1, of sorted (context << 8 | byte) keys, nearest byte highest."""
    node, zeros, ones = bit_nodes(keys, counts)
    levels = [Level(node, zeros, ones, None)]
    for _ in range(depth - top - 1):
        node, zeros, ones, below = levels[-1].parents()
        levels.append(Level(node, zeros, ones, below))
    return levels


def grams_of(block: np.ndarray, depth: int) -> np.ndarray:
    """At each place from ``depth`` on: the bytes before it, the nearest highest, and the byte itself lowest."""
    n = len(block) - depth
    wide = block.astype(np.int64)
    out = wide[depth:depth + n].copy()
    for i in range(depth):
        out |= wide[i:i + n] << (8 * (i + 1))
    return out


def padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with their edges as one array, the places to code (text and end), and how many each text has."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes + depth) - sizes - depth  # of each text's padding
    # grams_of's place i codes byte i + depth, so a text's places begin where its padding does
    keep = np.ones(len(data) - depth, bool)
    for shift in range(depth):
        late = first[1:] - depth + shift
        keep[late] = False
    return data, np.flatnonzero(keep), sizes


def parts_of(texts: list[bytes], most: int = PART_BYTES):
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def lowered(text: str) -> bytes:
    return text.encode().translate(LOWER)


class Words:
    """64-bit names of the words in a padded array of texts, the highest bit set (gram keys leave it clear).

    A name is the sum of its bytes' random numbers times powers of an odd base, from one running sum over the array.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.letter = np.random.default_rng(64).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32, EDGE]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            steps = [np.full(n, b, np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            self.power, self.inverse = (np.multiply.accumulate(s) for s in steps)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each word starts, its name)."""
        self.grow(len(data))
        inside = ~self.space[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # texts stand between edges: starts and ends by turns
        starts, stops = edges[::2], edges[1::2]
        sums = np.cumsum(self.letter[data] * self.power[:len(data)], dtype=np.uint64)
        names = (sums[stops - 1] - sums[starts - 1]) * self.inverse[starts]
        names = (names ^ (names >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return starts, ((names ^ (names >> np.uint64(29))) | np.uint64(WORD_FLAG)).view(np.int64)


class Gathered:
    """What one block of texts holds: its distinct words and byte grams, with their counts in training texts."""

    def __init__(self, depth: int):
        self.depth, self.words, self.keys, self.counts = depth, once("ctw words", "", Words), [], []
        self.held = 0

    def add(self, texts: list[bytes], train: list[bool]) -> None:
        for a, b in parts_of(texts):
            data, places, sizes = padded(texts[a:b], self.depth)
            learn = np.array(train[a:b])
            starts, names = self.words.of(data)
            grams = grams_of(data, self.depth)[places]
            for some, use in ((grams, np.repeat(learn, sizes)), (names, learn[owners(starts, sizes, self.depth)])):
                for part, counted in ((some[use], True), (some[~use], False)):
                    keys, counts = np.unique(part, return_counts=True)
                    self.keys.append(keys)
                    self.counts.append(counts if counted else np.zeros(len(keys), np.int64))
                    self.held += len(keys)
            if self.held > 1_500_000:
                self.merge()
                self.held = 0

    def merge(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[first]], [np.add.reduceat(np.concatenate(self.counts)[order], first)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        return self.keys[0], self.counts[0]


def owners(starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """The text of each place in a padded array."""
    return np.searchsorted(np.cumsum(sizes + depth), starts, side="right")


def labelled(rows: DataFrame, key: str, text: str, train: str) -> DataFrame:
    """(block, key, text, train): a block is what lies together in the table, about ``BLOCK_BYTES`` of text.

    Large blocks keep the tables of distinct words and grams small. A table is split alike in every reading, so a
    row has the same block each time; if it ever had not, :class:`Table` would miss its words and stop the job.
    """
    chosen = rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                         F.coalesce(F.col(f"`{train}`"), F.lit(False)).alias("train"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return chosen.coalesce(max(1, -(-int(size) // BLOCK_BYTES))).select(F.spark_partition_id().alias("block"), "key", "text", "train")


def gather(blocks: DataFrame, depth: int) -> DataFrame:
    """(block, item, n): the distinct words and grams of each block with their training counts."""
    def answer(block: int, found: Gathered):
        items, counts = found.result()
        for i in range(0, len(items), 200_000):
            n = len(items[i:i + 200_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(items[i:i + n]), pa.array(counts[i:i + n])],
                                             names=["block", "item", "n"])

    def step(batches):
        now, found = None, None  # a file holds its blocks one after the other
        for batch in batches:
            ids = batch.column(0).to_numpy()
            borders = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if a == b:
                    continue
                if now != ids[a]:
                    if found:
                        yield from answer(now, found)
                    now, found = ids[a], Gathered(depth)
                for i in range(a, b, 500):
                    part = batch.slice(i, min(500, b - i))
                    found.add([lowered(t) for t in part.column(2).to_pylist()], part.column(3).to_pylist())
        if found:
            yield from answer(now, found)

    return map_batches(blocks, step, "block int, item bigint, n bigint")


def top_levels(nodes: pd.DataFrame, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights down to depth ``top`` from its nodes (node, zeros, ones, below)."""
    nodes = nodes.sort_values("node")
    levels = [Level(*(nodes[c].to_numpy() for c in ("node", "zeros", "ones", "below")))]
    for _ in range(top):
        levels.append(Level(*levels[-1].parents()))
    above = None
    for level in reversed(levels):
        above = level.mixed(above)
    return above


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(item, value): log10 P(byte | its context) of every gram, from (item, total) with the training counts.

    Contexts of three bytes are dealt over the tasks and weighted there from the leaves up; their sums per two-byte context
    (at most 65,536 contexts times 255 places) finish the tree, and the mixed estimates go down again.
    Grams that training never saw are nodes without counts: their estimates are one half, as the method has it.
    """
    spark = grams.sparkSession
    ship_package(spark)
    dealt = grams.select("item", "total", F.expr(f"shiftright(item, {8 * (depth - TOP)})").alias("near"))
    ordered = stage(dealt.repartition("near").sortWithinPartitions("item"), "ctw-grams")
    held = ordered.select("item", "total", "near").repartition("near").sortWithinPartitions("item")

    def whole(batches):
        keys, counts = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
        return (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def up(batches):
        keys, counts = whole(batches)
        if len(keys):
            node, zeros, ones, below = tree_up(keys, counts, depth, TOP)[-1].parents()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zeros, ones, below)], names=["node", "zeros", "ones", "below"])

    nodes = (map_batches(held, up, "node bigint, zeros bigint, ones bigint, below double")
             .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas())
    shared = spark.sparkContext.broadcast(top_levels(nodes, TOP))

    def down(batches):
        keys, counts = whole(batches)
        if not len(keys):
            return
        above = shared.value
        for level in reversed(tree_up(keys, counts, depth, TOP)):
            above = level.mixed(above)
        value = np.zeros(len(keys))
        for b in range(8):
            at = np.searchsorted(above[0], (keys >> 8 << 8) | (1 << b) | ((keys & 255) >> (8 - b)))
            one = above[1][at]
            value += np.log10(np.where((keys >> (7 - b)) & 1, one, 1 - one))
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 200_000]), pa.array(value[i:i + 200_000])], names=["item", "value"])

    return map_batches(held, down, "item bigint, value double")


class Table:
    """Look-up of sorted keys through a direct table, with a search for what the table misses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self.at(keys)] = np.arange(len(keys), dtype=np.int32)

    def at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            if len(keys):
                raise RuntimeError("a block was read with other rows than it was gathered from")
            return self.values[:0]
        found = self.slot[self.at(keys)]
        wrong = np.flatnonzero(self.keys[found] != keys)
        if len(wrong):
            at = np.minimum(np.searchsorted(self.keys, keys[wrong]), len(self.keys) - 1)
            if (self.keys[at] != keys[wrong]).any():
                raise RuntimeError("a block was read with other rows than it was gathered from")
            found[wrong] = at
        return self.values[found]


def score(rows: DataFrame, train: str, key: str = KEY, text: str = TEXT, depth: int = DEPTH) -> DataFrame:
    """Scores of every whole text under models learned from the rows where ``train`` is true: a row per row.

    General: the reference has no prose records, so ``rows`` is any frame with a key, a text and the mark; it is read
    twice and has to be a table (stage other frames first).
    Returns the key, ``train``, ``n_tokens`` (words and one end), ``n_known`` (tokens that training saw), ``train_tokens``, ``base_score``
    (log10, add-one unigrams of words) and ``score``: log10 of the probability that the context trees give
    the text's bytes and its end. Letters A-Z count as lower case. Null and empty texts are an end alone; a null mark is false; repeated rows each
    give a row and count each in training, null keys stay null, other columns are ignored. Without a training row every bit
    costs one bit. An empty frame gives an empty frame.

    Each of a byte's eight bits has a tree of contexts of 0 to ``depth`` bytes; counts make Krichevsky-Trofimov estimates, and each node
    mixes its own with its children's, one half each, so every depth has a say. Texts are gathered in blocks: a block sends each distinct
    word and gram once and gets its totals and values back, so nothing that grows with the corpus is broadcast. The answers
    of a block come before its texts, which then stream by.
    """
    blocks = labelled(rows, key, text, train)
    counted = stage(gather(blocks, depth), "ctw-items")
    totals = counted.groupBy("item").agg(F.sum("n").alias("total"))
    is_word = F.col("item") < 0
    words = stage(totals.where(is_word), "ctw-words")
    ends = blocks.where("train").count()
    sums = words.agg(F.sum("total").alias("n"), F.count(F.when(F.col("total") > 0, 1)).alias("v")).first()
    n_all, v_all = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    values = gram_scores(totals.where(~is_word), depth)
    model = values.unionByName(words.select("item", F.col("total").cast("double").alias("value")))
    answered = counted.select("item", "block").join(model, "item").select("block", F.lit(0).alias("kind"), "item", "value")
    kind = key_type(rows, key)
    meeting = (answered.unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
               .select("block", "kind", "item", "value", "key", "text", "train").repartition("block").sortWithinPartitions("block", "kind"))
    floor = np.log10(1.0 / (n_all + v_all + 1.0))
    end_score = float(np.log10(ends + 1.0) + floor)

    def step(batches):
        named = once("ctw words", "", Words)
        now, items, values_, vocabulary, grams = None, [], [], None, None
        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            borders = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])) + 1), len(ids)]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if a == b:
                    continue
                if now != ids[a]:
                    now, items, values_, vocabulary, grams = ids[a], [], [], None, None
                if kinds[a] == 0:
                    items.append(batch.column(2).slice(a, b - a).to_numpy())
                    values_.append(batch.column(3).slice(a, b - a).to_numpy())
                    continue
                if grams is None:
                    vocabulary, grams = tables(items, values_)
                    items, values_ = [], []
                for i in range(a, b, 500):
                    part = batch.slice(i, min(500, b - i))
                    texts = [lowered(t) for t in part.column(5).to_pylist()]
                    found = [text_scores(texts[x:y], vocabulary, grams, named, depth) for x, y in parts_of(texts)]
                    tokens, seen, base, model_score = (np.concatenate(x) for x in zip(*found, strict=True))
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(4), part.column(6), pa.array(tokens + 1), pa.array(seen + (ends > 0)), pa.array(np.full(n, n_all, np.int64)),
                         pa.array(base + floor * (tokens + 0.0) + end_score), pa.array(model_score)],
                        names=[key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(meeting, step, f"`{key}` {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def tables(items: list[np.ndarray], values: list[np.ndarray]) -> tuple[Table, Table]:
    """Look-ups of a block's words and grams."""
    keys, found = np.concatenate([np.zeros(0, np.int64), *items]), np.concatenate([np.zeros(0), *values])
    order = np.argsort(keys)
    keys, found = keys[order], found[order]
    first = int(np.searchsorted(keys, 0))
    return Table(keys[:first], found[:first]), Table(keys[first:], found[first:])


def text_scores(texts: list[bytes], vocabulary: Table, grams: Table, named: Words, depth: int) -> tuple[np.ndarray, ...]:
    """Of each text: words, known words, the sum of log10(count + 1) of its words, and the trees' log10 probability."""
    data, places, sizes = padded(texts, depth)
    starts, names = named.of(data)
    owner, counts, n = owners(starts, sizes, depth), vocabulary[names], len(texts)
    value = grams[grams_of(data, depth)[places]]
    return (np.bincount(owner, minlength=n), np.bincount(owner, counts > 0, n).astype(np.int64), np.bincount(owner, np.log10(counts + 1), n),
            np.bincount(np.repeat(np.arange(n), sizes), value, n))
