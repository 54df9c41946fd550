"""Token ids stored as a wavelet matrix per shard."""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.llm.text import (KEY, ODD_SPACE, STABLE, TEXT, byte_letters, key_type, map_batches, once, read_source,
                               slices, specials, tokenizer)
from fairline.llm.token_counts import PRE_TOKENS
from fairline.session import shared_folder

SHARD_TOKENS = 1_000_000
END_ID = 0
#: A plane's directory counts the ones before each block of this many 64-bit words.
BLOCK_WORDS = 8
BLOCK = 64 * BLOCK_WORDS
#: Occurrences looked up at once; each unpacks a block.
LOOKUPS = 4_096
#: Characters of a text by which rows of one key are parted over tasks.
TIE_CHARS = 64


class Wavelet:
    """A sequence of ids as bit-planes, highest bit first, with a directory: the ones before each 512-bit block.

    In each plane the ids with a 0 come before those with a 1 in the next plane's order, so one rank
    per plane answers access, counting and occurrence look-up without decoding anything else. The directory is
    part of the written form; a rank reads one of its numbers and one block, and nothing is counted on loading.
    """

    def __init__(self, length: int, planes: np.ndarray, zeros: list[int], ones: np.ndarray):
        self.length, self.planes, self.zeros, self.ones = length, planes, zeros, ones

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> Wavelet:
        planes, zeros = np.zeros((bits, (len(ids) // BLOCK + 1) * BLOCK // 8), np.uint8), []
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for plane, b in zip(planes, range(bits - 1, -1, -1), strict=True):
            bit = (rest >> rest.dtype.type(b)) & rest.dtype.type(1) != 0
            plane[:(len(ids) + 7) // 8] = np.packbits(bit, bitorder="little")
            low = np.compress(~bit, rest)
            zeros.append(len(low))
            rest = np.concatenate([low, np.compress(bit, rest)])
        blocks = planes.view("<u8").reshape(bits, -1, BLOCK_WORDS)
        ones = np.bitwise_count(blocks).sum(2, dtype=np.uint32)
        return cls(len(ids), blocks, zeros, (np.cumsum(ones, axis=1, dtype=np.uint32) - ones).astype("<u4"))

    def to_bytes(self) -> bytes:
        """The planes, then their directory."""
        return self.planes.tobytes() + self.ones.tobytes()

    @classmethod
    def from_bytes(cls, length: int, zeros: list[int], data: bytes) -> Wavelet:
        bits, blocks = len(zeros), length // BLOCK + 1
        planes = np.frombuffer(data, "<u8", bits * blocks * BLOCK_WORDS).reshape(bits, blocks, BLOCK_WORDS)
        return cls(length, planes, list(zeros), np.frombuffer(data, "<u4", bits * blocks, planes.nbytes).reshape(bits, blocks))

    def bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[plane][at // BLOCK, at % BLOCK // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)

    def rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at // BLOCK
        left = np.clip((at % BLOCK)[:, None] - 64 * np.arange(BLOCK_WORDS), 0, 64)  # bits of each word that lie before
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
        return self.ones[plane][block] + np.bitwise_count(self.planes[plane][block] & mask).sum(1, dtype=np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for p, zeros in enumerate(self.zeros):
            bit, ones = self.bit(p, at).astype(bool), self.rank(p, at)
            at = np.where(bit, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def span(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences in [start, stop) stand below the last plane."""
        ends = np.array([start, stop], np.int64)
        for p, zeros in enumerate(self.zeros):
            ones = self.rank(p, ends)
            ends = zeros + ones if token >> (len(self.zeros) - 1 - p) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        if token >> len(self.zeros):
            return 0
        first, last = self.span(token, start, self.length if stop is None else stop)
        return last - first

    def find(self, token: int) -> np.ndarray:
        """All positions of the token, ascending: each plane's select, from the last plane up."""
        if token >> len(self.zeros):
            return np.zeros(0, np.int64)
        first, last = self.span(token, 0, self.length)
        at = np.arange(first, last)
        for p in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - p) & 1
            at = self.select(p, one, at - self.zeros[p] if one else at)
        return at

    def select(self, plane: int, one: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) ones or zeros of a plane."""
        ones = self.ones[plane].astype(np.int64)
        before, out = ones if one else np.arange(len(ones)) * BLOCK - ones, []
        for some in (nth[i:i + LOOKUPS] for i in range(0, len(nth), LOOKUPS)):
            block = np.searchsorted(before, some, side="right") - 1
            bits = np.unpackbits(np.ascontiguousarray(self.planes[plane][block]).view(np.uint8), axis=1, bitorder="little") == one
            out.append(block * BLOCK + np.argmax(np.cumsum(bits, axis=1) == (some - before[block] + 1)[:, None], axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def decode(self) -> np.ndarray:
        """All ids in order; the planes are merged from the last one up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        ids = np.zeros(self.length, kind)
        for b, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bit = np.unpackbits(plane.reshape(-1).view(np.uint8), count=self.length, bitorder="little").view(bool)
            order = np.empty(self.length, kind)
            order[np.flatnonzero(~bit)] = ids[:zeros]
            order[np.flatnonzero(bit)] = ids[zeros:] | kind(1 << b)
            ids = order
        return ids


class ByteIds:
    """Ids of a byte-level vocabulary, equal to the tokenizers library's.

    Texts of letters whose classes are the same in every Unicode version go through the faster
    library over the same vocabulary, whose ids after the single bytes are merge ranks; texts with
    other characters, odd spaces or special strings go through the tokenizers library.
    """

    def __init__(self, source: str):
        self.tok = tokenizer(source)
        self.special = specials(self.tok)
        model = json.loads(source)["model"]
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items()}
        if any(ranks[bytes(map(back.__getitem__, a + b))] != 256 + n for n, (a, b) in enumerate(model["merges"])):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or not text.isascii() and (STABLE.search(text) or ODD_SPACE.search(text)):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def shard_schema(kind: str) -> str:
    return (f"part int, shard int, keys array<{kind}>, lengths array<bigint>, n_tokens bigint, bits int, zeros array<bigint>, "
            "planes binary")


def write_tokens(rows: DataFrame, path: str, vocabulary: str, key: str = KEY, text: str = TEXT, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, ``end_id`` after it, and write the ids in ascending key order.

    The format: a Parquet file per range of keys, compressed with zstd, a row per shard of about
    ``shard_tokens`` ids: the keys and lengths of its texts and the bit-planes of its wavelet matrix with their rank directory.
    ``part`` and ``shard`` order the shards. Equal keys are ordered by text (and may lie in several files), null keys come first, null texts are empty; other columns
    are ignored and an empty frame writes no shard. A text is never split, so a shard may be longer by one text.
    """
    source = read_source(vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(source)
    kind = key_type(rows, key)
    bits = max(1, (max(tokenizer(source).get_vocab(with_added_tokens=True).values()) | end_id).bit_length())
    types = [pa.int32(), pa.int32(), None, pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    names = ["part", "shard", "keys", "lengths", "n_tokens", "bits", "zeros", "planes"]

    def step(batches):
        made = once("byte ids", shared.value, lambda: ByteIds(shared.value))
        part, shard, keys, lengths, held, total, key_kind = TaskContext.get().partitionId(), 0, [], [], [], 0, None

        def row():
            tree = Wavelet.build(np.concatenate(held), bits)
            values = [part, shard, keys, lengths, tree.length, bits, tree.zeros, tree.to_bytes()]
            arrays = [pa.array([v], t or pa.list_(key_kind)) for v, t in zip(values, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key_kind = batch.schema.field(0).type
            texts, names_ = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in slices(texts):
                for k, t in zip(names_[a:b], texts[a:b], strict=True):
                    ids = np.array([*made.encode(t), end_id], np.uint32).astype(np.uint16 if bits <= 16 else np.uint32)
                    keys.append(k)
                    lengths.append(len(ids))
                    held.append(ids)
                    total += len(ids)
                    if total >= shard_tokens:
                        yield row()
                        shard, keys, lengths, held, total = shard + 1, [], [], [], 0
        if held:
            yield row()

    chosen = rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ordered = chosen.repartitionByRange("key", F.substring("text", 1, TIE_CHARS)).sortWithinPartitions("key", "text")
    map_batches(ordered, step, shard_schema(kind)).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first``, the number of ids in the shards before each (two short running sums), and their own number ``n``."""
    table = spark.read.parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), zero).alias("before"))
    return (table.select("part", "shard", "n_tokens", F.coalesce(F.sum("n_tokens").over(inside), zero).alias("within"))
            .join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("first"), F.col("n_tokens").alias("n")))


def read_tokens(spark: SparkSession, path: str, key: str = KEY, digests: bool = False) -> DataFrame:
    """The texts' ids from the files: (key, ``start``, ``n_tokens``, ``ids``), ``start`` counting the ids of all earlier texts.

    ``digests``: ``ids_crc32`` (little-endian unsigned 32-bit ids) in place of ``ids``.
    """
    table = spark.read.parquet(path)
    kind = table.schema["keys"].dataType.elementType.simpleString()
    value = ("ids_crc32", "bigint", pa.int64()) if digests else ("ids", "array<int>", pa.list_(pa.int32()))

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Wavelet.from_bytes(row["n_tokens"], row["zeros"], row["planes"]).decode()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                parts = (ids[a:b] for a, b in zip(starts, ends, strict=True))
                values = [zlib.crc32(p.astype("<u4")) for p in parts] if digests else [p.tolist() for p in parts]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                     pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array(starts, pa.int64()),
                     pa.array(row["lengths"], pa.int64()), pa.array(values, value[2])],
                    names=["part", "shard", "key", "inside", "n_tokens", value[0]])

    found = map_batches(table, step, f"part int, shard int, key {kind}, inside bigint, n_tokens bigint, {value[0]} {value[1]}")
    return (found.join(shards(spark, path).drop("n"), ["part", "shard"])
            .select(F.col("key").alias(key), (F.col("first") + F.col("inside")).alias("start"), "n_tokens", value[0]))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of an id, as its ``position`` among all ids; planes are asked, nothing is decoded. Empty files and ids
    that don't occur give no rows."""
    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = Wavelet.from_bytes(row["n_tokens"], row["zeros"], row["planes"]).find(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(found), pa.int32()), pa.array([row["shard"]] * len(found), pa.int32()),
                                                  pa.array(found, pa.int64())], names=["part", "shard", "inside"])

    found = map_batches(spark.read.parquet(path).select("part", "shard", "n_tokens", "zeros", "planes"), step, "part int, shard int, inside bigint")
    return found.join(shards(spark, path), ["part", "shard"]).select((F.col("first") + F.col("inside")).alias("position"))


def read_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """(position, ``id``): the id at each position among all ids, by one rank a plane; shards that hold none are not opened.

    Positions that are null or outside the files have a null id; repeated rows each have theirs; other columns are not read.
    Positions meet shards through stretches of ``SHARD_TOKENS`` ids, an equi-join.
    """
    asked = positions.select(F.col(f"`{position}`").cast("bigint").alias("position"))
    lot = lambda at: F.floor(at / SHARD_TOKENS)
    spans = shards(spark, path).where("n > 0").withColumn("lot", F.explode(F.sequence(lot(F.col("first")), lot(F.col("first") + F.col("n") - 1))))
    met = asked.where("position >= 0").distinct().withColumn("lot", lot(F.col("position"))).join(spans, "lot").where("position >= first AND position < first + n")
    held = met.groupBy("part", "shard", "first").agg(F.collect_list(F.col("position") - F.col("first")).alias("inside"))  # at most the shard's ids

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["inside"], np.int64)
                found = Wavelet.from_bytes(row["n_tokens"], row["zeros"], row["planes"]).access(at)
                yield pa.RecordBatch.from_arrays([pa.array(at + row["first"]), pa.array(found, pa.int32())], names=["position", "id"])

    opened = spark.read.parquet(path).select("part", "shard", "n_tokens", "zeros", "planes").join(held, ["part", "shard"]).select(
        "n_tokens", "zeros", "planes", "first", "inside")
    return asked.join(map_batches(opened, step, "position bigint, id int"), "position", "left").select(F.col("position").alias(position), "id")


def count_token(spark: SparkSession, path: str, token: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """One row, ``n``: how often an id stands in [start, stop) of all ids, by two ranks a plane of each shard touched; 0 for empty files."""
    spans = shards(spark, path).where(F.col("first") + F.col("n") > start)
    if stop is not None:
        spans = spans.where(F.col("first") < stop)

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = [min(max(x - row["first"], 0), row["n_tokens"]) for x in (start, row["first"] + row["n_tokens"] if stop is None else stop)]
                n = Wavelet.from_bytes(row["n_tokens"], row["zeros"], row["planes"]).count(token, *ends) if ends[0] < ends[1] else 0
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    opened = spark.read.parquet(path).select("part", "shard", "n_tokens", "zeros", "planes").join(spans.drop("n"), ["part", "shard"])
    found = map_batches(opened.select("n_tokens", "zeros", "planes", "first"), step, "n bigint")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"))


def store(rows: DataFrame, vocabulary: str, key: str = KEY, text: str = TEXT, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write ``rows`` with :func:`write_tokens` (in the shared folder unless ``path`` is given) and read the digests back.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text. Nulls, ties, empty texts
    and tables, and other columns are as in :func:`write_tokens`; repeated rows each have their ids.
    """
    spark = rows.sparkSession
    path = path or os.path.join(shared_folder(spark), "fairline", f"tokens-{uuid.uuid4().hex}")
    write_tokens(rows, path, vocabulary, key, text, end_id)
    return read_tokens(spark, path, key, digests=True)
