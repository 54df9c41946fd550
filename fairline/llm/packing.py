"""Best-fit packing of token pieces into sequences, with exact complements found by hashing length sums."""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.bpe import END, Merges, Words
from fairline.llm.text import KEY, TEXT, byte_letters, key_type, keyed, map_batches, once, read_source, specials, tokenizer
from fairline.session import stage

SIZE = 2048
END_ID = 0
#: Ranks within a length are counted per bucket, so that no length is ordered in one task.
BUCKETS = 256


class WordIds:
    """Ids of texts under a word-end vocabulary, equal to the tokenizers library's.

    Texts are normalised, a mark is put after each pre-token, and a faster library merges the bytes with the
    mark as the word end. It merges by joined bytes where the vocabulary names pairs; :meth:`same_merges` proves
    offline that no other pair ever stands where a token could be made. Texts with newer letters, the mark
    or special strings, and vocabularies without that proof, go through the tokenizers library.
    """

    MARK = "\0"

    def __init__(self, source: str):
        self.tok, self.special = tokenizer(source), specials(tokenizer(source))
        model = json.loads(source)["model"]
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(back.__getitem__, t.removesuffix(END))) + (self.MARK.encode() if t.endswith(END) else b""): i
                 for t, i in model["vocab"].items() if t not in self.special}
        ordered = all(model["vocab"][a + b] == 512 + n for n, (a, b) in enumerate(model["merges"]))
        sound = ordered and len(ranks) == 512 + len(model["merges"]) and self.same_merges(Merges(source))
        self.fast = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}) if sound else None
        self.words = Words(source)

    @staticmethod
    def same_merges(merges: Merges) -> bool:
        """Whether each token comes from its letters, and no two tokens that spell a third without being its parts stay apart."""
        for token in merges.ids:
            if token not in merges.parts:
                continue
            if not merges.stands(token):
                return False
            end = END if token.endswith(END) else ""
            body = token.removesuffix(END)
            for i in range(1, len(body)):
                pair = body[:i], body[i:] + end
                if (pair != merges.parts[token] and pair[0] in merges.ids and pair[1] in merges.ids
                        and merges.stands(pair[0]) and merges.stands(pair[1]) and merges.apart(*pair)):
                    return False
        return True

    def encode(self, text: str) -> list[int]:
        marked = None
        if self.fast and self.MARK not in text and not any(s in text for s in self.special):
            marked = self.words.marked(text, self.MARK)
        return self.tok.encode(text, add_special_tokens=False).ids if marked is None else self.fast.encode_ordinary(marked)


def cut(rows: DataFrame, vocabulary: str, size: int = SIZE, key: str = KEY, text: str = TEXT, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``size`` tokens: (key, ``piece``, ``start``, ``length``, ``ids_crc32``).

    A text's ids are the library's, without added tokens, and ``end_id`` after them; only longer ones are cut.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_source(vocabulary))

    def step(batches):
        made = once("word ids", shared.value, lambda: WordIds(shared.value))
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text_ in enumerate(batch.column(1).to_pylist()):
                data = memoryview(np.array([*made.encode(text_), end_id], "<u4").tobytes())
                for n, begin in enumerate(range(0, len(data), 4 * size)):
                    part = data[begin:begin + 4 * size]
                    at.append(row)
                    piece.append(n)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["key", "piece", "start", "length", "ids_crc32"])

    return map_batches(keyed(rows, key, text), step, f"key {key_type(rows, key)}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with how many sequences take it; every piece is in exactly one.

    First exact complements: for the longest length left, the gap to ``size`` is looked up among the
    sums of one, two and three available lengths, and a match is taken as often as the counts allow.
    Each match uses up a length, so there are at most a few patterns per length, however many pieces.
    What is left goes, longest first, to the sequence it fills best.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit {size}")
        left[length] += n
    index = Sums(left)
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        patterns.append(((size,), int(left[size])))
        index.take((size,), int(left[size]))
    for length in range(size - 1, 0, -1):
        while left[length]:
            rest = index.complement(length, size - length)
            if not rest:
                break
            pattern = (length, *rest)
            times = min(int(left[x]) // n for x, n in Counter(pattern).items())
            patterns.append((pattern, times))
            index.take(pattern, times)
    return patterns + best_fit({x: int(n) for x, n in enumerate(left) if n}, size)


class Sums:
    """The sums of one, two and three available lengths; kept up as lengths run out."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.single = left > 0
        #: How many pairs of different available lengths have each sum; equal pairs are asked of ``left``.
        self.pair = np.zeros(2 * len(left), np.int64)
        have = np.flatnonzero(self.single)
        for n, a in enumerate(have):
            self.pair[a + have[n + 1:]] += 1

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
        for x in set(lengths):
            if self.left[x] == 0 and self.single[x]:
                self.single[x] = False
                self.pair[x + np.flatnonzero(self.single)] -= 1

    def fits(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= n for x, n in Counter(lengths).items())

    def pairs(self, total: int) -> list[tuple[int, int]]:
        low = np.arange(1, total // 2 + 1)
        low = low[self.single[low] & self.single[total - low]][::-1]
        return [(int(total - x), int(x)) for x in low]

    def complement(self, length: int, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that fill ``gap`` beside ``length``; none: ()."""
        if self.fits((length, gap)):
            return (gap,)
        if self.pair[gap] or (gap % 2 == 0 and self.single[gap // 2]):
            for two in self.pairs(gap):
                if self.fits((length, *two)):
                    return two
        first = np.arange(gap - 2, 0, -1)
        rest = gap - first
        even = (rest % 2 == 0) & self.single[rest // 2]
        for a in first[self.single[first] & ((self.pair[rest] > 0) | even)]:
            for two in self.pairs(gap - int(a)):
                if self.fits((length, int(a), *two)):
                    return (int(a), *two)
        return ()


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over groups of alike sequences instead of single ones."""
    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            space = min((s for s, groups in spaces.items() if s >= length and groups), default=None)
            if space is None:
                most = size // length
                for held, times in ((most, n // most), (n % most, 1)):
                    if held and times:
                        spaces.setdefault(size - held * length, []).append(((length,) * held, times))
                n = 0
                continue
            pattern, times = spaces[space].pop()
            placed = min(n, times)
            if times > placed:
                spaces[space].append((pattern, times - placed))
            spaces.setdefault(space - length, []).append(((*pattern, length), placed))
            n -= placed
    return [group for groups in spaces.values() for group in groups]


def seats(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks of a length sit in sequences in turn."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(rows: DataFrame, vocabulary: str, size: int = SIZE, key: str = KEY, text: str = TEXT, end_id: int = END_ID) -> DataFrame:
    """Texts cut into pieces and seated in as few sequences of ``size`` tokens as the method finds.

    General: the reference has no prose records, so ``rows`` is any frame with a key and a text.
    ``vocabulary`` is the path of a word-end BPE file of the tokenizers library.  Returns per piece the key,
    ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``; sequences are filled gaplessly from 0.
    Null and empty texts are the end id alone; repeated rows each give their pieces, null keys stay null,
    other columns are ignored, an empty frame gives an empty frame. Pieces of one length are interchangeable
    and ranked by key and piece.

    Only lengths matter to the plan, and there are at most ``size`` of them: Spark counts the pieces of
    each length, the plan is made on those counts (exact complements, then best fit), and each piece finds
    its seat by its rank within its length. Ranks are taken per (length, bucket), so a hot length is split.
    """
    pieces = stage(cut(rows, vocabulary, size, key, text, end_id)
                   .withColumn("bucket", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")), "pieces")
    cells = stage(pieces.groupBy("length", "bucket").count(), "piece-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    table = seats(plan(counts, size))
    shared = rows.sparkSession.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("key", "piece", "ids_crc32")
    ranked = (pieces.withColumn("n", F.row_number().over(within)).join(before, ["length", "bucket"])
              .select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n") - 1).alias("rank")))

    def step(batches):
        seat = shared.value
        order = (seat[:, 0] << 44) + seat[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            found = seat[np.searchsorted(order, (length << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(ranked, step, f"`{key}` {key_type(rows, key)}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                     "sequence_id bigint, offset bigint")
