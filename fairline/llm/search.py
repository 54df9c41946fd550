"""Ranked lexical search of many queries at once: shared sums of terms are made once and combined.

A feed names a fixture in its own words; the matches of the card are ranked for each such name, as for any other
search text. Queries have terms in common, so their common parts are mined first and summed once per match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.text import key_type, keyed, map_batches
from fairline.session import stage

#: Bytes that belong to terms: ASCII digits and letters, and all bytes of characters beyond ASCII.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Queries and distinct terms that one pass over the matches serves; more queries take more passes.
QUERIES, TERMS = 2_048, 1 << 17
#: Matches scored at once in a task, and the most sums they may take.
BLOCK, SUMS = 1_024, 1 << 23


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Sharing:
    """Sums that queries share, as a DAG. Nodes below ``len(terms)`` are single terms; node ``len(terms) + i`` adds
    the two earlier nodes ``parts[i]``; ``queries[q]`` are the nodes whose sum is the query's score."""

    terms: list[bytes]
    parts: np.ndarray
    queries: list[list[int]]


def mine(queries: list[list[bytes]]) -> Sharing:
    """Sums worth keeping among ``queries``.

    Each query's terms, repeats included, are put in one order for all, the most shared first. In rounds, pairs of
    neighbours that two queries or more have are joined to one node, the most frequent first and without overlap,
    until no pair repeats. Neighbours only, so a round costs as many pairs as the queries have nodes.
    """
    held_by = Counter(t for q in queries for t in set(q))
    terms = sorted(held_by, key=lambda t: (-held_by[t], t))
    number = {t: i for i, t in enumerate(terms)}
    lists, parts = [sorted(number[t] for t in q) for q in queries], []
    while True:
        seen = Counter(pair for nodes in lists for pair in set(zip(nodes, nodes[1:])))
        repeated = {pair: n for pair, n in seen.items() if n > 1}
        if not repeated:
            return Sharing(terms, np.array(parts, np.int64).reshape(-1, 2), lists)
        made: dict[tuple[int, int], int] = {}
        for i, nodes in enumerate(lists):
            order = sorted((-repeated[pair], pair, at) for at, pair in enumerate(zip(nodes, nodes[1:])) if pair in repeated)
            taken, firsts = set(), {}
            for _, pair, at in order:
                if at not in taken and at + 1 not in taken:
                    taken |= {at, at + 1}
                    firsts[at] = made.setdefault(pair, len(terms) + len(parts) + len(made))
            lists[i] = [firsts.get(at, node) for at, node in enumerate(nodes) if at in firsts or at not in taken]
        parts += made


def matches_terms(rows: DataFrame, terms: list[bytes], kind: str) -> DataFrame:
    """(key, n, ids, counts): a match's number of terms, and which of ``terms`` it has how often."""
    number = {t: i for i, t in enumerate(terms)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                sizes.append(len(found))
                for term, n in Counter(found).items():
                    if (at := number.get(term)) is not None:
                        ids.append(at)
                        counts.append(n)
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), *lists], ["key", "n", "ids", "counts"])

    return map_batches(rows, step, f"key {kind}, n bigint, ids array<int>, counts array<int>")


def best_of(scores: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of each query's ``best`` highest scores above 0, earlier columns first among equal ones."""
    n = scores.shape[1]
    if n > best:
        least = np.partition(scores, n - best, axis=1)[:, n - best]
        rows, columns = np.nonzero((scores >= np.maximum(least, 1)[:, None]))
    else:
        rows, columns = np.nonzero(scores > 0)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < best], columns[rank < best]


def scored(stored: DataFrame, sharing: Sharing, weights: np.ndarray, n: int, total: int, best: int, kind: str) -> DataFrame:
    """(query, key, score): of each task's matches the ``best`` of each query."""
    parts, held = sharing.parts, sharing.queries
    owner = np.repeat(np.arange(len(held)), [len(q) for q in held])
    flat = np.array([node for q in held for node in q], np.int64)
    used = np.flatnonzero(np.bincount(owner, minlength=len(held)))
    starts = np.searchsorted(owner, used)
    singles = len(sharing.terms)
    width = max(1, min(BLOCK, SUMS // (singles + len(parts) + len(held))))

    def block(sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Scores of all queries (rows) for a few matches (columns): terms scattered, shared sums once, queries from sums."""
        m = 75 + (25 * sizes * n) // total
        sums = np.zeros((singles + len(parts), len(sizes)), np.int64)
        sums[ids, owners] = weights[ids] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[owners]))
        for i, (one, other) in enumerate(parts):
            np.add(sums[one], sums[other], out=sums[singles + i])
        scores = np.zeros((len(held), len(sizes)), np.int64)
        if len(flat):
            scores[used] = np.add.reduceat(sums[flat], starts, axis=0)
        return scores

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                rows = batch.slice(at, width)
                rows = rows.take(pc.sort_indices(rows, [("key", "ascending")], null_placement="at_end"))
                ids, counts = (rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "counts"))
                owners = np.repeat(np.arange(rows.num_rows), rows.column("ids").value_lengths().to_numpy(zero_copy_only=False))
                scores = block(rows.column("n").to_numpy(), ids, counts, owners)
                query, column = best_of(scores, best)
                fresh = pa.table({"query": pa.array(query, pa.int32()), "key": rows.column("key").take(pa.array(column)),
                                  "score": pa.array(scores[query, column], pa.int64())})
                kept = fresh if kept is None else pa.concat_tables([kept, fresh])
                if kept.num_rows > 8 * best * max(len(held), 1):
                    kept = cut(kept, best)
        if kept is not None:
            yield from cut(kept, best).to_batches()

    return map_batches(stored, step, f"query int, key {kind}, score bigint")


def cut(found: pa.Table, best: int) -> pa.Table:
    """The ``best`` rows of each query: highest score first, smaller keys first among equal ones, no key last."""
    found = found.combine_chunks()
    found = found.take(pc.sort_indices(found, [("query", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_end"))
    query = found.column("query").to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < best))


def blocks(fixtures: DataFrame, queries: int, terms: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries in lots of at most ``queries`` and about ``terms`` distinct terms, read one lot at a time."""
    lot, seen = [], set()
    for row in fixtures.toLocalIterator():
        words = terms_of(row["text"])
        if lot and (len(lot) == queries or len(seen | set(words)) > terms):
            yield lot
            lot, seen = [], set()
        seen |= set(words)
        lot.append((row["key"], words))
    if lot:
        yield lot


def rank_matches(matches: DataFrame, fixtures: DataFrame, key: str = "match_id", text: str = "match", fixture: str = "fixture_id",
                 fixture_text: str = "match", best: int = 20, queries: int = QUERIES, terms: int = TERMS) -> DataFrame:
    """The ``best`` matches of each fixture name: (fixture_id, rank, match_id, score), rank from 1, scores above 0.

    A match's score for a name is the sum over the name's terms, repeats included, of
    w * ((10^9 tf) div (1000 tf + 12 m)) with w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + (25 n N) div L: N and
    L count the matches with a term and their terms, n and tf those of the match, df the matches with the term.
    Equal scores go by ascending key. The numbers are whole, so results are the same in any order of work.

    The names are read in lots of a fixed size. For each lot the sums that its names share are mined (``mine``);
    matches are read once and stored as counts of the lot's terms; then each task scores its matches in blocks,
    every shared sum once per match, and keeps ``best`` a name, so the last sort sees tasks x names x ``best`` rows.

    Null text has no terms and is never found; a null key ranks last among equal scores; repeated rows are ranked
    each, and rows of one fixture id each have their ranks; an empty table gives an empty one; texts are taken
    whole; other columns are never read.
    """
    spark, kind, own = matches.sparkSession, key_type(matches, key), key_type(fixtures, fixture)
    rows, asked = keyed(matches, key, text), keyed(fixtures, fixture, fixture_text)
    found = spark.createDataFrame([], f"lot int, query int, asked {own}, key {kind}, score bigint")
    for lot, block in enumerate(blocks(asked, queries, terms)):
        sharing = mine([words for _, words in block])
        stored = stage(matches_terms(rows, sharing.terms, kind), "search-terms")
        n, total = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n or not sharing.terms:
            continue
        weight = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.count(F.lit(1)) + 1))).alias("w")
        weights = np.zeros(len(sharing.terms), np.int64)
        for at, w in stored.select(F.explode("ids").alias("id")).groupBy("id").agg(weight).collect():  # one row per term of the lot
            weights[at] = w
        names = spark.createDataFrame([(lot, i, name) for i, (name, _) in enumerate(block)], f"lot int, query int, asked {own}")
        found = found.unionByName(scored(stored, sharing, weights, n, total, best, kind).join(F.broadcast(names), "query"))  # a lot's names
    order = Window.partitionBy("lot", "query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(F.col("asked").alias(fixture), "rank", F.col("key").alias(key), "score")
