"""Exact top-k by inner product: terms accumulated over blocks of rows, the common ones at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.text import key_type
from fairline.session import ship_package, stage

K = 20
#: Rows of a block. A task holds one block of postings and one of queries, and their dense scores.
ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Queries whose dense scores are held at once.
AT_ONCE = 64
#: A term that at least one row in this many has is common.
COMMON = 8


def weights(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, terms): each component as floor(scale * x). Rows with nulls or numbers that aren't finite take no part."""
    value = F.col("vector")
    fine = F.expr("key is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    chosen = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(fine)
    return chosen.select("key", F.transform(value, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("terms"))


def blocks(terms: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows dealt evenly over blocks of about ``size`` rows, (key, terms, block); and how many blocks."""
    n = max(1, -(-terms.count() // size))
    return terms.withColumn("block", F.pmod(F.xxhash64("key", "terms"), F.lit(n)).cast("int")), n


def common_terms(weight: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Which terms are summed at once, as a product of matrices: those that a ``COMMON``-th of the rows have, if no
    sum of theirs can reach 2**53, below which whole numbers are exact in floating point. The others have posting lists."""
    many = np.count_nonzero(terms, axis=1) * COMMON >= terms.shape[1]
    top = np.abs(weight.astype(float)).max(1) * np.abs(terms.astype(float)).max(1)
    return many & (top[many].sum() < 2.0 ** 53)


def best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller key: a partition first, then a sort of what reaches its border."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > border)
        even = np.flatnonzero(scores == border)
        if len(at) + len(even) > k:
            even = even[np.argsort(keys[even], kind="stable")[:k - len(at)]]
        at = np.concatenate([at, even])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((keys[at], -scores[at]))]


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, key: str = "match_id", vector: str = "probs", scale: int = 64,
            row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k matches whose selection weights agree most with each query's: (``query_id``, ``rank`` from 1, key, ``score``).

    ``rows`` and ``queries`` hold a match and its selections' values (say the card's probabilities, in catalogue order);
    each value x counts as the integer floor(scale * x), and the score is the exact integer inner product. A
    query's own row (same key) is no candidate. Ties go to the smaller key; a query with fewer candidates gets all.
    Vectors that are null, or hold a null or a number that isn't finite, take no part; null keys neither. Vectors of
    unlike length meet in their common selections. Repeated rows count as rows, a repeated query once; unlike queries under one key share its ranks. Empty sides give an empty result.

    The work is a grid of row blocks and query blocks of bounded size. In a cell each selection's postings (the rows
    with a weight other than 0) are added, times the query's weight, into dense scores, those of common selections
    together; a partition keeps k per query and block, and a window merges them. Scores need to stay below 2**63.
    """
    ship_package(rows.sparkSession)
    kind = key_type(rows, key)
    left, n_left = blocks(stage(weights(rows, key, vector, scale), "row-terms"), row_block)
    right, n_right = blocks(stage(weights(queries, key, vector, scale), "query-terms"), query_block)
    # every row block meets every query block: the cell's number is the grouping key on both sides
    left = left.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_right - 1)), lambda q: F.col("block").cast("bigint") * n_right + q)))
    right = right.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_left - 1)), lambda r: r.cast("bigint") * n_right + F.col("block"))))

    def matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
        out = np.zeros((width, len(frame)), np.int64)
        for i, x in enumerate(frame["terms"]):
            out[:len(x), i] = x
        return out

    def cell(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "key": [], "score": []})
        if found.empty or asked.empty:
            return empty
        width = max(max(map(len, found["terms"])), max(map(len, asked["terms"])))
        weight, terms = matrix(asked, width), matrix(found, width)
        common = common_terms(weight, terms)
        lists = [(t, at, terms[t, at]) for t in np.flatnonzero(~common) for at in [np.flatnonzero(terms[t])]]
        dense = terms[common].astype(float)
        keys, own = found["key"].to_numpy(), asked["key"].to_numpy()
        out = []
        for start in range(0, len(own), AT_ONCE):
            part = weight[:, start:start + AT_ONCE]
            scores = (part[common].T.astype(float) @ dense).astype(np.int64)
            for t, at, values in lists:
                for q in np.flatnonzero(part[t]):
                    scores[q, at] += part[t, q] * values
            for q in range(part.shape[1]):
                mine = keys == own[start + q]
                other = np.flatnonzero(~mine) if mine.any() else np.arange(len(keys))
                at = other[best(scores[q, other], keys[other], k)]
                out.append((np.repeat(own[start + q:start + q + 1], len(at)), keys[at], scores[q, at]))
        return pd.DataFrame(dict(zip(("query_id", "key", "score"), map(np.concatenate, zip(*out)), strict=True))) if out else empty

    # a repeated query is one query: its rows are scored once
    right = right.dropDuplicates(["cell", "key", "terms"])
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(cell, f"query_id {kind}, key {kind}, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("key").alias(key), "score"))
