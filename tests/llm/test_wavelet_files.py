"""The token files answer like a plain array: ids at positions, counts in ranges, hot keys over several files."""

import numpy as np
import public_tokenizers
import pytest

from fairline.llm import wavelet

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 5_000])
def test_directory_is_stored_and_answers_at_block_edges(n):
    ids = np.random.default_rng(n).integers(0, 40, n)
    built = wavelet.Wavelet.build(ids, 6)
    tree = wavelet.Wavelet.from_bytes(n, built.zeros, built.to_bytes())
    assert (tree.ones == built.ones).all() and len(built.to_bytes()) == 6 * (n // 512 + 1) * (64 + 4)
    assert (tree.decode() == ids).all() and (tree.access(np.arange(n)) == ids).all()
    for token in (0, 7, 39, 63, 64):
        assert (tree.find(token) == np.flatnonzero(ids == token)).all()
        for start, stop in ((0, n), (n // 3, n), (0, n // 2), (n, n)):
            assert tree.count(token, start, stop) == (ids[start:stop] == token).sum()


def test_files_are_asked_for_positions_and_counts(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(i % 7 if i % 3 else None, f"line {i} of a text, " * (i % 5)) for i in range(200)]
    wavelet.write_tokens(spark.createDataFrame(rows, "match_id int, text string"), path, BYTE, shard_tokens=300)
    every = [i for r in wavelet.read_tokens(spark, path).orderBy("start").collect() for i in r["ids"]]
    asked = [0, 1, 299, 300, 301, len(every) - 1, len(every), -1, None, 5, 5]
    got = wavelet.read_at(spark, path, spark.createDataFrame([(a, "x") for a in asked], "position long, id string")).collect()
    want = [(a, every[a] if a is not None and 0 <= a < len(every) else None) for a in asked]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for token in (0, every[3], 49_999):
        for start, stop in ((0, None), (100, 700), (299, 301), (len(every), None), (5, 5)):
            assert wavelet.count_token(spark, path, token, start, stop).first()["n"] == every[start:stop].count(token)


def test_a_hot_key_is_parted_and_stays_in_order(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(None if i % 2 else 3, f"{i:05d} text") for i in range(2_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put back into one file
    try:
        wavelet.write_tokens(spark.createDataFrame(rows, "match_id int, text string"), path, BYTE)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(path).select("part").distinct().count() > 2
    got = [r["match_id"] for r in wavelet.read_tokens(spark, path).orderBy("start").collect()]
    assert got == [None] * 1_000 + [3] * 1_000


def test_empty_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    wavelet.write_tokens(spark.createDataFrame([], "match_id int, text string"), path, BYTE)
    asked = spark.createDataFrame([(0,)], "position long")
    assert wavelet.count_token(spark, path, 0).first()["n"] == 0 and wavelet.read_at(spark, path, asked).collect() == [(0, None)]
