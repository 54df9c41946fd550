"""Pipeline stages on columns of any name, on empty tables, and the classifier's sample."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairline.llm import cleaning, pii, quality

GOOD = ("The match at the old ground went on until dusk and ended level, said a man from the local paper.\n"
        "Both sides had chances before the break, but neither keeper was beaten from open play that evening.\n"
        "After it the visitors pressed harder, won three corners in a row, and then lost the ball in midfield.\n"
        "Supporters who had come by train left early, since rain was forecast and the last one home was at nine.\n")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, GOOD + "Write to a.b@example.com now.", "x", (1, "y"), "k"), (2, None, None, None, None), (2, "", "x", (2, None), "k"), (None, GOOD, "x", (3, "z"), None)]
    return spark.createDataFrame(rows, "`match id` int, body string, `a.b` string, `rest` struct<`in side`:int,`c.d`:string>, `text` string")


def test_stages_take_columns_of_any_name(odd):
    kept, masked = cleaning.keep(odd, "body"), pii.redact(odd, "body")
    assert kept.columns == masked.columns == odd.columns and masked.schema["rest"].dataType == odd.schema["rest"].dataType
    assert sorted((r[0] is None, r["a.b"], r["rest"][0]) for r in kept.collect()) == [(False, "x", 1), (True, "x", 3)]
    rows = {(r[0], r["a.b"]): r for r in masked.collect()}
    assert len(rows) == 4 and "<EMAIL>" in rows[1, "x"]["body"] and rows[2, None]["body"] == "" and rows[1, "x"]["rest"]["c.d"] == "y"
    assert cleaning.keep(odd.limit(0), "body").count() == 0 and pii.redact(odd.limit(0), "body").count() == 0


def test_empty_tables_pass_through_the_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES[1:-1]:
        found = step(spark, docs, "/root/testdata/sf0.001")
        assert found.columns == docs.columns and found.count() == 0, name


def test_the_fit_takes_rows_whole_within_its_bytes(spark):
    words = " ".join(f"w{i}" for i in range(9_000))
    rows = spark.createDataFrame([(i, words + (" good" if i % 2 else " bad") * 40) for i in range(8)], "match_id int, text string")
    labels = rows.select("match_id", (F.col("match_id") % 2).alias("label"))
    whole = quality.fit(rows, labels)
    few = quality.fit(rows, labels, sample_bytes=200_000)  # two or three rows of some 72,000 bytes
    used = lambda m: int((m.weight != 0).sum())
    assert used(whole) > 4_000 and used(few) > 4_000 and not (whole.weight == few.weight).all()
    assert 0 <= quality.score(rows, few).agg(F.min("score")).first()[0] <= 1
