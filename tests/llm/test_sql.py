import duckdb

from fairline.llm import queries

SF = "/root/testdata/sf0.001"


def test_topk_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    found = queries.op3_exact_topk(spark, SF)
    relation = con.sql(queries.oracle_sql()["op3_exact_topk"])
    assert relation.columns == found.columns and [str(t) for t in relation.types] == ["BIGINT", "INTEGER", "BIGINT", "BIGINT"]
    assert sorted(relation.fetchall()) == sorted(tuple(r) for r in found.collect())
