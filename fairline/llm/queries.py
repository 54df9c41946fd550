"""One query per operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm import bpe, cleaning, ctw, leakage, near_dup, packing, pii, quality, search, spelling, token_counts, topk, wavelet

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
KEEP_SCORE = 0.7
LONG_TOKENS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of ``docs``; labels of held-out rows are never seen."""
    seen = labels.where(~F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    machine = quality.fit(docs, seen, "doc_id", "text", "quality", ("n_chars",))
    scored = quality.score(docs, machine, "doc_id", "text", ("n_chars",))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(read(spark, sf_dir, "documents"), "doc_id").drop("clean_text")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    found = topk.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, "vec_id", "embedding", 64)
    return found.select("query_id", "rank", "vec_id", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.written("base"), 256).alias("base_sha256"),
                        pii.written("spans").alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), "doc_id")
    return found.withColumn("over_limit", F.col("n_tokens") > LONG_TOKENS)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("train", F.coalesce(remainder("doc_id", 7) != 2, F.lit(True)))
    found = ctw.score(docs, "train", "doc_id")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2048, "doc_id")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "class_id")


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.store(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), "doc_id")


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), "doc_id", digests=True)


def misprinted(docs: DataFrame) -> DataFrame:
    """The runs of letters of all texts, one in 97 without one of its letters."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", leakage.UPPER, leakage.LOWER), F.lit("[a-z\u00C0-\u00FF]+"), F.lit(0)))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("word"))
    named = words.select("word", F.crc32(F.concat("doc", F.lit(":"), "word")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return named.select(F.when(F.col("h") % 97 == 0, short).otherwise(F.col("word")).alias("home_team"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spelling.spellings(misprinted(read(spark, sf_dir, "documents")), ("home_team",))
    return spelling.variants(names).withColumnRenamed("team", "word")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return search.rank_matches(docs, items, "doc_id", "text", "item_id", "text")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = leakage.held_out_leaks(docs, items, "doc_id", "text", "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", F.size("held_out").cast("long").alias("n_items"),
                        F.sha2(F.array_join("held_out", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_exact_topk, op4_pii, op5_token_counts, op6_lm_scoring,
                                    op7_best_fit_packing, op8_near_dedup, op9_wavelet_tokens, op10_trie_bpe, op11_spelling_variants,
                                    op12_ranked_search, op13_decontamination)}


LOWERED = f"translate(text, '{leakage.UPPER}', '{leakage.LOWER}')"
TERMS_SQL = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
WORDS_SQL = f"regexp_extract_all({LOWERED}, '{leakage.WORD}')"

RANKED_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, len(t) AS n, t FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0),
    g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
    q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g
          WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
    s AS (SELECT item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL),
    o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""

LEAKS_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w, least(10, len(w)) AS span FROM benchmark WHERE text IS NOT NULL),
    i AS (SELECT DISTINCT item, span, unnest(list_transform(generate_series(1, len(w) - span + 1), lambda x: array_to_string(w[x:x + span - 1], ' '))) AS win
          FROM b WHERE span > 0),
    u AS (SELECT r, n, place, [w, {', '.join(f'lead(w, {x}) OVER o' for x in range(1, leakage.SPAN))}] AS ws
          FROM (SELECT r, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM d) WINDOW o AS (PARTITION BY r ORDER BY place)),
    v AS (SELECT r, span, place, array_to_string(ws[1:span], ' ') AS win FROM u, (SELECT DISTINCT span FROM i) WHERE place + span - 1 <= n),
    m AS (SELECT DISTINCT r, place, span, item FROM v JOIN i USING (span, win)),
    h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(place, place + span - 1)) AS pos FROM m) GROUP BY r),
    l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": RANKED_SQL, "op13_decontamination": LEAKS_SQL, "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS t FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""}
