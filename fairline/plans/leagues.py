"""Competition catalogue work: feed coverage, labels, feed plans, artifact freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The stored artifacts, the job that rebuilds each, what it is built from.
ARTIFACTS = (
    ("history", "fetch-results", ()),
    ("odds", "fetch-odds", ()),
    ("predictions", "rebuild-model", ("history",)),
    ("calibration", "recalibrate", ("predictions",)),
    ("reliability", "recalibrate", ("predictions",)),
    ("picks", "refresh-picks", ("history", "odds", "calibration")),
    ("evidence", "rebuild-evidence", ("history",)),
    ("ledger", "refresh-picks", ()),
    ("accas", "refresh-picks", ()),
)
CREDITS_PER_LEAGUE = 4


def feed_coverage(catalogue: DataFrame, history: DataFrame, live: DataFrame,
                  tracked: DataFrame) -> DataFrame:
    """Which feeds can be priced. ``catalogue(code, sport)``, ``live(sport)``, ``tracked(sport)``.

    plan: in history and live; missing: in history, mapped, not live; unknown: live, unmapped.
    """
    have = catalogue.join(history.select(F.col("competition").alias("code")).distinct(),
                          "code", "left_semi")
    live = live.select("sport").distinct()
    marks = tracked.select("sport", F.lit(True).alias("tracked")).distinct()
    plan = (have.join(live, "sport", "left_semi").join(marks, "sport", "left")
            .select("code", "sport", F.lit("plan").alias("status"),
                    F.coalesce("tracked", F.lit(False)).alias("tracked")))
    missing = have.join(live, "sport", "left_anti").select(
        "code", "sport", F.lit("missing").alias("status"), F.lit(False).alias("tracked"))
    unknown = live.join(catalogue, "sport", "left_anti").select(
        F.lit(None).cast("string").alias("code"), "sport", F.lit("unknown").alias("status"),
        F.lit(False).alias("tracked"))
    return plan.unionByName(missing).unionByName(unknown)


def coverage_cost(coverage: DataFrame) -> DataFrame:
    plan = F.col("status") == "plan"
    return coverage.agg(
        F.count_if(plan).alias("available"),
        F.count_if(plan & ~F.col("tracked")).alias("new"),
        (F.count_if(plan) * CREDITS_PER_LEAGUE).alias("estimated_credits"))


def feed_plan(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Feeds to fetch: the plan where it has rows, else the feeds already stored."""
    planned = plan.select("sport").distinct()
    some = planned.agg((F.count(F.lit(1)) > 0).alias("_planned"))
    fallback = stored.select("sport").distinct().crossJoin(F.broadcast(some)).filter(
        ~F.col("_planned")).select("sport")
    return planned.unionByName(fallback)


def labels_for(codes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Names of this set of codes; the country is added only where a name repeats in the set."""
    named = codes.select("code").distinct().join(catalogue, "code", "left")
    same = Window.partitionBy(F.coalesce("name", "code"))
    label = F.when(F.col("name").isNull(), F.col("code")).when(
        F.count(F.lit(1)).over(same) > 1,
        F.concat("name", F.lit(" ("), F.col("country"), F.lit(")"))).otherwise(F.col("name"))
    return named.select("code", label.alias("label"))


def artifact_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, j, list(d)) for k, j, d in ARTIFACTS],
                                 "artifact string, job string, depends_on array<string>")


def staleness(artifacts: DataFrame, built: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Artifacts older than something they are built from.

    ``built(artifact, built_at)``, optionally per ``by`` columns; output adds ``exists`` and
    the sorted list ``stale_after`` as text.
    """
    by = list(by)
    scopes = built.select(*by).distinct() if by else None
    rows = artifacts if scopes is None else artifacts.crossJoin(scopes)
    own = rows.join(built, [*by, "artifact"], "left")
    needs = own.select(*by, "artifact", "built_at", F.explode("depends_on").alias("dep"))
    dep = built.select(*by, F.col("artifact").alias("dep"), F.col("built_at").alias("dep_at"))
    behind = needs.join(dep, [*by, "dep"]).filter(F.col("dep_at") > F.col("built_at")).groupBy(
        *by, "artifact").agg(F.array_join(F.array_sort(F.collect_set("dep")), ",")
                             .alias("stale_after"))
    return own.join(behind, [*by, "artifact"], "left").select(
        *by, "artifact", "job", F.col("built_at").isNotNull().alias("exists"),
        F.coalesce("stale_after", F.lit("")).alias("stale_after"))
