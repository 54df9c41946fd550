"""Queries: the record of picks and slips, settlement, and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairline.functions import markets, prices
from fairline.operators import matching
from fairline.operators.ordering import best_per_key
from fairline.plans import ledger as book, queries_card as qc, sql_tables as t
from fairline.plans.registry import cte, query
from fairline.session import shared_folder, stage
from fairline.sources import readers, sinks, textfiles, warehouse as w
from fairline.sources.sinks import rounded
from fairline.streaming import books

TODAY = "DATE '2001-11-10'"
_BANDS = "(VALUES ('safe', 1.3, 1.6), ('main', 1.6, 2.2), ('value', 2.2, 3.0)) b(band, lo, hi)"


def hex_digit(salt, of="match_id"):
    return F.conv(F.substring(F.md5(F.concat(F.col(of), F.lit(f"|{salt}"))), 1, 1), 16, 10
                  ).cast("int")


def sql_digit(salt, of="match_id"):
    return f"CAST(('0x' || substr(md5({of} || '|{salt}'), 1, 1)) AS INTEGER)"


def ledger_rows(spark, sf):
    """The recorded picks, stored: at most one per competition, day and band, and read several times by all that settles them."""
    return w._stored(spark, sf, "ledger", derive_ledger)


def derive_ledger(spark, sf):
    """Best pick per competition, day and band, as recorded: feed-side team spellings."""
    p = qc.picks(spark, sf).select("match_id", "date", "competition", "home", "away", "match",
                                   "key", "group", "selection", "prob", "fair_odds", "odds",
                                   "hit_rate_n")
    band = F.when(F.col("fair_odds").between(1.3, 1.6), "safe").when(
        F.col("fair_odds").between(1.6, 2.2), "main").when(
        F.col("fair_odds").between(2.2, 3.0), "value")
    banded = p.withColumn("band", band).filter("band IS NOT NULL")
    best = best_per_key(banded, ["competition", "date", "band"],
                        [F.desc("prob"), F.asc("match_id"), F.asc("key")])
    return best.select(
        F.concat_ws("/", "competition", F.col("date").cast("string"), "band").alias("pick_id"),
        F.col("date").alias("day"), "band", "competition",
        F.when(hex_digit("l") < 4, F.concat("home", F.lit(" town"))).otherwise(F.col("home"))
        .alias("home"), "away", "match", "key", "group", "selection", "prob", "fair_odds",
        "odds", F.lit("pending").alias("outcome"))


def results(spark, sf):
    """Results as they arrive, up to fifteen days after the planned day; stored, as names and grades both need them."""
    return w._stored(spark, sf, "results", derive_results)


def derive_results(spark, sf):
    m = w.matches(spark, sf).filter(F.col("date") >= F.lit(w.CARD_DAY).cast("date"))
    return m.filter(hex_digit("z") < 14).select(
        F.col("match_id").alias("result_id"), "competition", "home", "away",
        F.date_add("date", hex_digit("s")).alias("date"), "home_goals", "away_goals",
        "total_corners")


cte("x_ledger", f"""--m
SELECT competition || '/' || CAST(date AS VARCHAR) || '/' || band AS pick_id, date AS day, band, competition,
  CASE WHEN {sql_digit('l')} < 4 THEN home || ' town' ELSE home END AS home, home AS known_home, away, match, key, "group", selection, prob, fair_odds, odds
FROM (SELECT *, CASE WHEN fair_odds BETWEEN 1.3 AND 1.6 THEN 'safe' WHEN fair_odds BETWEEN 1.6 AND 2.2 THEN 'main' WHEN fair_odds BETWEEN 2.2 AND 3.0 THEN 'value' END AS band FROM x_picks)
WHERE band IS NOT NULL QUALIFY row_number() OVER (PARTITION BY competition, date, band ORDER BY prob DESC, match_id, key) = 1
""")
cte("x_results", f"""--m
SELECT match_id AS result_id, competition, home, away, date + {sql_digit('s')} AS date, home_goals, away_goals, total_corners FROM x_matches
WHERE date >= {qc.DAY} AND {sql_digit('z')} < 14
""")
_GRADE = "CASE key " + " ".join(
    f"WHEN '{s.key}' THEN " + (
        f"CASE WHEN total_corners IS NULL THEN NULL WHEN {t.settled_sql(s.key)} THEN 'won' ELSE 'lost' END"
        if s.group == "corners" else
        f"CASE WHEN ({t.settled_sql(s.key)}) IS NULL THEN 'void' WHEN {t.settled_sql(s.key)} THEN 'won' ELSE 'lost' END")
    for s in t.CATALOGUE) + " END"
# The resolver knows 'team 3 town' only if one team of the competition's results is inside it.
cte("x_settled", f"""--m
WITH r AS (SELECT l.*, r.date, r.home_goals, r.away_goals, r.total_corners FROM x_ledger l JOIN x_results r ON l.competition = r.competition AND l.known_home = r.home AND l.away = r.away AND abs(r.date - l.day) <= 7
  QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY abs(r.date - l.day), r.date, r.result_id) = 1),
g AS (SELECT pick_id, date, home_goals, away_goals, {_GRADE} AS out FROM r)
SELECT l.*, coalesce(g.out, 'pending') AS outcome, CASE WHEN g.out IS NOT NULL THEN g.date END AS played_on, CASE WHEN g.out IS NOT NULL THEN g.home_goals END AS home_goals,
  CASE WHEN odds IS NOT NULL THEN CASE g.out WHEN 'won' THEN odds - 1 WHEN 'lost' THEN -1 WHEN 'void' THEN 0 END END AS pnl FROM x_ledger l LEFT JOIN g USING (pick_id)
""")


def settled(spark, sf):
    return w._stored(spark, sf, "settled",
                     lambda s, d: book.settle(ledger_rows(s, d), results(s, d)))


@query("settle_picks", "J7 J8 J4 F16", """
SELECT pick_id, day, band, home, away, key, outcome, played_on, home_goals, round(pnl, 6) AS pnl FROM x_settled
""")
def settle_picks(spark, sf):
    return settled(spark, sf).select("pick_id", "day", "band", "home", "away", "key", "outcome",
                                     "played_on", "home_goals", F.round("pnl", 6).alias("pnl"))


def summary_sql(by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    done = "outcome IN ('won', 'lost', 'void')"
    pr = f"{done} AND pnl IS NOT NULL"
    return f"""
SELECT {head}count(*) AS recorded, count(*) FILTER (WHERE outcome = 'pending' AND day < {TODAY} - 14) AS overdue, count(*) FILTER (WHERE outcome = 'pending') AS pending,
  count(*) FILTER (WHERE {done}) AS settled, count(*) FILTER (WHERE outcome = 'void') AS void, count(*) FILTER (WHERE outcome = 'won') AS wins, count(*) FILTER (WHERE outcome = 'lost') AS losses,
  round(count(*) FILTER (WHERE outcome = 'won') / count(*) FILTER (WHERE outcome IN ('won', 'lost')), 6) AS hit_rate, round(avg(prob) FILTER (WHERE outcome IN ('won', 'lost')), 6) AS expected,
  count(*) FILTER (WHERE {pr}) AS priced, count(*) FILTER (WHERE {done} AND pnl IS NULL) AS unpriced, round(coalesce(sum(pnl) FILTER (WHERE {pr}), 0), 6) AS pnl,
  CAST(count(*) FILTER (WHERE {pr}) AS DOUBLE) AS staked, round(100 * sum(pnl) FILTER (WHERE {pr}) / count(*) FILTER (WHERE {pr}), 6) AS roi, round(avg(odds) FILTER (WHERE {pr}), 6) AS average_odds
FROM x_settled{tail}
"""


@query("ledger_summary", "A27 T8", summary_sql())
def ledger_summary(spark, sf):
    return rounded(book.summary(settled(spark, sf), F.expr(TODAY)), 6)


@query("ledger_summary_by_band", "A27", summary_sql("band"))
def ledger_summary_by_band(spark, sf):
    return rounded(book.summary(settled(spark, sf), F.expr(TODAY), ["band"]), 6)


@query("ledger_equity", "W2", """
SELECT pick_id, played_on, round(pnl, 6) AS pnl, round(sum(pnl) OVER o, 6) AS cum, row_number() OVER o AS position FROM x_settled WHERE pnl IS NOT NULL
WINDOW o AS (ORDER BY played_on, day, substr(md5(pick_id), 1, 2), pick_id ROWS UNBOUNDED PRECEDING)
""")
def ledger_equity(spark, sf):
    return book.equity(settled(spark, sf)).select(
        "pick_id", "played_on", F.round("pnl", 6).alias("pnl"), F.round("cum", 6).alias("cum"),
        "position")


@query("results_behind", "J14", f"""
WITH last AS (SELECT competition, max(date) AS league_last FROM x_results WHERE date < DATE '2001-10-20' - CAST(substr(competition, 2) AS INTEGER) GROUP BY competition)
SELECT s.competition, coalesce(league_last, (SELECT max(league_last) FROM last)) AS league_last, count(*) AS waiting FROM x_settled s LEFT JOIN last USING (competition)
WHERE outcome = 'pending' AND day < {TODAY} AND day > coalesce(league_last, (SELECT max(league_last) FROM last)) GROUP BY ALL
""")
def results_behind(spark, sf):
    lag = F.date_sub(F.lit("2001-10-20").cast("date"),
                     F.substring("competition", 2, 2).cast("int"))
    known = results(spark, sf).filter(F.col("date") < lag)
    return book.behind_results(settled(spark, sf), known, F.expr(TODAY))


def slip_rows(spark, sf):
    """The slips, stored: at most one per competition and day."""
    return w._stored(spark, sf, "slip_rows", derive_slips)


def derive_slips(spark, sf):
    """A slip per competition and day: its four strongest fixtures, legs stored as JSON."""
    p = qc.picks(spark, sf).filter(F.col("fair_odds") >= 1.2)
    one = best_per_key(p, ["competition", "date", "match_id"], [F.desc("prob"), F.asc("key")])
    legs = best_per_key(one, ["competition", "date"], [F.desc("prob"), F.asc("match_id")], 4)
    leg = F.struct(
        F.col("date").cast("string").alias("date"), "competition",
        F.col("competition").alias("competition_name"), "home", "away", "match", "key",
        "selection", "prob", "fair_odds", "odds", "hit_rate", "hit_rate_n")
    slips = legs.groupBy("competition", "date").agg(
        F.count(F.lit(1)).cast("int").alias("legs"), F.product("prob").alias("probability"),
        F.array_sort(F.collect_list(leg)).alias("leg_rows")).filter("legs >= 2")
    return slips.select(
        F.concat_ws("/", "competition", F.col("date").cast("string")).alias("issued"), "legs",
        F.round("probability", 6).alias("probability"),
        book.legs_to_json(F.col("leg_rows")).alias("selections"), F.lit("pending").alias("outcome"))


def settled_slips(spark, sf):
    def build(spark, sf):
        slips = slip_rows(spark, sf).withColumn(
            "leg_list", readers.legs_from_json(F.col("selections")))
        return book.settle_slips(slips, results(spark, sf)).drop("leg_list")
    return w._stored(spark, sf, "settled_slips", build)


cte("x_slip_legs", """--m
SELECT competition || '/' || CAST(date AS VARCHAR) AS issued, competition, date AS day, match_id, home, away, key, prob, odds FROM (
 SELECT * FROM x_picks WHERE fair_odds >= 1.2 QUALIFY row_number() OVER (PARTITION BY competition, date, match_id ORDER BY prob DESC, key) = 1)
QUALIFY row_number() OVER (PARTITION BY competition, date ORDER BY prob DESC, match_id) <= 4 AND count(*) OVER (PARTITION BY competition, date) >= 2
""")
cte("x_slips", f"""--m
WITH f AS (SELECT l.issued, l.match_id, l.key, r.home_goals, r.away_goals, r.total_corners FROM x_slip_legs l JOIN x_results r ON l.competition = r.competition AND l.home = r.home AND l.away = r.away AND abs(r.date - l.day) <= 7
  QUALIFY row_number() OVER (PARTITION BY l.issued, l.match_id ORDER BY abs(r.date - l.day), r.date, r.result_id) = 1),
g AS (SELECT issued, match_id, {_GRADE} AS out FROM f),
s AS (SELECT issued, count(*) AS legs, product(prob) AS probability, bool_and(out IS NOT NULL) AS done, count(*) FILTER (WHERE out = 'won') AS wins, count(*) FILTER (WHERE out IN ('won', 'lost')) AS alive,
  count(*) FILTER (WHERE out = 'void') AS voids, coalesce(bool_and(coalesce(odds, 0) <> 0) FILTER (WHERE out IN ('won', 'lost')), TRUE) AS priced, product(odds) FILTER (WHERE out IN ('won', 'lost')) AS price
 FROM x_slip_legs LEFT JOIN g USING (issued, match_id) GROUP BY issued)
SELECT issued, legs, round(probability, 6) AS probability, CASE WHEN NOT done THEN 'pending' WHEN alive = 0 THEN 'void' WHEN wins = alive THEN 'won' ELSE 'lost' END AS outcome,
  CASE WHEN done THEN wins END AS legs_won, CASE WHEN done THEN voids END AS legs_void, CASE WHEN NOT done THEN NULL WHEN alive = 0 THEN 0 WHEN NOT priced THEN NULL WHEN wins = alive THEN price - 1 ELSE -1 END AS pnl FROM s
""")


@query("settle_slips", "T6 F19 J7 J8 A29", """
SELECT issued, CAST(legs AS INTEGER) AS legs, probability, outcome, CAST(legs_won AS INTEGER) AS legs_won, CAST(legs_void AS INTEGER) AS legs_void, round(pnl, 6) AS pnl FROM x_slips
""")
def settle_slips(spark, sf):
    return rounded(settled_slips(spark, sf).drop("selections"), 6)


@query("slip_summary", "A28", """
SELECT count(*) AS recorded, count(*) FILTER (WHERE outcome = 'pending') AS pending, count(*) FILTER (WHERE outcome <> 'pending') AS settled, count(*) FILTER (WHERE outcome = 'won') AS wins, count(*) FILTER (WHERE outcome = 'lost') AS losses,
  round(count(*) FILTER (WHERE outcome = 'won') / count(*) FILTER (WHERE outcome IN ('won', 'lost')), 6) AS hit_rate, round(avg(probability) FILTER (WHERE outcome IN ('won', 'lost')), 6) AS expected,
  count(pnl) AS priced, count(*) FILTER (WHERE outcome <> 'pending' AND pnl IS NULL) AS unpriced, round(coalesce(sum(pnl), 0), 6) AS pnl, round(100 * sum(pnl) / count(pnl), 6) AS roi,
  round(avg(legs_won) FILTER (WHERE outcome IN ('won', 'lost')), 6) AS average_legs_won, round(avg(legs) FILTER (WHERE outcome IN ('won', 'lost')), 6) AS average_legs FROM x_slips
""")
def slip_summary(spark, sf):
    return rounded(book.slip_summary(settled_slips(spark, sf)), 6)


@query("slip_legs", "F19", """
SELECT issued, key, home, away, prob, odds FROM x_slip_legs
""")
def slip_legs(spark, sf):
    """Legs back out of their JSON text; a truncated text gives an empty list, not an error."""
    s = slip_rows(spark, sf).select("issued", "selections").unionByName(
        slip_rows(spark, sf).select("issued", F.substring("selections", 1, 0).alias("selections")))
    legs = s.select("issued", F.explode(readers.legs_from_json(F.col("selections"))).alias("l"))
    return legs.select("issued", "l.key", "l.home", "l.away", "l.prob",
                       "l.odds")


# -- books kept as text files -----------------------------------------------------------

def folder(spark, name):
    return f"{shared_folder(spark)}/fairline/{name}-{uuid.uuid4().hex}"


@query("ledger_files", "S19 S14", f"""
SELECT competition, CAST(day AS VARCHAR) AS day, band, key, CASE WHEN d <> 0 THEN round(prob, 5) END AS prob, CASE WHEN d = 1 THEN 'pending' ELSE outcome END AS outcome,
  CAST(home_goals AS INTEGER) AS home_goals, round(pnl, 5) AS pnl, CASE WHEN d = 0 THEN 'prob' END AS problem
FROM (SELECT *, {sql_digit('cell', 'pick_id')} AS d FROM x_settled)
""")
def ledger_files(spark, sf):
    """The ledger written as CSV in two layouts and read back. Some probabilities are no numbers, the flagship band and
    some outcomes are empty, goals carry a fraction; sound rows get their defaults, broken rows are shown with what is wrong."""
    rows = sinks.rounded(settled(spark, sf).withColumn("d", hex_digit("cell", "pick_id")), 5)
    rows = stage(rows.withColumns({
        "band": F.nullif("band", F.lit("main")), "prob": F.when(F.col("d") == 0, "n/a").otherwise(F.col("prob").cast("string")),
        "outcome": F.when(F.col("d") != 1, F.col("outcome")), "home_goals": F.col("home_goals").cast("double")}), "ledger")
    path, columns = folder(spark, "ledger-csv"), ["competition", "day", "band", "key", "prob", "outcome", "home_goals", "pnl"]
    textfiles.write_csv(rows.filter("d < 8").select(*columns), path)
    textfiles.write_csv(rows.filter("d >= 8").select(*reversed(columns), "match"), path, mode="append")
    book_rows = textfiles.read_book(spark, path, readers.LEDGER_SCHEMA)
    whole = readers.ledger(textfiles.sound(book_rows)).withColumn("problem", F.lit(None).cast("string"))
    bad = textfiles.broken(book_rows).withColumns({
        "band": F.coalesce("band", F.lit("main")), "outcome": F.coalesce("outcome", F.lit("pending"))}).withColumnRenamed("_problem", "problem").drop("_line")
    return whole.unionByName(bad).select("competition", "day", "band", "key", "prob", "outcome", "home_goals", "pnl", "problem")


@query("slip_files", "S19 F19", f"""
SELECT issued, key, home, away, prob, odds FROM x_slip_legs WHERE {sql_digit('cut', 'issued')} >= 4
""")
def slip_files(spark, sf):
    """The accumulator book as JSON lines and back; some slips' legs were cut off in mid-text and count as none."""
    rows = slip_rows(spark, sf).withColumn("selections", F.when(hex_digit("cut", "issued") < 4, F.left("selections", F.lit(40)))
                                           .otherwise(F.col("selections")))
    path = folder(spark, "slips-json")
    sinks.write_json_rows(rows, path, 6)
    legs = readers.slips(textfiles.sound(textfiles.read_book(spark, path, readers.SLIP_SCHEMA, "json"))).select("issued", F.explode("leg_list").alias("l"))
    return legs.select("issued", "l.key", "l.home", "l.away", "l.prob", "l.odds")


# -- streams: run to the end of what is there, then read what they wrote ----------------

def as_stream(df, name, batch):
    """The frame as a stream of micro-batches: one file for each value of the column ``batch``, written one after the
    other, as the file source takes files in the order in which they were written."""
    path = folder(df.sparkSession, name)
    stored = stage(df.withColumn("_batch", batch), name)
    for (value,) in sorted(stored.select("_batch").distinct().collect()):
        stored.filter(F.col("_batch") == value).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def weeks(day, n=3):
    """Blocks of n weeks since the first recorded day."""
    return F.floor(F.datediff(day, F.lit(w.CARD_DAY).cast("date")) / (7 * n)).cast("int")


@query("stream_ingest_quotes", "T1 U3", """
SELECT fetched_at, competition, home, away, count(*) AS n FROM (SELECT DISTINCT fetched_at, competition, home, away FROM x_quotes) GROUP BY ALL
""")
def stream_ingest_quotes(spark, sf):
    """A micro-batch a year, each with the year before sent once more; state is kept for 800 days."""
    q = w.quotes(spark, sf).select("fetched_at", "competition", "home", "away", "home_odds")
    twice = q.withColumn("_year", F.coalesce(F.year("fetched_at"), F.lit(0)))
    twice = stage(twice.unionByName(twice.withColumn("_year", F.col("_year") + 1)), "quotes")
    stream = as_stream(twice, "quotes-in", F.col("_year")).drop("_year")
    out = folder(spark, "quotes-out")
    books.ingest_quotes(stream, out, folder(spark, "ck"), "800 days").awaitTermination()
    return spark.read.schema(q.schema).parquet(out).groupBy(
        "fetched_at", "competition", "home", "away").agg(F.count(F.lit(1)).alias("n"))


@query("stream_current_quotes", "T2 T3", f"""
SELECT competition, home, away, fetched_at, match_id, home_odds FROM x_quotes WHERE coalesce(commence_time, CAST(date + 1 AS TIMESTAMP)) > TIMESTAMP '{w.CARD_NOW}'
QUALIFY row_number() OVER (PARTITION BY competition, home, away ORDER BY fetched_at DESC, match_id) = 1
""")
def stream_current_quotes(spark, sf):
    q = w.quotes(spark, sf).select("match_id", "fetched_at", "competition", "home", "away",
                                   "home_odds", "draw_odds", "away_odds", "date",
                                   "commence_time")
    out = folder(spark, "current-out")
    books.current_quotes(as_stream(q, "current-in", F.pmod(F.xxhash64("match_id"), F.lit(3))), out, folder(spark, "ck")).awaitTermination()
    return books.read_current(spark, out, F.expr(f"TIMESTAMP '{w.CARD_NOW}'")).select(
        "competition", "home", "away", "fetched_at", "match_id", "home_odds")


@query("stream_record_picks", "T4", f"""
SELECT pick_id, day, band, key FROM x_ledger WHERE day >= DATE '2001-09-01'
""")
def stream_record_picks(spark, sf):
    """Every pick arrives twice, the second time changed and in a later batch; the first answer stays."""
    rows = ledger_rows(spark, sf).drop("outcome")
    twice = rows.withColumn("arrival", F.lit(1)).unionByName(
        rows.withColumn("arrival", F.lit(2)).withColumn("key", F.lit("1x2_draw")))
    stream = as_stream(twice, "picks-in", F.col("arrival"))
    out = folder(spark, "picks-out")
    books.record_picks(stream, out, folder(spark, "ck"), ["pick_id"], ["arrival"],
                       F.lit("2001-09-01").cast("date")).awaitTermination()
    return spark.read.parquet(out).select("pick_id", "day", "band", "key")


def late_results(spark, sf):
    """Results in blocks of three weeks, one in four of them a block late."""
    rows = results(spark, sf)
    return as_stream(rows, "results-in", weeks(F.col("date")) + F.when(hex_digit("late", "result_id") < 4, 1).otherwise(0))


def feed_names(spark, sf, rows):
    """What the spellings in ``rows`` mean: resolved against the teams of the results."""
    known = results(spark, sf)
    both = lambda df, name: df.select("competition", F.col("home").alias(name)).unionByName(
        df.select("competition", F.col("away").alias(name))).distinct()
    return stage(matching.resolve_names(both(rows, "key"), both(known, "candidate")).filter("rule <> 'none'").select("competition", "key", "resolved"), "names")


#: Overdue in the stream: no result within a week, and the watermark (30 days behind the slower side) has passed that week.
_GIVEN_UP = "least((SELECT max(day) FROM x_ledger), (SELECT max(date) FROM x_results)) - 30 - 7"


@query("stream_settle_picks", "T6 T8", f"""
SELECT pick_id, outcome, round(pnl, 6) AS pnl FROM x_settled WHERE outcome <> 'pending'
UNION ALL SELECT pick_id, 'overdue', NULL FROM x_ledger l WHERE day < {_GIVEN_UP}
  AND NOT EXISTS (SELECT 1 FROM x_results r WHERE r.competition = l.competition AND r.home = l.known_home AND r.away = l.away AND abs(r.date - l.day) <= 7)
""")
def stream_settle_picks(spark, sf):
    """The whole ledger and all results as two streams, some results late: every grading of the batch job, and what is overdue."""
    rows = ledger_rows(spark, sf).drop("outcome")
    out = folder(spark, "met-out")
    books.meet_results(as_stream(rows, "recorded-in", weeks(F.col("day"))), late_results(spark, sf), feed_names(spark, sf, rows), out,
                       folder(spark, "ck")).awaitTermination()
    return books.read_settled(spark.read.parquet(out)).select("pick_id", "outcome", F.round("pnl", 6).alias("pnl"))


@query("stream_settle_slips", "T5 T6", """
SELECT issued, outcome, CAST(legs_won AS INTEGER) AS legs_won, CAST(legs_void AS INTEGER) AS legs_void, round(pnl, 6) AS pnl FROM x_slips WHERE outcome <> 'pending'
""")
def stream_settle_slips(spark, sf):
    """Slips recorded as they are issued, each sent twice, and graded when the last leg's result has come."""
    slips = slip_rows(spark, sf).drop("outcome").withColumn("day", F.to_date(F.element_at(F.split("issued", "/"), 2)))
    twice = slips.withColumn("sent", F.lit(1)).unionByName(slips.withColumn("sent", F.lit(2)).withColumn("selections", F.lit("[]")))
    recorded, met, graded = (folder(spark, n) for n in ("slips-out", "legs-out", "slips-graded"))
    books.record_picks(as_stream(twice, "slips-in", weeks(F.col("day")) + F.col("sent")), recorded, folder(spark, "ck"), ["issued"], ["sent"],
                       F.lit(w.CARD_DAY).cast("date")).awaitTermination()
    leg = F.posexplode(readers.legs_from_json(F.col("selections"))).alias("leg_no", "leg")
    legs = stage(spark.read.parquet(recorded).select("issued", "legs", leg).select(
        "issued", "legs", "leg_no", F.to_date("leg.date").alias("day"), "leg.competition", "leg.home", "leg.away", "leg.key", "leg.odds"), "legs")
    books.meet_results(as_stream(legs, "legs-in", weeks(F.col("day"))), late_results(spark, sf), feed_names(spark, sf, legs), met,
                       folder(spark, "ck")).awaitTermination()
    books.grade_slips(books.stream_met(spark, met), graded, folder(spark, "ck")).awaitTermination()
    return rounded(books.read_slips(spark, graded), 6)


_MARK = "CAST(day AS VARCHAR) || '|' || competition || '|' || match || '|' || key || '|' || selection"


@query("stream_notify_changes", "T7 F18", f"""
WITH n AS (SELECT competition, band, {_MARK} AS mark FROM x_ledger QUALIFY row_number() OVER (PARTITION BY competition, band ORDER BY day DESC, {_MARK}) = 1)
SELECT competition, band, mark FROM n UNION ALL SELECT competition, band, mark || ' or draw' FROM n WHERE CAST(substr(competition, 2) AS INTEGER) % 2 = 0
""")
def stream_notify_changes(spark, sf):
    """All picks arrive in three micro-batches: new, unchanged, and changed for every other competition; only news is sent."""
    rows = ledger_rows(spark, sf)
    changed = F.when(F.substring("competition", 2, 2).cast("int") % 2 == 0, F.concat("selection", F.lit(" or draw"))).otherwise(F.col("selection"))
    sent = [rows.withColumn("round", F.lit(i)) for i in (1, 2)] + [rows.withColumn("round", F.lit(3)).withColumn("selection", changed)]
    stream = as_stream(readers.union_layouts(sent), "sent-in", F.col("round"))
    out = folder(spark, "sent-out")
    books.notify_changes(stream, out, folder(spark, "ck"), ["competition", "band"], "day"
                         ).awaitTermination()
    return spark.read.parquet(out).select("competition", "band", "mark")
