"""Held-out texts inside training texts: winnowed fingerprints, joined and extended word by word.

The project learns from results files and holds some back (the later seasons of a division). A held-out
file's rows that also stand in a training file make every check on it worthless. Files are compared as
words, so the separators, the case of letters and the line breaks of the two may differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.text import keyed
from fairline.session import stage

#: Fixed values of the contract: ASCII letters in lower case, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, GRAM = 10, 5
#: Bits of a packed fingerprint that hold its place; longer texts are cut into overlapping parts of that many grams.
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS

ROW = ("key", "a", "b")
SHORT = "struct<start:int,stop:int,context:bigint>"
SHORTS = f"array<{SHORT}>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def rows_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, a, b, words): a row is named by its key and 96 bits of hashes of its text, so that rows without a
    key or with a repeated one stay apart; rows alike in both have one result."""
    named = keyed(rows, key, text).select("key", F.xxhash64("text").alias("a"), F.hash("text").alias("b"), "text")
    return named.select(*ROW, words_of(F.col("text")).alias("words"))


def hashes(rows: DataFrame, n: int, name: str = "h") -> DataFrame:
    """The hash of every run of ``n`` words in place of the words, null where there is none. Not a filter: pushed
    below the words it would look for them twice."""
    single = rows.select(*[c for c in rows.columns if c != "words"], F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    if n == 1:
        return single.withColumnRenamed("_h", name)
    run = F.transform(F.sequence(F.lit(0), F.size("_h") - n), lambda i: F.xxhash64(*[F.get("_h", i + d) for d in range(n)]))
    return single.withColumn(name, F.when(F.size("_h") >= n, run)).drop("_h")


def fingerprints(rows: DataFrame, span: int = SPAN, gram: int = GRAM, places: int = PLACES) -> DataFrame:
    """(key, a, b, at, mark) of texts of ``span`` words or more: the smallest hash among the grams of each window
    of ``span`` words, the leftmost of equal ones. Two texts that share ``span`` words in a row choose the same
    gram of them, as the choice looks at nothing outside the window.

    Hash and place are packed into one number, so that a window's choice is one ``least``. ``places`` grams have
    room; a longer text is cut into parts that overlap by a window, and no window is lost or told apart by that.
    """
    window = span - gram + 1
    grams = hashes(rows, gram).select(*ROW, F.when(F.size("h") >= window, F.col("h")).alias("h"))
    parts = grams.select(*ROW, "h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - window, F.lit(0)), F.lit(places - window))).alias("start"))
    part = F.when(F.size("h") <= places, F.col("h")).otherwise(F.slice("h", F.col("start") + 1, F.lit(places)))
    part = parts.where((F.col("start") == 0) | (F.size("h") > F.lit(places))).select(*ROW, "start", part.alias("h"))
    packed = part.select(*ROW, "start", F.transform("h", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("bigint"))).alias("p"))
    least = packed.select(*ROW, "start", "p" if window == 1 else F.transform(F.sequence(F.lit(0), F.size("p") - window), lambda j: F.least(*[
        F.get("p", j + d) for d in range(window)])).alias("p"))
    once = least.select(*ROW, "start", F.explode(F.filter("p", lambda v, j: (j == 0) | (v != F.get("p", j - 1)))).alias("p"))
    return once.select(*ROW, (F.col("start") + F.col("p").bitwiseAND(PLACES - 1)).cast("int").alias("at"), F.shiftright("p", PLACE_BITS).alias("mark"))


def around(words: str, at: Column, gram: int, reach: int) -> Column:
    """The words of a gram and the ``reach`` words on either side of it, nearest first."""
    before = F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))
    return F.struct(at.alias("at"), F.reverse(before).alias("before"), F.slice(words, at + 1, F.lit(gram)).alias("gram"),
                    F.slice(words, at + 1 + gram, F.lit(reach)).alias("after"))


def alike(one: str, other: str) -> Column:
    """How many words two lists share from their starts on."""
    same = F.zip_with(one, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(one)).otherwise(first.cast("int") - 1)


def held_out_leaks(files: DataFrame, held_out: DataFrame, key: str = "file", text: str = "body", held_key: str = "file", held_text: str = "body",
                   span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """What of the ``held_out`` texts stands in each of ``files``: (key, n_words, n_hit, held_out, contaminated).

    A word of a file is hit if it lies in ``span`` words in a row that some held-out text also has; a held-out
    text of fewer words, but not none, counts if it stands whole in the file. ``held_out`` lists the keys of the
    texts found, as strings in order. One row per row of ``files``, whatever its key.

    Training and held-out fingerprints are joined on their hash; what they meet on is extended word by word to
    both sides, so hashes never decide alone, and every shared run of ``span`` words is met by a fingerprint of
    its own. Extending by ``span - gram`` words is enough: what lies beyond has fingerprints of its own. Texts
    shorter than ``span`` words are outside what winnowing can promise; all runs of their lengths are looked up
    instead (by 96 bits of hashes).

    No Python runs in tasks and no side is broadcast by force: the held-out contexts are a stored table, whose
    size Spark checks. Held-out texts that repeat a passage share one context, so a passage is compared once.

    Null text has no words; a null held-out key is listed as the empty string; an empty table of either kind gives
    no hits; a repeated held-out row counts once; other columns are never read. Repeated rows of ``files`` each
    have their result.
    """
    if not 0 < gram <= span:
        raise ValueError("a gram has to be shorter than the span it stands for")
    reach, row = span - gram, list(ROW)
    rows = rows_of(files, key, text)
    named = held_out.select(F.coalesce(F.col(f"`{held_key}`").cast("string"), F.lit("")).alias("file"), F.col(f"`{held_text}`").alias("body"))
    held = stage(rows_of(named, "file", "body").dropDuplicates(row), "leaks-held")

    # held-out side: each distinct context of a fingerprint once, and who has it
    placed = fingerprints(held, span, gram).groupBy(*row).agg(F.collect_list(F.struct("at", "mark")).alias("marks"))
    spots = held.join(placed, row).select("key", F.explode(F.transform("marks", lambda m: F.struct(
        m["mark"].alias("mark"), around("words", m["at"], gram, reach).alias("c")))).alias("s"))
    content = [F.col(f"s.c.{c}").alias(f"h_{c}") for c in ("before", "gram", "after")]
    spots = stage(spots.select("key", "s.mark", *content).withColumn("context", F.xxhash64("h_before", "h_gram", "h_after")), "leaks-spots")
    contexts = stage(spots.drop("key").distinct(), "leaks-contexts")
    owners = spots.select("context", "key")

    # training side: places whose mark a held-out text has
    hits = fingerprints(rows, span, gram).join(contexts.select("mark").distinct(), "mark", "left_semi").groupBy(*row).agg(F.collect_set("at").alias("places"))
    hits = hits.withColumn("shorts", F.array().cast(SHORTS))
    lengths = [r[0] for r in held.where(F.size("words").between(1, span - 1)).select(F.size("words")).distinct().collect()]  # fewer than span
    for n in sorted(lengths):
        short = hashes(held.where(F.size("words") == n), n).select("key", F.get("h", 0).alias("mark"), F.xxhash64(F.lit(n), F.get("h", 0)).alias("context"))
        owners = owners.unionByName(short.select("context", "key"))
        # not a bare column: Spark would infer a filter on it and write the hashes into that filter's inner loop
        runs = hashes(rows, n).select(*row, F.posexplode(F.coalesce("h", F.array().cast("array<bigint>"))).alias("at", "mark")).join(short.select("mark", "context").distinct(), "mark")
        hits = hits.unionByName(runs.groupBy(*row).agg(F.array().cast("array<int>").alias("places"), F.collect_set(F.struct(
            F.col("at").alias("start"), (F.col("at") + n).alias("stop"), "context")).alias("shorts")))
    if lengths:
        hits = hits.groupBy(*row).agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("shorts")).alias("shorts"))
    hits = stage(hits, "leaks-hits").select(*[F.col(c).alias(f"hit_{c}") for c in row], "places", "shorts")

    # the hit files' words around those places against the contexts
    same = F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("a") == F.col("hit_a")) & (F.col("b") == F.col("hit_b"))
    sized = rows.select(*row, "words", F.size("words").cast("long").alias("n_words")).join(hits, same, "left").withColumn("row", F.monotonically_increasing_id())
    opened = sized.select("key", "a", "n_words", "row", F.explode_outer(F.concat(
        F.transform("places", lambda p: F.struct(around("words", p, gram, reach).alias("s"), F.lit(None).cast(SHORT).alias("short"))),
        F.transform("shorts", lambda x: F.struct(around("words", F.lit(None).cast("int"), gram, reach).alias("s"), x.alias("short"))))).alias("hit"))
    opened = opened.select("key", "a", "n_words", "row", F.col("hit.s").alias("s"), F.col("hit.short").alias("short"))
    gram_hash = F.xxhash64(*[F.xxhash64(F.get("s.gram", d)) for d in range(gram)])
    # a row without a fingerprint still comes out; its own hash keeps such rows from meeting in one null
    opened = opened.withColumn("mark", F.when(F.col("s.at").isNotNull(), F.shiftright(F.shiftleft(gram_hash, PLACE_BITS), PLACE_BITS)).otherwise(F.col("a")))
    met = opened.join(contexts, "mark", "left").withColumns({"left": alike("s.before", "h_before"), "right": alike("s.after", "h_after")})
    full = F.coalesce((F.col("s.gram") == F.col("h_gram")) & (F.col("left") + gram + F.col("right") >= span), F.lit(False))
    met = met.select("row", "key", "n_words", F.when(full, F.struct(
        (F.col("s.at") - F.col("left")).alias("start"), (F.col("s.at") + gram + F.col("right")).alias("stop"), "context")).otherwise(F.col("short")).alias("m"))
    found = stage(met.select("row", "key", "n_words", F.when(F.col("m").isNotNull(), F.struct("m.start", "m.stop")).alias("run"), "m.context"), "leaks-found")

    total = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))
    covered = F.aggregate(F.array_sort(F.collect_set("run")), total, lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["stop"] - F.greatest(r["start"], acc["stop"]), F.lit(0))).alias("n"),
        F.greatest(acc["stop"], r["stop"]).alias("stop")), lambda acc: acc["n"])
    result = found.groupBy("row").agg(F.first("key").alias(key), F.first("n_words").alias("n_words"), covered.alias("n_hit"))
    lists = found.where("context IS NOT NULL").select("row", "context").distinct().join(owners.distinct(), "context").groupBy("row").agg(
        F.array_sort(F.collect_set("key")).alias("held_out"))
    return result.join(lists, "row", "left").select(
        F.col(f"`{key}`"), "n_words", "n_hit", F.coalesce("held_out", F.array().cast("array<string>")).alias("held_out"), (F.col("n_hit") > 0).alias("contaminated"))
