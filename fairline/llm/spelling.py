"""Spelling variants of names: asymmetric chunks joined with positional grams, each name's most frequent neighbour.

Feeds spell the teams of a match in their own ways. A spelling that is one letter from a far more frequent one
is most likely a slip; ``variants`` finds the spelling it stands for, and follows slips of slips to the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.session import stage

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Pairs that one chunk may meet on before what it leaves open is cut into chunks again.
PAIRS = 10_000


def spellings(matches: DataFrame, teams: tuple[str, ...] = ("home_team", "away_team")) -> DataFrame:
    """(team, n): how often each spelling stands in the team columns of match rows; null is none."""
    sides = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in teams])).alias("team")
    return matches.select(sides).where("team IS NOT NULL").groupBy("team").agg(F.count(F.lit(1)).alias("n"))


def outside(shift: int) -> Column:
    """What of a word lies outside the open part [start, stop), which is ``shift`` longer here, with its place."""
    return F.xxhash64("gap", "chars", "start", "stop", F.substring("team", F.lit(1), F.col("start")),
                      F.substring("team", F.col("stop") + 1 + shift, F.length("team")))


def chunked(entries: DataFrame) -> DataFrame:
    """Both halves of the open part: the first is taken as kept, which leaves the second open, and the other way about."""
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(middle.alias("start"), "stop"), F.struct("start", middle.alias("stop")))).alias("half")
    return entries.select("team", "n", "gap", "chars", "side", halves).select("team", "n", "gap", "chars", "side", "half.*")


def keyed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("kept", F.when(F.col("side") == "grams", F.when(F.col("gap") == 1, outside(1)).otherwise(outside(0))).otherwise(outside(0)))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(team, n, near, near_n), both ways round, of all ``words(team, n)`` that differ by one inserted, deleted or replaced character.

    The shorter word of a pair gives two disjoint chunks, its halves, the other its positional grams of the same
    lengths; one edit leaves one chunk whole, in the same place or one further. The grams that the shift of one
    allows are the only ones written: lengths differ by ``gap`` (0 or 1), so the first half is met at its own
    place and the second ``gap`` places on. A chunk on which more than ``pairs`` pairs would meet is not joined:
    what it leaves open is cut into two chunks again, one of which the edit spares too, so that both have to meet.
    That ends when one character is open, where (at equal lengths) all that meet are near. A pair is taken only
    at the first chunk it shares, so none comes twice.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(gap).alias("gap"), F.lit(side).alias("side")) for gap in (0, 1) for side in ("chunks", "grams")]))
    roles = words.select("team", "n", sides.alias("r")).select("team", "n", "r.*")
    roles = roles.withColumn("chars", F.length("team") - F.when(F.col("side") == "grams", F.col("gap")).otherwise(0))
    entries = roles.select("team", "n", "gap", "chars", "side", F.lit(0).alias("start"), F.col("chars").alias("stop"))
    found = None
    while True:
        entries = stage(keyed(chunked(entries)), "spelling-chunks")
        met = entries.groupBy("kept").agg(F.count_if(F.col("side") == "chunks").alias("x"), F.count_if(F.col("side") == "grams").alias("y"))
        hot = stage(met.where((F.col("x") * F.col("y") > pairs)).select("kept"), "spelling-hot")
        splits = (F.col("stop") - F.col("start") >= 2)
        rest = entries.join(hot, "kept", "left_anti").unionByName(entries.where(~splits).join(hot, "kept", "left_semi"))
        x = rest.where("side = 'chunks'").drop("side", "gap", "chars")
        y = rest.where("side = 'grams'").select("kept", F.col("team").alias("near"), F.col("n").alias("near_n"), "gap", "chars")
        open_part = lambda c: F.substring(c, F.col("start") + 1, F.col("stop") - F.col("start"))
        first = (F.col("stop") == F.col("chars")) | (open_part("team") != open_part("near"))
        once = (F.col("gap") == 1) | (F.col("team") < F.col("near"))
        some = x.join(y, "kept").where(once & first & (F.levenshtein("team", "near", 1) == 1)).select("team", "n", "near", "near_n")
        found = some if found is None else found.unionByName(some)
        if not hot.take(1):
            break
        entries = entries.where(splits).join(hot, "kept", "left_semi").drop("kept")
    other = F.struct(F.col("near").alias("team"), F.col("near_n").alias("n"), F.col("team").alias("near"), F.col("n").alias("near_n"))
    return found.select(F.explode(F.array(F.struct("team", "n", "near", "near_n"), other)).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """(team, root): ``links(team, form)`` followed to the end. The way is halved each round, so a chain of c
    links takes log2(c) rounds; each form is at least twice as frequent as what leads to it, so c is small."""
    at = stage(links.select("team", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("team").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(further, "root", "left").select("team", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                      "spelling-roots")
        if not moved.where("moved").take(1):
            return moved.select("team", "root")
        at = moved.select("team", "root")


def variants(names: DataFrame, team: str = "team", n: str = "n", min_chars: int = MIN_CHARS, min_n: int = MIN_COUNT, ratio: int = RATIO,
             pairs: int = PAIRS) -> DataFrame:
    """The spelling that each spelling of ``names`` stands for: (team, form, root, n, n_near, form_n).

    ``names`` holds spellings and how often each occurs (``spellings`` makes it from match rows); rows of one
    spelling are added up. Spellings under ``min_chars`` code points or ``min_n`` occurrences are left out. Two
    are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts a
    spelling's near ones. ``form`` is the most frequent of them, of equally frequent ones the smallest in
    code-point order, if it occurs at least ``ratio`` times as often; else null, as is its count ``form_n``.
    ``root`` follows forms to the last; a spelling without a form is its own root.

    All joins are Spark's; no group of spellings is held in one task, and frequent chunks are cut further
    (``pairs``), never dropped. Null spellings and counts don't take part; an empty table gives an empty
    one; very long spellings only take more rounds; other columns are never read.
    """
    if ratio < 2:
        raise ValueError("forms have to be more frequent than their variants, or links could run in circles")
    counted = names.select(F.col(f"`{team}`").cast("string").alias("team"), F.col(f"`{n}`").cast("long").alias("n")).where("team IS NOT NULL")
    words = counted.where(F.length("team") >= min_chars).groupBy("team").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)
    words = stage(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_pairs(words, pairs).groupBy("team", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    near = stage(near.select("team", "n_near", formed["near"].alias("form"), (-formed["n"]).alias("form_n")), "spelling-near")
    ended = roots(near.where("form IS NOT NULL"))
    rows = words.join(near, "team", "left").join(ended, "team", "left")
    return rows.select(F.col("team").alias(team), "form", F.coalesce("root", "team").alias("root"), F.col("n").alias(n),
                       F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
