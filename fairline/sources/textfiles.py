"""Books kept as CSV or JSON lines: pinned columns, unreadable rows kept apart instead of guessed or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairline.sources import sinks

LINE, PROBLEM = "_line", "_problem"


def write_csv(df: DataFrame, path: str, digits: int = 5, mode: str = "errorifexists") -> None:
    """CSV with a header in every file, doubles rounded; null is an empty cell."""
    sinks.rounded(df, digits).write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def _columns(schema: str) -> dict[str, str]:
    return dict(item.strip().rsplit(" ", 1) for item in schema.split(","))


def _layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The CSV files of a folder by their header, whose order of columns may differ. A header is the first line of a file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect():  # one row per layout
        groups.setdefault(tuple(row["head"].split(",")), []).extend(row["files"])
    return groups


def read_book(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """The rows of a folder of ``kind`` csv or json under the columns of ``schema``, and ``_problem``.

    A column that a file lacks is null, one that ``schema`` lacks is left out. ``_problem`` is null for a sound row; else
    it is ``line`` where the line has too few or too many cells or is no JSON object (its text is in ``_line``), or
    the names of the columns whose cells can't be read as their type (those cells are null). Nothing is dropped.
    """
    types = _columns(schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "header": True, "enforceSchema": True}
    if kind == "json":
        frames = [spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=LINE).schema(
            ", ".join(f"`{c}` string" for c in [*types, LINE])).json(path)]
    elif kind == "csv":
        frames = [spark.read.options(**options).schema(", ".join(f"`{c}` string" for c in [*head, LINE])).csv(files)
                  for head, files in sorted(_layouts(spark, path).items())]
    else:
        raise ValueError(f"books are csv or json, not {kind}")
    typed = []
    for frame in frames:
        cell = {c: F.col(f"`{c}`") if c in frame.columns else F.lit(None).cast("string") for c in types}
        # whole numbers may be written with a fraction of zero
        value = {c: (F.when(x.try_cast("double") % 1 == 0, x.try_cast("double").cast(types[c])) if types[c] in ("int", "bigint") else x.try_cast(types[c]))
                 for c, x in cell.items()}
        unread = F.concat_ws(",", *[F.when(x.isNotNull() & value[c].isNull(), c) for c, x in cell.items()])
        problem = F.when(F.col(LINE).isNotNull(), "line").when(unread != "", unread)
        typed.append(frame.select(*[value[c].alias(c) for c in types], LINE, problem.alias(PROBLEM)))
    if not typed:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in [*types.items(), (LINE, "string"), (PROBLEM, "string")]))
    out = typed[0]
    for frame in typed[1:]:
        out = out.unionByName(frame)
    return out


def sound(book: DataFrame) -> DataFrame:
    return book.filter(F.col(PROBLEM).isNull()).drop(LINE, PROBLEM)


def broken(book: DataFrame) -> DataFrame:
    return book.filter(F.col(PROBLEM).isNotNull())
