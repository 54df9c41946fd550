"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "fairline", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults above; anything passed in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def short_methods(spark: SparkSession) -> None:
    """Let wide projections be compiled: HotSpot never compiles a method of over 8000 bytes.

    A stage whose generated method is larger runs operator by operator, in methods that are
    split. A limit that the session was given stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":  # Spark's own
        spark.conf.set(name, "8000")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) is a local folder made, and it is
    written back to the session so that every later call agrees on it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    # The DataFrame-level setting is readable from every caller of this session.
    local = spark.conf.get("spark.fairline.localDir", None)
    if not local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        local = tempfile.mkdtemp(prefix="fairline-")
        spark.conf.set("spark.fairline.localDir", local)
    return local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Needed only by the few operators that run Python in tasks, where the package is not
    installed on the workers.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="fairline-pkg-"))
    copy = target / "src" / root.name
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    archive = shutil.make_archive(str(target / root.name), "zip", str(target / "src"))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a frame is read by several later passes (predictions, graded selections):
    the columns stay prunable, the lineage is short, and a lost executor costs a re-read.
    ``codec`` is that of the files, the session's if not given.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "fairline", f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
