"""Session factory and the small helpers every operator shares."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "quillspark") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that it need not be installed on the executors."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._quillspark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one of this process, on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-ckpt-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """The rows written as a compressed table in the shared folder and read again, so that a lost executor loses none of them.

    The tables stay until `release_cuts`, since plans that were built on them may still run. The shuffle files that the
    writing took are deleted at its end. `file_rows`: rows of a file at most, so that as many tasks can read what few have written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(clean, before)
    spark.sparkContext._quillspark_cuts = [*getattr(spark.sparkContext, "_quillspark_cuts", []), path]
    return spark.read.schema(df.schema).parquet(path)


def release_cuts(spark: SparkSession) -> int:
    """Delete the tables that `cut_lineage` wrote for this session, once the results built on them are written; how many there were."""
    paths = getattr(spark.sparkContext, "_quillspark_cuts", [])
    spark.sparkContext._quillspark_cuts = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """`wanted`, or with the first free number behind it where the input already has such a column (case-insensitive)."""
    used, name, n = {c.lower() for c in taken}, wanted, 1
    while name.lower() in used:
        name, n = f"{wanted}_{n}", n + 1
    return name
