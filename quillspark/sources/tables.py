"""Scans of shows and of cleaned episodes, with the tolerant decoding of their text columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def updated_shows(shows: DataFrame, since: str = "", language: str | None = None, show_ids: list[str] | None = None) -> DataFrame:
    """Shows with a target and a language, changed after `since` (compared as text; no bound if empty).

    `show_ids` always narrows the scan. The integer flag `language_uncertain` becomes a boolean.
    """
    out = shows.where(F.col("target_index").isNotNull() & F.col("language_detected").isNotNull())
    if since:
        out = out.where(F.col("updated_at") > since)
    if language:
        out = out.where(F.col("language_detected") == language)
    if show_ids is not None:
        out = out.where(F.col("show_id").isin(show_ids))
    return out.withColumn("language_uncertain", F.col("language_uncertain").cast("boolean"))


def decoded_shows(shows: DataFrame) -> DataFrame:
    """JSON text columns as maps and arrays; null, broken or of the wrong kind they are empty."""
    no_map, no_list = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    return shows.withColumns({
        "image": F.coalesce(F.from_json("image", "map<string,string>"), no_map),
        "external_urls": F.coalesce(F.from_json("external_urls", "map<string,string>"), no_map),
        "categories": F.coalesce(F.from_json("categories", "array<string>"), no_list),
    })


def read_json_dir(spark: SparkSession, path: str, kind: str = "show") -> DataFrame:
    """A directory of JSON files, one document each; unreadable ones are left out, missing fields have their defaults."""
    kinds = {"show": schema.SHOW, "cleaned_episode": schema.CLEANED_EPISODE, "embedding_input": schema.EMBEDDING_INPUT}
    rows = spark.read.schema(kinds[kind]).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    if kind == "show":
        rows = rows.withColumns({"provider": F.coalesce("provider", F.lit("apple_podcasts")), "language_confidence": F.coalesce("language_confidence", F.lit(0.0)), "language_uncertain": F.coalesce("language_uncertain", F.lit(0))})
    key = "show_id" if kind == "show" else "episode_id"
    return rows.where(F.col(key).isNotNull())


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Query or click log: blank and unparseable lines are left out; a missing file is an empty table."""
    fields = {"query_log": schema.QUERY_LOG, "click_log": schema.CLICK_LOG}[kind]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path).where(F.col("request_id").isNotNull())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Search queries of a text file, one a line, trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where(F.col("query") != "")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, episode_id, score, relevance) of a judgments file, wrapped in a field of that name or bare."""
    inner = "map<string,struct<score:double,relevance:int>>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<judgments:map<string,{inner}>>")["judgments"]
    bare = F.from_json("value", f"map<string,{inner}>")
    rows = text.select(F.explode(F.when(wrapped.isNotNull(), wrapped).otherwise(bare)).alias("query", "docs"))
    return rows.select("query", F.explode("docs").alias("episode_id", "j")).select("query", "episode_id", "j.*")


def read_labelled_languages(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples; fails if a row has no correct_language."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.withColumn("correct_language", F.when(F.col("correct_language").isNull(), F.raise_error(F.lit("a sample has no correct_language"))).otherwise(F.col("correct_language")))


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 1) -> DataFrame:
    """A table of a SQLite file by row-id ranges, one connection each; the file must be visible to all executors."""
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        columns = [(r[1], kinds.get(r[2].upper(), "string")) for r in con.execute(f'PRAGMA table_info("{table}")')]
        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    finally:
        con.close()
    names = ", ".join(f'"{c}"' for c, _ in columns)
    fields = ", ".join(f"`{c}` {k}" for c, k in columns)
    if lo is None:
        return spark.createDataFrame([], fields)
    step = -(-(hi - lo + 1) // partitions)
    ranges = spark.range(0, partitions, 1, partitions)

    def scan(batches):
        import pandas as pd

        own = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        for b in batches:
            for i in b["id"]:
                yield pd.read_sql_query(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', own, params=(lo + int(i) * step, lo + (int(i) + 1) * step))
        own.close()

    return ranges.mapInPandas(scan, fields)


def latest_report(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The report `name` of the newest dated folder (yyyy-mm-dd) under `root`; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{name}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    dated = sorted(str(f.getPath()) for f in found if re.fullmatch(r"\d{4}-\d{2}-\d{2}", f.getPath().getParent().getName()))
    return spark.read.option("multiLine", True).json(dated[-1]) if dated else None
