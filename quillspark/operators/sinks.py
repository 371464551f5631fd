"""Sinks: versioned datasets behind an alias, all-or-nothing commits, cursors, snapshots, logs, reports."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path, PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import check_strict


class Store:
    """A folder of datasets on any file system Spark reaches: `name-vN` directories and one manifest of aliases.

    A version is written whole before the manifest points to it, so readers see the old or the new one and never a part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._fs.mkdirs(self._path(self.root))

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _local(self, name: str) -> Path | None:
        """The file of a name on the local file system, None on any other."""
        uri = self._fs.makeQualified(self._path(f"{self.root}/{name}")).toUri()
        return Path(uri.getPath()) if uri.getScheme() == "file" else None

    def _write(self, name: str, text: str) -> None:
        """Write beside, then rename over it in one step: a reader sees the old file or the new one, never none and never a part."""
        if to := self._local(name):
            to.parent.mkdir(parents=True, exist_ok=True)
            tmp = to.with_name(f".{uuid.uuid4().hex}")
            tmp.write_text(text, encoding="utf-8")
            os.replace(tmp, to)
            return
        tmp, to = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(to.getParent())
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, to, over)

    def _claim(self, name: str) -> bool:
        """Create an empty file; False if there is one, so of several writers one gets it."""
        try:
            if to := self._local(name):
                to.parent.mkdir(parents=True, exist_ok=True)
                to.open("x").close()
            else:
                self._fs.create(self._path(f"{self.root}/{name}"), False).close()
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def _json(self, name: str, default):
        text = self._read(name)
        return default if text is None else json.loads(text)

    # versions and aliases

    def aliases(self) -> dict[str, str]:
        return self._json("_aliases.json", {})

    def versions(self, name: str) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        return sorted(int(x.rsplit("-v", 1)[1]) for x in found if x.startswith(f"{name}-v") and x.rsplit("-v", 1)[1].isdigit() and self._fs.exists(self._path(f"{self.root}/{x}/_SUCCESS")))

    def write_version(self, df: DataFrame, name: str, partition_by: list[str] | None = None, schema: str | None = None) -> str:
        """Write the next version that no other writer has claimed and return its name. With a schema, unknown fields are refused. Nothing is published yet."""
        if schema:
            check_strict(df.columns, schema)
        n = max(self.versions(name), default=0) + 1
        while not self._claim(f"_claims/{name}-v{n}"):
            n += 1
        version = f"{name}-v{n}"
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{self.root}/{version}")
        return version

    def publish(self, alias: str, version: str) -> None:
        """Point the alias to a complete version, in one step. A dataset that has the alias' own name stands in its way."""
        if self._fs.exists(self._path(f"{self.root}/{alias}")):
            raise ValueError(f"{alias} is a dataset; an alias cannot have its name")
        if not self._fs.exists(self._path(f"{self.root}/{version}/_SUCCESS")):
            raise ValueError(f"{version} is not complete")
        self.publish_all({alias: version})

    def publish_all(self, versions: dict[str, str]) -> None:
        """Point several aliases to their versions in one step."""
        self._write("_aliases.json", json.dumps(self.aliases() | versions, indent=1, sort_keys=True))

    def read(self, name: str) -> DataFrame:
        """The dataset behind an alias, or a version by its own name."""
        parts = self._buckets(name)
        if parts:
            return self.spark.read.parquet(*(f"{self.root}/{p}" for p in parts.values()))
        return self.spark.read.parquet(f"{self.root}/{self.aliases().get(name, name)}")

    def _buckets(self, alias: str) -> dict[int, str]:
        return {int(k.rsplit("#", 1)[1]): v for k, v in self.aliases().items() if k.rsplit("#", 1)[0] == alias and "#" in k}

    def merge_buckets(self, fresh: DataFrame, alias: str, keys: list[str], version: list[str], buckets: int = 64) -> list[int]:
        """Merge rows into a dataset that lies in buckets of its keys, latest version wins; the buckets that were rewritten.

        Only buckets that have a new row are read and written; all become visible in one step. The number of buckets is that
        of the first merge.
        """
        from .state import upsert_latest

        there = self._buckets(alias)
        buckets = self._json(f"_buckets/{alias}.json", {"buckets": buckets})["buckets"]
        at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = sorted(r[0] for r in fresh.select(at).distinct().collect())  # at most `buckets`
        if not touched:
            return []
        old = [f"{self.root}/{there[i]}" for i in touched if i in there]
        present = self.spark.read.schema(fresh.schema).parquet(*old) if old else fresh.limit(0)
        merged = upsert_latest(present, fresh, keys, version).withColumn("_bucket", at)
        v = self.write_version(merged.repartition("_bucket"), f"{alias}-buckets", ["_bucket"])
        self._write(f"_buckets/{alias}.json", json.dumps({"buckets": buckets}))
        self.publish_all({f"{alias}#{i}": f"{v}/_bucket={i}" for i in touched})
        return touched

    def exists(self, name: str) -> bool:
        return name in self.aliases() or bool(self._buckets(name)) or bool(self._fs.exists(self._path(f"{self.root}/{name}/_SUCCESS")))

    def view(self, alias: str) -> None:
        self.read(alias).createOrReplaceTempView(alias.replace("-", "_"))

    def drop_version(self, version: str) -> None:
        if any(v.split("/")[0] == version for v in self.aliases().values()):
            raise ValueError(f"{version} is published")
        self._fs.delete(self._path(f"{self.root}/{version}"), True)

    def commit(self, df: DataFrame, alias: str, errors: int = 0, partition_by: list[str] | None = None) -> bool:
        """All or nothing: publish a new version only if no action failed."""
        if errors:
            return False
        self.publish(alias, self.write_version(df, alias, partition_by))
        return True

    def migrate(self, df: DataFrame, alias: str) -> dict[str, object]:
        """Write and publish a rebuilt dataset if it holds at least as many rows as the present one."""
        old = self.read(alias).count() if self.exists(alias) else None
        version = self.write_version(df, alias)
        new = self.spark.read.parquet(f"{self.root}/{version}").count()
        passed = old is None or new >= old
        if passed:
            self.publish(alias, version)
        return {"version": version, "old": old, "new": new, "passed": passed}

    # cursors

    def cursor(self, alias: str) -> str:
        return self._json(f"_cursors/{alias}.json", {}).get("since", "")

    def since(self, aliases: list[str]) -> str:
        """The lowest cursor; empty (no bound) if any alias has none."""
        return min((self.cursor(a) for a in aliases), default="")

    def advance(self, alias: str, since: str, errors: int = 0, dry_run: bool = False, narrowed: bool = False) -> bool:
        """Move a cursor after a real, whole and clean run only; an empty `since` leaves it."""
        if errors or dry_run or narrowed or not since:
            return False
        self._write(f"_cursors/{alias}.json", json.dumps({"since": since}))
        return True

    # snapshots

    def snapshot(self, df: DataFrame, name: str, keys: list[str]) -> dict[str, object]:
        """A version with a manifest: rows, columns and a fingerprint that does not depend on the order of rows."""
        if "_fingerprint" in df.columns:
            raise ValueError("_fingerprint is reserved")
        version = self.write_version(df, name)
        meta = {"version": version, "keys": keys, "columns": sorted(df.columns)} | fingerprint(self.spark.read.parquet(f"{self.root}/{version}"))
        self._write(f"_snapshots/{version}.json", json.dumps(meta))
        return meta

    def restore(self, version: str, current: DataFrame, force: bool = False, reason: str = "") -> tuple[str, DataFrame | None]:
        """('noop', None) if the table is as in the snapshot, else ('restored', rows); a snapshot that was changed is refused.

        A table that no longer has the snapshot's keys has drifted; restoring it takes `force` and a reason.
        """
        meta = self._json(f"_snapshots/{version}.json", None)
        if meta is None:
            raise ValueError(f"{version} has no manifest")
        saved = self.spark.read.parquet(f"{self.root}/{version}")
        if sorted(saved.columns) != meta["columns"] or fingerprint(saved) != {k: meta[k] for k in ("rows", "digest")}:
            raise ValueError(f"{version} is not what its manifest says")
        if fingerprint(current.select(*saved.columns)) == fingerprint(saved):
            return "noop", None
        drifted = current.select(*meta["keys"]).join(saved, meta["keys"], "left_anti").limit(1).count() + saved.join(current, meta["keys"], "left_anti").limit(1).count()
        if drifted and not (force and reason):
            return "drifted", None
        return "restored", saved


def fingerprint(df: DataFrame) -> dict[str, object]:
    """Rows and a digest over all of them: sums of two row hashes, so neither order nor partitioning matters."""
    cols = sorted(df.columns)
    row = df.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("a"), F.hash(*cols).cast("decimal(38,0)").alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return {"rows": row.n, "digest": f"{row.a}:{row.b}"}


def migrate_cache(flat: DataFrame, versioned: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Outcome for each flat cache entry (show_id, model_name, embedding_version, embeddings MAP): the versioned entry it becomes.

    unmigrated_missing_metadata without model or version, unmigrated_infer_failed for a model of unknown length, conflict_existing_same
    or _different where the versioned entry exists (compared by a hash over ids and vectors, not by time), else migrated_ok.
    """
    digest = lambda m: F.sha2(F.to_json(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,array<float>>"))))), 256)
    known = F.coalesce(*(F.when(F.col("model_name") == k, F.lit(v)) for k, v in dims.items()), F.lit(None).cast("int"))
    new = flat.withColumn("version", F.substring_index("embedding_version", "/", -1)).withColumn("dims", known).withColumn("digest", digest(F.col("embeddings")))
    old = versioned.select("show_id", "model_name", F.col("embedding_version").alias("version"), digest(F.col("embeddings")).alias("_old"))
    rows = new.join(old, ["show_id", "model_name", "version"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return rows.withColumn("outcome", F.when(blank("model_name") | blank("embedding_version"), "unmigrated_missing_metadata").when(F.col("dims").isNull(), "unmigrated_infer_failed").when(F.col("_old") == F.col("digest"), "conflict_existing_same").when(F.col("_old").isNotNull(), "conflict_existing_different").otherwise("migrated_ok")).drop("_old")


def append_log(df: DataFrame, path: str) -> bool:
    """Append rows as JSON lines. A failure to write is reported and never raised."""
    try:
        df.write.mode("append").json(path)
        return True
    except Exception:  # noqa: BLE001 - logging must not break what it logs
        return False


def export_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Documents as JSON lines, partitioned for point reads."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).json(path)


def report_markdown(title: str, df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses one that is not small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def file_name(key: str) -> str:
    """Ids hold colons, file names do not."""
    return PurePosixPath(key.replace(":", "_")).name
