"""State as tables: upserts, embedding plans, drift, backfill of statuses, commits. Everything is a join and a rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import scalars as X

# Categories of a status row, their class, and the status that each asks for (a hard failure asks for none).
CLASSES = {
    "pass": "normal", "neutral_metadata_absent": "normal", "anomaly_partial_metadata": "anomaly", "anomaly_cache_missing": "anomaly",
    "fail_payload_unreadable": "hard_fail", "fail_payload_identity_mismatch": "hard_fail", "fail_episode_entry_missing": "hard_fail",
}
TARGETS = {"pass": "done", "neutral_metadata_absent": "pending", "anomaly_partial_metadata": "pending", "anomaly_cache_missing": "pending"}
ANOMALY_PERCENT = 10.0


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Rows of both tables, of each key the one of the highest version; at equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(*(F.col(v).desc_nulls_last() for v in version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n", "_new")


def partial_update(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Fields of `new` where they are set, else those of `old`; `keep` stays as it was in documents that exist already."""
    names = [c for c in new.columns if c != key]
    extra = [c for c in old.columns if c != key and c not in names]
    o = old.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in old.columns if c != key))
    joined = new.join(o, F.col(key) == F.col("_k"), "full")
    pick = lambda c: F.col(c) if c not in [x for x in old.columns] else F.coalesce(f"_{c}", c) if c in keep else F.coalesce(c, f"_{c}")
    return joined.select(F.coalesce(key, "_k").alias(key), *(pick(c).alias(c) for c in names), *(F.col(f"_{c}").alias(c) for c in extra))


def sync_upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Sync rows by entity and environment; a written row is synced, whatever it was."""
    fresh = rows.withColumn("sync_status", F.lit("synced"))
    return upsert_latest(state, fresh.select(*state.columns), ["entity_type", "entity_id", "environment"], ["last_synced_at"])


def migrate_sync_state(state: DataFrame) -> DataFrame:
    """Sync rows in their present form: rows without an environment are of the default one, columns that were added later are null.

    A table that has the present columns comes out as it is; of rows that then share a key the latest stays.
    """
    kinds = [f.strip().split(" ") for f in schema.SYNC_STATE.split(",")]
    there = set(state.columns)
    cols = [F.col(c).cast(k).alias(c) if c in there else F.lit(None).cast(k).alias(c) for c, k in kinds]
    rows = state.select(*cols).withColumns({"environment": F.coalesce("environment", F.lit("default")), "sync_status": F.coalesce("sync_status", F.lit("pending"))})
    return upsert_latest(rows.limit(0), rows, ["entity_type", "entity_id", "environment"], ["last_synced_at"])


def shows_with_feeds(shows: DataFrame, files: DataFrame) -> DataFrame:
    """(show_id, path, state) of shows and feed files by name, where a colon of the id is an underscore: matched, no_feed or no_show.

    `files` has a column `path`; a name that occurs in several folders matches with its first path.
    """
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.(xml|rss)$", "")
    found = files.where(F.col("path").isNotNull()).groupBy(name.alias("_name")).agg(F.min("path").alias("path"))
    named = shows.where(F.col("show_id").isNotNull()).select("show_id", F.replace("show_id", F.lit(":"), F.lit("_")).alias("_name")).distinct()
    state = F.when(F.col("show_id").isNull(), "no_show").when(F.col("path").isNull(), "no_feed").otherwise("matched")
    return named.join(found, "_name", "full").select("show_id", "path", state.alias("state"))


def mark_status(status: DataFrame, done: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Status rows with new values for the episodes of `done` (by episode_id), the others as they are."""
    hit = done.select("episode_id").distinct().withColumn("_hit", F.lit(True))
    rows = status.join(hit, "episode_id", "left")
    return rows.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in status.columns))


def skip_existing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows with an outcome: skipped if the key exists, filtered without a text, else written."""
    seen = existing.select(key).distinct().withColumn("_seen", F.lit(True))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return rows.join(seen, key, "left").withColumn("outcome", F.when(F.col("_seen"), "skipped").when(blank, "filtered").otherwise("written")).drop("_seen")


def cache_lookup(rows: DataFrame, cache: DataFrame, identity: dict[str, object]) -> DataFrame:
    """Rows with `cache_status`: hit, miss (no vector), or mismatch (a vector of another model, version or length)."""
    c = cache.groupBy("episode_id").agg(F.max_by(F.struct("model_name", "embedding_version", "embedding_dimensions", F.size("embedding").alias("n")), F.struct("embedded_at", "vec_id")).alias("c"))
    same = (F.col("c.model_name") == identity["model"]) & (X.clean_version(F.col("c.embedding_version")) == identity["version"]) & (F.col("c.embedding_dimensions") == identity["dims"]) & (F.coalesce("c.n", F.lit(-1)) == identity["dims"])
    return rows.join(c, "episode_id", "left").withColumn("cache_status", F.when(F.col("c").isNull(), "miss").when(F.coalesce(same, F.lit(False)), "hit").otherwise("mismatch")).drop("c")


def identity_drift(cache: DataFrame, identity: dict[str, object]) -> DataFrame:
    """Cache entries with `drift` (null, model, version, dimension, vector_length, or multiple) and `parse_state`."""
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    kinds = F.array_compact(F.array(
        F.when(~F.col("model_name").eqNullSafe(F.lit(identity["model"])), "model_mismatch"), F.when(~F.col("embedding_version").eqNullSafe(F.lit(identity["version"])), "version_mismatch"),
        F.when(~F.col("embedding_dimensions").eqNullSafe(F.lit(identity["dims"])), "dimension_mismatch"), F.when(n != F.col("embedding_dimensions"), "vector_length_mismatch"),
    ))
    state = F.when(F.col("model_name").isNull(), "missing_model").when(F.col("embedding_version").isNull(), "missing_version").when(F.col("embedding_dimensions").isNull(), "missing_dims").when(n.isNull(), "empty_episodes").otherwise("ok")
    rows = cache.withColumn("_k", kinds)
    return rows.withColumn("drift", F.when(F.size("_k") == 1, F.col("_k")[0]).when(F.size("_k") > 1, F.lit("multiple"))).withColumn("parse_state", state).drop("_k")


def embed_plan(inputs: DataFrame, shows: DataFrame, cache: DataFrame, identity: dict[str, object], force: bool = False) -> DataFrame:
    """What an incremental run does with each input: excluded (its show has no target), skipped (a valid vector) or embed."""
    s = shows.select("show_id", X.target_language(F.col("target_index")).alias("show_language"), F.col("target_index").alias("show_target"))
    rows = cache_lookup(inputs.join(s, "show_id", "left"), cache, identity)
    action = F.when(F.col("show_target").isNull(), "excluded").when((F.col("cache_status") == "hit") & (not force), "skipped").otherwise("embed")
    return rows.withColumn("language", F.coalesce("show_language", X.target_language(F.col("target_index")))).withColumn("action", action)


def episode_drift(status: DataFrame, shows: DataFrame, identities: DataFrame) -> DataFrame:
    """Embedded episodes with `drift`: ok, model_mismatch, version_mismatch, multiple, or unresolvable without a known language.

    `identities` is (language, model, version), a row a language. Versions are compared by what stands behind the last slash.
    """
    rows = status.where(F.col("embedding_model").isNotNull()).join(shows.select("show_id", X.target_language(F.col("target_index")).alias("language")), "show_id", "left").join(F.broadcast(identities), "language", "left")
    model = F.col("embedding_model") != F.col("model")
    version = ~X.clean_version(F.col("embedding_version")).eqNullSafe(F.col("version"))
    drift = F.when(F.col("model").isNull(), "unresolvable").when(model & version, "multiple").when(model, "model_mismatch").when(version, "version_mismatch").otherwise("ok")
    return rows.withColumn("drift", drift)


def backfill_categories(status: DataFrame, cache: DataFrame, dims: int) -> DataFrame:
    """Status rows with their category, class and target status.

    Without model, version or time at all a row is neutral, with a part of them an anomaly. Then the show's cache of that
    identity must be there, be readable (`readable`), be of the row's identity, and hold the episode.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none, whole = blank("embedding_model") & blank("embedding_version") & blank("last_embedded_at"), ~blank("embedding_model") & ~blank("embedding_version")
    ident = lambda m, v: (F.col(m).alias("embedding_model"), X.clean_version(F.col(v)).alias("_v"))
    files = cache.groupBy("show_id", *ident("model_name", "embedding_version")).agg(F.min("readable").alias("readable"), F.max("embedding_dimensions").alias("_dims"), F.lit(True).alias("_file"))
    entries = cache.where(F.col("embedding").isNotNull()).select("show_id", *ident("model_name", "embedding_version"), "episode_id").distinct().withColumn("_entry", F.lit(True))
    rows = status.withColumn("_v", X.clean_version(F.col("embedding_version"))).join(files, ["show_id", "embedding_model", "_v"], "left").join(entries, ["show_id", "embedding_model", "_v", "episode_id"], "left")
    category = (
        F.when(none, "neutral_metadata_absent").when(~whole, "anomaly_partial_metadata").when(F.col("_file").isNull(), "anomaly_cache_missing").when(~F.col("readable"), "fail_payload_unreadable")
        .when(~F.col("_dims").eqNullSafe(F.lit(dims)), "fail_payload_identity_mismatch").when(F.col("_entry").isNull(), "fail_episode_entry_missing").otherwise("pass")
    )
    out = rows.withColumn("category", category)
    return out.select(*(F.col(c) for c in status.columns), "category", X.lookup(F.col("category"), CLASSES).alias("class"), X.lookup(F.col("category"), TARGETS).alias("target_status"))


def backfill_decision(classified: DataFrame, limit: float = ANOMALY_PERCENT, override: bool = False) -> DataFrame:
    """One row: counts by class, the share of missing caches among rows with metadata, and blocked_hard, blocked_anomaly or apply."""
    missing, meta = F.count_if(F.col("category") == "anomaly_cache_missing"), F.count_if(~F.col("category").isin("neutral_metadata_absent", "anomaly_partial_metadata"))
    s = classified.agg(F.count("*").alias("episodes"), *(F.count_if(F.col("class") == c).alias(c) for c in ("normal", "anomaly", "hard_fail")), F.round(F.coalesce(100.0 * missing / F.nullif(meta, F.lit(0)), F.lit(0.0)), 4).alias("missing_percent"))
    return s.withColumn("decision", F.when(F.col("hard_fail") > 0, "blocked_hard").when((F.col("missing_percent") > limit) & (not override), "blocked_anomaly").otherwise("apply"))


def apply_backfill(status: DataFrame, classified: DataFrame) -> DataFrame:
    """Statuses as classified, only where they differ and the row is still as it was when classified (compared null-safe)."""
    c = classified.where(F.col("target_status").isNotNull()).select(F.col("episode_id").alias("_e"), "target_status", F.col("embedding_status").alias("_seen"), F.col("last_embedded_at").alias("_at"))
    still = F.col("embedding_status").eqNullSafe(F.col("_seen")) & F.col("last_embedded_at").eqNullSafe(F.col("_at")) & F.col("_e").isNotNull()
    rows = status.join(c, F.col("episode_id") == F.col("_e"), "left")
    return rows.select(*(F.when(still, F.col("target_status")).otherwise(F.col(x)).alias(x) if x == "embedding_status" else F.col(x) for x in status.columns))


def show_commits(actions: DataFrame) -> DataFrame:
    """(show_id, ok, failed, committed): a show commits if it was rebuilt, had an action, and none failed."""
    a = actions.groupBy("show_id").agg(F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.min("rebuilt").alias("_r"))
    return a.select("show_id", "ok", "failed", (F.col("_r") & (F.col("failed") == 0) & (F.col("ok") > 0)).alias("committed"))


def resolve_selection(ids: DataFrame, status: DataFrame, shows: DataFrame) -> DataFrame:
    """(episode_id, show_id, language, resolved) of selected ids, each once; without a show or a known language unresolved."""
    s = shows.select("show_id", X.target_language(F.col("target_index")).alias("language"))
    rows = ids.select("episode_id").distinct().join(status.select("episode_id", "show_id").distinct(), "episode_id", "left").join(s, "show_id", "left")
    return rows.select("episode_id", "show_id", "language", F.col("language").isNotNull().alias("resolved"))


def episode_documents(inputs: DataFrame, cleaned: DataFrame, shows: DataFrame) -> DataFrame:
    """Documents of inputs that have a cleaned episode and a route, and the reason why others are rejected.

    The target is that of the cleaned episode, else of the show. A target without an alias is rejected, none at all too.
    """
    c = cleaned.select("episode_id", F.col("cleaned.normalized.title").alias("title"), F.col("cleaned.normalized.description").alias("description"), F.col("original_meta.duration").alias("_d"), F.col("original_meta.language").alias("_l"), F.col("original_meta.audio_url").alias("audio_url"), F.col("target_index").alias("_t")).dropDuplicates(["episode_id"]).withColumn("_c", F.lit(True))
    s = shows.select("show_id", F.col("title").alias("show_title"), F.col("author").alias("publisher"), F.col("target_index").alias("_st"))
    rows = inputs.join(c, "episode_id", "left").join(s, "show_id", "left")
    target = F.coalesce(F.nullif(F.col("_t"), F.lit("")), F.nullif(F.col("_st"), F.lit("")))
    reason = F.when(F.col("_c").isNull(), "no_cleaned_episode").when(target.isNull(), "no_target").when(X.route(target).isNull(), "unknown_target")
    return rows.select("episode_id", "show_id", "title", "description", X.parse_duration(F.col("_d")).alias("duration_sec"), X.normalize_language(F.col("_l")).alias("language"), F.struct("show_title", "publisher").alias("show"), F.struct(F.col("audio_url").alias("url")).alias("audio"), X.route(target).alias("alias"), reason.alias("reject_reason"))


def show_documents(shows: DataFrame) -> DataFrame:
    """Show documents of decoded shows: the provider defaults, and the provider apple has its link under apple_podcasts."""
    provider = F.coalesce("provider", F.lit("apple_podcasts"))
    link = F.when(provider == "apple", F.lit("apple_podcasts")).otherwise(provider)
    return shows.select(
        "show_id", "title", F.col("author").alias("publisher"), "description", provider.alias("provider"), F.create_map(provider, F.col("external_id")).alias("external_ids"),
        F.create_map(link, F.try_element_at("external_urls", link)).alias("external_urls"), "categories", F.col("image")["url"].alias("image_url"), F.col("language_detected").alias("language"), "episode_count", F.lit(None).cast("double").alias("popularity_score"),
    )


def sample_ids(classified: DataFrame, most: int = 10) -> DataFrame:
    """(category, ids): the first ids of each category in their order; the limit runs before the shuffle."""
    w = Window.partitionBy("category").orderBy("episode_id")
    few = classified.select("category", "episode_id", F.row_number().over(w).alias("r")).where(F.col("r") <= most)
    return few.groupBy("category").agg(F.array_sort(F.collect_list("episode_id")).alias("ids"))
