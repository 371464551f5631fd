"""Queries over state and documents, with their SQL. The vectors' table is the cache; statuses are derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import state as ST
from ..session import table as t
from ..sources import tables as SO
from .scalar_queries import ALIAS, DURATION, NORM_LANG

IDENTITY = {"model": "waveembed-multi-384", "version": "text-v1", "dims": 384}


def _episodes(s, d):
    return t(s, d, "episodes").select("episode_id", "show_id", "title", "description", "target_index").distinct()


def _shows(s, d):
    return t(s, d, "shows").dropDuplicates(["show_id"])


def _latest(s, d):
    v = t(s, d, "episode_vectors")
    return v.groupBy("episode_id").agg(F.max_by(F.struct("model_name", "embedding_version", "embedded_at"), F.struct("embedded_at", "vec_id")).alias("v"))


def _status(s, d):
    """Statuses: of the latest vector; its model is lost where the hash of the id begins with 0, its time is kept."""
    e = _episodes(s, d).select("episode_id", "show_id").join(_latest(s, d), "episode_id", "left")
    lost = F.substring(F.md5("episode_id"), 1, 1) == "0"
    return e.select("episode_id", "show_id", F.when(F.col("v").isNotNull(), "done").otherwise("pending").alias("embedding_status"), F.when(~lost, F.col("v.model_name")).alias("embedding_model"), F.col("v.embedding_version").alias("embedding_version"), F.date_format("v.embedded_at", "yyyy-MM-dd HH:mm:ss").alias("last_embedded_at"))


def upsert_latest(s, d):
    v = t(s, d, "episode_vectors").select("vec_id", "episode_id", F.unix_micros("embedded_at").alias("at"))
    cut = F.col("at") >= 1725148800000000
    return ST.upsert_latest(v.where(~cut), v.where(cut), ["episode_id"], ["at", "vec_id"]).select("episode_id", "vec_id", "at")


def partial_update(s, d):
    old = t(s, d, "cleaned_episodes").select("episode_id", F.col("cleaned.normalized.title").alias("title"), F.col("cleaned.normalized.description").alias("description"), F.col("cleaning_meta.cleaned_at").alias("created_at")).dropDuplicates(["episode_id"])
    new = _episodes(s, d).select("episode_id", "title", "description", F.lit("2025-06-01").alias("created_at"))
    return ST.partial_update(old, new, "episode_id")


def sync_upsert(s, d):
    key = [F.lit("episode").alias("entity_type"), F.col("episode_id").alias("entity_id"), F.lit("default").alias("environment")]
    old = t(s, d, "cleaned_episodes").select(*key, X.route(F.col("target_index")).alias("index_alias"), F.lit("stale").alias("sync_status"), F.lit("2024-01-01").alias("last_synced_at")).distinct()
    new = _episodes(s, d).where(F.col("target_index").isNotNull()).select(*key, X.route(F.col("target_index")).alias("index_alias"), F.lit("new").alias("sync_status"), F.lit("2025-01-01").alias("last_synced_at"))
    return ST.sync_upsert(old, new).select("entity_id", "index_alias", "sync_status", "last_synced_at")


def status_update(s, d):
    base = _status(s, d).withColumn("embedding_status", F.lit("pending"))
    done = t(s, d, "episode_vectors").where(F.col("embedding").isNotNull())
    return ST.mark_status(base, done, {"embedding_status": F.lit("done"), "last_embedded_at": F.lit("2025-06-01")}).select("episode_id", "embedding_status", "last_embedded_at")


def skip_existing(s, d):
    rows = _episodes(s, d).select("episode_id", F.col("description").alias("text"))
    return ST.skip_existing(rows, t(s, d, "cleaned_episodes"), "episode_id").select("episode_id", "outcome")


def cache_join(s, d):
    r = ST.cache_lookup(_episodes(s, d).select("episode_id", "show_id"), t(s, d, "episode_vectors"), IDENTITY)
    return r.groupBy("show_id").agg(*(F.count_if(F.col("cache_status") == c).alias(c) for c in ("hit", "miss", "mismatch")))


def embed_plan(s, d):
    p = ST.embed_plan(_episodes(s, d).select("episode_id", "show_id", "target_index"), _shows(s, d), t(s, d, "episode_vectors"), IDENTITY)
    return p.select("episode_id", "action", "language")


def identity_drift(s, d):
    return ST.identity_drift(t(s, d, "episode_vectors").dropDuplicates(["vec_id"]), IDENTITY).select("vec_id", "drift", "parse_state")


def _drift(s, d):
    ids = s.createDataFrame([("en", IDENTITY["model"], IDENTITY["version"]), ("zh-tw", IDENTITY["model"], "text-v2"), ("zh-cn", "other-model", IDENTITY["version"])], "language string, model string, version string")
    return ST.episode_drift(_status(s, d), _shows(s, d), ids)


def drift_report(s, d):
    return _drift(s, d).select("episode_id", "show_id", "drift")


def show_impact_topn(s, d):
    return _drift(s, d).where(~F.col("drift").isin("ok", "unresolvable")).groupBy("show_id").agg(F.count("*").alias("episodes")).orderBy(F.desc("episodes"), "show_id").limit(10)


def sync_distribution(s, d):
    return _status(s, d).groupBy("embedding_model", X.clean_version(F.col("embedding_version")).alias("version"), "embedding_status").agg(F.count("*").alias("n"))


def resolve_selection(s, d):
    ids = t(s, d, "click_log").select(F.col("clicked_episode_id").alias("episode_id"))
    r = ST.resolve_selection(ids, _status(s, d), _shows(s, d))
    return r.groupBy("resolved", "language").agg(F.count("*").alias("episodes"), F.countDistinct("show_id").alias("shows"))


def _classified(s, d):
    cache = t(s, d, "episode_vectors").select("show_id", "episode_id", "model_name", "embedding_version", "embedding_dimensions", "embedding", F.lit(True).alias("readable"))
    return ST.backfill_categories(_status(s, d), cache, 384)


def backfill_classify(s, d):
    return _classified(s, d).select("episode_id", "category", "class", "target_status")


def backfill_apply_plan(s, d):
    return ST.backfill_decision(_classified(s, d))


def ingest_document(s, d):
    inputs = _episodes(s, d).select("episode_id", "show_id")
    docs = ST.episode_documents(inputs, t(s, d, "cleaned_episodes"), _shows(s, d)).where(F.col("reject_reason").isNull() | (F.col("reject_reason") != "no_cleaned_episode"))
    return docs.select("episode_id", "title", F.coalesce("duration_sec", F.lit(-1)).alias("duration_sec"), "language", F.col("show.show_title").alias("show_title"), F.col("audio.url").alias("audio_url"), "alias", "reject_reason")


def show_document(s, d):
    docs = ST.show_documents(SO.decoded_shows(_shows(s, d)))
    kv = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")
    return docs.select("show_id", "title", "publisher", "provider", kv("external_ids").alias("external_ids"), kv("external_urls").alias("external_urls"), F.array_join("categories", "|").alias("categories"), "image_url")


def show_commit(s, d):
    """Actions are the vectors that a run would write: one fails if it is not of the expected length."""
    v = t(s, d, "episode_vectors").dropDuplicates(["vec_id"])
    acts = v.select("show_id", (F.col("embedding").isNotNull() & (F.size("embedding") == 384)).alias("ok"), F.lit(True).alias("rebuilt"))
    return ST.show_commits(acts)


_V = "v AS (SELECT DISTINCT ON (vec_id) * FROM episode_vectors)"
_L = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY embedded_at DESC, vec_id DESC) AS r FROM episode_vectors) WHERE r = 1)"
_E = "e AS (SELECT DISTINCT episode_id, show_id, title, description, target_index FROM episodes)"
_ST = f"""{_E}, {_L}, status AS (SELECT e.episode_id, e.show_id, CASE WHEN l.vec_id IS NOT NULL THEN 'done' ELSE 'pending' END AS embedding_status, CASE WHEN substring(md5(e.episode_id), 1, 1) <> '0' THEN l.model_name END AS embedding_model,
    l.embedding_version, strftime(l.embedded_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_embedded_at FROM e LEFT JOIN l ON l.episode_id = e.episode_id)"""
_LANG = lambda c: f"replace(CASE {c} WHEN 'podcast-episodes-zh-tw' THEN 'zh-tw' WHEN 'podcast-episodes-zh-cn' THEN 'zh-cn' WHEN 'podcast-episodes-en' THEN 'en' END, ' ', '')"
_CACHE = "CASE WHEN l.vec_id IS NULL THEN 'miss' WHEN l.model_name = 'waveembed-multi-384' AND split_part(l.embedding_version, '/', -1) = 'text-v1' AND l.embedding_dimensions = 384 AND coalesce(len(l.embedding), -1) = 384 THEN 'hit' ELSE 'mismatch' END"
_DRIFT = f"""{_ST}, ids AS (SELECT * FROM (VALUES ('en', 'waveembed-multi-384', 'text-v1'), ('zh-tw', 'waveembed-multi-384', 'text-v2'), ('zh-cn', 'other-model', 'text-v1')) i(language, model, version)),
    drift AS (SELECT s.*, CASE WHEN i.model IS NULL THEN 'unresolvable' WHEN s.embedding_model <> i.model AND split_part(s.embedding_version, '/', -1) IS DISTINCT FROM i.version THEN 'multiple' WHEN s.embedding_model <> i.model THEN 'model_mismatch'
        WHEN split_part(s.embedding_version, '/', -1) IS DISTINCT FROM i.version THEN 'version_mismatch' ELSE 'ok' END AS drift FROM status s LEFT JOIN shows sh ON sh.show_id = s.show_id LEFT JOIN ids i ON i.language = {_LANG('sh.target_index')} WHERE s.embedding_model IS NOT NULL)"""
_BACK = f"""{_ST}, c AS (SELECT *, split_part(embedding_version, '/', -1) AS ver FROM episode_vectors), files AS (SELECT show_id, model_name, ver, max(embedding_dimensions) AS dims FROM c GROUP BY ALL),
    ent AS (SELECT DISTINCT show_id, model_name, ver, episode_id FROM c WHERE embedding IS NOT NULL),
    cls AS (SELECT s.*, CASE WHEN coalesce(s.embedding_model, '') = '' AND coalesce(s.embedding_version, '') = '' AND coalesce(s.last_embedded_at, '') = '' THEN 'neutral_metadata_absent' WHEN coalesce(s.embedding_model, '') = '' OR coalesce(s.embedding_version, '') = '' THEN 'anomaly_partial_metadata'
        WHEN f.show_id IS NULL THEN 'anomaly_cache_missing' WHEN f.dims IS DISTINCT FROM 384 THEN 'fail_payload_identity_mismatch' WHEN n.episode_id IS NULL THEN 'fail_episode_entry_missing' ELSE 'pass' END AS category
        FROM status s LEFT JOIN files f ON f.show_id = s.show_id AND f.model_name = s.embedding_model AND f.ver = split_part(s.embedding_version, '/', -1)
        LEFT JOIN ent n ON n.show_id = s.show_id AND n.model_name = s.embedding_model AND n.ver = split_part(s.embedding_version, '/', -1) AND n.episode_id = s.episode_id),
    cl2 AS (SELECT *, CASE WHEN category IN ('pass', 'neutral_metadata_absent') THEN 'normal' WHEN category LIKE 'anomaly%' THEN 'anomaly' ELSE 'hard_fail' END AS class, CASE WHEN category = 'pass' THEN 'done' WHEN category LIKE 'fail%' THEN NULL ELSE 'pending' END AS target_status FROM cls)"""

SQL = {
    "upsert_latest": "SELECT episode_id, vec_id, epoch_us(embedded_at) AS at FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY embedded_at DESC, vec_id DESC) AS r FROM episode_vectors) WHERE r = 1",
    "partial_update": f"WITH {_E}, o AS (SELECT DISTINCT ON (episode_id) episode_id, cleaned.normalized.title AS title, cleaned.normalized.description AS description, cleaning_meta.cleaned_at AS created_at FROM cleaned_episodes) SELECT coalesce(e.episode_id, o.episode_id) AS episode_id, coalesce(e.title, o.title) AS title, coalesce(e.description, o.description) AS description, coalesce(o.created_at, CASE WHEN e.episode_id IS NOT NULL THEN '2025-06-01' END) AS created_at FROM e FULL JOIN o ON o.episode_id = e.episode_id",
    "sync_upsert": f"""WITH {_E}, o AS (SELECT DISTINCT episode_id, {ALIAS} AS index_alias FROM cleaned_episodes), n AS (SELECT episode_id, {ALIAS} AS index_alias FROM e WHERE target_index IS NOT NULL)
        SELECT episode_id AS entity_id, index_alias, 'synced' AS sync_status, '2025-01-01' AS last_synced_at FROM n UNION ALL SELECT episode_id, index_alias, 'stale', '2024-01-01' FROM o WHERE episode_id NOT IN (SELECT episode_id FROM n)""",
    "status_update": f"WITH {_ST}, d AS (SELECT DISTINCT episode_id FROM episode_vectors WHERE embedding IS NOT NULL) SELECT s.episode_id, CASE WHEN d.episode_id IS NOT NULL THEN 'done' ELSE 'pending' END AS embedding_status, CASE WHEN d.episode_id IS NOT NULL THEN '2025-06-01' ELSE s.last_embedded_at END AS last_embedded_at FROM status s LEFT JOIN d ON d.episode_id = s.episode_id",
    "skip_existing": f"WITH {_E} SELECT episode_id, CASE WHEN episode_id IN (SELECT episode_id FROM cleaned_episodes) THEN 'skipped' WHEN trim(coalesce(description, '')) = '' THEN 'filtered' ELSE 'written' END AS outcome FROM e",
    "cache_join": f"WITH {_E}, {_L}, x AS (SELECT e.show_id, {_CACHE} AS c FROM e LEFT JOIN l ON l.episode_id = e.episode_id) SELECT show_id, count(*) FILTER (WHERE c = 'hit') AS hit, count(*) FILTER (WHERE c = 'miss') AS miss, count(*) FILTER (WHERE c = 'mismatch') AS mismatch FROM x GROUP BY show_id",
    "embed_plan": f"WITH {_E}, {_L} SELECT e.episode_id, CASE WHEN s.target_index IS NULL THEN 'excluded' WHEN {_CACHE} = 'hit' THEN 'skipped' ELSE 'embed' END AS action, coalesce({_LANG('s.target_index')}, {_LANG('e.target_index')}) AS language FROM e LEFT JOIN shows s ON s.show_id = e.show_id LEFT JOIN l ON l.episode_id = e.episode_id",
    "identity_drift": f"""WITH {_V}, k AS (SELECT *, list_filter([CASE WHEN model_name IS DISTINCT FROM 'waveembed-multi-384' THEN 'model_mismatch' END, CASE WHEN embedding_version IS DISTINCT FROM 'text-v1' THEN 'version_mismatch' END, CASE WHEN embedding_dimensions IS DISTINCT FROM 384 THEN 'dimension_mismatch' END, CASE WHEN len(embedding) <> embedding_dimensions THEN 'vector_length_mismatch' END], lambda z: z IS NOT NULL) AS ks FROM v)
        SELECT vec_id, CASE WHEN len(ks) = 1 THEN ks[1] WHEN len(ks) > 1 THEN 'multiple' END AS drift, CASE WHEN model_name IS NULL THEN 'missing_model' WHEN embedding_version IS NULL THEN 'missing_version' WHEN embedding_dimensions IS NULL THEN 'missing_dims' WHEN embedding IS NULL THEN 'empty_episodes' ELSE 'ok' END AS parse_state FROM k""",
    "drift_report": f"WITH {_DRIFT} SELECT episode_id, show_id, drift FROM drift",
    "show_impact_topn": f"WITH {_DRIFT} SELECT show_id, count(*) AS episodes FROM drift WHERE drift NOT IN ('ok', 'unresolvable') GROUP BY show_id ORDER BY episodes DESC, show_id LIMIT 10",
    "sync_distribution": f"WITH {_ST} SELECT embedding_model, split_part(embedding_version, '/', -1) AS version, embedding_status, count(*) AS n FROM status GROUP BY ALL",
    "resolve_selection": f"WITH {_E}, ids AS (SELECT DISTINCT clicked_episode_id AS episode_id FROM click_log), r AS (SELECT i.episode_id, e.show_id, {_LANG('s.target_index')} AS language FROM ids i LEFT JOIN e ON e.episode_id = i.episode_id LEFT JOIN shows s ON s.show_id = e.show_id) SELECT language IS NOT NULL AS resolved, language, count(*) AS episodes, count(DISTINCT show_id) AS shows FROM r GROUP BY ALL",
    "backfill_classify": f"WITH {_BACK} SELECT episode_id, category, class, target_status FROM cl2",
    "backfill_apply_plan": f"""WITH {_BACK}, s AS (SELECT count(*) AS episodes, count(*) FILTER (WHERE class = 'normal') AS normal, count(*) FILTER (WHERE class = 'anomaly') AS anomaly, count(*) FILTER (WHERE class = 'hard_fail') AS hard_fail,
        round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE category = 'anomaly_cache_missing') / nullif(count(*) FILTER (WHERE category NOT IN ('neutral_metadata_absent', 'anomaly_partial_metadata')), 0), 0.0), 4) AS missing_percent FROM cl2)
        SELECT *, CASE WHEN hard_fail > 0 THEN 'blocked_hard' WHEN missing_percent > 10 THEN 'blocked_anomaly' ELSE 'apply' END AS decision FROM s""",
    "ingest_document": f"""WITH c AS (SELECT DISTINCT ON (episode_id) * FROM cleaned_episodes), x AS (SELECT c.episode_id, cleaned.normalized.title AS title, original_meta.duration AS dur, original_meta.language AS l, original_meta.audio_url AS audio_url, s.title AS show_title, coalesce(nullif(c.target_index, ''), nullif(s.target_index, '')) AS target_index
        FROM c JOIN (SELECT DISTINCT episode_id, show_id FROM episodes) e ON e.episode_id = c.episode_id LEFT JOIN shows s ON s.show_id = e.show_id)
        SELECT episode_id, title, coalesce({DURATION.format(x='dur')}, -1) AS duration_sec, {NORM_LANG.format(x='l')} AS language, show_title, audio_url, {ALIAS} AS alias, CASE WHEN target_index IS NULL THEN 'no_target' WHEN {ALIAS} IS NULL THEN 'unknown_target' END AS reject_reason FROM x""",
    "show_document": """SELECT show_id, title, author AS publisher, coalesce(provider, 'apple_podcasts') AS provider, coalesce(provider, 'apple_podcasts') || '=' || coalesce(external_id, '') AS external_ids,
        CASE WHEN coalesce(provider, 'apple_podcasts') = 'apple' THEN 'apple_podcasts' ELSE coalesce(provider, 'apple_podcasts') END || '=' || coalesce(CASE WHEN json_valid(external_urls) AND json_type(external_urls) = 'OBJECT' THEN json_extract_string(external_urls, CASE WHEN coalesce(provider, 'apple_podcasts') = 'apple' THEN '$.apple_podcasts' ELSE '$."' || coalesce(provider, 'apple_podcasts') || '"' END) END, '') AS external_urls,
        CASE WHEN json_valid(categories) AND json_type(categories) = 'ARRAY' THEN array_to_string(CAST(json_extract_string(categories, '$[*]') AS VARCHAR[]), '|') ELSE '' END AS categories, CASE WHEN json_valid(image) AND json_type(image) = 'OBJECT' THEN image ->> '$.url' END AS image_url FROM shows""",
    "show_commit": f"WITH {_V}, a AS (SELECT show_id, coalesce(len(embedding) = 384, false) AS ok FROM v) SELECT show_id, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE NOT ok) = 0 AND count(*) FILTER (WHERE ok) > 0 AS committed FROM a GROUP BY show_id",
}
QUERIES = {k: globals()[k] for k in SQL}
