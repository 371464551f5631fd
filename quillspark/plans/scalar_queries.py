"""Queries over scalar expressions and scans, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import text as TX
from ..session import table as t
from ..sources import tables as S

_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize_language(s, d):
    return t(s, d, "raw_shows").select("show_id", X.normalize_language(F.col("language")).alias("language")).distinct()


def parse_duration(s, d):
    return t(s, d, "episodes").select("episode_id", F.coalesce(X.parse_duration(F.col("duration")), F.lit(-1)).alias("duration_sec")).distinct()


def episode_id(s, d):
    return t(s, d, "episodes").select("episode_id", X.episode_id(F.col("show_id"), F.col("guid")).alias("computed_id")).distinct()


def route_index(s, d):
    shows = t(s, d, "shows").withColumn("alias", X.route(F.col("target_index")))
    return shows.groupBy("target_index", "alias", X.target_language(F.col("target_index")).alias("language")).agg(F.count("*").alias("shows"))


def version_clean(s, d):
    v = t(s, d, "episode_vectors").dropDuplicates(["vec_id"]).groupBy("model_name", "embedding_version").count()
    return v.select("model_name", F.col("embedding_version").alias("raw"), X.clean_version(F.col("embedding_version")).alias("clean"), X.cache_slug(F.col("model_name"), X.clean_version(F.col("embedding_version")), F.lit(384)).alias("slug"), F.col("count").alias("vectors"))


def log_timestamps(s, d):
    return t(s, d, "query_log").select("request_id", X.iso_micros(F.col("timestamp")).alias("micros")).distinct()


def embedding_text(s, d):
    return t(s, d, "cleaned_episodes").select("episode_id", X.embedding_text(F.col("cleaned.normalized.title"), F.col("cleaned.paragraphs")).alias("text")).distinct()


def annotation_text(s, d):
    return t(s, d, "episodes").select("episode_id", X.annotation_text(F.col("title"), F.col("description")).alias("text")).distinct()


def perturb_query(s, d):
    return t(s, d, "query_catalog").select("query_id", F.posexplode(X.perturb_query(F.col("query"))).alias("n", "variant"))


def csv_ids(s, d):
    lists = t(s, d, "query_log").groupBy("request_id").agg(F.max(F.concat_ws(" , ", F.col("result_ids"), F.lit(" "))).alias("ids"))
    return lists.select("request_id", F.array_join(X.id_list(F.col("ids")), ";").alias("ids"))


def scan_shows(s, d):
    return S.updated_shows(t(s, d, "shows"), since="2023-09-01", language="en").select("show_id", "title", "author", "updated_at", "language_uncertain")


def incremental_filter(s, d):
    shows = S.updated_shows(t(s, d, "shows"), since="2024-01-01")
    return shows.groupBy("target_index").agg(F.count("*").alias("shows"), F.max("updated_at").alias("next_cursor"))


def json_decode(s, d):
    shows = S.decoded_shows(t(s, d, "shows"))
    return shows.select("show_id", F.col("image")["url"].alias("image_url"), F.array_join("categories", "|").alias("categories"), F.col("external_urls")["apple"].alias("apple_url"))


def html_to_text(s, d):
    return t(s, d, "episodes").where(F.col("description").isNotNull()).select("episode_id", TX.html_text(F.col("description")).alias("text")).distinct()


def normalize_text(s, d):
    return t(s, d, "episodes").where(F.col("description").isNotNull()).select("episode_id", TX.normalize(F.col("description")).alias("text")).distinct()


def split_paragraphs(s, d):
    return t(s, d, "episodes").select("episode_id", F.posexplode(TX.paragraphs(TX.clean_text(F.col("description")))).alias("n", "paragraph")).distinct()


def detect_language(s, d):
    e = t(s, d, "episodes").select("episode_id", TX.script_language(F.col("description")).alias("language")).distinct()
    return e.groupBy("language").agg(F.count("*").alias("episodes"))


def _compatible() -> str:
    """(c, t): the compatibility decomposition of each character that has one, from the Unicode data; canonical ones are left to NFC."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    codes = (c for c in (*range(0xA0, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)) if unicodedata.normalize("NFKD", chr(c)) != unicodedata.normalize("NFD", chr(c)))
    return ", ".join(f"({q(chr(c))}, {q(unicodedata.normalize('NFKD', chr(c)))})" for c in codes)


def nfkc_sql(source: str, name: str = "composed") -> str:
    """CTEs up to `name`(id, x): NFKC of source(id, x), whose id is unique: characters mapped by a join, put together again and composed."""
    return f"""compatible(c, t) AS (VALUES {_compatible()}),
    plain AS (SELECT id, x FROM {source} WHERE x IS NULL OR regexp_full_match(x, '[\\x00-\\x7f]*')),
    chars AS (SELECT id, i, substring(x, i, 1) AS c FROM (SELECT id, x, unnest(range(1, CAST(length(x) + 1 AS INTEGER))) AS i FROM {source} WHERE NOT regexp_full_match(x, '[\\x00-\\x7f]*'))),
    {name} AS (SELECT id, x FROM plain UNION ALL SELECT id, nfc_normalize(string_agg(coalesce(m.t, s.c), '' ORDER BY s.i)) AS x FROM chars s LEFT JOIN compatible m ON m.c = s.c GROUP BY id)"""


HTML = (
    "CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '<|&[#\\w]') THEN {x} ELSE array_to_string(list_filter(regexp_split_to_array("
    "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')"
    ", '<[A-Za-z/!][^>]*>'), lambda n: n <> ''), chr(10)) END"
)
SQUEEZE = "array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x00-\\x09\\x0b-\\x1f\\x7f]', '', 'g'), '[ \\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{0085}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda l: trim(l)), chr(10))"
PARAGRAPHS = "list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
ALIAS = "CASE target_index WHEN 'podcast-episodes-zh-tw' THEN 'episodes-zh-tw' WHEN 'podcast-episodes-zh-cn' THEN 'episodes-zh-cn' WHEN 'podcast-episodes-en' THEN 'episodes-en' END"
NORM_LANG = """CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN lower({x}) LIKE 'en%' THEN 'en' WHEN lower({x}) IN ('zh-hans', 'zh-cn') THEN 'zh-hans'
    WHEN lower({x}) LIKE 'zh%' THEN 'zh-hant' WHEN length(split_part(lower({x}), '-', 1)) = 2 THEN split_part(lower({x}), '-', 1) END"""
DURATION = """(SELECT CASE len(p) WHEN 1 THEN p[1] WHEN 2 THEN p[1] * 60 + p[2] WHEN 3 THEN p[1] * 3600 + p[2] * 60 + p[3] END
    FROM (SELECT list_transform(string_split({x}, ':'), lambda y: CASE WHEN regexp_full_match(trim(y), '[+-]?\\d+') THEN TRY_CAST(trim(y) AS INTEGER) END) AS p))"""

SQL = {
    "normalize_language": f"SELECT DISTINCT show_id, {NORM_LANG.format(x='language')} AS language FROM raw_shows",
    "parse_duration": f"SELECT DISTINCT episode_id, coalesce({DURATION.format(x='duration')}, -1) AS duration_sec FROM episodes",
    "episode_id": "SELECT DISTINCT episode_id, 'episode:apple:' || split_part(show_id, ':', 3) || ':' || substring(md5(coalesce(guid, '')), 1, 8) AS computed_id FROM episodes",
    "route_index": f"SELECT target_index, {ALIAS} AS alias, replace({ALIAS}, 'episodes-', '') AS language, count(*) AS shows FROM shows GROUP BY ALL",
    "version_clean": "SELECT model_name, embedding_version AS raw, split_part(embedding_version, '/', -1) AS clean, replace(model_name, '/', '--') || '__' || split_part(embedding_version, '/', -1) || '__dim384' AS slug, count(DISTINCT vec_id) AS vectors FROM episode_vectors GROUP BY ALL",
    "log_timestamps": "SELECT DISTINCT request_id, epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ)) AS micros FROM query_log",
    "embedding_text": "SELECT DISTINCT episode_id, concat_ws(chr(10) || chr(10), nullif(trim(cleaned.normalized.title), ''), nullif(array_to_string(list_transform(list_filter(cleaned.paragraphs, lambda p: p.kept AND coalesce(p.text, '') <> ''), lambda p: p.text), chr(10) || chr(10)), '')) AS text FROM cleaned_episodes",
    "annotation_text": "SELECT DISTINCT episode_id, CASE WHEN length(x) > 1500 THEN substring(x, 1, 1500) || '...' ELSE x END AS text FROM (SELECT episode_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(description, '') AS x FROM episodes)",
    "perturb_query": """WITH w AS (SELECT query_id, regexp_split_to_array(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM query_catalog)
        SELECT query_id, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN array_to_string(w[2:], ' ') WHEN 1 THEN array_to_string(list_concat(w[1:1], w[3:]), ' ') ELSE array_to_string(list_reverse(w), ' ') END AS variant
        FROM w, range(3) r(n) WHERE len(w) >= 2""",
    "csv_ids": """SELECT request_id, array_to_string(list_transform(list_filter(list_distinct_in_order, lambda x: x <> ''), lambda x: x), ';') AS ids FROM (
        SELECT request_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (SELECT request_id, max(result_ids) AS l FROM query_log GROUP BY request_id))""",
    "scan_shows": "SELECT show_id, title, author, updated_at, CAST(language_uncertain AS BOOLEAN) AS language_uncertain FROM shows WHERE target_index IS NOT NULL AND language_detected = 'en' AND updated_at > '2023-09-01'",
    "incremental_filter": "SELECT target_index, count(*) AS shows, max(updated_at) AS next_cursor FROM shows WHERE target_index IS NOT NULL AND language_detected IS NOT NULL AND updated_at > '2024-01-01' GROUP BY target_index",
    "json_decode": """SELECT show_id, CASE WHEN json_valid(image) AND json_type(image) = 'OBJECT' THEN image ->> '$.url' END AS image_url,
        CASE WHEN json_valid(categories) AND json_type(categories) = 'ARRAY' THEN array_to_string(CAST(json_extract_string(categories, '$[*]') AS VARCHAR[]), '|') ELSE '' END AS categories,
        CASE WHEN json_valid(external_urls) AND json_type(external_urls) = 'OBJECT' THEN external_urls ->> '$.apple' END AS apple_url FROM shows""",
    "html_to_text": f"SELECT DISTINCT episode_id, {HTML.format(x='description')} AS text FROM episodes WHERE description IS NOT NULL",
    "normalize_text": f"WITH raw AS (SELECT DISTINCT episode_id AS id, description AS x FROM episodes WHERE description IS NOT NULL), {nfkc_sql('raw')} SELECT id AS episode_id, {SQUEEZE.format(x='x')} AS text FROM composed",
    "split_paragraphs": f"""WITH raw AS (SELECT DISTINCT episode_id AS id, {HTML.format(x='description')} AS x FROM episodes WHERE description IS NOT NULL), {nfkc_sql('raw')}
        SELECT DISTINCT id AS episode_id, CAST(n AS INTEGER) AS n, p[n + 1] AS paragraph FROM (SELECT id, p, unnest(range(len(p))) AS n FROM (SELECT id, {PARAGRAPHS.format(x=SQUEEZE.format(x='x'))} AS p FROM composed))""",
    "detect_language": """SELECT language, count(*) AS episodes FROM (SELECT DISTINCT episode_id, CASE WHEN length(replace(coalesce(description, ''), ' ', '')) = 0 THEN 'unknown'
        WHEN length(regexp_replace(description, '[^一-鿿]', '', 'g')) / length(replace(description, ' ', '')) > 0.3 THEN 'zh' ELSE 'en' END AS language FROM episodes) GROUP BY language""",
}
QUERIES = {k: globals()[k] for k in SQL}
