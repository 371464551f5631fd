"""Queries over cleaning and scoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import cleaning as C
from ..session import table as t
from .scalar_queries import HTML, PARAGRAPHS, SQUEEZE, nfkc_sql


def _paragraphs(s, d):
    return C.paragraph_table(t(s, d, "episodes"), TX.clean_text(F.col("description")))


def boilerplate_flags(s, d):
    p = _paragraphs(s, d).where(F.col("paragraph").isNotNull())
    rules = p.withColumn("rules", C.rules_hit(F.col("paragraph"), F.col("language")))
    return rules.select("episode_id", "n", F.array_join(C.flags_of(F.col("rules")), ",").alias("flags"), F.array_join("rules", ";").alias("rules"))


def paragraph_frequency(s, d):
    return C.frequent(C.paragraph_frequency(_paragraphs(s, d))).select("show_id", "norm", "occurrences", "episodes")


def clean_episode_stats(s, d):
    c = C.clean_episodes(C.judged_paragraphs(_paragraphs(s, d)))
    parts = F.array_join(F.array_sort(F.transform(F.map_entries("removal_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return c.select("episode_id", F.md5("description").alias("description_md5"), "raw_chars", "kept_chars", "paragraphs", "kept_paragraphs", parts.alias("breakdown"))


def corpus_cleaning_stats(s, d):
    return C.corpus_statistics(C.clean_episodes(C.judged_paragraphs(_paragraphs(s, d))))


def removal_breakdown(s, d):
    return C.removal_breakdown(C.clean_episodes(C.judged_paragraphs(_paragraphs(s, d))))


def extraneous_score(s, d):
    p = _paragraphs(s, d).where(F.col("paragraph").isNotNull()).select("episode_id", "n", C.extraneous_score(F.col("paragraph")).alias("x"))
    return p.select("episode_id", "n", F.round("x", 6).alias("score"), (F.round("x", 9) > P.EXTRANEOUS).alias("extraneous"))


def boilerplate_similarity(s, d):
    p = _paragraphs(s, d).where(F.col("paragraph").isNotNull()).select("episode_id", "n", "paragraph").withColumn("pid", F.concat_ws("#", "episode_id", "n"))
    often = C.frequent(C.paragraph_frequency(_paragraphs(s, d)))
    return C.boilerplate_similarity(p, "pid", "paragraph", often, "norm").select("pid", F.round("similarity", 6).alias("similarity"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hit(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_q(P.portable(p))})"


def _count(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, {_q(P.portable(p))}))" for p in patterns) + ")"


def _first(family: str, patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_hit('low', p)} THEN {_q(f'{family}:{p[:30]}')}" for p in patterns) + " END"


def _rules() -> str:
    parts = []
    for f, en in C.EN_FAMILIES.items():
        zh = C.ZH_FAMILIES.get(f)
        parts.append(f"CASE WHEN language = 'zh' THEN {_first(f, zh) if zh else 'NULL'} ELSE {_first(f, en)} END")
    parts.append(f"CASE WHEN {_count('paragraph', [P.URL])} >= 2 AND length(paragraph) < 500 THEN 'url_heavy:>=2_urls' END")
    left = rf"regexp_replace(regexp_replace(paragraph, {_q(P.portable(P.TIMESTAMP))}, '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    parts.append(f"CASE WHEN length({left}) < length(paragraph) * 0.3 THEN 'timestamps:>70%' END")
    parts.append("CASE WHEN length(paragraph) < 50 AND (" + " OR ".join(f"contains(low, {_q(w)})" for w in P.SHORT_CTA) + ") THEN 'short_cta:<50chars' END")
    return "list_filter([" + ", ".join(parts) + "], lambda r: r IS NOT NULL)"


_LANG = "CASE WHEN length(replace(coalesce(x, ''), ' ', '')) = 0 THEN 'unknown' WHEN length(regexp_replace(x, '[^一-鿿]', '', 'g')) / length(replace(x, ' ', '')) > 0.3 THEN 'zh' ELSE 'en' END"
_PAR = f"""
    once AS (SELECT DISTINCT episode_id, show_id, description FROM episodes), raw AS (SELECT episode_id AS id, {HTML.format(x='description')} AS x FROM once), {nfkc_sql('raw')},
    eps AS (SELECT episode_id, show_id, description, {SQUEEZE.format(x='x')} AS x FROM once JOIN composed ON composed.id = once.episode_id),
    par0 AS (SELECT episode_id, show_id, {_LANG} AS language, {PARAGRAPHS.format(x="coalesce(x, '')")} AS ps FROM eps),
    par AS (SELECT episode_id, show_id, language, CAST(unnest(range(len(ps))) AS INTEGER) AS n, unnest(ps) AS paragraph FROM par0)"""
_NORM = r"trim(regexp_replace(regexp_replace(lower(paragraph), '[^\p{L}\p{N}_\s\p{Z}]', '', 'g'), '[\s\p{Z}]+', ' ', 'g'))"
_FREQ = f"""
    normed AS (SELECT *, {_NORM} AS norm FROM par),
    freq AS (SELECT f.show_id, f.norm, f.occurrences, e.episodes FROM (SELECT show_id, norm, count(*) AS occurrences FROM normed WHERE length(norm) > 20 GROUP BY ALL) f
        JOIN (SELECT show_id, count(DISTINCT episode_id) AS episodes FROM eps GROUP BY ALL) e ON e.show_id = f.show_id
        WHERE e.episodes >= 4 AND f.occurrences > e.episodes * 0.25)"""
_JUDGED = f"""
    ruled AS (SELECT *, {_rules()} AS rules0 FROM (SELECT *, lower(paragraph) AS low FROM normed)),
    judged AS (SELECT r.*, CASE WHEN len(r.rules0) = 0 AND f.norm IS NOT NULL THEN ['frequent:>25%_episodes'] ELSE r.rules0 END AS rules
        FROM ruled r LEFT JOIN freq f ON f.show_id = r.show_id AND f.norm = r.norm),
    flagged AS (SELECT *, list_transform(rules, lambda r: split_part(r, ':', 1)) AS flags, len(rules) = 0 AS kept FROM judged),
    broken AS (SELECT episode_id, string_agg(f || '=' || c, ',' ORDER BY f || '=' || c) AS breakdown FROM (
        SELECT episode_id, f, count(*) AS c FROM (SELECT episode_id, unnest(flags) AS f FROM flagged) GROUP BY ALL) GROUP BY episode_id),
    per AS (SELECT e.episode_id, length(coalesce(e.description, '')) AS raw_chars, CAST(coalesce(sum(CASE WHEN f.kept THEN length(f.paragraph) END), 0) AS BIGINT) AS kept_chars, count(f.paragraph) AS paragraphs,
        count(*) FILTER (WHERE f.kept) AS kept_paragraphs, coalesce(string_agg(f.paragraph, chr(10) || chr(10) ORDER BY f.n) FILTER (WHERE f.kept), '') AS description
        FROM eps e LEFT JOIN flagged f ON f.episode_id = e.episode_id GROUP BY e.episode_id, e.description)"""
_UP = lambda x, n: f"least({x}, {n}) / {n}.0"
_SCORE = (
    f"0.0 + {_UP(_count('low', P.SCORE_EN_SPONSOR) + ' + CASE WHEN zh THEN ' + _count('low', P.SCORE_ZH_SPONSOR) + ' ELSE 0 END', 3)} * 0.3::DOUBLE"
    f" + {_UP(_count('low', P.PROMO_CODE), 2)} * 0.25::DOUBLE + {_UP(_count('low', P.EN_CTA) + ' + CASE WHEN zh THEN ' + _count('low', P.ZH_CTA) + ' ELSE 0 END', 3)} * 0.2::DOUBLE"
    f" + least({_count('paragraph', [P.URL])} / (length(paragraph) / 500.0::DOUBLE + 1) / 3.0::DOUBLE, 1.0) * 0.1::DOUBLE + {_UP(_count('low', P.HOSTING), 1)} * 0.15::DOUBLE"
)

SQL = {
    "boilerplate_flags": f"WITH {_PAR} SELECT episode_id, n, array_to_string(list_transform(rules, lambda r: split_part(r, ':', 1)), ',') AS flags, array_to_string(rules, ';') AS rules FROM (SELECT episode_id, n, {_rules()} AS rules FROM (SELECT *, lower(paragraph) AS low FROM par))",
    "paragraph_frequency": f"WITH {_PAR}, {_FREQ} SELECT show_id, norm, occurrences, episodes FROM freq",
    "clean_episode_stats": f"WITH {_PAR}, {_FREQ}, {_JUDGED} SELECT p.episode_id, md5(description) AS description_md5, raw_chars, kept_chars, paragraphs, kept_paragraphs, coalesce(b.breakdown, '') AS breakdown FROM per p LEFT JOIN broken b ON b.episode_id = p.episode_id",
    "corpus_cleaning_stats": f"""WITH {_PAR}, {_FREQ}, {_JUDGED}, s AS (SELECT count(*) AS episodes, count(*) FILTER (WHERE paragraphs > kept_paragraphs) AS episodes_with_cleaning, CAST(sum(paragraphs) AS BIGINT) AS paragraphs,
        CAST(sum(paragraphs - kept_paragraphs) AS BIGINT) AS removed_paragraphs, CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(kept_chars) AS BIGINT) AS kept_chars FROM per)
        SELECT *, round(coalesce(100.0::DOUBLE * removed_paragraphs / nullif(paragraphs, 0), 0), 2) AS removal_rate, round(coalesce(100.0::DOUBLE * (raw_chars - kept_chars) / nullif(raw_chars, 0), 0), 2) AS char_reduction FROM s""",
    "boilerplate_similarity": rf"""WITH {_PAR}, {_FREQ},
        w AS (SELECT pid, len(ws) AS na, unnest(ws) AS w FROM (SELECT episode_id || '#' || n AS pid, list_distinct(list_filter(regexp_split_to_array(lower(paragraph), '[\s\p{{Z}}]+'), lambda y: y <> '')) AS ws FROM par)),
        b AS (SELECT bid, len(ws) AS nb, unnest(ws) AS w FROM (SELECT array_to_string(list_sort(ws), ' ') AS bid, ws FROM (SELECT DISTINCT list_sort(list_distinct(list_filter(regexp_split_to_array(lower(norm), '[\s\p{{Z}}]+'), lambda y: y <> ''))) AS ws FROM freq) WHERE len(ws) > 0)),
        sims AS (SELECT pid, bid, count(*) / (max(na) + max(nb) - count(*)) AS sim FROM w JOIN b ON b.w = w.w GROUP BY pid, bid),
        best AS (SELECT pid, max(sim) AS sim FROM sims GROUP BY pid)
        SELECT p.pid, round(coalesce(best.sim, 0.0), 6) AS similarity FROM (SELECT episode_id || '#' || n AS pid FROM par) p LEFT JOIN best ON best.pid = p.pid""",
}
_ZH = "(length(replace(paragraph, ' ', '')) > 0 AND length(regexp_replace(paragraph, '[^一-鿿]', '', 'g')) / length(replace(paragraph, ' ', '')) > 0.3)"
SQL["extraneous_score"] = f"WITH {_PAR} SELECT episode_id, n, round(x, 6) AS score, round(x, 9) > 0.3 AS extraneous FROM (SELECT episode_id, n, least({_SCORE}, 1.0) AS x FROM (SELECT *, lower(paragraph) AS low, {_ZH} AS zh FROM par))"
SQL["removal_breakdown"] = f"WITH {_PAR}, {_FREQ}, {_JUDGED}, r AS (SELECT f AS reason, count(*) AS paragraphs FROM (SELECT unnest(flags) AS f FROM flagged) GROUP BY f) SELECT reason, paragraphs, round(100.0::DOUBLE * paragraphs / sum(paragraphs) OVER (), 1) AS percent FROM r"
QUERIES = {k: globals()[k] for k in SQL}
