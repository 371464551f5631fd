"""The queries of this package and, where SQL can state one, the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, neighbors, packing, quality, standing_lines, visual_form

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: neighbors.found_neighbors(_t(s, d, "episode_vectors")),
        "p2_found": lambda s, d: standing_lines.found_standing_lines(_t(s, d, "episodes"), _t(s, d, "cleaned_episodes")),
        "p4_found": lambda s, d: language.found_labels(_t(s, d, "shows"), _t(s, d, "raw_shows"), _t(s, d, "episodes"), _t(s, d, "documents")),
        "p4_languages": lambda s, d: language.description_languages(_t(s, d, "episodes"), _t(s, d, "documents")),
        "p5_found": lambda s, d: visual_form.found_lookalikes(_t(s, d, "episodes"), _t(s, d, "query_log"), _t(s, d, "query_catalog")),
        "p5_classes": lambda s, d: visual_form.episode_classes(_t(s, d, "episodes")),
        "p6_found": lambda s, d: packing.found_oversized(_t(s, d, "documents")),
        "p6_bins": lambda s, d: packing.pack_documents(_t(s, d, "documents"), "doc_id", packing.byte_tokens(F.col("text"))).select("doc_id", "part", "tokens"),
        "p6_packing": lambda s, d: packing.packing_report(packing.pack_documents(_t(s, d, "documents"), "doc_id", packing.byte_tokens(F.col("text")))),
        "p7_found": lambda s, d: mixing.found_short(_t(s, d, "documents"), _t(s, d, "mix_targets")),
        "p7_plan": lambda s, d: mixing.mix_report(_t(s, d, "documents"), _t(s, d, "mix_targets")).select("source", "size", "epochs", "short"),
        "p7_mix": lambda s, d: mixing.mix_report(_t(s, d, "documents"), _t(s, d, "mix_targets")).select("source", "budget", "mixed_tokens", "actual_share"),
        "p8_found": lambda s, d: quality.found_not_prose(_t(s, d, "documents"), _t(s, d, "doc_labels")),
    }


_SIZED = "SELECT doc_id, source, strlen(text) + 1 AS size FROM documents WHERE text IS NOT NULL AND text <> ''"
_LETTERS = r"nullif(replace(lower(regexp_replace(regexp_replace(replace(x, '&amp;', ''), '</?[A-Za-z][^<>\n]*>', '', 'g'), '[^\p{L}]+', '', 'g')), 'ß', 'ss'), '')"


def oracle_sql() -> dict[str, str]:
    # The level at which each source would be the first below its cap; the greatest that holds is the water level.
    plan = f"""
        WITH sized AS ({_SIZED}), totals AS (
            SELECT m.source, m.target_share, m.max_repeats, CAST(coalesce(sum(s.size), 0) AS BIGINT) AS size
            FROM mix_targets m LEFT JOIN sized s ON s.source = m.source GROUP BY ALL),
        caps AS (SELECT *, max_repeats * size AS cap, sum(size) OVER () AS total, sum(target_share) OVER () AS shares FROM totals),
        levels AS (SELECT a.source, (any_value(a.total) * any_value(a.shares) - coalesce(sum(b.cap), 0)) / (any_value(a.shares) - coalesce(sum(b.target_share), 0)) AS level, any_value(a.cap / a.target_share) AS ratio
            FROM caps a LEFT JOIN caps b ON b.cap / b.target_share < a.cap / a.target_share OR b.cap / b.target_share = a.cap / a.target_share AND b.source < a.source GROUP BY a.source),
        budgets AS (SELECT *, coalesce(least(target_share * (SELECT max(level) FROM levels WHERE level <= ratio), cap), cap) AS budget FROM caps)
    """
    return {
        "p2_found": f"""
            WITH lines AS (
                SELECT 'description' AS field, show_id, episode_id, unnest(string_split(description, chr(10))) AS x,
                       unnest(range(len(string_split(description, chr(10))))) AS line_no FROM episodes WHERE description IS NOT NULL
                UNION ALL SELECT 'paragraphs', show_id, episode_id, p.text, p."index"
                FROM (SELECT show_id, episode_id, unnest(cleaned.paragraphs) AS p FROM cleaned_episodes)),
            keyed AS (SELECT field, show_id, episode_id, line_no, {_LETTERS} AS key FROM lines),
            docs AS (SELECT 'description' AS field, show_id, count(DISTINCT episode_id) AS n FROM episodes WHERE description IS NOT NULL GROUP BY show_id
                UNION ALL SELECT 'paragraphs', show_id, count(DISTINCT episode_id) FROM cleaned_episodes GROUP BY show_id),
            often AS (SELECT k.field, k.show_id, k.key FROM keyed k JOIN docs d ON d.field = k.field AND d.show_id = k.show_id WHERE k.key IS NOT NULL
                GROUP BY k.field, k.show_id, k.key, d.n HAVING count(DISTINCT k.episode_id) >= 5 AND count(DISTINCT k.episode_id) > 0.2 * d.n)
            SELECT DISTINCT k.field, k.episode_id, CAST(k.line_no AS BIGINT) AS line_no
            FROM keyed k JOIN often o ON o.field = k.field AND o.show_id = k.show_id AND o.key = k.key""",
        "p6_found": f"SELECT DISTINCT doc_id FROM ({_SIZED}) WHERE size > 4096",
        "p6_bins": f"""
            SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(least(4096, size - part * 4096) AS BIGINT) AS tokens
            FROM (SELECT doc_id, size, unnest(range((size + 4095) // 4096)) AS part FROM ({_SIZED}))""",
        "p7_found": plan + "SELECT source FROM budgets WHERE target_share * total > max_repeats * size",
        "p7_plan": plan + """
            SELECT source, size, CAST(CASE WHEN size > 0 THEN least(floor(budget / size), max_repeats) ELSE 0 END AS INTEGER) AS epochs,
                   target_share * total > max_repeats * size AS short FROM budgets""",
    }
