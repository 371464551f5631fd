"""Queries over evaluation, logs and gates, with their SQL.

The logged result lists are the rankings and the clicks their judgments: relevance 3 for a click within 5 seconds, 2 within
20, else 1. A request counts once, however often its row was logged.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import text as TX
from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import search as R
from ..operators.timestamps import utc_micros
from ..session import cut_lineage
from ..session import table as t
from . import cleaning_queries as CQ
from . import search_queries as S


def logged(s, d):
    """Requests, each once, with the time of the query in microseconds."""
    q = t(s, d, "query_log").dropDuplicates(["request_id"])
    return q.withColumn("q_micros", X.iso_micros(F.col("timestamp")))


def ranked(s, d):
    q = logged(s, d).select(F.col("request_id").alias("query_id"), F.col("mode").alias("method"), F.coalesce("query_lang", F.lit("none")).alias("language"), F.when(F.col("is_cross_lang"), "cross").otherwise("same").alias("category"), F.posexplode("result_ids").alias("pos", "doc_id"))
    return q.select("*", (F.col("pos") + 1).alias("rank")).drop("pos").withColumn("show_id", F.concat(F.lit("show:apple:"), F.split_part("doc_id", F.lit(":"), F.lit(3))))


def judgments(s, d):
    c = t(s, d, "click_log")
    rel = F.when(F.col("time_to_click_sec") < 5, 3).when(F.col("time_to_click_sec") < 20, 2).otherwise(1)
    return c.select(F.col("request_id").alias("query_id"), F.col("clicked_episode_id").alias("doc_id"), rel.alias("relevance"))


KEYS = ["query_id", "method", "language", "category"]


def _per_query(s, d):
    return E.ranking_metrics(ranked(s, d), judgments(s, d), KEYS)


def ndcg_mrr(s, d):
    return _per_query(s, d).select("query_id", "method", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


def ndcg_grouped(s, d):
    return E.grouped_means(_per_query(s, d)).select("method", "language", "category", "queries", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


def bootstrap_ci(s, d):
    return E.bootstrap(_per_query(s, d), ["method"], "ndcg", ["query_id"])


def topk_overlap(s, d):
    return E.overlap(S.lexical(s, d, 10), S.semantic(s, d, 10)).select("query_id", F.round("jaccard", 6).alias("jaccard"))


def dominance(s, d):
    return E.dominance(ranked(s, d), ["query_id"]).select("query_id", F.round("dominance", 6).alias("dominance"), "show")


def _extraneous(s, d):
    c = S.corpus(s, d)
    return c.select("doc_id", (F.round(C.extraneous_score(F.col("description")), 9) > 0.3).alias("extraneous"))


def intrusion(s, d):
    return E.intrusion(ranked(s, d), _extraneous(s, d), ["query_id"]).select("query_id", F.round("intrusion", 6).alias("intrusion"))


def _stability(s, d):
    base = cut_lineage(S.seeds(s, d))  # read for the lists, their variants and the result
    variants = base.select("query_id", F.posexplode(X.perturb_query(F.col("query"))).alias("n", "query"))
    asked = base.select(F.concat(F.col("query_id"), F.lit("|base")).alias("query_id"), "query").unionByName(variants.select(F.concat_ws("|", "query_id", F.col("n").cast("string")).alias("query_id"), "query"))
    lists = E.result_sets(R.bm25(asked, S.corpus_in_place(s, d), 10))
    lists = lists.withColumn("seed", F.substring_index("query_id", "|", 1)).withColumn("variant", F.substring_index("query_id", "|", -1))
    kept = lists.where("variant = 'base'").select("seed", F.col("ids").alias("own"))
    each = asked.where(~F.endswith("query_id", F.lit("|base"))).select("query_id", F.substring_index("query_id", "|", 1).alias("seed")).join(lists.select("query_id", "ids"), "query_id", "left").join(kept, "seed", "left")
    none = F.array().cast("array<string>")
    scored = each.groupBy("seed").agg(F.avg(X.jaccard(F.coalesce("own", none), F.coalesce("ids", none))).alias("stability"))
    return base.select(F.col("query_id").alias("seed")).join(scored, "seed", "left").select(F.col("seed").alias("query_id"), F.coalesce("stability", F.lit(1.0)).alias("stability"))


def stability(s, d):
    return _stability(s, d).select("query_id", F.round("stability", 6).alias("stability"))


def no_annotation_summary(s, d):
    a = E.dominance(ranked(s, d), ["query_id"]).agg(F.avg("dominance").alias("dominance"))
    b = E.intrusion(ranked(s, d), _extraneous(s, d), ["query_id"]).agg(F.avg("intrusion").alias("intrusion"))
    rows = a.join(F.broadcast(b)).join(F.broadcast(_stability(s, d).agg(F.avg("stability").alias("stability"))))  # one row each
    clean, diverse, stable = F.col("intrusion") < 0.1, F.col("dominance") < 0.5, F.col("stability") > 0.7
    return rows.select(F.round("dominance", 4).alias("dominance"), F.round("intrusion", 4).alias("intrusion"), F.round("stability", 4).alias("stability"), (clean & diverse & stable).alias("passed"))


def _lists(s, d):
    """The lexical and the semantic lists, each made once for all that read them, as both are cut tables."""
    return S.lexical(s, d), S.semantic(s, d)


def method_comparison(s, d):
    lex, sem = _lists(s, d)
    m = E.method_comparison(lex, sem, R.hybrid(lex, sem, S.corpus(s, d)))
    return m.withColumns({c: F.round(c, 4) for c in ("bm25_knn", "bm25_hybrid", "knn_hybrid")})


def overlap_averages(s, d):
    lex, sem = _lists(s, d)
    a = E.overlap_averages(E.method_comparison(lex, sem, R.hybrid(lex, sem, S.corpus(s, d))))
    return a.select(*(F.round(c, 6).alias(c) if c.startswith("avg_") else c for c in a.columns))


def method_metrics(s, d):
    """The three methods, run, against judgments: a document of the query's own show is relevant, more so if its title shares a word."""
    lex, sem = _lists(s, d)
    runs = {"bm25": lex, "knn": sem, "hybrid": R.hybrid(lex, sem, S.corpus(s, d))}
    ranked = None
    for name, found in runs.items():
        part = found.where(F.col("rank") <= 10).select(F.col("query_id"), F.lit(name).alias("method"), "doc_id", "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    show = lambda c: F.split_part(c, F.lit(":"), F.lit(3))
    pairs = ranked.select("query_id", "doc_id").distinct()
    titles = S.corpus(s, d).select("doc_id", F.array_distinct(X.tokens(F.col("title"))).alias("w"))
    judged = pairs.join(titles, "doc_id").join(titles.select(F.col("doc_id").alias("query_id"), F.col("w").alias("q")), "query_id")
    label = F.when(show(F.col("query_id")) == show(F.col("doc_id")), F.when(F.arrays_overlap("w", "q"), 3).otherwise(2)).otherwise(0)
    m = E.ranking_metrics(ranked, judged.select("query_id", "doc_id", label.alias("relevance")), ["query_id", "method"])
    return m.groupBy("method").agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("mrr"), 4).alias("mrr"))


def annotation_pool(s, d):
    lex, sem = _lists(s, d)
    top = lambda x: x.where(F.col("rank") <= 10)
    pool = E.annotation_pool(("bm25", top(lex)), ("embedding", top(sem)), ("hybrid", R.hybrid(lex, sem, S.corpus(s, d))))
    ranks = F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return pool.select("query_id", "doc_id", F.array_join("sources", ",").alias("sources"), ranks.alias("ranks"))


def _scored(s, d):
    """Word overlap of a query with its logged results stands in for a model that scores pairs."""
    q = logged(s, d).where(F.col("query").isNotNull()).select("query", F.explode("result_ids").alias("doc_id")).distinct()
    words = S.corpus(s, d).select("doc_id", F.array_distinct(X.tokens(F.concat_ws(" ", "title", "description"))).alias("w"))
    asked = F.array_distinct(X.tokens(F.col("query")))
    return q.join(words, "doc_id").select(F.col("query").alias("query_id"), "doc_id", F.round(F.size(F.array_intersect(asked, F.col("w"))) / F.greatest(F.size(asked), F.lit(1)) + F.size("w") / (F.size("w") + 1000.0) / 1000.0, 6).alias("score"))


def labels_percentile(s, d):
    return E.percentile_labels(_scored(s, d)).select("query_id", "doc_id", "score", "label")


def labels_small_pool(s, d):
    rows = _scored(s, d)
    small = rows.groupBy("query_id").count().where("count < 10").select("query_id")
    return E.percentile_labels(rows.join(small, "query_id", "left_semi")).select("query_id", "doc_id", "label")


def judgment_stats(s, d):
    j = E.judgment_statistics(E.percentile_labels(_scored(s, d)))
    return j.withColumns({c: F.round(c, 6) for c in ("least", "most", "mean", "std", "mean_variance")})


def incremental_annotation(s, d):
    """Pairs that were judged stay as they are; only new pairs are labelled, among themselves."""
    rows = _scored(s, d)
    old = rows.where(F.substring(F.md5(F.concat("query_id", "doc_id")), 1, 1) < "6").select("query_id", "doc_id")
    new = E.percentile_labels(rows.join(old, ["query_id", "doc_id"], "left_anti"))
    kept = old.join(E.percentile_labels(rows.join(old, ["query_id", "doc_id"], "left_semi")), ["query_id", "doc_id"])
    both = kept.select("query_id", "doc_id", "label", F.lit("kept").alias("origin")).unionByName(new.select("query_id", "doc_id", "label", F.lit("new").alias("origin")))
    return both.select("query_id", "doc_id", "origin", "label")


def clicks(s, d):
    """Clicks with their time in microseconds, a click once, whatever the form in which its time was written."""
    c = t(s, d, "click_log").dropDuplicates(["request_id", "clicked_rank"])
    return c.withColumn("c_micros", utc_micros(F.col("timestamp")))


def search_success_rate(s, d):
    q = logged(s, d)
    hits = E.valid_clicks(q, clicks(s, d)).select("request_id").distinct().withColumn("hit", F.lit(1))
    return q.join(hits, "request_id", "left").groupBy("mode").agg(F.count("*").alias("queries"), F.count("hit").alias("successful"), F.round(F.count("hit") / F.count("*"), 4).alias("rate"))


def same_language_clicks(s, d):
    lang = logged(s, d).select("request_id", "query_lang")
    c = clicks(s, d).join(lang, "request_id", "left")
    same = F.coalesce(F.col("clicked_language") == F.coalesce("query_lang", F.lit("")), F.lit(False))
    return c.groupBy("selected_lang").agg(F.count("*").alias("clicks"), F.count_if(same).alias("same"), F.round(F.count_if(same) / F.count("*"), 4).alias("rate"))


def first_click_rank(s, d):
    first = E.first_click_ranks(E.valid_clicks(logged(s, d), clicks(s, d)))
    return first.agg(F.count("*").alias("requests"), F.round(F.coalesce(F.avg("clicked_rank"), F.lit(0.0)), 2).alias("mean_rank"))


def reformulation_rate(s, d):
    r = E.reformulations(logged(s, d).select("request_id", "query", "q_micros"))
    return r.agg(F.count("*").alias("queries"), F.count_if("reformulated").alias("reformulations"), F.round(F.count_if("reformulated") / F.count("*"), 4).alias("rate"))


def session_gap(s, d):
    r = E.reformulations(logged(s, d).select("request_id", "query", "q_micros"))
    return r.select("request_id", F.coalesce("gap_micros", F.lit(-1)).alias("gap_micros"), F.coalesce(F.col("gap_micros") <= E.SESSION_SECONDS * 1_000_000, F.lit(False)).alias("same_session"))


def regression_gate(s, d):
    means = _per_query(s, d).groupBy("language", "method").agg(F.avg("ndcg").alias("ndcg"))
    g = E.regression_gate(E.best_method(means, ["language"]))
    return g.select("language", "method", F.round("ndcg", 6).alias("ndcg"), "gate", "status")


def _routes(s, d):
    e = t(s, d, "episodes").select("episode_id", "description", "target_index").distinct()
    lang = X.target_language(F.col("target_index"))
    truth = F.when(TX.script_language(F.col("description")) == "zh", "zh").otherwise(F.when(F.col("description").isNotNull(), F.lit("other")))
    return e.select(truth.alias("truth"), F.when(lang.startswith("zh"), "zh").otherwise(F.when(lang.isNotNull(), F.lit("other"))).alias("predicted"))


def routing_confusion(s, d):
    c = E.confusion(_routes(s, d), ("zh", "other"))
    return c.select("truth", "n", "correct", "predicted_n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def routing_gates(s, d):
    g = E.routing_gates(E.confusion(_routes(s, d), ("zh", "other")))
    return g.select("truth", F.round("confusion", 6).alias("confusion"), "precision_gate", "recall_gate", "confusion_gate")


def latency_percentiles(s, d):
    return E.latency_statistics(logged(s, d).withColumn("language", F.coalesce("query_lang", F.lit("none"))), ["language", "mode"])


def latency_gate(s, d):
    q = logged(s, d).withColumn("language", F.coalesce("query_lang", F.lit("none"))).withColumn("late", F.col("timestamp") >= "2024-05-01")
    now, then = (E.latency_statistics(q.where(x), ["language", "mode"]) for x in (F.col("late"), ~F.col("late")))
    return E.latency_gate(now, then, ["language", "mode"])


def suite_status(s, d):
    a = regression_gate(s, d).select("status")
    return E.suite_status(a.unionByName(latency_gate(s, d).select("status")))


def weekly_delta(s, d):
    week = F.when(F.col("timestamp") >= "2024-05-01", "current").otherwise("previous")
    when = logged(s, d).select(F.col("request_id").alias("query_id"), week.alias("week"), "query").where(F.col("query").isNotNull())
    per = _per_query(s, d).join(when, "query_id").groupBy("week", "query").agg(F.avg("ndcg").alias("ndcg"))
    return E.deltas(per.where("week = 'current'"), per.where("week = 'previous'"), ["query"], "ndcg").select("query", F.round("ndcg", 6).alias("ndcg"), F.round("before", 6).alias("before"), "delta", "kind")


_Q = "q AS (SELECT DISTINCT ON (request_id) *, epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ)) AS q_micros FROM query_log)"
_RANKED = f"""{_Q}, ranked AS (SELECT *, 'show:apple:' || split_part(doc_id, ':', 3) AS show_id FROM (SELECT request_id AS query_id, mode AS method, coalesce(query_lang, 'none') AS language, CASE WHEN is_cross_lang THEN 'cross' ELSE 'same' END AS category,
        unnest(result_ids) AS doc_id, unnest(range(1, len(result_ids) + 1)) AS rank FROM q)),
    judg AS (SELECT request_id AS query_id, clicked_episode_id AS doc_id, max(CASE WHEN time_to_click_sec < 5 THEN 3 WHEN time_to_click_sec < 20 THEN 2 ELSE 1 END) AS rel FROM click_log GROUP BY ALL),
    rel AS (SELECT r.*, coalesce(j.rel, 0) AS rel, row_number() OVER (PARTITION BY r.query_id, r.method, r.language, r.category ORDER BY coalesce(j.rel, 0) DESC, r.rank) AS ideal FROM ranked r LEFT JOIN judg j ON j.query_id = r.query_id AND j.doc_id = r.doc_id WHERE r.rank <= 10),
    perq AS (SELECT query_id, method, language, category, CASE WHEN sum(rel) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)) ELSE 0.0 END AS ndcg, coalesce(1.0::DOUBLE / min(CASE WHEN rel >= 2 THEN rank END), 0.0) AS mrr FROM rel GROUP BY ALL)"""
# The forms of click times: Unix time in s, ms or us, ISO forms with any zone or none (UTC), month first with AM or PM, RFC 2822.
_PARTS = "regexp_extract(v, '^(\\d{4})-?(\\d{2})-?(\\d{2})[T ](\\d{2}):?(\\d{2}):?(\\d{2})(?:[.,](\\d{1,6})\\d*)? ?(.*)$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])"
_ZONE = "CASE WHEN p.z IN ('', 'Z', 'UTC', '[UTC]') THEN '+00' WHEN regexp_full_match(p.z, '[+-]\\d{2}:?\\d{2}') THEN left(p.z, 3) || ':' || right(p.z, 2) ELSE ' ' || trim(p.z, '[]') END"
_INSTANT = f"""CASE WHEN regexp_full_match(v, '\\d{{10}}') THEN CAST(v AS BIGINT) * 1000000 WHEN regexp_full_match(v, '\\d{{13}}') THEN CAST(v AS BIGINT) * 1000 WHEN regexp_full_match(v, '\\d{{16}}') THEN CAST(v AS BIGINT)
    WHEN regexp_full_match(v, '\\d{{10}}\\.\\d+') THEN CAST(left(v, 10) AS BIGINT) * 1000000 + CAST(rpad(substring(v, 12, 6), 6, '0') AS BIGINT)
    WHEN p.y <> '' THEN epoch_us(TRY_CAST(p.y || '-' || p.mo || '-' || p.d || ' ' || p.h || ':' || p.mi || ':' || p.s || '.' || rpad(p.f, 6, '0') || {_ZONE} AS TIMESTAMPTZ))
    ELSE coalesce(epoch_us(try_strptime(v, '%a, %d %b %Y %H:%M:%S %z')), epoch_us(try_strptime(v, '%m/%d/%Y %I:%M %p'))) END"""
_CLICKS = f"c AS (SELECT DISTINCT ON (request_id, clicked_rank) *, {_INSTANT} AS c_micros FROM (SELECT *, {_PARTS} AS p FROM (SELECT *, trim(replace(timestamp, chr(9), ' ')) AS v FROM click_log)))"
_VALID = f"{_Q}, {_CLICKS}, valid AS (SELECT c.*, q.mode FROM c JOIN q ON q.request_id = c.request_id WHERE coalesce(c.c_micros, 0) - coalesce(q.q_micros, 0) BETWEEN 0 AND 30000000)"
_GAPS = f"{_Q}, gaps AS (SELECT request_id, query, q_micros - lag(q_micros) OVER w AS gap, lag(query) OVER w AS before, lag(q_micros) OVER w IS NULL AS is_first FROM q WINDOW w AS (ORDER BY q_micros, request_id))"
_LAT = """SELECT coalesce(query_lang, 'none') AS language, mode, count(*) AS n, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 2) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms,
    round(quantile_cont(latency_ms, 0.95), 2) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 2) AS p99_ms, round(coalesce(stddev_samp(latency_ms), 0.0), 2) AS std_ms FROM q"""
_GATE = f"""cur AS ({_LAT} WHERE timestamp >= '2024-05-01' GROUP BY ALL), prev AS ({_LAT} WHERE NOT timestamp >= '2024-05-01' GROUP BY ALL),
    lgate AS (SELECT c.language, c.mode, c.p99_ms, round(p.p99_ms * 1.5, 1) AS bound_ms, CASE WHEN p.p99_ms IS NULL THEN 'SKIP' WHEN c.p99_ms <= round(p.p99_ms * 1.5, 1) THEN 'PASS' ELSE 'FAIL' END AS status FROM cur c LEFT JOIN prev p ON p.language = c.language AND p.mode = c.mode)"""
_RGATE = """mm AS (SELECT language, method, avg(ndcg) AS ndcg FROM perq GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY round(ndcg, 9) DESC, list_position(['bm25', 'knn', 'hybrid', 'exact'], method)) AS r FROM mm) WHERE r = 1),
    rgate AS (SELECT g.language, b.method, b.ndcg, g.gate, CASE WHEN b.ndcg IS NULL THEN 'SKIP' WHEN round(b.ndcg, 4) >= g.gate THEN 'PASS' ELSE 'FAIL' END AS status
        FROM (VALUES ('zh-tw', 0.897::DOUBLE), ('zh-cn', 0.897::DOUBLE), ('en', 0.853::DOUBLE)) g(language, gate) LEFT JOIN best b ON b.language = g.language)"""
_SETS = """bids AS (SELECT query_id, list(doc_id ORDER BY rank) AS b FROM lex WHERE rank <= 10 GROUP BY ALL), vids AS (SELECT query_id, list(doc_id ORDER BY rank) AS v FROM sem WHERE rank <= 10 GROUP BY ALL)"""
_JAC = lambda a, b: f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"
_MINUS = lambda a, b: f"list_filter({a}, lambda z: NOT list_contains({b}, z))"
_SCORED = f"""docs AS (SELECT DISTINCT episode_id AS doc_id, title, description FROM episodes), w AS (SELECT doc_id, list_distinct({S.TOK.format(x="concat_ws(' ', title, description)")}) AS w FROM docs),
    asked AS (SELECT p.query, p.doc_id, list_distinct({S.TOK.format(x="p.query")}) AS a, w.w FROM (SELECT DISTINCT query, unnest(result_ids) AS doc_id FROM query_log WHERE query IS NOT NULL) p JOIN w ON w.doc_id = p.doc_id),
    scored AS (SELECT query AS query_id, doc_id, round(len(list_intersect(a, w)) / greatest(len(a), 1) + len(w) / (len(w) + 1000.0::DOUBLE) / 1000.0::DOUBLE, 6) AS score FROM asked)"""


def _labels(source: str, name: str) -> str:
    """CTE of the labels within the pools of `source`."""
    return f"""{name} AS (SELECT s.query_id, s.doc_id, s.score, p.n, CAST(CASE WHEN p.n < 10 THEN CASE WHEN r <= 1 THEN 3 WHEN r <= 3 THEN 2 WHEN r <= 6 THEN 1 ELSE 0 END
        WHEN score >= p80 THEN 3 WHEN score >= p50 THEN 2 WHEN score >= p20 THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM {source}) s
        JOIN (SELECT query_id, count(*) AS n, quantile_cont(score, 0.8) AS p80, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.2) AS p20 FROM {source} GROUP BY query_id) p ON p.query_id = s.query_id)"""


_OLD = "substring(md5(query_id || doc_id), 1, 1) < '6'"
_DOM = "n AS (SELECT query_id, show_id, count(*) AS n, min(rank) AS f FROM ranked WHERE rank <= 10 GROUP BY ALL), dom AS (SELECT query_id, n / 10 AS dominance, show_id AS show FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS r FROM n) WHERE r = 1)"
_ZH = "(length(replace(paragraph, ' ', '')) > 0 AND length(regexp_replace(paragraph, '[^一-鿿]', '', 'g')) / length(replace(paragraph, ' ', '')) > 0.3)"
_INTR = f"""bad AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, least({CQ._SCORE}, 1.0) AS x FROM (SELECT *, lower(paragraph) AS low, {_ZH} AS zh FROM (SELECT DISTINCT episode_id AS doc_id, description AS paragraph FROM episodes WHERE trim(coalesce(description, '')) <> ''))) WHERE round(x, 9) > 0.3),
    intr AS (SELECT r.query_id, count(b.doc_id) / 10 AS intrusion FROM ranked r LEFT JOIN bad b ON b.doc_id = r.doc_id WHERE r.rank <= 10 GROUP BY ALL)"""
_STAB = f"""{S._C}, {S._V}, base AS (SELECT v.doc_id AS query_id, c.title AS query FROM vecs v JOIN docs c ON c.doc_id = v.doc_id WHERE v.vec_id % 100 = 0),
    bw AS (SELECT query_id, regexp_split_to_array(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM base),
    vars AS (SELECT query_id AS seed, query_id || '|' || n AS query_id, CASE n WHEN 0 THEN array_to_string(w[2:], ' ') WHEN 1 THEN array_to_string(list_concat(w[1:1], w[3:]), ' ') ELSE array_to_string(list_reverse(w), ' ') END AS query FROM bw, range(3) r(n) WHERE len(w) >= 2),
    qs AS (SELECT query_id || '|base' AS query_id, query FROM base UNION ALL SELECT query_id, query FROM vars), {S._scores()}, {S._PHRASE}, {S._top(S._PROD, 10, 'hits')},
    sets AS (SELECT query_id, list(doc_id) AS ids FROM hits GROUP BY ALL),
    stab AS (SELECT b.query_id, coalesce(avg(CASE WHEN v.seed IS NOT NULL THEN {_JAC("coalesce(o.ids, [])", "coalesce(s.ids, [])")} END), 1.0) AS stability FROM base b LEFT JOIN vars v ON v.seed = b.query_id LEFT JOIN sets o ON o.query_id = b.query_id || '|base' LEFT JOIN sets s ON s.query_id = v.query_id GROUP BY b.query_id)"""

SQL = {
    "ndcg_mrr": f"WITH {_RANKED} SELECT query_id, method, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM perq",
    "ndcg_grouped": f"WITH {_RANKED} SELECT method, language, category, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM perq GROUP BY GROUPING SETS ((method), (method, language), (method, category))",
    "topk_overlap": f"WITH {S._LEX.replace('100, ', '100, ')}, {S._top(S._KNN, 100, 'sem')}, {_SETS} SELECT coalesce(x.query_id, y.query_id) AS query_id, round({_JAC('coalesce(b, [])', 'coalesce(v, [])')}, 6) AS jaccard FROM bids x FULL JOIN vids y ON y.query_id = x.query_id",
    "dominance": f"WITH {_RANKED}, n AS (SELECT query_id, show_id, count(*) AS n, min(rank) AS f FROM ranked WHERE rank <= 10 GROUP BY ALL) SELECT query_id, round(n / 10, 6) AS dominance, show_id AS show FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS r FROM n) WHERE r = 1",
    "method_comparison": f"""WITH {S.HYBRID_SQL}, {_SETS}, hids AS (SELECT query_id, list(doc_id ORDER BY rank) AS h FROM hyb GROUP BY ALL),
        l AS (SELECT query_id, coalesce(b, []) AS b, coalesce(v, []) AS v, coalesce(h, []) AS h FROM bids FULL JOIN vids USING (query_id) FULL JOIN hids USING (query_id)),
        m AS (SELECT query_id, {_JAC('b', 'v')} AS j1, {_JAC('b', 'h')} AS j2, {_JAC('v', 'h')} AS j3, len({_MINUS('b', 'v')}) AS bm25_only, len({_MINUS('v', 'b')}) AS knn_only, len(list_intersect(b, v)) AS in_both,
            len({_MINUS('list_intersect(h, b)', 'v')}) AS hybrid_from_bm25, len({_MINUS('list_intersect(h, v)', 'b')}) AS hybrid_from_knn, len(list_filter(h, lambda z: NOT list_contains(b, z) AND NOT list_contains(v, z))) AS promoted,
            len(list_distinct(list_concat({_MINUS('b[1:5]', 'h[1:5]')}, {_MINUS('v[1:5]', 'h[1:5]')}))) AS demoted FROM l)
        SELECT query_id, round(j1, 4) AS bm25_knn, round(j2, 4) AS bm25_hybrid, round(j3, 4) AS knn_hybrid, CAST(bm25_only AS INTEGER) AS bm25_only, CAST(knn_only AS INTEGER) AS knn_only, CAST(in_both AS INTEGER) AS in_both, CAST(hybrid_from_bm25 AS INTEGER) AS hybrid_from_bm25,
            CAST(hybrid_from_knn AS INTEGER) AS hybrid_from_knn, CAST(promoted AS INTEGER) AS promoted, CAST(demoted AS INTEGER) AS demoted, CASE WHEN j1 < 0.3 THEN 'high_disagreement' WHEN j1 > 0.7 THEN 'high_agreement' ELSE 'mixed' END AS agreement,
            CASE WHEN hybrid_from_bm25 > hybrid_from_knn + 3 THEN 'bm25' WHEN hybrid_from_knn > hybrid_from_bm25 + 3 THEN 'knn' ELSE 'none' END AS dominant FROM m""",
    "annotation_pool": f"""WITH {S.HYBRID_SQL}, allr AS (SELECT query_id, doc_id, 'bm25' AS source, rank FROM lex WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'embedding', rank FROM sem WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'hybrid', rank FROM hyb)
        SELECT query_id, doc_id, string_agg(source, ',' ORDER BY source) AS sources, string_agg(source || '=' || rank, ',' ORDER BY source) AS ranks FROM allr GROUP BY ALL""",
    "search_success_rate": f"WITH {_VALID}, hit AS (SELECT DISTINCT request_id FROM valid) SELECT q.mode, count(*) AS queries, count(h.request_id) AS successful, round(count(h.request_id) / count(*), 4) AS rate FROM q LEFT JOIN hit h ON h.request_id = q.request_id GROUP BY q.mode",
    "same_language_clicks": f"WITH {_Q}, {_CLICKS} SELECT c.selected_lang, count(*) AS clicks, count(*) FILTER (WHERE c.clicked_language = coalesce(q.query_lang, '')) AS same, round(count(*) FILTER (WHERE c.clicked_language = coalesce(q.query_lang, '')) / count(*), 4) AS rate FROM c LEFT JOIN q ON q.request_id = c.request_id GROUP BY c.selected_lang",
    "first_click_rank": f"WITH {_VALID}, f AS (SELECT request_id, clicked_rank, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(c_micros, 0), clicked_rank) AS r FROM valid) SELECT count(*) AS requests, round(coalesce(avg(clicked_rank), 0.0), 2) AS mean_rank FROM f WHERE r = 1",
    "reformulation_rate": f"WITH {_GAPS} SELECT count(*) AS queries, count(*) FILTER (WHERE gap <= 30000000 AND query IS DISTINCT FROM before) AS reformulations, round(count(*) FILTER (WHERE gap <= 30000000 AND query IS DISTINCT FROM before) / count(*), 4) AS rate FROM gaps",
    "session_gap": f"WITH {_GAPS} SELECT request_id, coalesce(gap, -1) AS gap_micros, coalesce(gap <= 30000000, false) AS same_session FROM gaps",
    "regression_gate": f"WITH {_RANKED}, {_RGATE} SELECT language, method, round(ndcg, 6) AS ndcg, gate, status FROM rgate",
    "routing_confusion": """WITH e AS (SELECT DISTINCT episode_id, description, target_index FROM episodes), p AS (SELECT CASE WHEN description IS NULL THEN NULL WHEN length(replace(description, ' ', '')) > 0 AND length(regexp_replace(description, '[^一-鿿]', '', 'g')) / length(replace(description, ' ', '')) > 0.3 THEN 'zh' ELSE 'other' END AS truth,
            CASE WHEN target_index LIKE 'podcast-episodes-zh%' THEN 'zh' WHEN target_index = 'podcast-episodes-en' THEN 'other' END AS predicted FROM e), k AS (SELECT truth, predicted, count(*) AS n FROM p WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL),
        r AS (SELECT truth, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE truth = predicted), 0) AS BIGINT) AS correct FROM k GROUP BY truth), c AS (SELECT predicted AS truth, CAST(sum(n) AS BIGINT) AS predicted_n FROM k GROUP BY predicted)
        SELECT truth, coalesce(n, 0) AS n, coalesce(correct, 0) AS correct, coalesce(predicted_n, 0) AS predicted_n, round(coalesce(correct / nullif(predicted_n, 0), 0), 6) AS precision, round(coalesce(correct / nullif(n, 0), 0), 6) AS recall FROM r FULL JOIN c USING (truth)""",
    "latency_percentiles": f"WITH {_Q} {_LAT} GROUP BY ALL",
    "latency_gate": f"WITH {_Q}, {_GATE} SELECT * FROM lgate",
    "suite_status": f"WITH {_RANKED}, {_RGATE}, {_GATE}, st AS (SELECT status FROM rgate UNION ALL SELECT status FROM lgate) SELECT CASE WHEN count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'PASS') > 0 THEN 'PASS' ELSE 'N/A' END AS status, count(*) AS items, count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failed FROM st",
    "weekly_delta": f"""WITH {_RANKED}, per AS (SELECT CASE WHEN q.timestamp >= '2024-05-01' THEN 'current' ELSE 'previous' END AS week, q.query, avg(p.ndcg) AS ndcg FROM perq p JOIN q ON q.request_id = p.query_id WHERE q.query IS NOT NULL GROUP BY ALL),
        pairs AS (SELECT a.query, a.ndcg, b.ndcg AS before, round(a.ndcg - b.ndcg, 6) AS delta FROM per a JOIN per b ON b.query = a.query WHERE a.week = 'current' AND b.week = 'previous')
        SELECT query, round(ndcg, 6) AS ndcg, round(before, 6) AS before, delta, 'drop' AS kind FROM (SELECT * FROM pairs WHERE delta < 0 ORDER BY delta, query LIMIT 5) UNION ALL SELECT query, round(ndcg, 6), round(before, 6), delta, 'gain' FROM (SELECT * FROM pairs WHERE delta > 0 ORDER BY delta DESC, query LIMIT 5)""",
}
SQL |= {
    "intrusion": f"WITH {_RANKED}, {_INTR} SELECT query_id, round(intrusion, 6) AS intrusion FROM intr",
    "stability": f"WITH {_STAB} SELECT query_id, round(stability, 6) AS stability FROM stab",
    "no_annotation_summary": f"""WITH {_RANKED}, {_DOM}, {_INTR}, a AS (SELECT avg(dominance) AS d FROM dom), b AS (SELECT avg(intrusion) AS i FROM intr), c AS (WITH {_STAB} SELECT avg(stability) AS s FROM stab)
        SELECT round(d, 4) AS dominance, round(i, 4) AS intrusion, round(s, 4) AS stability, i < 0.1 AND d < 0.5 AND s > 0.7 AS passed FROM a, b, c""",
    "labels_percentile": f"WITH {_SCORED}, {_labels('scored', 'lab')} SELECT query_id, doc_id, score, label FROM lab",
    "labels_small_pool": f"WITH {_SCORED}, {_labels('scored', 'lab')} SELECT query_id, doc_id, label FROM lab WHERE n < 10",
    "judgment_stats": f"""WITH {_SCORED}, {_labels('scored', 'lab')} SELECT count(*) AS pairs, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1, count(*) FILTER (WHERE label = 2) AS label_2, count(*) FILTER (WHERE label = 3) AS label_3,
        round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round((SELECT avg(v) FROM (SELECT var_pop(score) AS v FROM lab GROUP BY query_id)), 6) AS mean_variance FROM lab""",
    "incremental_annotation": f"""WITH {_SCORED}, oldp AS (SELECT * FROM scored WHERE {_OLD}), newp AS (SELECT * FROM scored WHERE NOT {_OLD}), {_labels('oldp', 'a')}, {_labels('newp', 'b')}
        SELECT query_id, doc_id, 'kept' AS origin, label FROM a UNION ALL SELECT query_id, doc_id, 'new', label FROM b""",
}
SQL["overlap_averages"] = f"WITH m AS ({SQL['method_comparison']}) SELECT count(*) AS queries, round(avg(bm25_knn), 6) AS avg_bm25_knn, round(avg(bm25_hybrid), 6) AS avg_bm25_hybrid, round(avg(knn_hybrid), 6) AS avg_knn_hybrid, round(avg(bm25_only), 6) AS avg_bm25_only, round(avg(knn_only), 6) AS avg_knn_only, round(avg(in_both), 6) AS avg_in_both, count(*) FILTER (WHERE hybrid_from_bm25 > 0 AND hybrid_from_knn > 0) AS hybrid_helps, count(*) FILTER (WHERE hybrid_from_bm25 > hybrid_from_knn) AS bm25_better, count(*) FILTER (WHERE hybrid_from_knn > hybrid_from_bm25) AS knn_better FROM m"
SQL["routing_gates"] = f"WITH c AS ({SQL['routing_confusion']}), r AS (SELECT *, coalesce((n - correct) / nullif(n, 0), 0.0) AS rate FROM c) SELECT truth, round(rate, 6) AS confusion, CASE WHEN precision >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS precision_gate, CASE WHEN recall >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS recall_gate, CASE WHEN rate <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS confusion_gate FROM r"
SQL["method_metrics"] = f"""WITH {S.HYBRID_SQL}, ranked AS (SELECT query_id, 'bm25' AS method, doc_id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT query_id, 'knn', doc_id, rank FROM sem WHERE rank <= 10 UNION ALL SELECT query_id, 'hybrid', doc_id, rank FROM hyb),
    tw AS (SELECT doc_id, {S.TOK.format(x='title')} AS w FROM docs),
    rel AS (SELECT r.*, CASE WHEN split_part(r.query_id, ':', 3) = split_part(r.doc_id, ':', 3) THEN CASE WHEN len(list_intersect(a.w, b.w)) > 0 THEN 3 ELSE 2 END ELSE 0 END AS rel FROM ranked r JOIN tw a ON a.doc_id = r.doc_id JOIN tw b ON b.doc_id = r.query_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY rel DESC, rank) AS ideal FROM rel),
    p AS (SELECT query_id, method, CASE WHEN sum(rel) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)) ELSE 0.0 END AS ndcg, coalesce(1.0::DOUBLE / min(CASE WHEN rel >= 2 THEN rank END), 0.0) AS mrr FROM o GROUP BY ALL)
    SELECT method, count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr FROM p GROUP BY method"""
ROWS_ONLY = ("bootstrap_ci",)
QUERIES = {k: globals()[k] for k in (*SQL, *ROWS_ONLY)}
