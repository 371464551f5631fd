"""Measures of search quality, user behaviour, health and routing, with their gates."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X

# Gates of the reports.
NDCG_GATES = {"zh-tw": 0.897, "zh-cn": 0.897, "en": 0.853}
LATENCY_FACTOR = 1.5
HEALTH_GATES = {"embedding": 0.99, "image_url": 0.90, "zero_results": 0.05}
ROUTING_GATES = {"precision": 0.95, "recall": 0.90, "confusion": 0.05}
ONLINE_GATES = {"success": 0.60, "same_language": 0.80, "reformulation": 0.20}
SESSION_SECONDS = 30


def ranking_metrics(ranked: DataFrame, judgments: DataFrame, keys: list[str], k: int = 10, relevant: int = 2) -> DataFrame:
    """(keys..., ndcg, mrr) of ranked lists (keys..., doc_id, rank) against (query_id, doc_id, relevance).

    A document without a judgment has relevance 0. The ideal order is that of the retrieved list; a list without any
    relevance scores 0. MRR is the inverse of the first rank of at least `relevant`.
    """
    j = judgments.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    rel = ranked.where(F.col("rank") <= k).join(j, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("relevance", F.lit(0)))
    ideal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rel"), "rank"))
    rows = rel.withColumn("ideal", ideal)
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("rel") / F.log2(F.col("ideal") + 1.0)).alias("idcg"), F.min(F.when(F.col("rel") >= relevant, F.col("rank"))).alias("first")
    )
    return sums.select(*keys, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def grouped_means(per_query: DataFrame, method: str = "method", dims: tuple[str, ...] = ("language", "category")) -> DataFrame:
    """Means by method, and by method with each dimension, in one pass over grouping sets."""
    sets = [[F.col(method)], *([F.col(method), F.col(d)] for d in dims)]
    return per_query.groupingSets(sets, F.col(method), *(F.col(d) for d in dims)).agg(
        F.concat_ws(":", *(F.when(F.grouping(d) == 0, F.lit(d)) for d in dims)).alias("by"), F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr")
    )


def _poisson_sums(keys: list[str], resamples: int, seed: int):
    """Sums and counts of each resample over the rows of a partition, by key: every row draws how often it enters each."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(keys, dropna=False, sort=False):
                at = sums.setdefault(key, np.zeros((2, resamples)))
                for a in range(0, len(part), 256):
                    h, v = part["_h"].to_numpy("i8")[a : a + 256].view("u8"), part["_v"].to_numpy("f8")[a : a + 256]
                    # A draw is a mix of the row's hash and the number of the resample.
                    z = h[:, None] + (np.arange(1, resamples + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))[None, :] + np.uint64(seed)
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    n = np.searchsorted(cuts, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("f8") / 2.0**53)
                    at[0] += v @ n
                    at[1] += n.sum(axis=0)
        if sums:
            out = pd.DataFrame([k if isinstance(k, tuple) else (k,) for k in sums], columns=keys)
            yield out.assign(_s=[x[0].tolist() for x in sums.values()], _n=[x[1].tolist() for x in sums.values()])

    return run


def bootstrap(per_query: DataFrame, keys: list[str], value: str, row: list[str], resamples: int = 1000, least: int = 5, seed: int = 42) -> DataFrame:
    """(keys..., low, high): the 2.5 and 97.5 percentiles of means of resamples with replacement, for groups of at least `least` rows.

    `row` names the columns that tell rows apart. How often a row enters a resample (Poisson bootstrap) follows from a hash of
    these, the value and the seed, so the result does not depend on how the rows lie (sums are rounded to nine decimals). Each
    partition adds up its resamples and hands on one row a group. A null value counts in no mean.
    """
    kinds = dict(per_query.dtypes)
    rows = per_query.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(*keys, *row, F.col(value)).alias("_h"))
    sized = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= least).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    parts = rows.mapInPandas(_poisson_sums(keys, resamples, seed), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _s array<double>, _n array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("_s", "_n")).alias("r", "x"))
    means = each.groupBy(*keys, "r").agg((F.round(F.sum("x._s"), 9) / F.nullif(F.sum("x._n"), F.lit(0.0))).alias("m"))
    found = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return found.join(sized, functools.reduce(lambda a, b: a & b, same), "left_semi")


def result_sets(ranked: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """(query, ids): the ids of the first k in order of rank."""
    return ranked.where(F.col("rank") <= k).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, jaccard) of two result lists; both empty are equal."""
    empty = F.array().cast("array<string>")
    x, y = result_sets(a, k), result_sets(b, k).withColumnRenamed("ids", "other")
    return x.join(y, "query_id", "full").select("query_id", X.jaccard(F.coalesce("ids", empty), F.coalesce("other", empty)).alias("jaccard"))


def dominance(ranked: DataFrame, keys: list[str], show: str = "show_id", k: int = 10) -> DataFrame:
    """(keys..., dominance, show): the largest number of results of one show over k; among equals the show seen first."""
    counts = ranked.where(F.col("rank") <= k).groupBy(*keys, F.coalesce(X.blank_to_null(F.col(show)), F.lit("unknown")).alias("show")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct("show", "n"), F.struct(F.col("n"), -F.col("first"))).alias("x"))
    return best.select(*keys, (F.col("x.n") / k).alias("dominance"), F.col("x.show").alias("show"))


def intrusion(ranked: DataFrame, extraneous: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """(keys..., intrusion): documents of (doc_id, extraneous) among the first k, over k."""
    bad = extraneous.where("extraneous").select("doc_id").distinct().withColumn("_bad", F.lit(1))
    return ranked.where(F.col("rank") <= k).join(bad, "doc_id", "left").groupBy(*keys).agg((F.count("_bad") / k).alias("intrusion"))


def method_comparison(lexical: DataFrame, semantic: DataFrame, fused: DataFrame, k: int = 10) -> DataFrame:
    """What each query's fused list takes from either list, and a case: disagreement below 0.3, agreement above 0.7."""
    empty = F.array().cast("array<string>")
    lists = result_sets(lexical, k).withColumnRenamed("ids", "b").join(result_sets(semantic, k).withColumnRenamed("ids", "v"), "query_id", "full").join(result_sets(fused, k).withColumnRenamed("ids", "h"), "query_id", "full")
    lists = lists.select("query_id", *(F.coalesce(c, empty).alias(c) for c in "bvh"))
    size = lambda c: F.size(c)
    head = lambda c: F.slice(c, 1, 5)
    out = lists.select(
        "query_id", X.jaccard(F.col("b"), F.col("v")).alias("bm25_knn"), X.jaccard(F.col("b"), F.col("h")).alias("bm25_hybrid"), X.jaccard(F.col("v"), F.col("h")).alias("knn_hybrid"),
        size(F.array_except("b", "v")).alias("bm25_only"), size(F.array_except("v", "b")).alias("knn_only"), size(F.array_intersect("b", "v")).alias("in_both"),
        size(F.array_except(F.array_intersect("h", "b"), "v")).alias("hybrid_from_bm25"), size(F.array_except(F.array_intersect("h", "v"), "b")).alias("hybrid_from_knn"),
        size(F.array_except(F.array_except("h", "b"), "v")).alias("promoted"),
        size(F.array_distinct(F.concat(F.array_except(head("b"), head("h")), F.array_except(head("v"), head("h"))))).alias("demoted"),
    )
    lead = F.col("hybrid_from_bm25") - F.col("hybrid_from_knn")
    return out.withColumn("agreement", F.when(F.col("bm25_knn") < 0.3, "high_disagreement").when(F.col("bm25_knn") > 0.7, "high_agreement").otherwise("mixed")).withColumn(
        "dominant", F.when(lead > 3, "bm25").when(lead < -3, "knn").otherwise("none")
    )


def annotation_pool(*lists: tuple[str, DataFrame]) -> DataFrame:
    """(query_id, doc_id, sources, ranks): every result of any method once, with the methods that gave it and their ranks."""
    both = None
    for name, df in lists:
        part = df.select("query_id", "doc_id", F.lit(name).alias("source"), "rank")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("ranks"))


def percentile_labels(scored: DataFrame, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """Labels 0 to 3: by rank in pools of fewer than ten (1, 3 and 6 places), else by the 80th, 50th and 20th percentile."""
    pool = scored.groupBy(key).agg(F.count("*").alias("_n"), F.percentile(score, F.array(F.lit(0.8), F.lit(0.5), F.lit(0.2))).alias("_p"))
    rows = scored.join(pool, key).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item)))
    cut = lambda i: F.col(score) >= F.col("_p")[i]
    by_rank = F.when(F.col("_r") <= 1, 3).when(F.col("_r") <= 3, 2).when(F.col("_r") <= 6, 1).otherwise(0)
    return rows.withColumn("label", F.when(F.col("_n") < 10, by_rank).otherwise(F.when(cut(0), 3).when(cut(1), 2).when(cut(2), 1).otherwise(0))).drop("_n", "_p", "_r")


def judgment_statistics(judged: DataFrame, key: str = "query_id", score: str = "score", label: str = "label") -> DataFrame:
    """One row: how many pairs and of each label, moments of the scores, and the mean of the variances within queries."""
    within = judged.groupBy(key).agg(F.var_pop(score).alias("v")).agg(F.avg("v").alias("mean_variance"))
    whole = judged.agg(F.count("*").alias("pairs"), *(F.count_if(F.col(label) == i).alias(f"label_{i}") for i in range(4)), F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return whole.join(F.broadcast(within))


def valid_clicks(queries: DataFrame, clicks: DataFrame, seconds: float = SESSION_SECONDS) -> DataFrame:
    """Clicks within `seconds` of the query of their request: (request_id, q_micros, c_micros, clicked_rank, …).

    Times are microseconds; a missing time is that of 1970.
    """
    q = queries.select("request_id", F.coalesce(F.col("q_micros"), F.lit(0)).alias("q_micros"))
    c = clicks.withColumn("c_micros", F.coalesce("c_micros", F.lit(0)))
    gap = F.col("c_micros") - F.col("q_micros")
    return c.join(q, "request_id").where((gap >= 0) & (gap <= F.lit(int(seconds * 1_000_000))))


def first_click_ranks(valid: DataFrame) -> DataFrame:
    """(request_id, clicked_rank) of the earliest valid click of a request; of several at one time the highest place."""
    return valid.groupBy("request_id").agg(F.min_by("clicked_rank", F.struct("c_micros", "clicked_rank")).alias("clicked_rank"))


def reformulations(queries: DataFrame, seconds: float = SESSION_SECONDS, partition_by: str | None = None) -> DataFrame:
    """Queries with `gap_micros` to the one before and whether they reformulate it: within `seconds` and of other text.

    The log is one sequence by time, unless `partition_by` names a user or session column. One sequence is sorted in
    parallel by ranges of time; the last row of each range is handed to the next, so no task sees more than a range.
    """
    if partition_by:
        w = Window.partitionBy(partition_by).orderBy("q_micros", "request_id")
        before = queries.withColumn("_p", F.lag(F.struct("q_micros", "query")).over(w))
    else:
        span = 86_400_000_000  # a day a range
        ranged = queries.withColumn("_day", F.floor(F.col("q_micros") / span))
        w = Window.partitionBy("_day").orderBy("q_micros", "request_id")
        inside = ranged.withColumn("_p", F.lag(F.struct("q_micros", "query")).over(w))
        # Last rows of days: one row a day, so a single task orders them.
        last = ranged.groupBy("_day").agg(F.max_by(F.struct("q_micros", "query"), F.struct("q_micros", "request_id")).alias("_last"))
        last = last.withColumn("_carry", F.lag("_last").over(Window.orderBy("_day"))).select("_day", "_carry")
        before = inside.join(F.broadcast(last), "_day").withColumn("_p", F.coalesce("_p", "_carry")).drop("_carry", "_day")
    gap = F.col("q_micros") - F.col("_p.q_micros")
    return before.withColumn("gap_micros", gap).withColumn("reformulated", F.coalesce((gap <= int(seconds * 1_000_000)) & ~F.col("query").eqNullSafe(F.col("_p.query")), F.lit(False))).drop("_p")


def confusion(pairs: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(truth, n, correct, predicted_n, precision, recall) of each class over (truth, predicted); other labels are ignored."""
    known = pairs.where(F.col("truth").isin(*classes) & F.col("predicted").isin(*classes))
    cells = known.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    rows = cells.groupBy("truth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("correct"))
    cols = cells.groupBy(F.col("predicted").alias("truth")).agg(F.sum("n").alias("predicted_n"))
    both = rows.join(cols, "truth", "full").fillna(0, ["n", "correct", "predicted_n"])
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return both.withColumn("precision", part("correct", "predicted_n")).withColumn("recall", part("correct", "n"))


def index_health(coverage: DataFrame, rates: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """Coverage of each index (alias, docs, embedding, image_url, description) with its rate of queries without a result (alias, queries, zero).

    PASS or FAIL by the gates; N/A where no query was tested.
    """
    g = gates or HEALTH_GATES
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")
    rate = F.col("zero") / F.nullif(F.col("queries"), F.lit(0))
    return coverage.join(rates, "alias").select(
        "alias", "docs", "embedding", passed(F.col("embedding") >= g["embedding"]).alias("embedding_gate"), "image_url", passed(F.col("image_url") >= g["image_url"]).alias("image_url_gate"), "description",
        F.round(rate, 4).alias("zero_rate"), F.when(F.col("queries") == 0, "N/A").otherwise(passed(rate <= g["zero_results"])).alias("zero_gate"),
    )


def routing_gates(matrix: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """A confusion table with its confusion rate (what went elsewhere, of a class) and PASS or FAIL for each measure."""
    g = gates or ROUTING_GATES
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")
    rate = F.coalesce((F.col("n") - F.col("correct")) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return matrix.withColumn("confusion", rate).withColumns({
        "precision_gate": passed(F.col("precision") >= g["precision"]), "recall_gate": passed(F.col("recall") >= g["recall"]), "confusion_gate": passed(F.col("confusion") <= g["confusion"]),
    })


def overlap_averages(compared: DataFrame) -> DataFrame:
    """One row over `method_comparison`: means of the overlaps (of four decimals each) and of what one method found alone, and how often the fusion helped."""
    avg = lambda c, n: F.avg(F.round(c, n)).alias(f"avg_{c}")
    a, b = F.col("hybrid_from_bm25"), F.col("hybrid_from_knn")
    return compared.agg(
        F.count("*").alias("queries"), *(avg(c, 4) for c in ("bm25_knn", "bm25_hybrid", "knn_hybrid")), *(avg(c, 2) for c in ("bm25_only", "knn_only", "in_both")),
        F.count_if((a > 0) & (b > 0)).alias("hybrid_helps"), F.count_if(a > b).alias("bm25_better"), F.count_if(b > a).alias("knn_better"),
    )


def ingest_summary(documents: DataFrame, alias: str = "alias", language: str = "language", failed: str = "failed", limit: float = 0.05) -> DataFrame:
    """One row: documents by index and by language (unknown for none), how many failed, the share without a language, and a warning above `limit`."""
    lang = F.coalesce(F.col(language), F.lit("unknown"))
    pairs = lambda c, name: documents.where(~F.col(failed)).groupBy(c.alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit("none")).alias("k"), "n")))).alias(name))
    whole = documents.agg(F.count_if(~F.col(failed)).alias("succeeded"), F.count_if(F.col(failed)).alias("failed"), F.count_if(lang == "unknown").alias("_u"), F.count("*").alias("_n"))
    rate = F.coalesce(F.col("_u") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0))
    return whole.join(F.broadcast(pairs(F.col(alias), "indexes"))).join(F.broadcast(pairs(lang, "languages"))).select("indexes", "languages", "succeeded", "failed", F.round(rate, 4).alias("uncertain_rate"), (rate > limit).alias("warning"))


def latency_statistics(runs: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    v = F.col(value)
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.round(F.avg(v), 2).alias("mean_ms"),
        *(F.round(F.percentile(v, F.lit(p / 100)), 2).alias(f"p{p}_ms") for p in (50, 95, 99)), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 2).alias("std_ms"),
    )


def latency_gate(current: DataFrame, baseline: DataFrame, keys: list[str], factor: float = LATENCY_FACTOR) -> DataFrame:
    """PASS if the 99th percentile is at most `factor` times the stored one (a bound of one decimal); SKIP where none is stored."""
    b = baseline.select(*keys, F.round(F.col("p99_ms") * factor, 1).alias("bound_ms"))
    return current.join(b, keys, "left").select(*keys, "p99_ms", "bound_ms", F.when(F.col("bound_ms").isNull(), "SKIP").when(F.col("p99_ms") <= F.col("bound_ms"), "PASS").otherwise("FAIL").alias("status"))


def best_method(per_method: DataFrame, keys: list[str], order: tuple[str, ...] = ("bm25", "knn", "hybrid", "exact"), value: str = "ndcg") -> DataFrame:
    """(keys..., method, value): the method of the largest mean; the first in `order` among equals."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("method"))
    return per_method.groupBy(*keys).agg(F.max_by(F.struct("method", value), F.struct(F.round(value, 9), -place)).alias("x")).select(*keys, "x.*")


def regression_gate(best: DataFrame, gates: dict[str, float] | None = None, value: str = "ndcg") -> DataFrame:
    """A row for each gated language: PASS, FAIL, or SKIP where nothing was measured."""
    gates = gates or NDCG_GATES
    wanted = best.sparkSession.createDataFrame(list(gates.items()), "language string, gate double")
    return wanted.join(best, "language", "left").select("language", "method", value, "gate", F.when(F.col(value).isNull(), "SKIP").when(F.round(value, 4) >= F.col("gate"), "PASS").otherwise("FAIL").alias("status"))


def suite_status(statuses: DataFrame) -> DataFrame:
    """Overall status: FAIL if any item failed or ended in an error, else PASS if any passed, else N/A."""
    bad = F.count_if(F.col("status").isin("FAIL", "ERROR"))
    return statuses.agg(F.when(bad > 0, "FAIL").when(F.count_if(F.col("status") == "PASS") > 0, "PASS").otherwise("N/A").alias("status"), F.count("*").alias("items"), bad.alias("failed"))


def online_gate(value: Column, gate: str) -> Column:
    """Direction-aware: the reformulation rate must not exceed its gate, the others must reach theirs."""
    bound = ONLINE_GATES[gate]
    return F.when(value <= bound if gate == "reformulation" else value >= bound, "PASS").otherwise("FAIL")


def deltas(current: DataFrame, previous: DataFrame, keys: list[str], value: str, n: int = 5) -> DataFrame:
    """The n largest drops and gains of the rows that both reports have: (keys..., value, before, delta, kind, place)."""
    both = current.select(*keys, value).join(previous.select(*keys, F.col(value).alias("before")), keys).withColumn("delta", F.round(F.col(value) - F.col("before"), 6))
    drop = both.where(F.col("delta") < 0).orderBy("delta", *keys).limit(n).withColumn("kind", F.lit("drop"))
    gain = both.where(F.col("delta") > 0).orderBy(F.desc("delta"), *keys).limit(n).withColumn("kind", F.lit("gain"))
    return drop.unionByName(gain)


def measure_latency(run, queries: list[tuple[str, str, str]], runs: int = 10) -> list[tuple[str, str, float]]:
    """(language, mode, milliseconds) of `run(query, language, mode)` for each (query, language, mode), after one warm-up."""
    import time

    if queries:
        run(*queries[0])
    out = []
    for query, language, mode in queries:
        for _ in range(runs):
            began = time.perf_counter()
            run(query, language, mode)
            out.append((language, mode, (time.perf_counter() - began) * 1000))
    return out


def online_report(success: float, same_language: float, first_rank: float | None, reformulation: float) -> list[tuple[str, float | None, str]]:
    """Rows of the online table: measure, value, status. The mean first rank has no gate."""
    up = lambda v, g: "PASS" if v >= ONLINE_GATES[g] else "FAIL"
    return [
        ("search_success_rate", success, up(success, "success")), ("same_language_click_rate", same_language, up(same_language, "same_language")),
        ("mean_first_click_rank", first_rank, "N/A"), ("reformulation_rate", reformulation, "PASS" if reformulation <= ONLINE_GATES["reformulation"] else "FAIL"),
    ]
