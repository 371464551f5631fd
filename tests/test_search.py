import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import evaluation as E
from quillspark.operators import search as R
from quillspark.plans import eval_queries as EQ


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [("d1", "s1", "Solar power at home", "panels and inverters"), ("d2", "s1", "Power of habit", "solar is mentioned"), ("d3", None, "夜間列車 旅行", "太陽能電池"), ("d4", "s2", None, None), ("d5", "s2", "home solar power", "")]
    return spark.createDataFrame(docs, "doc_id string, show_id string, title string, description string")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(texts)], "query_id string, query string")


def ranked(df):
    return [(r.query_id, r.doc_id) for r in df.orderBy("query_id", "rank").collect()]


def test_title_phrase_leads(spark, corpus):
    assert [d for _, d in ranked(R.bm25(queries(spark, "solar power"), corpus))][:2] == ["d5", "d1"]


def test_evaluation_mode_knows_bigrams(spark, corpus):
    assert ranked(R.bm25(queries(spark, "夜間"), corpus, mode="evaluation"))[0] == ("q0", "d3")


def test_phrase_needs_the_order(spark, corpus):
    assert ranked(R.phrase_search(queries(spark, "power home", "home solar"), corpus)) == [("q1", "d5")]


def test_no_results(spark, corpus):
    assert {r.query_id for r in R.zero_results(queries(spark, "unheard", "solar", ""), corpus).collect()} == {"q0", "q2"}
    assert R.bm25(queries(spark, "solar"), corpus.limit(0)).count() == 0


def test_rrf(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, doc_id string, rank int")
    got = {r.doc_id: r.score for r in R.rrf(a, b).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_at_most_three_of_a_show(spark):
    a = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(7)], "query_id string, doc_id string, rank int")
    shows = spark.createDataFrame([(f"d{i}", "s" if i < 5 else None) for i in range(7)], "doc_id string, show_id string")
    assert [d for _, d in ranked(R.hybrid(a, a.limit(0), shows))] == ["d0", "d1", "d2", "d5", "d6"]


def test_knn(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("a", [1.0, 0.0])], "doc_id string, embedding array<float>")
    got = R.knn(v.withColumnRenamed("doc_id", "query_id"), v, 2, 1)
    assert ranked(got) == [("a", "b"), ("b", "a"), ("c", "b")]


def test_suggestions(spark, corpus):
    asked = spark.createDataFrame([("q", "Sol"), ("r", "xx")], "query_id string, prefix string")
    assert [r.title for r in R.suggestions(asked, corpus).collect()] == ["Solar power at home"]


def test_jaccard(spark):
    rows = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.j for r in rows.select(scalars.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == pytest.approx([1.0, 0.0, 1 / 3])


def metrics(spark, rel):
    lists = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(len(rel))], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", f"d{i}", r) for i, r in enumerate(rel)], "query_id string, doc_id string, relevance int")
    r = E.ranking_metrics(lists, judged, ["query_id"]).first()
    return r.ndcg, r.mrr


@pytest.mark.parametrize("rel,ndcg,mrr", [([3, 2, 1], 1.0, 1.0), ([0, 0, 0, 0], 0.0, 0.0), ([3, 0, 0, 0], 1.0, 1.0), ([1, 1, 2], None, 1 / 3), ([1, 1, 1, 0], None, 0.0)])
def test_ranking_metrics(spark, rel, ndcg, mrr):
    got = metrics(spark, rel)
    assert got[1] == pytest.approx(mrr)
    assert ndcg is None or got[0] == pytest.approx(ndcg)


def test_reformulations_across_days(spark):
    day = 86_400_000_000
    rows = spark.createDataFrame([("a", "x", day - 1_000_000), ("b", "y", day + 1_000_000), ("c", "y", day + 2_000_000), ("d", "z", 3 * day)], "request_id string, query string, q_micros bigint")
    got = {r.request_id: (r.gap_micros, r.reformulated) for r in E.reformulations(rows).collect()}
    assert got == {"a": (None, False), "b": (2_000_000, True), "c": (1_000_000, False), "d": (2 * day - 2_000_000, False)}


def test_gates(spark):
    row = spark.range(1).select(E.online_gate(F.lit(0.6), "success").alias("a"), E.online_gate(F.lit(0.2), "reformulation").alias("b"), E.online_gate(F.lit(0.21), "reformulation").alias("c")).first()
    assert tuple(row) == ("PASS", "PASS", "FAIL")
    st = spark.createDataFrame([("PASS",), ("ERROR",)], "status string")
    assert E.suite_status(st).first().status == "FAIL"


def test_small_pools(spark):
    rows = spark.createDataFrame([("q", f"d{i}", float(10 - i)) for i in range(8)], "query_id string, doc_id string, score double")
    assert [r.label for r in E.percentile_labels(rows).orderBy("doc_id").collect()] == [3, 2, 2, 1, 1, 1, 0, 0]


def test_bootstrap(spark):
    rows = spark.createDataFrame([("m", 0.5)] * 6 + [("few", 0.1)] * 4, "method string, ndcg double")
    got = E.bootstrap(rows.withColumn("id", F.monotonically_increasing_id()), ["method"], "ndcg", ["id"], 200).collect()
    assert [(r.method, r.low, r.high) for r in got] == [("m", pytest.approx(0.5), pytest.approx(0.5))]


def test_bootstrap_does_not_depend_on_the_partitions(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, "m" if i % 3 else None, rng.random()) for i in range(300)] + [(999, "m", None)], "id int, method string, ndcg double")
    got = {tuple(sorted((str(r.method), r.low, r.high) for r in E.bootstrap(rows.repartition(n, "ndcg"), ["method"], "ndcg", ["id"]).collect())) for n in (1, 3, 8)}
    assert len(got) == 1
    (m, low, high) = next(x for x in got.pop() if x[0] == "m")
    values = [r.ndcg for r in rows.where("method = 'm' and ndcg is not null").collect()]
    mean, sd = np.mean(values), np.std(values) / len(values) ** 0.5
    assert abs(low - (mean - 1.96 * sd)) < 0.3 * sd and abs(high - (mean + 1.96 * sd)) < 0.3 * sd


def test_routing_by_language(spark):
    docs = [("d1", "s", "solar power", None, "podcast-episodes-en"), ("d2", "s", "solar power 太陽", None, "podcast-episodes-zh-tw"), ("d3", "s", "solar", None, None), ("d4", "s", "solar", None, "podcast-episodes-zh-cn")]
    corpus = spark.createDataFrame(docs, "doc_id string, show_id string, title string, description string, target_index string")
    asked = spark.createDataFrame([("q1", "solar", "en"), ("q2", "solar", "mixed"), ("q3", "solar", "zh-cn"), ("q4", "solar", None)], "query_id string, query string, language string")
    for mode in ("bm25", "bm25_eval", "exact"):
        assert {(r.query_id, r.doc_id) for r in R.search(asked, corpus, mode=mode).collect()} == {("q1", "d1"), ("q2", "d2"), ("q3", "d4"), ("q4", "d2")}


def test_phrases_of_chinese_fields(spark, corpus):
    found = R.phrase_search(queries(spark, "列車 旅", "solar power", "power solar home", "夜"), corpus)
    scores = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    assert set(scores) == {("q0", "d3"), ("q1", "d1"), ("q1", "d5"), ("q3", "d3")}
    one = {(r.query_id, r.doc_id): r.score for r in R.phrase_search(queries(spark, "列車 旅"), corpus, fields={"title": 3.0, "description": 1.0}).collect()}
    assert scores["q0", "d3"] > one["q0", "d3"]  # the Chinese field adds its clause


def test_hits_and_identity(spark, corpus):
    found = spark.createDataFrame([("q", "d1", 1.0, 1), ("q", "gone", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    assert {(r.doc_id, r.title) for r in R.hits(found, corpus).collect()} == {("d1", "Solar power at home"), ("gone", None)}
    assert scalars.expected_identity("en")["dims"] == 384
    with pytest.raises(KeyError):
        scalars.expected_identity("de")


def test_ingest_summary(spark):
    docs = spark.createDataFrame([("en", "en", False)] * 18 + [("zh", None, False), (None, "zh", True)], "alias string, language string, failed boolean")
    r = E.ingest_summary(docs).first()
    assert (r.indexes, r.languages, r.succeeded, r.failed, r.uncertain_rate, r.warning) == ({"en": 18, "zh": 1}, {"en": 18, "unknown": 1}, 19, 1, 0.05, False)
    assert E.ingest_summary(docs.limit(0)).first().uncertain_rate == 0.0


def test_an_index_answers_as_the_corpus_does(spark, corpus, tmp_path):
    from quillspark.operators.sinks import Store

    index = R.SearchIndex(Store(spark, str(tmp_path / "i")), "episodes")
    index.write(corpus, buckets=8)
    asked = queries(spark, "solar power", "夜間列車", "habit", "nothing here", "列車 旅")
    plain = lambda df: sorted((r.query_id, r.doc_id, r.rank, round(r.score, 9)) for r in df.collect())
    for mode in ("production", "evaluation"):
        assert plain(R.bm25(asked, index, mode=mode)) == plain(R.bm25(asked, corpus, mode=mode))
    assert plain(R.phrase_search(asked, index)) == plain(R.phrase_search(asked, corpus))
    assert "PartitionFilters: [" in index.postings(R.query_terms(asked))._jdf.queryExecution().toString()
    index.write(corpus.limit(0))
    assert R.bm25(asked, index).count() == 0


def wordy(spark, n=60):
    rng = random.Random(7)
    title = lambda: " ".join(rng.choice("the of sea night train home power 海 夜".split()) for _ in range(rng.randint(0, 6)))
    return spark.createDataFrame([(f"d{i}", "s", title(), title() + " " + title()) for i in range(n)], "doc_id string, show_id string, title string, description string")


@pytest.mark.parametrize("block_rows,chunk_rows", [(8192, 8192), (7, 4)])
def test_bm25_in_blocks_is_bm25_of_all_pairs(spark, block_rows, chunk_rows):
    corpus = wordy(spark)
    asked = corpus.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    terms, placed, stats = R._searched(asked, corpus, R.PRODUCTION)
    best = R.field_scores(terms, placed, stats).withColumn("score", F.col("score") * R._boost(R.PRODUCTION)).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    phrase = R.phrase_scores(asked, placed, stats, {"title": 2.0}).select("query_id", "doc_id", (F.col("score") * 2.0).alias("score"))
    want = R.top(best.unionByName(phrase).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), 5)
    found = R.top(R.bm25_blocks(asked, corpus, R.PRODUCTION, {"title": 2.0}, 5, block_rows=block_rows, blocks_a_task=2, chunk_rows=chunk_rows), 5)
    rows = lambda df: {(r.query_id, r.rank): (r.doc_id, round(r.score, 8)) for r in df.collect()}
    assert rows(found) == rows(want)


def test_pairs_of_a_common_word_are_not_shuffled(spark):
    corpus = wordy(spark)
    found = R.bm25(corpus.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")), corpus, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("block_rows", [16_384, 10])
def test_equal_neighbours_come_by_id(spark, block_rows):
    v = spark.createDataFrame([(f"d{i:02}", [1.0, 1.0]) for i in range(60, -1, -1)] + [("a", [1.0, 0.0])], "doc_id string, embedding array<float>")
    got = R.knn(v.where("doc_id = 'a'").withColumnRenamed("doc_id", "query_id"), v, 2, 3, block_rows=block_rows)
    assert ranked(got) == [("a", "d00"), ("a", "d01"), ("a", "d02")]


def shuffled(spark, run):
    """Bytes that the stages of a run write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    written = lambda: sum(x.shuffleWriteBytes() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    wait()
    before = written()
    run()
    wait()
    return written() - before


def test_vectors_of_the_corpus_are_not_shuffled(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(3000, 384)).astype("f4")
    spark.createDataFrame([(f"d{i}", r.tolist()) for i, r in enumerate(x)], "doc_id string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    got = []
    size = shuffled(spark, lambda: got.extend(R.knn(v.where("doc_id < 'd1002'").withColumnRenamed("doc_id", "query_id"), v, 384, 3, chunk_rows=5).collect()))
    assert size < x.nbytes / 4
    c = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    asked = sorted({r.query_id for r in got})
    assert len(asked) == 6
    for q in asked:
        s = c @ c[int(q[1:])]
        assert {r.doc_id for r in got if r.query_id == q} == {f"d{i}" for i in np.argsort(-s)[1:4]}


def test_texts_are_not_shuffled_for_each_chunk_of_queries(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{i}", "s", f"t{i} night", " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id string, show_id string, title string, description string").write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    asked = corpus.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    one, many = (shuffled(spark, lambda n=n: R.bm25_blocks(asked, corpus, R.PRODUCTION, {"title": 2.0}, 1, chunk_rows=n).collect()) for n in (400, 40))
    assert many < 1.5 * one


def test_one_vector_of_an_id_and_none_without(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("b", [1.0, 0.1]), ("c", [float("nan"), 1.0]), ("c", [0.0, 1.0]), (None, [1.0, 0.0]), ("e", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    assert ranked(R.knn(v.where("doc_id = 'a'").withColumnRenamed("doc_id", "query_id"), v, 2, 5)) == [("a", "b"), ("a", "c")]
    assert R.knn(v.where("doc_id = 'z'").withColumnRenamed("doc_id", "query_id"), v, 2, 5).count() == 0
    assert R.bm25(queries(spark).limit(0), v.select("doc_id", F.lit("s").alias("show_id"), F.lit("x").alias("title"), F.lit("x").alias("description")), 5).count() == 0


def test_stability_shuffles_no_texts_of_the_corpus(spark, tmp_path):
    rng = random.Random(4)
    marks = "!?#%&/()=+*~<>|;:,.-"
    rows = [(f"episode:apple:1:{i}", "show:apple:1", f"night train {i}", "".join(rng.choice(marks) for _ in range(1000)) + " lamp") for i in range(2000)]
    spark.createDataFrame(rows + rows[:20], "episode_id string, show_id string, title string, description string").write.parquet(str(tmp_path / "episodes.parquet"))
    spark.createDataFrame([(i, f"episode:apple:1:{i}", [1.0] * 384) for i in range(0, 300, 50)], "vec_id long, episode_id string, embedding array<float>").write.parquet(str(tmp_path / "episode_vectors.parquet"))
    got = []
    size = shuffled(spark, lambda: got.extend(EQ.stability(spark, str(tmp_path)).collect()))
    assert size < 1000 * len(rows) / 4
    assert {r.query_id for r in got} == {f"episode:apple:1:{i}" for i in (0, 100, 200)}


@pytest.mark.parametrize("most", [R.BROADCAST_ROWS, 0])
def test_distinct_rows_are_those_of_distinct(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_ROWS", most)
    rows = [("s", "a", "x"), ("s", "a", "x"), ("s", "a", "y"), ("s", "b", None), ("s", "b", None), (None, "c", "x"), ("s", None, "x"), ("s", None, "x"), (None, None, None), ("t", "d", "x")]
    df = spark.createDataFrame(rows, "show_id string, doc_id string, title string")
    assert sorted(map(repr, R.distinct_rows(df, "doc_id").select(df.columns).collect())) == sorted(map(repr, df.distinct().collect()))
