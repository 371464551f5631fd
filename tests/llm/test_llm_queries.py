import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries as Q

from ..oracle import assert_same, connect

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    assert_same(Q.queries()[name](spark, small).toPandas(), connect(small).execute(SQL[name]).df())


@pytest.mark.parametrize("name,columns", [("p1_found", ["vec_a", "vec_b"]), ("p4_found", ["tab", "rec_id", "lang"]), ("p5_found", ["field", "key_a", "key_b"]), ("p8_found", ["doc_id"])])
def test_columns(spark, small, name, columns):
    got = Q.queries()[name](spark, small)
    assert got.columns == columns
    rows = got.collect()
    assert rows and len(set(rows)) == len(rows)


def test_neighbours_against_brute_force(spark, small):
    t = spark.read.parquet(f"{small}/episode_vectors.parquet").select("vec_id", "embedding").toPandas().drop_duplicates("vec_id")
    t = t[t.embedding.map(lambda v: v is not None and len(v) == 384 and np.isfinite(v).all() and np.any(v))]
    x = np.stack(t.embedding.to_numpy()).astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    ids = t.vec_id.to_numpy()
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in np.argsort(-s[i])[:10]}
    got = {tuple(r) for r in Q.queries()["p1_found"](spark, small).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


@pytest.mark.parametrize("name", ["p7_found", "p7_plan", "p7_mix"])
def test_the_mix_is_made(spark, small, name):
    plan = Q.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "LN(" in plan.upper().replace("LOG(", "LN(")


def test_what_the_mix_took(spark, small):
    plan = {r.source: r for r in Q.queries()["p7_plan"](spark, small).collect()}
    mix = {r.source: r for r in Q.queries()["p7_mix"](spark, small).collect()}
    repeats = {r.source: r.max_repeats for r in spark.read.parquet(f"{small}/mix_targets.parquet").collect()}
    longest = spark.read.parquet(f"{small}/documents.parquet").agg(F.max(F.octet_length("text"))).first()[0] + 1
    assert set(plan) == set(mix) and sum(r.actual_share for r in mix.values()) == pytest.approx(1)
    for s, r in mix.items():
        assert abs(r.mixed_tokens - r.budget) <= longest and r.budget <= repeats[s] * plan[s].size
        if plan[s].short:
            assert r.budget == repeats[s] * plan[s].size


def test_prose_verdicts_against_labels(spark, small):
    labels = spark.read.parquet(f"{small}/doc_labels.parquet").toPandas()
    found = {r.doc_id for r in Q.queries()["p8_found"](spark, small).collect()}
    assert np.mean([(d in found) != p for d, p in zip(labels.doc_id, labels.is_prose)]) > 0.95


def test_languages_of_lines(spark, small):
    rows = Q.queries()["p4_languages"](spark, small).toPandas()
    assert list(rows.columns) == ["episode_id", "line_no", "lang", "confidence"] and not rows.duplicated().any()
    told = rows[rows.lang.notna()]
    assert len(told) and told.confidence.between(0, 1).all() and set(told.lang) <= {"de", "en", "es", "fr", "ja", "zh-cn", "zh-tw"}
    described = spark.read.parquet(f"{small}/episodes.parquet").where("description is not null").select("episode_id").distinct().count()
    assert rows[rows.line_no.isna()].episode_id.nunique() == described


def test_classes_hold_the_pairs(spark, small):
    classes = Q.queries()["p5_classes"](spark, small).toPandas()
    assert list(classes.columns) == ["field", "show_id", "episode_id", "form", "variants"] and (classes.variants >= 2).all()
    pairs = {(r.field, k) for r in Q.queries()["p5_found"](spark, small).where("field <> 'query'").collect() for k in (r.key_a, r.key_b)}
    assert pairs == set(zip(classes.field, classes.episode_id))


def test_packing_report(spark, small):
    r = Q.queries()["p6_packing"](spark, small).first()
    sizes = [x.n + 1 for x in spark.read.parquet(f"{small}/documents.parquet").where("text <> ''").select(F.octet_length("text").alias("n")).collect()]
    assert (r.documents, r.tokens) == (len(sizes), sum(sizes)) and r.bound <= r.bins <= r.bound * 1.005 + 1 and r.most_fill <= 4096
