import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import language, mixing, neighbors, packing, quality, standing_lines, visual_form

VEC = "vec_id bigint, embedding array<float>"


def clustered(n, dims=32, clusters=20, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dims))
    return centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * 0.35


# most similar vectors


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("rows", [None, 1 << 23])
def test_neighbours_recall(spark, rows):
    x = clustered(1500)
    got = neighbors.nearest_neighbors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC), "vec_id", "embedding", 32, 10, expected_rows=rows).toPandas()
    want = exact(x.astype("f4"), 10)
    hits = sum(len(set(g.neighbor) & set(want[i])) for i, g in got.groupby("vec_id"))
    assert hits / want.size > 0.97
    assert (got.groupby("vec_id").size() == 10).all() and got.vec_id.nunique() == 1500 and (got.vec_id != got.neighbor).all()


def test_substrings_cover_the_code(spark):
    assert {b for _, b in neighbors._plan(1 << 23)} == {16}
    for n in (100, 112_632, 1 << 23, 10**9):
        plan = neighbors._plan(n)
        assert [a for a, _ in plan] == np.cumsum([0, *(b for _, b in plan)])[:-1].tolist() and sum(b for _, b in plan) == 192
        words = [0x0123456789ABCDEF, -0x0123456789ABCDE1, 0x7EDCBA9876543210]
        code = sum((w & (1 << 64) - 1) << 64 * i for i, w in enumerate(words))
        row = spark.createDataFrame([tuple(words)], "c0 bigint, c1 bigint, c2 bigint").select(*(neighbors._substring(*x).alias(f"s{i}") for i, x in enumerate(plan))).first()
        assert list(row) == [code >> a & (1 << b) - 1 for a, b in plan]


def test_exact_neighbours(spark):
    x = clustered(700)
    got = neighbors.nearest_neighbors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC), "vec_id", "embedding", 32, 5, exact=True).toPandas()
    want = exact(x.astype("f4"), 5)
    assert all(set(g.neighbor) == set(want[i]) for i, g in got.groupby("vec_id"))


def test_neighbours_when_buckets_and_groups_are_split(spark):
    x = clustered(1200, clusters=2)
    got = neighbors.nearest_neighbors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC), "vec_id", "embedding", 32, 5, bucket_rows=100, group_rows=150).toPandas()
    assert got.vec_id.nunique() == 1200 and got.groupby("vec_id").size().min() >= 1


def test_neighbours_in_a_topic_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x, n = clustered(1500, clusters=60, seed=3), 500
    x[:n] = rng.normal(size=32) * 3 + rng.normal(size=(n, 32))
    got = neighbors.nearest_neighbors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC), "vec_id", "embedding", 32, 5, bucket_rows=32, group_rows=32).toPandas()
    want = exact(x.astype("f4"), 5)
    hits = [len(set(g.neighbor) & set(want[i])) / 5 for i, g in got.groupby("vec_id") if i < n]
    assert sum(hits) / n > 0.98
    assert got.groupby("vec_id").size().max() <= 5 and not got.duplicated(["vec_id", "neighbor"]).any()


def test_blocks_let_all_pieces_meet():
    label, piece, pieces = np.full(9, 7), np.array([0, 0, 1, 2, 3, 3, 0, 1, 2]), np.array([4] * 6 + [1] * 3)
    piece[6:] = 0
    gids, at = neighbors._blocks(label, piece, pieces)
    groups = [set(at[gids == g]) for g in np.unique(gids)]
    assert all(any({a, b} <= g for g in groups) for a in range(6) for b in range(6)) and {6, 7, 8} in groups


def test_neighbours_are_the_same_in_turns(spark, monkeypatch):
    """Above BROADCAST_ROWS vectors are packed before they are joined, and groups are reranked in turns."""
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(clustered(600, 48))], "vec_id bigint, embedding array<float>")
    rows = lambda: {(r.vec_id, r.neighbor, round(r.similarity, 5)) for r in neighbors.nearest_neighbors(v, "vec_id", "embedding", 48, 5).collect()}
    want, seen = rows(), []
    monkeypatch.setattr(neighbors, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neighbors, "_spread", lambda turn, turns, f=neighbors._spread: (seen.append(turn), f(turn, turns))[1], raising=False)
    assert rows() == want
    assert seen == list(range(len(seen))) and len(seen) > 1


def test_neighbours_copies_and_bad_rows(spark):
    x = clustered(300)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(150)] + [(5, x[5].tolist())]
    rows += [(2000, None), (2001, [1.0]), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] * 32), (None, x[1].tolist()), (2005, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame(rows, VEC).withColumn("neighbor", F.lit("clash"))
    got = neighbors.nearest_neighbors(df, "vec_id", "embedding", 32, 10).toPandas()
    assert not set(got.vec_id) & set(range(2000, 2006)) and not set(got.neighbor) & set(range(2000, 2006))
    assert sorted(got[got.vec_id == 1100].neighbor) == [0, *range(1000, 1009)]
    assert sorted(got[got.vec_id == 0].neighbor) == list(range(1000, 1010))
    assert (got.groupby("vec_id").size() <= 10).all() and not got.duplicated(["vec_id", "neighbor"]).any()


@pytest.mark.parametrize("scan_rows", [4096, 0])
def test_neighbours_without_clusters(spark, monkeypatch, scan_rows):
    monkeypatch.setattr(neighbors, "SCAN_ROWS", scan_rows)
    x = np.random.default_rng(2).normal(size=(800, 32))
    got = neighbors.nearest_neighbors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC), "vec_id", "embedding", 32, 5).toPandas()
    assert got.vec_id.nunique() == 800 and (got.groupby("vec_id").size() == 5).all()
    want = exact(x.astype("f4"), 5)
    assert np.mean([len(set(g.neighbor) & set(want[i])) / 5 for i, g in got.groupby("vec_id")]) > 0.2


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], VEC)
    assert neighbors.nearest_neighbors(empty, "vec_id", "embedding", 32).count() == 0
    assert neighbors.nearest_neighbors(spark.createDataFrame([(1, [1.0] * 32)], VEC), "vec_id", "embedding", 32).count() == 0


@pytest.mark.parametrize("steps", [2, 20, 300, None])
def test_values_lose_nothing(steps):
    x = clustered(50).astype("f4")
    if steps:
        x = (np.round(x * steps) / np.float32(steps)).astype("f4")
    values = neighbors.Values(x[:40], 32)
    assert bool(len(values.known)) == bool(len(np.unique(x[:40])) <= 1 << 14)
    want = x / np.sqrt((x.astype("f8") ** 2).sum(axis=1))[:, None].astype("f4")
    assert (values.reader(values.pack(x))(np.arange(50)) == want).all()
    mixed = np.where(np.arange(50)[:, None] % 7, x, x + np.float32(0.01234))
    back = values.reader(values.pack(mixed))(np.arange(50)[::-1])[::-1]
    assert (back == mixed / np.sqrt((mixed.astype("f8") ** 2).sum(axis=1))[:, None].astype("f4")).all()


# standing lines


def shows(spark, texts, source="s"):
    return spark.createDataFrame([(source, f"e{i}", t) for i, t in enumerate(texts)], "source string, doc string, text string")


def places(df):
    return df.withColumn("places", F.lit(None).cast("array<bigint>"))


def test_standing_lines(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    line = "Follow US at no."
    texts = [f"Own line about {w}\n<p>{line} {i}!</p>\n\n12:30" for i, w in enumerate(words)] + ["Fo llow u s at NO", None, ""]
    want = {(f"e{i}", 1) for i in range(10)} | {("e10", 0)}
    df = shows(spark, texts)
    assert {(r.doc, r.line_no) for r in standing_lines.find_repeated_lines(places(df).dropna(subset=["text"])).collect()} == want
    # The own lines differ in one word only, so one template covers them.
    got = {(r.doc, r.line_no): r.template for r in standing_lines.find_standing_lines(df, "source", "doc", "text").collect()}
    assert set(got) >= want and got["e4", 0] == "own line about *"
    own = shows(spark, [f"{w} {w}s {w}t\n<p>{line} {i}!</p>\n\n12:30" for i, w in enumerate(words)] + [None, ""])
    clean = {r.doc: r.cleaned_text for r in standing_lines.remove_standing_lines(own, "source", "doc", "text").collect()}
    assert clean["e0"] == "alpha alphas alphat\n\n12:30" and clean["e10"] is None and clean["e11"] == ""


def test_bounds_of_repetition(spark):
    few = shows(spark, ["same line here"] * 4)
    assert standing_lines.find_standing_lines(few, "source", "doc", "text").count() == 0
    rare = shows(spark, ["same line here"] * 5 + [f"line {'abcdefghijklmnopqrstuvwxyz'[i]} other" for i in range(20)])
    assert standing_lines.find_standing_lines(rare, "source", "doc", "text").count() == 0
    copies = few.unionAll(few).unionAll(few)
    assert standing_lines.find_standing_lines(copies, "source", "doc", "text").count() == 0
    assert standing_lines.find_standing_lines(few.limit(0), "source", "doc", "text").count() == 0
    nulls = shows(spark, ["same line here"] * 6, None)
    assert standing_lines.find_standing_lines(nulls, "source", "doc", "text").count() == 0


def test_templates_have_slots():
    tree = standing_lines.Tree()
    lines = [x.split() for x in ("this show is made by anna in town", "this show is made by bob in town", "this show is made by carol in towns", "this show has nothing to do with it", "this show")]
    assert [tree.add(x) for x in lines] == [0, 0, 0, 1, 2] and " ".join(tree.templates[0]) == "this show is made by * in *"
    assert tree.add("this show * * by dora at home".split()) == 3  # fewer than half would stay
    assert standing_lines.covers(tree.templates[0], lines[1]) and not standing_lines.covers(tree.templates[0], lines[3])


def test_many_unlike_lines_in_one_leaf():
    rng, tree = random.Random(0), standing_lines.Tree()
    lines = [["same", "head", *(str(rng.randint(0, 10**6)) for _ in range(9))] for _ in range(3000)]
    at = [tree.add(x) for x in lines]
    assert len(tree.templates) == 3000 and [tree.add(x) for x in lines[:50]] == at[:50]


NAMES = "anna bob carol dora emil fritz gina hugo ida jan".split()


def test_lines_with_a_varying_name_are_standing(spark):
    texts = [f"Own {w} thing number {w}\nThis show is made by {w} in town" for w in NAMES]
    got = standing_lines.find_standing_lines(shows(spark, texts), "source", "doc", "text").collect()
    assert {(r.doc, r.line_no, r.template) for r in got} == {(f"e{i}", 1, "this show is made by * in town") for i in range(10)}
    clean = {r.doc: r.cleaned_text for r in standing_lines.remove_standing_lines(shows(spark, texts), "source", "doc", "text").collect()}
    assert clean["e3"] == "Own dora thing number dora"
    rows = places(shows(spark, texts))
    assert standing_lines.find_repeated_lines(rows).count() == 0  # no two have the same letters


def test_trees_decide(spark, monkeypatch):
    texts = [f"This show is made by {w} in town\nThe same line ends it" for w in NAMES]
    rows = places(shows(spark, texts))
    found = lambda: (standing_lines.find_standing_lines(shows(spark, texts), "source", "doc", "text").count(), standing_lines.find_repeated_lines(rows).count())
    assert found() == (20, 10)
    monkeypatch.setattr(standing_lines, "covered_lines", lambda r: r.where("kind = 'line'").select("source", "doc", "line_no", "key", F.lit("x").alias("template")).limit(0))
    assert found() == (0, 0)


@pytest.mark.parametrize("bucket_docs", [3, 17, 4096])
def test_a_hot_source_in_buckets(spark, bucket_docs):
    rng = random.Random(4)
    texts = []
    for i in range(200):
        lines = ["".join(rng.choice("abcdefgh") for _ in range(6)) + " own words of it " + "".join(rng.choice("abcdefgh") for _ in range(6))]
        lines += [f"brought to you by our friends at {rng.choice(NAMES)}"] * (i % 3 == 0) + ["Fol low us" if i % 2 else "follow us."] * (i % 4 < 2) + ["rare line here"] * (i % 10 == 0)
        texts.append("\n".join(lines))
    df = shows(spark, texts)
    rows = places(df)
    exact = {(r.doc, r.line_no) for r in standing_lines.find_repeated_lines(rows, bucket_docs=bucket_docs).collect()}
    want = {(f"e{i}", no) for i, t in enumerate(texts) for no, x in enumerate(t.split("\n")) if "us" in x and "ow" in x}
    assert exact == want
    got = {(r.doc, r.line_no) for r in standing_lines.find_standing_lines(df, "source", "doc", "text", bucket_docs=bucket_docs).collect()}
    named = {(f"e{i}", no) for i, t in enumerate(texts) for no, x in enumerate(t.split("\n")) if x.startswith("brought")}
    assert named <= got and not any("rare" in texts[int(d[1:])].split("\n")[n] for d, n in got)


# language labels

EN = "The people of the town wanted to talk about the weather and what it costs when nobody is watching the show"
SAMPLES = {
    "en": EN, "de": "Die Leute der Stadt wollten über das Wetter sprechen und was es kostet wenn niemand die Sendung schaut", "fr": "Les gens de la ville voulaient parler du temps et de ce que cela coûte quand personne ne regarde",
    "es": "La gente de la ciudad quería hablar del tiempo y de lo que cuesta cuando nadie está mirando el programa", "ja": "町の人々は天気について話したいと思っていました。誰も見ていないときの費用についても考えます", "zh-tw": "這個城市的人們想要討論天氣以及沒有人觀看節目時的費用，聽眾對這個問題很有興趣", "zh-cn": "这个城市的人们想要讨论天气以及没有人观看节目时的费用，听众对这个问题很有兴趣",
}


def fitted(spark):
    rows = [(t, k) for k, t in SAMPLES.items() for _ in range(3)] + [(EN + " again", "de"), (None, "en"), ("", "fr"), ("x", None)]
    return language.fit_profiles(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")


def test_languages(spark):
    p = fitted(spark)
    assert list(p.classify(list(SAMPLES.values()))[0]) == list(SAMPLES)
    docs = spark.createDataFrame([(1, f"{EN}\nhttps://x.example/a\n\n12:30\n{SAMPLES['de']}\n{EN}\n歡迎收聽《The Town Show》這個節目的人們"), (2, None), (3, ""), (4, "12 34"), (4, "12 34")], "id int, text string")
    out = sorted(language.with_languages(docs.withColumn("language_found", F.lit(0)), "text", p).collect(), key=lambda r: r.id)
    found = out[0].language_found_1
    assert found.main == "en" and found.langs == ["en", None, None, None, "de", "en", "zh-tw"] and 0 < found.confidence <= 1
    assert [r.language_found_1.main for r in out[1:]] == [None] * 4


def test_long_text_and_nothing(spark):
    p = fitted(spark)
    assert p.classify([EN * 3000])[0][0] == "en" and len(p.classify([])[0]) == 0
    empty = language.fit_profiles(spark.createDataFrame([], "text string, lang string"), "text", "lang")
    assert list(empty.classify(["x"])[0]) == [None]


TAGS = [("en-US", "en"), ("EN", "en"), ("zh-Hans", "zh-cn"), ("zh_CN", "zh-cn"), ("zh", "zh-tw"), ("zh-Hant", "zh-tw"), ("und", None), (" ", None), (None, None), ("ja-JP", "ja")]


@pytest.mark.parametrize("tag,want", TAGS)
def test_tags(spark, tag, want):
    assert spark.createDataFrame([(tag,)], "t string").select(language.tag_language(F.col("t")).alias("l")).first().l == want


# canonical form

SAME = [
    ("ｃａｒｅｓ", "cares"), ("abou﻿t", "about"), ("Ϲafе́", "Café"), ("a  b　", "a b"), ("ﬁn", "fin"), ("⼭", "山"), ("ｶﾞ", "ガ"), ("arcһіves", "archives"), ("co­op", "coop"), ("x\r\ny", "x\ny"), ("a‑b", "a-b"), ("不", "不"),
    ("각", "각"),
]
APART = [("A", "a"), ("e", "é"), ("x²", "x2"), ("½", "1/2"), ("a.b", "a,b"), ("ab", "a b"), ("①", "1")]


@pytest.fixture(scope="module")
def canonical(spark):
    return visual_form.Canonical(visual_form.lookalikes(spark))


@pytest.mark.parametrize("a,b", SAME)
def test_equal_looks(canonical, a, b):
    assert canonical(a) == canonical(b) == b


@pytest.mark.parametrize("a,b", APART)
def test_different_looks(canonical, a, b):
    assert canonical(a) != canonical(b)


OTHER_SCRIPTS = ["по", "ос", "Это слово по русски", "ΕΛΛΑΣ", "Το όνομα και ο λόγος", "We say по and слово there", "κόσμος"]


@pytest.mark.parametrize("text", OTHER_SCRIPTS)
def test_words_of_other_scripts_stay(canonical, text):
    assert canonical(text) == text


def test_a_word_of_lookalikes_in_a_latin_line(canonical):
    assert canonical("Live ЕР42 аt nоon, а day") == "Live EP42 at noon, a day"
    assert canonical("\u0395\u042073 從山間") == "EP73 從山間"  # Greek and Cyrillic in one word
    assert canonical("Слово\nраir оf it") == "Слово\npair of it"


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=30), st.text(alphabet=st.sampled_from("aаеоopР\u0301\u0300Ѐсω αά ſﬁ\n"), max_size=30)))
def test_canonical_is_stable(canonical, text):
    once = canonical(text)
    assert canonical(once) == once


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.characters(codec="ascii", min_codepoint=33), max_size=40))
def test_plain_text_is_untouched(canonical, text):
    assert canonical(text) == text


def test_texts_that_stay_in_the_jvm_are_stable(spark, canonical):
    texts = ["plain", "two  spaces", " edge", "edge ", "line \nend", "tab\tin", "ＷＩＤＥ", "Café", "Cafе", "不", "é\u0301", "x\u200by", "ok\nfine", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in rows.select(visual_form.canonical_form(spark)(F.col("t")).alias("c")).collect()] == [canonical(t) for t in texts]


def test_classes_and_pairs(spark):
    rows = [("g", "b", "Café"), ("g", "a", "Cafe\u0301"), ("g", "c", "Café"), ("h", "d", "Cafe\u0301"), ("g", "e", None), (None, "f", "Café"), ("g", "a", "Cafe\u0301"), ("g", "x", "y" * 50_000), ("g", "z", "")]
    df = spark.createDataFrame(rows, "g string, k string, t string")
    classes = visual_form.lookalike_classes(df, ["g"], "k", "t")
    assert {(r.g, r.key) for r in classes.collect()} == {("g", "a"), ("g", "b"), ("g", "c")} and classes.select("form").distinct().count() == 1 and classes.select("variant").distinct().count() == 2
    assert {(r.key_a, r.key_b) for r in visual_form.lookalike_pairs(classes, ["g"]).collect()} == {("a", "b"), ("a", "c")}
    assert visual_form.lookalike_classes(df.limit(0), ["g"], "k", "t").count() == 0
    out = visual_form.with_canonical_form(df.withColumn("Canonical", F.lit(1)), "t")
    assert out.columns[-1] == "canonical_1" and out.count() == len(rows)


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_best_fit_and_bound(sizes):
    s = np.array(sizes)
    bins, starts = packing.best_fit_decreasing(s, 100)
    fill = np.bincount(bins, s)
    assert fill.max() <= 100 and len(fill) >= packing.lower_bound(s, 100) >= math.ceil(s.sum() / 100)
    for b in range(len(fill)):
        at = sorted((starts[i], s[i]) for i in np.flatnonzero(bins == b))
        assert all(a + n == c for (a, n), (c, _) in zip(at, at[1:])) and at[0][0] == 0
    assert len(fill) <= packing.lower_bound(s, 100) * 11 / 9 + 1


def test_pack_documents(spark):
    rng = random.Random(3)
    sizes = {i: rng.randint(1, 120) for i in range(3000)} | {9000: 250, 9001: 100, 9002: 200}
    rows = [*sizes.items(), (5, sizes[5]), (9100, None), (9101, 0), (None, 7)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, n bigint"), "doc_id", F.col("n"), 100, pool_items=100).toPandas()
    assert got.groupby("doc_id").tokens.sum().to_dict() == sizes
    fill = got.groupby("bin_id").tokens.sum()
    assert fill.max() <= 100 and len(fill) <= 1.03 * math.ceil(sum(sizes.values()) / 100)
    assert set(got[got.oversized].doc_id) == {d for d, n in sizes.items() if n > 100}
    assert (got[~got.oversized].groupby("doc_id").size() == 1).all() and not got.duplicated(["doc_id", "part"]).any()


def test_bound_of_counts():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 500)
    distinct, n = np.unique(sizes, return_counts=True)
    assert packing.lower_bound(distinct, 100, n) == packing.lower_bound(sizes, 100)


def test_packing_is_near_its_bound_whatever_the_partitions(spark):
    rng = random.Random(5)
    sizes = {i: min(int(rng.lognormvariate(5.5, 1.2)) + 1, 9000) for i in range(6000)}
    df, reports = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n bigint"), set()
    try:
        for partitions in (4, 16, 64, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            reports.add(tuple(packing.packing_report(packing.pack_documents(df, "doc_id", F.col("n"), pool_items=2000, tolerance=0.002)).first()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(reports) == 1
    docs, pieces, tokens, bins, bound, used, least, most = reports.pop()
    assert (docs, tokens) == (6000, sum(sizes.values())) and most <= 4096 and bound <= bins <= bound * 1.005 and used > 0.99
    assert packing.global_bound(packing._pieces(df, "doc_id", F.col("n"), 4096), 4096)[1] == bound


def test_pack_nothing(spark):
    packed = packing.pack_documents(spark.createDataFrame([], "doc_id bigint, n bigint"), "doc_id", F.col("n"), 100)
    assert packed.count() == 0 and packing.packing_report(packed, 100).first().bins == 0


# mixing


def mixed(spark, n=4000, hot=0.5):
    rng = random.Random(1)
    docs = [(i, "a" if rng.random() < hot else "b", rng.randint(1, 50), 1.0 + i % 3) for i in range(n)] + [(90_000 + i, "small", 10, 1.0) for i in range(5)]
    docs += [(90_100, None, 5, 1.0), (90_101, "unlisted", 5, 1.0), (90_102, "a", None, 1.0), (0, docs[0][1], docs[0][2], 1.0)]
    targets = [("a", 0.3, 1), ("b", 0.6, 4), ("small", 0.1, 3), ("none", 0.0001, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, n bigint, w double"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("per_range", [100_000, 300])
def test_mixing(spark, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", per_range)
    docs, targets = mixed(spark)
    rep = {r.source: r for r in mixing.mix_report(docs, targets, F.col("n"), F.col("w")).collect()}
    picked = mixing.mix_sources(docs, targets, F.col("n"), F.col("w")).toPandas()
    assert not picked.doc_id.duplicated().any() and set(picked.source) <= {"a", "b", "small"}
    for s, cap in (("a", 1), ("b", 4), ("small", 3)):
        mine = picked[picked.source == s]
        assert mine.repeats.max() <= cap and mine.repeats.max() - mine.repeats.min() <= 1
        want = min(rep[s].budget, cap * rep[s].size)
        assert abs((mine.tokens * mine.repeats).sum() - want) <= 50
    assert (rep["small"].short, rep["none"].short, rep["b"].short) == (True, True, False)
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    # What the short sources leave goes to the others by their shares.
    level = sum(r.size for r in rep.values()) * (0.3 + 0.6 + 0.1 + 0.0001) - 3 * rep["small"].size
    assert [rep[s].budget for s in "ab"] == [pytest.approx(level * w / 0.9, rel=1e-3) for w in (0.3, 0.6)]


def test_ranges_of_skewed_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 200)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") % 100 == 0, 50.0).otherwise(0.01 + F.col("id") % 7 / 1000).alias("w"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    keyed = mixing.mix_sources(docs, targets, F.col("n"), F.col("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in keyed
    _, plan = mixing._sized(docs, targets, F.col("n"), F.col("w"))
    p = plan.first()
    u = np.random.default_rng(0).random(4000)
    w = np.array([r.w for r in docs.select("w").collect()])
    key = -np.log(u) / w
    below = sum(x.docs * (1 - np.exp(-key * x.weight)) for x in p.weights) / p.docs
    assert p.ranges == 20 and np.bincount(np.minimum((below * 20).astype(int), 19), minlength=20).max() < 300


def test_mixing_is_the_same_in_ranges(spark, monkeypatch):
    docs, targets = mixed(spark)
    pick = lambda: set(map(tuple, mixing.mix_sources(docs, targets, F.col("n"), F.col("w")).select("doc_id", "repeats").collect()))
    whole = pick()
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 250)
    assert pick() == whole


def test_mixing_nothing(spark):
    docs, targets = mixed(spark, 10)
    assert mixing.mix_sources(docs.limit(0), targets, F.col("n"), F.col("w")).count() == 0
    assert mixing.mix_report(docs.limit(0), targets, F.col("n"), F.col("w")).where("short").count() == 0


# text quality

TEXTS = [
    "One sentence stands here, and it ends with a stop.\n- item one\n- item two\n\n| a | b |\n<p>What would it be? It was <span class=\"n\">fine</span> for all of us.</p>",
    "話題は静かに変わり始めています。\n手工陶器\n1;古地图;青岭镇;1694;60.4%\nnaïve café   x      y      z\n" + "QUJD" * 40,
    '<a href="https://x.example/' + "p" * 180 + '">a link</a> with a long tag, and ' + "w" * 700 + " a long word.\n\r\n" + "    12.) 2 < 3 > 1 (quoted.”) <" + "b" * 400 + "> end",
]
MODEL = quality.LineModel(quality.features_of())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 300])
def test_states_add_up_over_every_cut(text, chunk):
    whole = quality.State.of(text, MODEL).finish(MODEL).tolist()
    for shift in range(min(chunk, 40)):
        parts = [quality.State.of(p, MODEL, a, z) for _, p, a, z in quality.cut(text[:shift], chunk)] if shift else []
        rest = [(max(0, a - quality.MARGIN), a, min(len(text), a + chunk)) for a in range(shift, len(text), chunk)]
        parts = [quality.State.of(text[max(0, -quality.MARGIN) : shift + quality.MARGIN], MODEL, 0, shift)] if shift else []
        parts += [quality.State.of(text[low : z + quality.MARGIN], MODEL, a - low, z - low) for low, a, z in rest]
        assert quality.merged(list(parts), MODEL).finish(MODEL).tolist() == whole
        left = parts[0]
        for p in parts[1:]:
            left = left.merge(p, MODEL)
        assert left.finish(MODEL).tolist() == whole


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab <>/.,;!-1|\n\t\"'é話。"), max_size=900), st.integers(1, 400))
def test_states_add_up_over_any_text(text, chunk):
    whole = quality.State.of(text, MODEL).finish(MODEL).tolist()
    parts = [quality.State.of(p, MODEL, a, z) for _, p, a, z in quality.cut(text, chunk)] or [quality.State.of("", MODEL)]
    assert quality.merged(parts, MODEL).finish(MODEL).tolist() == whole


def test_chunked_documents_equal_whole_ones(spark):
    big = "\n".join(TEXTS * 40)
    docs = spark.createDataFrame([(1, big), (2, TEXTS[0]), (2, TEXTS[0]), (3, None), (4, ""), (5, "   \n "), (6, "x" * 3000), (1, big)], "id int, t string").withColumn("words", F.lit(1))
    rows = quality.text_statistics(docs, "id", "t", chunk=700, fan_in=4).collect()
    whole = {r.id: r for r in quality.text_statistics(docs, "id", "t").collect()}
    assert sorted(r.id for r in rows) == [1, 1, 2, 2, 3, 4, 5, 6]
    for r in rows:
        assert r == whole[r.id]
    assert (whole[3].is_prose, whole[4].is_prose, whole[5].is_prose) == (None, None, None) and whole[3].words is None and whole[5].words == 0
    assert quality.text_statistics(docs.limit(0), "id", "t").count() == 0


def test_counts_of_lines():
    lines, doc = quality.lines_of_texts(["The cat and 12 dogs ran.\n\n<b>Die</b> Katze", "a|b\tc"])
    c = dict(zip(quality.COUNTS, quality._counts(lines, MODEL).T.tolist()))
    assert doc.tolist() == [0, 0, 0, 1] and c["lines"] == [1, 0, 1, 1] and c["stopped_lines"] == [1, 0, 0, 0]
    assert c["words"] == [6, 0, 2, 2] and c["common_words"] == [2, 0, 1, 1] and c["solid_chars"] == [19, 0, 8, 4] and c["digits"] == [2, 0, 0, 0]
    assert c["prose_chars"] == [19, 0, 0, 0]  # the rule alone


def test_model_learns_from_labels_of_documents(spark):
    rng = random.Random(0)
    words = "river stone window garden letter morning island paper silver music".split()
    prose = lambda: f"The {rng.choice(words)} was near the {rng.choice(words)} when we came to the {rng.choice(words)}"  # noqa: E731, no terminal mark
    other = lambda: f"{rng.choice(words)};{rng.randint(1, 99)};{rng.choice(words)}"
    rows = [(i, "\n".join(prose() if i % 2 else other() for _ in range(4)), bool(i % 2)) for i in range(120)] + [(500, None, True), (501, "x", None), (502, "", False)]
    labelled = spark.createDataFrame(rows, "doc_id int, text string, is_prose boolean")
    model = quality.fit_line_model(labelled, "doc_id", "text", "is_prose")
    assert model.prose(quality.Pieces.of("\n".join(prose() for _ in range(50)))).mean() > 0.9 and model.prose(quality.Pieces.of("\n".join(other() for _ in range(50)))).mean() < 0.1
    none = quality.fit_line_model(labelled.limit(0), "doc_id", "text", "is_prose")
    assert none.prose(quality.Pieces.of("One short sentence stands right here.\nno end here")).tolist() == [True, False]


def test_labels_of_a_bucket_do_not_depend_on_the_order_of_its_rows():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**62, (300, 3), dtype="i8")
    codes[1::3] = codes[::3] ^ 1  # a third has one near code, a third is that code
    columns = [np.zeros(300, "i4"), np.arange(300, dtype="i8") // 100, np.zeros(300, "i8"), rng.permutation(300).astype("i8"), *codes.T]
    found = []
    for order in (np.arange(300), np.arange(300)[::-1], rng.permutation(300)):
        batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[order])) for c in columns], ["t", "key", "sub", "cid", "c0", "c1", "c2"])
        found.append({r["cid"]: r for b in neighbors._label_buckets(30, 256)(iter([batch])) for r in b.to_pylist()})
    assert found[0] == found[1] == found[2]
    assert any(r["label"] is None for r in found[0].values())
