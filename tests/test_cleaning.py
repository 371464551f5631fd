import pytest
from pyspark.sql import functions as F

from quillspark.functions import patterns, scalars, text
from quillspark.operators import cleaning


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


HTML = [
    ("<p>a</p><p>b</p>", "a\nb"), ("Hello <strong>World</strong>", "Hello \nWorld"), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("a<!-- no -->b", "a\nb"), ("plain", "plain"), (None, None),
    ("<style>.x{}</style><p>unclosed", "unclosed"),
]


@pytest.mark.parametrize("html,want", HTML)
def test_html(spark, html, want):
    assert one(spark, text.html_text, html) == want


def test_scripts_vanish(spark):
    out = one(spark, text.html_text, "<p>Content</p><script>alert('xss')</script><style>.x{}</style>")
    assert "Content" in out and "alert" not in out and ".x" not in out


@pytest.mark.parametrize("raw,want", [("Ｈｅｌｌｏ　Ｗｏｒｌｄ", "Hello World"), ("Hello\x00\x01\x02World", "HelloWorld"), ("a\tb", "ab"), ("a\n\n\n\nb", "a\n\nb"), ("  a  b ", "a b")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize, raw) == want


def test_paragraphs(spark):
    assert one(spark, text.paragraphs, "Para 1\n\n\n\nPara 2\n\n   \n\nPara 3") == ["Para 1", "Para 2", "Para 3"]
    assert one(spark, text.paragraphs, None) == []


@pytest.mark.parametrize("raw,want", [("這是一個中文測試", "zh"), ("This is mostly English 測試", "en"), ("   ", "unknown")])
def test_script_language(spark, raw, want):
    assert one(spark, text.script_language, raw) == want


RULES = [
    ("本集節目由 ABC 公司贊助播出", "zh", "sponsor"), ("Use code SAVE20 for 20% off your purchase", "en", "sponsor"), ("Follow us at https://example.com and https://another.com", "en", "url_heavy"),
    ("(00:00) (05:30) (10:00) (15:00) x", "en", "timestamps"), ("訂閱更多", "zh", "short_cta"), ("This episode was produced somewhere", "en", "production"), ("Hosting provided by X", "zh", "hosting"),
]


@pytest.mark.parametrize("p,lang,flag", RULES)
def test_rules(spark, p, lang, flag):
    row = spark.createDataFrame([(p, lang)], "p string, l string").select(cleaning.flags_of(cleaning.rules_hit(F.col("p"), F.col("l"))).alias("f")).first()
    assert flag in row.f


@pytest.mark.parametrize("n,frequent", [(4, True), (2, False)])
def test_frequent(spark, n, frequent):
    eps = spark.createDataFrame([(f"e{i}", "s", f"own text number {'abcdefg'[i]} is long enough\n\nThis is our standard outro") for i in range(n)], "episode_id string, show_id string, description string")
    out = cleaning.clean_episodes(cleaning.judged_paragraphs(cleaning.paragraph_table(eps, F.col("description")))).collect()
    assert {r.removed_paragraphs for r in out} == {int(frequent)}


def test_clean_edges(spark):
    eps = spark.createDataFrame([("e1", "s", None), ("e2", "s", ""), ("e3", None, "x"), ("e3", None, "x")], "episode_id string, show_id string, description string")
    out = {r.episode_id: (r.paragraphs, r.description) for r in cleaning.clean_episodes(cleaning.judged_paragraphs(cleaning.paragraph_table(eps, F.col("description")))).collect()}
    assert out == {"e1": (0, ""), "e2": (0, ""), "e3": (1, "x")}


def test_scores(spark):
    score = lambda t: one(spark, cleaning.extraneous_score, t)
    assert score("Today we discuss the latest trends in technology and innovation.") < 0.3
    assert score("This episode is sponsored by XYZ Company. Use code SAVE20 for 20% off.") == pytest.approx(0.425)
    assert score("") == 0.0


DURATIONS = [("3600", 3600), ("1:30:00", 5400), ("45:30", 2730), ("1:2:3:4", None), ("a:b", None), (None, None)]


@pytest.mark.parametrize("raw,want", DURATIONS)
def test_duration(spark, raw, want):
    assert one(spark, scalars.parse_duration, raw) == want


TAGS = [("en-US", "en"), ("zh-Hant", "zh-hant"), ("zh", "zh-hant"), ("zh-cn", "zh-hans"), ("zh-sg", "zh-hant"), ("ja-JP", "ja"), ("fra", None), ("", None), (None, None)]


@pytest.mark.parametrize("raw,want", TAGS)
def test_language_tags(spark, raw, want):
    assert one(spark, scalars.normalize_language, raw) == want


def test_ids_and_versions(spark):
    row = spark.createDataFrame([("show:apple:1234567890", "guid-episode-1")], "s string, g string").select(scalars.episode_id(F.col("s"), F.col("g")).alias("i")).first()
    assert row.i == "episode:apple:1234567890:fff2a0ca"
    assert [one(spark, scalars.clean_version, v) for v in ("m/text-v1", "text-v1", None)] == ["text-v1", "text-v1", None]
    assert one(spark, scalars.perturb_query, "machine learning") == ["learning", "machine", "learning machine"]
    assert one(spark, scalars.perturb_query, "AI") == []
    assert one(spark, scalars.id_list, " a, b,,a ") == ["a", "b"]


def test_portable_patterns():
    assert patterns.portable(r"a\s+[\w:]+.\S") == r"(?i)a[\s\p{Z}]+[\p{L}\p{N}_:]+[^" + "\n" + r"][^\s\p{Z}]"


def test_similarity_keeps_its_pairs_in_cells(spark):
    texts = spark.createDataFrame([(f"t{i}", " ".join(f"w{j % 7}" for j in range(i % 9))) for i in range(50)], "k string, x string")
    known = spark.createDataFrame([("w0 w1 w2",), ("w2 w1 w0",), ("w3 w4 w5 w6 w7",), (" ",)], "norm string")
    sets = [{"w0", "w1", "w2"}, {"w3", "w4", "w5", "w6", "w7"}]
    want = {r.k: max(len(s & set(r.x.split())) / len(s | set(r.x.split())) for s in sets) for r in texts.collect()}
    found = cleaning.boilerplate_similarity(texts, "k", "x", known, "norm", text_rows=9, set_rows=1)
    assert {r.k: r.similarity for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
