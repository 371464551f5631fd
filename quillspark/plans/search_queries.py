"""Search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import text as TX
from ..operators import evaluation as E
from ..operators import search as R
from ..session import cut_lineage
from ..session import table as t


def _documents(s, d, *more):
    return t(s, d, "episodes").select(F.col("episode_id").alias("doc_id"), "show_id", "title", "description", *more)


def corpus(s, d, *more):
    """Episodes as documents, each once."""
    return _documents(s, d, *more).distinct()


def corpus_in_place(s, d):
    """The same, without a shuffle of the texts."""
    return R.distinct_rows(_documents(s, d), "doc_id")


def listed(s, d):
    return t(s, d, "query_catalog").select("query_id", "query")


def keyed(s, d):
    """Usable vectors by the id of their episode."""
    return t(s, d, "episode_vectors").where(R.usable_vector(F.col("embedding"), X.DIMS)).select(F.col("episode_id").alias("doc_id"), "vec_id", "embedding")


def vectors(s, d):
    """The vectors of an episode with the lowest id. Those of one id may be several, of which search takes one."""
    v = keyed(s, d)
    low = R.bounded(cut_lineage(v.groupBy("doc_id").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).where("low < high").select("doc_id", "low")))
    return v.join(low, "doc_id", "left").where(F.col("low").isNull() | (F.col("vec_id") == F.col("low"))).select("doc_id", "embedding", "vec_id")


def seeds(s, d):
    """Episodes as queries: every vector whose id is divisible by 100, with the title as the text that is asked."""
    v = cut_lineage(keyed(s, d).groupBy("doc_id").agg(F.min("vec_id").alias("vec_id")).where(F.col("vec_id") % 100 == 0).select("doc_id"))
    e = t(s, d, "episodes").withColumnRenamed("episode_id", "doc_id").join(R.bounded(v), "doc_id", "left_semi")
    return e.select("doc_id", "show_id", "title", "description").distinct().select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def lexical(s, d, k=R.WINDOW):
    return R.bm25(seeds(s, d), corpus(s, d), k)


def semantic(s, d, k=R.WINDOW):
    v = vectors(s, d)
    asked = v.where(F.col("vec_id") % 100 == 0).join(t(s, d, "episodes").select(F.col("episode_id").alias("doc_id")), "doc_id", "left_semi")
    return R.knn(asked.select(F.col("doc_id").alias("query_id"), "embedding"), v.select("doc_id", "embedding"), X.DIMS, k)


def _out(df):
    return df.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_prod(s, d):
    return _out(R.bm25(listed(s, d), corpus(s, d), 10))


def bm25_eval(s, d):
    return _out(R.bm25(listed(s, d), corpus(s, d), 10, "evaluation"))


def phrase_search(s, d):
    return _out(R.phrase_search(listed(s, d), corpus(s, d), 10))


def routed_search(s, d):
    """Each listed query in the index of its language, told by its script."""
    asked = listed(s, d).withColumn("language", F.when(TX.script_language(F.col("query")) == "zh", "mixed").otherwise("en"))
    return _out(R.search(asked, corpus(s, d, "target_index"), mode="bm25"))


def index_health(s, d):
    """Coverage and the rate of queries without a result of each index, with their gates."""
    asked = t(s, d, "query_log").where(F.col("query").isNotNull()).select(F.col("query").alias("query_id"), "query", X.query_alias(X.query_language(F.col("query_lang"))).alias("alias")).distinct()
    docs = corpus(s, d, "target_index").withColumn("alias", X.route(F.col("target_index"))).where(F.col("alias").isNotNull())
    rates = None
    for alias in X.ALIASES.values():
        mine = asked.where(F.col("alias") == alias)
        zero = R.zero_results(mine, docs.where(F.col("alias") == alias)).agg(F.count("*").alias("zero"))
        part = mine.agg(F.count("*").alias("queries")).join(F.broadcast(zero)).select(F.lit(alias).alias("alias"), "queries", "zero")
        rates = part if rates is None else rates.unionByName(part)
    return E.index_health(field_coverage(s, d), rates)


def knn_topk(s, d):
    return _out(semantic(s, d, 10))


def rrf_fusion(s, d):
    return R.rrf(lexical(s, d), semantic(s, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def hybrid_search(s, d):
    return _out(R.hybrid(lexical(s, d), semantic(s, d), corpus(s, d)))


def autocomplete_terms(s, d):
    asked = listed(s, d).select("query_id", F.substring("query", 1, 4).alias("prefix"))
    return R.suggestions(asked, corpus(s, d)).select("query_id", "title", "docs", "rank")


def edge_ngram_prefix(s, d):
    return R.edge_matches(listed(s, d).select("query_id", F.substring("query", 1, 5).alias("query")), corpus(s, d))


def zero_result_rate(s, d):
    asked = t(s, d, "query_log").where(F.col("query").isNotNull()).select(F.col("query").alias("query_id"), "query").distinct()
    zero = R.zero_results(asked, corpus(s, d)).agg(F.count("*").alias("zero"))
    n = asked.agg(F.count("*").alias("queries"))
    return n.join(F.broadcast(zero)).select("queries", "zero", F.round(F.col("zero") / F.col("queries"), 6).alias("rate"))


def field_coverage(s, d):
    v = t(s, d, "episode_vectors").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("episode_id").distinct().withColumn("has", F.lit(1))
    e = t(s, d, "episodes").select("episode_id", "target_index", "image_url", "description").distinct().join(v, "episode_id", "left")
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return e.groupBy(X.route(F.col("target_index")).alias("alias")).agg(
        F.count("*").alias("docs"), share(F.col("has").isNotNull()).alias("embedding"), share(F.col("image_url").isNotNull() & (F.col("image_url") != "")).alias("image_url"), share(F.col("description").isNotNull()).alias("description"))


TOK = r"regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '([一-鿿])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"
BI = "list_filter(list_transform(range(1, CAST(len({t}) + 1 AS INTEGER)), lambda i: CASE WHEN NOT regexp_full_match({t}[i], '[一-鿿]') THEN {t}[i] WHEN i < len({t}) AND regexp_full_match({t}[i + 1], '[一-鿿]') THEN {t}[i] || {t}[i + 1] END), lambda w: w IS NOT NULL)"
_C = "docs AS (SELECT DISTINCT episode_id AS doc_id, show_id, title, description FROM episodes)"
_QC = "qs AS (SELECT query_id, query FROM query_catalog)"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: isfinite(x))) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = f"vecs AS (SELECT episode_id AS doc_id, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS e, min(vec_id) AS vec_id FROM episode_vectors WHERE {_USABLE} GROUP BY episode_id)"
_SEEDS = f"{_C}, {_V}, seeds AS (SELECT v.doc_id AS query_id, c.title AS query, v.e FROM vecs v JOIN docs c ON c.doc_id = v.doc_id WHERE v.vec_id % 100 = 0), qs AS (SELECT query_id, query FROM seeds)"


def _fields(chinese: bool) -> str:
    parts = [f"SELECT doc_id, 'title' AS field, {TOK.format(x='title')} AS w FROM docs", f"SELECT doc_id, 'description', {TOK.format(x='description')} FROM docs"]
    if chinese:
        parts += [f"SELECT doc_id, '{f}_zh', {BI.format(t='k')} FROM (SELECT doc_id, {TOK.format(x=f)} AS k FROM docs)" for f in ("title", "description")]
    return " UNION ALL ".join(parts)


def _scores(chinese: bool = False) -> str:
    """CTEs up to fscore(query_id, doc_id, field, score)."""
    terms = f"SELECT query_id, unnest({TOK.format(x='query')}) AS term, false AS zh FROM qs"
    if chinese:
        terms += f" UNION ALL SELECT query_id, unnest({BI.format(t='k')}), true FROM (SELECT query_id, {TOK.format(x='query')} AS k FROM qs)"
    return f"""words AS ({_fields(chinese)}), stats AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM words WHERE len(w) > 0 GROUP BY field),
        terms AS (SELECT query_id, term, zh, count(*) AS qn FROM ({terms}) GROUP BY ALL),
        post AS (SELECT doc_id, field, term, dl, count(*) AS tf FROM (SELECT doc_id, field, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
        dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
        fscore AS (SELECT t.query_id, p.doc_id, p.field, sum(t.qn * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
            FROM post p JOIN dfs d ON d.field = p.field AND d.term = p.term JOIN stats s ON s.field = p.field JOIN terms t ON t.term = p.term AND t.zh = (p.field LIKE '%\\_zh' ESCAPE '\\') GROUP BY ALL)"""


def _phrase(chinese: bool = False) -> str:
    """CTEs up to pscore(query_id, doc_id, field, score)."""
    asked = f"SELECT query_id, false AS zh, {TOK.format(x='query')} AS k FROM qs"
    if chinese:
        asked += f" UNION ALL SELECT query_id, true, {BI.format(t='k')} FROM (SELECT query_id, {TOK.format(x='query')} AS k FROM qs)"
    return f"""asked AS (SELECT query_id, zh, term, qpos, len(k) AS words FROM (SELECT query_id, zh, k, unnest(k) AS term, unnest(range(len(k))) AS qpos FROM ({asked}))),
    placed AS (SELECT doc_id, field, field LIKE '%\\_zh' ESCAPE '\\' AS zh, len(w) AS dl, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words),
    pdf AS (SELECT field, zh, term, count(DISTINCT doc_id) AS df FROM placed WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    pidf AS (SELECT a.query_id, d.field, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5))) AS idf FROM asked a JOIN pdf d ON d.term = a.term AND d.zh = a.zh JOIN stats s ON s.field = d.field GROUP BY ALL),
    starts AS (SELECT a.query_id, p.doc_id, p.field, p.dl, p.pos - a.qpos AS start, count(*) AS hit, any_value(a.words) AS words FROM placed p JOIN asked a ON a.term = p.term AND a.zh = p.zh GROUP BY ALL),
    whole AS (SELECT query_id, doc_id, field, dl, count(*) AS tf FROM starts WHERE hit = words GROUP BY ALL),
    pscore AS (SELECT w.query_id, w.doc_id, w.field, i.idf * w.tf * 2.2 / (w.tf + 1.2 * (0.25 + 0.75 * w.dl / s.avgdl)) AS score FROM whole w JOIN pidf i ON i.query_id = w.query_id AND i.field = w.field JOIN stats s ON s.field = w.field)"""


_PHRASE = _phrase()
_BOOST = "CASE WHEN field LIKE 'title%' THEN 3.0 ELSE 1.0 END"


def _top(source: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({source})) WHERE rank <= {k})"


_PROD = f"SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, max(score * {_BOOST}) AS score FROM fscore GROUP BY ALL UNION ALL SELECT query_id, doc_id, score * 2.0 FROM pscore WHERE field = 'title') GROUP BY ALL"
_KNN = "SELECT q.query_id, v.doc_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM seeds q JOIN vecs v ON v.doc_id <> q.query_id"
_LEX = f"{_SEEDS}, {_scores()}, {_PHRASE}, {_top(_PROD, 100, 'lex')}"
_BOTH = f"{_LEX}, {_top(_KNN, 100, 'sem')}"
_HYBRID = f"""{_BOTH}, fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS r1, b.rank AS r2, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
        FROM lex a FULL JOIN sem b ON b.query_id = a.query_id AND b.doc_id = a.doc_id),
    capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY round(score, 9) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS n FROM (
        SELECT f.*, coalesce(nullif(trim(c.show_id), ''), '__unknown__') AS bucket FROM fused f LEFT JOIN docs c ON c.doc_id = f.doc_id)),
    hyb AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS rank FROM capped WHERE n <= 3) WHERE rank <= 10)"""
_SEL = "SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM"

SQL = {
    "bm25_prod": f"WITH {_C}, {_QC}, {_scores()}, {_PHRASE}, {_top(_PROD, 10, 'r')} {_SEL} r",
    "bm25_eval": f"WITH {_C}, {_QC}, {_scores(True)}, {_top(f'SELECT query_id, doc_id, max(score * {_BOOST}) AS score FROM fscore GROUP BY ALL', 10, 'r')} {_SEL} r",
    "phrase_search": f"WITH {_C}, {_QC}, {_scores(True)}, {_phrase(True)}, {_top(f'SELECT query_id, doc_id, sum(score * {_BOOST}) AS score FROM pscore GROUP BY ALL', 10, 'r')} {_SEL} r",
    "knn_topk": f"WITH {_SEEDS}, {_top(_KNN, 10, 'r')} {_SEL} r",
    "rrf_fusion": f"WITH {_BOTH} SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, rank FROM sem) GROUP BY ALL",
    "hybrid_search": f"WITH {_HYBRID} {_SEL} hyb",
    "autocomplete_terms": f"""WITH {_C}, titles AS (SELECT title, count(*) AS docs FROM docs WHERE title IS NOT NULL AND length(title) <= 256 GROUP BY title)
        SELECT query_id, title, docs, CAST(rank AS INTEGER) AS rank FROM (SELECT q.query_id, t.title, t.docs, row_number() OVER (PARTITION BY q.query_id ORDER BY t.docs DESC, t.title) AS rank
        FROM query_catalog q JOIN titles t ON starts_with(t.title, substring(q.query, 1, 4))) WHERE rank <= 5""",
    "edge_ngram_prefix": f"""WITH {_C}, w AS (SELECT DISTINCT doc_id, unnest({TOK.format(x='title')}) AS w FROM docs), a AS (SELECT DISTINCT query_id, unnest({TOK.format(x='substring(query, 1, 5)')}) AS p FROM query_catalog)
        SELECT query_id, count(DISTINCT doc_id) AS docs FROM a JOIN w ON length(w.w) >= 2 AND length(a.p) BETWEEN 2 AND 20 AND starts_with(w.w, a.p) GROUP BY query_id""",
    "zero_result_rate": f"""WITH {_C}, known AS (SELECT DISTINCT unnest({TOK.format(x="coalesce(title, '') || ' ' || coalesce(description, '')")}) AS term FROM docs),
        asked AS (SELECT DISTINCT query FROM query_log WHERE query IS NOT NULL), ok AS (SELECT DISTINCT query FROM (SELECT query, unnest({TOK.format(x='query')}) AS term FROM asked) WHERE term IN (SELECT term FROM known))
        SELECT count(*) AS queries, count(*) FILTER (WHERE ok.query IS NULL) AS zero, round(count(*) FILTER (WHERE ok.query IS NULL) / count(*), 6) AS rate FROM asked LEFT JOIN ok ON ok.query = asked.query""",
    "field_coverage": """WITH v AS (SELECT DISTINCT episode_id FROM episode_vectors WHERE embedding IS NOT NULL AND len(embedding) > 0), e AS (SELECT DISTINCT episode_id, target_index, image_url, description FROM episodes)
        SELECT CASE target_index WHEN 'podcast-episodes-zh-tw' THEN 'episodes-zh-tw' WHEN 'podcast-episodes-zh-cn' THEN 'episodes-zh-cn' WHEN 'podcast-episodes-en' THEN 'episodes-en' END AS alias, count(*) AS docs,
        round(count(v.episode_id) / count(*), 6) AS embedding, round(count(*) FILTER (WHERE image_url IS NOT NULL AND image_url <> '') / count(*), 6) AS image_url, round(count(*) FILTER (WHERE description IS NOT NULL) / count(*), 6) AS description
        FROM e LEFT JOIN v ON v.episode_id = e.episode_id GROUP BY 1""",
}
_ISZH = "length(replace(query, ' ', '')) > 0 AND length(regexp_replace(query, '[^一-鿿]', '', 'g')) / length(replace(query, ' ', '')) > 0.3"


def _routed(target: str, zh: str) -> str:
    docs = f"docs AS (SELECT DISTINCT episode_id AS doc_id, show_id, title, description FROM episodes WHERE target_index = '{target}'), qs AS (SELECT query_id, query FROM query_catalog WHERE {zh} ({_ISZH}))"
    return f"SELECT * FROM (WITH {docs}, {_scores()}, {_PHRASE}, {_top(_PROD, 10, 'r')} {_SEL} r)"


def _zero(alias: str, target: str, langs: str) -> str:
    return f"""SELECT * FROM (WITH known AS (SELECT DISTINCT unnest({TOK.format(x="coalesce(title, '') || ' ' || coalesce(description, '')")}) AS term FROM episodes WHERE target_index = '{target}'),
        asked AS (SELECT DISTINCT query FROM query_log WHERE query IS NOT NULL AND {langs}), ok AS (SELECT DISTINCT query FROM (SELECT query, unnest({TOK.format(x='query')}) AS term FROM asked) WHERE term IN (SELECT term FROM known))
        SELECT '{alias}' AS alias, count(*) AS queries, count(*) FILTER (WHERE ok.query IS NULL) AS zero FROM asked LEFT JOIN ok ON ok.query = asked.query)"""


SQL["routed_search"] = _routed("podcast-episodes-zh-tw", "") + " UNION ALL " + _routed("podcast-episodes-en", "NOT")
SQL["index_health"] = f"""WITH c AS ({SQL['field_coverage']}), z AS ({_zero('episodes-zh-tw', 'podcast-episodes-zh-tw', "coalesce(query_lang, '') NOT IN ('zh-cn', 'en')")} UNION ALL {_zero('episodes-zh-cn', 'podcast-episodes-zh-cn', "query_lang = 'zh-cn'")} UNION ALL {_zero('episodes-en', 'podcast-episodes-en', "query_lang = 'en'")})
    SELECT c.alias, docs, embedding, CASE WHEN embedding >= 0.99 THEN 'PASS' ELSE 'FAIL' END AS embedding_gate, image_url, CASE WHEN image_url >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS image_url_gate, description,
    round(zero / nullif(queries, 0), 4) AS zero_rate, CASE WHEN queries = 0 THEN 'N/A' WHEN zero / queries <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS zero_gate FROM c JOIN z ON z.alias = c.alias"""
QUERIES = {k: globals()[k] for k in SQL}
HYBRID_SQL, LEX_SQL = _HYBRID, _LEX
