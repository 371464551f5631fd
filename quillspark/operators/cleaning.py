"""Removal of functional paragraphs by rules and by frequency, and scores of what remains. All expressions, but for the similarity to boilerplate."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..session import cut_lineage

ZH_FAMILIES = {"sponsor": P.ZH_SPONSOR, "cta": P.ZH_CTA, "hosting": P.HOSTING}
EN_FAMILIES = {"sponsor": P.EN_SPONSOR, "cta": P.EN_CTA, "hosting": P.HOSTING, "production": P.EN_PRODUCTION, "subscribe": P.EN_SUBSCRIBE}


def _first(text: Column, family: str, patterns: list[str]) -> Column:
    """The rule of the first pattern that hits, null if none does."""
    return F.coalesce(*(F.when(F.regexp_like(text, F.lit(P.portable(p))), F.lit(f"{family}:{p[:30]}")) for p in patterns))


def rules_hit(paragraph: Column, language: Column) -> Column:
    """Rules that a paragraph meets, in the order of the families."""
    low = F.lower(paragraph)
    rules = [
        F.when(language == "zh", _first(low, f, ZH_FAMILIES[f]) if f in ZH_FAMILIES else F.lit(None).cast("string")).otherwise(_first(low, f, EN_FAMILIES[f]))
        for f in EN_FAMILIES
    ]
    rules.append(F.when((F.regexp_count(paragraph, F.lit(P.portable(P.URL))) >= 2) & (F.length(paragraph) < 500), F.lit("url_heavy:>=2_urls")))
    left = F.regexp_replace(F.regexp_replace(paragraph, P.portable(P.TIMESTAMP), ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rules.append(F.when(F.length(left) < F.length(paragraph) * 0.3, F.lit("timestamps:>70%")))
    short = F.lit(False)
    for word in P.SHORT_CTA:
        short = short | F.contains(low, F.lit(word))
    rules.append(F.when((F.length(paragraph) < 50) & short, F.lit("short_cta:<50chars")))
    return F.array_compact(F.array(*rules))


def flags_of(rules: Column) -> Column:
    return F.transform(rules, lambda r: F.split_part(r, F.lit(":"), F.lit(1)))


def paragraph_table(episodes: DataFrame, text: Column) -> DataFrame:
    """(episode_id, show_id, raw_chars, language, n, paragraph): an episode once, its language that of its whole text.

    Episodes without a paragraph have one row whose n and paragraph are null.
    """
    once = episodes.select("episode_id", "show_id", F.col("description").alias("_raw"), text.alias("_text")).dropDuplicates(["episode_id"])
    return once.select("episode_id", "show_id", F.length(F.coalesce("_raw", F.lit(""))).alias("raw_chars"), TX.script_language(F.col("_text")).alias("language"), F.posexplode_outer(TX.paragraphs(F.col("_text"))).alias("n", "paragraph"))


def paragraph_frequency(paragraphs: DataFrame) -> DataFrame:
    """(show_id, norm, occurrences, episodes): how often a normalised paragraph of more than 20 characters occurs in a show."""
    norm = paragraphs.where(F.col("paragraph").isNotNull()).select("show_id", TX.comparable(F.col("paragraph")).alias("norm")).where(F.length("norm") > 20)
    total = paragraphs.groupBy("show_id").agg(F.countDistinct("episode_id").alias("episodes"))
    return norm.groupBy("show_id", "norm").agg(F.count("*").alias("occurrences")).join(total, "show_id")


def frequent(frequency: DataFrame, share: float = 0.25, least: int = 4) -> DataFrame:
    return frequency.where((F.col("episodes") >= least) & (F.col("occurrences") > F.col("episodes") * share))


def judged_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with rules, flags and `kept`. The frequency rule is asked only where no other rule fired."""
    often = frequent(paragraph_frequency(paragraphs)).select(F.col("show_id").alias("_show"), "norm", F.lit(True).alias("often"))
    rules = paragraphs.withColumn("rules", F.when(F.col("paragraph").isNotNull(), rules_hit(F.col("paragraph"), F.col("language"))))
    marked = rules.withColumn("_norm", TX.comparable(F.col("paragraph"))).join(often, (F.col("show_id") == F.col("_show")) & (F.col("_norm") == F.col("norm")), "left")
    rules = F.when((F.size("rules") == 0) & F.col("often"), F.array(F.lit("frequent:>25%_episodes"))).otherwise(F.col("rules"))
    return marked.withColumn("rules", rules).withColumn("flags", flags_of(F.col("rules"))).withColumn("kept", F.size("rules") == 0).drop("_show", "_norm", "norm", "often")


def clean_episodes(judged: DataFrame) -> DataFrame:
    """One row an episode: the kept text, counts of paragraphs and characters, and how many paragraphs each flag removed."""
    kept = F.col("kept") & F.col("paragraph").isNotNull()
    rows = judged.groupBy("episode_id", "show_id").agg(
        F.max("raw_chars").alias("raw_chars"),
        F.coalesce(F.sum(F.when(kept, F.length("paragraph"))), F.lit(0)).alias("kept_chars"),
        F.count("paragraph").alias("paragraphs"),
        F.count_if(kept).alias("kept_paragraphs"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("n", "paragraph")))).alias("_kept"),
        F.flatten(F.collect_list(F.when(~F.col("kept"), F.col("flags")))).alias("_flags"),
    )
    breakdown = F.map_from_entries(F.transform(F.array_distinct(F.array_sort("_flags")), lambda f: F.struct(f, F.size(F.filter("_flags", lambda x: x == f)))))
    return rows.select("episode_id", "show_id", F.array_join(F.transform("_kept", lambda p: p["paragraph"]), "\n\n").alias("description"), "raw_chars", "kept_chars", "paragraphs", "kept_paragraphs", (F.col("paragraphs") - F.col("kept_paragraphs")).alias("removed_paragraphs"), breakdown.alias("removal_breakdown"))


def corpus_statistics(cleaned: DataFrame) -> DataFrame:
    """One row: totals, the share of removed paragraphs and characters in percent (two decimals), episodes with a removal."""
    s = cleaned.agg(
        F.count("*").alias("episodes"), F.count_if(F.col("removed_paragraphs") > 0).alias("episodes_with_cleaning"), F.sum("paragraphs").alias("paragraphs"), F.sum("removed_paragraphs").alias("removed_paragraphs"),
        F.sum("raw_chars").alias("raw_chars"), F.sum("kept_chars").alias("kept_chars"),
    )
    pct = lambda a, b: F.round(F.coalesce(100.0 * a / F.nullif(b, F.lit(0)), F.lit(0.0)), 2)
    return s.withColumn("removal_rate", pct(F.col("removed_paragraphs"), F.col("paragraphs"))).withColumn("char_reduction", pct(F.col("raw_chars") - F.col("kept_chars"), F.col("raw_chars")))


def removal_breakdown(cleaned: DataFrame, breakdown: str = "removal_breakdown") -> DataFrame:
    """(reason, paragraphs, percent): how many paragraphs each flag removed over the corpus, and its share of all removals (one decimal)."""
    each = cleaned.select(F.explode(breakdown).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("paragraphs"))
    total = each.agg(F.sum("paragraphs").alias("_all"))
    return each.join(F.broadcast(total)).select("reason", "paragraphs", F.round(100.0 * F.col("paragraphs") / F.col("_all"), 1).alias("percent"))


def _hits(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(P.portable(p))) for p in patterns[1:]), F.regexp_count(text, F.lit(P.portable(patterns[0]))))


def extraneous_features(text: Column) -> dict[str, Column]:
    low, zh = F.lower(text), TX.script_language(text) == "zh"
    sponsor = _hits(low, P.SCORE_EN_SPONSOR) + F.when(zh, _hits(low, P.SCORE_ZH_SPONSOR)).otherwise(0)
    cta = _hits(low, P.EN_CTA) + F.when(zh, _hits(low, P.ZH_CTA)).otherwise(0)
    urls = F.regexp_count(text, F.lit(P.portable(P.URL)))
    up = lambda c, n: F.least(c, F.lit(n)) / F.lit(float(n))
    return {
        "sponsor": up(sponsor, 3), "promo_code": up(_hits(low, P.PROMO_CODE), 2), "cta": up(cta, 3),
        "url_density": F.least(urls / (F.length(text) / F.lit(500.0) + F.lit(1.0)) / F.lit(3.0), F.lit(1.0)), "hosting": up(_hits(low, P.HOSTING), 1),
    }


def extraneous_score(text: Column, similarity: Column | None = None) -> Column:
    """Weighted sum of the features, at most 1; 0 for a blank text. `similarity` to known boilerplate joins in if given."""
    f = extraneous_features(text)
    score = sum((f[k] * w for k, w in P.WEIGHTS.items()), F.lit(0.0))
    if similarity is not None:
        score = score + F.coalesce(similarity, F.lit(0.0)) * P.SIMILARITY_WEIGHT
    blank = F.coalesce(F.regexp_replace(text, r"[\s\p{Z}]+", ""), F.lit("")) == ""
    return F.when(blank, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{Z}]+"), lambda w: w != ""))


class _Sets:
    """Sets of words, and the largest Jaccard similarity of another set to one of them."""

    def __init__(self, words: pa.Array):
        lists = pc.split_pattern(words, " ")
        self.known = pc.unique(lists.flatten())
        size = np.diff(lists.offsets.to_numpy())
        term, row = pc.index_in(lists.flatten(), self.known).to_numpy(), np.repeat(np.arange(len(size)), size)
        self.size, self.seen = size.astype("i8"), {}
        order = np.argsort(term, kind="stable")
        ends = np.searchsorted(term[order], np.arange(len(self.known) + 1))
        self.rows = [row[order][a:b] for a, b in itertools.pairwise(ends)]
        for t, r in enumerate(self.rows):  # a word of many sets as a row of all sets
            if len(r) > len(size) // 16:
                self.rows[t] = np.zeros(len(size), "i4")
                self.rows[t][r] = 1

    def nearest(self, terms: np.ndarray, n: int) -> float:
        if (key := (terms.tobytes(), n)) not in self.seen:
            both = np.zeros(len(self.size), "i4")
            for t in terms:
                if len(self.rows[t]) == len(both):
                    both += self.rows[t]
                else:
                    both[self.rows[t]] += 1
            if len(self.seen) >= 100_000:
                self.seen.clear()
            self.seen[key] = float((both / (self.size + n - both)).max()) if len(both) else 0.0
        return self.seen[key]

    def of(self, words: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(words, " ")
        term, offsets = pc.fill_null(pc.index_in(lists.flatten(), self.known), -1).to_numpy(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        out = np.zeros(len(words))
        for i, (a, b) in enumerate(itertools.pairwise(offsets)):
            mine = term[a:b]
            mine = np.sort(mine[mine >= 0])
            if len(mine):
                out[i] = self.nearest(mine, b - a)
        return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarity of each text of a cell to the boilerplate of the cell; a partition holds whole cells, boilerplate first."""
    at, held, sets = None, [], None
    for b in batches:
        cells = b.column("cell").to_numpy()
        known = b.column("known").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (known[1:] != known[:-1])) + 1
        for start, end in itertools.pairwise([0, *cuts.tolist(), b.num_rows]):
            if start == end:
                continue
            if cells[start] != at:
                at, held, sets = cells[start], [], None
            part = b.slice(start, end - start)
            if known[start]:
                held.append(part.column("words"))
                continue
            if sets is None:
                sets, held = _Sets(pa.chunked_array(held, pa.string()).combine_chunks()), []
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets.of(part.column("words")))], ["key", "similarity"])


def boilerplate_similarity(texts: DataFrame, key: str, text: str, corpus: DataFrame, corpus_text: str, text_rows: int = 65_536, set_rows: int = 8192) -> DataFrame:
    """(key, similarity): the largest Jaccard similarity of a text's words to those of a boilerplate text, 0 without a common word.

    Texts lie in blocks and boilerplate in chunks, both sized by rows. A cell holds one of each and keeps one number a text, so
    the pairs that share a word never leave it.
    """
    words = lambda c: F.array_join(F.array_sort(word_set(F.col(c))), " ")
    a = cut_lineage(texts.select(F.col(key).cast("string").alias("key"), words(text).alias("words")))
    b = cut_lineage(corpus.select(words(corpus_text).alias("words")).where(F.col("words") != "").distinct())
    blocks, chunks = (max(1, -(-df.count() // n)) for df, n in ((a, text_rows), (b, set_rows)))
    blocks = max(blocks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // chunks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = a.select("key", "words", F.lit(False).alias("known"), part("key", blocks).alias("g"), every(chunks).alias("c"))
    right = b.select(F.lit(None).cast("string").alias("key"), "words", F.lit(True).alias("known"), every(blocks).alias("g"), part("words", chunks).alias("c"))
    placed = left.unionByName(right).select((F.col("c") * blocks + F.col("g")).alias("cell"), "known", "key", "words")
    each = placed.repartitionById(blocks * chunks, "cell").sortWithinPartitions("cell", F.desc("known")).mapInArrow(_similar, "key string, similarity double")
    kind = dict(texts.dtypes)[key]
    return each.groupBy("key").agg(F.max("similarity").alias("similarity")).select(F.col("key").cast(kind).alias(key), "similarity")


def cleaned_documents(judged: DataFrame, titles: DataFrame, pipeline: str = "clean-v1", rules: str = "rules-v1") -> DataFrame:
    """Nested documents of judged paragraphs: normalised texts, all paragraphs with flags and rules, counts, versions.

    `titles` is (episode_id, title). A paragraph without a flag is content. An episode without paragraphs has an empty list.
    """
    p = F.struct(
        F.col("n").alias("index"), F.col("paragraph").alias("text"), F.length("paragraph").alias("char_count"),
        F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("content"))).alias("flags"), F.col("kept").alias("kept"), F.col("rules").alias("rules_hit"),
    )
    lists = judged.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.when(F.col("paragraph").isNotNull(), p))).alias("paragraphs"))
    number = lambda c: F.col(c).cast("int")
    stats = F.struct(
        number("raw_chars").alias("raw_char_count"), number("kept_chars").alias("kept_char_count"), number("paragraphs_n").alias("total_paragraphs"), number("kept_paragraphs").alias("kept_paragraphs"),
        number("removed_paragraphs").alias("removed_paragraphs"), "removal_breakdown",
    )
    counts = clean_episodes(judged).select("episode_id", F.col("paragraphs").alias("paragraphs_n"), "raw_chars", "kept_chars", "kept_paragraphs", "removed_paragraphs", "removal_breakdown", "show_id", "description")
    rows = counts.join(lists, "episode_id").join(titles.select("episode_id", "title").dropDuplicates(["episode_id"]), "episode_id", "left")
    return rows.select("episode_id", "show_id", F.struct(F.struct(TX.normalize(F.col("title")).alias("title"), "description").alias("normalized"), "paragraphs", stats.alias("stats")).alias("cleaned"), F.struct(F.lit(pipeline).alias("pipeline_version"), F.lit(rules).alias("rules_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("cleaned_at")).alias("cleaning_meta"))
