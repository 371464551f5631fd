"""Missing or wrong language labels: rank-order n-gram profiles and out-of-place distances.

A profile is the list of a language's most frequent character n-grams (n = 1..3, words padded by a space) in order. A text
is ranked likewise, and its distance to a language is the sum of the places by which its n-grams are out of place; one that
the profile lacks costs more than any that it has. Places are taken on a logarithmic scale, since the order of rare n-grams
is chance. Documents, and each of their lines, get the language of least distance.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, free_name

LANGUAGES = ("de", "en", "es", "fr", "ja", "zh-cn", "zh-tw")
#: Bound of the fitted sample: rows of each language. Their texts are taken whole.
SAMPLE_ROWS = 600
#: n-grams of a language profile.
PROFILE = 1000
#: An ideograph or kana counts as so many Latin letters where scripts are mixed; only the n-grams of the heavier script are compared.
EAST_WEIGHT = 3
#: How much nearer another language must be for a line to differ from its document's main language: by this share of the distance, or by so many places.
MARGIN, PLACES = 0.3, 100.0

_NOISE = re.compile(r"</?[A-Za-z][^<>]*>|(?:https?://|www\.)\S+|\S+@\S+\.\S+|[@#]\w+")
_PACK = (21, 42)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x30000)])


def plain(line: str) -> str:
    """A line without tags, links, addresses and handles, in lower case."""
    if "&" in line:
        line = html.unescape(line)
    return _NOISE.sub(" ", line).lower()


def _grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams, the line of each, and the number of letters of each line."""
    joined = "\n".join([" " + plain(x).replace("\n", " ") + " " for x in lines])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype("i8")
    end = codes == 10
    codes = np.where(end | _letters()[np.minimum(codes, 0x2FFFF)], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32))
    codes, end = codes[keep], end[keep]
    line = np.cumsum(end) - end
    letters = np.bincount(line, (codes != 32) & ~end, len(lines)).astype("i8")
    # In a line of two scripts (a title quoted in another) only the heavier one tells the language.
    east = (codes >= 0x2E80) & (codes != 32)
    weight = np.bincount(line, np.where(east, EAST_WEIGHT, np.where((codes != 32) & ~end, -1, 0)), len(lines))
    minor = (codes != 32) & ~end & (east != (weight >= 0)[line])
    codes = np.where(minor, 32, codes)
    one = np.flatnonzero((codes != 32) & ~end)
    two = np.flatnonzero(~(end[:-1] | end[1:]) & ((codes[:-1] != 32) | (codes[1:] != 32)))
    three = np.flatnonzero(~(end[:-2] | end[1:-1] | end[2:]) & (codes[1:-1] != 32))
    packed = np.concatenate([codes[one], codes[two] | codes[two + 1] << _PACK[0], codes[three] | codes[three + 1] << _PACK[0] | codes[three + 2] << _PACK[1]])
    return packed, np.concatenate([line[one], line[two], line[three]]), letters


class Profiles:
    """Ranks of n-grams by language. `vocabulary` is sorted; `ranks[i, l]` is the log of the place in language l."""

    def __init__(self, ordered: dict[str, list[int]], size: int):
        self.languages = sorted(ordered)
        self.size = size
        self.vocabulary = np.unique(np.concatenate([np.array(x, "i8") for x in ordered.values()] or [np.zeros(0, "i8")]))
        self.absent = 1.2 * np.log2(1 + size)
        self.ranks = np.full((len(self.vocabulary), len(self.languages)), 1e6, "f4")
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.vocabulary, ordered[lang]), k] = np.log2(1 + np.arange(len(ordered[lang])))

    def distances(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines x languages) out-of-place distances over the known n-grams, the numbers of these and of letters."""
        packed, line, letters = _grams(lines)
        at = np.minimum(np.searchsorted(self.vocabulary, packed), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == packed if len(self.vocabulary) else np.zeros(len(packed), bool)
        cells, n = np.unique(line[known] * np.int64(len(self.vocabulary) + 1) + at[known], return_counts=True)
        row, gram = np.divmod(cells, len(self.vocabulary) + 1)
        # Nearly in order already: by row, then by count downwards.
        order = np.argsort(row * 256 + (255 - np.minimum(n, 255)), kind="stable")
        row, gram = row[order], gram[order]
        first = np.searchsorted(row, np.arange(len(lines)))
        place = np.log2(1 + np.arange(len(row)) - first[row]).astype("f4") if len(row) else np.zeros(0, "f4")
        out = np.zeros((len(lines), len(self.languages)))
        if len(row):
            apart = np.minimum(np.abs(self.ranks[gram] - place[:, None]), self.absent)
            filled = np.flatnonzero(np.diff(np.append(first, len(row))))
            out[filled] = np.add.reduceat(apart, first[filled], axis=0)
        return out, np.bincount(row, minlength=len(lines)), letters

    def classify(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language (None without letters or known n-grams) and confidence: how much nearer it is than the next one, 0 to 1."""
        langs, confidence = np.full(len(lines), None, object), np.zeros(len(lines))
        if not lines or not self.languages:
            return langs, confidence
        best, nearness, _ = self.nearest(lines)
        good = best >= 0
        langs[good] = np.array(self.languages, object)[best[good]]
        others = nearness.copy()
        others[np.arange(len(lines)), best] = -1
        confidence[good] = 1 - np.maximum(others.max(axis=1)[good], 0) if len(self.languages) > 1 else 1.0
        return langs, confidence

    def nearest(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language (-1 for none); for each language the least distance over its own, 1 for the nearest; and its distance."""
        d, known, letters = self.distances(lines)
        best = np.where((letters > 0) & (known > 0), d.argmin(axis=1), -1)
        return best, (np.maximum(d.min(axis=1, keepdims=True), 1e-6) / np.maximum(d, 1e-6)).astype("f4"), d.astype("f4")


def _gram_counts(profiles: Profiles | None, sure: float):
    """(lang, gram, n) over the lines of labelled texts; with profiles only over those that agree with their label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                lines = [x for t in part.text for x in t.split("\n") if x.strip()]
                if profiles is not None:
                    found, confidence = profiles.classify(lines)
                    lines = [x for x, got, c in zip(lines, found, confidence) if got == lang and c > sure]
                grams, n = np.unique(_grams(lines)[0], return_counts=True) if lines else (np.zeros(0, "i8"),) * 2
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    return run


def fit_profiles(labelled: DataFrame, text: str, lang: str, sample_rows: int = SAMPLE_ROWS, size: int = PROFILE, languages: tuple[str, ...] = LANGUAGES) -> Profiles:
    """Profiles of the languages from a bounded sample of labelled rows: `sample_rows` of each label, in the order of a hash of their text.

    Labels may be partly wrong. A first fit classifies the sample's lines; the next two take only lines that agree with their
    label (all of a language if none does). Texts are counted where they lie; the driver sees the profiles only.
    """
    rows = labelled.where(F.length(text) > 0).select(tag_language(F.col(lang)).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where(F.col("lang").isin(*languages))
    picked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= sample_rows).select("lang", "text")
    picked = cut_lineage(picked.repartition(12))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ordered: dict[str, list[int]] = {}
    fitted = None
    for _ in range(3):
        counts = picked.repartition(12).mapInPandas(_gram_counts(fitted, 0.02), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        found = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= size).orderBy("lang", "place").select("lang", "gram").toPandas()
        ordered |= {k: part.gram.tolist() for k, part in found.groupby("lang")}
        fitted = Profiles(ordered, size)
    return fitted


def tag_language(tag: Column) -> Column:
    """The language of a tag: without its region, zh-cn and zh-hans apart from the other zh tags; null for none or undetermined."""
    t = F.lower(F.trim(F.translate(tag, "_", "-")))
    return (
        F.when(t.isin("", "und", "mul", "zxx", "unknown", "null", "none"), F.lit(None).cast("string"))
        .when(t.isin("zh-cn", "zh-hans") | t.startswith("zh-hans-"), F.lit("zh-cn"))
        .when((t == "zh") | t.startswith("zh-"), F.lit("zh-tw"))
        .otherwise(F.split_part(t, F.lit("-"), F.lit(1)))
    )


_LINES = "main string, confidence double, langs array<string>, confidences array<double>"


def _classify_lines(profiles: Profiles, margin: float, places: float):
    names = np.array([*profiles.languages, None], object)
    n = max(1, len(profiles.languages))

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            split = [[] if t is None else t.split("\n") for t in texts]
            seen: dict[str, int] = {}  # a standing line is classified once a batch
            line = np.array([seen.setdefault(x, len(seen)) for lines in split for x in lines], "i8")
            flat = list(seen)
            best, near, d = np.full(len(flat), -1), *(np.ones((len(flat), n), "f4") for _ in range(2))
            for a in range(0, len(flat) if profiles.languages else 0, 4000):
                best[a : a + 4000], near[a : a + 4000], d[a : a + 4000] = profiles.nearest(flat[a : a + 4000])
            sizes = np.array([len(x) for x in flat], "i8")[line] if flat else np.zeros(0, "i8")
            ends = np.cumsum([len(lines) for lines in split])
            doc = np.repeat(np.arange(len(split)), [len(lines) for lines in split])
            v = best[line]
            told = v >= 0
            # The language of most lines, of more characters among equals, then the first by name.
            cell = (doc * n + v)[told]
            votes = np.bincount(cell, minlength=len(split) * n) * 2.0**32 + np.bincount(cell, sizes[told], len(split) * n)
            votes = votes.reshape(len(split), n)
            main = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), -1)
            # A line that is almost as near to the main language has no language of its own to tell.
            m, at = main[doc], np.arange(len(line))
            close = told & (v != m) & (near[line, m] > 1 - margin) & (d[line, m] - d[line, v] < places)
            v = np.where(close, m, v)
            own = near[line]
            chosen = own[at, v]
            own[at, v] = 0
            sure = np.clip(chosen - own.max(axis=1), 0, 1) if n > 1 else chosen
            agree = told & (v == m)
            share = np.bincount(doc, sure * agree, len(split)) / np.maximum(np.bincount(doc, told, len(split)), 1)
            langs, confidences = names[v], np.where(told, sure.astype("f8"), None)
            cut = lambda x: [part.tolist() for part in np.split(x, ends[:-1])] if len(split) else []
            yield pd.DataFrame({"main": names[main], "confidence": np.where(main >= 0, share, None), "langs": cut(langs), "confidences": cut(confidences)}).astype({"confidence": "float64"})

    return classify


def line_languages(text: Column, profiles: Profiles, margin: float = MARGIN, places: float = PLACES) -> Column:
    """struct(main, confidence, langs, confidences): the main language of a text and the language of each of its lines.

    The main language is that of most lines, of more characters among equals; a line whose distance to it is within the
    share `margin` and the sum `places` of its least distance is of the main language too. Lines without letters, or of only links, have
    none; a null or empty text has none.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _classify_lines(profiles, margin, places)(batches)

    return F.pandas_udf(run, _LINES)(text)


def with_languages(docs: DataFrame, text: str, profiles: Profiles, out: str = "language_found") -> DataFrame:
    """Add the struct of `line_languages` as a column; where `out` is taken it gets a number behind its name. Rows stay as they are."""
    return docs.withColumn(free_name(docs.columns, out), line_languages(F.col(f"`{text}`"), profiles))


def description_languages(episodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(episode_id, line_no, lang, confidence) of every description (line_no null) and of each of its lines that has a language, distinct."""
    profiles = fit_profiles(documents, "text", "lang")
    rows = episodes.where(F.col("description").isNotNull() & F.col("episode_id").isNotNull()).select("episode_id", line_languages(F.col("description"), profiles).alias("found"))
    lines = F.transform(F.arrays_zip("found.langs", "found.confidences"), lambda x, i: F.struct(i.cast("bigint").alias("line_no"), x["langs"].alias("lang"), x["confidences"].alias("confidence")))
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("line_no"), F.col("found.main").alias("lang"), F.col("found.confidence").alias("confidence")))
    return rows.select("episode_id", F.explode(F.concat(whole, lines)).alias("x")).select("episode_id", "x.*").where(F.col("lang").isNotNull() | F.col("line_no").isNull()).distinct()


def found_labels(shows: DataFrame, raw_shows: DataFrame, episodes: DataFrame, documents: DataFrame) -> DataFrame:
    """p4_found. The profiles are fitted on labelled documents."""
    profiles = fit_profiles(documents, "text", "lang")
    # A show's own text: its description, where that is missing the one that its feed (or its entry) has, and only then a title.
    texts = shows.select("show_id", "title", "description", F.lit(0).alias("n")).unionByName(raw_shows.select("show_id", "title", "description", F.lit(1).alias("n")))
    has = lambda c: F.length(F.trim(F.col(c))) > 0
    own = texts.where(F.col("show_id").isNotNull()).groupBy("show_id").agg(
        *(F.min_by(F.when(has(c), F.col(c)), F.when(has(c), F.struct("n", c))).alias(c) for c in ("title", "description"))
    ).select("show_id", F.regexp_replace(F.coalesce("description", "title"), r"\s*\n\s*", " ").alias("other"))
    mine = F.regexp_replace(F.when(has("description"), F.col("description")), r"\s*\n\s*", " ")
    tables = [
        df.join(own, "show_id").select(F.lit(tab).alias("tab"), F.col("show_id").alias("rec_id"), F.col(label).alias("label"), F.coalesce(mine, F.col("other")).alias("text"))
        for tab, df, label in (("shows", shows, "language_detected"), ("raw_shows", raw_shows, "language"))
    ]
    rows = episodes.where(F.col("description").isNotNull()).select(F.lit("episodes").alias("tab"), F.col("episode_id").alias("rec_id"), F.col("language").alias("label"), F.col("description").alias("text"))
    for x in tables:
        rows = rows.unionByName(x)
    read = rows.where(F.col("rec_id").isNotNull()).withColumn("found", line_languages(F.col("text"), profiles)).where(F.col("found.main").isNotNull())
    wrong = ~tag_language(F.col("label")).eqNullSafe(F.col("found.main"))
    of_label = F.when(wrong, F.array(F.struct(F.col("tab"), F.col("rec_id"), F.col("found.main").alias("lang"))))
    place = F.transform("found.langs", lambda x, i: F.struct(F.lit("segments").alias("tab"), F.concat(F.col("rec_id"), F.lit("#"), i.cast("string")).alias("rec_id"), x.alias("lang")))
    of_lines = F.when(F.col("tab") == "episodes", F.filter(place, lambda x: x["lang"] != F.col("found.main")))
    kind = "array<struct<tab:string,rec_id:string,lang:string>>"
    none = F.array().cast(kind)
    return read.select(F.explode(F.concat(F.coalesce(of_label.cast(kind), none), F.coalesce(of_lines.cast(kind), none))).alias("x")).select("x.*").distinct()
