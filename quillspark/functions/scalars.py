"""Scalar expressions of the data model. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a show's target goes, and the language that target stands for.
ALIASES = {"podcast-episodes-zh-tw": "episodes-zh-tw", "podcast-episodes-zh-cn": "episodes-zh-cn", "podcast-episodes-en": "episodes-en"}
LANGUAGES = {"podcast-episodes-zh-tw": "zh-tw", "podcast-episodes-zh-cn": "zh-cn", "podcast-episodes-en": "en"}
# The embedding identity expected of each language.
MODEL, VERSION, DIMS = "paraphrase-multilingual-MiniLM-L12-v2", "text-v1", 384


def blank_to_null(c: Column) -> Column:
    """Null for a text that is empty or white space only."""
    return F.when(F.regexp_replace(c, r"(?U)^\s+|\s+$", "") != "", c)


def lookup(c: Column, values: dict[str, str]) -> Column:
    """The value of a small fixed table, null for a key it lacks."""
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in values.items()))


def route(target: Column) -> Column:
    return lookup(target, ALIASES)


def target_language(target: Column) -> Column:
    return lookup(target, LANGUAGES)


def query_alias(language: Column) -> Column:
    """The index a query of this language searches; anything but zh-cn and en goes to zh-tw."""
    return F.when(language == "zh-cn", F.lit("episodes-zh-cn")).when(language == "en", F.lit("episodes-en")).otherwise(F.lit("episodes-zh-tw"))


def query_language(label: Column) -> Column:
    """The language that a query's label searches in: mixed queries are routed to zh-tw, other labels stay."""
    return F.when(label == "mixed", F.lit("zh-tw")).otherwise(label)


def expected_identity(language: str) -> dict[str, object]:
    """Model, version and length of the vectors of a language; a KeyError for one that has no model."""
    return {"model": MODEL, "version": VERSION, "dims": DIMS} if language in LANGUAGES.values() else {}[language]


def normalize_language(tag: Column) -> Column:
    """English variants en; zh-hans and zh-cn zh-hans; other zh tags zh-hant; else a two-letter primary tag; null otherwise."""
    t = F.lower(tag)
    primary = F.split_part(t, F.lit("-"), F.lit(1))
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(t.startswith("en"), F.lit("en"))
        .when(t.isin("zh-hans", "zh-cn"), F.lit("zh-hans"))
        .when(t.startswith("zh"), F.lit("zh-hant"))
        .when(F.length(primary) == 2, primary)
    )


def parse_duration(text: Column) -> Column:
    """Seconds of 'n', 'm:s' or 'h:m:s'; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: F.when(F.regexp_like(F.trim(p), F.lit(r"^[+-]?\d+$")), F.trim(p).try_cast("int")))
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(F.size(parts) == 1, at(1)).when(F.size(parts) == 2, at(1) * 60 + at(2)).when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3))


def episode_id(show_id: Column, guid: Column) -> Column:
    """Id from the show's number and a hash of the guid; a missing guid hashes the empty text."""
    return F.concat(F.lit("episode:apple:"), F.split_part(show_id, F.lit(":"), F.lit(3)), F.lit(":"), F.substring(F.md5(F.coalesce(guid, F.lit(""))), 1, 8))


def clean_version(version: Column) -> Column:
    """What stands behind the last slash."""
    return F.substring_index(version, "/", -1)


def cache_slug(model: Column, version: Column, dims: Column) -> Column:
    return F.concat(F.replace(model, F.lit("/"), F.lit("--")), F.lit("__"), F.replace(version, F.lit("/"), F.lit("--")), F.lit("__dim"), dims.cast("string"))


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 text; without an offset it is UTC; null where it is none."""
    return F.unix_micros(F.try_to_timestamp(text))


def embedding_text(title: Column, paragraphs: Column) -> Column:
    """Title and kept paragraphs with blank lines between; either alone where the other is missing."""
    body = F.array_join(F.transform(F.filter(paragraphs, lambda p: p["kept"] & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"]), "\n\n")
    return F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), F.nullif(body, F.lit("")))


def annotation_text(title: Column, description: Column, limit: int = 1500) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(description, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def perturb_query(query: Column, most: int = 3) -> Column:
    """Variants of a query: without its first word, without its second, in reverse order; none for a single word."""
    words = F.split(F.regexp_replace(query, r"^\s+|\s+$", ""), r"\s+")
    join = lambda w: F.array_join(w, " ")
    n = F.size(words)
    variants = F.array(join(F.slice(words, 2, n)), join(F.concat(F.slice(words, 1, 1), F.slice(words, 3, n))), join(F.reverse(words)))
    return F.slice(F.when(n >= 2, variants).otherwise(F.array().cast("array<string>")), 1, most)


def id_list(text: Column) -> Column:
    """Ids of a comma-separated list, trimmed, without blanks and repetitions, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def tokens(text: Column) -> Column:
    """The words of the standard analyzer: lower case, each ideograph a word of its own."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[一-鿿]|[\p{L}\p{N}_&&[^一-鿿]]+"), F.lit(0))


def bigrams(words: Column) -> Column:
    """Words of the Chinese field from those of the standard analyzer, in their order: pairs of neighbouring ideographs, other words as they are.

    `words` should be a plain column, since it is read twice.
    """
    one = lambda w: F.regexp_like(w, F.lit(r"^[一-鿿]$"))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(~one(a), a).when(one(b), F.concat(a, b)))
    return F.array_compact(pairs)


def prefixes(text: Column, least: int = 2, most: int = 20) -> Column:
    """Edge n-grams of the words of a text."""
    grams = F.transform(F.filter(tokens(text), lambda t: F.length(t) >= least), lambda t: F.transform(F.sequence(F.lit(least), F.least(F.length(t), F.lit(most))), lambda n: F.substring(t, F.lit(1), n)))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty ones are equal, an empty and another have nothing in common."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)
