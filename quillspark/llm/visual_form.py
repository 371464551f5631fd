"""Visually identical text with different characters: one canonical form in which equal-looking texts are equal.

Quick-check properties (which characters can change, or combine with what stands before them) are compiled into one
character class. Only the segments it finds, with one character of context before them, are normalised; they are spliced
into the text around them, which stays as it is. Texts without such a segment never leave the JVM.

Letters that look like Latin ones come from the public confusables data that ICU holds (part of Spark). They are read as
Latin only in a word that has Latin letters or mixes scripts, or in a line that has such a word and no letter that is clearly
of another alphabet; a word of one other script in a text of that script stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, free_name

# Punctuation that looks like a basic sign.
SIGNS = {0x2010: "-", 0x2011: "-", 0x2024: ".", 0x0589: ":", 0x01C0: "|"}
# Compatibility decompositions of these kinds look like what they decompose to; others (², ½, ①, …) do not.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_SAME_LOOK_RANGES = ((0xFB00, 0xFB4F), (0x2E80, 0x2FDF), (0x2160, 0x217F), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133), (0x3131, 0x318E))
_PLANES = ((0x80, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
#: Where most characters of texts that never change lie: ASCII, Latin letters, quotes and dashes, kana, ideographs.
_COMMON = ((0x0A, 0x0A), (0x20, 0x7E), (0xA1, 0x17E), (0x2013, 0x2014), (0x2018, 0x201F), (0x2026, 0x2026), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF))
_INVISIBLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0}


def _invisible(c: int) -> bool:
    return c in _INVISIBLE or 0xFE00 <= c <= 0xFE0F or 0xE0000 <= c <= 0xE01EF or (unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2, 0x110BD))


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], list[tuple[int, int]], re.Pattern]:
    """What each character becomes after canonical decomposition, the ranges of unstable characters, and the pattern of their segments."""
    becomes: dict[int, str] = dict(SIGNS)
    unstable: set[int] = set(SIGNS)
    for a, b in _PLANES:
        for c in range(a, b):
            if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4:
                continue
            ch, kind = chr(c), unicodedata.decomposition(chr(c))
            if _invisible(c):
                becomes[c] = ""
            elif ch.isspace():
                becomes[c] = " "
            elif c not in becomes and (kind.startswith(_SAME_LOOK) or kind.startswith("<compat>") and any(x <= c <= y for x, y in _SAME_LOOK_RANGES)):
                becomes[c] = unicodedata.normalize("NFKC", ch)
            if c in becomes or unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
                unstable.add(c)
            if kind and kind[0] != "<":
                unstable.update(int(x, 16) for x in kind.split()[1:])  # may combine with what stands before it
    unstable |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0x9, 0xE), *range(0x1C, 0x20)} - {0x0A}
    becomes |= {c: " " for c in (*range(0x9, 0xE), *range(0x1C, 0x20)) if c != 0x0A}
    ranges = _ranges(unstable)
    cls = "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return becomes, ranges, re.compile(f"(?:[^\\n{cls}]?[{cls}]+)+")


def _ranges(codes: set[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def lookalikes(spark: SparkSession) -> dict[int, str]:
    """Cased letters beyond the alphabets in everyday Latin use that ICU's confusables data take for one basic Latin letter.

    Among I, l, 1 and |, which these data do not tell apart, a capital is I. Letters that decompose into such a letter and
    marks become the Latin letter with these marks.
    """
    codes = [c for c in range(0x250, 0x11000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Lu", "Ll")]
    found = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(map(chr, codes))).split("\n")
    looks = {}
    for c, latin in zip(codes, found, strict=True):
        if len(latin) == 1 and latin.isascii() and latin.isalpha():
            looks[c] = "I" if latin == "l" and chr(c).isupper() else latin
    for a, b in ((0x370, 0x530), (0x1F00, 0x2000)):
        for c in range(a, b):
            base, *marks = unicodedata.normalize("NFD", chr(c))
            if marks and ord(base) in looks:
                looks[c] = unicodedata.normalize("NFC", looks[ord(base)] + "".join(marks))
    return looks


_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_SCRIPTS = [re.compile(x) for x in (r"[\u0370-\u03ff\u1f00-\u1fff]", r"[\u0400-\u052f]", r"[\u0530-\u058f]", r"[\u13a0-\u13ff\uab70-\uabbf]", r"[\u2c80-\u2cff]")]
_OTHER = re.compile(r"[\u0370-\u058f\u10a0-\u10ff\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\uab70-\uabbf]")


class Canonical:
    """The canonical form of texts, with a table of lookalike letters (none: letters stay)."""

    def __init__(self, looks: dict[int, str] | None = None):
        self.looks = looks or {}
        self._any = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(set(self.looks))) + "]") if self.looks else None

    def stable_class(self) -> str:
        """Common characters that never change, as a class for the JVM of a few ranges (it tries ranges one by one)."""
        changing = {c for a, b in _tables()[1] for c in range(a, b + 1)} | set(self.looks)
        return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges({c for a, b in _COMMON for c in range(a, b + 1)} - changing))

    def _segment(self, m: re.Match) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", m[0]).translate(_tables()[0]))

    def _line(self, line: str) -> str:
        if not self._any.search(line):
            return line
        words = _WORD.findall(line)
        mixed = {w for w in words if _LATIN.search(w) or sum(bool(x.search(w)) for x in _SCRIPTS) > 1}
        if not mixed:
            return line
        clear = any(ord(c) not in self.looks for c in _OTHER.findall(line))
        return _WORD.sub(lambda m: m[0].translate(self.looks) if not clear or m[0] in mixed else m[0], line)

    def __call__(self, text: str) -> str:
        """Unstable segments normalised, lookalike letters read as Latin, runs of white space one space, none at line ends."""
        if not text.isascii() or "\t" in text or "\r" in text or not text.isprintable() and any(c < " " and c != "\n" for c in text):
            pattern = _tables()[2]
            text = pattern.sub(self._segment, text)
            if self._any is not None and self._any.search(text):
                text = pattern.sub(self._segment, "\n".join(map(self._line, text.split("\n"))))
        if _LOOSE.search(text):
            text = "\n".join(" ".join(line.split(" ")).strip(" ") if "  " not in line else " ".join(x for x in line.split(" ") if x) for line in text.split("\n"))
        return text


_LOOSE = re.compile(r" {2,}|^ | $", re.M)


def canonical_form(spark: SparkSession) -> Callable[[Column], Column]:
    """An expression of the canonical form. Texts of common characters that never change, without a loose space, stay in the JVM."""
    form = Canonical(lookalikes(spark))
    changes = f"[^{form.stable_class()}]" + r"|  | $|^ |\n | \n"

    def run(s: pd.Series) -> pd.Series:
        return s.map(form, na_action="ignore")

    udf = F.pandas_udf(run, "string")
    return lambda text: F.coalesce(udf(F.when(F.regexp_like(text, F.lit(changes)), text)), text)


def with_canonical_form(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """Add the canonical form of column `text`. Null stays null, an empty text stays empty; rows and other columns stay as they are.

    Where `out` is taken the new column gets a number behind its name. Case, accents, words and visible punctuation are kept.
    """
    return df.withColumn(free_name(df.columns, out), canonical_form(df.sparkSession)(F.col(f"`{text}`")))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def lookalike_classes(df: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """(group..., key, form, variant): the keys of one group whose texts have one canonical form but not all the same characters.

    `form` names the class and `variant` the exact text, both as digests; a key stands in it once for each of its texts.
    Texts with equal characters are one variant, and forms with one variant have no row, so exact copies, however many, are
    counted by partial aggregation only. Rows with a null group, key or text are in no class; repeated rows count once.
    """
    canonical = canonical_form(df.sparkSession)
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    # Digests of every row, normalised once and read twice.
    rows = cut_lineage(rows.select(*group, F.col(key).alias("key"), _digest(F.col(text)).alias("variant"), _digest(canonical(F.col(text))).alias("form")))
    mixed = rows.groupBy(*group, "form").agg(F.min("variant").alias("_lo"), F.max("variant").alias("_hi")).where(F.col("_lo") < F.col("_hi")).select(*group, "form")
    return rows.join(mixed, [*group, "form"], "left_semi").distinct()


def lookalike_pairs(classes: DataFrame, group: list[str]) -> DataFrame:
    """(group..., key_a, key_b): the classes written out as pairs of keys with different characters, the smaller key first."""
    other = classes.select(*group, "form", F.col("key").alias("_key"), F.col("variant").alias("_variant"))
    both = classes.join(other, [*group, "form"]).where((F.col("key") < F.col("_key")) & (F.col("variant") != F.col("_variant")))
    return both.select(*group, F.col("key").alias("key_a"), F.col("_key").alias("key_b")).distinct()


def episode_texts(episodes: DataFrame) -> DataFrame:
    """(show_id, episode_id, field, text): titles and descriptions."""
    return episodes.select("show_id", "episode_id", F.explode(F.create_map(F.lit("title"), F.col("title"), F.lit("description"), F.col("description"))).alias("field", "text"))


def episode_classes(episodes: DataFrame) -> DataFrame:
    """(field, show_id, episode_id, form, variants): the class of each episode that looks like another of its show, and its number of variants."""
    classes = lookalike_classes(episode_texts(episodes), ["field", "show_id"], "episode_id", "text")
    many = classes.groupBy("field", "show_id", "form").agg(F.countDistinct("variant").alias("variants"))
    return classes.join(many, ["field", "show_id", "form"]).select("field", "show_id", F.col("key").alias("episode_id"), F.hex("form").alias("form"), "variants").distinct()


def found_lookalikes(episodes: DataFrame, query_log: DataFrame, query_catalog: DataFrame) -> DataFrame:
    """p5_found."""
    group = ["field", "show_id"]
    own = lookalike_pairs(lookalike_classes(episode_texts(episodes), group, "episode_id", "text"), group).select("field", "key_a", "key_b")
    canonical = canonical_form(episodes.sparkSession)
    asked = query_log.where(F.col("query").isNotNull() & F.col("request_id").isNotNull()).select("request_id", "query")
    # One row for each distinct spelling goes through the normaliser, however often it was asked.
    spelled = asked.groupBy("query").agg(F.lit(1).alias("_n")).select("query", _digest(canonical(F.col("query"))).alias("_form"))
    listed = query_catalog.where(F.col("query").isNotNull() & F.col("query_id").isNotNull()).select("query_id", F.col("query").alias("_listed"), _digest(canonical(F.col("query"))).alias("_form"))
    alike = spelled.join(listed, "_form").where(F.col("query") != F.col("_listed")).select("query", "query_id")
    said = asked.join(alike, "query").select(F.lit("query").alias("field"), F.least("request_id", "query_id").alias("key_a"), F.greatest("request_id", "query_id").alias("key_b")).distinct()
    return own.unionByName(said)
