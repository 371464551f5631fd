"""Text expressions: HTML to text, normalisation, paragraphs, script language."""

from __future__ import annotations

import html
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, for patterns of the JVM (whose own \s is ASCII).
SPACE = r"(?U)\s"


class _TextNodes(HTMLParser):
    """Text between tags and comments, a node each; text of scripts and styles is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.skipping, self._open = [], 0, []

    def _close_node(self):
        if self._open:
            self.nodes.append("".join(self._open))
            self._open = []

    def handle_starttag(self, tag, attrs):
        self._close_node()
        self.skipping += tag in ("script", "style")

    def handle_endtag(self, tag):
        self._close_node()
        if tag in ("script", "style") and self.skipping:
            self.skipping -= 1

    def handle_comment(self, data):
        self._close_node()

    def handle_data(self, data):
        if not self.skipping:
            self._open.append(data)

    def close(self):
        super().close()
        self._close_node()


def _parse(text: str) -> str:
    parser = _TextNodes()
    parser.feed(html.unescape(text))
    parser.close()
    return "\n".join(parser.nodes)


def html_text(text: Column) -> Column:
    """Text nodes of an HTML text, one a line, without scripts, styles and comments. Entities are read first, so an escaped tag vanishes.

    Texts without a tag or an entity never leave the JVM.
    """
    marked = F.regexp_like(text, F.lit(r"<|&[#\w]"))
    parsed = F.pandas_udf(lambda s: s.map(_parse, na_action="ignore"), "string")(F.when(marked, text))
    return F.coalesce(parsed, text)


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts never leave the JVM."""
    other = F.when(~F.regexp_like(text, F.lit(r"^\p{ASCII}*$")), text)
    return F.coalesce(F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore"), "string")(other), text)


def squeeze(text: Column) -> Column:
    """Control characters deleted, white space other than line breaks one space, at most two line breaks, each line trimmed."""
    clean = F.regexp_replace(text, r"[\x00-\x09\x0b-\x1f\x7f]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?U)[\s&&[^\n]]+", " "), r"\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), "\n")


def normalize(text: Column) -> Column:
    return squeeze(nfkc(text))


def clean_text(text: Column) -> Column:
    """What cleaning starts from: the text of HTML, normalised."""
    return normalize(html_text(text))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones; no part for a null text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n(?U)\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def script_language(text: Column) -> Column:
    """zh if more than 30 % of the characters but spaces are ideographs, else en; unknown for an empty text."""
    solid = F.length(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))
    east = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    return F.when(solid == 0, F.lit("unknown")).when(east / solid > 0.3, F.lit("zh")).otherwise(F.lit("en"))


def comparable(text: Column) -> Column:
    """Lower case, without anything but word characters and spaces, spaces squeezed: two paragraphs that differ in punctuation are equal."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\p{Z}]", "")
    return F.trim(F.regexp_replace(kept, r"[\s\p{Z}]+", " "))
