"""Lines repeated across one source's documents.

Lines are parsed into templates by token trees of fixed depth: the levels below a source are the number of words and the
first words, a leaf holds templates in which varying words are wildcard slots. A source's documents lie whole in buckets of
bounded size; each bucket builds its own tree and counts the documents of each template. What covers more than a share of a
source's documents covers more than that share of one bucket at least, so each bucket hands on only such templates, a
bounded number. They are merged by source; the lines that a merged template covers are counted over all buckets, and the
templates that cover enough documents are standing.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, free_name

DEPTH = 2  # words that lead to a leaf; they are never slots
SIMILAR = 0.5  # share of a template's words that stay fixed
WILDCARD = "*"
#: Documents and characters that a bucket of a source holds.
BUCKET_DOCS, BUCKET_CHARS = 4096, 8_000_000
_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*>|<!--[^\n]*?-->")
_ENTITY = regex.compile(r"&#?\w+;")
_WORD = regex.compile(r"\p{L}+")


def words_of(line: str) -> list[str]:
    """The words (runs of letters) of a line without tags and with entities read, in lower case."""
    if "<" in line:
        line = _TAG.sub("", line)
    if "&" in line and _ENTITY.search(line):
        line = html.unescape(line)
    return _WORD.findall(line.lower().replace("ß", "ss"))


def _path(words: list[str]) -> tuple:
    return len(words), *words[:DEPTH]


def covers(template: list[str], words: list[str]) -> bool:
    return len(template) == len(words) and all(t == WILDCARD or t == w for t, w in zip(template, words))


class Tree:
    """Templates by leaf. An index of words by place finds the similar ones without reading all of a leaf.

    A line joins the template that keeps most of its words fixed, the first among equals, if that leaves the share SIMILAR
    of its words; the words in which they differ become slots. Otherwise it is a template of its own.
    """

    def __init__(self):
        self.templates: list[list[str]] = []
        self._leaves: dict[tuple, tuple[list[int], dict[tuple[int, str], set[int]]]] = {}

    def add(self, words: list[str]) -> int:
        n, path = len(words), _path(words)
        leaf, at = self._leaves.setdefault(path, ([], {}))
        least = int(np.ceil(n * SIMILAR)) - min(n, DEPTH)  # beyond the words of the path, which are equal
        same: dict[int, int] = {}
        for k in range(DEPTH, n):
            for i in at.get((k, words[k]), ()):
                same[i] = same.get(i, 0) + 1
        best = min(same, key=lambda i: (-same[i], i)) if same else leaf[0] if leaf else -1
        if best >= 0 and same.get(best, 0) >= least:
            template = self.templates[best]
            for k in range(DEPTH, n):
                if template[k] != words[k] and template[k] != WILDCARD:
                    at[k, template[k]].discard(best)
                    template[k] = WILDCARD
            return best
        best = len(self.templates)
        self.templates.append(list(words))
        leaf.append(best)
        for k in range(DEPTH, n):
            if words[k] != WILDCARD:
                at.setdefault((k, words[k]), set()).add(best)
        return best


class Bucket:
    """Documents of one source (or of one bucket of it): their lines, and the templates of these."""

    def __init__(self):
        self.letters: dict[str, int] = {}
        self.words: list[list[str]] = []
        self.lines: list[tuple[str, int, int]] = []
        self.docs: set[str] = set()
        self._seen: dict[str, int] = {}

    def add(self, doc: str, lines: list[str], places: list[int] | None) -> None:
        self.docs.add(doc)
        for no, line in enumerate(lines) if places is None else zip(places, lines):
            i = self._seen.get(line)
            if i is None:
                words = words_of(line)
                i = -1
                if words:  # equal letters are one line, however they are spaced; the least spelling stands for it
                    key = "".join(words)
                    i = self.letters.setdefault(key, len(self.words))
                    if i == len(self.words):
                        self.words.append(words)
                    elif words < self.words[i]:
                        self.words[i] = words
                self._seen[line] = i
            if i >= 0 and no is not None:
                self.lines.append((doc, no, i))

    def rows(self, share: float, least_docs: int, whole: bool) -> Iterator[tuple]:
        """(kind, doc, line_no, key, leaf, words, docs): how many documents; the templates that cover more than the share; lines.

        `whole` tells that the source has no other bucket, so that what fails here fails for the source; of such a source
        only lines that lie in the leaf of a template come out, of others all.
        """
        yield "documents", None, None, None, None, None, len(self.docs)
        tree, of = Tree(), np.empty(len(self.words), "i8")
        for i in sorted(range(len(self.words)), key=self.words.__getitem__):
            of[i] = tree.add(self.words[i])
        number = {d: k for k, d in enumerate(sorted(self.docs))}
        at = np.array([i for _, _, i in self.lines], "i8")
        pairs = np.unique(of[at] * len(number) + np.array([number[d] for d, _, _ in self.lines], "i8")) if len(at) else at
        counts = np.bincount(pairs // max(1, len(number)), minlength=len(tree.templates))
        leaves = set()
        for t, n in zip(tree.templates, counts.tolist()):
            if n > share * len(self.docs) and (n >= least_docs or not whole):
                leaf = leaf_of(t)
                leaves.add(leaf)
                yield "template", None, None, None, leaf, " ".join(t), n
        leaf = [leaf_of(w) for w in self.words]
        key = [_hash("".join(w)) for w in self.words]
        text = [" ".join(w) for w in self.words]
        for doc, no, i in self.lines:
            if not whole or leaf[i] in leaves:
                yield "line", doc, no, key[i], leaf[i], text[i], None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def leaf_of(words: list[str]) -> int:
    return _hash("\n".join(map(str, _path(words))))


_ROWS = "source string, kind string, doc string, line_no bigint, key bigint, leaf bigint, words string, docs bigint"


def _buckets(share: float, least_docs: int):
    types = pa.schema([("source", pa.string()), ("kind", pa.string()), ("doc", pa.string()), ("line_no", pa.int64()), ("key", pa.int64()), ("leaf", pa.int64()), ("words", pa.string()), ("docs", pa.int64())])

    def batch(source: str, rows: list[tuple]) -> pa.RecordBatch:
        kind, *rest = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([source] * len(rows), pa.string()), *(pa.array(c, f.type) for c, f in zip((kind, *rest), list(types)[1:]))], schema=types)

    def finished(source: str, bucket: Bucket, whole: bool) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in bucket.rows(share, least_docs, whole):
            rows.append(row)
            if len(rows) == 8192:
                yield batch(source, rows)
                rows = []
        if rows:
            yield batch(source, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, bucket = None, True, Bucket()
        for b in batches:
            for source, number, buckets, doc, text, places in zip(*(b.column(c).to_pylist() for c in ("source", "bucket", "buckets", "doc", "text", "places"))):
                if at != (source, number):
                    if at is not None:
                        yield from finished(at[0], bucket, whole)
                    at, whole, bucket = (source, number), buckets == 1, Bucket()
                bucket.add(doc, text.split("\n") if text or places is None else [], places)
        if at is not None:
            yield from finished(at[0], bucket, whole)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The templates of each source as one tree; a partition holds whole sources, in their order."""

    def finished(source: str, found: set[str]) -> pa.RecordBatch:
        tree = Tree()
        for t in sorted(found):
            tree.add(t.split(" "))
        # A template whose words turned into slots may now be another's equal.
        texts = sorted({" ".join(t) for t in tree.templates})
        return pa.RecordBatch.from_arrays([pa.array([source] * len(texts), pa.string()), pa.array([leaf_of(t.split(" ")) for t in texts], pa.int64()), pa.array(texts, pa.string())], ["source", "leaf", "template"])

    at, found = None, set()
    for b in batches:
        for source, template in zip(b.column("source").to_pylist(), b.column("words").to_pylist()):
            if source != at:
                if at is not None:
                    yield finished(at, found)
                at, found = source, set()
            found.add(template)
    if at is not None:
        yield finished(at, found)


def parsed(docs: DataFrame, share: float, least_docs: int, bucket_docs: int, bucket_chars: int) -> DataFrame:
    """Documents (source, doc, text, places), none of the first three null, as rows of `Bucket.rows`, written once."""
    sizes = docs.groupBy("source").agg(F.ceil(F.greatest(F.count("*") / F.lit(bucket_docs), F.sum(F.length("text")) / F.lit(bucket_chars), F.lit(1))).cast("int").alias("buckets"))
    placed = docs.join(sizes, "source").withColumn("bucket", F.pmod(F.xxhash64("doc"), F.col("buckets")).cast("int")).select("source", "bucket", "buckets", "doc", "text", "places")
    return cut_lineage(placed.repartition("source", "bucket").sortWithinPartitions("source", "bucket").mapInArrow(_buckets(share, least_docs), _ROWS))


def covered_lines(rows: DataFrame) -> DataFrame:
    """(source, doc, line_no, key, template): the lines that a template of their source covers."""
    templates = rows.where("kind = 'template'").select("source", "words").distinct().repartition("source").sortWithinPartitions("source").mapInArrow(_merge, "source string, leaf bigint, template string")
    fits = F.forall(F.zip_with(F.split("template", " "), F.split("words", " "), lambda t, w: (t == WILDCARD) | (t == w)), lambda x: x)
    return rows.where("kind = 'line'").join(templates, ["source", "leaf"]).where(fits).select("source", "doc", "line_no", "key", "template")


def _documents(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'documents'").groupBy("source").agg(F.sum("docs").alias("documents"))


def _standing(counted: DataFrame, documents: DataFrame, least_docs: int, share: float) -> DataFrame:
    return counted.where(F.col("docs") >= least_docs).join(documents, "source").where(F.col("docs") > F.lit(share) * F.col("documents"))


def _rows(docs: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    cols = [F.col(f"`{c}`").cast("string").alias(n) for c, n in ((source, "source"), (doc, "doc"), (text, "text"))]
    return docs.select(*cols, F.lit(None).cast("array<bigint>").alias("places")).dropna(subset=["source", "doc", "text"])


def find_standing_lines(docs: DataFrame, source: str, doc: str, text: str, least_docs: int = 5, share: float = 0.2, bucket_docs: int = BUCKET_DOCS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(source, doc, line_no, template) of the lines that a standing template covers, distinct.

    A template is standing if at least `least_docs` documents of its source, and more than the share `share` of them, have
    a line that it covers. Slots stand for one word each and never for the first two; at least half of a template's words
    are fixed. Case, spacing, punctuation, digits and markup do not matter, line_no counts blank lines too. Rows with a null
    source, document or text have no such line; an empty text counts as a document without lines; repeated rows count once.
    """
    rows = parsed(_rows(docs, source, doc, text), share, least_docs, bucket_docs, bucket_chars)
    covered = covered_lines(rows)
    standing = _standing(covered.groupBy("source", "template").agg(F.countDistinct("doc").alias("docs")), _documents(rows), least_docs, share)
    return covered.join(standing.select("source", "template"), ["source", "template"], "left_semi").select("source", "doc", "line_no", "template").distinct()


def remove_standing_lines(docs: DataFrame, source: str, doc: str, text: str, out: str = "cleaned_text", least_docs: int = 5, share: float = 0.2) -> DataFrame:
    """The documents with a column in which the lines of standing templates are left out; all rows and columns stay.

    Null texts stay null; where `out` is taken the new column gets a number behind its name.
    """
    found = find_standing_lines(docs, source, doc, text, least_docs, share).groupBy(F.col("source").alias("_source"), F.col("doc").alias("_doc")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone"))
    out = free_name(docs.columns, out)
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda _, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    same = (F.col(f"`{source}`").cast("string") == F.col("_source")) & (F.col(f"`{doc}`").cast("string") == F.col("_doc"))
    return docs.join(found, same, "left").select(*(F.col(f"`{c}`") for c in docs.columns), F.array_join(kept, "\n").alias(out))


def find_repeated_lines(docs: DataFrame, least_docs: int = 5, share: float = 0.2, bucket_docs: int = BUCKET_DOCS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(source, doc, line_no) of the lines of (source, doc, text, places) that their source repeats with the same letters, distinct.

    Only lines that a template of the trees covers are candidates: a line that is often enough is so in one bucket at least,
    and its template there with it. An exact count of the candidates' letters decides.
    """
    rows = parsed(docs, share, least_docs, bucket_docs, bucket_chars)
    lines = rows.where("kind = 'line'").select("source", "doc", "line_no", "key")
    candidates = covered_lines(rows).select("source", "key").distinct()
    counted = lines.join(candidates, ["source", "key"], "left_semi").groupBy("source", "key").agg(F.countDistinct("doc").alias("docs"))
    repeated = _standing(counted, _documents(rows), least_docs, share)
    return lines.join(repeated.select("source", "key"), ["source", "key"], "left_semi").select("source", "doc", "line_no").distinct()


def paragraph_documents(cleaned: DataFrame) -> DataFrame:
    """(show_id, episode_id, text, places): the paragraphs of an episode as lines of one text, and the index of each line."""
    return cleaned.select(
        "show_id", "episode_id",
        F.array_join(F.transform("cleaned.paragraphs", lambda p: F.regexp_replace(F.coalesce(p["text"], F.lit("")), "\n", " ")), "\n").alias("text"),
        F.transform("cleaned.paragraphs", lambda p: p["index"].cast("bigint")).alias("places"),
    ).where((F.size("places") > 0) | F.col("cleaned.normalized.description").isNotNull())


def found_standing_lines(episodes: DataFrame, cleaned: DataFrame, least_docs: int = 5, share: float = 0.2) -> DataFrame:
    """p2_found."""
    source = lambda field: F.concat_ws("|", F.lit(field), "show_id").alias("source")
    own = episodes.where(F.col("show_id").isNotNull()).select(source("description"), F.col("episode_id").alias("doc"), F.col("description").alias("text"), F.lit(None).cast("array<bigint>").alias("places"))
    theirs = paragraph_documents(cleaned).where(F.col("show_id").isNotNull()).select(source("paragraphs"), F.col("episode_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))
    found = find_repeated_lines(own.unionByName(theirs).dropna(subset=["doc", "text"]), least_docs, share)
    return found.select(F.substring_index("source", "|", 1).alias("field"), F.col("doc").alias("episode_id"), "line_no").distinct()
