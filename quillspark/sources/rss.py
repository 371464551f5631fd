"""RSS feeds, one file a show: read whole, repaired, parsed in the JVM, exploded to episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X

_IMAGE = "`itunes:image` struct<_href:string>, image struct<url:string>"
_ITEM = (
    "struct<title:string, guid:string, description:string, `content:encoded`:string, pubDate:string, `itunes:duration`:string, `itunes:summary`:string, `dc:creator`:string, "
    "`itunes:episodeType`:string, link:string, enclosure:struct<_url:string,_type:string,_length:string>, `itunes:image`:struct<_href:string>, image:struct<url:string>, "
    "`psc:chapters`:struct<`psc:chapter`:array<struct<_start:string,_title:string>>>>"
)
FEED = f"channel struct<title:string, description:string, language:string, `itunes:author`:string, `itunes:image`:struct<_href:string>, image:struct<url:string>, link:string, item:array<{_ITEM}>>"


def repaired(xml: Column) -> Column:
    """XML without control characters and with bare ampersands escaped; well-formed text stays as it is."""
    clean = F.regexp_replace(xml, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(clean, r"&(?!#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)", "&amp;")


def feeds_of(files: DataFrame) -> DataFrame:
    """(show_id, feed) of (path, value): the show's id is the file's stem. `feed.channel` is null where a file is no feed."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select(F.url_decode(stem).alias("show_id"), F.from_xml(repaired(F.col("value")), FEED, {"mode": "PERMISSIVE"}).alias("feed"))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of a directory or pattern; unreadable files come out with a null channel and are left out by shows_of and episodes_of."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return feeds_of(files)


def _text(c: str) -> Column:
    """Stripped text; null for a missing or empty element."""
    return F.regexp_replace(F.nullif(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def _image(base: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{base}.`itunes:image`._href"), F.lit("")), _text(f"{base}.image.url"))


def shows_of(feeds: DataFrame) -> DataFrame:
    f = feeds.where(F.col("feed.channel").isNotNull())
    c = "feed.channel"
    return f.select("show_id", F.coalesce(_text(f"{c}.title"), F.lit("")).alias("title"), _text(f"{c}.description").alias("description"), _text(f"{c}.language").alias("language"), _text(f"{c}.`itunes:author`").alias("author"), _image(c).alias("image_url"), _text(f"{c}.link").alias("link"))


def episodes_of(feeds: DataFrame) -> DataFrame:
    """One row an item. A length that is not all digits is null; chapters without start or title are dropped, none at all is null."""
    items = feeds.where(F.col("feed.channel").isNotNull()).select("show_id", F.explode("feed.channel.item").alias("i"))
    guid = F.coalesce(_text("i.guid"), F.lit(""))
    chapters = F.transform(
        F.filter(F.col("i.`psc:chapters`.`psc:chapter`"), lambda x: (F.coalesce(x["_start"], F.lit("")) != "") & (F.coalesce(x["_title"], F.lit("")) != "")),
        lambda x: F.struct(x["_start"].alias("start"), F.trim(x["_title"]).alias("title")),
    )
    number = F.when(F.size(F.split("show_id", ":")) >= 3, F.col("show_id")).otherwise(F.concat(F.lit("::"), F.col("show_id")))
    return items.select(
        X.episode_id(number, guid).alias("episode_id"), "show_id", guid.alias("guid"), F.coalesce(_text("i.title"), F.lit("")).alias("title"), _text("i.description").alias("description"), _text("i.`content:encoded`").alias("content_encoded"),
        _text("i.pubDate").alias("pub_date"), _text("i.`itunes:duration`").alias("duration"), F.col("i.enclosure._url").alias("audio_url"), F.col("i.enclosure._type").alias("audio_type"),
        F.when(F.regexp_like("i.enclosure._length", F.lit("^[0-9]+$")), F.col("i.enclosure._length").try_cast("bigint")).alias("audio_length"), _text("i.link").alias("link"), _text("i.`itunes:summary`").alias("itunes_summary"),
        _text("i.`dc:creator`").alias("creator"), _text("i.`itunes:episodeType`").alias("episode_type"), F.when(F.size(chapters) > 0, chapters).alias("chapters"), _image("i").alias("image_url"),
    )
