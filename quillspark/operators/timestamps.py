"""Mixed timestamp formats and time zones to one UTC instant.

Every value is reduced to a shape mask (a class per character: digit, letter, the character itself otherwise). A mask is
mapped to a parser once per worker; all values of one mask have their fields at the same places, so they are cut out and
converted as NumPy columns. Local times go through per-zone transition tables that carry the version of the zone data.
"""

from __future__ import annotations

import math
import re
import struct
import unicodedata
import zoneinfo
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from importlib import resources
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import free_name

OK, NULL, UNPARSED, NO_TIME, INVALID, SKIPPED = "ok", "null", "unparsed", "no_time", "invalid", "skipped"

# Offsets in minutes of zone abbreviations in their usual North American and European meaning.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540,
}
MONTHS = {m[:n].lower(): k + 1 for k, m in enumerate("January February March April May June July August September October November December".split()) for n in {3, len(m)}} | {"sept": 9}
WEEKDAYS = {w[:n].lower() for w in "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split() for n in (2, 3, len(w))} | {"tues", "thur", "thurs"}
HALVES = {"am": 0, "a.m.": 0, "上午": 0, "凌晨": 0, "早上": 0, "午前": 0, "pm": 1, "p.m.": 1, "下午": 1, "晚上": 1, "午後": 1, "中午": 1}

# Shapes as patterns over masks, where 9 is a digit and a is a letter; z is whatever names the zone.
_CLOCK = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?"
_SHAPES = [
    re.compile(x)
    for x in (
        rf"(?P<y>9999)[-/](?P<mo>9{{1,2}})[-/](?P<d>9{{1,2}})(?:(?P<sep>a)| +){_CLOCK}(?: ?(?P<half>c\.?c\.?))?(?P<z>.*)",
        r"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<sep>a)?(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,](?P<f>9{1,12}))?(?P<z>(?:[a+\- \[].*)?)",
        rf"(?:(?P<w>a+)\.?,? +)?(?P<d>9{{1,2}})[ -](?P<mon>a+)\.?,?[ -](?P<y>9999|99),? +{_CLOCK}(?: ?(?P<half>c\.?c\.?))?(?P<z>.*)",
        rf"(?:(?P<w>a+)\.?,? +)?(?P<mon>a+)\.? +(?P<d>9{{1,2}}),? +(?P<y>9999),? +(?:aa +)?{_CLOCK}(?: ?(?P<half>c\.?c\.?))?(?P<z>.*)",
        rf"(?P<d>9{{1,2}})\.(?P<mo>9{{1,2}})\.(?P<y>9999|99),? +{_CLOCK}(?P<z>.*)",
        rf"(?P<mo>9{{1,2}})/(?P<d>9{{1,2}})/(?P<y>9999|99),? +{_CLOCK}(?: ?(?P<half>c\.?c\.?))?(?P<z>.*)",
        r"(?P<y>9999)年 ?(?P<mo>9{1,2})月 ?(?P<d>9{1,2})日 *(?P<half>c{2})? *(?P<h>9{1,2})[:時时](?P<mi>99)分?(?:[:]?(?P<s>99)秒?)?(?P<z>.*)",
    )
]
_DATES = [
    re.compile(x)
    for x in (
        r"9999[-/.]9{1,2}[-/.]9{1,2}", r"99999999", r"(?:a+\.?,? +)?9{1,2}[ -]a+\.?,?[ -](?:9999|99)", r"(?:a+,? +)?a+\.? +9{1,2},? +9999",
        r"9{1,2}[./]9{1,2}[./](?:9999|99)", r"9999年 ?9{1,2}月 ?9{1,2}日", r"9999-99",
    )
]
_NUMBER = re.compile(r"-?9+(?:\.9+)?")
_TO_MASK = {**{ord(c): "9" for c in "0123456789"}, **{ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "c" for c in "上下午凌晨早晚中前後"}, ord("\t"): " ", 0xA0: " "}
_OFFSET = re.compile(r"(?:(?:UTC|GMT) ?)?([+\-−])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?(?: ?\[[\w/+\-]+\]| ?\([^()]*\))?", re.I)


_HALF = re.compile(r"(?<=\d)( ?)[AaPp](\.?)[Mm](?![A-Za-z/_])")


def shape_mask(value: str) -> str:
    """A class for each character: digits 9, Latin letters a, letters that name a half of the day c, anything else itself."""
    return _HALF.sub("\\1上\\2上", value).translate(_TO_MASK)


def zone_data_version() -> str:
    """The version of the zone data of this machine, "unknown" if it states none."""
    for root in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            try:
                with open(Path(root, name)) as f:
                    if m := re.match(pattern, f.readline()):
                        return m[1]
            except OSError:
                pass
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """Transitions of one zone: `starts[i]` is the UTC second from which `offsets[i + 1]` holds; before the first, `offsets[0]`."""

    version: str
    starts: np.ndarray
    offsets: np.ndarray

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of local seconds, and whether the local time exists. The earlier instant of a time that occurred twice."""
        around = np.searchsorted(self.starts, local - 86400 * 2, side="right")
        best, found = np.zeros_like(local), np.zeros(len(local), bool)
        # The intervals that a local time can fall into lie within two days around it.
        for step in range(int((np.searchsorted(self.starts, local + 86400 * 2, side="right") - around).max(initial=0)) + 1):
            at = np.minimum(around + step, len(self.offsets) - 1)
            utc = local - self.offsets[at]
            fits = ~found & (np.searchsorted(self.starts, utc, side="right") == at)
            best[fits], found = utc[fits], found | fits
        return best, found


def _zone_file(name: str) -> bytes | None:
    """The compiled data of an IANA zone, None for an unknown name."""
    if not re.fullmatch(r"[A-Za-z0-9_+\-]+(?:/[A-Za-z0-9_+\-]+)*", name):
        return None
    for root in zoneinfo.TZPATH:
        path = Path(root, name)
        if path.is_file():
            data = path.read_bytes()
            return data if data[:4] == b"TZif" else None
    try:
        data = resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()
    except (ModuleNotFoundError, OSError, ValueError):
        return None
    return data if data[:4] == b"TZif" else None


_POSIX = re.compile(r"(?:<[^>]+>|[A-Za-z]+)(?P<std>[+-]?[\d:]+)(?:(?:<[^>]+>|[A-Za-z]+)(?P<dst>[+-]?[\d:]+)?,(?P<start>[^,]+),(?P<end>[^,]+))?")


def _hms(text: str) -> int:
    sign = -1 if text[0] == "-" else 1
    return sign * sum(int(x) * 60 ** (2 - i) for i, x in enumerate(text.lstrip("+-").split(":")))


def _rule_seconds(rule: str, years: np.ndarray) -> np.ndarray:
    """Local seconds of the change that a footer rule (Mm.w.d, Jn or n, with a time) names in each year."""
    day, _, time = rule.partition("/")
    first = (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype("i8")
    if day[0] == "M":
        month, week, weekday = map(int, day[1:].split("."))
        begin = ((years - 1970) * 12 + month - 1).astype("datetime64[M]")
        d, after = begin.astype("datetime64[D]").astype("i8"), (begin + 1).astype("datetime64[D]").astype("i8")
        days = d + (weekday - (d + 4)) % 7 + 7 * (week - 1)
        days = np.where(days >= after, days - 7, days)
    else:
        leap = (years % 4 == 0) & ((years % 100 != 0) | (years % 400 == 0))
        n = int(day.lstrip("J"))
        days = first + (n - 1 + (leap & (n >= 60)) if day[0] == "J" else n)
    return days * 86400 + (_hms(time) if time else 7200)


@lru_cache(maxsize=1024)
def zone_table(name: str, until: int = 2100) -> ZoneTable | None:
    """The table of an IANA zone, None for an unknown name: the transitions of its file, and those of its footer rule to the year `until`."""
    data = _zone_file(name)
    if data is None:
        return None
    at, width = 0, 4
    for version in (1, 2):
        utc, std, leaps, n, types, chars = struct.unpack(">6l", data[at + 20 : at + 44])
        body = at + 44
        if version == 1 and data[4:5] >= b"2":
            at, width = body + n * 5 + types * 6 + chars + leaps * 8 + std + utc, 8
            continue
        break
    starts = np.frombuffer(data, ">i8" if width == 8 else ">i4", n, body).astype("i8")
    index = np.frombuffer(data, "u1", n, body + n * width)
    infos = [struct.unpack(">lBB", data[body + n * (width + 1) + 6 * i : body + n * (width + 1) + 6 * i + 6]) for i in range(types)]
    before = next((i for i in infos if not i[1]), infos[0])
    offsets = np.concatenate([[before[0]], np.array([i[0] for i in infos], "i8")[index]]).astype("i8")
    footer = data[body + n * (width + 1) + types * 6 + chars + leaps * (width + 4) + std + utc :].strip().decode() if width == 8 else ""
    if m := _POSIX.fullmatch(footer):
        normal = -_hms(m["std"])
        last = int(starts[-1]) if n else -(1 << 60)
        if m["start"]:
            summer = -_hms(m["dst"]) if m["dst"] else normal + 3600
            years = np.arange(max(1901, int(np.datetime64(max(last, -(2**31)), "s").astype("datetime64[Y]").astype("i8")) + 1970), until + 1)
            changes = np.concatenate([_rule_seconds(m["start"], years) - normal, _rule_seconds(m["end"], years) - summer])
            to = np.repeat([summer, normal], len(years))
            order = np.argsort(changes, kind="stable")
            order = order[changes[order] > last]
            starts, offsets = np.concatenate([starts, changes[order]]), np.concatenate([offsets, to[order]])
        elif offsets[-1] != normal:
            starts, offsets = np.append(starts, max(last, -(2**31))), np.append(offsets, normal)
    # Entries that change a name or a flag but not the offset are left out.
    keep = np.flatnonzero(np.diff(offsets) != 0)
    return ZoneTable(zone_data_version(), starts[keep], np.concatenate([offsets[:1], offsets[keep + 1]]))


@lru_cache(maxsize=65536)
def _zone(text: str) -> tuple[str, object]:
    """What a written zone means: ('none', None), ('offset', seconds), ('zone', name) or ('bad', None)."""
    text = re.sub(r"\s*\([^()]*\)$", "", text.strip()).strip()
    if not text:
        return "none", None
    if text.upper() in ABBREVIATIONS:
        return "offset", ABBREVIATIONS[text.upper()] * 60
    if m := _OFFSET.fullmatch(text):
        hours, minutes, seconds = int(m[2]), int(m[3] or 0), int(m[4] or 0)
        if hours <= 18 and minutes < 60 and seconds < 60:
            return "offset", (hours * 3600 + minutes * 60 + seconds) * (1 if m[1] == "+" else -1)
        return "bad", None
    if m := re.fullmatch(r"(?:Z ?)?\[([\w/+\-]+)\]", text):
        if text[0] == "Z":
            return "offset", 0
        text = m[1]
    if text.upper() in ABBREVIATIONS:
        return "offset", ABBREVIATIONS[text.upper()] * 60
    return ("zone", text) if zone_table(text) else ("bad", None)


@lru_cache(maxsize=65536)
def _parser(mask: str) -> tuple[str, dict[str, tuple[int, int]] | None]:
    """The kind of a mask and where its fields lie. Found once for each distinct mask of a worker."""
    if _NUMBER.fullmatch(mask) and mask != "99999999":
        return "number", None
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            return "fields", {k: m.span(k) for k, v in m.groupdict().items() if v is not None and v != ""}
    return ("date" if any(d.fullmatch(mask) for d in _DATES) else "none"), None


_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "i8")


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date is real."""
    real = (m >= 1) & (m <= 12) & (y >= 1)
    mm = np.where(real, m, 1)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    real &= (d >= 1) & (d <= _DAYS[mm] + (leap & (mm == 2)))
    months = (y - 1970) * 12 + mm - 1
    return months.astype("datetime64[M]").astype("datetime64[D]").astype("i8") + d - 1, real


def parse_batch(values: pd.Series, zones: pd.Series | None = None, default_zone: str = "UTC") -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds and a status for each value. `zones` names the zone of a value that writes none."""
    n = len(values)
    seconds, status = np.zeros(n, "i8"), np.full(n, UNPARSED, object)
    raw = values.to_numpy(object)
    home = np.full(n, None, object) if zones is None else zones.to_numpy(object)
    groups: dict[str, list[int]] = {}
    texts: list[str] = [""] * n
    for i, v in enumerate(raw):
        if v is None or v != v:
            status[i] = NULL
            continue
        v = v.strip()
        if not v.isascii():
            v = unicodedata.normalize("NFKC", v).strip()
        texts[i] = v
        groups.setdefault(shape_mask(v), []).append(i)
    for mask, members in groups.items():
        kind, spans = _parser(mask)
        at = np.array(members)
        if kind == "number":
            for i in members:
                whole = int(texts[i].split(".")[0])
                size = abs(whole)
                unit = 1 if size < 10**11 else 10**3 if size < 10**14 else 10**6 if size < 10**17 else 10**9
                value = whole // unit - (texts[i][0] == "-" and unit == 1 and "." in texts[i] and int(texts[i].split(".")[1]) > 0)
                if abs(value) < 10**12:
                    seconds[i], status[i] = value, OK
                else:
                    status[i] = INVALID
        elif kind == "date":
            status[at] = NO_TIME
        elif kind == "fields":
            seconds[at], status[at] = _convert([texts[i] for i in members], len(mask), spans, home[at], default_zone)
    return seconds, status


def _convert(texts: list[str], width: int, spans: dict[str, tuple[int, int]], home: np.ndarray, default_zone: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    codes = np.array(texts, f"U{width}").view("u4").reshape(n, width).astype("i8")

    def number(k: str, default: int = 0) -> np.ndarray:
        if k not in spans:
            return np.full(n, default, "i8")
        a, b = spans[k]
        return (codes[:, a:b] - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype="i8"))

    def words(k: str, meaning, bad: int = -1) -> np.ndarray:
        a, b = spans[k]
        names, inverse = np.unique([t[a:b] for t in texts], return_inverse=True)
        return np.array([meaning(str(x), bad) for x in names], "i8")[inverse]

    year = number("y")
    if spans["y"][1] - spans["y"][0] == 2:
        year = year + 2000
    month = words("mon", lambda x, bad: MONTHS.get(x.lower(), bad)) if "mon" in spans else number("mo")
    days, good = _days(year, month, number("d"))
    hour, minute, second = number("h"), number("mi"), number("s")
    if "half" in spans:
        half = words("half", lambda x, bad: HALVES.get(x.lower(), bad))
        good &= (half >= 0) & (hour <= 23)
        twelve = (hour >= 1) & (hour <= 12)
        hour = np.where(twelve, hour % 12 + 12 * (half == 1), hour)
    known = np.ones(n, bool)
    if "w" in spans:
        known &= words("w", lambda x, bad: int(x.lower() in WEEKDAYS)) == 1
    if "sep" in spans:
        known &= words("sep", lambda x, bad: int(x in "Tt")) == 1
    good &= (hour < 24) & (minute < 60) & (second < 60)
    local = days * 86400 + hour * 3600 + minute * 60 + second
    out, status = np.zeros(n, "i8"), np.full(n, OK, object)
    a, b = spans.get("z", (width, width))
    written, inverse = np.unique([t[a:b] for t in texts], return_inverse=True)
    exists = np.ones(n, bool)
    for k, w in enumerate(written):
        mine = np.flatnonzero(inverse == k)
        kind, meaning = _zone(str(w))
        if kind == "offset":
            out[mine] = local[mine] - meaning
        elif kind == "bad":
            known[mine] = False
        else:
            names = np.full(len(mine), meaning, object) if kind == "zone" else np.array([z if isinstance(z, str) and zone_table(z.strip()) else default_zone for z in home[mine]], object)
            for name in set(names):
                part = mine[names == name]
                until = 9999 if year[part].max() >= 2099 else 2100
                out[part], exists[part] = zone_table(name.strip(), until).to_utc(local[part])
    status[~exists] = SKIPPED
    status[~good] = INVALID
    status[~known] = UNPARSED
    return out, status


_RESULT = T.StructType([T.StructField("sec", T.LongType()), T.StructField("status", T.StringType())])


def utc_seconds(value: Column, zone: Column | None = None, default_zone: str = "UTC") -> Column:
    """Column expression: struct(sec, status) of a written timestamp; `zone` is the zone of values that write none."""
    version = zone_data_version()

    def convert(values: pd.Series, zones: pd.Series) -> pd.DataFrame:
        if zone_data_version() != version:
            raise RuntimeError(f"zone data {zone_data_version()} on this executor, {version} on the driver")
        seconds, status = parse_batch(values, zones, default_zone)
        return pd.DataFrame({"sec": pd.array(np.where(status == OK, seconds, 0), "Int64").copy(), "status": status}).assign(sec=lambda x: x.sec.where(x.status == OK))

    udf = F.pandas_udf(convert, _RESULT)
    return udf(value.cast("string"), (F.lit(None) if zone is None else zone).cast("string"))


_FRACTION = re.compile(r"(?::\d{2}|^\d{8}[Tt]\d{6})[.,](\d{1,12})")


def _micros(text: str, second: int) -> int:
    """Microseconds of a written timestamp whose whole UTC second is known; what is finer is cut off."""
    text = unicodedata.normalize("NFKC", text.strip()).strip()
    if m := re.fullmatch(r"(-?\d+)(?:\.(\d+))?", text):
        power = next((p for bound, p in ((10**11, 0), (10**14, 3), (10**17, 6)) if abs(int(m[1])) < bound), 9)
        return math.floor(Fraction(text) * 10**6 / 10**power)
    m = _FRACTION.search(text)
    return second * 1_000_000 + (int(m[1].ljust(6, "0")[:6]) if m else 0)


def utc_micros(value: Column) -> Column:
    """Column expression: UTC microseconds of a written timestamp, null unless its status is ok; without a zone it is UTC."""
    version = zone_data_version()

    def convert(values: pd.Series) -> pd.Series:
        if zone_data_version() != version:
            raise RuntimeError(f"zone data {zone_data_version()} on this executor, {version} on the driver")
        seconds, status = parse_batch(values)
        return pd.Series([_micros(v, int(x)) if ok == OK else None for v, x, ok in zip(values, seconds, status)], dtype="Int64")

    return F.pandas_udf(convert, T.LongType())(value.cast("string"))


def normalize_timestamps(df: DataFrame, value: str, zone: str | None = None, default_zone: str = "UTC") -> DataFrame:
    """Add `utc_sec` (BIGINT), `utc_ts` (TIMESTAMP) and `utc_status` for the written timestamps of column `value`.

    Status is ok, null (no value), unparsed (empty or of no known shape), no_time (a date alone), invalid (no such date, time
    or offset) or skipped (a local time its zone jumped over); `utc_sec` and `utc_ts` are null unless it is ok. A written
    offset, abbreviation or zone name holds; else the zone of column `zone`, and `default_zone` where that is null or unknown.
    A local time that occurred twice is the earlier instant. Bare numbers are Unix time in s, ms, us or ns by magnitude.
    Repeated rows stay, an empty table gives an empty table; a new column whose name is taken gets a number behind it.
    """
    names = [free_name(df.columns, x) for x in ("utc_sec", "utc_ts", "utc_status")]
    tmp = free_name(df.columns, "_utc")
    out = df.withColumn(tmp, utc_seconds(F.col(f"`{value}`"), F.col(f"`{zone}`") if zone else None, default_zone))
    return out.select(
        *(F.col(f"`{c}`") for c in df.columns), F.col(tmp)["sec"].alias(names[0]), F.timestamp_seconds(F.col(tmp)["sec"]).alias(names[1]), F.col(tmp)["status"].alias(names[2])
    )


def written_instants(episodes: DataFrame, shows: DataFrame, clicks: DataFrame, feed_zones: DataFrame) -> DataFrame:
    """(tab, rec_id, utc_sec, status) of the three written fields; feeds give the zone of their episodes."""
    zones = feed_zones.where(F.col("show_id").isNotNull()).groupBy("show_id").agg(F.min("zone").alias("zone"))
    first = episodes.select(F.lit("episodes").alias("tab"), F.col("episode_id").alias("rec_id"), F.col("pub_date").alias("written"), "show_id").join(zones, "show_id", "left").drop("show_id")
    none = F.lit(None).cast("string").alias("zone")
    second = shows.select(F.lit("shows").alias("tab"), F.col("show_id").alias("rec_id"), F.col("updated_at").alias("written"), none)
    third = clicks.select(F.lit("click_log").alias("tab"), F.concat("request_id", F.lit(":"), F.col("clicked_rank").cast("string")).alias("rec_id"), F.col("timestamp").alias("written"), none)
    return normalize_timestamps(first.unionByName(second).unionByName(third), "written", "zone").select("tab", "rec_id", "utc_sec", F.col("utc_status").alias("status"))


def found_instants(episodes: DataFrame, shows: DataFrame, clicks: DataFrame, feed_zones: DataFrame) -> DataFrame:
    """p3_found: the values that name a real date and time of day, distinct."""
    return written_instants(episodes, shows, clicks, feed_zones).where((F.col("status") == OK) & F.col("rec_id").isNotNull()).select("tab", "rec_id", "utc_sec").distinct()
