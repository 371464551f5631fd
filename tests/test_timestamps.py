import datetime as dt
import random
import zoneinfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import timestamps as T


def sec(*args, **kw):
    return int(dt.datetime(*args, tzinfo=dt.timezone.utc, **kw).timestamp())


CASES = [
    ("Sat, 13 Aug 2022 09:00:56 +0000", None, sec(2022, 8, 13, 9, 0, 56)),
    ("Mon, 13 Aug 2022 09:00:56 GMT", None, sec(2022, 8, 13, 9, 0, 56)),
    ("Thu, 22 Aug 2019 03:51:46 UT", None, sec(2019, 8, 22, 3, 51, 46)),
    ("Fri, 5 Aug 2022 20:05:41 CEST", None, sec(2022, 8, 5, 18, 5, 41)),
    ("12 Mar 21 05:11 -0600", None, sec(2021, 3, 12, 11, 11)),
    ("wed, 21 December 2022 13:22:29 +01:00", None, sec(2022, 12, 21, 12, 22, 29)),
    ("20200611T000253Z", None, sec(2020, 6, 11, 0, 2, 53)),
    ("2023-06-03T11:17:21.742650072-04:00", None, sec(2023, 6, 3, 15, 17, 21)),
    ("2024-01-01 12:18:26,701Z", None, sec(2024, 1, 1, 12, 18, 26)),
    ("2021-01-09T21:06:57[Asia/Taipei]", None, sec(2021, 1, 9, 13, 6, 57)),
    ("2024-04-24 16:34:33 Asia/Tokyo", None, sec(2024, 4, 24, 7, 34, 33)),
    ("31.3.2023 16:34", "Europe/Berlin", sec(2023, 3, 31, 14, 34)),
    ("6/24/2023 7:12 PM", None, sec(2023, 6, 24, 19, 12)),
    ("6/24/2023 12:12 AM", None, sec(2023, 6, 24, 0, 12)),
    ("2022年1月11日 下午12:28", "Asia/Taipei", sec(2022, 1, 11, 4, 28)),
    ("2022年4月26日 上午12:54", None, sec(2022, 4, 26, 0, 54)),
    ("1649315750", None, 1649315750),
    ("1649315750668", None, 1649315750),
    ("1704078497096948", None, 1704078497),
    ("1724160740.555", None, 1724160740),
    ("2024-11-03T01:30:00", "America/New_York", sec(2024, 11, 3, 5, 30)),
    ("２０２４-01-01T00:00:00Z", None, sec(2024, 1, 1)),
    (" \t2024-01-01T00:00:00Z ", None, sec(2024, 1, 1)),
    ("2024-02-29 00:00:00", "not/a zone", sec(2024, 2, 29)),
]
BAD = [
    ("2023-02-31T10:00:00Z", T.INVALID), ("0000-00-00 00:00:00", T.INVALID), ("Thu, 32 Mar 2023 09:00:00 GMT", T.INVALID), ("2021-06-07T25:61:00", T.INVALID),
    ("2024-07-08", T.NO_TIME), ("21 Nov 2020", T.NO_TIME), ("20240101", T.NO_TIME), ("12:30", T.UNPARSED), ("", T.UNPARSED), ("n/a", T.UNPARSED),
    ("2024-01-01 00:00:00 Mars/Base", T.UNPARSED), ("Xyz, 01 Jan 2024 00:00:00 GMT", T.UNPARSED), (None, T.NULL), ("9" * 40, T.INVALID),
]


@pytest.mark.parametrize("text,zone,want", CASES)
def test_forms(text, zone, want):
    s, status = T.parse_batch(pd.Series([text]), pd.Series([zone]))
    assert (status[0], s[0]) == (T.OK, want)


@pytest.mark.parametrize("text,status", BAD)
def test_unusable(text, status):
    assert T.parse_batch(pd.Series([text], dtype=object))[1][0] == status


def test_skipped_local_time():
    assert T.parse_batch(pd.Series(["Sun, 31 Mar 2024 02:30:00"]), pd.Series(["Europe/Berlin"]))[1][0] == T.SKIPPED


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2050, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"]))
def test_local_times_as_the_library_has_them(when, name):
    when = when.replace(microsecond=0)
    s, status = T.parse_batch(pd.Series([when.isoformat()]), pd.Series([name]))
    zone = zoneinfo.ZoneInfo(name)
    back = [when.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc) for f in (0, 1)]
    real = [b for b in back if b.astimezone(zone).replace(tzinfo=None) == when]
    if real:
        assert (status[0], s[0]) == (T.OK, int(min(real).timestamp()))
    else:
        assert status[0] == T.SKIPPED


def test_edges(spark):
    rows = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", 1), ("a", "2024-01-01T00:00:00Z", 1), (None, None, 2), ("b", "x" * 100_000, 3)], "k string, v string, utc_sec int")
    out = T.normalize_timestamps(rows, "v")
    assert out.columns == ["k", "v", "utc_sec", "utc_sec_1", "utc_ts", "utc_status"]
    assert sorted((r.k or "", r.utc_sec_1, r.utc_status) for r in out.collect()) == [("", None, "null"), ("a", 1704067200, "ok"), ("a", 1704067200, "ok"), ("b", None, "unparsed")]
    assert T.normalize_timestamps(rows.limit(0), "v").count() == 0


@pytest.mark.parametrize("name", ["America/New_York", "Europe/Dublin", "Asia/Tokyo", "Australia/Lord_Howe", "America/Sao_Paulo", "Africa/Casablanca", "Asia/Kolkata", "Europe/London", "America/St_Johns", "Antarctica/Troll", "UTC", "Pacific/Apia", "Asia/Gaza"])
def test_zone_tables_against_zoneinfo(name):
    zone, table = zoneinfo.ZoneInfo(name), T.zone_table(name, 9999)
    rng = random.Random(1)
    seconds = [rng.randint(-2_600_000_000, 9_000_000_000) for _ in range(3000)] + [int(x) + d for x in table.starts[:400] for d in (-1, 0, 1)] + [200_000_000_000]
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    for sec in seconds:
        if sec > -2_600_000_000:
            want = (epoch + dt.timedelta(seconds=sec)).astimezone(zone).utcoffset().total_seconds()
            assert table.offsets[np.searchsorted(table.starts, sec, side="right")] == want, (name, sec)


FAR = [("2150-07-01 12:00:00 America/New_York", 5695977600), ("1940-07-01 12:00:00 Europe/London", -931006800), ("1940-01-15 12:00:00 America/New_York", -945500400), ("9998-07-01 00:00:00 Europe/Berlin", 253354860000), ("2150-03-08 02:30:00 America/New_York", None)]


@pytest.mark.parametrize("text,want", FAR)
def test_years_far_from_now(text, want):
    seconds, status = T.parse_batch(pd.Series([text]))
    assert (status[0], seconds[0]) == (T.OK, want) if want is not None else status[0] == T.SKIPPED
