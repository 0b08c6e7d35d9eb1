"""Timestamps: notations, daylight saving, and every row against the standard library."""

import datetime as dt
from zoneinfo import ZoneInfo

from lorespan.operators.timestamps import corpus_timestamps, normalize_timestamps, offset_intervals
from lorespan.session import table

SCHEMA = "k int, t string, zone string, o string"


def us(*parts, zone="UTC", fold=0):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000


CASES = [
    ("2002-01-06T00:59:42+01:00", None, None, us(2002, 1, 5, 23, 59, 42)),
    ("2002-01-05T09:45:53.249471-07:00", None, None, us(2002, 1, 5, 16, 45, 53) + 249471),
    ("1010242495000", None, None, 1010242495000000),
    ("1010216237376324", None, None, 1010216237376324),
    ("1010226660", None, None, 1010226660000000),
    ("Sat, 05 Jan 2002 16:24:12 +0100", None, None, us(2002, 1, 5, 15, 24, 12)),
    ("Fri, 11 Jan 2002 03:20:07 -0700 (MST)", "Asia/Tokyo", None, us(2002, 1, 11, 10, 20, 7)),
    ("Thu, 24 Jan 2002 00:12:40 IST", "Asia/Kolkata", None, us(2002, 1, 23, 18, 42, 40)),
    ("Sat Jan 12 08:29:15 MST 2002", "America/Denver", None, us(2002, 1, 12, 15, 29, 15)),
    ("Sat, 12 Jan 2002 00:27:05 SGT", "Asia/Singapore", None, us(2002, 1, 11, 16, 27, 5)),
    ("17-Jan-02 02.52.00 PM", "America/Chicago", None, us(2002, 1, 17, 14, 52, zone="America/Chicago")),
    ("28-Jan-02 12.07 AM", "Europe/London", None, us(2002, 1, 28, 0, 7)),
    ("20020110182154-0700", None, None, us(2002, 1, 11, 1, 21, 54)),
    ("20020110T105600.5-0800", None, None, us(2002, 1, 10, 18, 56) + 500000),
    ("25/01/2002 15:07:50", "Europe/Paris", "dmy", us(2002, 1, 25, 14, 7, 50)),
    ("25/01/2002 15:07:50", "America/Chicago", "mdy", None),
    ("01/06/2002 05:52:29 AM", "America/New_York", "mdy", us(2002, 1, 6, 10, 52, 29)),
    ("2002/05/22 03:19", "Asia/Tokyo", "ymd", us(2002, 5, 21, 18, 19)),
    ("January 11, 2002 2:29:30 PM", "America/Phoenix", None, us(2002, 1, 11, 21, 29, 30)),
    ("27. Januar 2002, 12:52:46 Uhr", "Europe/Berlin", None, us(2002, 1, 27, 11, 52, 46)),
    ("11 septembre 2002 01:11:43", "Europe/Paris", None, us(2002, 9, 10, 23, 11, 43)),
    ("7.1.2002 11:09:22", "Europe/Berlin", None, us(2002, 1, 7, 10, 9, 22)),
    ("2002年3月13日 17時04分26秒", "Asia/Tokyo", None, us(2002, 3, 13, 8, 4, 26)),
    ("2002-07-08", "Europe/London", None, us(2002, 7, 7, 23)),
    ("2002-01-26T13:42:08 America/Chicago", None, None, us(2002, 1, 26, 19, 42, 8)),
    ("2002-01-20T05:25:00-07:00[America/Denver]", None, None, us(2002, 1, 20, 12, 25)),
    # repeated hour: the first run; skipped hour: forward by what was skipped
    ("2002-10-27 01:30:00", "America/Chicago", None, us(2002, 10, 27, 1, 30, zone="America/Chicago")),
    ("2002-04-07 02:30:00", "America/Chicago", None, us(2002, 4, 7, 3, 30, zone="America/Chicago")),
    ("2003-03-30 01:15", "Europe/London", None, us(2003, 3, 30, 1, 15)),
    ("2002-10-27 01:30:00 CST", "America/Chicago", None, us(2002, 10, 27, 7, 30)),
    # none
    ("2002-01-05T23:28:22", None, None, None),
    ("2003-02-30T10:15:00Z", None, None, None),
    ("2004-13-05T08:00:00+01:00", None, None, None),
    ("Thu, 00 Jan 2003 25:61:00 +0000", None, None, None),
    ("2004-01-05T08:00:00+25:00", None, None, None),
    ("2002-01-26T13:42:08 Mars/Olympus", "America/Chicago", None, None),
    ("14:05", "America/Chicago", "mdy", None),
    ("yesterday, 10:20", "America/Chicago", "mdy", None),
    ("", "America/Chicago", "mdy", None),
    (None, "America/Chicago", "mdy", None),
    ("x" * 20000, "America/Chicago", "mdy", None),
]


def test_notations(spark):
    rows = [(k, t, z, o) for k, (t, z, o, _) in enumerate(CASES)]
    got = {r.k: r for r in normalize_timestamps(spark.createDataFrame(rows, SCHEMA), "t", "zone", "o").collect()}
    assert len(got) == len(CASES)
    wrong = [(t, z, want, got[k].epoch_us) for k, (t, z, _, want) in enumerate(CASES) if got[k].epoch_us != want]
    assert not wrong
    by_text = {(t, z): got[k].n_match for k, (t, z, _, _) in enumerate(CASES)}
    assert by_text["2002-10-27 01:30:00", "America/Chicago"] == 2
    assert by_text["2002-04-07 02:30:00", "America/Chicago"] == 0
    assert by_text["2002-07-08", "Europe/London"] == 1


def test_every_hour_of_a_year_against_the_standard_library(spark):
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Africa/Casablanca"):
        hours = [dt.datetime(2011, 1, 1) + dt.timedelta(minutes=30 * k) for k in range(365 * 48)]
        rows = [(k, h.isoformat(), zone, None) for k, h in enumerate(hours)]
        got = {r.k: r.epoch_us for r in normalize_timestamps(spark.createDataFrame(rows, SCHEMA), "t", "zone", "o").collect()}
        tz = ZoneInfo(zone)
        assert [got[k] for k in range(len(hours))] == [int(h.replace(tzinfo=tz).timestamp()) * 1_000_000 for h in hours]


def test_intervals_cover_the_timeline():
    spans = offset_intervals("Europe/London")
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "2002-01-05T00:00:00Z", None, None)] * 2, SCHEMA).selectExpr("*", "'x' as _ts_local", "7 as epoch_us", "8 as n_match", "9 as _ts_row")
    out = normalize_timestamps(df, "t", "zone", "o").collect()
    assert [r.epoch_us for r in out] == [1010188800000000] * 2 and out[0]._ts_local == "x" and out[0]._ts_row == 9
    assert normalize_timestamps(df.limit(0), "t", "zone", "o").count() == 0


def test_corpus_rows_are_unique(spark, data):
    out = corpus_timestamps(table(spark, data, "fetch_corpus"), table(spark, data, "claims"), table(spark, data, "mailboxes"))
    assert out.columns == ["src", "ord", "pos", "epoch_us"]
    assert out.count() == out.select("src", "ord", "pos").distinct().count() > 0
