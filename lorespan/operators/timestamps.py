"""Timestamps of mixed notations and zones, normalised to one instant in UTC.

Texts are parsed with JVM expressions into wall-clock microseconds and a zone
text.  Wall-clock times of a region are as-of joined to the offset intervals of
that region, laid out on its local timeline and exploded by (zone, local year).
Where two intervals cover a local time it is ambiguous, where none does it is
nonexistent; ``n_match`` keeps that count.  The intervals are cut into disjoint
segments beforehand, so each row meets exactly one of them and no row is
multiplied.
"""

from __future__ import annotations

import bisect
import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions.text import address_of, strip

US = 1_000_000
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: Largest number of rows of the segment table that is broadcast: all public regions together stay below it.
MAX_SEGMENTS = 400_000

# Month names by language.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jänner": 1, "janvier": 1, "janv": 1, "enero": 1, "ene": 1, "gennaio": 1, "janeiro": 1, "januari": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "fevrier": 2, "févr": 2, "febrero": 2, "febbraio": 2, "fevereiro": 2, "februari": 2,
    "mar": 3, "march": 3, "märz": 3, "maerz": 3, "mär": 3, "mars": 3, "marzo": 3, "março": 3, "maart": 3,
    "apr": 4, "april": 4, "avril": 4, "avr": 4, "abril": 4, "abr": 4, "aprile": 4,
    "may": 5, "mai": 5, "mayo": 5, "maggio": 5, "maio": 5, "mei": 5, "maj": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6, "giugno": 6, "junho": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7, "juil": 7, "julio": 7, "luglio": 7, "julho": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "agosto": 8, "ago": 8, "augustus": 8, "augusti": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9, "settembre": 9, "setembro": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "octobre": 10, "octubre": 10, "ottobre": 10, "outubro": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11, "novembro": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "décembre": 12, "decembre": 12, "déc": 12, "diciembre": 12, "dic": 12, "dicembre": 12, "dezembro": 12,
}

# Minutes east of UTC of common abbreviations, for homes that do not use the abbreviation themselves.
ABBREVIATIONS = {
    "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
    "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "PKT": 300, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "BRT": -180, "SAST": 120,
}

_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_AP = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(Z|z|[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)?(?:\s*[\[(][A-Za-z_/+\-0-9 ]*[\])])?"
_MON = r"(\p{L}{3,10})\.?"
#: (pattern, template of year|month|day|hour|minute|second|fraction|half|zone)
NOTATIONS = [
    (rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt\s]+{_T}{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"(?:\p{{L}}{{2,10}}\.?,?\s+)?(\d{{1,2}})\.?[\s-]+{_MON}[\s-]+(\d{{4}}),?(?:\s+{_T}{_AP}(?:\s*Uhr)?{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"\p{{L}}{{2,9}}\.?,?\s+{_MON}\s+(\d{{1,2}})\s+{_T}\s*(Z|[+-]\d{{2}}:?\d{{2}}|[A-Za-z]{{2,5}})?\s+(\d{{4}})", "$8|$1|$2|$3|$4|$5|$6||$7"),
    (rf"(?:\p{{L}}{{2,10}}\.?,?\s+)?{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}}),?(?:\s+{_T}{_AP}{_ZONE})?", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:,?\s+{_T}{_AP}{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?(?:\s+{_T}{_AP}(?:\s*Uhr)?{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{1,2}})-{_MON}-(\d{{2}}|\d{{4}})(?:\s+(\d{{1,2}})[.:](\d{{2}})(?:[.:](\d{{2}})(?:[.,](\d{{1,9}}))?)?{_AP}{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(\d{{4}})年\s*(\d{{1,2}})月\s*(\d{{1,2}})日(?:\s*(\d{{1,2}})時(\d{{1,2}})分(?:(\d{{1,2}})秒)?{_ZONE})?", "$1|$2|$3|$4|$5|$6|||$7"),
]
_SLASH = rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_T}{_AP}{_ZONE})?"
_SLASH_ORDERS = {"mdy": "$3|$1|$2|$4|$5|$6|$7|$8|$9", "dmy": "$3|$2|$1|$4|$5|$6|$7|$8|$9", "ymd": "$1|$2|$3|$4|$5|$6|$7|$8|$9"}
#: An epoch of 9 to 11 digits counts seconds, 12 or 13 milliseconds, 15 to 17 microseconds, 18 to 20 nanoseconds.
_EPOCH = r"^\d{9,20}$"


@lru_cache(maxsize=None)
def offset_intervals(zone: str) -> list[tuple[int, int, int, str]]:
    """(first UTC second, end, offset in seconds, abbreviation) of a region from 1900 to 2100."""
    tz, utc, step = ZoneInfo(zone), dt.timezone.utc, 14 * 86_400
    lo = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc).timestamp())
    hi = int(dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=utc).timestamp())
    epoch = dt.datetime(1970, 1, 1, tzinfo=utc)

    def at(second: int) -> tuple[int, str]:
        local = (epoch + dt.timedelta(seconds=second)).astimezone(tz)
        return int(local.utcoffset().total_seconds()), local.tzname()

    found, start, now = [], lo, at(lo)
    for probe in range(lo + step, hi + step, step):
        then = at(min(probe, hi))
        while then != now:  # the change lies in the last step: halve until it is found
            a, b = max(start, probe - step), min(probe, hi)
            change = a + 1 + bisect.bisect_left(range(a + 1, b), True, key=lambda s: at(s) != now)
            found.append((start, change, *now))
            start, now = change, at(change)
    return [*found, (start, hi, *now)]


def zone_segments(zone: str) -> list[tuple[str, int, int, int, int, int]]:
    """(zone, local year, first local second, end, offset to use, matching intervals).

    A doubly covered stretch takes the offset of its first run, an uncovered
    stretch the offset in force before it, which moves its times forward.
    """
    spans = offset_intervals(zone)
    cuts: list[tuple[int, int, int, int]] = []
    begin = -(2**40)
    for k, (_, end, offset, _) in enumerate(spans):
        if k + 1 == len(spans):
            cuts.append((begin, 2**40, offset, 1))
            break
        here, there = end + offset, end + spans[k + 1][2]
        cuts.append((begin, min(here, there), offset, 1))
        if here != there:
            cuts.append((min(here, there), max(here, there), offset, 2 if there < here else 0))
        begin = max(here, there)
    rows, first = [], lambda y: int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    for a, b, offset, n in cuts:
        if a >= b:
            continue
        ya = FIRST_YEAR if a < first(FIRST_YEAR) else (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=a)).year
        yb = LAST_YEAR if b > first(LAST_YEAR + 1) else (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=b - 1)).year
        rows += [(zone, y, a, b, offset, n) for y in range(ya, min(yb, LAST_YEAR) + 1)]
    return rows


def _fields(text: Column, order: Column) -> Column:
    """Array of the nine texts of a notation; null if none fits."""
    picked = None
    for pattern, template in NOTATIONS:
        whole = f"^{pattern}$"
        case = (F.regexp_like(text, F.lit(whole)), F.regexp_replace(text, whole, template))
        picked = F.when(*case) if picked is None else picked.when(*case)
    whole = f"^{_SLASH}$"
    by_order = F.when(order == "mdy", F.regexp_replace(text, whole, _SLASH_ORDERS["mdy"]))
    by_order = by_order.when(order == "dmy", F.regexp_replace(text, whole, _SLASH_ORDERS["dmy"]))
    by_order = by_order.when(order == "ymd", F.regexp_replace(text, whole, _SLASH_ORDERS["ymd"]))
    return F.split(picked.when(F.regexp_like(text, F.lit(whole)), by_order), r"\|", -1)


def normalize_timestamps(df: DataFrame, text: str, zone: str, order: str) -> DataFrame:
    """Add ``epoch_us`` (BIGINT, null where the text names no valid instant) and ``n_match``.

    ``text``: column of the notation; ``zone``: column of the home region (null:
    none); ``order``: column of the date order of slash dates (mdy, dmy, ymd).
    ``n_match`` is the number of offset intervals that cover the wall-clock
    time: 1, 2 (ambiguous: the first run is taken), 0 (nonexistent: moved
    forward), null where an offset or epoch was stated.  Null, empty and
    unreadable texts, impossible dates, times and offsets, and times without a
    zone or home give null.  All other columns are kept, whatever their names;
    columns named like the results are replaced.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("epoch_us", "n_match")]
    t = F.regexp_replace(strip(F.col(text)), r"(?U)\s+", " ")
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_ts_row"), t.alias("_ts_text"), F.col(zone).alias("_ts_home"), F.lower(F.col(order)).alias("_ts_order"))
    df = df.withColumn("_ts_f", _fields(F.col("_ts_text"), F.col("_ts_order")))
    f = lambda k: F.nullif(F.get("_ts_f", F.lit(k)), F.lit(""))
    number = lambda k: F.expr(f"try_cast(nullif(get(_ts_f, {k}), '') as int)")
    month_map = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    year, month = number(0), F.coalesce(number(1), F.try_element_at(month_map, F.lower(f(1))))
    year = F.when(F.length(f(0)) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)
    hour, minute, second = F.coalesce(number(3), F.lit(0)), F.coalesce(number(4), F.lit(0)), F.coalesce(number(5), F.lit(0))
    half = F.lower(f(7))
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    micros = F.coalesce(F.rpad(F.substring(f(6), 1, 6), 6, "0").cast("bigint"), F.lit(0).cast("bigint"))
    day = F.datediff(F.try_make_timestamp_ntz(year, month, number(2), F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.lit("1970-01-01").cast("date"))
    local = F.when((hour < 24) & (minute < 60) & (second < 60) & (year > 0), ((day.cast("bigint") * 24 + hour) * 60 + minute) * 60 + second)
    df = df.withColumns({"_ts_local": local, "_ts_us": micros, "_ts_zone": f(8)})

    stated = F.upper(F.col("_ts_zone"))
    sign = F.when(F.col("_ts_zone").startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(F.substring("_ts_zone", 2, 9), ":", "")
    digits = F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0"))
    hh, mm = F.expr("1") * F.substring(digits, 1, 2).cast("int"), F.substring(digits, 3, 2).cast("int")
    numeric = F.when((mm < 60) & (sign * (hh * 60 + mm)).between(-12 * 60, 14 * 60), sign * (hh * 60 + mm) * 60)
    is_numeric = F.regexp_like("_ts_zone", F.lit(r"^[+-]\d"))
    named = F.col("_ts_zone").contains("/")
    df = df.withColumns({
        "_ts_direct": F.when(stated.isin("Z", "UTC", "GMT", "UT"), 0).when(is_numeric, numeric),
        "_ts_abbr": F.when(~is_numeric & ~named & ~stated.isin("Z", "UTC", "GMT", "UT"), stated),
        "_ts_region": F.when(F.col("_ts_zone").isNull(), F.col("_ts_home")).when(named, F.col("_ts_zone")),
    })

    # Regions in use: at most as many as there are public regions.
    public = available_timezones()
    stated_regions = df.where(F.col("_ts_text").contains("/")).select(F.regexp_extract("_ts_text", r" ([A-Z][A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)$", 1).alias("z"))
    homes = df.select(F.col("_ts_home").alias("z"))
    used = stated_regions.union(homes).where(F.col("z").isin(sorted(public))).distinct()
    regions = sorted(r.z for r in used.collect())
    segments = [row for z in regions for row in zone_segments(z)]
    latest: dict[tuple[str, str], int] = {}
    for z in regions:
        for s, _, o, a in offset_intervals(z):
            if a.isalpha():
                latest[z, a] = o
    if len(segments) > MAX_SEGMENTS:
        raise ValueError("more zone segments than all public regions have")
    seg = spark.createDataFrame(segments, "_ts_region string, _ts_year int, _ts_a bigint, _ts_b bigint, _ts_offset int, n_match int")
    abb = spark.createDataFrame([(*k, v) for k, v in latest.items()], "_ts_home string, _ts_abbr string, _ts_home_offset int")
    table = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])

    df = df.join(F.broadcast(abb), ["_ts_home", "_ts_abbr"], "left")
    offset = F.coalesce("_ts_direct", "_ts_home_offset", F.try_element_at(table, F.col("_ts_abbr")))
    year_key = F.least(F.greatest(F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_ts_local") / 86_400).cast("int"))), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR))
    df = df.withColumns({"_ts_year": year_key, "_ts_stated": offset})
    df = df.join(F.broadcast(seg), (df._ts_region == seg._ts_region) & (df._ts_year == seg._ts_year) & (df._ts_local >= seg._ts_a) & (df._ts_local < seg._ts_b), "left").drop(seg._ts_region, seg._ts_year)

    number_text = F.when(F.regexp_like("_ts_text", F.lit(_EPOCH)), F.col("_ts_text"))
    n = F.length(number_text)
    value = number_text.cast("decimal(20,0)")
    scaled = F.when(n <= 11, value * US).when(n <= 13, value * 1000).when(n.between(15, 17), value).when(n >= 18, F.floor(value / 1000))
    wall = (F.col("_ts_local") - F.coalesce("_ts_stated", "_ts_offset").cast("bigint")) * US + F.col("_ts_us")
    return df.select(*[F.col(f"_ts_row.`{c}`").alias(c) for c in columns], F.coalesce(scaled.cast("bigint"), wall).alias("epoch_us"), "n_match")


def corpus_timestamps(mail: DataFrame, claims: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """(src, ord, pos, epoch_us) of every readable timestamp of the mail and the evidence."""
    path = F.filter(F.split("filepath", "/"), lambda x: x != "")
    m = mail.select(F.lit("mail").alias("src"), "ord", F.lit(0).cast("bigint").alias("pos"), "timestamp", F.get(F.reverse(path), F.lit(2)).alias("home"))
    e = claims.select("ord", F.posexplode("evidence").alias("pos", "e")).select(
        F.lit("evidence").alias("src"), "ord", F.col("pos").cast("bigint").alias("pos"), F.col("e.timestamp").alias("timestamp"), address_of(F.col("e.author")).alias("home")
    )
    homes = mailboxes.select(F.col("mailbox").alias("home"), "zone", "date_order").union(mailboxes.select(F.lower(strip(F.col("address"))), "zone", "date_order"))
    homes = homes.dropna(subset=["home"]).dropDuplicates(["home"])
    rows = m.union(e).where(~F.coalesce(F.length(strip(F.col("timestamp"))) == 0, F.lit(True))).join(homes, "home", "left")
    return normalize_timestamps(rows, "timestamp", "zone", "date_order").where("epoch_us is not null").select("src", "ord", "pos", "epoch_us")
