"""Mixed timestamp formats and time zones, normalised to one UTC instant.

Text is parsed in Arrow batches by one pattern for each way of writing a date and one for the time of day. Local times are then joined as-of to
zone-offset intervals: the transitions of a zone cut local time into spans, each matched by one interval (the offset is plain), by two
(the hour occurs twice) or by none (the hour is skipped).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.runtime import BROADCAST_KEYS, checkpointed, few_rows, hot_keys, skew_join

#: Month names in English, German, Spanish and French, in full and shortened, by number.
MONTHS = {
    1: "january jan januar jänner enero ene janvier janv",
    2: "february feb februar febrero février fevrier févr",
    3: "march mar märz maerz mär marzo mars",
    4: "april apr abril abr avril avr",
    5: "may mai mayo",
    6: "june jun juni junio juin",
    7: "july jul juli julio juillet juil",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre setiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic décembre decembre déc",
}
#: Distinct (zone, year) spans that may be broadcast: 100,000 rows of under 100 bytes.
BROADCAST_SPANS = 100_000
#: Messages of one session that one task of the join may hold; the session of more is copied to as many blocks as they need.
SESSION_CAP = 1 << 17

_MONTH = "(" + "|".join(sorted((n for names in MONTHS.values() for n in names.split()), key=lambda n: (-len(n), n))) + ")\\.?"
_DAYNAME = "(?:[^\\W\\d_]{2,12}\\.?,? )?"
#: Ways to write a date, as (pattern, group of year, of month, of day). Spelt dates allow a weekday before and small words between.
_DATES = [
    ("(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})(?: \\(?[^\\W\\d_]{2,12}\\.?\\)?(?= ))?", 1, 2, 3),
    (_DAYNAME + "(\\d{1,2})(?:\\.|st|nd|rd|th)? (?:de |of )?" + _MONTH + ",? (?:de |del )?(\\d{4})", 3, 2, 1),
    ("(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})", 3, 2, 1),
    (_DAYNAME + _MONTH + " (\\d{1,2})(?:st|nd|rd|th)?,? (\\d{4})", 3, 1, 2),
    ("(\\d{4}) ?年 ?(\\d{1,2}) ?月 ?(\\d{1,2}) ?日", 1, 2, 3),
    ("(\\d{1,2})/(\\d{1,2})/(\\d{4})", 3, 1, 2),
    ("(\\d{4})(\\d{2})(\\d{2})(?=t)", 1, 2, 3),
]
_CLOCK = "(\\d{1,2})[:h](\\d{2})(?::(\\d{2})(?:[.,](\\d+))?)?(?: ?([ap])\\.?m\\.?)?(?: uhr)?"
_BASIC_CLOCK = "(\\d{2})(\\d{2})(\\d{2})?(?:[.,](\\d+))?()"
_ZONE = "( ?z| ?(?:gmt|utc)? ?[-+−]\\d{1,2}(?::?\\d{2})?(?::?\\d{2})?| ?\\[?[^\\W\\d]+/[^\\W\\d]+(?:[/+\\-][/\\w+\\-]*)?\\]?| [^\\W\\d_]{2,5}|)"
_JOIN = "(?:t| at | à | um | on |, | )"


_NUMBER_OF = {word: number for number, words in MONTHS.items() for word in words.split()}


def _patterns() -> list[tuple[re.Pattern, int, int, int, int, int]]:
    """(pattern, group of year, month, day, hour, zone); minute, second, fraction and half of the day follow the hour."""
    out = []
    for date, y, m, d in _DATES:
        if date.endswith("(?=t)"):
            out.append((re.compile(date + "t" + _BASIC_CLOCK + _ZONE), y, m, d, 4, 9))
        out.append((re.compile(date + _JOIN + "?" * date.endswith("日") + _CLOCK + _ZONE), y, m, d, 4, 9))
    for date, y, m, d in _DATES[:6]:
        out.append((re.compile(_CLOCK + "(?: on|,| am| le| el)? " + date + _ZONE), y + 5, m + 5, d + 5, 1, 9))
    return out


_PATTERNS = _patterns()
_UNIX = {10: 1_000_000, 13: 1000, 16: 1}
_EPOCH = dt.date(1970, 1, 1).toordinal()


def parse_text(raw: str | None) -> tuple[int, str] | None:
    """(microseconds of the stated clock since 1970, or of the instant; what was stated of a zone, '' if nothing), or None.

    None for null, blank and meaningless texts, dates or times alone, and days or hours that do not exist. Digits alone are Unix time by
    their number: 10 seconds, 13 milliseconds, 16 microseconds. More than six fraction digits are cut off.
    """
    text = " ".join(raw.lower().split()) if raw else ""
    if not text:
        return None
    if text.isascii() and text.isdigit():
        return (int(text) * _UNIX[len(text)], "z") if len(text) in _UNIX else None
    for pattern, y, m, d, h, z in _PATTERNS:
        hit = pattern.fullmatch(text)
        if hit is None:
            continue
        g = hit.group
        hour, minute, second, half = int(g(h)), int(g(h + 1)), int(g(h + 2) or 0), g(h + 4)
        if half:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (half == "p")
        month = int(g(m)) if g(m).isdigit() else _NUMBER_OF[g(m)]
        if hour > 23 or minute > 59 or second > 59:
            return None
        try:
            days = dt.date(int(g(y)), month, int(g(d))).toordinal() - _EPOCH
        except ValueError:
            return None
        fraction = int(((g(h + 3) or "") + "000000")[:6])
        return (((days * 24 + hour) * 60 + minute) * 60 + second) * 1_000_000 + fraction, (g(z) or "").strip()
    return None


def _parse_batch(raw: pd.Series) -> pd.DataFrame:
    """parse_text over Arrow batches: as one JVM expression the pattern chain grows past what the optimizer holds."""
    parsed = [parse_text(t) for t in raw]
    local = pd.array([p[0] if p else None for p in parsed], dtype="Int64")
    return pd.DataFrame({"local": local, "zone": [p[1] if p else None for p in parsed]})


def parse_time(raw: Column) -> Column:
    """Struct (local long, zone string) of parse_text for every row; both fields null where it gives None."""
    return F.pandas_udf(_parse_batch, "local long, zone string")(raw)


def stated_offset(zone: Column) -> Column:
    """Offset in minutes of z, +hh[:mm] and gmt/utc+h; null for names."""
    sign = F.regexp_extract(zone, "^(?:gmt|utc)? ?([-+−])", 1)
    hours = F.regexp_extract(zone, "[-+−](\\d{1,2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, "[-+−]\\d{1,2}:?(\\d{2})", 1).try_cast("int"), F.lit(0))
    compact = F.regexp_extract(zone, "^(?:gmt|utc)? ?[-+−](\\d{3})$", 1)  # +530
    total = F.when(compact != "", F.substring(compact, 1, 1).try_cast("int") * 60 + F.substring(compact, 2, 2).try_cast("int")).otherwise(hours * 60 + minutes)
    valid = (total <= 18 * 60) & (F.when(compact != "", F.substring(compact, 2, 2).try_cast("int")).otherwise(minutes) < 60)
    return F.when(zone == "z", 0).when(zone.rlike("^(?:gmt|utc)? ?[-+−]\\d"), F.when(valid, total * F.when(sign == "+", 1).otherwise(-1)))


def _transitions(zone: ZoneInfo, lo: dt.datetime, hi: dt.datetime) -> list[tuple[dt.datetime, int]]:
    """(UTC instant from which the offset holds, offset in seconds) over [lo, hi]; the first entry stands for all before."""

    def offset(at: dt.datetime) -> int:
        return int(at.replace(tzinfo=dt.UTC).astimezone(zone).utcoffset().total_seconds())

    out, at, step = [(lo, offset(lo))], lo, dt.timedelta(days=7)
    while at < hi:
        nxt = min(at + step, hi)
        if offset(nxt) != out[-1][1]:
            a, b = at, nxt
            while b - a > dt.timedelta(seconds=1):
                mid = a + dt.timedelta(seconds=(b - a).total_seconds() // 2)
                a, b = (a, mid) if offset(mid) != out[-1][1] else (mid, b)
            out.append((b, offset(b)))
            at = b
        else:
            at = nxt
    return out


def zone_spans(zone_years: DataFrame) -> DataFrame:
    """Spans of local time of each (zone, year): (zone, year, from_s, to_s, offset_s, matches), in seconds of the local clock.

    Each span lies in the given year's local time with a day to spare and tells how many offset intervals match it: 1, 2 (the hour
    occurs twice; offset_s is that of the earlier interval, the first occurrence) or 0 (skipped; offset_s is the one in force before).
    Unknown zone names give no span.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        epoch = dt.datetime(1970, 1, 1)
        for batch in batches:
            rows = []
            for zone, year in zip(batch["zone"], batch["year"]):
                try:
                    info = ZoneInfo(zone)
                    lo = dt.datetime(max(int(year), 2), 1, 1) - dt.timedelta(days=3)
                    hi = dt.datetime(min(int(year), 9998) + 1, 1, 1) + dt.timedelta(days=3)
                    changes = _transitions(info, lo, hi)
                except (KeyError, ValueError, OSError, OverflowError):
                    continue
                seconds = [(int((at - epoch).total_seconds()), off) for at, off in changes]
                ends = [at for at, _ in seconds[1:]] + [int((hi - epoch).total_seconds())]
                local = [(at + off, end + off, off) for (at, off), end in zip(seconds, ends)]  # the intervals in local time
                cuts = sorted({x for a, b, _ in local for x in (a, b)})
                for a, b in zip(cuts, cuts[1:]):
                    held = [off for x, y, off in local if x <= a and b <= y]
                    before = [off for x, y, off in local if y <= a]
                    rows.append((zone, int(year), a, b, held[0] if held else before[-1], len(held)))
            yield pd.DataFrame(rows, columns=["zone", "year", "from_s", "to_s", "offset_s", "matches"])

    return zone_years.mapInPandas(run, "zone string, year int, from_s long, to_s long, offset_s long, matches int")


def to_utc(times: DataFrame, raw_col: str, abbrevs: DataFrame, default_zone_col: str | None = None) -> DataFrame:
    """times with utc_us (microseconds since 1970, null if none), utc (its text) and time_status added.

    abbrevs is (abbr, offset_minutes), upper case, a table of a few rows. A stated offset, abbreviation or zone holds; otherwise the zone
    in default_zone_col does. time_status: 'offset', 'unique', 'ambiguous' (the first of two is taken), 'nonexistent' (read with the
    offset before the change, so it moves forward), 'no_zone' (no or an unknown zone) or 'unparsed'. Rows and their columns stay as
    they are; an empty table gives an empty result.
    """
    names = {r[0].lower(): int(r[1]) for r in few_rows(abbrevs.filter("abbr is not null and offset_minutes is not null").select("abbr", "offset_minutes"))}
    # written once: the spans that are wanted, and then the join, both need what was parsed
    parsed = checkpointed(times.withColumn("_p", parse_time(F.col(raw_col))))
    zone = F.col("_p.zone")
    offset = stated_offset(zone)
    if names:
        lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        offset = F.coalesce(offset, lookup[zone])
    region = F.when(zone.contains("/"), F.regexp_replace(zone, "[\\[\\]]", "")).when(zone == "", F.lower(F.col(default_zone_col)) if default_zone_col else F.lit(None).cast("string"))
    parsed = parsed.withColumns({"_offset": offset.cast("long") * 60, "_s": F.floor(F.col("_p.local") / 1_000_000), "_zone": F.when(offset.isNull(), region)})
    parsed = parsed.withColumn("_year", F.when(F.col("_zone").isNotNull(), F.year(F.timestamp_seconds("_s").cast("date"))))
    wanted = parsed.filter("_zone is not null and _year is not null").select(F.col("_zone").alias("zone"), F.col("_year").alias("year")).distinct()
    wanted = checkpointed(wanted)  # counted and looked up
    spans = zone_spans(_proper_zone_names(wanted)).withColumn("zone", F.lower("zone"))
    small = wanted.limit(BROADCAST_SPANS // 4 + 1).count() <= BROADCAST_SPANS // 4
    spans = F.broadcast(spans) if small else spans
    cond = (F.col("_zone") == spans["zone"]) & (F.col("_year") == spans["year"]) & (F.col("_s") >= spans["from_s"]) & (F.col("_s") < spans["to_s"])
    joined = parsed.join(spans, cond, "left")
    utc = F.col("_p.local") - F.coalesce("_offset", spans["offset_s"]) * 1_000_000
    matches = spans["matches"]
    status = F.when(F.col("_p.local").isNull(), "unparsed").when(F.col("_offset").isNotNull(), "offset").when(matches == 1, "unique").when(matches == 2, "ambiguous").when(matches == 0, "nonexistent").otherwise("no_zone")
    out = joined.select(*[parsed[c] for c in times.columns], utc.alias("utc_us"), status.alias("time_status"))
    shown = F.timestamp_micros("utc_us")
    return out.withColumn("utc", F.concat(F.date_format(shown.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod("utc_us", F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z")))


def _proper_zone_names(zones: DataFrame) -> DataFrame:
    """Zone names in the spelling of the time zone database, whatever their case; unknown ones stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zoneinfo

        proper = {z.lower(): z for z in zoneinfo.available_timezones()}
        for batch in batches:
            yield batch.assign(zone=[proper.get(z.lower(), z) for z in batch["zone"]])

    return zones.mapInPandas(run, "zone string, year int")


def message_times(messages: DataFrame, sessions: DataFrame, zones: DataFrame, abbrevs: DataFrame, cap: int = SESSION_CAP) -> DataFrame:
    """(src, row_id, utc_us, time_status, utc) of every id in chat_messages ('message') and chat_sessions ('session').

    Copies of an id count once. A message of an unknown session has no zone of its own. A session may hold any share of the messages: those with
    more than cap are dealt to blocks, all others are shuffled once, and no session is broadcast, as their size is only guessed when the join is
    planned. zones has one row for each chat; only its distinct (chat_id, zone_name) is used.
    """
    zone_of = zones.filter("chat_id is not null").groupBy("chat_id").agg(F.min("zone_name").alias("zone_name"))
    session = sessions.filter("id is not null").groupBy("id").agg(F.min(F.struct("session_time_raw", "chat_id")).alias("s")).select("id", "s.session_time_raw", "s.chat_id")
    if zone_of.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        session = session.join(F.broadcast(zone_of), "chat_id", "left")
    else:
        session = skew_join(session, zone_of.withColumnRenamed("chat_id", "_chat"), "chat_id", "_chat", "id")
    session = session.select(F.col("id").alias("row_id"), F.col("session_time_raw").alias("raw"), "zone_name")
    message = messages.filter("id is not null").groupBy("id").agg(F.min(F.struct("message_time_raw", "session_id")).alias("m")).select(F.col("id").alias("row_id"), F.col("m.message_time_raw").alias("raw"), "m.session_id")
    hot = checkpointed(hot_keys(messages.filter("session_id is not null").select("session_id"), "session_id", cap).withColumnRenamed("session_id", "_hot"))
    found = hot.limit(BROADCAST_KEYS + 1).count()
    small = F.broadcast(hot) if found <= BROADCAST_KEYS else hot
    own = session.select(F.col("row_id").alias("_sid"), "zone_name")
    blocks = F.coalesce("_blocks", F.lit(1)) if found else F.lit(1)
    if found:
        message, own = message.join(small, F.col("session_id") == F.col("_hot"), "left"), own.join(small, F.col("_sid") == F.col("_hot"), "left")
        own = own.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    else:
        own = own.withColumn("_salt2", F.lit(0).cast("long"))
    # messages without a session meet none, so they go anywhere
    message = message.withColumn("_salt", F.when(F.col("session_id").isNull(), F.xxhash64("row_id")).otherwise(F.pmod(F.xxhash64("row_id"), blocks)))
    message = message.join(own.hint("merge"), (F.col("session_id") == F.col("_sid")) & (F.col("_salt") == F.col("_salt2")), "left").select("row_id", "raw", "zone_name")
    both = message.withColumn("src", F.lit("message")).unionByName(session.withColumn("src", F.lit("session")))
    return to_utc(both, "raw", abbrevs, "zone_name").select("src", "row_id", "utc_us", "time_status", "utc")
