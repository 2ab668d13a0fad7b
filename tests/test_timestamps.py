import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from mnemoframe.operators.timestamps import message_times, parse_text, to_utc

ABBREVS = [("UTC", 0), ("PDT", -420), ("IST", 330)]


def us(*parts):
    return int((dt.datetime(*parts) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2023-02-04T10:48:17+05:45", (us(2023, 2, 4, 10, 48, 17), "+05:45")),
        ("20250926T144653Z", (us(2025, 9, 26, 14, 46, 53), "z")),
        ("2021-08-11T15:58:32[Asia/Kolkata]", (us(2021, 8, 11, 15, 58, 32), "[asia/kolkata]")),
        ("2021-08-11T08:00:57.475173406-04:00", (us(2021, 8, 11, 8, 0, 57, 475173), "-04:00")),
        ("983, ", None),
        ("2021-08-11 05:48:34,018", (us(2021, 8, 11, 5, 48, 34, 18000), "")),
        ("22. April 2021, 03:12 Uhr", (us(2021, 4, 22, 3, 12), "")),
        ("14 février 2025 à 11h23", (us(2025, 2, 14, 11, 23), "")),
        ("22 de abril de 2021, 2:59", (us(2021, 4, 22, 2, 59), "")),
        ("2021年8月11日 07:26", (us(2021, 8, 11, 7, 26), "")),
        ("12:03 pm on 23 June, 2022", (us(2022, 6, 23, 12, 3), "")),
        ("Oct 12, 2023 at 12:31:43 AM", (us(2023, 10, 12, 0, 31, 43), "")),
        ("Sat, 13 Aug 2022 03:47:40 +0545", (us(2022, 8, 13, 3, 47, 40), "+0545")),
        ("16 Aug 2025 01:42:46 GMT+10", (us(2025, 8, 16, 1, 42, 46), "gmt+10")),
        ("8/10/2021 3:58 AM", (us(2021, 8, 10, 3, 58), "")),
        ("11/01/2025 5:13pm", (us(2025, 11, 1, 17, 13), "")),
        ("11.08.2021 06:54:36", (us(2021, 8, 11, 6, 54, 36), "")),
        ("2021/08/28 (Sat) 22:20", (us(2021, 8, 28, 22, 20), "")),
        ("1628518769", (1628518769_000000, "z")),
        ("1628680607093", (1628680607093_000, "z")),
        ("1628679210019217", (1628679210019217, "z")),
        ("2023-02-30 10:00:00", None), ("31.06.2023 08:15", None), ("2024-13-05T09:00:00Z", None), ("2025-04-01T", None), ("2023-02-04", None),
        ("13:56", None), ("unknown", None), ("", None), (None, None), ("   ", None), ("2024-01-01 25:00", None), ("x" * 100_000, None),
    ],
)
def test_forms(text, expected):
    assert parse_text(text) == expected


def test_zones_by_brute_force(spark):
    zones = ["America/New_York", "Australia/Lord_Howe", "Europe/Berlin", "Asia/Kathmandu", "Pacific/Auckland"]
    start = dt.datetime(2023, 1, 1)
    data, expected = [], {}
    for z, zone in enumerate(zones):
        for h in range(0, 366 * 48):
            if h % 7 == 0 or start + dt.timedelta(minutes=30 * h) in ():
                local = start + dt.timedelta(minutes=30 * h)
                i = z * 100_000 + h
                data.append((i, local.strftime("%Y-%m-%d %H:%M:%S"), zone, 1.5))
                # fold 0 is the first of two equal hours, and reads a skipped one with the offset before
                expected[i] = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    df = spark.createDataFrame(data, "id long, raw string, zone_name string, utc_offset double")
    got = to_utc(df, "raw", spark.createDataFrame(ABBREVS, "abbr string, offset_minutes int"), "zone_name")
    assert {r.id: r.utc for r in got.collect()} == expected
    assert {r[0] for r in got.select("time_status").distinct().collect()} >= {"unique"}


def test_first_of_two_and_moved_forward(spark):
    data = [(1, "2023-11-05 01:30:00", "America/New_York"), (2, "2023-03-12 02:30:00", "America/New_York"), (3, "2023-03-12 02:30:00", None), (4, None, "Europe/Berlin"), (5, "2023-03-12 02:30:00 PDT", None), (6, "2023-03-12 02:30:00", "No/Where")]
    got = to_utc(spark.createDataFrame(data, "id long, raw string, z string"), "raw", spark.createDataFrame(ABBREVS, "abbr string, offset_minutes int"), "z")
    assert {r.id: (r.utc, r.time_status) for r in got.collect()} == {
        1: ("2023-11-05T05:30:00.000000Z", "ambiguous"), 2: ("2023-03-12T07:30:00.000000Z", "nonexistent"), 3: (None, "no_zone"),
        4: (None, "unparsed"), 5: ("2023-03-12T09:30:00.000000Z", "offset"), 6: (None, "no_zone"),
    }


def test_tables_with_copies_and_unknown_sessions(spark):
    m = spark.createDataFrame([(1, 10, "2024-01-01 10:00"), (1, 10, "2024-01-01 10:00"), (2, 99, "2024-01-01 10:00"), (3, 99, "2024-01-01T10:00:00Z"), (None, 10, "x")], "id long, session_id long, message_time_raw string")
    s = spark.createDataFrame([(10, "c1", "1704103200"), (10, "c1", "1704103200")], "id long, chat_id string, session_time_raw string")
    z = spark.createDataFrame([("c1", "Asia/Tokyo")], "chat_id string, zone_name string")
    got = message_times(m, s, z, spark.createDataFrame(ABBREVS, "abbr string, offset_minutes int"))
    assert {(r.src, r.row_id): r.utc for r in got.collect()} == {("message", 1): "2024-01-01T01:00:00.000000Z", ("message", 2): None, ("message", 3): "2024-01-01T10:00:00.000000Z", ("session", 10): "2024-01-01T10:00:00.000000Z"}
    empty = message_times(m.limit(0), s.limit(0), z.limit(0), spark.createDataFrame([], "abbr string, offset_minutes int"))
    assert empty.collect() == []


def test_no_session_is_broadcast_and_a_hot_one_is_dealt_to_blocks(spark, monkeypatch):
    n = 300
    m = spark.createDataFrame([(k, None if k % 7 == 0 else 10 if k % 2 else 11 + k, "2024-01-01 10:00") for k in range(n)], "id long, session_id long, message_time_raw string")
    s = spark.createDataFrame([(10 + k, f"c{k % 2}", "1704103200") for k in range(n)], "id long, chat_id string, session_time_raw string")
    z = spark.createDataFrame([("c0", "Asia/Tokyo"), ("c1", "Europe/Berlin")], "chat_id string, zone_name string")
    abbrevs = spark.createDataFrame(ABBREVS, "abbr string, offset_minutes int")
    utc = {"c0": "2024-01-01T01:00:00.000000Z", "c1": "2024-01-01T09:00:00.000000Z"}
    expected = {k: None if k % 7 == 0 else utc["c0"] if k % 2 or 11 + k >= 10 + n else utc[f"c{(k + 1) % 2}"] for k in range(n) if k % 2 or 11 + k < 10 + n or k % 7 == 0}
    for cap in (5, 1 << 17):
        got = {r.row_id: r.utc for r in message_times(m, s, z, abbrevs, cap).filter("src = 'message'").collect()}
        assert len(got) == n and {k: got[k] for k in expected} == expected
    monkeypatch.setattr("mnemoframe.operators.timestamps.to_utc", lambda both, *_: both.withColumns({c: both["zone_name"] for c in ("utc_us", "time_status", "utc")}))
    plan = message_times(m, s, z, abbrevs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [session_id" in plan and "BroadcastHashJoin [session_id" not in plan and "Generate" not in plan
