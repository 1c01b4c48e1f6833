"""Attributes as known at event time (p4) and trailing totals (p7), against brute force and edge cases."""

import datetime as dt
import random

import pytest

from cohortloom.operators import known, trailing

T0 = dt.datetime(2100, 1, 1)
EVENTS = "entity long, event long, time timestamp_ntz, extra string, attribute string"
RECORDS = "entity long, attribute string, known timestamp_ntz, ends timestamp_ntz, extra int, time string"


def as_known(spark, events, records, **rule):
    e = spark.createDataFrame(events, EVENTS)
    r = spark.createDataFrame(records, RECORDS)
    found = known.as_known(e, r, "entity", "event", "time", "attribute", "known", "ends", **rule)
    return sorted((row["event"], tuple(row["attributes"])) for row in found.collect())


def hours(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def brute(events, records):
    out = []
    for entity, event, time, *_ in events:
        names = {
            "".join(a.lower().split())
            for e, a, k, end, *_ in records
            if None not in (e, a, k, time) and e == entity and a.strip() and k < time and (end is None or end > time)
        }
        out.append((event, tuple(sorted(names))))
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [100_000, 30, 5])
def test_known_equals_brute_force_whatever_the_shards(spark, shard_rows):
    rng = random.Random(shard_rows)
    pick = lambda: rng.choice([1, 1, 1, 1, 2, 3, 4])
    events = [(pick(), i, hours(rng.randint(0, 900)), "x", None) for i in range(150)]
    records = []
    for _ in range(120):
        start = rng.randint(0, 900)
        end = rng.choice([None, start + rng.randint(-5, 300)])
        records.append((pick(), rng.choice(["a", " A", "b", "B ", "c c", "", None]), hours(start), hours(end), 1, "z"))
    records += records[:10]
    assert as_known(spark, events, records, shard_rows=shard_rows) == brute(events, records)


def test_known_bounds_nulls_and_repeats(spark):
    records = [(1, "A", hours(5), hours(9), 0, ""), (1, None, hours(0), None, 0, ""), (None, "b", hours(0), None, 0, ""), (1, "c", None, None, 0, "")]
    events = [(1, 1, hours(5), "", ""), (1, 2, hours(6), "", ""), (1, 3, hours(9), "", ""), (None, 4, hours(6), "", ""), (1, 5, None, "", ""), (1, 2, hours(6), "", "")]
    assert as_known(spark, events, records) == [(1, ()), (2, ("a",)), (2, ("a",)), (3, ()), (4, ()), (5, ())]
    assert as_known(spark, events, []) == [(1, ()), (2, ()), (2, ()), (3, ()), (4, ()), (5, ())]
    assert as_known(spark, [], records) == []


def test_known_at_one_busy_moment_in_many_shards(spark):
    records = [(1, f"a{i % 7}", hours(5), hours(9 + i % 3), 0, "") for i in range(60)] + [(1, "late", hours(6), None, 0, "")]
    events = [(1, i, hours(5 + i % 6), "", "") for i in range(120)]
    assert as_known(spark, events, records, shard_rows=10) == brute(events, records)


def test_old_roots_stay_valid():
    history = known.KnownHistory([(10, 100, 0), (20, 50, 1), (30, 1000, 0), (40, 45, 2)])
    assert [history.at(t) for t in (10, 11, 25, 41, 46, 60, 500, 1000)] == [0, 1, 3, 7, 3, 1, 1, 0]


def day(n, hour=12):
    return T0 + dt.timedelta(days=n, hours=hour)


def test_rolling_calendar_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2]), i, day(rng.randint(0, 700), rng.randint(0, 23)), None) for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 7, day(1), None), (1, None, day(1), None), (1, 99, None, None)], "e long, id long, t timestamp_ntz, n string")
    found = {(r["e"], r["day"]): (r["n_7d"], r["n_365d"], round(r["mean_30d"], 6)) for r in trailing.rolling_calendar(df, "e", "id", "t", task_rows=500).collect()}
    want = {}
    for e in (1, 2):
        days = [t.date() for x, _, t, _ in rows if x == e]
        at = min(days)
        while at <= min(max(days) + dt.timedelta(days=364), max(t for *_, t, _ in rows).date()):
            n = lambda p: sum(at - dt.timedelta(days=p) < x <= at for x in days)
            want[e, at] = (n(7), n(365), round(n(30) / 30, 6))
            at += dt.timedelta(days=1)
    assert found == want


def test_whole_calendar_goes_on_after_the_last_event_of_an_entity(spark):
    rng = random.Random(4)
    rows = [(1, 0, day(5, 3), None), (2, 1, day(900, 2), None), *((3, i, day(rng.randint(100, 300)), None) for i in range(2, 30))]
    df = spark.createDataFrame([*rows, *rows[:4]], "e long, id long, t timestamp_ntz, n string")
    found = {(r["e"], r["day"]): (r["n_7d"], r["n_30d"], r["n_365d"]) for r in trailing.rolling_calendar(df, "e", "id", "t", task_rows=500, whole=True).collect()}
    want = {}
    for e in (1, 2, 3):
        days = [t.date() for x, _, t, _ in rows if x == e]
        at = min(days)
        while at <= day(900).date():
            want[e, at] = tuple(sum(at - dt.timedelta(days=p) < x <= at for x in days) for p in (7, 30, 365))
            at += dt.timedelta(days=1)
    assert found == want
    assert found[1, day(369).date()] == (0, 0, 1) and found[1, day(370).date()] == (0, 0, 0)
    assert trailing.rolling_calendar(df.where("e > 9"), "e", "id", "t", whole=True).count() == 0


def test_counts_before_include_the_first_moment_and_exclude_the_last(spark):
    times = [day(0, 0), day(0, 12), day(0, 12), day(3, 1), day(10, 5), day(10, 6), day(10, 6)]
    events = spark.createDataFrame([(1, i, t, "x") for i, t in enumerate(times)] + [(1, 0, times[0], "x")], "e long, id long, t timestamp_ntz, n_before string")
    asked = spark.createDataFrame([(1, 10, day(10, 12)), (1, 11, day(10, 6)), (2, 12, day(10, 6)), (None, 13, day(1)), (1, 14, None)], "e long, key long, t timestamp_ntz")
    found = {r["key"]: r["n_before"] for r in trailing.counts_before(events.drop("n_before"), asked, "e", "id", "t", "key", days=10).collect()}
    assert found == {10: 6, 11: 4, 12: 0, 13: None, 14: None}


def test_counts_before_equals_brute_force(spark):
    rng = random.Random(5)
    events = [(rng.choice([1, 2]), i, T0 + dt.timedelta(minutes=rng.randint(0, 600_000))) for i in range(120)]
    asked = [(rng.choice([1, 2]), i, rng.choice(events)[2] + dt.timedelta(days=rng.choice([0, 30, 29]))) for i in range(60)]
    e = spark.createDataFrame(events, "e long, id long, t timestamp_ntz")
    a = spark.createDataFrame(asked, "e long, key long, t timestamp_ntz")
    found = {r["key"]: r["n_before"] for r in trailing.counts_before(e, a, "e", "id", "t", "key", days=30).collect()}
    month = dt.timedelta(days=30)
    assert found == {k: sum(x == y and t - month <= u < t for y, _, u in events) for x, k, t in asked}


def test_busy_days_are_counted_by_prefixes(spark):
    rng = random.Random(6)
    events = [(1, i, T0 + dt.timedelta(days=rng.choice([0, 30]), seconds=rng.randint(0, 86_399))) for i in range(400)]
    asked = [(1, i, T0 + dt.timedelta(days=30, seconds=rng.randint(0, 86_399))) for i in range(200)]
    e = spark.createDataFrame(events, "e long, id long, t timestamp_ntz")
    a = spark.createDataFrame(asked, "e long, key long, t timestamp_ntz")
    found = {r["key"]: r["n_before"] for r in trailing.counts_before(e, a, "e", "id", "t", "key", days=30).collect()}
    month = dt.timedelta(days=30)
    assert found == {k: sum(t - month <= u < t for _, _, u in events) for _, k, t in asked}


def test_totals_come_out_on_asked_dates_only(spark):
    daily = spark.createDataFrame([(1, 0, 2), (1, 5, 1), (2, 600, 3)], "entity long, day long, n long")
    dates = spark.createDataFrame([(1, 4), (1, 5), (1, 7), (1, 7), (2, 511), (2, 606), (2, 607), (3, 1)], "entity long, day long")
    found = {(r["entity"], r["day"]): (r["n_3d"], r["n_7d"]) for r in trailing.rolling_on(daily, dates, (3, 7)).collect()}
    assert found == {(1, 4): (0, 2), (1, 5): (1, 3), (1, 7): (1, 1), (2, 511): (0, 0), (2, 606): (0, 3), (2, 607): (0, 0), (3, 1): (0, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "e long, id long, t timestamp_ntz")
    assert trailing.rolling_calendar(none, "e", "id", "t").count() == 0
    assert trailing.counts_before(none, none, "e", "id", "t", "id").count() == 0
