"""Totals and means over trailing periods, days without activity included.

Each daily total is exploded onto every output date it influences and summed by entity and date;
calendar rows add the zeros. Both are first placed by entity and block of dates, so that the
exploded rows are summed where they arise and no entity fills a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import ranges
from cohortloom.operators.known import micros
from cohortloom.session import materialize

_BLOCK = 512
_DAY = 86_400_000_000


def daily_totals(events: DataFrame, entity: str, event: str, time: str) -> DataFrame:
    """entity, day (days since 1970) and n, the number of different events on that day.

    Rows with a null entity, event or time don't count.
    """
    each = events.where(F.col(entity).isNotNull() & F.col(event).isNotNull() & F.col(time).isNotNull())
    each = each.select(F.col(entity).alias("entity"), F.col(event).alias("event"), F.unix_date(F.to_date(time)).alias("day"))
    return each.distinct().groupBy("entity", "day").agg(F.count("*").alias("n"))


def _summed(dated: DataFrame, keys: list[str], periods: tuple[int, ...]) -> DataFrame:
    """Totals of each period by keys, from rows of n, begin (the day they fell on) and day (a date they influence)."""
    age = F.col("day") - F.col("begin")
    return dated.groupBy(*keys).agg(*[F.sum(F.when(age < p, F.col("n")).otherwise(0)).alias(f"n_{p}d") for p in periods])


def rolling_calendar(
    events: DataFrame, entity: str, event: str, time: str, periods: tuple[int, ...] = (7, 30, 365), task_rows: int = 4_000_000, whole: bool = False
) -> DataFrame:
    """entity, day (date), n_<p>d and mean_<p>d for each period, for every day from an entity's first event until its totals are zero again.

    No day is later than the last event of any entity; whole: each entity's days go on to that one, with
    zeros. A period of p days ends with the day itself. Events are counted once each, whatever repeats;
    rows with a null entity, event or time don't count; no events give no rows. task_rows: exploded
    rows that a task sums, from which the number of tasks follows.
    """
    daily = materialize(daily_totals(events, entity, event, time))
    reach = max(periods) - 1
    end = F.lit(daily.agg(F.max("day")).first()[0]).cast("int")
    span = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    span = span.withColumn("last", end if whole else F.least(F.col("last") + reach, end))
    seeds = daily.select("entity", F.col("day").alias("begin"), F.least(F.col("day") + reach, end).alias("end"), "n")
    seeds = seeds.unionByName(span.select("entity", F.col("first").alias("begin"), F.col("last").alias("end"), F.lit(0).cast("long").alias("n")))
    block = F.explode(F.sequence(F.floor(F.col("begin") / _BLOCK), F.floor(F.col("end") / _BLOCK)))
    seeds = materialize(seeds)
    rows = seeds.agg(F.sum(F.col("end") - F.col("begin") + 1)).first()[0] or 0
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // task_rows))
    placed = seeds.withColumn("block", block).repartition(tasks, "entity", "block")  # few bytes that grow: the number is set by rows
    low = F.greatest(F.col("begin").cast("long"), F.col("block") * _BLOCK)
    high = F.least(F.col("end").cast("long"), F.col("block") * _BLOCK + _BLOCK - 1)
    out = _summed(placed.withColumn("day", F.explode(F.sequence(low, high))), ["entity", "block", "day"], periods)
    means = [(F.col(f"n_{p}d") / F.lit(float(p))).alias(f"mean_{p}d") for p in periods]
    day = F.date_from_unix_date(F.col("day").cast("int")).alias("day")
    return out.select(F.col("entity").alias(entity), day, *[f"n_{p}d" for p in periods], *means)


def rolling_on(daily: DataFrame, dates: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """entity, day and n_<p>d of each asked (entity, day): daily totals exploded onto the asked dates they influence, zeros for dates that none does.

    An entity's asked dates of a block are one array, of no more than the block's days, and a daily total meets
    the one or two arrays in its reach. So a total gives rows only for dates that are asked, and the rows of an
    entity are bounded by its days, however many events it has.
    """
    reach = max(periods) - 1
    blocks = dates.distinct().withColumn("block", F.floor(F.col("day") / _BLOCK)).groupBy("entity", "block").agg(F.collect_set("day").alias("days"))
    begin, end = F.col("begin"), F.col("begin") + reach
    placed = daily.select("entity", F.col("day").alias("begin"), "n").withColumn("block", F.explode(F.sequence(F.floor(begin / _BLOCK), F.floor(end / _BLOCK))))
    dated = placed.join(blocks, ["entity", "block"])
    dated = dated.select("entity", "begin", "n", F.explode(F.filter("days", lambda d: (d >= begin) & (d <= end))).alias("day"))
    sums = _summed(dated, ["entity", "day"], periods)
    return dates.distinct().join(sums, ["entity", "day"], "left").fillna(0, [f"n_{p}d" for p in periods])


def counts_before(
    events: DataFrame, asked: DataFrame, entity: str, event: str, time: str, asked_key: str, days: int = 365
) -> DataFrame:
    """asked's columns and n_before: different events of the entity from exactly `days` days before time, up to it exclusively.

    The rolling total of the day before, plus what the day itself has before the time, less what the first
    day has before the same time. An event that repeats counts once, at its first time. Rows of asked
    with a null entity or time have a null n_before; repeated rows stay.
    """
    each = events.where(F.col(entity).isNotNull() & F.col(event).isNotNull() & F.col(time).isNotNull())
    each = each.select(F.col(entity).alias("entity"), F.col(event).alias("event"), micros(F.col(time)).alias("at"))
    each = each.groupBy("entity", "event").agg(F.min("at").alias("at"))
    day = F.floor(F.col("at") / _DAY)
    # what happened at one moment counts as one row, so that busy days stay small
    moments = materialize(each.groupBy("entity", "at").agg(F.count("*").alias("n")).withColumn("day", day))
    daily = moments.groupBy("entity", "day").agg(F.sum("n").alias("n"))
    want = asked.select(F.col(entity).alias("entity"), micros(F.col(time)).alias("at")).where("entity is not null and at is not null").distinct()
    want = materialize(want.withColumn("day", day))
    rolling = rolling_on(daily, want.select("entity", (F.col("day") - 1).alias("day")), (days,))
    total = rolling.select("entity", (F.col("day") + 1).alias("day"), F.col(f"n_{days}d").alias("total"))

    edges = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("at").alias("point")), F.struct(F.lit(-1).alias("sign"), (F.col("at") - days * _DAY).alias("point"))))
    points = want.select("entity", "at", edges.alias("e")).select("entity", F.col("at").alias("asked"), "e.sign", F.col("e.point").alias("at")).withColumn("day", day)
    own = moments.join(points.select("entity", "day").distinct(), ["entity", "day"], "left_semi")
    # points come before the events of their moment, which they don't count
    line = points.withColumn("n", F.lit(0).cast("long")).unionByName(own, allowMissingColumns=True).withColumn("later", F.col("sign").isNull())
    keys, order = ["entity", "day"], ["at", "later"]
    before = ranges.counted(ranges.placed(line, keys, order), keys, order, "n").where("not later")
    edge = before.groupBy("entity", F.col("asked").alias("at")).agg(F.sum(F.col("sign") * F.col("_before")).alias("edge"))
    counts = want.join(total, ["entity", "day"], "left").join(edge, ["entity", "at"], "left").select("entity", "at", (F.col("total") + F.col("edge")).alias("n_before"))
    keyed = asked.select(asked_key, F.col(entity).alias("entity"), micros(F.col(time)).alias("at"), F.struct(*asked.columns).alias("row"))
    return keyed.join(counts, ["entity", "at"], "left").select("row.*", "n_before")
