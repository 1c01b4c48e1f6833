"""Descriptive summaries: numbers, categories, cross tables, bins and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators import ranges


def quantiles(values: DataFrame, keys: list[str], x: str, shares: tuple[float, ...]) -> DataFrame:
    """keys and q, an array of the exact quantiles of x, interpolated between neighbours. Null values don't count.

    Equal values are counted first; the different ones are ranked over ranges, so that no group is held by one task.
    """
    counts = values.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    ranked = ranges.counted(ranges.placed(counts, keys, [x]), keys, [x], "_c")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_all"))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "_all")
    ranked = ranked.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    at = [(F.col("_all") - 1) * F.lit(s) for s in shares]
    within = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_c"))
    low = [F.max(F.when(within(F.floor(a)), F.col(x))) for a in at]
    high = [F.max(F.when(within(F.ceil(a)), F.col(x))) for a in at]
    part = [F.max(a - F.floor(a)) for a in at]
    return ranked.groupBy(*keys).agg(F.array(*[lo + (hi - lo) * p for lo, hi, p in zip(low, high, part)]).alias("q"))


def describe_numbers(df: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """AGG-03, AGG-11: n, mean, sd, quartiles, range and share above 0 of each measure in each group.

    All measures are unpivoted and summarised in one aggregation; quantiles are exact. Null values
    don't count; a single value has a null sd.
    """
    rows = df.select(group, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot([group], measures, "measure", "x").where("x is not null")
    out = rows.groupBy(group, "measure").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(F.col("x") > 0).alias("n_positive"),
    )
    q = quantiles(rows, [group, "measure"], "x", (0.25, 0.5, 0.75)).select(F.col(group).alias("_g"), F.col("measure").alias("_m"), "q")
    out = out.join(q, F.col(group).eqNullSafe(F.col("_g")) & (F.col("measure") == F.col("_m")))
    return out.select(
        group, "measure", "n", "mean", "sd", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "min", "max", "n_positive", (100.0 * F.col("n_positive") / F.col("n")).alias("pct_positive"),
    )


def describe_categories(df: DataFrame, group: str, variables: list[str]) -> DataFrame:
    """AGG-12: n and percent within the group of each level of each variable; blanks count as missing."""
    rows = df.select(group, *[F.col(v).cast("string").alias(v) for v in variables]).unpivot([group], variables, "variable", "level")
    level = F.when(F.trim(F.coalesce("level", F.lit(""))) == "", "missing").otherwise(F.col("level"))
    counts = rows.groupBy(group, "variable", level.alias("level")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group, "variable"))
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def with_overall(df: DataFrame, group: str, aggregates: list[Column]) -> DataFrame:
    """AGG-13: the aggregates of each group and of all rows, labelled `overall`, in one pass (grouping sets)."""
    out = df.rollup(group).agg(F.grouping(group).alias("_all"), *aggregates)
    return out.withColumn(group, F.when(F.col("_all") == 1, "overall").otherwise(F.col(group).cast("string"))).drop("_all")


def cut(value: Column, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """CND-03: the label of the interval that holds a value, null outside. right: intervals are open left and closed right,
    the first closed on both sides; else closed left and open right."""
    out = F.lit(None).cast("string")
    for i, label in reversed(list(enumerate(labels))):
        low, high = edges[i], edges[i + 1]
        inside = ((value > low) | ((value == low) & F.lit(i == 0))) & (value <= high) if right else (value >= low) & (value < high)
        out = F.when(inside, label).otherwise(out)
    return out


def bin_counts(df: DataFrame, value: str, edges: list[float], labels: list[str], right: bool = True) -> DataFrame:
    """CND-03: bin and n for every label in order, empty ones with 0."""
    counts = df.groupBy(cut(F.col(value), edges, labels, right).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i, label) for i, label in enumerate(labels)], "bin_order long, bin string")
    return every.join(counts, "bin", "left").select("bin_order", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """RSH-03: a, b and n for every two labels that occur, cells without rows with 0. Labels are few by nature."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    grid = counts.select(a).distinct().join(counts.select(b).distinct())
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def count_histogram(df: DataFrame, entity: str, group: str | None = None) -> DataFrame:
    """AGG-04: how many entities have each number of rows: [group,] n_rows, n_entities."""
    keys = [entity, group] if group else [entity]
    each = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return each.groupBy(*([group] if group else []), "n_rows").agg(F.count("*").alias("n_entities"))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """TOP-02, WIN-06: the first n rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def zero_filled_counts(keys: DataFrame, events: DataFrame, on: str, kinds: dict[str, Column]) -> DataFrame:
    """AGG-15: keys with the number of events of each kind, 0 without any. Events are counted before the join."""
    counts = events.groupBy(on).agg(*[F.count_if(test).alias(name) for name, test in kinds.items()])
    return keys.join(counts, on, "left").select(*keys.columns, *[F.coalesce(name, F.lit(0)).alias(name) for name in kinds])


def pivot_difference(df: DataFrame, row: str, column: str, values: tuple[str, str], measure: Column) -> DataFrame:
    """RSH-02, STA-07: a measure by two values of a column side by side, with difference and ratio (null for a zero)."""
    a, b = values
    wide = df.groupBy(row).pivot(column, [a, b]).agg(measure)
    wide = wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).cast("double").alias(f"value_{i}") for i, v in enumerate((a, b), 1)])
    return wide.withColumn("difference", F.col("value_1") - F.col("value_2")).withColumn("ratio", F.try_divide("value_1", "value_2"))


def collapse_category(df: DataFrame, entity: str, category: str) -> DataFrame:
    """CND-09: an entity's only non-missing category, `multiple_values` if there are several, `missing` without any."""
    names = F.array_sort(F.collect_set(F.when(F.trim(category) != "", F.col(category))))
    out = df.groupBy(entity).agg(names.alias("x"))
    return out.select(entity, F.when(F.size("x") == 0, "missing").when(F.size("x") == 1, F.col("x")[0]).otherwise("multiple_values").alias(category))


def keyword_category(value: Column, rules: list[tuple[str, list[str]]], otherwise: str, missing: str = "missing") -> Column:
    """CND-02: the first category one of whose keywords a value contains, whatever its case."""
    text = F.upper(F.trim(value))
    out = F.lit(otherwise)
    for name, needles in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [text.contains(n) for n in needles]), name).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", missing).otherwise(out)


def guarded_percent(n: Column, d: Column) -> Column:
    """MTH-01: percent, 0 for a denominator of 0."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, 0.0).otherwise(100.0 * n / d)


def standardised_difference(df: DataFrame, group: str, values: tuple[str, str], measures: list[str]) -> DataFrame:
    """STA-01: measure, both means, and the standardised mean difference (null if it isn't defined)."""
    a, b = values
    rows = df.select(group, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot([group], measures, "measure", "x")
    of = lambda v: F.when(F.col(group) == v, F.col("x"))
    out = rows.groupBy("measure").agg(
        F.avg(of(a)).alias("mean_1"), F.avg(of(b)).alias("mean_2"), F.var_samp(of(a)).alias("v1"), F.var_samp(of(b)).alias("v2")
    )
    spread = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return out.select("measure", "mean_1", "mean_2", F.when(spread > 0, (F.col("mean_1") - F.col("mean_2")) / spread).alias("smd"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-17: count, mean, sd, min, exact quartiles and max of each column, over all rows."""
    out = describe_numbers(df.select(F.lit("all").alias("_every"), *columns), "_every", columns)
    return out.select("measure", F.col("n").alias("count"), "mean", "sd", "min", F.col("q1").alias("p25"), F.col("median").alias("p50"), F.col("q3").alias("p75"), "max")


def share_of_all(df: DataFrame, by: str, entity: str) -> DataFrame:
    """JON-07: by, n and pct of all different entities, whose number is one row that is joined to every group."""
    whole = df.agg(F.count_distinct(entity).alias("n_all"))
    counts = df.groupBy(by).agg(F.count_distinct(entity).alias("n"))
    return counts.crossJoin(F.broadcast(whole)).select(by, "n", guarded_percent(F.col("n"), F.col("n_all")).alias("pct"))


def ordered_by_size(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """SRT-02, TOP-01: the n rows with the largest absolute values, nulls last, ties by key."""
    return df.orderBy(F.abs(F.col(column)).desc_nulls_last(), F.col(key)).limit(n)


def category_rank(value: Column, order: list[str]) -> Column:
    """SRT-03: the place of a value in a custom order, from 0; others come last."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(order)).cast("long")


def two_key_pivot(df: DataFrame, row: list[str], a: str, b: str, pairs: list[tuple[str, str]], value: str) -> DataFrame:
    """RSH-04: row and <value>_<a>_<b> of every listed pair of two columns' values, null where there is no row."""
    wide = [F.first(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value)), ignorenulls=True).alias(f"{value}_{x}_{y}") for x, y in pairs]
    return df.groupBy(*row).agg(*wide)
