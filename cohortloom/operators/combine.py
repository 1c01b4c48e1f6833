"""Joins with provenance, key differences, preferred sources and resumption (JON-08 to JON-11, STR-01, STR-02, QA)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import text as tx
from cohortloom.functions.vocabulary import COMBINED_SUBGROUPS, OVERLAPS, SUBGROUPS
from cohortloom.operators import ranges


class ContractError(ValueError):
    """A frame breaks what an operator asks of it."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """QA-01: df, if it has the columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """QA-02: df, if no key repeats."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ContractError(f"repeated key: {repeated[0].asDict()}")
    return df


def merge_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """JON-08: a join after a check that keys are unique on the side or sides that validate names."""
    one_left, one_right = (x == "one" for x in validate.split("_to_"))
    if one_left:
        require_unique(left, on)
    if one_right:
        require_unique(right, on)
    return left.join(right, on, how)


def outer_with_source(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """JON-09: a full join with `_merge` (both, left_only, right_only)."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full_outer")
    source = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("_merge", source).drop("_l", "_r")


def key_differences(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """JON-10, QA-04: keys that are missing from seen or unexpected in it, with `status`."""
    a, b = expected.select(keys).distinct(), seen.select(keys).distinct()
    missing = a.join(b, keys, "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(b.join(a, keys, "left_anti").withColumn("status", F.lit("unexpected")))


def prefer(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """JON-11: one row for each key, from the first source that has it; order settles repeated rows of a source."""
    both = None
    for i, df in enumerate(sources):
        ranked = df.withColumn("_source", F.lit(i))
        both = ranked if both is None else both.unionByName(ranked, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_source", *order))
    return both.withColumn("_r", first).where("_r = 1").drop("_r", "_source")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """STR-01: the rows that a result doesn't have yet."""
    return rows.join(done.select(keys).distinct(), keys, "left_anti")


def last_written(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """STR-02: the last row of each key of an append-only log; order is from old to new."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return log.withColumn("_r", last).where("_r = 1").drop("_r")


def stacked_roles(df: DataFrame, prefixes: dict[str, str], shared: list[str]) -> DataFrame:
    """PRJ-03: one row for each role of a wide row; prefixes maps a column prefix to the role's name."""
    names = [[c[len(p) :] for c in df.columns if c.startswith(p)] for p in prefixes]
    common = [c for c in names[0] if all(c in n for n in names)]
    parts = [df.select(*shared, F.lit(role).alias("role"), *[F.col(p + c).alias(c) for c in common]) for p, role in prefixes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def collapse_labels(chunks: DataFrame, keys: list[str], label: str, order: str, priority: list[str]) -> DataFrame:
    """AGG-14: for each key the label of highest priority, the first chunk that has it, and how many chunks have each label."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(label))
    rank = F.when(rank > 0, rank).otherwise(len(priority) + 1)
    counts = [F.count_if(F.col(label) == p).alias(f"n_{p}") for p in priority]
    best = F.min_by(F.struct(label, order), F.struct(rank, F.col(order))).alias("b")
    out = chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"), *counts, best)
    return out.select(*keys, F.col(f"b.{label}").alias(label), F.col(f"b.{order}").alias(f"first_{order}"), "n_chunks", *[f"n_{p}" for p in priority])


def sampled(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """TOP-04: n rows of each stratum, chosen by a seeded hash of the key, the same on every run."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def first_entities(df: DataFrame, entity: str, order: list[Column], n: int) -> DataFrame:
    """TOP-03: all rows of the first n entities in an order."""
    firsts = df.groupBy(entity).agg(F.min(F.struct(*order)).alias("o")).orderBy("o", entity).limit(n)
    return df.join(firsts.select(entity), entity, "left_semi")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a number from 0 in an order that tells its rows apart; no task sees more than its range of rows."""
    rows = ranges.placed(df.withColumn("_g", F.lit(0)), ["_g"], order)
    return ranges.counted(rows, ["_g"], order).withColumn(name, F.col("_before").cast("long")).drop("_before", "_p", "_g")


def with_subgroups(df: DataFrame, complaint: str, terms: str) -> DataFrame:
    """TXT-21, CND-07: df with has_<subgroup> of every clinical subgroup, combination and overlap, how many subgroups
    match and which, the only one (`pure_group`) and the only combination (`exclusive_group`), null if there are none or several."""
    t, names = F.col(complaint), F.col(terms)
    out = df.withColumns({f"has_{g}": tx.belongs(t, names, *told) for g, told in SUBGROUPS.items()})
    out = out.withColumns({f"has_{g}": reduce(lambda a, b: a | b, [F.col(f"has_{x}") for x in own]) for g, own in COMBINED_SUBGROUPS.items()})
    out = out.withColumns({f"has_overlap_{g}": tx.belongs(t, names, *told) for g, told in OVERLAPS.items()})
    own = F.filter(F.array(*[F.when(F.col(f"has_{g}"), F.lit(g)) for g in SUBGROUPS]), lambda x: x.isNotNull())
    both = F.filter(F.array(*[F.when(F.col(f"has_{g}"), F.lit(g)) for g in COMBINED_SUBGROUPS]), lambda x: x.isNotNull())
    flags = [c for c in out.columns if c.startswith("has_")]
    out = out.withColumns({
        "n_subgroups": F.size(own).cast("long"), "subgroups": F.array_join(own, " | "),
        "pure_group": F.when(F.size(own) == 1, own[0]), "exclusive_group": F.when(F.size(both) == 1, both[0]),
    })
    return out.withColumns({c: F.col(c).cast("int") for c in flags})
