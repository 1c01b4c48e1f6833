"""Look-back features over each subject's admissions (WIN-01 to WIN-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators import ranges
from cohortloom.operators.known import micros

_DAY = 86_400_000_000


def admission_history(admissions: DataFrame, urgent: Column) -> DataFrame:
    """admissions (subject_id, hadm_id, admittime, dischtime) with order, prior counts and previous values.

    All come from windows over one sort by subject, time and admission, cut into ranges, so that no
    subject fills a single task.
    """
    columns = ["subject_id", "hadm_id", "admittime", "dischtime"]
    rows = ranges.placed(admissions.select(*columns, urgent.cast("long").alias("_urgent")), ["subject_id"], ["admittime", "hadm_id"])
    last = lambda c: F.max_by(c, F.struct(F.col("admittime").isNotNull(), "admittime", "hadm_id"))
    parts = {
        "_n": F.count("*"), "_u": F.sum("_urgent"), "_hadm": last("hadm_id"), "_admit": last("admittime"), "_disch": last("dischtime"), "_first": F.min("admittime"),
    }
    carry = {
        "_cn": F.sum("_n"), "_cu": F.sum("_u"), "_chadm": F.last("_hadm"), "_cadmit": F.last("_admit"), "_cdisch": F.last("_disch"), "_cfirst": F.first("_first"),
    }
    rows = ranges.carried(rows, ["subject_id"], parts, carry)
    order = Window.partitionBy("_p", "subject_id").orderBy("admittime", "hadm_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(order) + F.coalesce("_cn", F.lit(0))
    opens = F.row_number().over(order) == 1
    previous = lambda c, carried: F.when(opens, F.col(carried)).otherwise(F.lag(c).over(order))
    return rows.select(
        "subject_id",
        "hadm_id",
        number.cast("long").alias("admission_order"),
        (number - 1).cast("long").alias("n_prior"),
        (F.coalesce(F.sum("_urgent").over(before), F.lit(0)) + F.coalesce("_cu", F.lit(0))).alias("n_prior_urgent"),
        previous("hadm_id", "_chadm").alias("previous_hadm_id"),
        previous("admittime", "_cadmit").alias("previous_admittime"),
        previous("dischtime", "_cdisch").alias("previous_dischtime"),
        F.coalesce("_cfirst", F.first("admittime").over(order)).alias("first_admittime"),
        F.datediff("admittime", previous("dischtime", "_cdisch")).cast("long").alias("days_since_previous_discharge"),
        F.datediff("admittime", F.coalesce("_cfirst", F.first("admittime").over(order))).cast("long").alias("days_since_first"),
    )


def lookback_counts(admissions: DataFrame, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """subject_id, hadm_id, n_prior_<d>d: strictly earlier admissions within each number of days, the bound included (WIN-05).

    Each row stands in its own stretch of time, and as context in the next one, so that a subject is counted in
    many tasks. Rows without a time have no earlier ones.
    """
    width = max(days) * _DAY
    timed = admissions.select("subject_id", "hadm_id", micros(F.col("admittime")).alias("at"))
    stretch = F.floor(F.col("at") / width)
    both = F.explode(F.when(F.col("at").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("ahead")
    rows = timed.select("*", both).select("*", (stretch + F.col("ahead")).alias("stretch"))
    order = Window.partitionBy("subject_id", "stretch").orderBy("at")
    counts = [F.when(F.col("at").isNull(), 0).otherwise(F.count("at").over(order.rangeBetween(-d * _DAY, -1))).alias(f"n_prior_{d}d") for d in days]
    return rows.select("subject_id", "hadm_id", "ahead", *counts).where("ahead = 0").drop("ahead")


def adjusted_p_values(df: DataFrame, group: str, p: str, key: str, out: str = "p_adjusted") -> DataFrame:
    """WIN-08: Benjamini-Hochberg within each group; null p values stay null and don't count."""
    some = ranges.placed(df.where(F.col(p).isNotNull()), [group], [p, key])
    sizes = some.groupBy(group).agg(F.count("*").alias("_m"))
    ranked = ranges.counted(some, [group], [p, key])
    ranked = ranked.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_before") + 1))
    ranked = ranges.carried(ranked, [group], {"_least": F.min("_raw")}, {"_later": F.min("_least")}, later=True)
    after = Window.partitionBy("_p", group).orderBy("_before").rowsBetween(0, Window.unboundedFollowing)
    value = F.least(F.lit(1.0), F.min("_raw").over(after), F.coalesce("_later", F.lit(1.0)))
    none = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.withColumn(out, value).select(*df.columns, out).unionByName(none)


def share_of_total(df: DataFrame, group: str, n: str, out: str = "share") -> DataFrame:
    """WIN-09: each row's part of its group's total, null for a total of 0."""
    total = F.sum(n).over(Window.partitionBy(group))
    return df.withColumn(out, F.try_divide(F.col(n).cast("double"), total.cast("double")))
