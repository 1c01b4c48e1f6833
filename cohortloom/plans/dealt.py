"""Queries for attributes as known at event time (p4) and trailing totals (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import known, trailing
from cohortloom.session import table


def _admissions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "base_admissions_mhc_subject_groups").select("subject_id", "hadm_id", "admittime", "has_prior_psychiatric_history").distinct()


def _on_record(spark: SparkSession, d: str) -> DataFrame:
    admissions = _admissions(spark, d).withColumn("event", F.struct("hadm_id", "has_prior_psychiatric_history"))
    records = table(spark, d, "psych_history_records")
    found = known.as_known(admissions, records, "subject_id", "event", "admittime", "psych_category", "recorded_at", "withdrawn_at")
    return found.select("event.hadm_id", "event.has_prior_psychiatric_history", "attributes")


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    return _on_record(spark, d).select("hadm_id", F.array_join("attributes", "|").alias("categories_on_record"), F.size("attributes").cast("long").alias("n_on_record"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = _on_record(spark, d)
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("prior_psych_categories", r"\|"), known.clean_name), lambda x: x.isNotNull())))
    stored = table(spark, d, "possible_overshadowing_admissions_psychiatric").select("hadm_id", "prior_psych_categories").distinct()
    stored = stored.select("hadm_id", F.coalesce(names, F.array().cast("array<string>")).alias("stored"))
    flag = F.coalesce(F.col("has_prior_psychiatric_history") == 1, F.lit(False))
    wrong_flag = found.where(flag != (F.size("attributes") > 0)).select("hadm_id")
    wrong_names = found.join(stored, "hadm_id").where(F.col("stored") != F.col("attributes")).select("hadm_id")
    return wrong_flag.union(wrong_names).distinct()


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    return trailing.rolling_calendar(table(spark, d, "base_admissions_mhc_subject_groups"), "subject_id", "hadm_id", "admittime")


def p7_calendar(spark: SparkSession, d: str) -> DataFrame:
    return trailing.rolling_calendar(table(spark, d, "base_admissions_mhc_subject_groups"), "subject_id", "hadm_id", "admittime", whole=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "utilization_readmission_adjusted_model_dataset").select("hadm_id", "subject_id", "admittime", "prior_admissions_365d")
    asked = asked.where("prior_admissions_365d is not null").distinct()
    counted = trailing.counts_before(table(spark, d, "base_admissions_mhc_subject_groups"), asked, "subject_id", "hadm_id", "admittime", "hadm_id")
    return counted.where("not (prior_admissions_365d <=> n_before)").select("hadm_id").distinct()


QUERIES = {"p4_found": p4_found, "p4_history": p4_history, "p7_calendar": p7_calendar, "p7_found": p7_found, "p7_rolling": p7_rolling}

_NAMES = "nullif(regexp_replace(lower({}), '\\s+', '', 'g'), '')"
_ON_RECORD = f"""
with a as (select distinct subject_id, hadm_id, admittime, has_prior_psychiatric_history from base_admissions_mhc_subject_groups),
r as (select subject_id, {_NAMES.format("psych_category")} as name, recorded_at, withdrawn_at from psych_history_records),
on_record as (
  select a.hadm_id, any_value(a.has_prior_psychiatric_history) as flag,
    coalesce(list_sort(list(distinct r.name) filter (where r.name is not null)), []) as names
  from a left join r on a.subject_id = r.subject_id and r.recorded_at < a.admittime
    and (r.withdrawn_at is null or r.withdrawn_at > a.admittime)
  group by a.hadm_id)
"""

SQL = {
    "p4_history": _ON_RECORD
    + "select hadm_id, array_to_string(names, '|') as categories_on_record, len(names)::bigint as n_on_record from on_record",
    "p4_found": _ON_RECORD
    + f""", stored as (
  select distinct hadm_id, list_sort(list_distinct(list_filter(list_transform(
    string_split(coalesce(prior_psych_categories, ''), '|'), lambda x: {_NAMES.format("x")}), lambda x: x is not null))) as names
  from possible_overshadowing_admissions_psychiatric)
select hadm_id from on_record where coalesce(flag = 1, false) <> (len(names) > 0)
union
select o.hadm_id from on_record o join stored s using (hadm_id) where o.names <> s.names
""",
    "p7_rolling": """
with a as (select distinct subject_id, hadm_id, admittime::date as d from base_admissions_mhc_subject_groups
  where subject_id is not null and hadm_id is not null and admittime is not null),
n as (select subject_id, d, count(*) as n from a group by 1, 2),
span as (select subject_id, min(d) as first, least(max(d) + 364, (select max(d) from n)) as last from n group by 1),
days as (select subject_id, unnest(generate_series(first, last, interval 1 day))::date as day from span)
select days.subject_id, days.day,
  sum(case when n.d > day - 7 then n.n else 0 end)::bigint as n_7d, sum(case when n.d > day - 30 then n.n else 0 end)::bigint as n_30d,
  coalesce(sum(n.n), 0)::bigint as n_365d,
  sum(case when n.d > day - 7 then n.n else 0 end)::double / 7 as mean_7d, sum(case when n.d > day - 30 then n.n else 0 end)::double / 30 as mean_30d,
  coalesce(sum(n.n), 0)::double / 365 as mean_365d
from days left join n on n.subject_id = days.subject_id and n.d <= day and n.d > day - 365
group by 1, 2
""",
    "p7_found": """
with a as (select distinct subject_id, hadm_id, admittime from base_admissions_mhc_subject_groups),
u as (select distinct hadm_id, subject_id, admittime, prior_admissions_365d from utilization_readmission_adjusted_model_dataset
  where prior_admissions_365d is not null)
select u.hadm_id from u left join a on a.subject_id = u.subject_id and a.admittime >= u.admittime - interval 365 days and a.admittime < u.admittime
group by u.hadm_id, u.subject_id, u.admittime, u.prior_admissions_365d
having count(distinct a.hadm_id) <> u.prior_admissions_365d
""",
}
