"""Queries for cohort definition, history and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import rules
from cohortloom.operators import cohort, combine, exports, history
from cohortloom.operators import summarise as sm
from cohortloom.plans import roles
from cohortloom.session import materialize, table

_WITH = "with " + roles.SQL.strip()


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of all admissions, written once: three operators and more read them."""
    return materialize(cohort.admission_facts(roles.diagnoses(spark, d), roles.dictionary(spark, d)))


def _grouped(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    admissions = roles.admissions(spark, d)
    facts = _facts(spark, d) if facts is None else facts
    base = cohort.base_of(admissions, roles.notes(spark, d), facts)
    return cohort.subject_groups(cohort.history_categories(base, admissions, facts))


def base_cohort_groups(spark, d):
    return _grouped(spark, d).drop("same_admission_psych_categories", "prior_psych_categories")


def prior_history_strings(spark, d):
    return cohort.exposed_only(_grouped(spark, d)).drop("subject_group", "mhc")


def subject_group_counts(spark, d):
    return _grouped(spark, d).groupBy("subject_group").agg(F.count_distinct("subject_id").alias("n_subjects"), F.count("*").alias("n_admissions"))


def code_category_counts(spark, d):
    return cohort.code_categories(roles.dictionary(spark, d)).groupBy("category").agg(F.count("*").alias("n_codes"))


def other_category_anti(spark, d):
    return cohort.code_categories(roles.dictionary(spark, d)).where("category = 'other'").select("icd_version", "icd_code")


def grey_zone_union(spark, d):
    return cohort.grey_codes(roles.dictionary(spark, d))


def base_admissions(spark, d):
    return cohort.base_admissions(roles.admissions(spark, d), roles.notes(spark, d), roles.diagnoses(spark, d), roles.dictionary(spark, d))


def primary_category_first_match(spark, d):
    found = cohort.primary_category(_facts(spark, d))
    return found.groupBy("category").agg(F.count("*").alias("n_admissions"), F.count_distinct("subject_id").alias("n_subjects"))


def same_admission_focus(spark, d):
    return cohort.with_focus(cohort.same_admission_only(_grouped(spark, d)), "same_admission_psych_categories").select("subject_id", "hadm_id", "same_admission_psych_categories")


def history_focus(spark, d):
    rows = cohort.exposed_only(_grouped(spark, d)).where("has_prior_psychiatric_history = 1")
    return cohort.with_focus(rows, "prior_psych_categories").select("subject_id", "hadm_id", "prior_psych_categories")


def history_only(spark, d):
    rows = _grouped(spark, d).where("has_prior_psychiatric_history = 1 and has_secondary_psychiatric_same_admission = 0")
    return rows.select("subject_id", "hadm_id", "admittime", "prior_psych_categories", "subject_group")


def focus_overlap_patterns(spark, d):
    rows = cohort.focus_patterns(_grouped(spark, d), "same_admission_psych_categories")
    return rows.groupBy("pattern").agg(F.count("*").alias("n_admissions"), F.count_distinct("subject_id").alias("n_subjects"))


def category_complexity(spark, d):
    rows = cohort.focus_patterns(_grouped(spark, d), "prior_psych_categories")
    return rows.groupBy("subject_group", "n_categories").agg(F.count("*").alias("n_admissions"))


def _states(spark, d, refined):
    facts = _facts(spark, d)
    return cohort.admission_states(roles.admissions(spark, d), materialize(_grouped(spark, d, facts)), facts, refined)


def mixed_trajectories(spark, d):
    return cohort.trajectories(_states(spark, d, False))


def trajectory_counts(spark, d):
    return mixed_trajectories(spark, d).groupBy("trajectory").agg(F.count("*").alias("n_subjects"))


def refined_states(spark, d):
    return _states(spark, d, True).groupBy("admission_state").agg(F.count_distinct("hadm_id").alias("n_admissions"), F.count_distinct("subject_id").alias("n_subjects"))


def exposed_control_export(spark, d):
    """COH-12: exposed and control rows with valid stratum and age-like range (PRJ-01, FLT-07, SRC-06)."""
    people = roles.patients(spark, d).withColumn("age", F.col("nation").cast("long") * 4 + 2)
    rows = _grouped(spark, d).join(people, "subject_id").withColumn("age_at_admission", F.col("age") + F.year("admittime") - 1995)
    valid = F.col("age_at_admission").between(18, 120) & F.col("segment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")
    exposed = cohort.with_focus(rows.where("has_prior_psychiatric_history = 1"), "prior_psych_categories", ["psychotic"]).where(valid)
    control = rows.where("subject_group = 'only_MHC0'").where(valid)
    columns = ["subject_id", "hadm_id", "age_at_admission", "segment"]
    return exposed.select(F.lit("exposed").alias("cohort"), *columns).unionByName(control.select(F.lit("control").alias("cohort"), *columns))


def admission_history_windows(spark, d):
    return history.admission_history(roles.admissions(spark, d), _urgent())


def lookback_30_90_365(spark, d):
    return history.lookback_counts(roles.admissions(spark, d))


def first_pair_per_subject(spark, d):
    """COH-17 on the matched pairs of the domain tables."""
    admitted = table(spark, d, "base_admissions_mhc_subject_groups").select("hadm_id", "admittime").distinct()
    pairs = table(spark, d, "matched_pairs").select("pair_id", "mhh_subject_id", "mhh_hadm_id", "mhc0_subject_id", "mhc0_hadm_id").distinct()
    rows = combine.stacked_roles(pairs, {"mhh_": "case", "mhc0_": "control"}, ["pair_id"]).join(admitted, "hadm_id", "left")
    return cohort.first_pairs(rows, "role", "case", "control").select("pair_id", "role", "subject_id", "hadm_id")


def psychosis_extended(spark, d):
    return cohort.listed_codes(roles.dictionary(spark, d), rules.PSYCHOSIS_EXTENDED)


def psychosis_restricted(spark, d):
    return cohort.listed_codes(roles.dictionary(spark, d), rules.PSYCHOSIS_RESTRICTED)


def psychosis_removed(spark, d):
    """COH-14: what the restricted list leaves out of the extended one."""
    wide, narrow = (cohort.listed_codes(roles.dictionary(spark, d), x) for x in (rules.PSYCHOSIS_EXTENDED, rules.PSYCHOSIS_RESTRICTED))
    return wide.join(narrow.select(cohort.KEY), cohort.KEY, "left_anti")


def psychosis_titles_unlisted(spark, d):
    return cohort.unlisted_titles(roles.dictionary(spark, d), rules.PSYCHOSIS_SEEN, rules.PSYCHOSIS_TITLES)


def _urgent():
    return F.upper("admission_type").contains("URGENT") | F.upper("admission_type").contains("EMER")


def matched_descriptors(spark, d):
    """COH-16: the matched admissions with their patient and history."""
    found = exports.matched_descriptors(roles.matched(spark, d), roles.patients(spark, d), roles.admissions(spark, d), _urgent())
    return found.drop("o_orderstatus", "o_totalprice", "score")


def matched_subject_history(spark, d):
    found = exports.matched_subject_history(roles.matched(spark, d), roles.patients(spark, d), roles.admissions(spark, d), _urgent())
    return found.select("matched_cohort", "subject_id", "hadm_id", "is_matched_cohort_admission", "n_prior", "n_prior_365d", "has_prior_30d", "previous_hadm_id", "segment")


def matched_labevents(spark, d):
    return exports.matched_events(roles.matched(spark, d), roles.lab_events(spark, d), roles.lab_items(spark, d))


def matched_order_details(spark, d):
    return exports.matched_events(roles.matched(spark, d), roles.orders(spark, d), details=roles.order_details(spark, d))


def matched_diagnoses(spark, d):
    return exports.matched_diagnoses(roles.matched(spark, d), roles.diagnoses(spark, d), roles.dictionary(spark, d))


def category_share(spark, d):
    """JON-07: admissions with each first category as a share of all admissions that have one."""
    return sm.share_of_all(cohort.primary_category(_facts(spark, d)), "category", "hadm_id")


def state_reversals(spark, d):
    """QA-05: no admission is unexposed after an exposed one."""
    return cohort.reversals(_states(spark, d, False)).select("subject_id", "hadm_id", "admission_state")


def readmission_cap_loss(spark, d):
    """COH-18 on the utilisation rows of the domain tables."""
    rows = table(spark, d, "utilization_readmission_adjusted_model_dataset").select("pair_id", "subject_id", "hadm_id", "admittime").distinct()
    return cohort.cap_loss(rows, "pair_id", "subject_id", ["admittime", "hadm_id"])


QUERIES = {
    f.__name__: f
    for f in (
        base_cohort_groups, prior_history_strings, subject_group_counts, code_category_counts, other_category_anti, grey_zone_union, base_admissions,
        primary_category_first_match, same_admission_focus, history_focus, history_only, focus_overlap_patterns, category_complexity, mixed_trajectories,
        trajectory_counts, refined_states, exposed_control_export, admission_history_windows, lookback_30_90_365, first_pair_per_subject, readmission_cap_loss,
        psychosis_extended, psychosis_restricted, psychosis_removed, psychosis_titles_unlisted, matched_descriptors, matched_subject_history,
        matched_labevents, matched_order_details, matched_diagnoses, category_share, state_reversals,
    )
}

_PATTERN = """
patterned as (select *, list_filter(['internalizing', 'substance_related', 'psychotic', 'personality_behavioral'],
    lambda x: list_contains(string_split(coalesce({0}, ''), ' | '), x)) as f from grouped)
select {1} from (select *, case len(f) when 0 then 'none_of_focus4' when 4 then 'all_four' when 1 then f[1] || '_only'
  else array_to_string(f, '+') end as pattern, len(list_filter(string_split(coalesce({0}, ''), ' | '), lambda x: x <> ''))::bigint as n_categories from patterned)
"""
_STATES = """
, mixed as (select distinct subject_id from grouped where subject_group = 'MHC_0_to_1'),
states as (select a.subject_id, a.hadm_id, a.admittime, case {0}
    when exists (select 1 from diagnoses d join psychiatric p using (icd_version, icd_code)
      where d.subject_id = a.subject_id and d.hadm_id = a.hadm_id and d.seq_num = 1) then 4 else 9 end as admission_state
  from admissions a join mixed using (subject_id) left join grouped g on g.subject_id = a.subject_id and g.hadm_id = a.hadm_id),
trajectories as (select subject_id, count(*) as n_admissions, string_agg(admission_state::varchar, '-' order by admittime, hadm_id) as trajectory
  from states group by 1)
"""
_MHC = _STATES.format("when g.mhc = 0 then 0 when g.mhc = 1 then 1")
_REFINED = _STATES.format(
    "when g.hadm_id is not null then case when g.has_secondary_psychiatric_same_admission = 0 and g.has_prior_psychiatric_history = 0 then 0 "
    "when g.has_prior_psychiatric_history = 0 then 11 when g.has_secondary_psychiatric_same_admission = 0 then 12 else 13 end"
)
_FOCUS = "regexp_matches({}, 'internalizing|substance_related|psychotic|personality_behavioral')"

_EXTENDED = """((icd_version = 10 and (regexp_matches(icd_code, '^(F20|F22|F23|F24|F25|F28|F29|F060|F061|F062|F531|F1[0-9].*5)')
    or icd_code in ('F0152', 'F01A2', 'F01B2', 'F01C2', 'F0282', 'F02A2', 'F02B2', 'F02C2', 'F0392', 'F03A2', 'F03B2', 'F03C2', 'F302', 'F312', 'F315', 'F3164', 'F323', 'F333')))
  or (icd_version = 9 and (icd_code like '295%' or icd_code in ('2971', '2973', '2980', '2981', '2984', '2988', '2989', '29012', '29020', '29042', '29381', '29382', '29211',
    '29212', '2913', '2915', '29604', '29614', '29624', '29634', '29644', '29654', '29664', 'V110', '2908', '2909'))))"""
_RESTRICTED = """((icd_version = 10 and (regexp_matches(icd_code, '^(F20|F22|F23|F24|F25|F28|F29|F531)') or icd_code in ('F302', 'F312', 'F315', 'F3164', 'F323', 'F333')))
  or (icd_version = 9 and (icd_code like '295%' or icd_code in ('2971', '2973', '2980', '2981', '2988', '2989', '2984', '29604', '29614', '29624', '29634', '29644', '29654',
    '29664', 'V110'))))"""
_MATCHED = """matched as (select o_orderkey // 2 as pair_id, case when o_orderkey % 2 = 0 then 'case' else 'control' end as matched_role,
  case when o_orderkey % 2 = 0 then 'MHH1_psychotic' else 'MHC0' end as cohort, o_custkey as subject_id, o_orderkey as hadm_id from orders where o_orderpriority = '1-URGENT')"""
_HISTORY = f"""{_MATCHED}, w as (select a.subject_id, a.hadm_id, a.admittime, a.dischtime, a.admission_type, row_number() over w as admission_order, row_number() over w - 1 as n_prior,
    coalesce(sum((upper(admission_type) like '%URGENT%' or upper(admission_type) like '%EMER%')::int) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as n_prior_urgent,
    lag(hadm_id) over w as previous_hadm_id, lag(admittime) over w as previous_admittime, lag(dischtime) over w as previous_dischtime,
    first_value(admittime) over w as first_admittime, date_diff('day', lag(dischtime) over w, admittime) as days_since_previous_discharge,
    date_diff('day', first_value(admittime) over w, admittime) as days_since_first
  from admissions a window w as (partition by subject_id order by admittime, hadm_id)),
n as (select c.subject_id, c.hadm_id, count(p.hadm_id) filter (where p.admittime >= c.admittime - interval 30 days) as n_prior_30d,
    count(p.hadm_id) filter (where p.admittime >= c.admittime - interval 90 days) as n_prior_90d, count(p.hadm_id) filter (where p.admittime >= c.admittime - interval 365 days) as n_prior_365d
  from admissions c left join admissions p on p.subject_id = c.subject_id and p.admittime < c.admittime group by 1, 2),
h as (select w.*, n.n_prior_30d, n.n_prior_90d, n.n_prior_365d, (n_prior_30d > 0)::int as has_prior_30d, (n_prior_90d > 0)::int as has_prior_90d, (n_prior_365d > 0)::int as has_prior_365d
  from w join n using (subject_id, hadm_id))"""

SQL = {
    "base_cohort_groups": _WITH
    + " select subject_id, hadm_id, admittime, mhc, has_secondary_psychiatric_same_admission, has_prior_psychiatric_history, subject_group from grouped",
    "prior_history_strings": _WITH
    + """ select subject_id, hadm_id, admittime, has_secondary_psychiatric_same_admission, has_prior_psychiatric_history, same_admission_psych_categories,
  prior_psych_categories from grouped where subject_group = 'only_MHC1' and mhc = 1""",
    "subject_group_counts": _WITH + " select subject_group, count(distinct subject_id) as n_subjects, count(*) as n_admissions from grouped group by 1",
    "code_category_counts": _WITH + " select category, count(*) as n_codes from categories group by 1",
    "other_category_anti": _WITH + " select icd_version, icd_code from categories where category = 'other'",
    "grey_zone_union": _WITH + " select icd_version, icd_code, long_title from grey",
    "base_admissions": _WITH + " select subject_id, hadm_id, admittime from base",
    "primary_category_first_match": _WITH
    + """, firsts as (select d.subject_id, d.hadm_id, min(list_position(['psychotic', 'substance_related', 'internalizing', 'personality_behavioral',
    'neurodevelopmental', 'neurocognitive', 'suicide_self_harm', 'other'], c.category)) as p
  from diagnoses d join categories c using (icd_version, icd_code) where d.seq_num = 1 group by 1, 2)
select ['psychotic', 'substance_related', 'internalizing', 'personality_behavioral', 'neurodevelopmental', 'neurocognitive', 'suicide_self_harm',
  'other'][p] as category, count(*) as n_admissions, count(distinct subject_id) as n_subjects from firsts group by 1""",
    "same_admission_focus": _WITH
    + f" select subject_id, hadm_id, same_admission_psych_categories from grouped where subject_group = 'only_MHC1' and has_secondary_psychiatric_same_admission = 1 and has_prior_psychiatric_history = 0 and {_FOCUS.format('same_admission_psych_categories')}",
    "history_focus": _WITH
    + f""" select subject_id, hadm_id, prior_psych_categories from grouped where subject_group = 'only_MHC1' and has_prior_psychiatric_history = 1
  and {_FOCUS.format('prior_psych_categories')}""",
    "history_only": _WITH
    + """ select subject_id, hadm_id, admittime, prior_psych_categories, subject_group from grouped
where has_prior_psychiatric_history = 1 and has_secondary_psychiatric_same_admission = 0""",
    "focus_overlap_patterns": _WITH
    + ","
    + _PATTERN.format("same_admission_psych_categories", "pattern, count(*) as n_admissions, count(distinct subject_id) as n_subjects")
    + "group by 1",
    "category_complexity": _WITH + "," + _PATTERN.format("prior_psych_categories", "subject_group, n_categories, count(*) as n_admissions") + "group by 1, 2",
    "mixed_trajectories": _WITH + _MHC + " select * from trajectories",
    "trajectory_counts": _WITH + _MHC + " select trajectory, count(*) as n_subjects from trajectories group by 1",
    "refined_states": _WITH
    + _REFINED
    + " select admission_state, count(distinct hadm_id) as n_admissions, count(distinct subject_id) as n_subjects from states group by 1",
    "exposed_control_export": _WITH
    + """, aged as (select g.*, c.c_mktsegment as segment, c.c_nationkey * 4 + 2 + year(g.admittime) - 1995 as age_at_admission
  from grouped g join customer c on c.c_custkey = g.subject_id)
select case when subject_group = 'only_MHC0' then 'control' else 'exposed' end as cohort, subject_id, hadm_id, age_at_admission, segment from aged
where age_at_admission between 18 and 120 and segment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  and (subject_group = 'only_MHC0' or (has_prior_psychiatric_history = 1 and prior_psych_categories like '%psychotic%'))""",
    "admission_history_windows": _WITH
    + """ select subject_id, hadm_id, row_number() over w as admission_order, row_number() over w - 1 as n_prior,
  coalesce(sum(case when upper(admission_type) like '%URGENT%' or upper(admission_type) like '%EMER%' then 1 else 0 end)
    over (w rows between unbounded preceding and 1 preceding), 0)::bigint as n_prior_urgent,
  lag(hadm_id) over w as previous_hadm_id, date_diff('day', lag(dischtime) over w, admittime) as days_since_previous_discharge,
  lag(admittime) over w as previous_admittime, lag(dischtime) over w as previous_dischtime, first_value(admittime) over w as first_admittime,
  date_diff('day', first_value(admittime) over w, admittime) as days_since_first
from admissions window w as (partition by subject_id order by admittime, hadm_id)""",
    "lookback_30_90_365": _WITH
    + """ select c.subject_id, c.hadm_id, count(p.hadm_id) filter (where p.admittime >= c.admittime - interval 30 days) as n_prior_30d,
  count(p.hadm_id) filter (where p.admittime >= c.admittime - interval 90 days) as n_prior_90d,
  count(p.hadm_id) filter (where p.admittime >= c.admittime - interval 365 days) as n_prior_365d
from admissions c left join admissions p on p.subject_id = c.subject_id and p.admittime < c.admittime group by 1, 2""",
    "first_pair_per_subject": """
with a as (select distinct hadm_id, admittime from base_admissions_mhc_subject_groups), p as (select distinct pair_id, mhh_subject_id, mhh_hadm_id, mhc0_subject_id, mhc0_hadm_id from matched_pairs),
s as (select pair_id, 'case' as role, mhh_subject_id as subject_id, mhh_hadm_id as hadm_id from p union all select pair_id, 'control', mhc0_subject_id, mhc0_hadm_id from p),
r as (select s.*, a.admittime from s left join a using (hadm_id)),
f as (select pair_id from r where role = 'case' qualify row_number() over (partition by subject_id order by admittime nulls last, pair_id, hadm_id) = 1),
k as (select r.* from r where pair_id in (select pair_id from f)),
w as (select pair_id from k group by 1 having count(distinct hadm_id) filter (where role = 'case') = 1 and count(distinct hadm_id) filter (where role = 'control') = 1),
c as (select pair_id from k where role = 'control' and pair_id in (select pair_id from w)
  qualify row_number() over (partition by subject_id order by admittime nulls last, pair_id, hadm_id) = 1)
select pair_id, role, subject_id, hadm_id from k where pair_id in (select pair_id from w) and pair_id in (select pair_id from c)""",
    "psychosis_extended": f"{_WITH} select distinct icd_version, icd_code, long_title from dictionary where {_EXTENDED}",
    "psychosis_restricted": f"{_WITH} select distinct icd_version, icd_code, long_title from dictionary where {_RESTRICTED}",
    "psychosis_removed": f"{_WITH} select distinct icd_version, icd_code, long_title from dictionary where {_EXTENDED} and not {_RESTRICTED}",
    "psychosis_titles_unlisted": _WITH
    + """ select distinct icd_version, icd_code, long_title from dictionary
where regexp_matches(lower(long_title), 'psycho|schizo|delusion') and not ((icd_version = 10 and regexp_matches(icd_code, '^(F2[0234589]|F06[012]|F531|F1[0-9].*5)'))
  or (icd_version = 9 and (regexp_matches(icd_code, '^(295|6484)') or icd_code in ('2971', '2973', '2988', '2989', '29381', '29382', '29211', '29212'))))""",
    "matched_descriptors": f"""{_WITH}, {_HISTORY} select m.pair_id, m.matched_role, m.cohort, m.subject_id, m.hadm_id, c.c_mktsegment as segment, c.c_nationkey as nation,
  h.* exclude (subject_id, hadm_id) from matched m left join customer c on c.c_custkey = m.subject_id left join h on h.subject_id = m.subject_id and h.hadm_id = m.hadm_id""",
    "matched_subject_history": f"""{_WITH}, {_HISTORY}, s as (select distinct cohort, subject_id from matched)
select s.cohort as matched_cohort, h.subject_id, h.hadm_id, (m.hadm_id is not null)::int as is_matched_cohort_admission, h.n_prior, h.n_prior_365d, h.has_prior_30d,
  h.previous_hadm_id, c.c_mktsegment as segment from s join h using (subject_id) left join customer c on c.c_custkey = h.subject_id
  left join (select distinct cohort, subject_id, hadm_id from matched) m on m.cohort = s.cohort and m.subject_id = h.subject_id and m.hadm_id = h.hadm_id""",
    "matched_labevents": f"""{_WITH}, {_MATCHED} select m.*, l.l_partkey as itemid, l.l_quantity as valuenum, l.l_shipdate as charttime, p.p_name as label, p.p_brand as fluid, p.p_type as category
from matched m join orders o on o.o_orderkey = m.hadm_id join lineitem l on l.l_orderkey = o.o_orderkey left join part p on p.p_partkey = l.l_partkey""",
    "matched_order_details": f"""{_WITH}, {_MATCHED} select m.*, o.o_orderkey as poe_id, o.o_orderpriority as order_type, l.l_returnflag as field_name, l.l_quantity as field_value
from matched m join orders o on o.o_orderkey = m.hadm_id join lineitem l on l.l_orderkey = o.o_orderkey""",
    "matched_diagnoses": f"""{_WITH}, {_MATCHED}, t as (select distinct icd_version, icd_code, long_title from dictionary)
select m.*, d.seq_num, d.icd_version, d.icd_code, t.long_title, (exists (select 1 from psychiatric p where p.icd_version = d.icd_version and p.icd_code = d.icd_code))::int as is_psychiatric_icd,
  (exists (select 1 from grey g where g.icd_version = d.icd_version and g.icd_code = d.icd_code))::int as is_grey_zone_physical_icd, (d.seq_num = 1)::int as is_primary_diagnosis
from matched m join diagnoses d on d.subject_id = m.subject_id and d.hadm_id = m.hadm_id left join t on t.icd_version = d.icd_version and t.icd_code = d.icd_code""",
    "category_share": _WITH
    + """, firsts as (select d.hadm_id, min(list_position(['psychotic', 'substance_related', 'internalizing', 'personality_behavioral', 'neurodevelopmental', 'neurocognitive',
    'suicide_self_harm', 'other'], c.category)) as p from diagnoses d join categories c using (icd_version, icd_code) where d.seq_num = 1 group by 1)
select ['psychotic', 'substance_related', 'internalizing', 'personality_behavioral', 'neurodevelopmental', 'neurocognitive', 'suicide_self_harm', 'other'][p] as category,
  count(*) as n, 100.0::double * count(*) / (select count(*) from firsts) as pct from firsts group by 1""",
    "state_reversals": _WITH
    + _MHC
    + """ select subject_id, hadm_id, admission_state from states s where admission_state = 0 and exists
  (select 1 from states p where p.subject_id = s.subject_id and p.admission_state = 1 and p.admittime <= s.admittime)""",
    "readmission_cap_loss": """
with r as (select distinct pair_id, subject_id, hadm_id, admittime from utilization_readmission_adjusted_model_dataset),
n as (select *, row_number() over (partition by subject_id order by admittime nulls first, hadm_id) as n from r),
w as (select *, max(n) over (partition by pair_id) as worst from n)
select cap::int as cap, count(*) as n_rows, count(*) filter (where n <= cap) as n_kept, count(*) filter (where worst <= cap) as n_kept_in_whole_pairs,
  count(distinct case when worst <= cap then pair_id end) as n_whole_pairs from w cross join (values (3), (4), (5)) t(cap) group by 1""",
}
