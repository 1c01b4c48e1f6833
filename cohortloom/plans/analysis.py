"""Queries for summaries, joins with provenance, matching and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortloom.functions import values as vl
from cohortloom.functions import vocabulary
from cohortloom.operators import combine, comorbidity, history, matching, models, stats
from cohortloom.operators import summarise as sm
from cohortloom.plans import roles
from cohortloom.plans.comorbidity_sql import GROUPS_SQL
from cohortloom.session import checkpoint_root, materialize, remove, table
from cohortloom.sources import readers, writers
from cohortloom.streaming import lookback

MEASURES = ["elixhauser_score", "hospital_los_days", "n_labevents", "n_orders", "prior_admissions_365d"]


def _utilisation(spark, d):
    return table(spark, d, "utilization_readmission_adjusted_model_dataset").distinct()


def _variables(spark, d):
    return table(spark, d, "mhh_psychotic_matching_variables").drop("embedding").distinct()


def _rounded(df, digits=10):
    """Sums in another order differ in the last digits; more than what the data have is kept."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def cohort_numeric_summary(spark, d):
    return _rounded(sm.describe_numbers(_utilisation(spark, d), "cohort", MEASURES))


def cohort_categorical_balance(spark, d):
    return sm.describe_categories(_variables(spark, d), "cohort", ["sex", "insurance_group", "chief_complaint_normalized"])


def overall_beside_groups(spark, d):
    return sm.with_overall(_utilisation(spark, d), "cohort", [F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_subjects"), F.sum("n_labevents").alias("n_labs")])


def admissions_per_subject_hist(spark, d):
    return sm.count_histogram(roles.admissions(spark, d), "subject_id")


def interval_buckets(spark, d):
    rows = history.admission_history(roles.admissions(spark, d), F.lit(False)).where("days_since_previous_discharge is not null")
    return sm.bin_counts(rows, "days_since_previous_discharge", [-10, 0, 30, 90, 365, 100000], ["none", "30d", "90d", "365d", "more"])


def age_bin_cut_all_bins(spark, d):
    edges = [0, 18, 30, 40, 50, 60, 70, 80, 90, 130, 150]
    labels = ["<18", "18-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90+", "none"]
    return sm.bin_counts(_variables(spark, d), "age_at_admission", edges, labels, right=False)


def matched_pair_smd(spark, d):
    roles_ = combine.stacked_roles(table(spark, d, "matched_pairs").distinct(), {"mhh_": "case", "mhc0_": "control"}, ["pair_id"])
    return _rounded(sm.standardised_difference(roles_, "role", ("case", "control"), ["age_at_admission", "elixhauser_score"]))


def stacked_pairs(spark, d):
    rows = combine.stacked_roles(table(spark, d, "matched_pairs").distinct(), {"mhh_": "case", "mhc0_": "control"}, ["pair_id"])
    return rows.select("pair_id", "role", "subject_id", "hadm_id", "age_bin")


def topn_codes_per_group(spark, d):
    counts = roles.diagnoses(spark, d).groupBy("icd_version", "icd_code").agg(F.count_distinct("hadm_id").alias("n_admissions"))
    return sm.top_per_group(counts, "icd_version", [F.desc("n_admissions"), F.asc("icd_code")], 10)


def event_counts_zero_filled(spark, d):
    kinds = {f"n_{k}": F.col("event_type") == k for k in ("click", "error", "purchase", "signup", "view")}
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return sm.zero_filled_counts(keys, table(spark, d, "events"), "user_id", kinds)


def label_crosstab(spark, d):
    return sm.crosstab(table(spark, d, "chief_complaint_cluster_qc_output").distinct(), "cohort", "bert_cluster")


def pivot_rates(spark, d):
    return sm.pivot_difference(_variables(spark, d), "insurance_group", "sex", ("F", "M"), F.avg("elixhauser_score"))


def collapsed_insurance(spark, d):
    return sm.collapse_category(_variables(spark, d), "subject_id", "insurance_group")


def insurance_category(spark, d):
    rules = [("public", ["MEDICARE", "MEDICAID", "GOV"]), ("private", ["PRIV", "COMM"]), ("none", ["SELF", "NO CHARGE", "UNINSURED"])]
    rows = _variables(spark, d).select("hadm_id", sm.keyword_category(F.col("insurance"), rules, "other").alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def share_of_group(spark, d):
    counts = _variables(spark, d).groupBy("sex", "insurance_group").agg(F.count("*").alias("n"))
    return history.share_of_total(counts, "sex", "n")


def adjusted_p_values(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("m"))
    rows = rows.withColumn("p", F.round(F.abs(F.col("m") - 0.05) * 10, 6))
    return history.adjusted_p_values(rows, "l_returnflag", "p", "l_suppkey").select("l_returnflag", "l_suppkey", "p", "p_adjusted")


def label_agreement_outer(spark, d):
    pairs = table(spark, d, "matched_pairs").select(F.col("mhh_hadm_id").alias("hadm_id"), F.col("match_type").alias("a")).distinct()
    clusters = table(spark, d, "chief_complaint_cluster_qc_output").select("hadm_id", F.col("bert_cluster").alias("b")).distinct()
    return combine.outer_with_source(pairs, clusters, ["hadm_id"]).groupBy("_merge").agg(F.count("*").alias("n")).withColumnRenamed("_merge", "source")


def resume_missing_rows(spark, d):
    done = table(spark, d, "psych_history_llm_input").where("n_psych_keyword_hits >= 3")
    return combine.remaining(table(spark, d, "psych_history_llm_input").distinct(), done, ["hadm_id"]).select("classifier_row_id", "hadm_id")


def key_differences(spark, d):
    base = table(spark, d, "base_admissions_mhc_subject_groups").where("mhc = 1")
    return combine.key_differences(table(spark, d, "possible_overshadowing_admissions_psychiatric"), base, ["hadm_id"])


def preferred_source_merge(spark, d):
    new = table(spark, d, "possible_overshadowing_admissions_psychiatric").select("hadm_id", "has_prior_psychiatric_history", F.lit("new").alias("source"))
    old = table(spark, d, "base_admissions_mhc_subject_groups").select("hadm_id", "has_prior_psychiatric_history", F.lit("old").alias("source"))
    return combine.prefer([new, old], ["hadm_id"], [F.col("has_prior_psychiatric_history")])


def last_written_rows(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return combine.last_written(log, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


def chunk_label_collapse(spark, d):
    rows = table(spark, d, "psych_history_llm_input").select("classifier_row_id", "hadm_id", "n_psych_keyword_hits").distinct()
    label = F.when(F.col("n_psych_keyword_hits") >= 4, "positive").when(F.col("n_psych_keyword_hits") >= 2, "unclear").otherwise("negative")
    return combine.collapse_labels(rows.withColumn("label", label), ["hadm_id"], "label", "classifier_row_id", ["positive", "unclear", "negative"])


def death_window_flags(spark, d):
    """DAT-05 with days of death and the flag of the admission made from its number."""
    death = F.when(F.col("hadm_id") % 3 == 0, F.col("dischtime") + F.make_dt_interval((F.col("hadm_id") % 400).cast("int") - 5))
    rows = roles.admissions(spark, d).withColumn("dod", death).withColumn("expired", (F.col("hadm_id") % 11 == 0).cast("int"))
    flags = vl.death_flags(F.col("admittime"), F.col("dischtime"), F.col("dod"), F.col("expired"))
    return rows.select("hadm_id", *[f.cast("int").alias(n) for n, f in flags.items()])


def length_of_stay(spark, d):
    return _utilisation(spark, d).select("hadm_id", F.round(vl.fractional_days(F.col("admittime"), F.col("dischtime")), 6).alias("los_days"), F.round(F.log1p(F.col("n_labevents")), 6).alias("log_labs"))


def comorbidity_scores(spark, d):
    return comorbidity.comorbidity_scores(roles.admissions(spark, d), roles.diagnoses(spark, d))


def _sides(spark, d):
    """Admissions that were matched, and all others of the same table, as exposed rows and controls."""
    rows = table(spark, d, "mhh_psychotic_matching_variables").groupBy("hadm_id").agg(
        *[F.min(c).alias(c) for c in ("sex", "insurance_group", "age_at_admission", "elixhauser_score", "quickumls_terms", "embedding")]
    )
    people = rows.select(
        F.col("hadm_id").alias("id"), "sex", "insurance_group", F.col("age_at_admission").alias("age"), matching.age_bin(F.col("age_at_admission")).alias("age_bin"),
        F.col("elixhauser_score").alias("score"), vl.split_terms(F.lower("quickumls_terms")).alias("terms"), "embedding",
    )
    matched = table(spark, d, "matched_pairs").select(F.col("mhh_hadm_id").alias("id")).distinct()
    return people.join(matched, "id", "left_semi"), people.join(matched, "id", "left_anti")


def match_static_candidates(spark, d):
    found = matching.static_candidates(*_sides(spark, d))
    return found.select("exposed_id", "control_id", F.round("cosine", 5).alias("cosine"), F.col("fallback").cast("int").alias("fallback"), F.round("score_difference", 6).alias("score_difference"))


def match_greedy(spark, d):
    return matching.match(*_sides(spark, d)).select("exposed_id", "control_id", F.round("cosine", 5).alias("cosine"), "match_type")


def _modelled(spark, d):
    """Utilisation rows with scaled covariates (PRJ-05) and the subgroup of the admission's complaint."""
    said = combine.stacked_roles(table(spark, d, "matched_pairs").distinct(), {"mhh_": "a", "mhc0_": "b"}, ["pair_id"])
    lower = F.transform(vl.split_terms(F.col("quickumls_terms")), F.lower)
    said = combine.with_subgroups(said.select("hadm_id", F.col("chief_complaint_normalized").alias("t"), vl.expanded_terms(lower).alias("n")), "t", "n")
    groups = said.groupBy("hadm_id").agg(F.min("pure_group").alias("pure_group"), F.min("exclusive_group").alias("exclusive_group"))
    rows = _utilisation(spark, d).join(groups, "hadm_id", "left")
    return rows.withColumns({
        "exposed": (F.col("cohort") != "MHC0").cast("int"), "age10": F.col("age_at_admission") / 10, "score5": F.col("elixhauser_score") / 5,
        "log_prior": F.log1p("prior_admissions_365d"), "long": (F.col("hospital_los_days") > 3).cast("int"), "log_orders": F.log(F.when(F.col("n_orders") > 0, F.col("n_orders"))),
    })


_STRATA = {g: f"pure_group = '{g}'" for g in vocabulary.SUBGROUPS} | {g: f"exclusive_group = '{g}'" for g in vocabulary.COMBINED_SUBGROUPS}


def _grid(spark, d):
    models = stats.adjustment_grid(["n_labevents", "n_orders"], ["hospital_los_days"], "cluster_id")
    return stats.fit_grid(_modelled(spark, d), models, _STRATA)


def regression_grid(spark, d):
    """STA-03 to STA-06: counts and stays by cohort in each adjustment, over all rows and in each complaint subgroup."""
    return _grid(spark, d)


def regression_side_by_side(spark, d):
    pairs = [(f, a) for f in ("poisson_log", "log_ols", "gamma_log") for a in stats.ADJUSTMENTS]
    return stats.side_by_side(_grid(spark, d), "exposed", pairs)


def regression_odds(spark, d):
    """STA-02, STA-03 with an offset, STA-05 with its row guard."""
    models = {
        "long_stay_logistic": stats.Model("binomial", "long", ("exposed",), "cluster_id"),
        "labs_by_order": stats.Model("poisson", "n_labevents", ("exposed",), "cluster_id", offset="log_orders"),
        "orders_ols": stats.Model("gaussian", "n_orders", ("exposed", "age10", "score5"), "cluster_id", least_rows=20, both="exposed"),
    }
    return stats.fit_grid(_modelled(spark, d), models)


def single_predictor_effects(spark, d):
    """STA-02 to STA-04 where they have a closed form: with the cohort alone, the means of both cohorts tell the estimates and the cluster sums their errors."""
    models = {
        "labs|poisson": stats.Model("poisson", "n_labevents", ("exposed",), "cluster_id"), "stay|gamma": stats.Model("gamma", "hospital_los_days", ("exposed",), "cluster_id"),
        "stay|log_ols": stats.Model("gaussian", "hospital_los_days", ("exposed",), "cluster_id", log1p=True),
        "long|binomial": stats.Model("binomial", "long", ("exposed",), "cluster_id"),
    }
    found = stats.fit_grid(_modelled(spark, d), models).where("term = 'exposed'")
    return found.select("model", F.round("estimate", 6).alias("estimate"), F.round("error", 6).alias("error"), "n_rows", "n_clusters")


def cluster_summaries(spark, d):
    return models.cluster_summary(table(spark, d, "chief_complaint_cluster_qc_output").distinct(), "bert_cluster", "cohort", "subject_id")


def cluster_pair_agreement(spark, d):
    rows = table(spark, d, "chief_complaint_cluster_qc_output").select("pair_id", "cohort", "bert_cluster").distinct()
    return models.pair_agreement(rows, "pair_id", "cohort", "bert_cluster")


def phrase_clusters(spark, d):
    rows = table(spark, d, "chief_complaint_cluster_qc_output").select("hadm_id", "chief_complaint_normalized").distinct()
    return models.phrase_clusters(rows, "hadm_id", "chief_complaint_normalized", 20)


def classified_sections(spark, d):
    """UDF-02, JSN-01 to JSN-05: a client's JSON answers read into fields."""
    rows = table(spark, d, "psych_history_llm_input").select("classifier_row_id", "section_text").distinct()
    told = models.classify(rows, "classifier_row_id", "section_text", models.keyword_client)
    fields = told.select("classifier_row_id", vl.classifier_fields(F.col("answer")).alias("f"))
    return fields.select("classifier_row_id", "f.label", "f.mention_type", F.col("f.recovered").cast("int").alias("recovered"))


def streamed_daily_counts(spark, d):
    """A stream over the events' files, run to its end, in the windows of the streaming module; only windows that the watermark has closed come out."""
    path = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = lookback.windowed_counts(rows, "ts", "event_type", "1 day", "1 day")
    writer = counts.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    out = materialize(spark.read.parquet(f"{path}/out").select("event_type", F.to_date("begin").alias("day"), "n"))
    remove(spark, path)
    return out


def described_measures(spark, d):
    return _rounded(sm.described(_utilisation(spark, d), MEASURES))


def largest_differences(spark, d):
    """SRT-02, TOP-01: the pairs whose scores differ most."""
    rows = table(spark, d, "matched_pairs").select("pair_id", (F.col("mhh_elixhauser_score") - F.col("mhc0_elixhauser_score")).alias("difference")).distinct()
    return sm.ordered_by_size(rows, "difference", "pair_id", 25)


def ordered_categories(spark, d):
    """SRT-03: counts of insurance groups with their place in a custom order."""
    counts = _variables(spark, d).groupBy("insurance_group").agg(F.count("*").alias("n"))
    return counts.withColumn("place", sm.category_rank(F.col("insurance_group"), ["medicare", "medicaid", "private", "other", "missing"]))


def round_trips(spark, d):
    """SRC-01, SRC-04, SRC-06 to SRC-10, SNK-01 to SNK-06: matched pairs through each format and back."""
    path = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}"
    rows = table(spark, d, "matched_pairs").select("pair_id", "mhh_chief_complaint_raw", "mhh_sex", "cosine_similarity").distinct()
    writers.write_twins(rows, f"{path}/twins")
    writers.write_jsonl(rows, f"{path}/lines", {"query": "round_trips"})
    writers.write_csv(rows, f"{path}/zipped", compression="gzip")
    rows.createOrReplaceTempView("round_trip_pairs")
    parts = {
        "parquet": readers.resolve(spark, f"{path}", "twins"), "csv": readers.read_csv(spark, f"{path}/twins.csv", rows.schema),
        "gzip": readers.read_csv(spark, f"{path}/zipped", rows.schema, partitions=4), "json_lines": readers.read_jsonl(spark, f"{path}/lines", rows.schema),
        "view": readers.lower_names(spark.table("round_trip_pairs")),
    }
    both = readers.union_tagged(parts, "source").where("mhh_chief_complaint_raw <> '' or mhh_chief_complaint_raw is null")
    out = materialize(both.select("source", "pair_id", F.length("mhh_chief_complaint_raw").cast("long").alias("n_characters"), "mhh_sex", F.round("cosine_similarity", 6).alias("cosine")))
    remove(spark, path)
    return out


def group_by_all(spark, d):
    """AGG-07, SRC-07: a registered frame grouped by all that isn't aggregated, and by ordinals."""
    _variables(spark, d).createOrReplaceTempView("group_by_all_variables")
    every = spark.sql("select sex, insurance_group, count(*) as n, avg(elixhauser_score) as mean_score from group_by_all_variables group by all")
    ordinal = spark.sql("select sex, insurance_group, max(age_at_admission) as oldest from group_by_all_variables group by 1, 2")
    return _rounded(every.join(ordinal, every["sex"].eqNullSafe(ordinal["sex"]) & every["insurance_group"].eqNullSafe(ordinal["insurance_group"])).select(every["*"], ordinal["oldest"]))


def terms_by_group(spark, d):
    """AGG-09: the concepts of each age bin of cases, each once, in order."""
    rows = table(spark, d, "matched_pairs").select("mhh_age_bin", "mhh_quickumls_terms").distinct()
    return rows.groupBy("mhh_age_bin").agg(vl.joined_terms(F.col("mhh_quickumls_terms")).alias("terms"))


def pilot_admissions(spark, d):
    """TOP-03: all sections of the first ten admissions."""
    rows = table(spark, d, "psych_history_llm_input").select("classifier_row_id", "hadm_id", "subject_id").distinct()
    return combine.first_entities(rows, "hadm_id", [F.col("subject_id"), F.col("hadm_id")], 10)


def checked_merge(spark, d):
    """JON-08, QA-02, MTH-01, MTH-04: utilisation rows with their matching variables, one to one after a check, with rates."""
    left = _utilisation(spark, d).select("hadm_id", "cohort", "n_labevents", "n_orders", "hospital_los_days").dropDuplicates(["hadm_id"])
    right = _variables(spark, d).groupBy("hadm_id").agg(F.max("elixhauser_score").alias("score"))
    rows = combine.merge_checked(left, right, ["hadm_id"], "left", "one_to_one")
    rows = combine.require_columns(rows, ["score", "n_orders"])
    return rows.groupBy("cohort").agg(
        F.round(sm.guarded_percent(F.count("score"), F.count("*")), 6).alias("pct_with_score"),
        F.round(vl.rate_per_year(F.sum("n_orders"), F.sum("hospital_los_days")), 6).alias("orders_per_year"),
    )


def cluster_tables(spark, d):
    """MLC-04: rows of each cohort, their share and the commonest complaints of each cluster."""
    rows = table(spark, d, "chief_complaint_cluster_qc_output").distinct()
    return models.cluster_table(rows, "bert_cluster", "cohort", ["MHH1_psychotic", "MHC0"], "chief_complaint_normalized", 3)


_QUERIES = [
    streamed_daily_counts, cluster_summaries, cluster_pair_agreement, phrase_clusters, classified_sections,
    cohort_numeric_summary, cohort_categorical_balance, overall_beside_groups, admissions_per_subject_hist, interval_buckets, age_bin_cut_all_bins,
    matched_pair_smd, stacked_pairs, topn_codes_per_group, event_counts_zero_filled, label_crosstab, pivot_rates, collapsed_insurance, insurance_category,
    share_of_group, adjusted_p_values, label_agreement_outer, resume_missing_rows, key_differences, preferred_source_merge, last_written_rows,
    chunk_label_collapse, death_window_flags, length_of_stay, comorbidity_scores, match_static_candidates, match_greedy, regression_grid, regression_side_by_side,
    regression_odds, single_predictor_effects, described_measures, group_by_all, terms_by_group, pilot_admissions,
    checked_merge, cluster_tables, largest_differences, ordered_categories, round_trips,
]
QUERIES = {f.__name__: f for f in _QUERIES}

_WITH = "with " + roles.SQL.strip()
_U = "u as (select distinct * from utilization_readmission_adjusted_model_dataset)"
_V = "v as (select distinct * exclude (embedding) from mhh_psychotic_matching_variables)"
_UNPIVOTED = " union all ".join(f"select cohort, '{m}' as measure, {m}::double as x from u" for m in MEASURES)
_P = "p as (select distinct * from matched_pairs)"
_STACK = """s as (select pair_id, 'case' as role, mhh_subject_id as subject_id, mhh_hadm_id as hadm_id, mhh_age_bin as age_bin, mhh_age_at_admission as age_at_admission,
    mhh_elixhauser_score as elixhauser_score from p union all
  select pair_id, 'control', mhc0_subject_id, mhc0_hadm_id, mhc0_age_bin, mhc0_age_at_admission, mhc0_elixhauser_score from p)"""


def _bins(source: str, value: str, edges: list, labels: list[str], right: bool) -> str:
    cases = []
    for i, label in enumerate(labels):
        low = f"{value} {'>=' if not right or i == 0 else '>'} {edges[i]}"
        cases.append(f"when {low} and {value} {'<=' if right else '<'} {edges[i + 1]} then '{label}'")
    names = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    return f"""c as (select case {" ".join(cases)} end as bin, count(*) as n from {source} group by 1),
b(bin_order, bin) as (values {names}) select b.bin_order::bigint as bin_order, b.bin, coalesce(c.n, 0) as n from b left join c on c.bin = b.bin"""


_SIDES = """r as (select hadm_id as id, min(sex) as sex, min(insurance_group) as ig, min(age_at_admission) as age, min(elixhauser_score) as score, min(quickumls_terms) as terms,
    min(embedding) as e from mhh_psychotic_matching_variables group by 1),
b as (select *, case when age between 18 and 29 then 0 when age between 30 and 79 then age // 10 - 2 when age between 80 and 120 then 6 end as bin,
  list_filter(list_transform(string_split(coalesce(lower(terms), ''), '|'), lambda x: trim(x)), lambda x: x <> '') as t from r),
w as (select *, list_distinct(list_concat(t, flatten(list_transform(t, lambda x: list_transform(string_split(regexp_replace(x, '^negated:', ''), ' '),
    lambda y: case when starts_with(x, 'negated:') then 'negated:' || y else y end))))) as words, id in (select mhh_hadm_id from matched_pairs) as exposed from b),
v as (select * from w where sex is not null and ig is not null and bin is not null and score is not null and e is not null and list_inner_product(e::double[], e::double[]) > 0),
p as (select e.id as exposed_id, c.id as control_id, round(list_cosine_similarity(e.e::double[], c.e::double[]), 9) as cosine, abs(e.score - c.score) as score_difference,
    abs(e.age - c.age)::double as age_difference, e.bin = c.bin as same_bin, c.bin, e.sex, e.ig, e.score as exposed_score,
    len(list_intersect(e.words, c.words)) > 0 and len(list_intersect(e.words, c.words)) >= 0.2::double * len(list_distinct(list_concat(e.words, c.words))) as screened
  from v e join v c on e.exposed and not c.exposed and e.sex = c.sex and e.ig = c.ig and abs(e.bin - c.bin) <= 1 and len(e.e) = len(c.e)),
f as (select *, not max(screened) over (partition by exposed_id) as fallback from p),
k as (select *, cosine > case when fallback then 0.93 else 0.90 end as enough from f where screened or fallback
  qualify row_number() over (partition by exposed_id, bin order by cosine desc, control_id) <= 100)"""
# Each step of the recursion takes the next exposed row of every block and the controls that are still free.
_GREEDY = f"""with recursive {_SIDES},
pool as (select exposed_id, count(*) as pool_size from p group by 1),
lists as (select k.exposed_id, any_value(k.sex || '|' || k.ig) as block, any_value(pool_size) as pool_size, any_value(exposed_score) as s,
    list({{'bad': case when score_difference <= 2 then 0 when score_difference <= 5 then 1 else 2 end, 'cosine': cosine, 'age': age_difference, 'other': not same_bin,
      'near': -cosine, 'score': score_difference, 'control': control_id, 'enough': enough}}) as l from k join pool using (exposed_id) group by 1),
steps as (select *, row_number() over (partition by block order by pool_size, s desc nulls last, exposed_id) as step from lists),
g as (select block, 0::bigint as step, null::bigint as exposed_id, null::bigint as control_id, null::double as cosine, ''::varchar as match_type, []::bigint[] as used
    from (select distinct block from steps)
  union all
  select block, step, exposed_id, pick.control, pick.cosine, case when pick.bad = 0 then 'strict' when pick.bad = 1 then 'relaxed' when len(near) > 0 then 'elixhauser_caliper'
      when len(free) > 0 then 'below_similarity_threshold' else 'no_available_controls' end, case when pick.control is null then used else list_append(used, pick.control) end
  from (select *, list_sort(list_transform(list_filter(fit, lambda x: x.cosine >= list_max(list_transform(fit, lambda y: y.cosine)) - 0.01::double),
      lambda x: {{'age': x.age, 'other': x.other, 'near': x.near, 'score': x.score, 'control': x.control, 'cosine': x.cosine, 'bad': x.bad}}))[1] as pick
    from (select *, case when len(list_filter(near, lambda x: x.bad = 0)) > 0 then list_filter(near, lambda x: x.bad = 0) else list_filter(near, lambda x: x.bad = 1) end as fit
      from (select *, list_filter(free, lambda x: x.enough) as near
        from (select s.block, s.step, s.exposed_id, g.used, list_filter(s.l, lambda x: not list_contains(g.used, x.control)) as free
          from g join steps s on s.block = g.block and s.step = g.step + 1)))))
select w.id as exposed_id, g.control_id, round(g.cosine, 5) as cosine, coalesce(g.match_type, case when v.id is null then 'incomplete_row'
  else 'no_same_sex_insurance_nearby_age_bin_candidates' end) as match_type from w left join v on v.id = w.id left join g on g.exposed_id = w.id where w.exposed"""
_ROWS = "s as (select case when cohort <> 'MHC0' then 1 else 0 end as x, cluster_id as g, n_labevents::double as labs, hospital_los_days as stay from u where cohort is not null and cluster_id is not null)"
# With one yes-no predictor a model's fitted values are the means of both groups, so that a cluster's scores are sums of differences from these.
_SINGLE = f"""with {_U}, {_ROWS},
l as (select 'labs|poisson' as model, x, g, labs as y, 1 as kind from s where labs is not null union all select 'stay|gamma', x, g, stay, 2 from s where stay > 0
  union all select 'stay|log_ols', x, g, ln(1 + stay), 3 from s where stay >= 0 union all select 'long|binomial', x, g, (stay > 3)::int, 4 from s where stay is not null),
m as (select model, x, any_value(kind) as kind, count(*) as n, avg(y) as mean from l group by 1, 2),
i as (select *, case kind when 1 then n * mean when 2 then n when 3 then n else n * mean * (1 - mean) end as info from m),
c as (select l.model, l.x, l.g, sum(case i.kind when 2 then (y - mean) / mean else y - mean end) / any_value(info) as d from l join i on i.model = l.model and i.x = l.x group by 1, 2, 3),
d as (select model, g, sum(case x when 1 then d else -d end) as d from c group by 1, 2),
q as (select model, sum(d * d) as v, count(*) as n_clusters from d group by 1),
t as (select model, any_value(kind) as kind, sum(n)::bigint as n_rows, max(mean) filter (where x = 1) as m1, max(mean) filter (where x = 0) as m0 from m group by 1)
select model, round(case kind when 3 then m1 - m0 when 4 then ln(m1 / (1 - m1)) - ln(m0 / (1 - m0)) else ln(m1 / m0) end, 6) as estimate,
  round(sqrt(v * n_clusters / (n_clusters - 1.0::double) * (n_rows - 1.0::double) / (n_rows - 2.0::double)), 6) as error, n_rows, n_clusters from t join q using (model)"""

SQL = {
    "streamed_daily_counts": """select event_type, ts::date as day, count(*) as n from events
where ts::date + interval 1 day <= (select max(ts) from events) - interval 2 days group by 1, 2""",
    "cluster_summaries": """with q as (select distinct * from chief_complaint_cluster_qc_output) select bert_cluster, count(*) as n_rows,
  count(distinct subject_id) as n_subjects, count(distinct cohort) as n_cohorts, (bert_cluster = -1)::int as is_noise from q group by 1""",
    "cluster_pair_agreement": """with q as (select distinct pair_id, cohort, bert_cluster from chief_complaint_cluster_qc_output),
w as (select pair_id, count(distinct cohort) as roles, min(bert_cluster) as low, max(bert_cluster) as high from q group by 1)
select count(*) as n_pairs, count(*) filter (where low = high and low <> -1) as n_same, count(*) filter (where low = -1) as n_with_noise
from w where roles = 2 and low is not null""",
    "classified_sections": """select distinct classifier_row_id, case when section_text is null then null when regexp_matches(lower(section_text), 'psych|mania') then 'positive' else 'negative' end as label,
  case when section_text is null then null when regexp_matches(lower(section_text), 'psych|mania') then 'current_context' else 'none' end as mention_type,
  case when section_text is null then null else (contains(lower(section_text), 'mood') and not regexp_matches(lower(section_text), 'psych|mania'))::int end as recovered
from psych_history_llm_input""",
    "cohort_numeric_summary": f"""with {_U}, l as ({_UNPIVOTED})
select cohort, measure, count(*) as n, round(avg(x), 10) as mean, round(stddev_samp(x), 10) as sd, round(quantile_cont(x, 0.5), 10) as median,
  round(quantile_cont(x, 0.25), 10) as q1, round(quantile_cont(x, 0.75), 10) as q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 10) as iqr,
  round(min(x), 10) as min, round(max(x), 10) as max, count(*) filter (where x > 0) as n_positive,
  round(100.0::double * count(*) filter (where x > 0) / count(*), 10) as pct_positive from l where x is not null group by 1, 2""",
    "cohort_categorical_balance": f"""with {_V}, l as (select cohort, 'sex' as variable, sex as level from v union all select cohort, 'insurance_group', insurance_group from v
  union all select cohort, 'chief_complaint_normalized', chief_complaint_normalized from v),
c as (select cohort, variable, case when trim(coalesce(level, '')) = '' then 'missing' else level end as level, count(*) as n from l group by 1, 2, 3)
select *, 100.0::double * n / sum(n) over (partition by cohort, variable) as pct from c""",
    "overall_beside_groups": f"""with {_U} select case when grouping(cohort) = 1 then 'overall' else cohort end as cohort, count(*) as n,
  count(distinct subject_id) as n_subjects, sum(n_labevents)::bigint as n_labs from u group by rollup(cohort)""",
    "admissions_per_subject_hist": "with c as (select o_custkey, count(*) as n_rows from orders group by 1) select n_rows, count(*) as n_entities from c group by 1",
    "interval_buckets": _WITH
    + """, h as (select date_diff('day', lag(dischtime) over (partition by subject_id order by admittime, hadm_id), admittime) as x from admissions),
k as (select * from h where x is not null), """
    + _bins("k", "x", [-10, 0, 30, 90, 365, 100000], ["none", "30d", "90d", "365d", "more"], True),
    "age_bin_cut_all_bins": f"with {_V}, "
    + _bins("v", "age_at_admission", [0, 18, 30, 40, 50, 60, 70, 80, 90, 130, 150], ["<18", "18-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90+", "none"], False),
    "matched_pair_smd": f"""with {_P}, {_STACK}, l as (select role, 'age_at_admission' as measure, age_at_admission::double as x from s
  union all select role, 'elixhauser_score', elixhauser_score from s),
m as (select measure, avg(x) filter (where role = 'case') as mean_1, avg(x) filter (where role = 'control') as mean_2,
  sqrt((var_samp(x) filter (where role = 'case') + var_samp(x) filter (where role = 'control')) / 2) as sd from l group by 1)
select measure, round(mean_1, 10) as mean_1, round(mean_2, 10) as mean_2, case when sd > 0 then round((mean_1 - mean_2) / sd, 10) end as smd from m""",
    "stacked_pairs": f"with {_P}, {_STACK} select pair_id, role, subject_id, hadm_id, age_bin from s",
    "topn_codes_per_group": _WITH
    + """, c as (select icd_version, icd_code, count(distinct hadm_id) as n_admissions from diagnoses group by 1, 2),
r as (select *, row_number() over (partition by icd_version order by n_admissions desc, icd_code) as rank from c) select * from r where rank <= 10""",
    "event_counts_zero_filled": "select c.c_custkey as user_id, "
    + ", ".join(f"count(*) filter (where e.event_type = '{k}') as n_{k}" for k in ("click", "error", "purchase", "signup", "view"))
    + " from customer c left join events e on e.user_id = c.c_custkey group by 1",
    "label_crosstab": """with q as (select distinct * from chief_complaint_cluster_qc_output), k as (select * from q where cohort is not null and bert_cluster is not null),
c as (select cohort, bert_cluster, count(*) as n from k group by 1, 2)
select a.cohort, b.bert_cluster, coalesce(c.n, 0) as n from (select distinct cohort from k) a cross join (select distinct bert_cluster from k) b
left join c on c.cohort = a.cohort and c.bert_cluster = b.bert_cluster""",
    "pivot_rates": f"""with {_V}, w as (select insurance_group, coalesce(avg(elixhauser_score) filter (where sex = 'F'), 0)::double as value_1,
  coalesce(avg(elixhauser_score) filter (where sex = 'M'), 0)::double as value_2 from v group by 1)
select *, value_1 - value_2 as difference, case when value_2 <> 0 then value_1 / value_2 end as ratio from w""",
    "collapsed_insurance": f"""with {_V} select subject_id, case count(distinct nullif(trim(insurance_group), '')) when 0 then 'missing'
  when 1 then max(insurance_group) filter (where trim(insurance_group) <> '') else 'multiple_values' end as insurance_group from v group by 1""",
    "insurance_category": f"""with {_V} select case when trim(coalesce(insurance, '')) = '' then 'missing'
  when regexp_matches(upper(insurance), 'MEDICARE|MEDICAID|GOV') then 'public' when regexp_matches(upper(insurance), 'PRIV|COMM') then 'private'
  when regexp_matches(upper(insurance), 'SELF|NO CHARGE|UNINSURED') then 'none' else 'other' end as category, count(*) as n from v group by 1""",
    "share_of_group": f"with {_V}, c as (select sex, insurance_group, count(*) as n from v group by 1, 2) select *, n::double / sum(n) over (partition by sex) as share from c",
    "adjusted_p_values": """
with m as (select l_returnflag, l_suppkey, round(abs(avg(l_discount) - 0.05::double) * 10, 6) as p from lineitem group by 1, 2),
r as (select *, row_number() over (partition by l_returnflag order by p, l_suppkey) as r, count(*) over (partition by l_returnflag) as m from m)
select l_returnflag, l_suppkey, p, least(1.0::double, min(p * m / r) over (partition by l_returnflag order by r rows between current row and unbounded following)) as p_adjusted from r""",
    "label_agreement_outer": """with a as (select distinct mhh_hadm_id as hadm_id, match_type from matched_pairs),
b as (select distinct hadm_id, bert_cluster from chief_complaint_cluster_qc_output)
select case when a.hadm_id is null then 'right_only' when b.hadm_id is null then 'left_only' else 'both' end as source, count(*) as n
from a full join b on a.hadm_id = b.hadm_id group by 1""",
    "resume_missing_rows": """select distinct classifier_row_id, hadm_id from psych_history_llm_input
where hadm_id not in (select hadm_id from psych_history_llm_input where n_psych_keyword_hits >= 3 and hadm_id is not null)""",
    "key_differences": """with a as (select distinct hadm_id from possible_overshadowing_admissions_psychiatric),
b as (select distinct hadm_id from base_admissions_mhc_subject_groups where mhc = 1)
select hadm_id, 'missing' as status from a where hadm_id not in (select hadm_id from b) union all
select hadm_id, 'unexpected' from b where hadm_id not in (select hadm_id from a)""",
    "preferred_source_merge": """with s as (select hadm_id, has_prior_psychiatric_history, 'new' as source from possible_overshadowing_admissions_psychiatric
  union all select hadm_id, has_prior_psychiatric_history, 'old' from base_admissions_mhc_subject_groups)
select * from s qualify row_number() over (partition by hadm_id order by source, has_prior_psychiatric_history nulls first) = 1""",
    "last_written_rows": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "chunk_label_collapse": """with r as (select distinct classifier_row_id, hadm_id, n_psych_keyword_hits as n from psych_history_llm_input),
l as (select *, case when n >= 4 then 'positive' when n >= 2 then 'unclear' else 'negative' end as label, case when n >= 4 then 1 when n >= 2 then 2 else 3 end as p from r)
select hadm_id, arg_min(label, p) as label, min(classifier_row_id) filter (where p = m) as first_classifier_row_id, count(*) as n_chunks,
  count(*) filter (where p = 1) as n_positive, count(*) filter (where p = 2) as n_unclear, count(*) filter (where p = 3) as n_negative
from (select *, min(p) over (partition by hadm_id) as m from l) group by 1""",
    "death_window_flags": _WITH
    + """, x as (select *, case when hadm_id % 3 = 0 then dischtime + to_days((hadm_id % 400)::int - 5) end as dod from admissions)
select hadm_id, (hadm_id % 11 = 0)::int as died_in_hospital, coalesce(dod >= admittime and dod <= admittime + interval 365 days, false)::int as death_within_1y_after_admission,
  (coalesce(dod > dischtime and dod <= dischtime + interval 365 days, false) and hadm_id % 11 <> 0)::int as post_discharge_death_within_1y from x""",
    "length_of_stay": f"""with {_U}, l as (select hadm_id, (epoch_us(dischtime) - epoch_us(admittime)) / 86400000000.0::double as x, n_labevents from u)
select hadm_id, case when x >= 0 then round(x, 6) end as los_days, round(ln(1 + n_labevents), 6) as log_labs from l""",
    "comorbidity_scores": _WITH + ", " + GROUPS_SQL,
    "match_static_candidates": f"""with {_SIDES}
select exposed_id, control_id, round(cosine, 5) as cosine, fallback::int as fallback, round(score_difference, 6) as score_difference from k where enough""",
    "match_greedy": _GREEDY,
    "single_predictor_effects": _SINGLE,
    "described_measures": f"""with {_U}, l as ({_UNPIVOTED})
select measure, count(*) as count, round(avg(x), 10) as mean, round(stddev_samp(x), 10) as sd, round(min(x), 10) as min, round(quantile_cont(x, 0.25), 10) as p25,
  round(quantile_cont(x, 0.5), 10) as p50, round(quantile_cont(x, 0.75), 10) as p75, round(max(x), 10) as max from l where x is not null group by 1""",
    "group_by_all": f"""with {_V} select sex, insurance_group, count(*) as n, round(avg(elixhauser_score), 10) as mean_score, max(age_at_admission) as oldest from v group by 1, 2""",
    "terms_by_group": """with r as (select distinct mhh_age_bin, mhh_quickumls_terms as t from matched_pairs),
e as (select mhh_age_bin, trim(unnest(string_split(t, '|'))) as x from r where t is not null), k as (select mhh_age_bin, string_agg(distinct x, ' | ' order by x) as terms from e where x <> '' group by 1)
select b.mhh_age_bin, coalesce(k.terms, '') as terms from (select distinct mhh_age_bin from r) b left join k on k.mhh_age_bin is not distinct from b.mhh_age_bin""",
    "pilot_admissions": """with r as (select distinct classifier_row_id, hadm_id, subject_id from psych_history_llm_input),
f as (select hadm_id, min((subject_id, hadm_id)) as o from r group by 1 order by 2, 1 limit 10) select r.* from r join f using (hadm_id)""",
    "checked_merge": f"""with {_U}, {_V}, l as (select hadm_id, any_value(cohort) as cohort, any_value(n_orders) as n_orders, any_value(hospital_los_days) as los from u group by 1),
s as (select hadm_id, max(elixhauser_score) as score from v group by 1)
select cohort, round(100.0::double * count(score) / count(*), 6) as pct_with_score, round(sum(n_orders) / (sum(los) / 365.25::double), 6) as orders_per_year from l left join s using (hadm_id) group by 1""",
    "cluster_tables": """with q as (select distinct * from chief_complaint_cluster_qc_output),
c as (select bert_cluster, coalesce(chief_complaint_normalized, '') as t, count(*) as n from q group by 1, 2),
r as (select *, row_number() over (partition by bert_cluster order by n desc, t) as r from c where t <> ''),
t as (select bert_cluster, string_agg(t || ' (' || n || ')', ' | ' order by r) as frequent from r where r <= 3 group by 1)
select q.bert_cluster, count(*) as n_rows, count(*) filter (where cohort = 'MHH1_psychotic') as n_MHH1_psychotic, count(*) filter (where cohort = 'MHC0') as n_MHC0,
  100.0::double * count(*) filter (where cohort = 'MHH1_psychotic') / count(*) as pct_MHH1_psychotic, (q.bert_cluster = -1)::int as is_noise, coalesce(any_value(t.frequent), '') as frequent
from q left join t on t.bert_cluster is not distinct from q.bert_cluster group by q.bert_cluster""",
    "largest_differences": """with d as (select distinct pair_id, mhh_elixhauser_score - mhc0_elixhauser_score as difference from matched_pairs)
select * from d order by abs(difference) desc nulls last, pair_id limit 25""",
    "ordered_categories": f"""with {_V} select insurance_group, count(*) as n, coalesce(list_position(['medicare', 'medicaid', 'private', 'other', 'missing'], insurance_group) - 1, 5)::bigint as place
from v group by 1""",
    "round_trips": """with p as (select distinct pair_id, mhh_chief_complaint_raw as t, mhh_sex, cosine_similarity as c from matched_pairs)
select s.source, pair_id, length(t) as n_characters, mhh_sex, round(c, 6) as cosine from p cross join (values ('parquet'), ('csv'), ('gzip'), ('json_lines'), ('view')) s(source)
where t <> '' or t is null""",
}
