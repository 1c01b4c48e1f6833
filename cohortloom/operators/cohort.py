"""Cohorts of admissions by coded diagnoses (COH-01 to COH-18).

Admissions have subject_id, hadm_id and admittime; diagnoses subject_id, hadm_id, seq_num,
icd_version and icd_code; the dictionary icd_version, icd_code and long_title. The dictionary is
classified once, and the diagnoses are read once, into one row of facts for each admission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import rules
from cohortloom.operators import ranges

KEY = ["icd_version", "icd_code"]
ADMISSION = ["subject_id", "hadm_id"]


def code_dimension(dictionary: DataFrame) -> DataFrame:
    """COH-01 to COH-03: icd_version, icd_code, psychiatric, grey and categories of each code, in one pass.

    A code with several titles is what any of them makes it. categories is empty for codes that
    aren't psychiatric and [other] for those of no other category; grey leaves psychiatric titles out.
    """
    version, code, title = (F.col(c) for c in (*KEY, "long_title"))
    tests = {name: rules.by_version(version, code, rule) for name, rule in rules.CATEGORY_RULES.items()}
    tests["suicide_self_harm"] = rules.title_has(title, rules.SELF_HARM_TITLES)
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    told = dictionary.groupBy(KEY).agg(
        F.bool_or(rules.is_psychiatric(version, code, title)).alias("psychiatric"), F.bool_or(rules.is_listed_grey(version, code)).alias("listed"),
        F.bool_or(rules.title_has(title, rules.GREY_TITLES)).alias("titled"), F.array_distinct(F.flatten(F.collect_set(found))).alias("x"),
    )
    own = F.when(~F.col("psychiatric"), F.array().cast("array<string>")).when(F.size("x") == 0, F.array(F.lit("other"))).otherwise(F.col("x"))
    return told.select(*KEY, "psychiatric", (F.col("listed") | (F.col("titled") & ~F.col("psychiatric"))).alias("grey"), own.alias("categories"))


def code_categories(dictionary: DataFrame) -> DataFrame:
    """COH-02: icd_version, icd_code, category; a code may have several, `other` has those without any."""
    return code_dimension(dictionary).select(*KEY, F.explode("categories").alias("category"))


def grey_codes(dictionary: DataFrame) -> DataFrame:
    """COH-03: listed codes of organ damage by alcohol, and titles of poisoning and the like of codes that aren't psychiatric."""
    own = dictionary.select(*KEY, "long_title").distinct().join(code_dimension(dictionary).where("grey"), KEY)
    titled = rules.title_has(F.col("long_title"), rules.GREY_TITLES) & ~F.col("psychiatric")
    return own.where(rules.is_listed_grey(*[F.col(c) for c in KEY]) | titled).select(*KEY, "long_title")


def listed_codes(dictionary: DataFrame, rule: dict[int, rules.CodeRule]) -> DataFrame:
    """COH-14: the dictionary's codes of a list."""
    return dictionary.where(rules.by_version(F.col("icd_version"), F.col("icd_code"), rule)).select(*KEY, "long_title").distinct()


def unlisted_titles(dictionary: DataFrame, rule: dict[int, rules.CodeRule], titles: tuple[str, ...]) -> DataFrame:
    """FLT-06: codes whose title has one of the needles but that a list lacks; a null title has none."""
    seen = rules.by_version(F.col("icd_version"), F.col("icd_code"), rule)
    return dictionary.where(rules.title_has(F.col("long_title"), titles) & ~seen).select(*KEY, "long_title").distinct()


def _bit(name: str) -> int:
    return 1 << rules.CATEGORIES.index(name)


def _mask(names: Column) -> Column:
    """Categories as bits of a number, so that they add up in a hash aggregate."""
    return sum((F.when(F.array_contains(names, n), _bit(n)).otherwise(0) for n in rules.CATEGORIES), F.lit(0))


def category_names(mask: Column) -> Column:
    """The sorted names of a number's categories."""
    each = F.array(*[F.when(mask.bitwiseAND(_bit(n)) != 0, F.lit(n)) for n in sorted(rules.CATEGORIES)])
    return F.filter(each, lambda x: x.isNotNull())


def admission_facts(diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """subject_id, hadm_id and what the codes of an admission say, from one read of the diagnoses.

    plain_first: some first diagnosis is neither psychiatric nor grey; psychiatric_first: some is
    psychiatric; first_category: the first category, in the rules' order, of the first diagnoses;
    same: categories of the further diagnoses, and every: of all, as numbers that category_names reads. Codes the dictionary lacks are plain.
    """
    codes = code_dimension(dictionary).select(*KEY, "psychiatric", "grey", _mask(F.col("categories")).alias("mask"))
    coded = diagnoses.select(*ADMISSION, "seq_num", *KEY).join(codes, KEY, "left")
    first, mask = F.col("seq_num") == 1, F.coalesce("mask", F.lit(0))
    psychiatric, grey = (F.coalesce(c, F.lit(False)) for c in ("psychiatric", "grey"))
    out = coded.groupBy(ADMISSION).agg(
        F.bool_or(first & ~psychiatric & ~grey).alias("plain_first"), F.bool_or(first & psychiatric).alias("psychiatric_first"),
        F.bit_or(F.when(first, mask).otherwise(0)).alias("first"), F.bit_or(F.when(F.col("seq_num") > 1, mask).otherwise(0)).alias("same"), F.bit_or(mask).alias("every"),
    )
    category = F.coalesce(*[F.when(F.col("first").bitwiseAND(_bit(n)) != 0, F.lit(n)) for n in rules.CATEGORIES])
    return out.withColumn("first_category", category).drop("first")


def base_admissions(admissions: DataFrame, notes: DataFrame, diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """COH-04: admissions with a note and a first diagnosis that is neither psychiatric nor grey."""
    return base_of(admissions, notes, admission_facts(diagnoses, dictionary))


def base_of(admissions: DataFrame, notes: DataFrame, facts: DataFrame) -> DataFrame:
    """COH-04 from the facts of the admissions."""
    kept = admissions.select(*ADMISSION, "admittime").join(notes.select(ADMISSION), ADMISSION, "left_semi")
    return kept.join(facts.where("plain_first").select(ADMISSION), ADMISSION, "left_semi").distinct()


def history_categories(base: DataFrame, admissions: DataFrame, facts: DataFrame) -> DataFrame:
    """COH-05, COH-06 and COH-08: base with both flags, mhc and both lists of categories joined by a bar.

    "Some earlier admission had the category" is "its first time is earlier", so that the first time
    of each category, one column for each by subject, replaces the inequality join.
    """
    timed = facts.select(*ADMISSION, "every").where("every <> 0").join(admissions.select(*ADMISSION, "admittime"), ADMISSION)
    times = {n: F.min(F.when(F.col("every").bitwiseAND(_bit(n)) != 0, F.col("admittime"))).alias(f"_{n}") for n in sorted(rules.CATEGORIES)}
    first = timed.groupBy("subject_id").agg(*times.values())
    joined = base.join(facts.select(*ADMISSION, "same"), ADMISSION, "left").join(first, "subject_id", "left")
    prior = F.filter(F.array(*[F.when(F.col(f"_{n}") < F.col("admittime"), F.lit(n)) for n in times]), lambda x: x.isNotNull())
    joined = joined.withColumn("prior", prior).withColumn("same", category_names(F.coalesce("same", F.lit(0))))
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    text = lambda c: F.when(has(c), F.array_join(c, " | "))
    return joined.select(
        *ADMISSION,
        "admittime",
        (has("same") | has("prior")).cast("int").alias("mhc"),
        has("same").cast("int").alias("has_secondary_psychiatric_same_admission"),
        has("prior").cast("int").alias("has_prior_psychiatric_history"),
        text("same").alias("same_admission_psych_categories"),
        text("prior").alias("prior_psych_categories"),
    )


def subject_groups(history: DataFrame) -> DataFrame:
    """COH-07: history with subject_group, from all base admissions of the subject."""
    own = history.groupBy("subject_id").agg(F.max("mhc").alias("most"), F.min("mhc").alias("least"))
    group = F.when(F.col("most") == 0, "only_MHC0").when(F.col("least") == 1, "only_MHC1").otherwise("MHC_0_to_1")
    return history.join(own.select("subject_id", group.alias("subject_group")), "subject_id")


def exposed_only(grouped: DataFrame) -> DataFrame:
    """COH-09: exposed admissions of subjects that have no other."""
    return grouped.where("subject_group = 'only_MHC1' and mhc = 1")


def same_admission_only(grouped: DataFrame) -> DataFrame:
    """COH-10: exposed admissions by their own further diagnoses alone, without history."""
    return exposed_only(grouped).where("has_secondary_psychiatric_same_admission = 1 and has_prior_psychiatric_history = 0")


def with_focus(grouped: DataFrame, column: str, focus: list[str] = rules.FOCUS) -> DataFrame:
    """COH-10 and COH-11: rows whose list of categories in column has one of the focus."""
    return grouped.where(F.arrays_overlap(F.split(F.coalesce(column, F.lit("")), r" \| "), F.array(*map(F.lit, focus))))


def flag_pattern(flags: dict[str, Column], all_name: str = "all_four", none_name: str = "none_of_focus4") -> Column:
    """CND-05: a name for each combination of flags: x_only, x+y, all, none."""
    found = F.filter(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]), lambda x: x.isNotNull())
    some = F.when(F.size(found) == 1, F.concat(found[0], F.lit("_only"))).otherwise(F.array_join(found, "+"))
    return F.when(F.size(found) == 0, none_name).when(F.size(found) == len(flags), all_name).otherwise(some)


def focus_patterns(grouped: DataFrame, column: str) -> DataFrame:
    """Rows with `pattern` of the focus categories and n_categories in a list column."""
    names = F.split(F.coalesce(F.col(column), F.lit("")), r" \| ")
    flags = {name: F.array_contains(names, name) for name in rules.FOCUS}
    count = F.size(F.filter(names, lambda x: x != "")).cast("long")
    return grouped.withColumn("pattern", flag_pattern(flags)).withColumn("n_categories", count)


def primary_category(facts: DataFrame) -> DataFrame:
    """CND-04: subject_id, hadm_id and the first category, in the rules' order, of an admission's first diagnoses."""
    return facts.where("first_category is not null").select(*ADMISSION, F.col("first_category").alias("category"))


def admission_states(admissions: DataFrame, grouped: DataFrame, facts: DataFrame, refined: bool = False) -> DataFrame:
    """COH-13, CND-06: all admissions of mixed subjects with their state."""
    mixed = grouped.where("subject_group = 'MHC_0_to_1'").select("subject_id").distinct()
    base = grouped.select(*ADMISSION, "mhc", "has_secondary_psychiatric_same_admission", "has_prior_psychiatric_history")
    rows = admissions.select(*ADMISSION, "admittime").join(mixed, "subject_id", "left_semi").join(base, ADMISSION, "left")
    rows = rows.join(facts.where("psychiatric_first").select(*ADMISSION, "psychiatric_first"), ADMISSION, "left")
    same, prior = F.col("has_secondary_psychiatric_same_admission"), F.col("has_prior_psychiatric_history")
    if refined:
        state = F.when((same == 0) & (prior == 0), 0).when((same == 1) & (prior == 0), 11).when((same == 0) & (prior == 1), 12).when((same == 1) & (prior == 1), 13)
    else:
        state = F.when(F.col("mhc").isNotNull(), F.col("mhc"))
    state = F.coalesce(state, F.when(F.col("psychiatric_first"), 4), F.lit(9))
    return rows.select(*ADMISSION, "admittime", state.cast("int").alias("admission_state"))


def trajectories(states: DataFrame) -> DataFrame:
    """subject_id, n_admissions, trajectory: states joined in order of time and admission."""
    ordered = F.array_sort(F.collect_list(F.struct("admittime", "hadm_id", "admission_state")))
    out = states.groupBy("subject_id").agg(F.count("*").alias("n_admissions"), ordered.alias("x"))
    return out.select("subject_id", "n_admissions", F.array_join(F.transform("x", lambda s: s["admission_state"].cast("string")), "-").alias("trajectory"))


def reversals(states: DataFrame) -> DataFrame:
    """QA-05: admissions in state 0 after one in state 1 of the same subject; there are none if history is right."""
    order = Window.partitionBy("subject_id").orderBy("admittime").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.coalesce(F.max((F.col("admission_state") == 1).cast("int")).over(order), F.lit(0))
    return states.withColumn("_seen", seen).where("_seen = 1 and admission_state = 0").drop("_seen")


def _least(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The pair of each value of `by` that comes first in an order, nulls last; one aggregate, no sort of whole groups."""
    key = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])
    return rows.groupBy(by).agg(F.min_by("pair_id", key).alias("pair_id")).select("pair_id").distinct()


def first_pairs(rows: DataFrame, role: str, case: str, control: str) -> DataFrame:
    """COH-17: the rows (pair_id, role, subject_id, hadm_id, admittime) of each case subject's first pair with its control.

    Only pairs with exactly one case and one control admission count; of pairs that share a control
    subject the one with the earliest control admission is kept.
    """
    order = ["admittime", "pair_id", "hadm_id"]
    first = rows.join(_least(rows.where(F.col(role) == case), "subject_id", order), "pair_id", "left_semi")
    one = lambda name: F.count_distinct(F.when(F.col(role) == name, F.col("hadm_id"))) == 1
    whole = first.groupBy("pair_id").agg((one(case) & one(control)).alias("whole")).where("whole").select("pair_id")
    kept = first.join(whole, "pair_id", "left_semi")
    return kept.join(_least(kept.where(F.col(role) == control), "subject_id", order), "pair_id", "left_semi")


def cap_loss(rows: DataFrame, pair: str, subject: str, order: list[str], caps: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """COH-18: for each cap on a subject's rows, how many rows and pairs remain, alone and if pairs stay whole."""
    numbered = ranges.counted(ranges.placed(rows, [subject], order), [subject], order).withColumn("n", F.col("_before") + 1)
    worst = Window.partitionBy(pair)
    numbered = numbered.withColumn("worst", F.max("n").over(worst))
    each = numbered.select(pair, "n", "worst", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    kept, whole = F.col("n") <= F.col("cap"), F.col("worst") <= F.col("cap")
    return each.groupBy("cap").agg(
        F.count("*").alias("n_rows"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(whole).alias("n_kept_in_whole_pairs"),
        F.count_distinct(F.when(whole, F.col(pair))).alias("n_whole_pairs"),
    )
