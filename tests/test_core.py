"""Operators on tiny frames: edge cases, brute force and contracts."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text as tx
from cohortloom.functions import values as vl
from cohortloom.functions import vocabulary
from cohortloom import rules, session
from cohortloom.operators import cohort, combine, comorbidity, exports, history, matching, models, stats, summarise
from cohortloom.sources import readers, writers
from cohortloom.streaming import lookback


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Chief Complaint:\nchest pain\n\nHistory of Present Illness:\nx", "chest pain"),
        ("CHIEF COMPLAINT: a\nb\nHPI: c", "a b"),
        ("chief complaint: [] none\n", ""),
        ("nothing", ""),
        (None, ""),
    ],
)
def test_chief_complaint(spark, text, want):
    assert one(spark, tx.chief_complaint(F.col("x")), text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("CC: ___ PCP: ___", ""),
        ("n/v/d", "nausea vomiting diarrhea"),
        ("Don't know & SOB", "do not know and shortness of breath"),
        ("admitted for  s/p Fall, LLE fx", "fall left lower extremity fracture"),
        ("gi bleed", "gastrointestinal bleed"),
        ("N/A", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_normal_complaint(spark, text, want):
    assert one(spark, tx.normal_complaint(F.col("x")), text) == want


def test_sections_keep_order_and_add_up(spark):
    note = "intro\r\nAllergies: none\nunknown label: stays\nPMH:\n___\nHospital Course:\nday one\nALLERGIES:\nnuts ___\n"
    rows = spark.createDataFrame([(1, note), (2, None), (3, ""), (4, "___ \n \n")], "k long, t string")
    found = {(r["k"], r["section"]): r["text"] for r in tx.parse_sections(rows, ["k"], "t").collect()}
    assert found == {
        (1, "unsectioned"): "intro",
        (1, "allergies"): "none unknown label: stays nuts",
        (1, "brief_hospital_course"): "day one",
    }


@pytest.mark.parametrize("n,chunks", [(1, 1), (600, 1), (601, 2), (1125, 2), (1126, 3)])
def test_word_windows_cover_all_words(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " "), (3, None)], "k long, t string")
    parts = tx.word_windows(df, ["k"], "t").orderBy("chunk").collect()
    assert len(parts) == chunks and {r["n_chunks"] for r in parts} == {chunks}
    split = [r["chunk_text"].split() for r in parts]
    assert all(a[-75:] == b[:75] for a, b in zip(split, split[1:])) and split[-1][-1] == words[-1] and all(len(s) <= 600 for s in split)


def test_overlapping_keywords_count_twice(spark):
    counts = tx.keyword_counts(F.col("x"))
    assert one(spark, counts["psychiatry_general"], "Psychiatric history, mental health") == 3
    assert one(spark, counts["bipolar_mania"], None) == 0


def test_json_whole_wrapped_and_cut_off(spark):
    field = vl.json_field(F.col("x"), "label")
    texts = ['{"label": "a"}', 'Sure: {"label": "b"} done', '{"label": "c", "why": "cut', "none", None]
    assert [one(spark, field, t) for t in texts] == ["a", "b", "c", None, None]


def test_values(spark):
    assert one(spark, vl.shortened(F.col("x"), 3, 9), "alpha beta gamma delta") == "alpha"
    assert one(spark, F.array_join(vl.expanded_terms(vl.split_terms(F.col("x"))), ","), "negated:chest pain | cough") == "negated:chest pain,cough,negated:chest,negated:pain"
    assert one(spark, vl.cosine(F.col("x"), F.col("x")), [0.0, 0.0], "array<double>") is None
    assert one(spark, tx.has_phrase(F.col("x"), "low mood"), "A Low  mood .") is True


def test_cut_bounds(spark):
    labels = ["a", "b"]
    right = [one(spark, summarise.cut(F.col("x"), [0, 10, 20], labels), v, "double") for v in (0.0, 10.0, 10.5, 20.0, 20.5, None)]
    left = [one(spark, summarise.cut(F.col("x"), [0, 10, 20], labels, right=False), v, "double") for v in (0.0, 10.0, 20.0)]
    assert right == ["a", "a", "b", "b", None, None] and left == ["a", "b", None]


def test_summaries_of_one_row_and_none(spark):
    df = spark.createDataFrame([("g", 2.0, None), ("h", None, 1.0)], "g string, a double, b double")
    rows = {(r["g"], r["measure"]): r for r in summarise.describe_numbers(df, "g", ["a", "b"]).collect()}
    assert set(rows) == {("g", "a"), ("h", "b")} and rows["g", "a"]["sd"] is None and rows["g", "a"]["median"] == 2.0
    assert summarise.describe_numbers(df.where("false"), "g", ["a"]).count() == 0
    assert one(spark, summarise.guarded_percent(F.lit(1), F.col("x")), 0, "int") == 0.0


def test_contracts_and_provenance(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k long, u string")
    with pytest.raises(combine.ContractError):
        combine.require_columns(a, ["k", "q"])
    with pytest.raises(combine.ContractError):
        combine.merge_checked(a, b, ["k"], validate="one_to_one")
    assert combine.merge_checked(a, b, ["k"], "inner", "one_to_many").count() == 1
    assert {(r["k"], r["_merge"]) for r in combine.outer_with_source(a, b, ["k"]).collect()} == {(1, "left_only"), (2, "both"), (3, "right_only")}
    assert {(r["k"], r["status"]) for r in combine.key_differences(a, b, ["k"]).collect()} == {(1, "missing"), (3, "unexpected")}
    first = combine.prefer([a.withColumn("s", F.lit("a")), b.select("k", F.col("u").alias("v"), F.lit("b").alias("s"))], ["k"], [F.col("v")])
    assert {(r["k"], r["s"]) for r in first.collect()} == {(1, "a"), (2, "a"), (3, "b")}
    assert combine.sampled(spark.range(100).withColumn("g", F.col("id") % 2), "g", "id", 3, 1).count() == 6
    assert combine.first_entities(b, "k", [F.col("k")], 1).count() == 1


def test_labels_collapse_by_priority(spark):
    rows = spark.createDataFrame([(1, 0, "negative"), (1, 1, "positive"), (1, 2, "positive"), (2, 0, "odd"), (2, 1, "negative")], "k long, c long, label string")
    found = {r["k"]: (r["label"], r["first_c"], r["n_chunks"]) for r in combine.collapse_labels(rows, ["k"], "label", "c", ["positive", "negative"]).collect()}
    assert found == {1: ("positive", 1, 3), 2: ("negative", 1, 2)}


def test_history_is_strictly_earlier_and_counts_any_admission(spark):
    t = dt.datetime(2100, 1, 1)
    admissions = spark.createDataFrame([(1, 10, t), (1, 11, t), (1, 12, t + dt.timedelta(days=30)), (2, 20, t)], "subject_id long, hadm_id long, admittime timestamp_ntz")
    diagnoses = spark.createDataFrame(
        [(1, 10, 1, 10, "F200"), (1, 11, 1, 10, "J00"), (1, 12, 1, 10, "J00"), (1, 12, 2, 9, "311"), (2, 20, 1, 9, "311x"), (2, 20, 2, 10, "J00")],
        "subject_id long, hadm_id long, seq_num int, icd_version int, icd_code string",
    )
    codes = [(10, "F200", "a"), (10, "J00", "cold"), (9, "311", "low"), (9, "311x", None), (10, "T50", "poisoning, self-harm"), (10, "K70", None), (9, "F200", None), (10, "T51", "Overdose")]
    dictionary = spark.createDataFrame(codes, "icd_version int, icd_code string, long_title string")
    base = cohort.base_admissions(admissions, admissions, diagnoses, dictionary)
    facts = cohort.admission_facts(diagnoses, dictionary)
    assert sorted(r["hadm_id"] for r in base.collect()) == [11, 12]
    rows = {r["hadm_id"]: r for r in cohort.subject_groups(cohort.history_categories(base, admissions, facts)).collect()}
    assert (rows[11]["mhc"], rows[12]["mhc"], rows[11]["subject_group"]) == (0, 1, "MHC_0_to_1")
    assert (rows[12]["prior_psych_categories"], rows[12]["same_admission_psych_categories"]) == ("psychotic", "internalizing")
    named = {(r["icd_version"], r["icd_code"]): r["category"] for r in cohort.code_categories(dictionary).collect()}
    assert named == {(10, "F200"): "psychotic", (9, "311"): "internalizing", (9, "311x"): "other", (10, "T50"): "suicide_self_harm"}
    assert sorted(r["icd_code"] for r in cohort.grey_codes(dictionary).collect()) == ["K70", "T51"]
    counts = {r["hadm_id"]: (r["n_prior_30d"], r["n_prior_90d"]) for r in history.lookback_counts(admissions).collect()}
    assert counts == {10: (0, 0), 11: (0, 0), 12: (2, 2), 20: (0, 0)}


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("m", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.9])], "m string, i long, p double")
    found = {r["i"]: r["q"] for r in history.adjusted_p_values(df, "m", "p", "i", "q").collect()}
    assert found[3] is None and [round(found[i], 6) for i in (0, 1, 2, 4)] == [0.04, 0.053333, 0.053333, 0.9]


def people(spark, rng, n, first):
    rows = [
        (first + i, rng.choice("FM"), rng.choice("ab"), rng.randint(20, 59), rng.choice([0.0, 2.0, 4.0]), [rng.choice("pqr")], [rng.gauss(0, 1) for _ in range(3)])
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id long, sex string, insurance_group string, age long, score double, terms array<string>, embedding array<double>")
    return rows, df.withColumn("age_bin", F.floor(F.col("age") / 10).cast("int"))


def test_matching_equals_one_sequential_pass(spark):
    rng = random.Random(9)
    rule = matching.MatchRule(nearest=5, least_cosine=0.2, fallback_cosine=0.4)
    (e_rows, e), (c_rows, c) = people(spark, rng, 25, 0), people(spark, rng, 40, 100)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    near = lambda x, y: x[1] == y[1] and x[2] == y[2] and abs(x[3] // 10 - y[3] // 10) <= 1
    pool = {x[0]: [y for y in c_rows if near(x, y)] for x in e_rows}
    used, want = set(), {}
    for x in sorted(e_rows, key=lambda x: (len(pool[x[0]]), -x[4], x[0])):
        screened = [y for y in pool[x[0]] if set(x[5]) & set(y[5])]
        least = rule.least_cosine if screened else rule.fallback_cosine
        kept = []
        for bin_ in {y[3] // 10 for y in pool[x[0]]}:
            own = sorted((y for y in (screened or pool[x[0]]) if y[3] // 10 == bin_), key=lambda y: (-cos(x[6], y[6]), y[0]))
            kept += [y for y in own[: rule.nearest] if cos(x[6], y[6]) > least]
        free = [y for y in kept if y[0] not in used]
        for limit in (rule.strict, rule.relaxed):
            fit = [y for y in free if abs(x[4] - y[4]) <= limit]
            if fit:
                best = max(cos(x[6], y[6]) for y in fit)
                tied = [y for y in fit if cos(x[6], y[6]) >= best - rule.tie]
                want[x[0]] = min(tied, key=lambda y: (abs(x[3] - y[3]), x[3] // 10 != y[3] // 10, -cos(x[6], y[6]), abs(x[4] - y[4]), y[0]))[0]
                used.add(want[x[0]])
                break
    matches = matching.match(e, c, rule)
    assert {r["exposed_id"]: r["control_id"] for r in matches.collect() if r["control_id"] is not None} == want
    assert matches.count() == len(e_rows)
    assert matching.match_faults(matches, e, c, rule).count() == 0


def sandwich(x, y, g, family):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        eta = x @ beta
        mu = {"binomial": 1 / (1 + np.exp(-eta)), "poisson": np.exp(np.clip(eta, -20, 20)), "gaussian": eta}[family]
        w = {"binomial": mu * (1 - mu), "poisson": mu, "gaussian": np.ones_like(mu)}[family]
        beta = beta + np.linalg.solve((x * w[:, None]).T @ x, x.T @ (y - mu))
    scores = np.array([(x[g == k] * (y - mu)[g == k, None]).sum(axis=0) for k in np.unique(g)])
    bread = np.linalg.inv((x * w[:, None]).T @ x)
    groups, (n, k) = len(scores), x.shape
    return beta, np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * groups / (groups - 1) * (n - 1) / (n - k))


def test_gamma_offset_and_guards(spark):
    rng = np.random.default_rng(5)
    a, w, g = rng.integers(0, 2, 200), rng.uniform(1, 9, 200), rng.integers(0, 30, 200)
    y = rng.gamma(2.0, np.exp(0.5 + 0.7 * a) / 2)
    n = rng.poisson(w * np.exp(0.2 + 0.4 * a))
    df = spark.createDataFrame([tuple(map(float, r[:4])) + (int(r[4]), math.log(r[1])) for r in zip(a, w, y, n, g)], "a double, w double, y double, n double, g long, o double")
    # with one yes-no predictor the fitted means are those of both groups, for the offset by exposure
    gamma = stats.fit(df, stats.Model("gamma", "y", ("a",), "g"))
    assert math.isclose(gamma[1]["estimate"], math.log(y[a == 1].mean() / y[a == 0].mean()), rel_tol=1e-6) and gamma[1]["ratio"] > 1
    rate = stats.fit(df, stats.Model("poisson", "n", ("a",), "g", offset="o"))
    assert math.isclose(rate[1]["estimate"], math.log((n[a == 1].sum() / w[a == 1].sum()) / (n[a == 0].sum() / w[a == 0].sum())), rel_tol=1e-6)
    scores = np.array([[((y - m) / m * x)[g == k].sum() for x in (np.ones(200), a)] for m in [np.where(a == 1, y[a == 1].mean(), y[a == 0].mean())] for k in np.unique(g)])
    x = np.column_stack([np.ones(200), a])
    bread, groups = np.linalg.inv(x.T @ x), len(np.unique(g))
    assert math.isclose(gamma[1]["error"], math.sqrt((bread @ scores.T @ scores @ bread)[1, 1] * groups / (groups - 1) * 199 / 198), rel_tol=1e-6)
    guarded = stats.fit_grid(df, {"m": stats.Model("gaussian", "y", ("a",), "g", least_rows=20, both="a")}, {"few": "w < 1.2", "one": "a = 1", "odd": "null"})
    found = {r["stratum"]: r["status"] for r in guarded.collect()}
    assert found == {"overall": "fit_converged", "few": "not_fit_too_few_rows", "one": "not_fit_one_group", "odd": "not_fit_no_complete_rows"}
    grid = stats.fit_grid(df.withColumnRenamed("a", "exposed"), stats.adjustment_grid(["n"], ["y"], "g", {"plain": ("exposed",)}))
    wide = stats.side_by_side(grid, "exposed", [("poisson_log", "plain"), ("gamma_log", "plain"), ("log_ols", "plain")])
    rows = {r["outcome"]: r for r in wide.collect()}
    assert math.isclose(rows["y"]["ratio_gamma_log_plain"], gamma[1]["ratio"], rel_tol=1e-9) and rows["n"]["ratio_gamma_log_plain"] is None


@pytest.mark.parametrize("family", ["binomial", "poisson", "gaussian"])
def test_models_equal_a_plain_sandwich(spark, family):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=120), rng.integers(0, 20, 120)
    y = {"binomial": (rng.random(120) < 1 / (1 + np.exp(-x))).astype(float), "poisson": rng.poisson(np.exp(0.3 * x)).astype(float), "gaussian": 2 * x + rng.normal(size=120)}[family]
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, g)] + [(None, 1.0, 1)], "a double, y double, g long")
    rows = stats.fit(df, stats.Model(family, "y", ("a",), "g"))
    beta, errors = sandwich(np.column_stack([np.ones(120), x]), y, g, family)
    assert [r["status"] for r in rows] == ["fit_converged"] * 2 and rows[0]["n_rows"] == 120
    assert np.allclose([r["estimate"] for r in rows], beta, atol=1e-6) and np.allclose([r["error"] for r in rows], errors, atol=1e-6)


def test_models_that_cannot_be_fit(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 1.0, 2)], "a double, y double, g long")
    assert {r["status"] for r in stats.fit(df, stats.Model("binomial", "y", ("a",), "g"))} == {"not_fit_outcome_has_one_class"}
    assert {r["status"] for r in stats.fit(df.where("false"), stats.Model("poisson", "y", ("a",), "g"))} == {"not_fit_no_complete_rows"}
    same = df.withColumn("a", F.lit(1.0))
    assert {r["status"] for r in stats.fit(same, stats.Model("gaussian", "y", ("a",), "g"))} == {"fit_failed"}


def test_client_is_asked_again(spark):
    def client(text: str) -> str:
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k long, t string")
    found = {r["k"]: (r["answer"], r["error"]) for r in models.classify(df, "k", "t", client, attempts=2, pause=0.01).collect()}
    assert found == {1: ("A", None), 2: (None, "RuntimeError: no"), 3: (None, None)}
    vectors = {r["k"]: r["embedding"] for r in models.embed(df, "k", "t").collect()}
    assert vectors[3] is None and math.isclose(sum(x * x for x in vectors[2]), 1, rel_tol=1e-5)


def test_files_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None)], "k int, t string")
    writers.write_twins(df, f"{tmp_path}/x", texts=["t"])
    writers.write_csv(df, f"{tmp_path}/y.csv")
    writers.write_jsonl(df, f"{tmp_path}/z", {"run": "1"})
    assert sorted(map(tuple, readers.resolve(spark, str(tmp_path), "x").collect())) == sorted(map(tuple, df.collect()), key=str)
    assert readers.resolve(spark, str(tmp_path), "y", df.schema).where("k = 1").first()["t"] == 'a "b", c\nd'
    assert readers.read_jsonl(spark, f"{tmp_path}/z", df.schema).count() == 2
    assert readers.read_csv(spark, f"{tmp_path}/x.csv", df.drop("t").schema).columns == ["k"]
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, str(tmp_path), "nothing")
    assert readers.Settings.from_environment({"COHORTLOOM_LIMIT_ADMISSIONS": "5"}).limit_admissions == 5
    assert readers.coerce(spark.createDataFrame([("1",), ("x",)], "a string"), {"a": "int"}).where("a is null").count() == 1


def test_resumed_classification_skips_what_is_done(spark, tmp_path):
    log = f"{tmp_path}/log"
    label = lambda df: df.withColumn("label", F.lit("x"))
    lookback.classify_remaining(spark.range(3), log, ["id"], label)
    lookback.classify_remaining(spark.range(5), log, ["id"], label)
    assert spark.read.parquet(log).count() == 5
    spark.range(4, 8).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    lookback.classify_stream(stream, log, f"{tmp_path}/state", ["id"], label).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == list(range(8))


# what the reference's lists ask for beyond the queries' data


def test_every_stigmatising_word_counts(spark):
    text = "Uncooperative, unkempt, unmotivated, unwilling; unwillingly adamant. Poor  historian, drug-seeking, NARCOTIC - seeking, in denial."
    counts = {g: one(spark, c, text) for g, c in tx.keyword_counts(F.col("x"), vocabulary.STIGMA).items()}
    assert counts == {"adamant": 1, "compliance": 0, "other": 9}


def test_hits_have_offsets_roots_and_snippets(spark):
    text = "He claims to be angry, and claimed\n poor  historian."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    rows = tx.keyword_hits(df, ["k"], "t", around=5).orderBy("hit_index").collect()
    assert [(r["keyword_group"], r["matched_term"], text[r["match_start"] : r["match_end"]]) for r in rows] == [
        ("adamant", "claim", "claimed"), ("adamant", "claim", "claims"), ("other", "angry", "angry"), ("other", "poor historian", "poor  historian"),
    ]
    assert rows[1]["snippet"] == "He claims to b" and rows[3]["snippet"] == "med poor historian."
    flags = tx.group_flags(tx.keyword_hits(df, ["k"], "t"), ["k"], list(vocabulary.STIGMA)).first()
    assert (flags["has_adamant_keyword"], flags["has_compliance_keyword"]) == (True, False)


def test_headings_with_placeholders_open_sections(spark):
    note = "Chief Complaint ___:\nfall\n ALLERGIES :\n___\nUnit No: 4\n"
    df = spark.createDataFrame([(1, note)], "k long, t string")
    assert {r["section"]: r["text"] for r in tx.parse_sections(df, ["k"], "t").collect()} == {"chief_complaint": "fall", "allergies": "___ Unit No: 4".replace("___ ", "")}
    told = tx.section_report(df, ["k"], "t").first()
    assert told["detected_section_headings"] == "Chief Complaint ___ | ALLERGIES" and told["n_detected_sections"] == 2
    assert '"normalized_heading":"chief complaint"' in told["all_detected_sections_json"]
    missed = {r["heading"]: r["likely"] for r in tx.missed_headings(df, "k", "t").collect()}
    assert missed == {"unit no": 0}


def test_texts_without_end_marks_are_read_by_line(spark):
    df = spark.createDataFrame([(1, "one two\n\tthree  four\r\nfive"), (2, "One. Two!\nThree"), (3, "one two"), (4, " "), (5, "a\n\nb")], "k long, t string")
    found = {r["k"]: r for r in tx.complexity(df, ["k"], "t").collect()}
    assert [found[k]["n_sentences"] for k in range(1, 6)] == [3, 3, 1, 0, 2]
    assert (found[1]["n_nonempty_lines"], found[1]["n_whitespace_words"], found[4]["smog_index"]) == (3, 5, 0.0)


def test_complaints_in_context_and_placeholders(spark):
    assert one(spark, tx.context_complaint(F.col("x")), "CC: Pt can't  walk ;no CP.  ( fever )s/p fall") == "pt cannot walk; no chest pain. fever fall"
    assert one(spark, tx.complaint_tokens(F.col("x")), "n/v 3 days b12") == "n/v | days | b12"
    assert [one(spark, tx.is_placeholder(F.col("x")), t) for t in ("CC: ___", "s/p Unknown", "fall", None)] == [True, True, False, True]
    assert one(spark, tx.normal_complaint(F.col("x")), "ha/sob") == "headache/shortness of breath"


def test_mentions_are_negated_within_five_words(spark):
    told = lambda negated: tx.mention_text(tx.concept_mentions(F.col("x")), negated)
    text = "denies alcohol intoxication or heroin. panic attack; does not a b c feel suicidal and no one two three four five cocaine"
    assert one(spark, told(True), text) == "alcohol intoxication=>intoxication | heroin=>substance_use | suicidal=>suicidal_ideation"
    assert one(spark, told(False), text) == "cocaine=>substance_use | panic attack=>anxiety"
    assert one(spark, told(False), None) is None or one(spark, told(False), None) == ""


def test_subgroups_by_phrase_or_term(spark):
    rows = [(1, "nausea and abd pain", []), (2, "cp", ["dyspnea"]), (3, "chest painful", []), (4, None, None), (5, "fevers", ["x"])]
    df = spark.createDataFrame(rows, "k long, t string, n array<string>")
    found = {r["k"]: r for r in combine.with_subgroups(df, "t", "n").collect()}
    assert found[1]["subgroups"] == "abdominal_pain | nausea_vomiting" and found[1]["pure_group"] is None
    assert found[1]["exclusive_group"] == "abdominal_pain_nausea_vomiting" and found[2]["exclusive_group"] == "chest_pain_shortness_of_breath"
    assert [found[k]["n_subgroups"] for k in (3, 4, 5)] == [0, 0, 0] and found[5]["has_overlap_fever"] == 1


def test_rows_are_numbered_in_order_over_all_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("a"))
    assert all(r["n"] == r["a"] for r in combine.numbered(df, ["a"], "n").collect())
    assert combine.numbered(df.where("a < 0"), ["a"], "n").count() == 0


def test_answers_of_a_classifier(spark):
    fields = vl.classifier_fields(F.col("x"))
    answers = [
        '{"psychiatric_context_label": "Positive", "psychiatric_mention_type": "odd", "evidence_span": "a  b"}',
        'Sure: {"psychiatric_context_integrated": "negative", "integration_type": "management"} ok',
        '{"psychiatric_context_label": "positive", "reason": "cut off he',
        '{"psychiatric_context_label": "neither", "reason": "cut',
        None,
    ]
    found = [one(spark, fields, a) for a in answers]
    assert tuple(found[0])[:3] == ("positive", "current_context", "a b") and tuple(found[1])[:2] == ("negative", "management")
    assert (found[2]["label"], found[2]["reason"], found[2]["recovered"]) == ("positive", "cut off he", True)
    assert found[3] is None and found[4] is None


def test_parents_need_two_texts_and_go_if_covered(spark):
    said = ["left knee pain"] * 3 + ["right knee pain"] * 3 + ["fall"] * 2 + ["fall down"] * 2 + ["of the knee"] * 4
    df = spark.createDataFrame(list(enumerate(said)) + [(99, None), (98, " ")], "k long, t string")
    found = {r["phrase"]: (r["n_exact"], r["n_records"], r["n_texts"]) for r in tx.parent_phrases(df, "k", "t", least=4).collect()}
    assert found == {"knee pain": (0, 6, 2), "fall": (2, 4, 2)}


def test_comorbidity_of_both_versions_and_graver_groups(spark):
    codes = [(1, 10, "i50.1 "), (1, 9, "428"), (1, 10, "I10"), (1, 10, "I119"), (2, 10, "C50"), (2, 10, "C780"), (3, 9, "3051"), (3, 10, None), (4, 10, "E66")]
    diagnoses = spark.createDataFrame(codes, "hadm_id long, icd_version int, icd_code string")
    found = {r["hadm_id"]: tuple(r)[1:] for r in comorbidity.comorbidity_scores(spark.range(1, 6).toDF("hadm_id"), diagnoses).collect()}
    assert found == {
        1: (2, "congestive_heart_failure|hypertension_complicated", 14), 2: (1, "metastatic_cancer", 12), 3: (0, "", 0), 4: (1, "obesity", -4), 5: (0, "", 0),
    }
    assert comorbidity.expanded(("I05-I08", "2500-2503", "V56")) == ["I05", "I06", "I07", "I08", "2500", "2501", "2502", "2503", "V56"]


def test_running_values_of_a_group_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randint(0, 20)}", i, rng.randint(0, 400)) for i in range(600)]
    t = dt.datetime(2100, 1, 1)
    data = [(s, i, t + dt.timedelta(days=d), t + dt.timedelta(days=d + 2), "URGENT" if i % 3 == 0 else "x") for s, i, d in rows]
    df = spark.createDataFrame(data, "subject_id string, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, kind string")
    found = {r["hadm_id"]: r for r in history.admission_history(df, F.col("kind") == "URGENT").collect()}
    counts = {r["hadm_id"]: r["n_prior_30d"] for r in history.lookback_counts(df).collect()}
    for subject in {s for s, *_ in rows}:
        own = sorted((d, i) for s, i, d in rows if s == subject)
        for n, (day, i) in enumerate(own):
            assert (found[i]["admission_order"], found[i]["previous_hadm_id"]) == (n + 1, own[n - 1][1] if n else None)
            assert found[i]["n_prior_urgent"] == sum(j % 3 == 0 for _, j in own[:n]) and found[i]["days_since_first"] == day - own[0][0]
            assert counts[i] == sum(day - 30 <= d < day for d, _ in own)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 301).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0), ("b", None), (None, 1.0), (None, 4.0)], "g string, x double")
    found = {r["g"]: r["q"] for r in summarise.quantiles(df, ["g"], "x", (0.1, 0.25, 0.5)).collect()}
    assert np.allclose(found["a"], np.quantile(x, [0.1, 0.25, 0.5])) and found["b"] == [2.0, 2.0, 2.0] and found[None] == [1.3, 1.75, 2.5]


def test_pairs_need_both_sides_and_the_earliest_control(spark):
    t = lambda d: dt.datetime(2100, 1, d)
    rows = [
        (1, "case", 10, 100, t(5)), (1, "control", 20, 200, t(9)), (2, "case", 10, 101, t(1)), (2, "control", 20, 201, t(8)),
        (3, "case", 11, 102, t(2)), (3, "control", 20, 202, t(7)), (4, "case", 12, 103, None),
    ]
    df = spark.createDataFrame(rows, "pair_id long, role string, subject_id long, hadm_id long, admittime timestamp_ntz")
    assert sorted(r["hadm_id"] for r in cohort.first_pairs(df, "role", "case", "control").collect()) == [102, 202]


def test_matched_exports(spark):
    t = dt.datetime(2100, 1, 1)
    matched = spark.createDataFrame([(1, "case", "A", 7, 70)], "pair_id long, matched_role string, cohort string, subject_id long, hadm_id long")
    admissions = spark.createDataFrame([(7, 69, t, t, "EMER"), (7, 70, t + dt.timedelta(days=9), t, "x"), (8, 80, t, t, "x")], "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, kind string")
    people = spark.createDataFrame([(7, "F")], "subject_id long, sex string")
    row = exports.matched_descriptors(matched, people, admissions, F.col("kind") == "EMER").first()
    assert (row["sex"], row["n_prior"], row["n_prior_urgent"], row["has_prior_30d"], row["previous_hadm_id"]) == ("F", 1, 1, 1, 69)
    told = {r["hadm_id"]: r["is_matched_cohort_admission"] for r in exports.matched_subject_history(matched, people, admissions, F.lit(False)).collect()}
    assert told == {69: 0, 70: 1}
    events = spark.createDataFrame([(7, 70, 1, "p"), (7, 70, 2, "q"), (8, 80, 1, "r")], "subject_id long, hadm_id long, itemid long, poe_id string")
    items, details = spark.createDataFrame([(1, "Na")], "itemid long, label string"), spark.createDataFrame([("p", 1), ("p", 2)], "poe_id string, v long")
    assert {(r["itemid"], r["label"]) for r in exports.matched_events(matched, events, items).collect()} == {(1, "Na"), (2, None)}
    assert exports.matched_events(matched, events, details=details).count() == 2


def test_small_sources_and_contracts(spark):
    a = spark.createDataFrame([(1, "x")], "Key long, B string")
    assert readers.lower_names(a).columns == ["key", "b"]
    both = readers.union_tagged({"one": a, "two": a.drop("B")})
    assert sorted((r["cohort"], r["B"]) for r in both.collect()) == [("one", "x"), ("two", None)]
    assert readers.optional_columns(a, ["Key"], ["B", "C"]).columns == ["Key", "B"]
    a.createOrReplaceTempView("lookup_a")
    assert readers.lookup_rows(spark, ["lookup_a"], {"Key": 1}, ["B"]).first()["B"] == "x"
    assert one(spark, vl.rate_per_year(F.col("x"), F.lit(0)), 3, "long") is None and one(spark, vl.rate_per_year(F.col("x"), F.lit(365.25)), 3, "long") == 3.0
    assert one(spark, vl.lenient_day(F.col("x")), "2100-02-03 04:05:06") == "2100-02-03" and one(spark, vl.lenient_day(F.col("x")), "soon") is None
    assert [one(spark, summarise.category_rank(F.col("x"), ["b", "a"]), v) for v in ("b", "a", "z", None)] == [0, 1, 2, 2]


def test_reversals_and_code_lists(spark):
    t = dt.datetime(2100, 1, 1)
    states = spark.createDataFrame([(1, 1, t, 1), (1, 2, t + dt.timedelta(1), 0), (2, 3, t, 0), (2, 4, t + dt.timedelta(1), 1)], "subject_id long, hadm_id long, admittime timestamp_ntz, admission_state int")
    assert [r["hadm_id"] for r in cohort.reversals(states).collect()] == [2]
    codes = [(10, "F1095", "x"), (10, "F109", "Psychosis"), (10, "F531", None), (9, "2913", "a"), (9, "2980", "Delusions"), (9, "6484", "psycho"), (10, "F061", "b")]
    d = spark.createDataFrame(codes, "icd_version int, icd_code string, long_title string")
    assert {r["icd_code"] for r in cohort.listed_codes(d, rules.PSYCHOSIS_EXTENDED).collect()} == {"F1095", "F531", "2913", "2980", "F061"}
    assert {r["icd_code"] for r in cohort.listed_codes(d, rules.PSYCHOSIS_RESTRICTED).collect()} == {"F531", "2980"}
    assert {r["icd_code"] for r in cohort.unlisted_titles(d, rules.PSYCHOSIS_SEEN, rules.PSYCHOSIS_TITLES).collect()} == {"F109", "2980"}


def test_cut_points_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())
    df = session.materialize(spark.range(3))
    path = next(p for p in session._WRITTEN if p)
    assert df.count() == 3 and readers.exists(spark, path)
    session.release()
    assert not readers.exists(spark, path)


def test_headers_previews_and_vectors_by_row_id(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b", 2.0), (2, "c", None)], "k int, t string, v double")
    writers.write_csv(df, f"{tmp_path}/x", sample=2, order=["k"])
    assert readers.csv_header(spark, f"{tmp_path}/x") == ["k", "t", "v"]
    assert [tuple(r) for r in readers.read_csv_columns(spark, f"{tmp_path}/x", ["t", "zz"]).collect()] == [("a, b",), ("c",)]
    assert readers.preview(df, 1).count() == 1 and readers.preview(df, 5, "k = 2").first()["t"] == "c"
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k int, e array<double>")
    assert [r["e"] for r in readers.with_vectors(df.select("k"), vectors, "k", "e").orderBy("k").collect()] == [[1.0], [2.0]]
    with pytest.raises(Exception, match="out of bounds"):
        readers.with_vectors(df.select((F.col("k") + 1).alias("k")), vectors, "k", "e").collect()


def test_length_profiles_of_all_and_of_non_empty_texts(spark):
    df = spark.createDataFrame([("a", "one two"), ("a", "  "), ("a", None), ("b", None)], "g string, t string")
    found = {r["g"]: r for r in tx.length_profile(df, "g", "t").collect()}
    assert (found["a"]["n_rows"], found["a"]["n_nonempty"], found["a"]["mean_words_nonempty"], found["b"]["mean_words_nonempty"]) == (3, 1, 2.0, 0.0)
    assert found["a"]["mean_characters_all"] == round(7 / 3, 6)
