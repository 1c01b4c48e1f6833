"""Tables that go with a matched cohort (COH-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import history
from cohortloom.operators.cohort import ADMISSION, KEY, code_dimension

WINDOWS = (30, 90, 365)


def with_history(admissions: DataFrame, urgent: Column) -> DataFrame:
    """admissions with each one's order, earlier and previous ones and look-back counts and flags."""
    told = history.admission_history(admissions, urgent)
    counts = history.lookback_counts(admissions, WINDOWS)
    flags = [(F.col(f"n_prior_{d}d") > 0).cast("int").alias(f"has_prior_{d}d") for d in WINDOWS]
    return admissions.join(told, ADMISSION).join(counts.select("*", *flags), ADMISSION)


def matched_descriptors(matched: DataFrame, patients: DataFrame, admissions: DataFrame, urgent: Column) -> DataFrame:
    """One row for each matched admission: the patient's and the admission's columns and its history."""
    return matched.join(patients, "subject_id", "left").join(with_history(admissions, urgent), ADMISSION, "left")


def matched_subject_history(matched: DataFrame, patients: DataFrame, admissions: DataFrame, urgent: Column) -> DataFrame:
    """One row for each cohort and admission of a matched subject, with whether it is itself a matched one."""
    subjects = matched.select(F.col("cohort").alias("matched_cohort"), "subject_id").distinct()
    own = matched.select(F.col("cohort").alias("matched_cohort"), *ADMISSION, F.lit(1).alias("is_matched_cohort_admission")).distinct()
    rows = subjects.join(with_history(admissions, urgent), "subject_id").join(patients, "subject_id", "left")
    return rows.join(own, ["matched_cohort", *ADMISSION], "left").fillna(0, ["is_matched_cohort_admission"])


def matched_events(matched: DataFrame, events: DataFrame, items: DataFrame | None = None, item: str = "itemid", details: DataFrame | None = None, detail: str = "poe_id") -> DataFrame:
    """The events of the matched admissions: with their items' columns if there are any, and a row for each detail."""
    rows = matched.join(events, ADMISSION)
    rows = rows.join(items, item, "left") if items is not None else rows
    return rows.join(details, detail) if details is not None else rows


def matched_diagnoses(matched: DataFrame, diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each diagnosis of the matched admissions with its title and whether it is psychiatric, grey and first."""
    titles = dictionary.select(*KEY, "long_title").distinct().join(code_dimension(dictionary).drop("categories"), KEY)
    rows = matched.join(diagnoses, ADMISSION).join(titles, KEY, "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.select(
        *matched.columns, "seq_num", *KEY, "long_title", flag(F.col("psychiatric")).alias("is_psychiatric_icd"), flag(F.col("grey")).alias("is_grey_zone_physical_icd"),
        flag(F.col("seq_num") == 1).alias("is_primary_diagnosis"),
    )
