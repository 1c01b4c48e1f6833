"""Queries for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import canonical, clusters, leakage, quality, readability, splitter, tokenizer, vectors
from cohortloom.session import table


NOTES = splitter.SplitRule(600, 75, "words")
SPANS = splitter.SplitRule(120, 20, "characters")


def _stories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "chief_complaint_cluster_qc_output").select("hadm_id", "chief_complaint_normalized")
    return clusters.cluster_stories(rows, "hadm_id", "chief_complaint_normalized", table(spark, d, "complaint_reference")), rows


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    found, rows = _stories(spark, d)
    return clusters.describe_clusters(found, rows, "hadm_id", "chief_complaint_normalized")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.same_cluster_pairs(_stories(spark, d)[0], "hadm_id")


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "matched_pairs").select("pair_id", "mhh_chief_complaint_normalized").distinct()
    pairs = pairs.where(F.regexp_replace("mhh_chief_complaint_normalized", r"(?U)\s+", "") != "")
    found = canonical.map_to_list(pairs, "mhh_chief_complaint_normalized", table(spark, d, "complaint_reference"))
    return pairs.join(found, "mhh_chief_complaint_normalized").select("pair_id", F.coalesce("ref_id", F.lit(-1)).cast("long").alias("ref_id"), "jaccard")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_entries(spark, d).select("pair_id", "ref_id").distinct()


def p3_grades(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_grade(table(spark, d, "export_mhh_psychotic"), "note_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.demanding_texts(table(spark, d, "export_mhh_psychotic"), "note_id", "text")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    notes = splitter.split_column(table(spark, d, "export_mhh_psychotic").select("note_id", "text").distinct(), "note_id", "text", NOTES)
    spans = table(spark, d, "psych_history_llm_input").select("classifier_row_id", "evidence_span").distinct()
    spans = splitter.split_column(spans, "classifier_row_id", "evidence_span", SPANS)
    parts = [
        x.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("item_key"), "n_pieces", "piece", "begin", "n_units", "piece_text")
        for x, name, key in (
            (notes, "export_mhh_psychotic", "note_id"),
            (spans, "psych_history_llm_input", "classifier_row_id"),
        )
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sources = (("export_mhh_psychotic", "note_id", "text", NOTES), ("psych_history_llm_input", "classifier_row_id", "evidence_span", SPANS))
    parts = []
    for name, key, text, rule in sources:  # repeated rows are told apart by their keys, so that no text is moved for that
        found = splitter.piece_counts(table(spark, d, name), key, text, rule).where("n_pieces > 1")
        parts.append(found.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("item_key")).distinct())
    return parts[0].unionByName(parts[1])


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(table(spark, d, "mhh_psychotic_matching_variables"), "hadm_id", "embedding")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_pairs(table(spark, d, "mhh_psychotic_matching_variables"), "hadm_id", "embedding")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_clusters": p1_clusters,
    "p1_found": p1_found,
    "p2_entries": p2_entries,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_grades": p3_grades,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

#: SQL where it can express a query.
SQL: dict[str, str] = {
    "p5_found": r"""
select distinct 'export_mhh_psychotic' as source_table, note_id as item_key from export_mhh_psychotic where len(regexp_extract_all(text, '[^ \t\r\n]+')) > 600
union select distinct 'psych_history_llm_input', classifier_row_id::varchar from psych_history_llm_input where length(evidence_span) > 120
""",
    "p6_found": """
with e as (select hadm_id as h, min(embedding) as v from mhh_psychotic_matching_variables where embedding is not null group by 1),
u as (select h, v::double[] as v from e where list_inner_product(v::double[], v::double[]) > 0),
s as (select a.h as a, b.h as b, row_number() over (partition by a.h order by round(list_cosine_similarity(a.v, b.v), 9) desc, b.h) as r
  from u a join u b on a.h <> b.h)
select distinct least(a, b) as hadm_id_a, greatest(a, b) as hadm_id_b from s where r <= 5
""",
}
