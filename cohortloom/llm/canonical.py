"""Hand-typed values mapped to the entries of a reference list, or reported as unmatched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import terms
from cohortloom.llm.setjoin import best_matches
from cohortloom.session import materialize


def wordings(values: DataFrame, text: str, reference: DataFrame, key: str, preferred: str, others: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """text and words of every different value, right in spelling, without abbreviations and in the list's preferred words; the list's
    entries (ref and the words of the preferred name, in the same way); its words.

    Null and blank values have no row.
    """
    names = materialize(terms.list_names(reference, key, preferred, others))
    known = names.select(F.explode("name").alias("word")).distinct()
    each = values.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct()
    each = materialize(each.withColumn("words", terms.lookup(terms.words(F.col("text")), terms.ABBREVIATIONS)).where("size(words) > 0"))
    counts = each.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    right = materialize(terms.spelling(counts, known))
    meanings = materialize(terms.synonyms(names))
    said = terms.preferred(terms.correct(each, "text", "words", right), "text", "words", meanings)
    firsts = names.select(F.array_join("first", " ").alias("name"), "first").distinct()
    entries = names.select("ref", F.array_join("first", " ").alias("name")).distinct().join(terms.preferred(firsts, "name", "first", meanings), "name")
    entries = materialize(entries.select("ref", F.array_distinct("first").alias("items")).distinct())
    return said, entries, entries.select(F.explode("items").alias("word")).distinct()


def map_to_list(
    values: DataFrame,
    text: str,
    reference: DataFrame,
    key: str = "ref_id",
    preferred: str = "preferred_term",
    others: str = "entry_terms",
    threshold: float = 0.6,
) -> DataFrame:
    """text, <key> (null if unmatched) and jaccard for every different value of text that isn't null.

    Values and names become sets of the list's own words: misspelt words are put right, synonyms that
    the list tells become the preferred words, and words foreign to the list are left out. The most
    similar entry counts, ties go to the smaller key. Entries without words match nothing; repeated
    rows and names count once; blank values and an empty list leave values unmatched.
    """
    right, entries, vocabulary = wordings(values, text, reference, key, preferred, others)
    said = right.select("text", F.explode(F.array_distinct("words")).alias("word"))
    sets = said.join(vocabulary, "word", "left_semi").groupBy("text").agg(F.collect_set("word").alias("items"))
    found = best_matches(sets.withColumnRenamed("text", "left_id"), entries.withColumnRenamed("ref", "right_id"), threshold)
    every = values.select(F.col(text).alias("left_id")).where(F.col(text).isNotNull()).distinct()
    return every.join(found, "left_id", "left").select(F.col("left_id").alias(text), F.col("right_id").alias(key), "jaccard")
