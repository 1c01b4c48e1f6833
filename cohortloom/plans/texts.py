"""Queries for text operators, on the notes, complaints and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import text as tx
from cohortloom.functions import values as vl
from cohortloom.functions import vocabulary as vo
from cohortloom.operators import combine
from cohortloom.plans.texts_sql import SQL as SQL
from cohortloom.session import spread, table


# The words that no parent phrase of the query begins or ends with.
_STOP = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]


def _notes(spark, d) -> DataFrame:
    return spread(table(spark, d, "export_mhh_psychotic").select("note_id", "text").distinct())


def _documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _sections(spark, d) -> DataFrame:
    return tx.parse_sections(_notes(spark, d), ["note_id"], "text")


def keyword_density(spark, d):
    counts = tx.keyword_counts(F.col("text"))
    words = tx.pattern_count(F.col("text"), r"(?U)\S+")
    rows = _documents(spark, d).select("doc_id", words.alias("n_words"), *[c.alias(g) for g, c in counts.items()])
    hits = sum((F.col(g) for g in counts), F.lit(0)).cast("long")
    rows = rows.withColumn("n_hits", hits).withColumn("hits_per_1000_words", F.when(F.col("n_words") > 0, 1000.0 * hits / F.col("n_words")).otherwise(0.0))
    return rows.withColumn("log_words", F.round(F.when(F.col("n_words") > 0, F.log("n_words")), 6))


def stigma_counts(spark, d):
    counts = tx.keyword_counts(F.col("text"), vo.STIGMA)
    return _documents(spark, d).select("doc_id", *[c.alias(f"n_{g}") for g, c in counts.items()])


def keyword_group_explode(spark, d):
    counts = tx.keyword_counts(F.col("text"))
    rows = _documents(spark, d).select("doc_id", *[c.alias(g) for g, c in counts.items()])
    long = rows.unpivot(["doc_id"], list(counts), "keyword_group", "hits").where("hits > 0")
    return long.groupBy("keyword_group").agg(F.sum("hits").alias("n_hits"), F.count("*").alias("n_documents"))


def keyword_hits(spark, d):
    """TXT-10 on the sections of the notes."""
    return tx.keyword_hits(_sections(spark, d), ["note_id", "section"], "text")


def keyword_flags(spark, d):
    hits = tx.keyword_hits(_sections(spark, d), ["note_id", "section"], "text")
    return tx.group_flags(hits, ["note_id"], list(vo.STIGMA))


def note_sections(spark, d):
    return _sections(spark, d).select("note_id", "section", "text")


def section_report(spark, d):
    return tx.section_report(_notes(spark, d), ["note_id"], "text")


def section_length_profile(spark, d):
    return _sections(spark, d).groupBy("section").agg(F.count("*").alias("n_notes"), F.sum(F.length("text")).alias("n_characters"), F.sum(tx.pattern_count(F.col("text"), r"(?U)\S+")).alias("n_words"))


def length_profile(spark, d):
    return tx.length_profile(spread(table(spark, d, "documents").select("source", "text")), "source", "text")


def classifier_input(spark, d):
    """RSH-01, FLT-08, FLT-11: chosen sections from wide to long, blank ones dropped, with their lengths and hits (0 without any)."""
    chosen = ["present_illness", "brief_hospital_course", "discharge_condition", "discharge_instructions"]
    wide = _sections(spark, d).groupBy("note_id").agg(*[F.max(F.when(F.col("section") == c, F.col("text"))).alias(c) for c in chosen])
    cells = F.array(*[F.struct(F.lit(c).alias("section_name"), F.col(c).alias("section_text")) for c in chosen])  # unpivot's code doesn't compile here
    long = wide.select("note_id", F.explode(cells).alias("x")).select("note_id", "x.*").where(tx.strip(F.coalesce("section_text", F.lit(""))) != "")
    hits = sum(tx.keyword_counts(F.col("section_text"), vo.STIGMA).values(), F.lit(0)).cast("long")
    return long.select(
        "note_id", "section_name", tx.pattern_count(F.col("section_text"), r"(?U)\S+").alias("section_word_count"),
        F.length("section_text").cast("long").alias("section_char_length"), hits.alias("n_keyword_hits"), (hits > 0).cast("int").alias("has_sl_keyword_hit"),
    )


def chief_complaints(spark, d):
    return _notes(spark, d).select("note_id", tx.chief_complaint(F.col("text")).alias("chief_complaint"))


def _complaints(spark, d) -> DataFrame:
    return table(spark, d, "matched_pairs").select("pair_id", F.col("mhh_chief_complaint_raw").alias("raw"), F.col("mhh_quickumls_terms").alias("terms")).distinct()


def text_normalise(spark, d):
    return _complaints(spark, d).select("pair_id", tx.normal_complaint(F.col("raw")).alias("normalized")).distinct()


def complaint_context(spark, d):
    """TXT-07: the context form, the tokens and whether the raw text is a placeholder."""
    rows = _complaints(spark, d).select("pair_id", "raw", tx.normal_complaint(F.col("raw")).alias("normal"))
    return rows.select(
        "pair_id", tx.context_complaint(F.col("raw")).alias("context"), tx.complaint_tokens(F.col("normal")).alias("tokens"),
        tx.is_placeholder(F.col("raw")).cast("int").alias("is_placeholder"),
    ).distinct()


def concept_mentions(spark, d):
    """TXT-08 on the evidence of the history sections."""
    rows = table(spark, d, "psych_history_llm_input").select("classifier_row_id", tx.normal_complaint(F.col("section_text")).alias("said")).distinct()
    rows = spread(rows).select("classifier_row_id", tx.concept_mentions(F.col("said")).alias("m"))
    return rows.select("classifier_row_id", *[tx.mention_text(F.col("m"), n).alias("negated" if n else "affirmed") for n in (False, True)])


def usable_complaints(spark, d):
    """FLT-10: complaints that are kept after all screens."""
    names = vl.split_terms(F.col("terms"))
    gone = F.array_join(F.filter(names, lambda t: t.startswith("negated:")), " | ")
    rows = _complaints(spark, d).select("pair_id", tx.normal_complaint(F.col("raw")).alias("normalized"), "terms", gone.alias("negated_terms"))
    rows = rows.withColumn("m", tx.concept_mentions(F.col("normalized")))
    rows = rows.select("*", tx.mention_text(F.col("m"), False).alias("affirmed"), tx.mention_text(F.col("m"), True).alias("negated"))
    return tx.usable_complaints(rows).select("pair_id", "normalized").distinct()


def complaint_subgroups(spark, d):
    """TXT-21, CND-07: subgroups of the matched admissions' complaints, their combinations and overlaps."""
    roles = combine.stacked_roles(table(spark, d, "matched_pairs").distinct(), {"mhh_": "case", "mhc0_": "control"}, ["pair_id"])
    lower = F.transform(vl.split_terms(F.col("quickumls_terms")), F.lower)
    rows = roles.select("pair_id", "role", F.col("chief_complaint_normalized").alias("t"), vl.expanded_terms(lower).alias("names"))
    return combine.with_subgroups(rows, "t", "names").drop("t", "names")


def chunk_windows(spark, d):
    parts = tx.word_windows(_notes(spark, d), ["note_id"], "text")
    return parts.select("note_id", "chunk", "n_chunks", F.length("chunk_text").cast("long").alias("n_characters"))


def readability_metrics(spark, d):
    return tx.complexity(_documents(spark, d), ["doc_id"], "text")


def bigram_counts(spark, d):
    return tx.ngram_frequencies(_documents(spark, d), "doc_id", "text")


def token_phrase_flags(spark, d):
    phrases = ["emergency department", "heavy drinking", "low mood", "hearing voices"]
    flags = [tx.has_phrase(F.col("text"), p).cast("int").alias("has_" + p.replace(" ", "_")) for p in phrases]
    return _documents(spark, d).select("doc_id", *flags)


def confused_in_section(spark, d):
    """TXT-18: the word in one section of every note that has it."""
    parsed = _sections(spark, d).where("section = 'discharge_condition'")
    return parsed.select("note_id", F.col("text").rlike(r"(?iU)\bconfused\b").cast("int").alias("flag"))


def missed_headings(spark, d):
    return tx.missed_headings(_documents(spark, d), "doc_id", "text")


def parent_phrases(spark, d):
    rows = table(spark, d, "chief_complaint_cluster_qc_output").select("hadm_id", "chief_complaint_normalized").distinct()
    return tx.parent_phrases(rows, "hadm_id", "chief_complaint_normalized", stop_words=_STOP)


def term_pairs(spark, d):
    rows = table(spark, d, "matched_pairs").select("pair_id", "mhh_quickumls_terms").distinct()
    return vl.term_pairs(rows, "pair_id", vl.split_terms(F.col("mhh_quickumls_terms")))


def shared_terms(spark, d):
    rows = table(spark, d, "matched_pairs").select("pair_id", "mhh_quickumls_terms", "mhc0_quickumls_terms").distinct()
    a, b = vl.split_terms(F.col("mhh_quickumls_terms")), vl.split_terms(F.col("mhc0_quickumls_terms"))
    shared = F.array_sort(F.array_intersect(a, b))
    return rows.select("pair_id", F.size(shared).cast("long").alias("n_shared"), F.array_join(shared, " | ").alias("shared"), vl.jaccard(a, b).alias("jaccard"))


def json_props(spark, d):
    rows = table(spark, d, "events").select("event_id", "props")
    return rows.select("event_id", vl.json_field(F.col("props"), "k").cast("long").alias("k"))


def json_recovered(spark, d):
    """JSN-02: props whole and cut off before their end; the field is read by pattern where the text is no JSON."""
    cut = F.substring("props", F.lit(1), F.length("props") - 1)
    rows = table(spark, d, "events").select("event_id", F.explode(F.array("props", cut)).alias("props"))
    return rows.select("event_id", vl.json_field(F.col("props"), "k").cast("long").alias("k"), vl.json_object_text(F.col("props")).isNull().cast("int").alias("recovered"))


def lenient_days(spark, d):
    """DAT-06: days read from hand-written times, null where there is none."""
    rows = table(spark, d, "export_mhh_psychotic").select("note_id", "charttime").distinct()
    told = F.coalesce(F.col("charttime").cast("string"), F.lit("not known"))
    return rows.select("note_id", vl.lenient_day(told).alias("day"))


def keyword_prefilter(spark, d):
    """TXT-12, ARR-06: sections with hits, with their groups and counts, numbered over all notes in order."""
    counts = tx.keyword_counts(F.col("text"))
    hits = sum(counts.values(), F.lit(0)).cast("long")
    groups = F.size(F.filter(F.array(*[c > 0 for c in counts.values()]), lambda x: x)).cast("long")
    parsed = _sections(spark, d).select("note_id", "section", "position", hits.alias("n_hits"), groups.alias("n_groups"), tx.group_count_text(counts).alias("group_hit_counts"))
    return combine.numbered(parsed.where("n_hits > 0"), ["note_id", "position"], "classifier_row_id").drop("position")


_QUERIES = [
    keyword_density, stigma_counts, keyword_group_explode, keyword_hits, keyword_flags, note_sections, section_report, section_length_profile, length_profile, classifier_input,
    chief_complaints, text_normalise, complaint_context, concept_mentions, usable_complaints, complaint_subgroups, chunk_windows, readability_metrics,
    bigram_counts, token_phrase_flags, confused_in_section, missed_headings, parent_phrases, term_pairs, shared_terms, json_props, json_recovered, lenient_days,
    keyword_prefilter,
]
QUERIES = {f.__name__: f for f in _QUERIES}
