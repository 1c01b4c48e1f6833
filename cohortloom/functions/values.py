"""Functions over arrays, JSON text, dates and vectors (ARR, JSN, DAT, MTH)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.vocabulary import CONTEXT_LABELS, MENTION_TYPES


def split_terms(text: Column, separator: str = r"\|") -> Column:
    """ARR-01: trimmed, non-blank parts of a delimited string; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def joined_terms(text: Column, separator: str = r"\|") -> Column:
    """AGG-09: an aggregate: the different terms of all delimited strings of a group, sorted, joined by bars."""
    every = F.flatten(F.collect_list(F.array_distinct(split_terms(text, separator))))
    return F.array_join(F.array_sort(F.array_distinct(every)), " | ")


def jaccard(a: Column, b: Column) -> Column:
    """ARR-05: shared part of two arrays as sets, 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def expanded_terms(terms: Column) -> Column:
    """ARR-04: the terms and their words, a `negated:` mark kept on each word."""
    def words(t: Column) -> Column:
        mark = F.when(t.startswith("negated:"), "negated:").otherwise("")
        return F.transform(F.split(F.regexp_replace(t, "^negated:", ""), " "), lambda w: F.concat(mark, w))

    return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, words))))


def term_pairs(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """ARR-03: term_a, term_b (in order) and n_rows of every two different terms of a row."""
    rows = df.select(key, F.array_sort(F.array_distinct(terms)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("term_a"), b.alias("term_b")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("term_a", "term_b").agg(F.count("*").alias("n_rows"))


def json_object_text(text: Column) -> Column:
    """JSN-01: the text itself if it is JSON, else the widest {...} in it that is, else null."""
    widest = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    return F.when(F.try_parse_json(text).isNotNull(), text).when((widest != "") & F.try_parse_json(widest).isNotNull(), widest)


def json_field(text: Column, field: str) -> Column:
    """JSN-02: a field of JSON text, read by pattern where the text is cut off; null if it isn't there."""
    whole = F.get_json_object(json_object_text(text), f"$.{field}")
    found = F.regexp_extract(text, rf'"{field}"\s*:\s*"?([^",}}]*)', 1)
    return F.coalesce(whole, F.when(found != "", F.trim(found)))


def enum_or(value: Column, allowed: list[str], otherwise: str) -> Column:
    """JSN-04: a value in lower case if it is allowed, else a default."""
    bare = F.lower(F.trim(value))
    return F.when(bare.isin(*allowed), bare).otherwise(otherwise)


def shortened(text: Column, words: int, characters: int) -> Column:
    """JSN-05: the first words, and of these no more characters than allowed, cut at a word's end."""
    some = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, words), " ")
    return F.when(F.length(some) <= characters, some).otherwise(F.regexp_replace(F.substring(some, 1, characters), r" [^ ]*$", ""))


def cosine(a: Column, b: Column) -> Column:
    """MTH-03: cosine of two arrays of numbers; null for null, empty and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fractional_days(start: Column, end: Column, negative_as_null: bool = True) -> Column:
    """DAT-04: days between two times as a fraction; negative ones are null by default."""
    days = F.timestamp_diff("MICROSECOND", start, end) / 86_400_000_000.0
    return F.when(days >= 0, days) if negative_as_null else days


def rate_per_year(n: Column, days: Column) -> Column:
    """MTH-04: n by observed year, null without observed time."""
    return F.when(days > 0, n / (days / 365.25))


def death_flags(admit: Column, discharge: Column, death: Column, expired: Column, days: int = 365) -> dict[str, Column]:
    """DAT-05: died in hospital, as the flag of the admission says; within days of admission; after discharge, within days of it."""
    limit = F.make_dt_interval(F.lit(days))
    inside = F.coalesce(expired == 1, F.lit(False))
    return {
        "died_in_hospital": inside,
        "death_within_1y_after_admission": F.coalesce((death >= admit) & (death <= admit + limit), F.lit(False)),
        "post_discharge_death_within_1y": F.coalesce((death > discharge) & (death <= discharge + limit), F.lit(False)) & ~inside,
    }


def lenient_day(text: Column) -> Column:
    """DAT-06: the day of a time told as text, as year-month-day; null if it can't be read."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd")


def classifier_fields(answer: Column) -> Column:
    """JSN-01 to JSN-05: struct of label, mention_type, evidence_span, reason and recovered of a model's answer.

    Fields go by either of their names. An answer that is no JSON counts only if a label can be read
    from its beginning, and is recovered then; otherwise, as for null, the struct is null.
    """
    whole = json_object_text(answer)
    read = lambda name: squeezed(F.coalesce(F.get_json_object(whole, f"$.{name}"), F.when(whole.isNull(), _told(answer, name))))
    either = lambda a, b: F.lower(F.coalesce(read(a), read(b)))
    said = either("psychiatric_context_label", "psychiatric_context_integrated")
    label = F.when(said.isin(*CONTEXT_LABELS), said).otherwise("negative")
    mention = either("psychiatric_mention_type", "integration_type")
    usual = F.when(label == "positive", "current_context").otherwise("none")
    fields = F.struct(
        label.alias("label"), F.when(mention.isin(*MENTION_TYPES), mention).otherwise(usual).alias("mention_type"),
        shortened(F.coalesce(read("evidence_span"), F.lit("")), 20, 120).alias("evidence_span"),
        shortened(F.coalesce(read("reason"), F.lit("")), 25, 160).alias("reason"), whole.isNull().alias("recovered"),
    )
    return F.when(whole.isNotNull() | said.isin(*CONTEXT_LABELS), fields)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _told(text: Column, field: str) -> Column:
    """What stands behind a field's name, also if its end is cut off; null for nothing."""
    found = F.regexp_extract(text, rf'"{field}"\s*:\s*"([^"]*)', 1)
    return F.when(found != "", found)
