"""Short hand-typed phrases in one wording: spelling, abbreviations, synonyms of a reference list."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialize

#: Abbreviations of hand-typed complaints.
ABBREVIATIONS = {
    "abd": "abdomen", "absc": "abscess", "ams": "confusion", "bldg": "bleeding", "bx": "biopsy", "cst": "chest",
    "disloc": "dislocation", "fngr": "finger", "ftg": "fatigue", "fvr": "fever", "fx": "fracture", "ha": "headache", "htn": "hypertension",
    "infxn": "infection", "inj": "injury", "kn": "knee", "lac": "laceration", "loc": "syncope", "nk": "neck", "numb": "numbness", "rect": "rectum",
    "shldr": "shoulder", "sob": "dyspnea", "swlg": "swelling", "thrt": "throat", "wkns": "weakness", "p": "post",
    "w": "with", "c": "with", "s": "since", "bilat": "bilateral", "lt": "left", "rt": "right", "n": "nausea", "v": "vomiting", "d": "diarrhea",
}
#: Words that join the parts of a phrase.
LINKS = frozenset("a an and at for in of on or the this to".split())
#: Links that may stand within a phrase of the list without changing it.
INNER_LINKS = frozenset("a an and in of or the to".split())


@dataclass(frozen=True)
class SpellRule:
    """A word counts as misspelt if one that is `ratio` times as frequent is within `near` edits, or, from
    far_length letters on, one that is far_ratio times as frequent within `far`, or for words seen `ratio` times and
    more usual_ratio times. A word that is itself what at least `drawn` rarer words are nearest to has its own
    misspellings and isn't one within `far`. A word of the list counts as frequent as the list's words on average, and as
    `ratio`, at least; words of the list are never misspelt."""

    ratio: float = 4.0
    far_ratio: float = 12.0
    usual_ratio: float = 100.0
    drawn: int = 2
    near: int = 1
    far: int = 2
    far_length: int = 6


def words(text: Column) -> Column:
    """The words of a phrase in lower case; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def lookup(array: Column, table: dict[str, str]) -> Column:
    """Each word, or what a small fixed table has for it."""
    if not table:
        return array
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.transform(array, lambda w: F.coalesce(F.try_element_at(pairs, w), w))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, losses, changes and swaps of neighbours between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            value = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                value = min(value, before[j - 2] + 1)
            row.append(value)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletions(word: Column, most: Column) -> Column:
    """The word, and what is left of it without one letter, and where `most` is 2 without two.

    Two words within that many edits have one of these in common.
    """
    def without(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = without(word)
    two = F.when(most >= 2, F.flatten(F.transform(F.filter(one, lambda w: F.length(w) > 0), without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def spelling(counts: DataFrame, known: DataFrame, rule: SpellRule = SpellRule()) -> DataFrame:
    """word, right: what misspelt words stand for.

    counts: word, n. known: word of the list. Words meet over what is left of both without one or two letters, so that
    only words near each other do, and the edits are then counted exactly; the fewest edits count, then frequency and
    the first in the alphabet.
    """
    listed = known.select("word").distinct().withColumn("listed", F.lit(True))
    every = materialize(counts).join(listed, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed"))
    usual = F.lit(every.where("listed").agg(F.avg("n")).first()[0] or 0.0)
    every = every.where(F.length("word") >= 2).withColumn("weight", F.when(F.col("listed"), F.greatest("n", usual, F.lit(rule.ratio))).otherwise(F.col("n")))
    every = materialize(every)
    reach = F.when(F.length("word") >= rule.far_length, rule.far).otherwise(rule.near)
    asked = every.where("not listed").select(F.col("word").alias("left_id"), F.col("n").alias("own"), reach.alias("reach"))
    asked = asked.select("*", F.explode(deletions(F.col("left_id"), F.col("reach"))).alias("rest"))
    offered = every.where(F.col("listed") | (F.col("n") >= rule.ratio)).select(F.col("word").alias("right_id"), "n", "weight")
    offered = offered.select("*", F.explode(deletions(F.col("right_id"), F.lit(rule.far))).alias("rest"))
    near = (F.abs(F.length("left_id") - F.length("right_id")) <= F.col("reach")) & (F.col("left_id") != F.col("right_id")) & (F.col("weight") >= rule.ratio * F.col("own"))
    pairs = asked.join(offered, "rest").where(near).select("left_id", "right_id", "own", "n", "weight", "reach").distinct()

    @F.pandas_udf("int")
    def far(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y, rule.far) for x, y in zip(a, b)], dtype="int32")

    pairs = materialize(pairs.withColumn("edits", far("left_id", "right_id")).where(F.col("edits") <= F.col("reach")))
    best = F.min_by("right_id", F.struct("edits", -F.col("n"), "right_id"))
    nearest = pairs.groupBy("left_id").agg(best.alias("left_of"))
    own = nearest.groupBy(F.col("left_of").alias("left_id")).agg(F.count("*").alias("drawn")).where(F.col("drawn") >= rule.drawn)
    pairs = pairs.join(own, "left_id", "left")
    times = F.when(F.col("own") < rule.ratio, rule.far_ratio).otherwise(rule.usual_ratio)
    pairs = pairs.where((F.col("edits") <= rule.near) | (F.col("drawn").isNull() & (F.col("weight") >= times * F.col("own"))))
    return pairs.groupBy(F.col("left_id").alias("word")).agg(best.alias("right"))


def correct(df: DataFrame, key: str, array: str, right: DataFrame) -> DataFrame:
    """df's key and its words with misspelt ones put right; twice, as a misspelling may be near another."""
    twice = right.alias("a").join(right.alias("b"), F.col("a.right") == F.col("b.word"), "left")
    twice = twice.select("a.word", F.coalesce("b.right", "a.right").alias("right"))
    each = df.select(key, F.posexplode(array).alias("at", "word")).join(twice, "word", "left")
    each = each.select(key, F.struct("at", F.coalesce("right", "word").alias("w")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias(array))


def list_names(reference: DataFrame, key: str, preferred: str, others: str) -> DataFrame:
    """key, first (the preferred name's words) and name (the words of one of its names), link words left out."""
    bare = lambda c: F.filter(words(c), lambda w: ~w.isin(*LINKS))
    names = F.concat(F.array(F.col(preferred)), F.coalesce(F.split(others, r"\|"), F.array().cast("array<string>")))
    each = reference.select(F.col(key).alias("ref"), bare(F.col(preferred)).alias("first"), F.explode(names).alias("n"))
    return each.select("ref", "first", bare(F.col("n")).alias("name")).where("size(first) > 0 and size(name) > 0").distinct()


def _swap(first: list[str], name: list[str]) -> tuple[str, str] | None:
    """What a name says in other words than the preferred name: (its words, the preferred ones)."""
    mine, own = Counter(name), Counter(first)
    rest = [w for w in name if mine[w] > own[w]]
    gone = [w for w in first if own[w] > mine[w]]
    return (" ".join(rest), " ".join(gone)) if rest and gone else None


def synonyms(names: DataFrame, support: int = 2) -> DataFrame:
    """phrase and means: phrases of the list's further names and the words of the preferred names they stand for in at least `support` entries."""

    def swaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_swap(list(f), list(n)) for f, n in zip(batch["first"], batch["name"])]
            yield pd.DataFrame([x for x in found if x], columns=["phrase", "means"])

    pairs = names.select("first", "name").mapInPandas(swaps, "phrase string, means string").groupBy("phrase", "means").count()
    best = pairs.where(F.col("count") >= support).groupBy("phrase").agg(F.max_by("means", F.struct("count", "means")).alias("means"))
    return best.select("phrase", F.split("means", " ").alias("means"))


def _spans(words: list[str], longest: int) -> list[tuple[str, int, int]]:
    """Runs of words that say something, as phrases, with the places of their first and last word; inner links don't part them."""
    said = [i for i, w in enumerate(words) if w not in LINKS]
    out = []
    for a in range(len(said)):
        for b in range(a, min(len(said), a + longest)):
            if b > a and any(w not in INNER_LINKS for w in words[said[b - 1] + 1 : said[b]]):
                break
            out.append((" ".join(words[i] for i in said[a : b + 1]), said[a], said[b]))
    return out


def _replaced(words: list[str], found: list[tuple[str, int, int, list[str]]]) -> list[str]:
    """The words with phrases replaced, longer ones first; what is replaced once isn't read again."""
    taken: dict[int, tuple[int, list[str]]] = {}
    used: set[int] = set()
    for phrase, begin, end, means in sorted(found, key=lambda x: (-x[0].count(" "), x[1], x[0])):
        place = set(range(begin, end + 1))
        if not used & place:
            used |= place
            taken[begin] = (end, means)
    out, i = [], 0
    while i < len(words):
        if i in taken:
            end, means = taken[i]
            out += means
            i = end + 1
        else:
            out.append(words[i])
            i += 1
    return out


def preferred(df: DataFrame, key: str, array: str, meanings: DataFrame) -> DataFrame:
    """key and its words with the list's synonyms replaced; link words outside them stay.

    The runs of words of each row are joined with the phrases, so that neither the plan nor a task grows with the list.
    df's keys are different and not null.
    """
    kind = df.schema[key].dataType.simpleString()
    longest = meanings.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *span) for k, words in zip(batch[key], batch[array]) for span in _spans(list(words), longest)]
            yield pd.DataFrame(rows, columns=[key, "phrase", "begin", "last"])

    spans = df.select(key, array).mapInPandas(runs, f"{key} {kind}, phrase string, begin int, last int")
    found = spans.join(meanings, "phrase").groupBy(key).agg(F.collect_list(F.struct("phrase", "begin", "last", "means")).alias("found"))

    @F.pandas_udf("array<string>")
    def replaced(words: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for w, rows in zip(words, found):
            hits = [(r["phrase"], int(r["begin"]), int(r["last"]), list(r["means"])) for r in rows] if rows is not None else []
            out.append(_replaced(list(w), hits) if hits else list(w))
        return pd.Series(out)

    return df.select(key, array).join(found, key, "left").select(key, replaced(array, "found").alias(array))
