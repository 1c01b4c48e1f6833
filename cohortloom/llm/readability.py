"""Reading grade of the running prose in each text.

Sentences are taken from the text without headings, list items, value lines and rulers. Words,
letters, syllables (by hyphenation patterns) and sentences give six grade estimates, of which
the median counts. Grades are not clamped: very plain texts lie below 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortloom.llm.syllables import syllables
from cohortloom.session import spread

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-.,][^\W_]+)*")
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*(?=\s|$)")
_ITEM = re.compile(r"^\s*(?:[-*•‣▪◦·–—+>]{1,3}|\(?(?:\d{1,3}|[A-Za-z])[.)])\s+\S")
_HEADING = re.compile(r"^[^.!?]{1,60}:\s*$")
_FIELD = re.compile(r"\S:\s{1,}\S.*:\s{1,}\S|_{3,}\s*$")
_BLANK = re.compile(r"(?:[A-Z][A-Za-z ]{0,24}:\s*)?_{3,}\s*")
_ENDED = re.compile(r"[.!?…][\"'”’)\]]*$")


@dataclass(frozen=True)
class GradeRule:
    """Sentences of least_words words and more count, with letters for letter_share of what is visible
    and at most number_share numbers. Lines of up to longest_field characters with several fields are no prose. A text is demanding from grade `demanding` on."""

    least_words: int = 4
    letter_share: float = 0.7
    number_share: float = 0.35
    wrapped_line: int = 45
    longest_field: int = 160
    demanding: float = 14.0


def sentences(text: str, rule: GradeRule = GradeRule()) -> Iterator[list[str]]:
    """The words of each sentence of the running prose."""
    run: list[str] = []
    for line in [*text.splitlines(), ""]:
        bare = line.strip()
        if len(bare) > rule.longest_field and len(_END.findall(bare)) > 1:  # a whole note in one line, behind fields left blank
            bare = _BLANK.sub("", bare)
        apart = not bare or _ITEM.match(line) or _HEADING.match(bare) or (len(bare) <= rule.longest_field and _FIELD.search(bare)) or "\t" in bare or "|" in bare
        fresh = run and bare[:1].isupper() and not bare.isupper() and not _ENDED.search(run[-1])
        short = run and len(run[-1]) < rule.wrapped_line and not _ENDED.search(run[-1])
        if run and (apart or fresh or short):
            yield from _cut(" ".join(run), rule)
            run = []
        if not apart:
            run.append(bare)


def _cut(block: str, rule: GradeRule) -> Iterator[list[str]]:
    for part in _END.split(block):
        part = part.strip()
        if not _ENDED.search(part):
            continue
        tokens = _TOKEN.findall(part)
        words = _WORD.findall(part)
        visible = sum(map(len, part.split()))
        if (
            len(words) >= rule.least_words
            and sum(map(len, words)) >= rule.letter_share * visible
            and sum(t[0].isdigit() for t in tokens) <= rule.number_share * len(tokens)
        ):
            yield words


def grade(text: str | None, rule: GradeRule = GradeRule()) -> tuple[int, int, float | None]:
    """Sentences and words of the running prose and its reading grade; a grade of null without prose."""
    count = words = letters = heard = hard = long = 0
    for sentence in sentences(text or "", rule):
        count += 1
        words += len(sentence)
        for word in sentence:
            n = syllables(word)
            letters += len(word)
            heard += n
            hard += n >= 3
            long += len(word) > 6
    if not count:
        return 0, 0, None
    length, rate = words / count, heard / words
    estimates = [
        0.39 * length + 11.8 * rate - 15.59,  # Flesch and Kincaid
        0.4 * (length + 100 * hard / words),  # Gunning's fog index
        1.043 * math.sqrt(30 * hard / count) + 3.1291,  # McLaughlin's SMOG
        4.71 * letters / words + 0.5 * length - 21.43,  # automated readability index
        5.88 * letters / words - 29.6 * count / words - 15.8,  # Coleman and Liau
        (length + 100 * long / words + 15) / 6.0,  # Björnsson's LIX on the scale of school grades
    ]
    return count, words, float(median(estimates))


def reading_grade(df: DataFrame, key: str, text: str, rule: GradeRule = GradeRule()) -> DataFrame:
    """key, n_sentences, n_words and grade of every row's whole text, spread over all cores if the input is small.

    Null, empty and prose-less texts have no sentences and a null grade; repeated rows stay; columns
    other than key and text are not read.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [grade(value, rule) for value in batch.column(1).to_pylist()]
            counts, words, grades = zip(*rows) if rows else ([], [], [])
            arrays = [pa.array(counts, pa.int64()), pa.array(words, pa.int64()), pa.array(grades, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "n_sentences", "n_words", "grade"])

    schema = T.StructType([df.schema[key]]).add("n_sentences", "long").add("n_words", "long").add("grade", "double")
    return spread(df.select(key, text)).mapInArrow(measure, schema)


def demanding_texts(df: DataFrame, key: str, text: str, rule: GradeRule = GradeRule()) -> DataFrame:
    """The keys of the texts whose prose needs a reader of the rule's grade or more; each key once."""
    return reading_grade(df, key, text, rule).where(f"grade >= {rule.demanding}").select(key).distinct()
