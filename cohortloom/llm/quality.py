"""Statistics of each text that tell running prose from lists, tables and junk.

Layout is read from the lines: columns whose delimiters stand below each other, indentation that
repeats with a period, line lengths that follow each other at a lag, and list marks. Together they
tell the lines that are set as a list or table, whatever their items or cells hold. Sentences are
read from the other, running text with line breaks ignored, so that wrapping doesn't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortloom.session import spread

#: Frequent function words of some European languages, for the share of common words. Sentences don't need them.
COMMON_WORDS = frozenset(
    """
    a about after all an and any are as at be because been before but by can could do for from had has have he her his
    i if in into is it its may no not of on one or our she so than that the their them there they this to up was we
    were what when which who will with would you your
    al como con cuando de del desde el en es esta este fue la las le les lo los más me mi muy no para pero por porque
    que se sin su sus un una y ya
    au aux avec ce cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour
    qui sa sans ses son sont sur un une vous était été
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    ihm ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und unter vom von vor war wie wir wurde zu
    zum zur da e em não os um uma che di è gli il non per una het een van niet op te
    """.split()
)

_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_MARK = re.compile(r"^\s*(?:[-*•‣▪◦·–—+]{1,3}|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)])\s+\S")
_DELIMITER = re.compile(r"\t|\||;|,|:|>| {2,}")
#: What parts cells: a comma or semicolon only without a space behind it, as in prose one follows; gaps of blanks.
_CLOSE = re.compile(r"(?<!\d)[,;](?=\S)|[,;](?=[^\s\d])")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…。！？](?:[\"'”’)\]]*)(?=\s|$)|[。！？]")
#: Letters of scripts other than Latin, whose function words aren't listed.
_FOREIGN = re.compile(r"[^\W\d_A-Za-z\u00aa-\u024f\u1e00-\u1eff]")
#: Vowels of the Latin script with any mark, and what parts the entries of a list within a line.
_VOWEL = re.compile("[aeiouyæœøı\u00e0-\u00e6\u00e8-\u00ef\u00f2-\u00f6\u00f8-\u00fd\u00ff-\u0105\u0112-\u011b\u0128-\u0131\u014c-\u0153\u0168-\u0173\u1ea0-\u1ef9]")
_PARTING = ",;|>=/\t"
_LINE_END = re.compile(r"[.!?…。！？:;][\"'”’)\]]*$")


_SHORT, _NUMBER, _SPOKEN, _OTHER = range(4)
#: Letters from which on a run without a break isn't a word of any language written with spaces.
_LONGEST_WORD = 40


class _Kinds(dict):
    """What kind of word each is; kept for as many words as memory should hold."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        if word.isdigit():
            kind = _NUMBER
        elif len(word) <= 2:
            kind = _SHORT
        else:
            whole = word.isalpha() or "-" in word or "'" in word or "’" in word
            kind = _SPOKEN if whole and len(word) <= _LONGEST_WORD and _VOWEL.search(word) else _OTHER
        self[word] = kind
        return kind


_KINDS = _Kinds()


@dataclass(frozen=True)
class ProseRule:
    """What counts as prose.

    A sentence is a stretch up to an end mark, outside lists and tables, of least_words words and more, in any language: letters for
    letter_share of what is visible; at most number_share of the words numbers; of the longer words spoken_share with a
    vowel, no digit and not overlong; at most parted_share as many separators as words; and of
    the words different_share different ones (of different_words at most). A stretch without an end mark passes from
    open_words words and open_common of frequent function words on, or whatever the language from open_unknown words on with
    open_short of three letters and less; it lies within one line or a wrapped paragraph (of lines of wrapped_line
    characters on average; short_line, without spaces, in scripts other than Latin). Text is prose if
    its sentences outside lists and tables hold prose_share of its visible characters.
    At least least_rows neighbouring lines make a list or table: marked items of which at most half have
    two sentences; rows with equally many cells in row_share of them, or their first number behind equally many words; or,
    from least_period on in indentation (with half the correlation of line lengths) and least_indent in indentation alone,
    lines of which ended_share end in punctuation or that are short.
    """

    least_words: int = 4
    letter_share: float = 0.75
    number_share: float = 0.4
    spoken_share: float = 0.7
    parted_share: float = 0.4
    different_share: float = 0.4
    different_words: int = 50
    open_words: int = 8
    open_common: float = 0.18
    open_unknown: int = 12
    open_short: float = 0.2
    wrapped_line: float = 45.0
    short_line: float = 20.0
    prose_share: float = 0.4
    least_rows: int = 3
    row_share: float = 0.9
    least_period: float = 0.4
    least_indent: float = 0.2
    ended_share: float = 0.8


def _aligned_columns(lines: list[str]) -> float:
    """Share of lines with a delimiter where at least half of all lines have it, or with the commonest set of delimiters."""
    if len(lines) < 3:
        return 0.0
    at: Counter = Counter()
    shapes: Counter = Counter()
    marks = []
    for line in lines:
        own = [(m.end(), m.group()[0]) for m in _DELIMITER.finditer(line)]
        marks.append(own)
        at.update(own)
        shapes["".join(sorted([c for _, c in own]))] += 1
    columns = {k for k, n in at.items() if 2 * n >= len(lines)}
    by_place = sum(any(k in columns for k in own) for own in marks) if columns else 0
    shapes.pop("", None)
    return max(by_place, max(shapes.values(), default=0)) / len(lines)


def _autocorrelation(values: list[int]) -> float:
    """The largest correlation of a series with itself at a lag of 1 to 8, at least 0."""
    if len(values) < 6 or min(values) == max(values):
        return 0.0
    v = np.asarray(values, dtype=float)
    v -= v.mean()
    lags = np.correlate(v, v, "full")[len(v) - 1 :]
    return float(max(0.0, lags[1 : min(9, len(v) // 2)].max() / lags[0]))


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of true flags."""
    begin = None
    for at, flag in enumerate([*flags, False]):
        if flag and begin is None:
            begin = at
        elif not flag and begin is not None:
            yield begin, at
            begin = None


def _items(lines: list[str], rule: ProseRule) -> Iterator[int]:
    """The lines of lists: marked lines and what is indented below them, blank lines between ignored."""
    member, marked, indent = [], [], None
    for line in lines:
        own = len(line) - len(line.lstrip())
        mark = bool(_MARK.match(line))
        indent = own if mark else indent if indent is not None and own > indent else None
        member.append(indent is not None)
        marked.append(mark)
    for begin, end in _runs(member):
        starts = [at for at in range(begin, end) if marked[at]]
        if len(starts) < rule.least_rows:
            continue
        several = 0
        for at, after in zip(starts, [*starts[1:], end]):
            text = _MARK.sub("", " ".join(lines[at:after]), count=1)
            several += sum(len(_TOKEN.findall(x)) >= rule.least_words or len(_FOREIGN.findall(x)) >= 8 for x in _END.split(text)) > 1
        if 2 * several <= len(starts):
            yield from range(begin, end)


def _rows(lines: list[str], rule: ProseRule) -> Iterator[int]:
    """The lines of tables: neighbours with equally many cells, of three on unless tabs or bars part them."""
    counted = (
        (1, [x.count("\t") for x in lines]), (1, [x.count("|") for x in lines]), (2, [len(_CLOSE.findall(x)) if "," in x or ";" in x else 0 for x in lines]),
        (2, [x.count(";") for x in lines]), (1, gaps := [len(_GAP.findall(x)) if "  " in x else 0 for x in lines]),
    )
    for least, counts in counted:
        if max(counts, default=0) < least:
            continue
        for begin, end in _runs([x >= least for x in counts]):
            own = Counter(counts[begin:end])
            if end - begin >= rule.least_rows and max(own.values()) >= rule.row_share * (end - begin):
                if counts is not gaps or _aligned_gaps(lines[begin:end], rule):
                    yield from range(begin, end)


def _dosed(lines: list[str], rule: ProseRule) -> Iterator[int]:
    """The lines of lists of values: short neighbours with their first number behind equally many words."""
    at = []
    for line in lines:
        words = _TOKEN.findall(line) if len(line) < rule.wrapped_line and _DIGIT.search(line) else ()
        at.append(next((i for i, w in enumerate(words) if w[0].isdigit()), -1) if len(words) > 1 else -1)
    for begin, end in _runs([x > 0 for x in at]):
        if end - begin >= rule.least_rows and max(Counter(at[begin:end]).values()) >= rule.row_share * (end - begin):
            yield from range(begin, end)


def _aligned_gaps(lines: list[str], rule: ProseRule) -> bool:
    """Whether gaps of blanks end, or begin, below each other."""
    for side in (0, 1):
        at = Counter(m.span()[side] for line in lines for m in _GAP.finditer(line))
        if at and max(at.values()) >= rule.row_share * len(lines):
            return True
    return False


def _laid(lines: list[str], period: float, correlation: float, ended: float, rule: ProseRule) -> set[int]:
    """Which of the visible lines are set as a list or table."""
    laid = {*_items(lines, rule), *_rows(lines, rule), *_dosed(lines, rule)}
    if period >= rule.least_indent and period + correlation / 2 >= rule.least_period:
        if ended >= rule.ended_share or sum(map(len, lines)) < rule.wrapped_line * len(lines):
            indents = [len(x) - len(x.lstrip()) for x in lines]
            laid |= {at for at, own in enumerate(indents) if own > min(indents)}
    return laid


def _blocks(lines: list[str], laid: set[int]) -> Iterator[tuple[list[str], bool]]:
    """The lines in stretches that can hold sentences, and whether they are laid: list items and table rows stand alone."""
    run: list[str] = []
    at = -1
    for line in lines:
        bare = line.strip()
        at += bool(bare)
        alone = bare and (at in laid or "\t" in bare or "|" in bare or _MARK.match(line))
        if run and (alone or not bare):
            yield run, False
            run = []
        if alone:
            yield [bare], at in laid
        elif bare:
            run.append(bare)
    if run:
        yield run, False


def describe(text: str | None, rule: ProseRule = ProseRule()) -> tuple:
    """One text's statistics, in the order of FIELDS."""
    every = (text or "").splitlines()
    lines = [x for x in every if x.strip()]
    visible = sum(map(len, text.split())) if text else 0
    if not visible or not any(unicodedata.category(c) not in ("Cf", "Cc", "Zs") for c in text):
        return (0, None, None, None, None, None, None, None, None, None, 0, None, None)
    period, correlation = _autocorrelation([len(x) - len(x.lstrip()) for x in lines]), _autocorrelation([len(x) for x in lines])
    ended = sum(1 for x in lines if _LINE_END.search(x.rstrip())) / len(lines)
    laid = _laid(lines, period, correlation, ended, rule)
    count = letters = common = sentences = prose = 0
    for block, apart in _blocks(every, laid):
        whole = " ".join(block).lower()
        *closed, rest = _END.split(whole)
        for part in closed:
            words, own, frequent = _words(part)
            count, letters, common = count + len(words), letters + own, common + frequent
            size = 0 if apart else _sentence(part, words, own, frequent, True, rule)
            sentences += size > 0
            prose += size
        if not rest:
            continue
        words, own, frequent = _words(rest)
        count, letters, common = count + len(words), letters + own, common + frequent
        if len(block) > 1 and sum(map(len, block[:-1])) < rule.wrapped_line * (len(block) - 1) and len(rest) > len(block[-1]):
            rest = rest[-len(block[-1]) :]
            words, own, frequent = _words(rest)
        listed = len(block) > 1 and sum(len(x) - x.count(" ") for x in block) < rule.short_line * len(block)
        if not apart and not _MARK.match(block[0]) and not (listed and _foreign(rest)):
            size = _sentence(rest, words, own, frequent, False, rule)
            sentences += size > 0
            prose += size
    share = prose / visible
    return (
        count,
        letters / count if count else None,
        max(0, visible - letters) / visible,
        ended,
        common / count if count else 0.0,
        sum(1 for x in lines if _MARK.match(x)) / len(lines),
        _aligned_columns(lines),
        period,
        correlation,
        sum(len(x) - sum(map(x.count, " \t")) for at, x in enumerate(lines) if at in laid) / visible,
        sentences,
        share,
        share >= rule.prose_share,
    )


def _words(part: str) -> tuple[list[str], int, int]:
    """Words of a stretch in lower case, their letters, and how many are frequent."""
    words = _TOKEN.findall(part)
    return words, sum(map(len, words)), sum(map(COMMON_WORDS.__contains__, words))


def _foreign(part: str) -> bool:
    """Whether at least half of what is visible are letters of a script other than Latin."""
    count = not part.isascii() and len(_FOREIGN.findall(part))
    return bool(count) and 2 * count >= len(part) - part.count(" ")


def _flows(part: str, words: list[str], rule: ProseRule) -> bool:
    """Whether a stretch of Latin letters reads as words in a row, in whatever language: words that can be spoken, few of
    them numbers or parted by separators, and not the same few again and again."""
    kinds = list(map(_KINDS.__getitem__, words))
    spoken = kinds.count(_SPOKEN)
    if spoken < rule.spoken_share * (spoken + kinds.count(_OTHER)) or kinds.count(_NUMBER) > rule.number_share * len(words):
        return False
    if sum(map(part.count, _PARTING)) > rule.parted_share * len(words):
        return False
    return len(words) < 2 * rule.least_words or len(set(words)) >= rule.different_share * min(len(words), rule.different_words)


def _sentence(part: str, words: list[str], letters: int, frequent: int, closed: bool, rule: ProseRule) -> int:
    """The visible characters of a stretch if it reads as a sentence, else 0."""
    visible = len(part) - part.count(" ")
    if visible >= 8 and _foreign(part):
        return visible
    if len(words) < rule.least_words or letters < rule.letter_share * visible or not _flows(part, words, rule):
        return 0
    if closed:
        return visible
    short = sum(len(w) <= 3 for w in words)
    known = len(words) >= rule.open_words and frequent >= rule.open_common * len(words)
    return visible if known or (len(words) >= rule.open_unknown and short >= rule.open_short * len(words)) else 0


FIELDS = [
    ("word_count", T.LongType(), pa.int64()),
    ("mean_word_length", T.DoubleType(), pa.float64()),
    ("symbol_ratio", T.DoubleType(), pa.float64()),
    ("ended_line_share", T.DoubleType(), pa.float64()),
    ("common_word_share", T.DoubleType(), pa.float64()),
    ("list_line_share", T.DoubleType(), pa.float64()),
    ("column_alignment", T.DoubleType(), pa.float64()),
    ("indent_period", T.DoubleType(), pa.float64()),
    ("length_correlation", T.DoubleType(), pa.float64()),
    ("layout_share", T.DoubleType(), pa.float64()),
    ("sentence_count", T.LongType(), pa.int64()),
    ("prose_share", T.DoubleType(), pa.float64()),
    ("is_prose", T.BooleanType(), pa.bool_()),
]


def text_statistics(df: DataFrame, key: str, text: str, rule: ProseRule = ProseRule()) -> DataFrame:
    """key and the statistics of every row's whole text, spread over all cores if the input is small.

    Null, empty and blank texts count no words and have null in the other columns; repeated rows
    stay; columns other than key and text are not read.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(value, rule) for value in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(FIELDS)
            arrays = [pa.array(column, kind) for column, (_, _, kind) in zip(columns, FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *(name for name, _, _ in FIELDS)])

    schema = T.StructType([df.schema[key], *(T.StructField(name, kind) for name, kind, _ in FIELDS)])
    return spread(df.select(key, text)).mapInArrow(measure, schema)


def not_prose(df: DataFrame, key: str, text: str, rule: ProseRule = ProseRule()) -> DataFrame:
    """The keys of the texts with something visible that are in the main not prose."""
    return text_statistics(df, key, text, rule).where("not is_prose").select(key).distinct()
