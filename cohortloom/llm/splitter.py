"""Pieces of oversized texts, cut along their structure and overlapping by a fixed amount.

A text is a tree: sections, paragraphs, list items, lines, sentences, words. Sibling subtrees are
merged from below as long as they fit; only nodes that are too large themselves are descended into.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortloom.session import spread

#: Places before which a node of each level can begin, from the coarsest level to the finest.
_LEVELS = [
    re.compile(r"(?:(?<=\n)|(?<=\r)(?!\n))(?=[ \t]*(?:#{1,6} |[^\s.!?:][^.!?:\r\n]{0,60}:[ \t]*(?:\r|\n|$)))"),  # headings
    re.compile(r"(?<=\n\n)(?!\n)|(?<=\n\r\n)(?![\r\n])|(?<=\r\r)(?!\r)"),  # after blank lines
    re.compile(r"(?:(?<=\n)|(?<=\r)(?!\n))(?=[ \t]*(?:[-*•‣▪·–]|\(?(?:\d{1,3}|[A-Za-z])[.)])[ \t])"),  # list items
    re.compile(r"(?<=\n)|(?<=\r)(?!\n)"),  # lines
    re.compile(r"(?<=[.!?;][ \t\r\n])(?![ \t\r\n])"),  # sentences
    re.compile(r"(?<=[ \t\r\n])(?![ \t\r\n])"),  # words
]
_WORD = re.compile(r"[^ \t\r\n]+")


@dataclass(frozen=True)
class SplitRule:
    """Texts of more than `limit` units are cut; consecutive pieces share `overlap` units.

    unit: "words" (separated by spaces, tabs, carriage returns and line feeds) or "characters"
    (Unicode code points).
    """

    limit: int
    overlap: int
    unit: str = "words"

    def __post_init__(self) -> None:
        if self.unit not in ("words", "characters"):
            raise ValueError(f"unknown unit {self.unit}")
        if not 0 <= self.overlap < self.limit:
            raise ValueError("the overlap must be below the limit")


class _Ruler:
    """Sizes of stretches of one text in units."""

    def __init__(self, text: str, unit: str) -> None:
        self.starts = [m.start() for m in _WORD.finditer(text)] if unit == "words" else None
        self.length = len(text)

    def size(self, begin: int, end: int) -> int:
        if self.starts is None:
            return end - begin
        return bisect_left(self.starts, end) - bisect_left(self.starts, begin)

    def back(self, at: int, units: int) -> int:
        """The place `units` before a place, at least 0."""
        if self.starts is None:
            return max(0, at - units)
        i = bisect_left(self.starts, at) - units
        return self.starts[i] if i > 0 else 0

    def step(self, begin: int, units: int) -> int:
        """The place `units` after a place."""
        if self.starts is None:
            return min(self.length, begin + units)
        i = bisect_left(self.starts, begin) + units
        return self.starts[i] if i < len(self.starts) else self.length


def split(text: str | None, rule: SplitRule) -> list[tuple[int, int]]:
    """Begin and end of each piece. Null and empty texts have none, texts within the limit one."""
    if not text:
        return []
    ruler = _Ruler(text, rule.unit)
    if ruler.size(0, len(text)) <= rule.limit:
        return [(0, len(text))]
    places = [[m.start() for m in level.finditer(text)] for level in _LEVELS]
    cores = _pack(0, len(text), 0, places, ruler, rule.limit - rule.overlap)
    while len(cores) > 1 and ruler.size(*cores[0]) < rule.overlap:
        cores[:2] = [(cores[0][0], cores[1][1])]  # still within the limit, and now long enough to be shared
    return [(ruler.back(begin, rule.overlap) if begin else 0, end) for begin, end in cores]


def _pack(begin: int, end: int, level: int, places: list[list[int]], ruler: _Ruler, room: int) -> list[tuple[int, int]]:
    if ruler.size(begin, end) <= room:
        return [(begin, end)]
    if level == len(places):  # a single word of more characters than fit
        cuts = [begin]
        while ruler.size(cuts[-1], end) > room:
            cuts.append(ruler.step(cuts[-1], room))
        return list(zip(cuts, [*cuts[1:], end]))
    own = places[level]
    cuts = own[bisect_right(own, begin) : bisect_left(own, end)]
    nodes = list(zip([begin, *cuts], [*cuts, end]))
    if len(nodes) == 1:
        return _pack(begin, end, level + 1, places, ruler, room)
    merged: list[tuple[int, int]] = []
    for low, high in nodes:
        for part in [(low, high)] if ruler.size(low, high) <= room else _pack(low, high, level + 1, places, ruler, room):
            if merged and ruler.size(merged[-1][0], part[1]) <= room:
                merged[-1] = (merged[-1][0], part[1])
            else:
                merged.append(part)
    return merged


def split_column(df: DataFrame, key: str, text: str, rule: SplitRule) -> DataFrame:
    """key, n_pieces, piece (from 0), begin (its first code point in the text), n_units and text of every piece.

    Every row's whole text is covered. Null and empty texts have no
    piece, repeated rows repeat theirs, and columns other than key and text are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                at, count, number, begins, units, texts = [], [], [], [], [], []
                for row, value in enumerate(some.column(1).to_pylist()):
                    pieces = split(value, rule)
                    ruler = _Ruler(value, rule.unit) if pieces else None
                    for i, (begin, end) in enumerate(pieces):
                        at.append(row)
                        count.append(len(pieces))
                        number.append(i)
                        begins.append(begin)
                        units.append(ruler.size(begin, end))
                        texts.append(value[begin:end])
                columns = [pa.array(x, pa.int64()) for x in (count, number, begins, units)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(at, pa.int64())), *columns, pa.array(texts, pa.string())],
                    names=[key, "n_pieces", "piece", "begin", "n_units", "piece_text"],
                )

    schema = T.StructType([df.schema[key]])
    for name in ("n_pieces", "piece", "begin", "n_units"):
        schema = schema.add(name, "long")
    return spread(df.select(key, text)).mapInArrow(cut, schema.add("piece_text", "string"))


def piece_counts(df: DataFrame, key: str, text: str, rule: SplitRule) -> DataFrame:
    """key and n_pieces of every row's text, 0 for null and empty ones: the same cuts, without the pieces' texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(split(value, rule)) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_pieces"])

    return spread(df.select(key, text)).mapInArrow(cut, T.StructType([df.schema[key]]).add("n_pieces", "long"))
