"""Encoding of whole texts with a public byte-pair vocabulary, by backtracking.

The usual encoder merges pairs in a loop over the piece; here each piece takes linear time: an
Aho-Corasick automaton finds the longest token at every position, and a token is accepted only if
the pair with its predecessor is one that the merges would also leave side by side. If no token
fits, the last one is taken back and its end is marked as impossible.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortloom.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space as the vocabulary's pre-tokenizer means it (Unicode White_Space; the separators 1c-1f are not in it).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNICODE = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: The same for texts of ASCII letters only, in the faster engine.
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Encoder:
    """Encodes and decodes with the ranks of a vocabulary file.

    cache_size bounds the memory for pieces already seen; it has no effect on results.
    """

    def __init__(self, path: str = VOCABULARY, cache_size: int = 200_000) -> None:
        self._ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self._ranks[base64.b64decode(token)] = int(rank)
        ranks = self._ranks
        count = max(ranks.values()) + 1
        self._bytes: list[bytes] = [b""] * count
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._shorter = [self._longest_prefix(token) for token in self._bytes]
        self._merged: dict[tuple[int, int], int] = {}
        self._parts = [(rank, rank) for rank in range(count)]
        for rank in range(count):
            self._learn(rank)
        lengths = np.array([len(token) for token in self._bytes], dtype=np.int64)
        self._offsets = np.concatenate([[0], np.cumsum(lengths)])
        self._blob = np.frombuffer(b"".join(self._bytes), dtype=np.uint8)
        self._pieces = _Pieces(self, cache_size)

    def _longest_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            rank = self._ranks.get(token[:end])
            if rank is not None:
                return rank
        return -1

    def _learn(self, rank: int) -> None:
        """Find the two tokens whose merge yields this one, if merges can yield it."""
        token, left = self._bytes[rank], self._shorter[rank]
        while left >= 0:
            right = self._ranks.get(token[len(self._bytes[left]) :])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self._merged[left, right] = rank
                self._parts[rank] = (left, right)
                return
            left = self._shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order leaves left and right as neighbours.

        Undo merges from the later one downwards; the pair fails if, at some stage, the tokens that
        meet at the border would have been merged before the step that was undone.
        """
        merged, parts = self._merged, self._parts
        limit = 1 << 60
        while True:
            rank = merged.get((left, right))
            if rank is not None and rank < limit:
                return False
            if left > right:
                limit = left
                inner = parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit = right + 1
                inner = parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit = right + 1
                inner = parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit = left
                inner = parts[left][1]
                if inner == left:
                    return True
                left = inner

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The exact merge result of one piece, in time linear in its length."""
        whole = self._ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        longest, reach = [-1] * size, [0] * size
        for end, (rank, length) in self._automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                longest[start], reach[start] = rank, length
        possible = bytearray(b"\1" * (size + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self._bytes[token])
                if possible[end] and (last < 0 or self._compatible(last, token)):
                    break
                token = self._shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif out:
                possible[at] = 0
                token = out.pop()
                at -= len(self._bytes[token])
            else:
                raise ValueError("the vocabulary has no token for some byte")
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces; together they are the text."""
        return (_ASCII if text.isascii() else _UNICODE).findall(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of an empty text and of null none. Special tokens' names are ordinary text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, cut from one blob by the table of offsets."""
        ids = np.asarray(ids, dtype=np.int64)
        starts, sizes = self._offsets[ids], self._offsets[ids + 1] - self._offsets[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        steps = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        return self._blob[np.repeat(starts, sizes) + steps].tobytes()


class _Pieces(dict):
    """Pieces seen so far with their ids; emptied when full. Very long pieces are not kept."""

    def __init__(self, encoder: Encoder, most: int) -> None:
        super().__init__()
        self.encoder, self.most = encoder, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encoder.encode_piece(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


_SENT: set[tuple[str, str]] = set()


def _sent(df: DataFrame, path: str) -> str:
    """The name under which executors find a vocabulary file, which only the driver needs to have."""
    context = df.sparkSession.sparkContext
    if (context.applicationId, path) not in _SENT:
        context.addFile(path)
        _SENT.add((context.applicationId, path))
    return os.path.basename(path)


def encode_column(df: DataFrame, key: str, text: str, path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """key and the list of ids of every row's whole text, spread over all cores if the input is small.

    Null and empty texts give an empty list; repeated rows stay; other columns are not read.
    """

    name = _sent(df, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = [own.encode(value) for value in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=[key, ids])

    schema = T.StructType([df.schema[key], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return spread(df.select(key, text)).mapInArrow(encode, schema)


def decode_column(df: DataFrame, key: str, ids: str, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """key and the text of every row's ids; null ids give null, no ids an empty text."""

    name = _sent(df, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, text])

    schema = T.StructType([df.schema[key], T.StructField(text, T.StringType())])
    return df.select(key, ids).mapInArrow(decode, schema)
