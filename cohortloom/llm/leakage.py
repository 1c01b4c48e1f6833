"""Passages of held-out material inside a corpus, by winnowed word shingles and extension of hits.

Both sides keep, of every `window` neighbouring k-grams of words, the one with the least hash, so
that any span of window + k - 1 equal words leaves at least one common fingerprint. A hit is
extended to both sides over altered, added and lost words; the aligned words decide.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import materialize, spread

_WORD = re.compile(r"[^\W_]+")
_LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*(?:\r\n|\n|\r)\s*(?=[^\W\d_])")
_NUMBER_POINT = re.compile(r"(?<=\d)[.,](?=\d)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class LeakRule:
    """What counts as a leak.

    k, window: shingle length and winnowing window in words.
    least_words: aligned words that make a leak. A word counts 1 in an alignment's score, but only
    template_weight if it is a number or stands in a trigram that more than template_share of the
    passages have, and each altered, added or lost word costs gap_cost; drop: by how much the score
    may fall within an alignment. least_share: aligned among the passage's words of weight 1 there
    (texts merely of the passages' style have the template's words but not these). least_seeds:
    words of weight 1 in the common fingerprints of a document and an item, below which they aren't aligned.
    stock_held, stock_contexts, stock_lone, stock_near: a sentence is held where this share of its words
    is aligned, and held alone where no sentence beside it in a passage has stock_near aligned words. It is
    a stock sentence, whose words don't count, if it stands alone in more than stock_contexts different
    contexts (stock_near * 3 words to both sides; copies have one), or in two if several passages
    have it between other sentences, and alone in at least stock_lone of all its contexts.
    block_words: words of passages up to which their fingerprints are sent to every task; for more, the
    fingerprints of both sides are joined. template: trigrams that stand in more than template_share of the
    passages, and more than template_count of them, are told over all passages either way.
    """

    k: int = 3
    window: int = 3
    least_words: int = 19
    least_share: float = 0.8
    least_content: int = 4
    least_seeds: int = 4
    gap_cost: float = 1.0
    drop: float = 3.5
    template_share: float = 0.05
    template_count: int = 4
    template_weight: float = 0.3
    stock_held: float = 0.9
    stock_contexts: int = 8
    stock_lone: float = 0.5
    stock_near: int = 3
    block_words: int = 2_000_000


def words_of(text: str | None) -> list[str]:
    """Words in one form: no case, accents, compatibility letters, line-end hyphens or number points."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    if ("\n" in text or "\r" in text) and ("-" in text or not text.isascii()):
        text = _LINE_HYPHEN.sub("", text)
    return _WORD.findall(_NUMBER_POINT.sub("", text.lower()))


def _mix(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k-gram that begins at each place."""
    out = np.zeros(max(0, len(ids) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = (out ^ ids[j : len(ids) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Whether each place holds the least hash of some run of `window` places."""
    size = len(hashes)
    if size <= window:
        return hashes == hashes.min() if size else np.zeros(0, dtype=bool)
    least = hashes[: size - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j : size - window + 1 + j], out=least)
    chosen = np.zeros(size, dtype=bool)
    for j in range(window):
        chosen[j : size - window + 1 + j] |= hashes[j : size - window + 1 + j] == least
    return chosen


def _digest(words: Iterable[str]) -> int:
    """A number for some words, the same in every task."""
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class _Numbers(dict):
    """Numbers of the passages' words; every other word is 0."""

    def __missing__(self, word: str) -> int:
        return 0


class _Codes(dict):
    """A hash of each word, the same everywhere; kept for as many words as memory should hold."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") | 1
        return code


_CODES = _Codes()


def _trigrams(words: list[str]) -> list[int]:
    return [_digest(words[j : j + 3]) for j in range(len(words) - 2)]


def _weights(words: list[str], template: set[int] | frozenset[int], rule: LeakRule) -> tuple[list[float], list[int]]:
    """The weight of each word of a passage, and how many words of weight 1 stand before each place."""
    weights = [1.0] * len(words)
    for j, gram in enumerate(_trigrams(words)):
        if gram in template:
            weights[j : j + 3] = [rule.template_weight] * 3
    weights = [min(w, rule.template_weight) if word.isdigit() else w for word, w in zip(words, weights)]
    return weights, np.concatenate([[0], np.cumsum([w >= 1 for w in weights])]).astype(int).tolist()


def _fingerprints(words: list[str], rule: LeakRule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-grams of a text that winnowing keeps."""
    hashes = _mix(np.array([_CODES[w] for w in words], dtype=np.uint64), rule.k) if len(words) >= rule.k else np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(winnow(hashes, rule.window))
    return hashes[at], at


def _passage(text: str) -> tuple[list[str], list[int]]:
    """The words of a passage and a number for the sentence of each."""
    words, sentences = [], []
    for sentence in map(words_of, _SENTENCE.split(text)):
        words += sentence
        sentences += [_digest(sentence)] * len(sentence)
    return words, sentences


class _Index:
    """Fingerprints of some passages; made once in each worker."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]], template: set[int] | frozenset[int], rule: LeakRule) -> None:
        self.rule = rule
        self.vocabulary: dict[str, int] = _Numbers()
        self.items = []
        self.orders: list[list[int]] = []  # the sentences of each passage
        self.lengths: list[list[int]] = []  # their words
        places = defaultdict(list)
        number = self.vocabulary
        for _, words, _ in items:
            for word in words:
                number.setdefault(word, len(number) + 1)
        for item, words, sentences in items:
            weights, content = _weights(words, template, rule)
            for code, at in zip(*map(np.ndarray.tolist, _fingerprints(words, rule))):
                places[code].append((len(self.items), at, content[at + rule.k] - content[at]))
            starts = [j == 0 or sentences[j] != sentences[j - 1] for j in range(len(words))]
            self.orders.append([x for x, start in zip(sentences, starts) if start])
            self.lengths.append(np.diff([*np.flatnonzero(starts), len(words)]).tolist())
            self.items.append((item, [number[w] for w in words], weights, content, sentences, (np.cumsum(starts) - 1).tolist()))
        self.known = np.array(sorted(places), dtype=np.uint64)
        listed = [places[int(x)] for x in self.known]
        self.begins = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int64)
        self.postings = np.array([x for part in listed for x in part], dtype=np.int64).reshape(-1, 3)

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, bool, list[tuple]]]:
        """(row, item, enough, parts) of the alignments in a batch of texts that are long enough or hold a sentence.

        parts: for each sentence of the passage that the alignment touches, its number, aligned
        words, those of weight 1, all its words of weight 1 in the aligned stretch, and if it is held
        and the passage has others beside it, its place among them, its context in the text and
        whether it stands alone there.
        """
        rule = self.rule
        if not len(self.known):
            return []
        read = [words_of(text) for text in texts]
        kept, places, starts = [], [], [0]
        for words in read:
            hashes, at = _fingerprints(words, rule)
            kept.append(hashes)
            places.append(at + starts[-1])
            starts.append(starts[-1] + len(words) + rule.k)
        hashes, place = np.concatenate(kept), np.concatenate(places)
        hits = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        same = self.known[hits] == hashes
        hits, found = hits[same], place[same]
        rows: dict[int, list[int]] = {}  # the words' numbers, for texts that are aligned
        counts = self.begins[hits + 1] - self.begins[hits]
        every = np.repeat(np.arange(len(found)), counts)
        within = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
        posting = self.postings[self.begins[hits][every] + within]
        row = (np.searchsorted(starts, found, side="right") - 1)[every]
        pair = row * len(self.items) + posting[:, 0]
        order = np.argsort(pair, kind="stable")
        keys, first = np.unique(pair[order], return_index=True)
        if not len(keys):
            return []
        sums = np.add.reduceat(posting[order, 2], first)
        ends = np.append(first[1:], len(order))
        begin = np.asarray(starts)
        out = []
        for j in np.flatnonzero(sums >= rule.least_seeds).tolist():
            at_row, item = divmod(int(keys[j]), len(self.items))
            own = order[first[j] : ends[j]]
            seeds = zip((found[every[own]] - begin[at_row]).tolist(), posting[own, 1].tolist())
            if at_row not in rows:
                rows[at_row] = list(map(self.vocabulary.__getitem__, read[at_row]))
            found_here = self._alignments(rows[at_row], item, list(seeds))
            touched: dict[int, int] = defaultdict(int)
            for _, parts in found_here:
                for place, (_, words, *_) in parts.items():
                    touched[place] = max(touched[place], words)
            for enough, parts in found_here:
                told = [self._told(read[at_row], item, place, part, touched) for place, part in parts.items()]
                if enough or any(x[4] is not None for x in told):
                    out.append((at_row, self.items[item][0], enough, told))
        return out

    def _told(self, words: list[str], item: int, place: int, part: list[int], touched: dict[int, int]) -> tuple:
        """A part as leaks() gives it. place: which of the passage's sentences it is."""
        rule, order = self.rule, self.orders[item]
        number, aligned, own, total, low, high = part
        if len(order) < 2 or aligned < rule.stock_held * self.lengths[item][place]:
            return (number, aligned, own, total, None, None, None)
        wide = 3 * rule.stock_near
        beside = [order[j] if 0 <= j < len(order) else None for j in (place - 1, place + 1)]
        context = _digest([*words[max(0, low - wide) : low], "|", *words[high + 1 : high + 1 + wide]])
        alone = all(touched.get(j, 0) < rule.stock_near for j in (place - 1, place + 1))
        return (number, aligned, own, total, _digest(map(str, beside)), context, alone)

    def _alignments(self, text: list[int], item_at: int, seeds: list[tuple[int, int]]) -> list[tuple[bool, dict[int, list[int]]]]:
        """Whether each alignment is long enough, and by place of a sentence its number, counts and first and last place in the text."""
        rule, (_, passage, weights, content, sentences, places) = self.rule, self.items[item_at]
        shortest = rule.stock_held * min(self.lengths[item_at])
        reached: list[tuple[int, int, int]] = []
        out = []
        for at, on in sorted(seeds):
            if any(low <= at < high and abs(at - on - diagonal) <= 4 for low, high, diagonal in reached):
                continue
            ahead, high, last = self._walk(text, passage, weights, at + rule.k, on + rule.k, 1)
            behind, low, first = self._walk(text, passage, weights, at - 1, on - 1, -1)
            reached.append((low, high, at - on))
            aligned = [*behind, *((on + j, at + j) for j in range(rule.k)), *ahead]
            if len(aligned) < min(rule.least_words, shortest):
                continue
            own = sum(weights[j] >= 1 for j, _ in aligned)
            enough = len(aligned) >= rule.least_words and own >= max(rule.least_content, rule.least_share * (content[last] - content[first + 1]))
            parts: dict[int, list[int]] = {}
            for j in range(first + 1, last):
                parts.setdefault(places[j], [sentences[j], 0, 0, 0, len(text), -1])[3] += weights[j] >= 1
            for j, there in aligned:
                part = parts[places[j]]
                part[1] += 1
                part[2] += weights[j] >= 1
                part[4], part[5] = min(part[4], there), max(part[5], there)
            out.append((enough, parts))
        return out

    def _walk(self, text, passage, weights, at, on, step) -> tuple[list[tuple[int, int]], int, int]:
        """The best stretch in one direction: places of its aligned words in passage and text, first places beyond in text and passage."""
        rule, size, length = self.rule, len(text), len(passage)
        aligned: list[tuple[int, int]] = []
        score = best = 0.0
        kept = (0, at, on)
        while 0 <= at < size and 0 <= on < length and score > best - rule.drop:
            if text[at] == passage[on]:
                aligned.append((on, at))
                score += weights[on]
                at, on = at + step, on + step
                if score >= best:
                    best, kept = score, (len(aligned), at, on)
                continue
            for skip_at, skip_on in _SKIPS:
                a, b = at + step * skip_at, on + step * skip_on
                c, d = a + step, b + step
                if 0 <= a < size and 0 <= b < length and text[a] == passage[b] and (
                    not (0 <= c < size and 0 <= d < length) or text[c] == passage[d]
                ):
                    score -= rule.gap_cost * max(skip_at, skip_on)
                    at, on = a, b
                    break
            else:
                break
        return aligned[: kept[0]], kept[1], kept[2]


_SKIPS = [(1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (0, 2), (2, 0), (3, 3), (3, 2), (2, 3)]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    passage: str = "passage",
    rule: LeakRule = LeakRule(),
) -> DataFrame:
    """doc and item of every document that holds some twenty running words of an item's passage.

    Up to the rule's block_words the passages go to every task, which meets their fingerprints while it
    reads its documents once; for more, the fingerprints of both sides are joined and only documents and
    passages that meet are brought together. The result is the same. Null and empty texts or
    passages have no leaks, repeated documents or items give a row once, and other columns are not
    read.
    """
    held = items.where(F.col(passage).isNotNull()).select(F.col(item).alias("i"), F.col(passage).alias("p")).distinct()
    size = held.agg(F.sum(F.length("p")).alias("n"), F.count("*").alias("items")).first()
    kind = items.schema[item].dataType
    texts = docs.select(doc, text)
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema[doc], T.StructField(item, kind)]))
    if size["n"] <= rule.block_words * 6:
        aligned = _aligned(texts, [(r["i"], r["p"]) for r in held.orderBy("i", "p").collect()], doc, text, item, kind, rule)
    else:
        aligned = _aligned_by_join(texts, held, size["items"], doc, text, item, kind, rule)
    return _without_stock(materialize(aligned), doc, item, rule).distinct()


_PART = [("sentence", T.LongType(), pa.int64()), ("words", T.IntegerType(), pa.int32()), ("own", T.IntegerType(), pa.int32()), ("total", T.IntegerType(), pa.int32())]
_PART += [("place", T.LongType(), pa.int64()), ("context", T.LongType(), pa.int64()), ("alone", T.BooleanType(), pa.bool_())]
_INDEX: dict[str, _Index] = {}


def _often(rule: LeakRule, items: int) -> float:
    """The number of passages above which a trigram is the template's."""
    return max(rule.template_count, rule.template_share * items)


def _schema(doc_field: T.StructField, item: str, kind: T.DataType) -> T.StructType:
    counts = T.StructType([T.StructField(name, spark_kind) for name, spark_kind, _ in _PART])
    return T.StructType([doc_field, T.StructField(item, kind), T.StructField("enough", T.BooleanType()), T.StructField("parts", T.ArrayType(counts))])


def _aligned(texts, held, doc, text, item, kind, rule) -> DataFrame:
    """The alignments with passages that every task holds."""
    entries, holders = [], Counter()
    for i, p in held:
        words, sentences = _passage(p)
        if len(words) >= rule.k:
            entries.append((i, words, sentences))
            holders.update(set(_trigrams(words)))
    template = {gram for gram, n in holders.items() if n > _often(rule, len(held))}
    shared = texts.sparkSession.sparkContext.broadcast((entries, template))
    part = pa.struct([(name, arrow) for name, _, arrow in _PART])
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(kind, pa.string())
    key = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _INDEX:  # once for each worker, whatever the number of its tasks
            _INDEX.clear()
            _INDEX[key] = _Index(*shared.value, rule)
        index = _INDEX[key]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                found = index.leaks(some.column(1).to_pylist())
                parts = [[dict(zip((name for name, _, _ in _PART), x)) for x in p] for *_, p in found]
                at = some.column(0).take(pa.array([row for row, *_ in found], pa.int64()))
                ids = pa.array([i for _, i, *_ in found], arrow)
                enough = pa.array([bool(x) for _, _, x, _ in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([at, ids, enough, pa.array(parts, pa.list_(part))], names=[doc, item, "enough", "parts"])

    return spread(texts).mapInArrow(search, _schema(texts.schema[doc], item, kind))


def _aligned_by_join(texts, held, items, doc, text, item, kind, rule) -> DataFrame:
    """The alignments with any number of passages, from a join of fingerprints.

    Fingerprints without words of weight 1 can't make a pair, so the template's, which many documents and
    passages have, are not joined; of a text's equal fingerprints the number is.
    """
    held = materialize(held.withColumn("item_key", F.xxhash64("i", "p")))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"gram": [g for p in batch["p"] for g in set(_trigrams(_passage(p)[0]))]}, dtype="int64")

    counted = held.select("p").mapInPandas(grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > _often(rule, items))
    # each is in more than template_share of the passages, so there are at most their mean length by that share
    template = frozenset(r["gram"] for r in counted.collect())

    def item_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, p in zip(batch["item_key"], batch["p"]):
                words = _passage(p)[0]
                _, content = _weights(words, template, rule)
                own: Counter = Counter()
                for code, at in zip(*map(np.ndarray.tolist, _fingerprints(words, rule))):
                    own[code] += content[at + rule.k] - content[at]
                out += [(np.uint64(code).astype(np.int64), key, n) for code, n in own.items() if n]
            yield pd.DataFrame(out, columns=["print", "item_key", "content"]).astype("int64")

    def doc_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, value in zip(batch["doc_key"], batch[text]):
                codes, n = np.unique(_fingerprints(words_of(value), rule)[0], return_counts=True)
                out.append(pd.DataFrame({"print": codes.astype(np.int64), "doc_key": key, "n": n}))
            yield pd.concat(out) if out else pd.DataFrame({"print": [], "doc_key": [], "n": []}, dtype="int64")

    keyed = spread(texts.where(F.col(text).isNotNull()).withColumn("doc_key", F.xxhash64(doc, text)))
    left = keyed.select("doc_key", text).mapInPandas(doc_prints, "print long, doc_key long, n long")
    right = held.select("item_key", "p").mapInPandas(item_prints, "print long, item_key long, content long")
    met = left.join(right, "print").groupBy("doc_key", "item_key").agg(F.sum(F.col("n") * F.col("content")).alias("seeds"))
    met = met.where(F.col("seeds") >= rule.least_seeds).select("doc_key", "item_key")
    pairs = met.join(keyed, "doc_key").join(held, "item_key").select(doc, text, F.col("i").alias(item), "p")
    schema = _schema(texts.schema[doc], item, kind)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes: dict[tuple, _Index] = {}
        for batch in batches:
            out = []
            for d, value, i, p in zip(batch[doc], batch[text], batch[item], batch["p"]):
                if (i, p) not in indexes:
                    if len(indexes) > 2000:
                        indexes.clear()
                    indexes[i, p] = _Index([(i, *_passage(p))], template, rule)
                for _, own, enough, parts in indexes[i, p].leaks([value]):
                    out.append((d, own, bool(enough), [dict(zip((name for name, _, _ in _PART), x)) for x in parts]))
            yield pd.DataFrame(out, columns=[doc, item, "enough", "parts"])

    return pairs.mapInPandas(align, schema)


def _without_stock(aligned: DataFrame, doc: str, item: str, rule: LeakRule) -> DataFrame:
    """The alignments that are long enough without the stock sentences."""
    each = aligned.select(F.explode("parts").alias("x")).where("x.context is not null").select("x.*")
    # what any passage has around a sentence shows that it was taken over with it
    contexts = each.groupBy("sentence", "context").agg(F.min("alone").alias("alone"))
    contexts = contexts.groupBy("sentence").agg(F.count("*").alias("contexts"), F.sum(F.col("alone").cast("long")).alias("lone"))
    places = each.select("sentence", "place").distinct().groupBy("sentence").agg(F.count("*").alias("places"))
    often = contexts.join(places, "sentence").where(F.col("lone") >= rule.stock_lone * F.col("contexts"))
    stock = often.where((F.col("lone") > rule.stock_contexts) | (F.col("places") > 1) & (F.col("lone") > 1)).select("sentence", F.lit(True).alias("stock"))
    numbered = aligned.where("enough").withColumn("_at", F.monotonically_increasing_id())  # before the parts are told apart
    parts = numbered.select("_at", doc, item, F.explode("parts").alias("x"))
    parts = parts.select("_at", doc, item, "x.sentence", "x.words", "x.own", "x.total").join(stock, "sentence", "left").where("stock is null")
    left = parts.groupBy("_at", doc, item).agg(*[F.sum(c).alias(c) for c in ("words", "own", "total")])
    enough = (F.col("words") >= rule.least_words) & (F.col("own") >= F.greatest(F.lit(float(rule.least_content)), rule.least_share * F.col("total")))
    return left.where(enough).select(doc, item)
