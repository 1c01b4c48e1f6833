"""The k most similar vectors of every vector, by learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size, a softmax classifier learns
to tell a vector's part, every vector is stored in its most probable part, and each query visits
the most probable parts, where exact cosines decide. Parts that are too large are cut in the same way, from a
sample of their own, so that parts keep their size however many vectors there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialize


@dataclass(frozen=True)
class IndexRule:
    """Sizes of the index.

    part_size: vectors in a part, from which the number of parts follows; few vectors are cut into least_parts parts of
    least_size and more. most_parts: parts into which one level cuts; parts of more than twice part_size are cut again.
    sample: vectors that a level's graph and classifier are fitted on, at most; every vector is indexed.
    degree: neighbours in the graph. least_probes, most_probes, mass: a query visits its most
    probable parts until they hold `mass` of the probability, within these bounds.
    block: vectors that one task compares at most; larger parts are compared in blocks, wholly.
    """

    part_size: int = 2000
    least_parts: int = 4
    least_size: int = 40
    most_parts: int = 512
    sample: int = 8192
    degree: int = 12
    least_probes: int = 3
    most_probes: int = 8
    mass: float = 0.995
    block: int = 8192
    epochs: int = 80
    seed: int = 17

    def parts(self, count: int) -> int:
        """Parts into which so many vectors are cut at once."""
        return int(min(self.most_parts, max(1, -(-count // self.part_size), min(self.least_parts, count // self.least_size))))


def neighbour_graph(unit: np.ndarray, degree: int) -> np.ndarray:
    """The most similar rows of each row, itself left out."""
    n = len(unit)
    degree = min(degree, n - 1)
    out = np.zeros((n, max(degree, 0)), dtype=np.int32)
    if degree <= 0:
        return out
    for start in range(0, n, 512):
        sims = unit[start : start + 512] @ unit.T
        sims[np.arange(len(sims)), np.arange(start, start + len(sims))] = -2
        out[start : start + 512] = np.argpartition(-sims, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int, passes: int = 8) -> np.ndarray:
    """Part of each node, none larger than 1.1 times the mean; regions grown from seeds, then refined."""
    n = len(graph)
    room = max(1, int(np.ceil(1.1 * n / parts)))
    rng = np.random.default_rng(seed)
    links: list[set[int]] = [set() for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            links[i].add(j)
            links[j].add(i)
    part = np.full(n, -1)
    size = np.zeros(parts, dtype=int)
    fronts: list[list[int]] = [[] for _ in range(parts)]
    free = rng.permutation(n).tolist()
    growing = list(range(parts))
    goal = -(-n // parts)
    while growing:
        still = []
        for p in growing:
            node = -1
            while fronts[p]:
                candidate = fronts[p].pop(0)
                if part[candidate] < 0:
                    node = candidate
                    break
            while node < 0 and free:
                candidate = free.pop()
                if part[candidate] < 0:
                    node = candidate
            if node < 0:
                continue
            part[node] = p
            size[p] += 1
            fronts[p] += [x for x in sorted(links[node]) if part[x] < 0]
            if size[p] < goal:
                still.append(p)
        growing = still
    part[part < 0] = int(np.argmin(size))
    for _ in range(passes):
        moved = 0
        for node in rng.permutation(n).tolist():
            own = part[node]
            counts: dict[int, int] = {}
            for x in links[node]:
                counts[int(part[x])] = counts.get(int(part[x]), 0) + 1
            best = max(counts, key=lambda p: (counts[p], -p), default=own)
            if best != own and counts[best] > counts.get(int(own), 0) and size[best] < room:
                part[node] = best
                size[own] -= 1
                size[best] += 1
                moved += 1
        if not moved:
            break
    return part


def fit_router(unit: np.ndarray, part: np.ndarray, parts: int, epochs: int, seed: int) -> np.ndarray:
    """Weights (with a last row of biases) of a softmax classifier of the part, by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([unit, np.ones((len(unit), 1))], axis=1).astype(np.float32)
    centres = np.zeros((parts, x.shape[1]), dtype=np.float32)
    np.add.at(centres, part, x)
    w = 8 * (centres / np.maximum(1, np.bincount(part, minlength=parts))[:, None]).T
    w[-1] = 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 512):
            own = order[start : start + 512]
            p = _softmax(x[own] @ w)
            p[np.arange(len(own)), part[own]] -= 1
            g = x[own].T @ p / len(own) + 1e-4 * w
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def unit_classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row for each key that has a usable vector: key, class (the least key with an equal direction), vector.

    Null vectors, vectors with null or non-finite values, vectors of zeros and vectors of another
    length than most have no row; repeated rows count once (of differing vectors the least counts).
    """
    each = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(vector).alias("v"))
    usable = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    each = each.where(usable).withColumn("norm", norm).where("norm > 0")
    usual = each.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    each = each.where(F.size("v") == (usual["dim"] if usual else 0))
    direction = F.transform("v", lambda x: F.round(x.cast("double") / F.col("norm"), 6) + F.lit(0.0))
    each = each.withColumn("d", F.xxhash64(direction)).withColumn("e", F.hash(direction))
    least = each.groupBy("d", "e").agg(F.min("k").alias("class"))
    return each.join(least, ["d", "e"]).select("k", "class", "v")


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, rule: IndexRule = IndexRule()) -> DataFrame:
    """key, neighbour, similarity and rank (from 1) of the k most similar other keys of every key.

    Similarity is the cosine, ties go to the smaller key. Keys with equal directions are searched
    once, as a class, and take each other first. Which rows take part is told at unit_classes; fewer
    than k other keys give fewer rows.
    """
    members = materialize(unit_classes(df, key, vector))
    heads = members.where("k = class").select("class", "v")
    found = _by_parts(heads, k, heads.count(), rule)
    order = Window.partitionBy("class").orderBy(F.desc("similarity"), "neighbour")
    close = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    first = Window.partitionBy("class").orderBy("k")
    few = members.select("class", "k", F.row_number().over(first).alias("r")).where(F.col("r") <= k + 1).drop("r")
    own = few.select("class", F.col("k").alias("neighbour"), F.lit(1.0).alias("similarity"), F.lit(1).alias("same"))
    other = close.join(few.select(F.col("class").alias("neighbour"), F.col("k").alias("n")), "neighbour").select(
        "class", F.col("n").alias("neighbour"), "similarity", F.lit(0).alias("same")
    )
    by_class = Window.partitionBy("class").orderBy(F.desc("same"), F.desc("similarity"), "neighbour")
    ranked = own.union(other).withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    listed = ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "similarity"))).alias("all"))
    others = F.filter("all", lambda x: x["neighbour"] != F.col("k"))
    return (
        members.select("k", "class")
        .join(listed, "class")
        .withColumn("others", F.slice(others, 1, k))
        .select("k", F.posexplode("others").alias("at", "x"))
        .select(F.col("k").alias(key), F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity"), (F.col("at") + 1).alias("rank"))
    )


def _rerank(queries: pd.DataFrame, stored: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k most similar stored classes of each query, by exact cosine."""
    if not len(queries) or not len(stored):
        return pd.DataFrame({"class": [], "neighbour": [], "similarity": []})
    q, s = _unit(queries["v"]), _unit(stored["v"])
    qid, sid = queries["class"].to_numpy(), stored["class"].to_numpy()
    coarse = s.astype(np.float32)
    keep = min(len(s), k + 9)
    out = []
    for start in range(0, len(q), 1024):
        own = q[start : start + 1024]
        sims = own.astype(np.float32) @ coarse.T
        top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        exact = np.round(np.einsum("ij,ikj->ik", own, s[top]), 9)
        ids = sid[top]
        exact[ids == qid[start : start + 1024, None]] = -3
        order = np.lexsort((ids, -exact), axis=1)[:, :k]
        rows = np.arange(len(own))[:, None]
        best, near = exact[rows, order].ravel(), ids[rows, order].ravel()
        who = np.repeat(qid[start : start + 1024], order.shape[1])
        out.append(pd.DataFrame({"class": who, "neighbour": near, "similarity": best})[best > -2])
    return pd.concat(out)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _schema(heads: DataFrame) -> str:
    kind = heads.schema["class"].dataType.simpleString()
    return f"class {kind}, neighbour {kind}, similarity double"


def _anew(df: DataFrame) -> DataFrame:
    """The same columns as new ones, so that two uses of a frame can be told apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _fitted(unit: np.ndarray, count: int, rule: IndexRule) -> np.ndarray:
    """The router of so many vectors, fitted on a sample of them."""
    parts = min(rule.parts(count), max(1, len(unit)))
    part = balanced_parts(neighbour_graph(unit.astype(np.float32), rule.degree), parts, rule.seed)
    return fit_router(unit, part, parts, rule.epochs, rule.seed)


def _visits(vectors: pd.Series, w: np.ndarray, rule: IndexRule) -> list[list[int]]:
    """The parts that each query visits, its own first."""
    p = _softmax(_unit(vectors).astype(np.float32) @ w[:-1] + w[-1])
    order = np.argsort(-p, axis=1)[:, : rule.most_probes]
    held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    visits = np.minimum(order.shape[1], np.maximum(rule.least_probes, (held < rule.mass).sum(axis=1) + 1))
    return [o[:n].tolist() for o, n in zip(order, visits)]


def _by_parts(heads: DataFrame, k: int, count: int, rule: IndexRule) -> DataFrame:
    """The k most similar of the visited parts, for every class."""
    spark = heads.sparkSession
    kind, array = heads.schema["class"].dataType.simpleString(), heads.schema["v"].dataType.simpleString()
    chosen = heads.orderBy(F.xxhash64("class", F.lit(rule.seed)), "class").limit(rule.sample).toPandas()
    if not len(chosen):
        return spark.createDataFrame([], _schema(heads))
    router = spark.sparkContext.broadcast(_fitted(_unit(chosen["v"]), count, rule))

    def route(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=_visits(batch["v"], router.value, rule))

    routed = materialize(heads.mapInPandas(route, f"class {kind}, v {array}, parts array<int>"))
    stored = routed.select("class", "v", F.array(F.col("parts")[0]).alias("path"))
    queries = routed.select("class", "v", F.explode("parts").alias("part")).select("class", "v", F.array("part").alias("path"))
    return _compared(*_cut_again(stored, queries, rule), k, rule)


def _cut_again(stored: DataFrame, queries: DataFrame, rule: IndexRule) -> tuple[DataFrame, DataFrame]:
    """Both sides with longer paths where a part holds more than twice part_size, until none does."""
    kind, array = stored.schema["class"].dataType.simpleString(), stored.schema["v"].dataType.simpleString()
    while True:
        sizes = materialize(stored.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 2 * rule.part_size))
        large = sizes.agg(F.count("*").alias("parts"), F.max("n").alias("n")).first()
        if not large["parts"]:
            return stored, queries
        inside = stored.join(sizes, "path")
        first = Window.partitionBy("path").orderBy(F.xxhash64("class", F.lit(rule.seed)), "class")
        samples = inside.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rule.sample)

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            w = _fitted(_unit(rows["v"]), int(rows["n"].iloc[0]), rule)
            return pd.DataFrame({"path": [rows["path"].iloc[0]], "width": [w.shape[1]], "router": [w.ravel().tolist()]})

        routers = materialize(samples.groupBy("path").applyInPandas(fit, "path array<int>, width int, router array<float>"))

        def cut(df: DataFrame, visit: bool) -> DataFrame:
            """The rows of large parts with their sub-parts; a part meets its router in turns of block rows."""
            turns = df.join(sizes, "path", "left_semi").groupBy("path").agg(F.ceil(F.count("*") / rule.block).cast("int").alias("turns"))
            rows = df.join(turns, "path").withColumn("turn", F.pmod(F.xxhash64("class"), F.col("turns")).cast("int"))
            meets = routers.join(turns, "path").select(*[F.col(c).alias(c) for c in ("path", "width", "router")], F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))

            def route(own: pd.DataFrame, routed: pd.DataFrame) -> pd.DataFrame:
                if not len(own) or not len(routed):
                    return pd.DataFrame({"class": [], "v": [], "path": []})
                w = np.asarray(routed["router"].iloc[0], dtype=np.float32).reshape(-1, int(routed["width"].iloc[0]))
                visits = _visits(own["v"], w, rule)
                paths = [[[*path, p] for p in (v if visit else v[:1])] for path, v in zip(own["path"], visits)]
                return own[["class", "v"]].assign(path=paths).explode("path", ignore_index=True)

            again = rows.groupBy("path", "turn").cogroup(meets.groupBy("path", "turn")).applyInPandas(route, f"class {kind}, v {array}, path array<int>")
            return materialize(df.join(sizes, "path", "left_anti").select("class", "v", "path").unionByName(again))

        before = large["n"]
        stored, queries = cut(stored, False), cut(queries, True)
        now = stored.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if now >= before:  # vectors that no router tells apart: they are compared in blocks
            return stored, queries


def _compared(stored: DataFrame, queries: DataFrame, k: int, rule: IndexRule) -> DataFrame:
    """Each query's k most similar of every part that it visits, by exact cosine, in blocks of both sides."""
    held = stored.groupBy("path").agg(F.ceil(F.count("*") / rule.block).cast("int").alias("blocks"))
    asked = queries.groupBy("path").agg(F.ceil(F.count("*") / rule.block).cast("int").alias("turns"))
    sizes = materialize(held.join(asked, "path"))  # a row for each part
    stored = stored.join(sizes, "path").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    stored = stored.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    queries = queries.join(sizes, "path").withColumn("turn", F.pmod(F.xxhash64("class"), F.col("turns")).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    on = ["path", "block", "turn"]
    return (
        queries.select(*on, "class", "v")
        .groupBy(on)
        .cogroup(_anew(stored.select(*on, "class", "v")).groupBy(on))
        .applyInPandas(lambda q, s: _rerank(q, s, k), _schema(stored))
    )


def skipped(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and reason of the rows that take no part in the search: null_key, null_vector, not_finite, zeros or other_length."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zeros = ~F.exists(vector, lambda x: x != 0)
    reason = F.when(F.col(key).isNull(), "null_key").when(F.col(vector).isNull(), "null_vector").when(bad, "not_finite").when(zeros, "zeros")
    told = df.select(F.col(key).alias("k"), F.size(vector).alias("dim"), reason.alias("reason"))
    usual = told.where("reason is null").groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    other = F.when(F.col("reason").isNull() & (F.col("dim") != F.lit(usual["dim"] if usual else 0)), "other_length")
    return told.select(F.col("k").alias(key), F.coalesce("reason", other).alias("reason")).where("reason is not null").distinct()


def nearest_pairs(df: DataFrame, key: str, vector: str, k: int = 5, rule: IndexRule = IndexRule()) -> DataFrame:
    """<key>_a and <key>_b, smaller first, of every two keys of which one is among the other's k most similar."""
    found = nearest(df, key, vector, k, rule)
    return found.select(
        F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")
    ).distinct()
