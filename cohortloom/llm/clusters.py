"""Clusters of mutually similar short records, by distributed k-means on hashed weighted features.

A record becomes a sparse vector: what it is about (its head) and what else it states, each word by the part it
plays, hashed and weighted by rarity. K-means over the different heads, with seeds from parallel
oversampled rounds, places the records in cells, which are shared out to the tasks; in each cell k-means over the whole
vectors of each head goes on with seeds, again oversampled in rounds, until every record is near a centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import canonical, terms
from cohortloom.session import materialize

#: Words that tell what part the next word plays, and words without meaning here.
PARTS = {
    "since": "onset", "for": "onset", "this": "onset", "on": "onset", "at": "onset",
    "during": "occasion", "while": "occasion", "after": "occasion", "post": "occasion",
    "with": "company", "and": "company", "also": "company", "associated": "company",
}
SILENT = frozenset("left right bilateral a an the of in to".split())
#: Fixed value: a time that is told like an occasion.
TIMES = frozenset({"sleep"})


@dataclass(frozen=True)
class ClusterRule:
    """k: cells, whatever the number of records; rounds: of oversampling, each drawing about oversampling * k seeds, which are
    reduced to k; steps: of k-means, there and in each cell; width: of the heads' hashed vectors.

    least: cosine of a member to its centroid. head: weight of the head beside 1 for each other part, both less for
    frequent words. A record that lacks one of three parts has a cosine of 0.87 to its story, one that differs in one of 0.75.
    slip: cosine from which records may differ by slips alone, each part of a few edits: a single record from any larger
    cluster, several records from one that is `rarer` times as large.
    cell_points: different contents that a task clusters, about; a cell with more is cut between heads.
    Neither k nor cell_points changes a cluster, as what has different heads is never compared.
    """

    k: int = 64
    rounds: int = 3
    oversampling: float = 2.0
    steps: int = 2
    width: int = 256
    least: float = 0.8
    head: float = 1.0
    slip: float = 0.6
    rarer: float = 4.0
    cell_points: int = 4096
    seed: int = 11


def story_parts(words: list[str], heads: list[bool]) -> list[str]:
    """part:word of the words that say something; words of the list without a lead are the head."""
    out, lead = set(), ""
    for word, head in zip(words, heads):
        if word in PARTS:
            lead = PARTS[word]
        elif word not in SILENT:
            part = "onset" if word in TIMES else lead or ("head" if head else "onset")
            out.add(f"{part}:{word}")
            lead = ""
    return sorted(out)


def story_points(values: DataFrame, key: str, text: str, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, points): key, text and point of all that every record says; point, parts and weight (in records) of each different content."""
    values = values.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null").distinct()
    said, _, heads = canonical.wordings(values, "text", reference, "ref_id", "preferred_term", "entry_terms")
    each = said.select("text", F.posexplode("words").alias("at", "word")).join(heads.withColumn("head", F.lit(True)), "word", "left")
    told = F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("head", F.lit(False)).alias("head"))))
    each = each.groupBy("text").agg(told.alias("x"))
    each = each.select("text", F.transform("x", lambda x: x["word"]).alias("words"), F.transform("x", lambda x: x["head"]).alias("heads"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "parts": [story_parts(list(w), list(h)) for w, h in zip(batch["words"], batch["heads"])]})

    parsed = each.mapInPandas(parse, "text string, parts array<string>").where("size(parts) > 0")
    members = values.join(parsed, "text")
    members = materialize(members.withColumn("point", F.concat_ws("-", F.xxhash64("parts"), F.hash("parts"))))
    once = members.groupBy("point", "key").agg(F.first("parts").alias("parts"))
    points = materialize(once.groupBy("point").agg(F.first("parts").alias("parts"), F.count("*").alias("weight")))
    return members.select("key", "text", "point"), points


def features(points: DataFrame, rule: ClusterRule = ClusterRule()) -> DataFrame:
    """point, weight, head (hashed) and arrays of hashed features and values: the joint head and each other part, rarer words
    with more weight, up to that of the word that is as rare as most."""
    whole = F.array_join(F.filter("parts", lambda x: x.startswith("head:")), "|")
    rest = F.filter("parts", lambda x: ~x.startswith("head:"))
    rows = points.select("point", "weight", F.xxhash64(whole).alias("head"), F.concat(F.array(whole), rest).alias("said"))
    each = rows.select("point", "weight", "head", F.posexplode("said").alias("at", "word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"), F.first(F.col("at") == 0).alias("is_head"))
    size = points.count()
    rarity = F.log(1.0 + F.lit(float(size)) / F.col("often"))
    often = materialize(often.withColumn("rarity", rarity))
    usual = {r["is_head"]: r["m"] for r in often.groupBy("is_head").agg((F.sum(F.col("rarity") * F.col("often")) / F.sum("often")).alias("m")).collect()}
    mean = F.when(F.col("is_head"), F.lit(usual.get(True, 1.0))).otherwise(F.lit(usual.get(False, 1.0)))
    value = F.least(F.lit(1.0), F.col("rarity") / mean) * F.when(F.col("is_head"), F.lit(rule.head)).otherwise(1.0)
    values = each.join(often.select("word", value.alias("value")), "word").groupBy("point", "weight", "head")
    pairs = F.array_sort(F.collect_list(F.struct(F.xxhash64("word").alias("f"), F.col("value").alias("v"))))
    out = values.agg(pairs.alias("x"))
    return out.select("point", "weight", "head", F.transform("x", lambda x: x["f"]).alias("features"), F.transform("x", lambda x: x["v"]).alias("values"))


def head_vectors(points: DataFrame, rule: ClusterRule) -> DataFrame:
    """head, weight and v, a unit vector of hashed words weighted by rarity, of every different head."""
    words = F.filter("parts", lambda x: x.startswith("head:"))
    heads = points.select(F.array_join(words, "|").alias("h"), words.alias("words"), "weight").groupBy("h").agg(F.first("words").alias("words"), F.sum("weight").alias("weight"))
    heads = materialize(heads)
    size = heads.count()
    each = heads.select("h", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.log(1.0 + F.lit(float(size)) / F.count("*")).alias("rarity"))
    each = each.join(often, "word").groupBy("h").agg(F.collect_list(F.struct(F.xxhash64("word").alias("f"), "rarity")).alias("x"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own in batch["x"]:
                v = np.zeros(rule.width, dtype=np.float32)
                for x in own:
                    v[x["f"] % rule.width] += x["rarity"] * (1 if x["f"] >> 32 & 1 else -1)
                out.append((v / max(1e-9, float(np.linalg.norm(v)))).tolist())
            yield pd.DataFrame({"h": batch["h"], "v": out})

    vectors = each.mapInPandas(hashed, "h string, v array<float>")
    return heads.select("h", "weight").join(vectors, "h", "left").select(F.xxhash64("h").alias("head"), "weight", F.coalesce("v", F.array_repeat(F.lit(0.0).cast("float"), rule.width)).alias("v"))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float32)


def _reduced(seeds: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the seeds by weighted k-means++."""
    rng = np.random.default_rng(seed)
    chosen = [int(np.argmax(weights))]
    cost = 1 - seeds @ seeds[chosen[0]]
    while len(chosen) < min(k, len(seeds)):
        p = np.maximum(0, cost) * weights
        if p.sum() <= 1e-9:
            break
        chosen.append(int(rng.choice(len(seeds), p=p / p.sum())))
        cost = np.minimum(cost, 1 - seeds @ seeds[chosen[-1]])
    return seeds[chosen]


def _measured(heads: DataFrame, centroids: np.ndarray) -> DataFrame:
    """head, weight, v, cell and cost of every head with centroids that each task holds, of which there are about as many as the rule's seeds."""
    shared = heads.sparkSession.sparkContext.broadcast(centroids)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _stack(batch["v"]) @ shared.value.T
                yield batch.assign(cell=near.argmax(axis=1).astype("int32"), cost=(2 - 2 * near.max(axis=1)).astype(float))

    return heads.select("head", "weight", "v").mapInPandas(measure, "head long, weight long, v array<float>, cell int, cost double")


def head_cells(heads: DataFrame, rule: ClusterRule) -> DataFrame:
    """head and cell: k-means over the different heads, weighted by their records, with seeds from parallel oversampled rounds."""
    first = heads.orderBy(F.xxhash64("head", F.lit(rule.seed))).limit(1).collect()
    if not first:
        return heads.select("head", F.lit(0).alias("cell"))
    seeds = np.array([first[0]["v"]], dtype=np.float32)
    chance = lambda r: F.pmod(F.xxhash64("head", F.lit(rule.seed + r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for r in range(1, rule.rounds + 1):
        cost = materialize(_measured(heads, seeds).select("head", "v", (F.col("cost") * F.col("weight")).alias("cost")))
        total = cost.agg(F.sum("cost")).first()[0] or 0.0
        if total <= 1e-9:
            break
        drawn = cost.where(chance(r) < F.lit(rule.oversampling * rule.k / total) * F.col("cost")).select("v").collect()  # about oversampling * k
        seeds = np.concatenate([seeds, np.array([d["v"] for d in drawn], dtype=np.float32).reshape(-1, rule.width)])
    held = {c["cell"]: c["w"] for c in _measured(heads, seeds).groupBy("cell").agg(F.sum("weight").alias("w")).collect()}
    centroids = _reduced(seeds, np.array([held.get(i, 0) for i in range(len(seeds))], dtype=float) + 1e-9, rule.k, rule.seed)
    for _ in range(rule.steps):
        centroids = _moved(_measured(heads, centroids), centroids)
    return _measured(heads, centroids).select("head", "cell")


def _moved(measured: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The unit vector of each cell's weighted mean; a cell without heads stays. Each task sums its own rows first."""
    size, width = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, width))
        for batch in batches:
            np.add.at(total, batch["cell"].to_numpy(), _stack(batch["v"]) * batch["weight"].to_numpy()[:, None])
        own = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"cell": own, "v": [total[i].tolist() for i in own]})

    each = measured.mapInPandas(sums, "cell int, v array<double>").select("cell", F.posexplode("v").alias("at", "v"))
    out = centroids.astype(np.float64).copy()
    out[[r["cell"] for r in each.select("cell").distinct().collect()]] = 0
    for r in each.groupBy("cell", "at").agg(F.sum("v").alias("v")).collect():  # k times width numbers
        out[r["cell"], r["at"]] = r["v"]
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def _story_clusters(rows: pd.DataFrame, rule: ClusterRule) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (the place of a row that stands for it) and cosine of each row of a cell, by k-means over whole vectors.

    Each head is clustered by itself, so that it doesn't matter which heads share the cell.
    """
    columns = {c: rows[c].to_numpy() for c in ("point", "head", "weight", "features", "values", "parts")}
    heads = columns["head"]
    order = np.lexsort((columns["point"], heads))
    cluster, cosine = np.arange(len(rows)), np.ones(len(rows))
    for at in np.split(order, np.flatnonzero(np.diff(heads[order])) + 1):
        if len(at) > 1:
            own, near = _head_clusters({c: v[at] for c, v in columns.items()}, rule)
            cluster[at], cosine[at] = at[own], near
    return cluster, cosine


def _head_clusters(rows: dict[str, np.ndarray], rule: ClusterRule) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and cosine of each row of a head.

    Seeds are drawn in rounds from the rows that no seed is near to, in proportion to weight, until none is left;
    of seeds near each other the one that says more, then the heavier one, stays.
    """
    ids, columns = np.unique(np.concatenate(rows["features"]), return_inverse=True)
    sizes = np.array([len(f) for f in rows["features"]])
    x = np.zeros((len(sizes), len(ids)), dtype=np.float32)
    x[np.repeat(np.arange(len(x)), sizes), columns] = np.concatenate(rows["values"])
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    weight = rows["weight"].astype(float)
    rank = np.lexsort((rows["point"], -weight, -sizes))
    place = np.empty(len(x), dtype=int)
    place[rank] = np.arange(len(x))
    kept = _spread_seeds(x, weight * sizes, place, rule)
    centroids, mass = x[kept], np.ones(len(kept))
    for _ in range(rule.steps):
        own, cosine = _assigned(x, centroids, mass, rule.least)
        near = cosine >= rule.least
        mass = 1 + np.bincount(own[near], weights=weight[near], minlength=len(kept))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own[near], (x * weight[:, None].astype(np.float32))[near])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(1e-9, norm), centroids)
    own, cosine = _assigned(x, centroids, mass, rule.least)
    cluster = np.array(kept)[own]
    alone = cosine < rule.least
    cluster[alone], cosine[alone] = np.flatnonzero(alone), 1.0
    return _without_slips(x, rows["parts"].tolist(), weight, place, cluster, cosine, rule)


def _without_slips(
    x: np.ndarray, parts: list[list[str]], weight: np.ndarray, place: np.ndarray, cluster: np.ndarray, cosine: np.ndarray, rule: ClusterRule
) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and cosine, with clusters that differ by slips that make another word put to the one they are slips of.

    Every row of every larger cluster is a candidate; the nearest row that explains all that differs counts, then the larger cluster.
    """
    total = np.bincount(cluster, weights=weight, minlength=len(x))
    size = total[cluster]
    rank = np.argsort(place)
    names, first = np.unique(cluster[rank], return_index=True)
    best = rank[first]  # the row of each cluster that says most
    to: dict[int, tuple[int, int]] = {}
    for start in range(0, len(names), 1024):
        close = (x[best[start : start + 1024]] @ x.T).round(4)
        for name, i, near in zip(names[start : start + 1024].tolist(), best[start : start + 1024].tolist(), close):
            larger = size > 1 if total[name] <= 1 else size >= rule.rarer * total[name]
            rows = np.flatnonzero(larger & (near >= rule.slip) & (cluster != name))
            for j in rows[np.lexsort((place[rows], -size[rows], -near[rows]))].tolist():
                if _slipped(parts[i], parts[j]):
                    to[name] = int(cluster[j]), j
                    break
    moved, cosine = cluster.copy(), cosine.copy()
    for name in to:
        last, own = name, np.flatnonzero(cluster == name)
        while last in to:  # a slip may be one of another slip; each step leads to a larger cluster
            last = to[last][0]
        moved[own], cosine[own] = last, x[own] @ x[to[name][1]]
    return moved, cosine


def _leaders(x: np.ndarray, candidates: list[int], place: np.ndarray, least: float) -> list[int]:
    """The candidates, best places first, that no better one is near to."""
    out: list[int] = []
    for i in sorted(candidates, key=place.__getitem__):
        if not out or (x[out] @ x[i]).max() < least:
            out.append(i)
    return out


def _spread_seeds(x: np.ndarray, share: np.ndarray, place: np.ndarray, rule: ClusterRule) -> list[int]:
    """Seeds near which every row lies. place: rows that say more, then heavier ones, come first."""
    rng = np.random.default_rng(rule.seed)
    kept: list[int] = []
    left = np.arange(len(x))
    while len(left):
        drawn = left[rng.random(len(left)) < rule.oversampling * rule.k * share[left] / share[left].sum()] if len(left) > rule.k else left
        if not len(drawn):
            drawn = left[[int(place[left].argmin())]]
        kept += _leaders(x, drawn.tolist(), place, rule.least)
        # each seed gives way to the best row near it, so that what lacks a part doesn't stand for what states it
        best = []
        for start in range(0, len(kept), 512):
            near = x[kept[start : start + 512]] @ x.T >= rule.least
            best += np.where(near, place[None, :], len(x)).argmin(axis=1).tolist()
        kept = _leaders(x, sorted(set(best)), place, rule.least)
        near = np.concatenate([(x[left[a : a + 1024]] @ x[kept].T).max(axis=1) for a in range(0, len(left), 1024)])
        rest = left[near < rule.least]
        if len(rest) == len(left):  # the seeds that gave way left nothing new covered
            kept += _leaders(x, rest.tolist(), place, rule.least)
            break
        left = rest
    return kept


def _slipped(parts: list[str], others: list[str]) -> bool:
    """Whether all that one record states and the other doesn't is a slip of what the other has in that part."""
    own, rest = set(parts) - set(others), set(others) - set(parts)
    for part in own:
        kind, word = part.split(":", 1)
        most = 2 if len(word) >= 7 else 1
        if kind == "head" or not any(x.startswith(f"{kind}:") and terms.edits(word, x.split(":", 1)[1], most) <= most for x in rest):
            return False
    return bool(own)


def _assigned(x: np.ndarray, centroids: np.ndarray, mass: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and cosine of each row: the heaviest of the centroids that are near, then the nearest; where none is near, the nearest.

    Only a record that lacks a part is near to several.
    """
    own, cosine = np.empty(len(x), dtype=int), np.empty(len(x), dtype=np.float32)
    for start in range(0, len(x), 1024):
        near = x[start : start + 1024] @ centroids.T
        score = np.where(near >= least, 2 + mass[None, :] + near, near)
        own[start : start + 1024] = score.argmax(axis=1)
        cosine[start : start + 1024] = np.take_along_axis(near, score.argmax(axis=1)[:, None], axis=1)[:, 0]
    return own, cosine


def cluster_stories(values: DataFrame, key: str, text: str, reference: DataFrame, rule: ClusterRule = ClusterRule()) -> DataFrame:
    """key, cluster, cosine (to the cluster's centroid), size (of the cluster, in records) and texts (with their cosines) of every record.

    A record with several complaints has a row for the cluster of each.
    Records tell the same if their head, onset, occasion and company, as far as stated, do, in
    whatever spelling and the wording the reference list knows. Records near no centroid
    form clusters of the records with the same content, which join a larger one that they differ from by slips.
    Null and blank texts have no row; repeated rows count once. What one head has in different contents is
    clustered by one task; copies are only weights there.
    """
    members, points = story_points(values, key, text, reference)
    cells = head_cells(materialize(head_vectors(points, rule)), rule)
    placed = materialize(features(points, rule).join(cells, "head").join(points.select("point", "parts"), "point"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / rule.cell_points).cast("int").alias("turns"))
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("turn", F.pmod("head", F.col("turns")))  # a row for each of the k cells

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        own, cosine = _story_clusters(rows, rule)
        points = rows["point"].to_numpy()
        return pd.DataFrame({"point": points, "cluster": ["c" + p for p in points[own]], "cosine": cosine.astype(float)})

    found = materialize(placed.groupBy("cell", "turn").applyInPandas(cluster, "point string, cluster string, cosine double"))
    texts = F.map_from_entries(F.collect_list(F.struct("text", "cosine")))
    told = members.join(found, "point").groupBy("key", "cluster").agg(F.max("cosine").alias("cosine"), texts.alias("texts"))
    sized = told.groupBy("cluster").agg(F.count("*").alias("size"))
    return told.join(sized, "cluster").select(F.col("key").alias(key), "cluster", "cosine", "size", "texts")


def same_cluster_pairs(clustered: DataFrame, key: str) -> DataFrame:
    """<key>_a and <key>_b, smaller first, of every two records of a cluster, once. Large clusters are paired in blocks.

    Two records that share several clusters are paired in the first of those.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / 1024)).cast("int")
    every = F.collect_set("cluster").over(Window.partitionBy(key))
    each = clustered.select(key, "cluster", blocks.alias("blocks"), every.alias("every")).withColumn("several", F.when(F.size("every") > 1, F.col("every")))
    each = each.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    turns = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = each.select("cluster", F.col(key).alias(f"{key}_a"), F.col("several").alias("a"), "block", turns.alias("with"))
    right = each.select("cluster", F.col(key).alias(f"{key}_b"), F.col("several").alias("b"), F.col("block").alias("with"))
    right = right.join(each.select("cluster", "block").distinct(), "cluster")
    pairs = left.join(right, ["cluster", "block", "with"])
    first = F.col("a").isNull() | F.col("b").isNull() | (F.array_min(F.array_intersect("a", "b")) == F.col("cluster"))
    return pairs.where((F.col(f"{key}_a") < F.col(f"{key}_b")) & first).select(f"{key}_a", f"{key}_b")


def describe_clusters(clustered: DataFrame, values: DataFrame, key: str, text: str, typical: int = 3) -> DataFrame:
    """cluster, size and typical (the texts of the members nearest to the centroid, different ones, by cosine and text)."""
    said = clustered.join(values.select(key, F.col(text).alias("text")).distinct(), key)
    said = said.withColumn("cosine", F.try_element_at("texts", F.col("text"))).where("cosine is not null")
    each = said.groupBy("cluster", "size", "text").agg(F.max("cosine").alias("cosine"), F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("cosine"), F.desc("n"), "text")
    top = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
    return top.groupBy("cluster", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("typical"))
