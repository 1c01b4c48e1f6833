"""Joins of sets by Jaccard similarity with prefix, length and positional filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slack for sizes computed from a threshold in floating point.
_SLACK = 1e-9


def best_matches(left: DataFrame, right: DataFrame, threshold: float, keep: str | None = "best") -> DataFrame:
    """left_id, right_id, jaccard of pairs of sets (column items, each item once) that reach the threshold.

    Items are ordered by how rare they are on both sides together. Two sets that reach the threshold
    share an item among the first n - ceil(threshold * n) + 1 of each, so only these are joined; a
    pair goes on if the sizes allow the threshold and so do the places of the item they meet at. The
    Jaccard similarity is then exact. keep "best": only the most similar partner of each left set,
    ties to the smaller right_id. Null and empty sets have no partner.
    """
    sides = [x.where("size(items) > 0") for x in (left, right)]
    ranks = sides[0].select(F.explode("items").alias("item")).unionAll(sides[1].select(F.explode("items").alias("item")))
    ranks = ranks.groupBy("item").agg(F.count("*").alias("often"))
    prefixes = [_prefix(x, f"{side}_id", ranks, threshold, side) for x, side in zip(sides, ("left", "right"))]
    met = prefixes[0].join(prefixes[1], "item")
    met = met.where(f"right_size >= {threshold} * left_size - {_SLACK} and left_size >= {threshold} * right_size - {_SLACK}")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("left_size") + F.col("right_size")) - _SLACK)
    possible = 1 + F.least(F.col("left_size") - F.col("left_at") - 1, F.col("right_size") - F.col("right_at") - 1)
    # the first common item of both orders bounds the overlap; later ones can't be judged alone, so the best bound counts
    candidates = met.withColumn("possible", possible).withColumn("least", least).groupBy("left_id", "right_id").agg(
        F.max("possible").alias("possible"), F.first("least").alias("least")
    )
    candidates = candidates.where("possible >= least").select("left_id", "right_id")
    own = sides[0].select("left_id", F.col("items").alias("left_items"))
    other = sides[1].select("right_id", F.col("items").alias("right_items"))
    common = F.size(F.array_intersect("left_items", "right_items"))
    pairs = candidates.join(own, "left_id").join(other, "right_id").withColumn("common", common)
    jaccard = F.col("common") / (F.size("left_items") + F.size("right_items") - F.col("common"))
    pairs = pairs.select("left_id", "right_id", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold - _SLACK)
    if keep is None:
        return pairs
    best = pairs.groupBy("left_id").agg(F.min_by(F.struct("right_id", "jaccard"), F.struct(-F.col("jaccard"), "right_id")).alias("b"))
    return best.select("left_id", "b.right_id", "b.jaccard")


def _prefix(df: DataFrame, key: str, ranks: DataFrame, threshold: float, side: str) -> DataFrame:
    """One row for each item in the prefix of each set: key, item, its place and the set's size."""
    each = df.select(key, F.explode("items").alias("item")).join(ranks, "item")
    ordered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("x"))
    size = F.size("x")
    length = size - F.ceil(F.lit(threshold) * size - _SLACK).cast("int") + 1
    return ordered.select(key, size.alias(f"{side}_size"), F.posexplode(F.slice("x", F.lit(1), length)).alias(f"{side}_at", "y")).select(
        key, f"{side}_size", f"{side}_at", F.col("y.item").alias("item")
    )
