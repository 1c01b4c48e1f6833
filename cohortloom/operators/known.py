"""Attributes of an entity as they were known at the time of an event.

Per entity a path-copied search tree is kept: each entry that becomes known gives a new root, and
the old roots stay valid. An event takes the root of the last entry known before it and searches
it by the end of validity. Entries and events lie in ranges of entity and time, so that an entity with
very many rows has several shards; what was entered in earlier shards is handed on as one entry
for each attribute.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators import ranges
from cohortloom.session import materialize

#: Microseconds that stand for no end of validity, and for known before everything.
_NEVER, _ALWAYS = (1 << 62), -(1 << 62)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def clean_name(name: Column) -> Column:
    """A name without case and blanks, null if nothing is left."""
    bare = F.regexp_replace(F.lower(name), r"(?U)\s+", "")
    return F.when(bare != "", bare)


class _Node:
    """A node of the treap: entries in it and below that are valid until `end` and later ends."""

    __slots__ = ("end", "rank", "own", "below", "left", "right")

    def __init__(self, end: int, rank: int, own: int, left: _Node | None, right: _Node | None) -> None:
        self.end, self.rank, self.own, self.left, self.right = end, rank, own, left, right
        self.below = own | (left.below if left else 0) | (right.below if right else 0)


def _insert(node: _Node | None, end: int, rank: int, own: int) -> _Node:
    """A new root with one more entry; nodes off its path are shared with the old one."""
    if node is None:
        return _Node(end, rank, own, None, None)
    if end == node.end:
        return _Node(end, node.rank, node.own | own, node.left, node.right)
    if end < node.end:
        left = _insert(node.left, end, rank, own)
        if left.rank > node.rank:
            return _Node(left.end, left.rank, left.own, left.left, _Node(node.end, node.rank, node.own, left.right, node.right))
        return _Node(node.end, node.rank, node.own, left, node.right)
    right = _insert(node.right, end, rank, own)
    if right.rank > node.rank:
        return _Node(right.end, right.rank, right.own, _Node(node.end, node.rank, node.own, node.left, right.left), right.right)
    return _Node(node.end, node.rank, node.own, node.left, right)


def _valid_after(node: _Node | None, time: int) -> int:
    """The attributes in a tree whose end is later than a time."""
    found = 0
    while node is not None:
        if node.end > time:
            found |= node.own | (node.right.below if node.right else 0)
            node = node.left
        else:
            node = node.right
    return found


class KnownHistory:
    """All versions of one entity's tree."""

    def __init__(self, entries: list[tuple[int, int, int]]) -> None:
        """entries: time known, end of validity and bit of the attribute."""
        self.times: list[int] = []
        self.roots: list[_Node] = []
        root: _Node | None = None
        for known, end, bit in sorted(entries):
            root = _insert(root, end, (end * 0x9E3779B97F4A7C15 ^ (end >> 13)) & 0xFFFFFFFF, 1 << bit)
            if self.times and self.times[-1] == known:
                self.roots[-1] = root
            else:
                self.times.append(known)
                self.roots.append(root)

    def at(self, time: int) -> int:
        """Attributes known strictly before a time and still valid strictly after it."""
        i = bisect_left(self.times, time)
        return _valid_after(self.roots[i - 1], time) if i else 0


def _search(rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
    """Each event of a shard with its attributes. rows: entries and events; carried: entries of earlier shards."""
    is_event = rows["is_event"].to_numpy(dtype=bool)
    entries = pd.concat([carried[["entity", "time", "ends", "attribute"]], rows.loc[~is_event, ["entity", "time", "ends", "attribute"]]])
    names = sorted(set(entries["attribute"]))
    bit = {name: i for i, name in enumerate(names)}
    by_entity: dict = {}
    for entity, known, end, name in zip(entries["entity"], entries["time"], entries["ends"], entries["attribute"]):
        by_entity.setdefault(entity, []).append((int(known), int(end), bit[name]))
    histories: dict = {}
    lists: dict[int, list[str]] = {0: []}
    out = []
    events = rows[is_event]
    for entity, time in zip(events["entity"], events["time"]):
        history = histories.get(entity)
        if history is None:
            history = histories[entity] = KnownHistory(by_entity.get(entity, []))
        mask = history.at(int(time))
        if mask not in lists:
            lists[mask] = [name for name in names if mask >> bit[name] & 1]
        out.append(lists[mask])
    return events[["event"]].assign(attributes=pd.Series(out, index=events.index, dtype=object))


def as_known(
    events: DataFrame,
    records: DataFrame,
    entity: str,
    event: str,
    event_time: str,
    attribute: str,
    known_time: str,
    end_time: str,
    shard_rows: int = 100_000,
) -> DataFrame:
    """event and attributes (sorted names) of every event: what was on record at its time.

    An entry is on record if known_time is strictly earlier than the event and end_time is null or
    strictly later. Names are compared without case and blanks; null and blank names, entries with
    a null entity or known_time and entries that end before they are known never count. Events keep
    their number, repeated ones included; those with a null entity or time have no attributes.
    shard_rows: entries and events that one task takes, about; no entity, day or moment has more in one task.
    """
    e = events.select(F.col(entity).alias("entity"), F.col(event).alias("event"), micros(F.col(event_time)).alias("time"))
    lost = e.where(F.col("entity").isNull() | F.col("time").isNull())
    e = e.where(F.col("entity").isNotNull() & F.col("time").isNotNull())
    r = records.select(
        F.col(entity).alias("entity"),
        clean_name(F.col(attribute)).alias("attribute"),
        micros(F.col(known_time)).alias("time"),
        F.coalesce(micros(F.col(end_time)), F.lit(_NEVER)).alias("ends"),
    ).where("entity is not null and attribute is not null and time is not null and ends > time")
    r = r.groupBy("entity", "attribute", "time").agg(F.max("ends").alias("ends"))
    # of one moment events come first: they don't see what becomes known then, so that any cut leaves them right
    both = e.withColumn("is_event", F.lit(True)).unionByName(r.withColumn("is_event", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("turn", F.struct((~F.col("is_event")).alias("last"), F.xxhash64("event", "attribute").alias("any")))
    size = both.count()
    rows = ranges.placed(both, ["entity"], ["time", "turn"], max(events.sparkSession.sparkContext.defaultParallelism, -(-size // shard_rows))).drop("turn")

    kind = events.schema[event].dataType
    schema = T.StructType([T.StructField("event", kind), T.StructField("attributes", T.ArrayType(T.StringType()))])
    found = rows.groupBy("_p").cogroup(_carried(rows).groupBy("_p")).applyInPandas(_search, schema)
    none = lost.select("event", F.array().cast("array<string>").alias("attributes"))
    return found.unionByName(none).withColumnRenamed("event", event)


def _carried(rows: DataFrame) -> DataFrame:
    """For each later shard of an entity with several, one entry for each attribute entered before: its latest end.

    As many rows at most as there are shards and attributes of an entity: only an entity's first and last shard hold others too.
    """
    shards = rows.groupBy("entity", "_p").agg(F.count("*").alias("n"))
    shards = materialize(shards.withColumn("n", F.count("*").over(Window.partitionBy("entity"))).where("n > 1").select("entity", "_p"))
    latest = rows.where("not is_event").join(F.broadcast(shards), ["entity", "_p"]).groupBy("entity", "attribute", "_p").agg(F.max("ends").alias("ends"))
    grid = latest.select("entity", "attribute").distinct().join(shards, "entity").join(latest, ["entity", "attribute", "_p"], "left")
    before = Window.partitionBy("entity", "attribute").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("ends", F.max("ends").over(before)).where(F.col("ends").isNotNull())
    # new columns, so that both sides of the search can be told apart
    return grid.select(*[F.col(c).alias(c) for c in ("_p", "entity", "attribute")], F.lit(_ALWAYS).alias("time"), F.col("ends").alias("ends"))
