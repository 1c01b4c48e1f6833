"""Matching of exposed rows to controls (JON-12, JON-13).

The candidates don't depend on earlier matches, so they come from one blocked search: rows of equal sex
and insurance group meet in blocks of neighbouring age bins, where a matrix product gives the
cosines and only the best of each row leave the task. Only the choice is sequential, and blocks
by sex and insurance group are independent of each other.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import values as vl


@dataclass(frozen=True)
class MatchRule:
    """least_cosine: similarity must be above it, above fallback_cosine where no candidate shares terms;
    nearest: candidates kept of each age bin; strict, relaxed: score differences allowed; tie: cosines
    this close to the best count as equal; block: rows of either side that a task compares at most."""

    nearest: int = 100
    least_cosine: float = 0.90
    fallback_cosine: float = 0.93
    least_jaccard: float = 0.2
    strict: float = 2.0
    relaxed: float = 5.0
    tie: float = 0.01
    block: int = 8192


COLUMNS = ["id", "sex", "insurance_group", "age", "age_bin", "score", "terms", "embedding"]
_NEEDED = ["id", "sex", "insurance_group", "age", "age_bin", "score", "embedding"]
_STRATUM = ["sex", "insurance_group"]


def complete(rows: DataFrame) -> DataFrame:
    """FLT-09: the rows (COLUMNS) that can be matched: nothing needed is null, and the vector isn't zero; null terms are none."""
    some = rows.select(*COLUMNS).dropna(subset=_NEEDED)
    some = some.where("size(embedding) > 0").where(F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False))) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return some.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def _best(exposed: pd.DataFrame, controls: pd.DataFrame, rule: MatchRule) -> pd.DataFrame:
    """Of one block, the nearest controls of each exposed row among all and among those that share terms."""
    columns = ["exposed_id", "control_id", "cosine", "screened", "plain", "age_difference", "score_difference"]
    if not len(exposed) or not len(controls):
        return pd.DataFrame({c: [] for c in columns})
    unit = [np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (exposed, controls)]
    unit = [u / np.linalg.norm(u, axis=1, keepdims=True) for u in unit]
    ids = controls["id"].to_numpy()
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    words, sizes = defaultdict(list), np.array([len(x) for x in controls["words"]])
    for at, own in enumerate(controls["words"]):
        for x in own:
            words[x].append(at)
    out = []
    for start in range(0, len(exposed), 512):
        cosines = np.round(unit[0][start : start + 512] @ unit[1].T, 9)
        for row, cosine in enumerate(cosines, start):
            own = exposed.iloc[row]
            common = np.zeros(len(ids))
            for x in own["words"]:
                common[words.get(x, [])] += 1
            jaccard = common / np.maximum(1, len(own["words"]) + sizes - common)
            passes = (common > 0) & (jaccard >= rule.least_jaccard)
            kept = []
            for pool in (np.flatnonzero(passes), np.arange(len(ids))):
                if len(pool) > rule.nearest:  # all that are as near as the last one stay until ties are settled
                    bound = np.partition(-cosine[pool], rule.nearest - 1)[rule.nearest - 1]
                    pool = pool[-cosine[pool] <= bound]
                kept.append(pool[np.lexsort((rank[pool], -cosine[pool]))][: rule.nearest])
            every = np.union1d(*kept)
            out.append(pd.DataFrame({
                "exposed_id": own["id"], "control_id": ids[every], "cosine": cosine[every], "screened": np.isin(every, kept[0]), "plain": np.isin(every, kept[1]),
                "age_difference": np.abs(own["age"] - controls["age"].to_numpy()[every]).astype(float),
                "score_difference": np.abs(own["score"] - controls["score"].to_numpy()[every]).astype(float),
            }))
    return pd.concat(out)[columns]


def _blocked(exposed: DataFrame, controls: DataFrame, rule: MatchRule) -> tuple[DataFrame, DataFrame]:
    """Both sides by stratum, bin, vector length and block; each row of one side meets each block of the other once."""
    keys = [*_STRATUM, "bin", "dim"]
    words = vl.expanded_terms(F.col("terms"))
    e = exposed.withColumn("bin", F.explode(F.array(F.col("age_bin") - 1, F.col("age_bin"), F.col("age_bin") + 1)))
    sides = [x.withColumn("dim", F.size("embedding")).withColumn("words", words) for x in (e, controls.withColumn("bin", F.col("age_bin")))]
    counts = [x.groupBy(*keys).agg(F.ceil(F.count("*") / rule.block).cast("int").alias(n)) for x, n in zip(sides, ("turns", "blocks"))]
    sizes = counts[0].join(counts[1], keys)  # a row for each stratum, bin and length
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = sides[0].join(sizes, keys).withColumn("turn", part("turns")).withColumn("block", every("blocks"))
    c = sides[1].join(sizes, keys).withColumn("block", part("blocks")).withColumn("turn", every("turns"))
    columns = [*keys, "turn", "block", "id", "age", "age_bin", "score", "words", "embedding"]
    return e.select(columns), c.select(*[F.col(x).alias(x) for x in columns])


def age_bin(age: Column) -> Column:
    """CND-01: the place of an adult's age among 18-29, tens of years and 80 and more; null for other ages."""
    return F.when(age.between(18, 29.999), 0).when(age.between(30, 79.999), F.floor(age / 10) - 2).when(age.between(80, 120), 6).cast("int")


def nearest_controls(exposed: DataFrame, controls: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """The nearest controls of each exposed row and bin with `enough`, whether the cosine reaches the rule's bound. As told at static_candidates."""
    exposed, controls = complete(exposed), complete(controls)
    keys = [*_STRATUM, "bin", "dim", "turn", "block"]
    e, c = _blocked(exposed, controls, rule)
    kind = [x.schema["id"].dataType.simpleString() for x in (exposed, controls)]
    schema = (
        f"sex string, insurance_group string, bin int, exposed_id {kind[0]}, control_id {kind[1]}, cosine double, screened boolean, plain boolean, "
        "age_difference double, score_difference double, same_bin boolean, exposed_score double"
    )

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _best(left, right, rule)
        own = left.drop_duplicates("id").set_index("id")
        found["same_bin"] = own["age_bin"].reindex(found["exposed_id"]).to_numpy() == key[2]
        found["exposed_score"] = own["score"].reindex(found["exposed_id"]).to_numpy(dtype=float)
        return found.assign(sex=key[0], insurance_group=key[1], bin=key[2])[[x.split()[0] for x in schema.split(", ")]]

    found = e.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(search, schema)
    found = found.withColumn("fallback", ~F.max("screened").over(Window.partitionBy("exposed_id"))).where("screened or (fallback and plain)")
    order = Window.partitionBy("exposed_id", "bin").orderBy(F.desc("cosine"), "control_id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rule.nearest)
    enough = F.col("cosine") > F.when(F.col("fallback"), rule.fallback_cosine).otherwise(rule.least_cosine)
    return found.withColumn("enough", enough).drop("r", "bin", "screened", "plain")


def static_candidates(exposed: DataFrame, controls: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """sex, insurance_group, exposed_id, control_id, cosine (of 9 digits), fallback and the differences of every eligible pair.

    Both frames have COLUMNS (age_bin an integer); rows that aren't complete take no part. A pair has equal sex and insurance
    group and equal or neighbouring bins, and shares a term and least_jaccard of the expanded terms, or
    where an exposed row has no such control in any bin, it is a fallback. Of each bin the nearest
    controls are kept, ties by id, whether or not others take them later.
    """
    return nearest_controls(exposed, controls, rule).where("enough").drop("enough")


def pool_sizes(exposed: DataFrame, controls: DataFrame) -> DataFrame:
    """exposed_id and pool_size: controls of equal sex and insurance group in the same or neighbouring bins, counted before joining."""
    sizes = controls.groupBy(*_STRATUM, F.col("age_bin").alias("bin")).agg(F.count("*").alias("n"))
    rows = exposed.select(F.col("id").alias("exposed_id"), *_STRATUM, F.explode(F.array(F.col("age_bin") - 1, F.col("age_bin"), F.col("age_bin") + 1)).alias("bin"))
    return rows.join(sizes, [*_STRATUM, "bin"], "left").groupBy("exposed_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pool_size"))


def choose(candidates: pd.DataFrame, rule: MatchRule) -> list[tuple]:
    """One block's matches in order: hardest exposed row first, no control twice."""
    used: set = set()
    out = []
    rows = candidates.sort_values(["pool_size", "exposed_score", "exposed_id"], ascending=[True, False, True], na_position="last", kind="stable")
    whose = rows["exposed_id"].to_numpy()
    starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(rows) else []
    ids, cosine, age, score = (rows[c].to_numpy() for c in ("control_id", "cosine", "age_difference", "score_difference"))
    same, enough = (rows[c].to_numpy(dtype=bool) for c in ("same_bin", "enough"))
    for begin, end in zip(starts, [*starts[1:], len(rows)]):
        free = [i for i in range(begin, end) if ids[i] not in used]
        near = [i for i in free if enough[i]]
        picked, kind = None, "elixhauser_caliper" if near else "below_similarity_threshold" if free else "no_available_controls"
        for name, limit in (("strict", rule.strict), ("relaxed", rule.relaxed)):
            fit = [i for i in near if score[i] <= limit]
            if fit:
                best = max(cosine[i] for i in fit)
                tied = [i for i in fit if cosine[i] >= best - rule.tie]
                picked, kind = min(tied, key=lambda i: (age[i], not same[i], -cosine[i], score[i], ids[i])), name
                used.add(ids[picked])
                break
        out.append((whose[begin], None, None, kind) if picked is None else (whose[begin], ids[picked], float(cosine[picked]), kind))
    return out


def match(exposed: DataFrame, controls: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """exposed_id, control_id, cosine, match_type of every exposed row; unmatched ones have a null control and the reason.

    A block's candidates, at most three times `nearest` for each exposed row, are chosen from in one
    task, in the order a single pass over all rows would take. Rows that can't be matched are
    incomplete_row; other reasons are no_same_sex_insurance_nearby_age_bin_candidates, no_available_controls
    (others have all that are near enough to be kept), below_similarity_threshold and elixhauser_caliper.
    """
    usable, others = complete(exposed), complete(controls)
    candidates = nearest_controls(usable, others, rule).join(pool_sizes(usable, others), "exposed_id")
    kinds = [x.schema["id"].dataType.simpleString() for x in (exposed, controls)]

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        frame = pd.DataFrame(choose(rows, rule), columns=["exposed_id", "control_id", "cosine", "match_type"])
        return frame.astype({"control_id": "Int64"}) if kinds[1] == "bigint" else frame

    schema = f"exposed_id {kinds[0]}, control_id {kinds[1]}, cosine double, match_type string"
    chosen = candidates.groupBy(*_STRATUM).applyInPandas(block, schema)
    every = exposed.select(F.col("id").alias("exposed_id")).join(usable.select(F.col("id").alias("exposed_id"), F.lit("no_same_sex_insurance_nearby_age_bin_candidates").alias("_else")), "exposed_id", "left")
    reason = F.coalesce("match_type", "_else", F.lit("incomplete_row"))
    return every.join(chosen, "exposed_id", "left").select("exposed_id", "control_id", "cosine", reason.alias("match_type"))


def match_faults(matches: DataFrame, exposed: DataFrame, controls: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """QA-03: matched rows that break a promise: control used twice, other stratum, too little similarity."""
    used = Window.partitionBy("control_id")
    found = matches.where("control_id is not null").withColumn("n", F.count("*").over(used))
    e = exposed.select(F.col("id").alias("exposed_id"), F.col("sex").alias("es"), F.col("insurance_group").alias("ei"))
    c = controls.select(F.col("id").alias("control_id"), F.col("sex").alias("cs"), F.col("insurance_group").alias("ci"))
    joined = found.join(e, "exposed_id").join(c, "control_id")
    return joined.where((F.col("n") > 1) | (F.col("es") != F.col("cs")) | (F.col("ei") != F.col("ci")) | (F.col("cosine") <= rule.least_cosine))
