"""Batched models over columns: embedding, text classification by a client, clustering (MLC-01 to MLC-04, UDF-01 to UDF-05)."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import text as tx


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic stand-in for a language model: signed hashed words and letter triples, of length 1."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for i, text in enumerate(texts):
        words = text.lower().split()
        for part in [*words, *(f"<{w}>"[j : j + 3] for w in words for j in range(len(w)))]:
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 40 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_embedding) -> DataFrame:
    """MLC-01, UDF-03: key and embedding; the model is loaded once in each worker. Null texts have a null embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            vectors = model(batch[text].fillna("").tolist())
            yield pd.DataFrame({key: batch[key], "embedding": [v.tolist() if isinstance(t, str) else None for v, t in zip(vectors, batch[text])]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def classify(df: DataFrame, key: str, text: str, client: Callable[[str], str], attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """UDF-02: key, answer and error of a client's call for each text, again with growing pauses after a failure.

    The client is any function from prompt to answer. Null texts aren't asked.
    """

    def ask(prompt: str) -> tuple[str | None, str | None]:
        for i in range(attempts):
            try:
                return client(prompt), None
            except Exception as e:  # the client's own errors
                error = f"{type(e).__name__}: {e}"
                if i + 1 < attempts:
                    time.sleep(pause * 2**i)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [ask(t) if isinstance(t, str) else (None, None) for t in batch[text]]
            yield pd.DataFrame({key: batch[key], "answer": [a for a, _ in told], "error": [e for _, e in told]}, dtype=object).astype({key: batch[key].dtype})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, answer string, error string")


def keyword_client(prompt: str) -> str:
    """A deterministic client for tests: a label from keywords, as JSON, which is cut off where mood is spoken of."""
    low = prompt.lower()
    label = "positive" if "psych" in low or "mania" in low else "negative"
    answer = json.dumps({"psychiatric_context_label": label, "psychiatric_mention_type": "other", "reason": "words"})
    return answer[:-4] if "mood" in low and label == "negative" else answer


def phrase_clusters(df: DataFrame, key: str, text: str, k: int, least: int = 3, most: float = 0.8, seed: int = 42) -> DataFrame:
    """MLC-03: key and cluster of bisecting k-means on tf-idf of one to three words. Texts without a known phrase are noise, -1.

    The agglomerative and density clustering of one machine have no distributed equal; this is the
    scalable stand-in, with the same inputs and outputs.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z0-9]{2,})"), 1)
    rows = df.select(key, words.alias("w")).select(key, F.flatten(F.array(*[tx.ngrams(F.col("w"), n) for n in (1, 2, 3)])).alias("grams"))
    counted = CountVectorizer(inputCol="grams", outputCol="tf", minDF=float(least), maxDF=most).fit(rows).transform(rows)
    scaled = IDF(inputCol="tf", outputCol="raw").fit(counted).transform(counted)
    unit = Normalizer(inputCol="raw", outputCol="features").transform(scaled)
    some = unit.withColumn("known", F.exists(vector_to_array("features"), lambda x: x != 0)).cache()
    model = BisectingKMeans(k=k, seed=seed, maxIter=10).fit(some.where("known"))
    found = model.transform(some.where("known")).select(key, F.col("prediction").alias("cluster"))
    return found.unionByName(some.where("not known").select(key, F.lit(-1).alias("cluster")))


def cluster_summary(labels: DataFrame, cluster: str, cohort: str, subject: str) -> DataFrame:
    """MLC-04: rows, subjects, rows of each cohort and whether it is noise, for each cluster."""
    out = labels.groupBy(cluster).agg(F.count("*").alias("n_rows"), F.count_distinct(subject).alias("n_subjects"), F.count_distinct(cohort).alias("n_cohorts"))
    return out.withColumn("is_noise", (F.col(cluster) == -1).cast("int"))


def cluster_table(labels: DataFrame, cluster: str, cohort: str, cohorts: list[str], text: str, top: int = 10) -> DataFrame:
    """MLC-04: of each cluster n_rows, n_<cohort>, the first cohort's share, whether it is noise and its commonest texts with their numbers."""
    counts = labels.where(F.coalesce(F.trim(text), F.lit("")) != "").groupBy(cluster, text).agg(F.count("*").alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), text)
    first = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    told = F.transform(F.array_sort(F.collect_list(F.struct("r", text, "n"))), lambda x: F.concat(x[text], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    frequent = first.groupBy(F.col(cluster).alias("_c")).agg(F.array_join(told, " | ").alias("frequent"))
    sizes = labels.groupBy(cluster).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(cohort) == c).alias(f"n_{c}") for c in cohorts])
    sizes = sizes.withColumn(f"pct_{cohorts[0]}", 100.0 * F.col(f"n_{cohorts[0]}") / F.col("n_rows")).withColumn("is_noise", (F.col(cluster) == -1).cast("int"))
    return sizes.join(frequent, F.col(cluster).eqNullSafe(F.col("_c")), "left").drop("_c").withColumn("frequent", F.coalesce("frequent", F.lit("")))


def pair_agreement(labels: DataFrame, pair: str, role: str, cluster: str) -> DataFrame:
    """MLC-04: n_pairs, and how many have both members in the same cluster that isn't noise."""
    wide = labels.groupBy(pair).agg(F.count_distinct(role).alias("roles"), F.min(cluster).alias("low"), F.max(cluster).alias("high"))
    whole = wide.where("roles = 2 and low is not null")
    same = (F.col("low") == F.col("high")) & (F.col("low") != -1)
    return whole.agg(F.count("*").alias("n_pairs"), F.count_if(same).alias("n_same"), F.count_if(F.col("low") == -1).alias("n_with_noise"))
