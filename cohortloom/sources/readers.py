"""Reading tables: gzip CSV, Parquet, JSON lines, and whichever of these is there (SRC-01 to SRC-15)."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Settings:
    """SRC-15: configuration; each field can be set by an environment variable of its name in capitals with the prefix COHORTLOOM_."""

    input_dir: str = "."
    output_dir: str = "out"
    limit_admissions: int = 0
    shuffle_partitions: int = 200

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment
        found = {f.name: env.get(f"COHORTLOOM_{f.name.upper()}") for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{name: kinds[name](value) for name, value in found.items() if value is not None})


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """SRC-01, SRC-03: CSV with a header and a given schema. gzip files can't be split, so that partitions spreads their rows."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.select(*[c for c in columns if c in df.columns]) if columns else df
    return df.repartition(partitions) if partitions else df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """SRC-03: the column names of a CSV file, from its first line alone."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader([first[0]["value"]])) if first else []


def read_csv_columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """SRC-03: those of the wanted columns that a CSV file has, as text; the header is looked at first, so that only they are parsed."""
    header = csv_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return read_csv(spark, path, schema, wanted)


def preview(df: DataFrame, n: int, where: str | None = None) -> DataFrame:
    """SRC-14: the first n rows, or of those that meet a condition."""
    return (df.where(where) if where else df).limit(n)


def with_vectors(rows: DataFrame, vectors: DataFrame, row_id: str, vector: str) -> DataFrame:
    """SRC-08: rows with the vector of their row id (from 0 in each file of vectors). Ids outside the file's bounds end the job."""
    found = rows.join(vectors.select(row_id, vector), row_id, "left")
    known = F.coalesce(F.col(row_id).isNull() | F.col(vector).isNotNull(), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit(f"{row_id} out of bounds: "), F.col(row_id).cast("string")))
    return found.withColumn(vector, F.when(known, F.col(vector)).otherwise(wrong.cast(found.schema[vector].dataType)))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-09: JSON lines; a line that can't be read ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def resolve(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-04: the first that exists of name.parquet, name.csv, name.csv.gz and the catalog's table of this name."""
    base = f"{directory}/{name}"
    if exists(spark, f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    for ending in ("csv", "csv.gz"):
        if exists(spark, f"{base}.{ending}"):
            if schema is None:
                raise ValueError(f"{base}.{ending} needs a schema")
            return read_csv(spark, f"{base}.{ending}", schema)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    raise FileNotFoundError(f"neither a file {base}.parquet, .csv, .csv.gz nor a table {name}")


def lower_names(df: DataFrame) -> DataFrame:
    """SRC-05: the same columns with names in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def union_tagged(parts: dict[str, DataFrame], tag: str = "cohort") -> DataFrame:
    """SRC-06: frames below each other with their name in a column; columns that some lack are null."""
    out = None
    for name, df in parts.items():
        own = df.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def coerce(df: DataFrame, kinds: dict[str, str], strict: bool = False) -> DataFrame:
    """SRC-10: columns as other types; what can't be read becomes null, or with strict ends the job."""
    cast = (lambda c, k: F.col(c).cast(k)) if strict else (lambda c, k: F.col(c).try_cast(k))
    return df.withColumns({c: cast(c, k) for c, k in kinds.items() if c in df.columns})


def optional_columns(df: DataFrame, required: list[str], wanted: list[str]) -> DataFrame:
    """PRJ-04: the required columns, and of the wanted ones those that are there."""
    return df.select(*required, *[c for c in wanted if c in df.columns and c not in required])


def lookup_rows(spark: SparkSession, tables: list[str], ids: dict[str, int], columns: list[str]) -> DataFrame:
    """SRC-12, SRC-13: rows by ids over several catalog tables; names are quoted as identifiers, ids bound as parameters."""
    quoted = ", ".join(f"`{c.replace('`', '``')}`" for c in columns)
    test = " and ".join(f"`{c.replace('`', '``')}` = :{c}" for c in ids)
    parts = [f"select '{t}' as source_table, {quoted} from identifier(:t{i}) where {test}" for i, t in enumerate(tables)]
    return spark.sql(" union all ".join(parts), args={**ids, **{f"t{i}": t for i, t in enumerate(tables)}})
