"""Writing tables: Parquet, CSV, JSON lines, tables, with run metadata (SNK-01 to SNK-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, name: str) -> None:
    """SNK-01: create or replace a catalog table."""
    df.write.mode("overwrite").saveAsTable(name)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """SNK-02: Parquet, in folders by the given columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sample: int | None = None, order: list[str] | None = None, compression: str = "none") -> None:
    """SNK-03: CSV with a header; with sample the first rows in an order, in one file."""
    rows = df.orderBy(*order) if order else df
    rows = rows.limit(sample).coalesce(1) if sample else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').options(compression=compression, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_twins(df: DataFrame, path: str, sample: int | None = None, texts: list[str] | None = None) -> None:
    """SNK-04, SNK-06: Parquet, and from what was written CSV, without the columns of raw text."""
    write_parquet(df, f"{path}.parquet")
    saved = df.sparkSession.read.parquet(f"{path}.parquet")
    write_csv(saved.drop(*(texts or [])), f"{path}.csv", sample)


def write_jsonl(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """SNK-05: JSON lines; metadata of the run in a file of its own beside them."""
    df.write.mode("overwrite").json(path)
    if metadata:
        values = [F.lit(v).alias(k) for k, v in sorted(metadata.items())]
        df.sparkSession.range(1).select(*values).coalesce(1).write.mode("overwrite").json(f"{path}_metadata")


def append_log(df: DataFrame, path: str) -> None:
    """STR-02: append rows to a log, of which combine.last_written reads the newest by key."""
    df.write.mode("append").parquet(path)
