"""Sinks: tables as parquet or CSV, small results as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shorten
from ..operators.corpus import upsert

#: Most rows of a result that is written as one document through the driver.
MAX_DOCUMENT_ROWS = 100_000


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_points(df: DataFrame, path: str, new_path: str, key: str = "vec_id") -> None:
    """Upsert by key into a new version of a table of points; readers switch to it when it is whole."""
    write_parquet(upsert(df.sparkSession.read.parquet(path), df, key), new_path)


def nested_document(summary: DataFrame, per_query: DataFrame) -> DataFrame:
    """One row `value`: {"summary": ..., "per_query": [...]} of a one-row summary and a bounded table per query."""
    rows = per_query.agg(F.array_sort(F.collect_list(F.struct(*per_query.columns))).alias("per_query"))
    return summary.select(F.struct(*summary.columns).alias("summary")).withColumn("per_query", rows.scalar()).select(F.to_json(F.struct("summary", "per_query")).alias("value"))


def write_document(df: DataFrame, path: str) -> None:
    """Rows as one indented JSON array; refuses more than MAX_DOCUMENT_ROWS."""
    rows = df.limit(MAX_DOCUMENT_ROWS + 1).toJSON().collect()
    if len(rows) > MAX_DOCUMENT_ROWS:
        raise ValueError(f"more than {MAX_DOCUMENT_ROWS} rows; write a table instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows], f, indent=2, ensure_ascii=False)


def write_ids(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """The distinct ids in order, one a line."""
    df.select(key).distinct().orderBy(key).write.mode("overwrite").text(path)


def show_table(df: DataFrame, width: int = 60, n: int = 20) -> None:
    """A table on the console, long texts cut with an ellipsis."""
    cols = [shorten(F.col(c), width).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).show(n, truncate=False)
