"""Idempotent batches: what was done is left out, what is new is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `work` whose keys are not among those done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_once(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append to a parquet table the rows whose keys it lacks; running it again adds nothing. Returns how many were added."""
    spark = rows.sparkSession
    try:
        fresh = remaining(rows, spark.read.parquet(path), keys)
    except Exception as e:  # the table does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = rows
    fresh = fresh.dropDuplicates(keys).cache()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
        return n
    finally:
        fresh.unpersist()


def merge_cache(old: DataFrame, new: DataFrame, key: str, value: str, only_filled: bool = False) -> DataFrame:
    """Full-outer merge of two key-value tables, the new value first; with only_filled empty arrays do not replace old ones."""
    fresh = new.where(F.size(value) > 0) if only_filled else new
    a = old.select(key, F.col(value).alias("_old"))
    b = fresh.select(key, F.col(value).alias("_new"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_new", "_old").alias(value))


def stage_recovery(attempted: DataFrame, key: str, value: str) -> DataFrame:
    """(attempted, recovered, remaining) of a lookup stage: rows with a non-empty array are recovered."""
    got = F.count_if(F.coalesce(F.size(value) > 0, F.lit(False)))
    return attempted.agg(F.count("*").alias("attempted"), got.alias("recovered")).withColumn("remaining", F.col("attempted") - F.col("recovered"))
