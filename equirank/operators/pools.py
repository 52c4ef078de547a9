"""Pools of papers to be judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_of(ranked: DataFrame, k: int = 30) -> DataFrame:
    """(qkey, doc_key, pos) of runs in one table (qkey, doc_key, run, rank): the first k of each run in order of the runs.

    Each paper stands at its first occurrence, numbered from 1.
    """
    first = ranked.where(F.col("rank") <= k).groupBy("qkey", "doc_key").agg(F.min(F.struct("run", "rank")).alias("o"))
    return first.select("qkey", "doc_key", F.row_number().over(Window.partitionBy("qkey").orderBy("o.run", "o.rank", "doc_key")).alias("pos"))


def pool_union(runs: list[DataFrame], k: int = 30) -> DataFrame:
    """pool_of() of separate runs (qkey, doc_key, rank)."""
    parts = [r.select("qkey", "doc_key", F.lit(i).alias("run"), "rank") for i, r in enumerate(runs)]
    return pool_of(reduce(DataFrame.unionByName, parts), k)


def unjudged(pool: DataFrame, cache: DataFrame) -> DataFrame:
    """Pool rows without a cached grade, by the pair of keys."""
    return pool.join(cache.select("qkey", "doc_key"), ["qkey", "doc_key"], "left_anti")


def chunked(rows: DataFrame, size: int, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their batch number within the keys, `size` rows a batch in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int")).withColumn("id", ((n - 1) % size + 1).cast("int"))


def grade_distribution(grades: DataFrame) -> DataFrame:
    return grades.groupBy("relevance").agg(F.count("*").alias("n"))
