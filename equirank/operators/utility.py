"""Ranking quality against graded judgments, and coverage of the judged pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graded(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits with their grades; unjudged hits have grade 0."""
    return run.join(qrels.select("qkey", "doc_key", "relevance"), ["qkey", "doc_key"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def ideal(qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qkey, idcg): the gain of the best ranking of all judged papers of a query."""
    best = Window.partitionBy("qkey").orderBy(F.desc("relevance"), "doc_key")
    return qrels.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("qkey").agg(F.sum(F.col("relevance") / F.log2(F.col("r") + 1)).alias("idcg"))


def ndcg_per_query(run: DataFrame, qrels: DataFrame, k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(qkey, dcg, idcg, ndcg): linear gain; the ideal ranks all judged papers; ndcg is null for an ideal of 0 and for queries with nothing retrieved.

    All judged queries appear.
    """
    dcg = graded(run.where(F.col("rank") <= k), qrels).groupBy(*keys, "qkey").agg(F.sum(F.col("relevance") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = ideal(qrels, k)
    if keys:
        arms = run.agg(F.collect_set(F.struct(*keys)).alias("arms")).scalar()  # the few arms of a sweep
        best = best.withColumn("arm", F.explode(arms)).select(*[F.col(f"arm.{k}").alias(k) for k in keys], "qkey", "idcg")
    ndcg = F.when(F.col("idcg") > 0, F.try_divide(F.col("dcg"), F.col("idcg")))
    return best.join(dcg, [*keys, "qkey"], "left").withColumn("ndcg", ndcg)


def reciprocal_rank(run: DataFrame, qrels: DataFrame, k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(qkey, rr): one over the first rank with a grade above 0, 0 without one; for queries both run and judged."""
    hits = graded(run.where(F.col("rank") <= k), qrels).join(qrels.select("qkey").distinct(), "qkey", "left_semi")
    first = F.min(F.when(F.col("relevance") > 0, F.col("rank")))
    return hits.groupBy(*keys, "qkey").agg(F.coalesce(1 / first, F.lit(0.0)).alias("rr"))


def utility_summary(run: DataFrame, qrels: DataFrame, k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean NDCG (nulls left out) and mean reciprocal rank of unrounded values, with the queries that could not be scored."""
    n = ndcg_per_query(run, qrels, k, keys).join(reciprocal_rank(run, qrels, k, keys), [*keys, "qkey"], "left")
    return n.groupBy(*keys).agg(
        F.round(F.avg("ndcg"), 4).alias("mean_ndcg"), F.round(F.avg("rr"), 4).alias("mrr"), F.count("ndcg").alias("n_ndcg"), F.count("rr").alias("n_rr"),
        F.count_if(F.col("dcg").isNull()).alias("n_missing"),
    )


def utility_delta(summary: DataFrame, arm: str, base, other) -> DataFrame:
    """Differences of the rounded means of two arms."""
    pick = lambda c, v: F.max(F.when(F.col(arm) == v, F.col(c)))
    return summary.agg(*[F.round(pick(c, other) - pick(c, base), 4).alias(f"delta_{c}") for c in ("mean_ndcg", "mrr")])


def precision_recall(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qkey, precision, recall) of queries with relevant papers: precision over the hits there are, both 0 where there is nothing.

    relevant: (qkey, doc_key), distinct.
    """
    goal = relevant.groupBy("qkey").agg(F.count("*").alias("n_relevant"))
    hits = run.where(F.col("rank") <= k).select("qkey", "doc_key")
    good = hits.join(relevant.withColumn("good", F.lit(1)), ["qkey", "doc_key"], "left").groupBy("qkey").agg(
        F.count("*").alias("n_hits"), F.count("good").alias("n_good")
    )
    zero = F.lit(0.0)
    return goal.join(good, "qkey", "left").select(
        "qkey", F.round(F.coalesce(F.try_divide(F.col("n_good").cast("double"), F.col("n_hits")), zero), 4).alias("precision"),
        F.round(F.coalesce(F.try_divide(F.col("n_good").cast("double"), F.col("n_relevant")), zero), 4).alias("recall"),
    )


def precision_recall_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n_queries"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def judged_coverage(run: DataFrame, qrels: DataFrame, k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(n_hits, n_judged, coverage) over the queries that have judgments: hits with any grade."""
    hits = run.where(F.col("rank") <= k).join(qrels.select("qkey").distinct(), "qkey", "left_semi")
    marked = hits.join(qrels.select("qkey", "doc_key", F.lit(1).alias("judged")), ["qkey", "doc_key"], "left")
    return marked.groupBy(*keys).agg(F.count("*").alias("n_hits"), F.count("judged").alias("n_judged")).withColumn(
        "coverage", F.round(F.try_divide(F.col("n_judged").cast("double"), F.col("n_hits")), 4)
    )
