"""The shared inputs of the queries: corpus, judgments, query vectors, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import usable
from ..operators import qrels as Q
from ..operators import retrieval as V

DEPTH, TOP_K, POOL_K, DIVERSE_K = 100, 10, 30, 50
LAMBDAS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def label_of(raw: str = "institution_label"):
    """The label of a typed value: one of the two groups, anything else unknown."""
    clean = F.lower(T.strip(raw))
    return F.when(clean.isin("privileged", "underrepresented"), clean).otherwise(F.lit("unknown"))


def papers(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The last indexed row of each paper: (paper_id, vec_id, *columns)."""
    rows = read(spark, sf, "fairsearch_arxiv").where("paper_id is not null").select("paper_id", "vec_id", *columns)
    last = rows.groupBy("paper_id").agg(F.max(F.struct("vec_id", *columns)).alias("r"))
    return last.select("paper_id", "r.vec_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_key, label) of every paper."""
    return papers(spark, sf, "institution_label").select(F.col("paper_id").alias("doc_key"), label_of().alias("label"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_key, v) of the papers with a usable vector."""
    rows = papers(spark, sf, "embedding").where(usable(F.col("embedding")))
    return rows.select(F.col("paper_id").alias("doc_key"), F.col("embedding").alias("v"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    return Q.canonical_qrels(read(spark, sf, "qrels_flat"), "judged_at", ["paper_id"])


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, v, exclude): a query stands for its best judged paper with a vector, which is not returned for it."""
    judged = qrels(spark, sf).join(vectors(spark, sf), "doc_key")
    best = judged.groupBy("qkey").agg(F.min(F.struct((-F.col("relevance")).alias("o"), "doc_key", "v")).alias("r"))
    return best.select(F.col("qkey").alias("qid"), F.col("r.v").alias("v"), F.col("r.doc_key").alias("exclude"))


def run(spark: SparkSession, sf: str, depth: int = DEPTH) -> DataFrame:
    """(qid, doc_key, score, rank) of all queries to the given depth."""
    return V.dense_topk(query_vectors(spark, sf), vectors(spark, sf), depth)


def with_labels(hits: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return hits.join(labels(spark, sf), "doc_key", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def audit_run(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten labeled hits of each query within the depth, with qkey for the evaluators."""
    labeled = V.filter_after_rank(with_labels(run(spark, sf), spark, sf), F.col("label") != "unknown", TOP_K)
    return labeled.withColumn("qkey", F.col("qid"))


def diverse_run(spark: SparkSession, sf: str, lambdas: list[float]) -> DataFrame:
    """The first ten labeled hits after re-ranking the whole depth, per lambda."""
    hits = V.mmr(run(spark, sf), vectors(spark, sf), lambdas, DEPTH).withColumn("arm", F.struct("lam", "qid"))
    labeled = V.filter_after_rank(with_labels(hits, spark, sf), F.col("label") != "unknown", TOP_K, "arm").drop("arm")
    return labeled.withColumn("qkey", F.col("qid"))
