"""Stances of documents and summaries, and scores of generated answers, over supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STANCES = ("PRO-CONSENSUS", "NEUTRAL", "DISSENTING")


def stance_distribution(docs: DataFrame, keys: tuple[str, ...] = ("condition", "id")) -> DataFrame:
    """Shares of the three stances; other stances stay in the denominator."""
    share = lambda s: F.round(F.count_if(F.col("stance") == s) / F.count("*"), 6)
    return docs.groupBy(*keys).agg(
        F.count("*").alias("n_docs"), share(STANCES[0]).alias("pro_share"), share(STANCES[1]).alias("neutral_share"), share(STANCES[2]).alias("dissenting_share")
    )


def label_documents(docs: DataFrame, stances: DataFrame) -> DataFrame:
    """Documents (id, pos, ...) with their stances (id, pos, stance); an id with a document without stance is dropped whole."""
    joined = docs.join(stances.select("id", "pos", "stance"), ["id", "pos"], "left")
    whole = joined.groupBy("id").agg(F.count("*").alias("n"), F.count("stance").alias("s")).where("n = s").select("id")
    return joined.join(whole, "id", "left_semi")


def consensus_amplification(retrieved: DataFrame, summaries: DataFrame, keys: tuple[str, ...] = ("condition", "id")) -> DataFrame:
    """Share of consensus in the summary less that in the documents, and its size."""
    joined = retrieved.join(summaries.select(*keys, "summary_pro_ratio"), list(keys))
    amp = F.col("summary_pro_ratio") - F.col("pro_share")
    return joined.select(*keys, "pro_share", "summary_pro_ratio", F.round(amp, 6).alias("consensus_amplification"), F.round(F.abs(amp), 6).alias("absolute_gap"))


def condition_summary(measures: DataFrame, names: list[str], conditions: list[str]) -> DataFrame:
    """One row per measure and one column per condition: counts and means to three digits."""
    means = measures.groupBy("condition").agg(F.count("*").cast("double").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in names])
    long = means.unpivot(["condition"], ["n", *names], "measure", "value")
    return long.groupBy("measure").pivot("condition", conditions).agg(F.first("value"))


def score_summary(scores: DataFrame, conditions: list[str]) -> DataFrame:
    """Mean of each metric by condition, from (id, condition, metric, value)."""
    return scores.groupBy("metric").pivot("condition", conditions).agg(F.round(F.avg("value"), 4))


def zip_conditions(a: DataFrame, b: DataFrame, c: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Answers of three conditions side by side, by id; raises where a query differs between conditions. Ids missing in one are left out."""
    parts = [x.select("id", F.col("query").alias(f"q{i}"), F.col("answer").alias(n)) for i, (x, n) in enumerate(zip((a, b, c), names))]
    joined = parts[0].join(parts[1], "id").join(parts[2], "id")
    same = (F.col("q0") == F.col("q1")) & (F.col("q0") == F.col("q2"))
    query = F.when(same, F.col("q0")).otherwise(F.raise_error(F.concat(F.lit("conditions disagree on "), F.col("id").cast("string"))).cast("string"))
    return joined.select("id", query.alias("query"), *names)
