"""The fairness-utility trade-off over the re-ranking parameter, all points in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fairness, utility

SAFE_LAMBDA = 0.5


def sweep(labeled: DataFrame, points: DataFrame, qrels: DataFrame, k: int = 10, allow_untrusted: bool = False) -> DataFrame:
    """One row per lambda of a labeled run (lam, qid, qkey, doc_key, label, rank), from one pass over the run.

    Fairness as in parity_pooled, parity_per_query and equalized_odds, coverage and
    utility as in judged_coverage and utility_summary. Utility is null below
    SAFE_LAMBDA, where too few hits are judged, unless asked for.
    """
    grade, label, rank = F.col("relevance"), F.col("label"), F.col("rank")
    group = {"priv": label == fairness.PRIV, "under": label == fairness.UNDER}
    cells = {f"{kind}_{g}": is_g & (grade >= 2 if kind == "tp" else grade < 2) for kind in ("tp", "fp") for g, is_g in group.items()}
    per_query = labeled.where(rank <= k).join(qrels, ["qkey", "doc_key"], "left").groupBy("lam", "qid", "qkey").agg(
        F.count("*").alias("n"), F.count("relevance").alias("n_judged"), *[F.count_if(c).alias(f"hits_{g}") for g, c in group.items()],
        F.sum(F.coalesce(grade, F.lit(0)) / F.log2(rank + 1)).alias("dcg"), F.min(F.when(grade > 0, rank)).alias("first"), *[F.count_if(c).alias(n) for n, c in cells.items()],
    )
    totals = {f"all_{n}": c for n, c in cells.items()}
    judged = qrels.join(points.select("doc_key", "label"), "doc_key", "left").groupBy("qkey").agg(*[F.count_if(c).alias(n) for n, c in totals.items()])
    known = utility.ideal(qrels, k).join(judged, "qkey").withColumn("is_judged", F.lit(True))
    rows = per_query.join(known, "qkey", "left")
    base = points.agg(F.struct(F.count_if(group["priv"]).alias("priv"), F.count_if(group["under"]).alias("under")).alias("n")).scalar()
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    by = rows.groupBy("lam").agg(
        F.count_distinct(F.when(F.col("hits_priv") + F.col("hits_under") > 0, F.col("qid"))).alias("q"), F.sum("hits_priv").alias("hp"), F.sum("hits_under").alias("hu"),
        F.round(F.try_divide(F.sum("hits_priv").cast("double"), F.sum(F.col("hits_priv") + F.col("hits_under"))), 6).alias("priv_share"),
        F.round(share(F.when(F.col("is_judged"), F.col("n_judged")), F.when(F.col("is_judged"), F.col("n"))), 4).alias("coverage"),
        F.round(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))), 4).alias("mean_ndcg"),
        F.round(F.avg(F.when(F.col("is_judged"), F.coalesce(1 / F.col("first"), F.lit(0.0)))), 4).alias("mrr"),
        *[F.round(share(f"{kind}_{g}", f"all_{kind}_{g}"), 4).alias(f"{rate}_{g}") for kind, rate in (("tp", "tpr"), ("fp", "fpr")) for g in group],
    ).withColumn("base", base)
    priv, under = (F.try_divide(F.col(h).cast("double"), F.col(f"base.{g}") * F.col("q")) for h, g in (("hp", "priv"), ("hu", "under")))
    gap = lambda r: F.abs(F.round(F.col(f"{r}_priv") - F.col(f"{r}_under"), 4))
    trusted = F.col("lam") >= SAFE_LAMBDA
    shown = lambda c: F.when(trusted | F.lit(allow_untrusted), F.col(c)).alias(c)
    return by.select(
        "lam", F.round(priv, 6).alias("priv_selection"), F.round(under, 6).alias("under_selection"), F.round(priv - under, 6).alias("spd"),
        F.round(F.try_divide(priv, under), 4).alias("priv_under_ratio"), "priv_share", "tpr_priv", "tpr_under", F.greatest(gap("tpr"), gap("fpr")).alias("eo_difference"),
        "coverage", shown("mean_ndcg"), shown("mrr"), trusted.alias("utility_trustworthy"),
    )
