"""Group-fairness measures of a labeled run: (qid, doc_key, label, rank), label privileged or underrepresented."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIV, UNDER = "privileged", "underrepresented"


def is_labeled(label: str = "label"):
    return F.col(label).isin(PRIV, UNDER)


def label_census(points: DataFrame, label: str = "label") -> DataFrame:
    return points.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def page_mix(run: DataFrame) -> DataFrame:
    """(qid, label, n): the labels on each page of results; a hit without a label is unknown."""
    return run.groupBy("qid", F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def corpus_base_rates(points: DataFrame) -> DataFrame:
    """(n_priv, n_under, priv_base_rate): counts of the labeled corpus, share of the privileged among them (null without any)."""
    n_priv, n_under = F.count_if(F.col("label") == PRIV), F.count_if(F.col("label") == UNDER)
    return points.agg(n_priv.alias("n_priv"), n_under.alias("n_under")).withColumn(
        "priv_base_rate", F.round(F.try_divide(F.col("n_priv").cast("double"), F.col("n_priv") + F.col("n_under")), 4)
    )


def parity_per_query(run: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Counts, rates, statistical parity difference (priv - under) and ratio (under / priv, null without privileged hits) per query.

    Queries without labeled hits are absent.
    """
    counted = run.where(is_labeled()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("label") == PRIV).alias("n_priv"))
    n_under = F.col("n") - F.col("n_priv")
    priv, under = F.col("n_priv") / F.col("n"), n_under / F.col("n")
    return counted.select(
        *keys, "n", "n_priv", n_under.alias("n_under"), F.round(priv, 4).alias("priv_rate"), F.round(under, 4).alias("under_rate"),
        F.round(priv - under, 4).alias("spd"), F.round(F.try_divide(n_under.cast("double"), F.col("n_priv")), 4).alias("under_priv_ratio"),
    )


def parity_pooled(run: DataFrame, points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Selection rates over all (paper, query with labeled hits) trials, in closed form: hits / (papers x queries).

    spd is priv - under; the ratio is priv / under (null for 0), the other way round than per query.
    """
    hits = run.where(is_labeled()).groupBy(*keys).agg(
        F.countDistinct("qid").alias("n_queries"), F.count_if(F.col("label") == PRIV).alias("hits_priv"), F.count_if(F.col("label") == UNDER).alias("hits_under")
    )
    base = points.agg(F.struct(F.count_if(F.col("label") == PRIV).alias("p"), F.count_if(F.col("label") == UNDER).alias("u")).alias("n")).scalar()
    hits = hits.withColumn("base", base)
    priv = F.try_divide(F.col("hits_priv").cast("double"), F.col("base.p") * F.col("n_queries"))
    under = F.try_divide(F.col("hits_under").cast("double"), F.col("base.u") * F.col("n_queries"))
    return hits.select(
        *keys, "n_queries", "hits_priv", "hits_under", F.round(priv, 6).alias("priv_selection"), F.round(under, 6).alias("under_selection"),
        F.round(priv - under, 6).alias("spd"), F.round(F.try_divide(priv, under), 4).alias("priv_under_ratio"),
    )


def parity_summary(per_query: DataFrame, base: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of the rounded values per query (null ratios left out) and the lift of the privileged rate over the corpus."""
    means = per_query.groupBy(*keys).agg(
        F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("priv_rate", "under_rate", "spd", "under_priv_ratio")]
    )
    return means.withColumn("priv_base_rate", base.select("priv_base_rate").scalar()).withColumn("priv_lift", F.round(F.col("mean_priv_rate") - F.col("priv_base_rate"), 6))


def exposure_per_query(run: DataFrame) -> DataFrame:
    """Exposure 1 / log2(rank + 1) by group over the labeled hits in their own ranking: shares, difference, ratio under / priv."""
    worth = 1 / F.log2(F.col("rank") + 1)
    sums = run.where(is_labeled()).groupBy("qid").agg(
        F.sum(F.when(F.col("label") == PRIV, worth).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label") == UNDER, worth).otherwise(0.0)).alias("u")
    )
    total = F.col("p") + F.col("u")
    return sums.select(
        "qid", F.round("p", 4).alias("exposure_priv"), F.round("u", 4).alias("exposure_under"), F.round(F.try_divide(F.col("p"), total), 4).alias("share_priv"),
        F.round(F.try_divide(F.col("u"), total), 4).alias("share_under"), F.round(F.try_divide(F.col("p") - F.col("u"), total), 4).alias("exposure_difference"),
        F.round(F.try_divide(F.col("u"), F.col("p")), 4).alias("exposure_ratio"),
    )


def exposure_summary(per_query: DataFrame, parity: DataFrame) -> DataFrame:
    """Means of the rounded exposure and parity values; raises on a run without a query that has labeled hits."""
    joined = per_query.join(parity.select("qid", "priv_rate", "under_rate", "spd", "under_priv_ratio"), "qid")
    names = ("share_priv", "share_under", "exposure_difference", "exposure_ratio", "priv_rate", "under_rate", "spd", "under_priv_ratio")
    n = F.when(F.count("*") == 0, F.raise_error(F.lit("no query has labeled hits")).cast("long")).otherwise(F.count("*"))
    return joined.agg(n.alias("n_queries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names])


def judged_with_run(qrels: DataFrame, run: DataFrame, labels: DataFrame) -> DataFrame:
    """All judgments, with the current label of the paper (unknown without one), whether it was retrieved, and whether its query was run."""
    # the run enters once: the papers of each query as a set, which is bounded by the depth of the run
    got = run.groupBy("qkey").agg(F.collect_set("doc_key").alias("got"))
    held = qrels.join(labels.select("doc_key", F.col("label").alias("now")), "doc_key", "left").join(got, "qkey", "left")
    retrieved = F.coalesce(F.array_contains("got", F.col("doc_key")), F.lit(False)).cast("int")
    return held.select("qkey", "doc_key", "relevance", F.coalesce("now", F.lit("unknown")).alias("label"), retrieved.alias("retrieved"), F.col("got").isNotNull().alias("ran"))


def confusion_rates(judged: DataFrame, cut: int = 2) -> DataFrame:
    """(label, tpr, fpr, tp, fn, fp, tn) of the two groups, from judgments of queries that were run; relevant means a grade of at least `cut`."""
    y, r = F.col("relevance") >= cut, F.col("retrieved") == 1
    counts = judged.where(is_labeled()).groupBy("label").agg(
        F.count_if(y & r).alias("tp"), F.count_if(y & ~r).alias("fn"), F.count_if(~y & r).alias("fp"), F.count_if(~y & ~r).alias("tn")
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), 4)
    return counts.withColumn("tpr", rate("tp", "fn")).withColumn("fpr", rate("fp", "tn"))


def equalized_odds(rates: DataFrame) -> DataFrame:
    """Gaps priv - under of the rounded rates and the larger of their sizes."""
    pick = lambda c, g: F.max(F.when(F.col("label") == g, F.col(c)))
    wide = rates.agg(*[pick(c, g).alias(f"{c}_{s}") for c in ("tpr", "fpr") for g, s in ((PRIV, "priv"), (UNDER, "under"))])
    gaps = wide.withColumn("tpr_gap", F.round(F.col("tpr_priv") - F.col("tpr_under"), 4)).withColumn("fpr_gap", F.round(F.col("fpr_priv") - F.col("fpr_under"), 4))
    return gaps.withColumn("eo_difference", F.greatest(F.abs("tpr_gap"), F.abs("fpr_gap")))


def odds_counts(judged: DataFrame, cut: int = 2) -> DataFrame:
    """(label, judged, relevant, retrieved, skipped_queries) by group over the queries that were run, unlabeled judgments under unknown.

    skipped_queries, the judged queries that were not run, is the same in all rows.
    Without a query that was run there are no rows.
    """
    group = F.when(is_labeled(), F.col("label")).otherwise(F.lit("unknown"))
    rows = judged.groupBy(F.col("ran"), F.when(F.col("ran"), group).alias("label")).agg(
        F.count("*").alias("judged"), F.count_if(F.col("relevance") >= cut).alias("relevant"), F.count_if(F.col("retrieved") == 1).alias("retrieved"),
        F.countDistinct(F.when(~F.col("ran"), F.col("qkey"))).alias("n"),
    )
    skipped = F.coalesce(F.max(F.when(~F.col("ran"), F.col("n"))).over(Window.partitionBy()), F.lit(0))  # over at most four rows
    return rows.withColumn("skipped_queries", skipped).where("ran").select("label", "judged", "relevant", "retrieved", "skipped_queries")
