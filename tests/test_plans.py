"""What the plans must look like."""

from pyspark.sql import functions as F

from equirank.operators import fairness as P
from equirank.operators import retrieval as V
from equirank.plans import tables as B


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_are_pruned(spark, sf):
    text = plan(P.label_census(B.read(spark, sf, "fairsearch_arxiv").select(B.label_of().alias("label"))))
    assert "ReadSchema: struct<institution_label:string>" in text


def test_topk_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(B.run(spark, sf, 10))


def test_label_filter_stays_above_the_rank(spark):
    hits = spark.createDataFrame([("q", "d", 0.5, 1, "unknown")], "qid string, doc_key string, score double, rank int, label string")
    order_text = plan(V.filter_after_rank(V.cut(hits, 100), F.col("label") != "unknown", 10))
    assert order_text.count("WindowGroupLimit") >= 1


def test_no_vectors_in_the_ranking_shuffle(spark, sf):
    text = plan(B.run(spark, sf, 10))
    exchange = text[text.index("== Physical Plan ==") :]
    assert "Exchange hashpartitioning(qid" in exchange and "CartesianProduct" not in exchange


def test_one_search_per_plan(spark, sf):
    from equirank.plans import catalog

    for name in ("pool_union", "eo_counts", "equalized_odds", "mmr_lambda_sweep"):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert text[text.index("== Optimized Logical Plan ==") : text.index("== Physical Plan ==")].count("MapInPandas") == 1, name
