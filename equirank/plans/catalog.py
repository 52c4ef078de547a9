"""All queries of the core and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R_
from ..functions import text as T
from ..operators import corpus as C
from ..operators import fairness as P
from ..operators import labels as L
from ..operators import models as M
from ..operators import pools as O
from ..operators import qrels as Q
from ..operators import retrieval as V
from ..operators import sweep as W
from ..operators import synthesis as Y
from ..operators import utility as U
from ..streaming import resume as R
from . import tables as B
from .tables import read

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# SQL shared by the equivalents ------------------------------------------------

_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


_LABEL = f"CASE WHEN lower({_strip('institution_label')}) IN ('privileged', 'underrepresented') THEN lower({_strip('institution_label')}) ELSE 'unknown' END"
_BASE = rf"""
WITH RECURSIVE papers AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY vec_id DESC) AS rn FROM fairsearch_arxiv WHERE paper_id IS NOT NULL) WHERE rn = 1),
labels AS (SELECT paper_id AS doc_key, {_LABEL} AS label FROM papers),
vectors AS (SELECT paper_id AS doc_key, CAST(embedding AS DOUBLE[]) AS v FROM papers WHERE embedding IS NOT NULL),
judged AS (
  SELECT {_norm('lower(query)')} AS qkey, coalesce(nullif({_strip('paper_id')}, ''), nullif(lower({_norm('title')}), '')) AS doc_key, relevance, judged_at
  FROM qrels_flat WHERE relevance IS NOT NULL AND query IS NOT NULL),
qrels AS (
  SELECT qkey, doc_key, relevance FROM (
    SELECT *, row_number() OVER (PARTITION BY qkey, doc_key ORDER BY judged_at DESC NULLS LAST, relevance DESC) AS rn FROM judged WHERE doc_key IS NOT NULL) WHERE rn = 1),
seeds AS (
  SELECT qkey, doc_key, v FROM (
    SELECT qkey, doc_key, v, row_number() OVER (PARTITION BY qkey ORDER BY relevance DESC, doc_key) AS rn FROM qrels JOIN vectors USING (doc_key)) WHERE rn = 1),
scored AS (
  SELECT s.qkey, c.doc_key, round(list_cosine_similarity(s.v, c.v), 9) AS score FROM seeds s JOIN vectors c ON c.doc_key <> s.doc_key),
hits AS (
  SELECT * FROM (SELECT qkey, doc_key, score, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, doc_key) AS rank FROM scored) WHERE rank <= 100),
labeled AS (SELECT h.*, coalesce(l.label, 'unknown') AS label FROM hits h LEFT JOIN labels l USING (doc_key)),
audit AS (
  SELECT qkey, doc_key, score, label, rank FROM (
    SELECT qkey, doc_key, score, label, row_number() OVER (PARTITION BY qkey ORDER BY rank) AS rank FROM labeled WHERE label <> 'unknown') WHERE rank <= 10),
parity AS (
  SELECT qkey, count(*) AS n, count(*) FILTER (WHERE label = 'privileged') AS n_priv FROM audit GROUP BY 1),
per_query AS (
  SELECT qkey AS qid, n, n_priv, n - n_priv AS n_under, round(n_priv / n, 4) AS priv_rate, round((n - n_priv) / n, 4) AS under_rate,
    round(n_priv / n - (n - n_priv) / n, 4) AS spd, round(CASE WHEN n_priv > 0 THEN (n - n_priv) / n_priv END, 4) AS under_priv_ratio FROM parity),
base AS (
  SELECT count(*) FILTER (WHERE label = 'privileged') AS n_priv, count(*) FILTER (WHERE label = 'underrepresented') AS n_under,
    round(CASE WHEN count(*) FILTER (WHERE label <> 'unknown') > 0 THEN count(*) FILTER (WHERE label = 'privileged') / count(*) FILTER (WHERE label <> 'unknown') END, 4) AS priv_base_rate
  FROM labels),
worth AS (
  SELECT qkey, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE label = 'privileged'), 0) AS p, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE label = 'underrepresented'), 0) AS u
  FROM audit GROUP BY 1),
exposure AS (
  SELECT qkey AS qid, round(p, 4) AS exposure_priv, round(u, 4) AS exposure_under, round(p / (p + u), 4) AS share_priv, round(u / (p + u), 4) AS share_under,
    round((p - u) / (p + u), 4) AS exposure_difference, round(CASE WHEN p > 0 THEN u / p END, 4) AS exposure_ratio FROM worth),
ran AS (
  SELECT q.qkey, q.doc_key, q.relevance, coalesce(l.label, 'unknown') AS label, CASE WHEN a.doc_key IS NULL THEN 0 ELSE 1 END AS retrieved
  FROM qrels q LEFT JOIN labels l USING (doc_key) LEFT JOIN audit a ON a.qkey = q.qkey AND a.doc_key = q.doc_key WHERE q.qkey IN (SELECT qkey FROM audit)),
rates AS (
  SELECT label, count(*) FILTER (WHERE relevance >= 2 AND retrieved = 1) AS tp, count(*) FILTER (WHERE relevance >= 2 AND retrieved = 0) AS fn,
    count(*) FILTER (WHERE relevance < 2 AND retrieved = 1) AS fp, count(*) FILTER (WHERE relevance < 2 AND retrieved = 0) AS tn
  FROM ran WHERE label <> 'unknown' GROUP BY 1),
rated AS (
  SELECT *, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 4) AS tpr, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 4) AS fpr FROM rates),
graded AS (SELECT a.qkey, a.rank, coalesce(q.relevance, 0) AS relevance FROM audit a LEFT JOIN qrels q USING (qkey, doc_key)),
dcg AS (SELECT qkey, sum(relevance / log2(rank + 1)) AS dcg FROM graded GROUP BY 1),
idcg AS (
  SELECT qkey, sum(relevance / log2(r + 1)) AS idcg FROM (
    SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY relevance DESC, doc_key) AS r FROM qrels) WHERE r <= 10 GROUP BY 1),
ndcg AS (SELECT qkey, dcg, idcg, CASE WHEN idcg > 0 THEN dcg / idcg END AS ndcg FROM idcg LEFT JOIN dcg USING (qkey)),
rr AS (SELECT qkey, coalesce(1 / min(rank) FILTER (WHERE relevance > 0), 0) AS rr FROM graded WHERE qkey IN (SELECT qkey FROM qrels) GROUP BY 1)
"""


def _oracle(name: str, sql: str) -> None:
    ORACLE[name] = _BASE + sql


# retrieval --------------------------------------------------------------------


@query
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return B.run(spark, sf, B.TOP_K).withColumn("score", F.round("score", 6))


_oracle("dense_topk", "SELECT qkey AS qid, doc_key, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")


@query
def labeled_topk_oversample(spark: SparkSession, sf: str) -> DataFrame:
    return B.audit_run(spark, sf).select("qid", "doc_key", "label", F.round("score", 6).alias("score"), "rank")


_oracle("labeled_topk_oversample", "SELECT qkey AS qid, doc_key, label, round(score, 6) AS score, rank FROM audit")


@query
def hit_payload(spark: SparkSession, sf: str) -> DataFrame:
    payload = B.papers(spark, sf, "title", "category", "year").withColumnRenamed("paper_id", "doc_key")
    return V.project_hits(B.run(spark, sf, B.TOP_K), payload, ["title", "category", "year"])


_oracle("hit_payload", "SELECT h.qkey AS qid, doc_key, round(score, 4) AS score, rank, p.title, p.category, p.year FROM hits h JOIN papers p ON p.paper_id = doc_key WHERE rank <= 10")

_MMR = """,
lams AS (SELECT unnest({lams})::DOUBLE AS lam),
cand AS (SELECT h.qkey, h.doc_key, h.score, h.rank, c.v FROM hits h JOIN vectors c USING (doc_key) WHERE h.rank <= {depth}),
sim AS (SELECT a.qkey, a.doc_key AS x, b.doc_key AS y, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM cand a JOIN cand b ON a.qkey = b.qkey),
mmr AS (
  SELECT 1 AS step, lam, qkey, doc_key, score, rank, 0::DOUBLE AS worst, row_number() OVER (PARTITION BY lam, qkey ORDER BY score DESC, rank) = 1 AS pick FROM cand, lams
  UNION ALL
  SELECT step + 1, lam, qkey, doc_key, score, rank, worst, row_number() OVER (PARTITION BY lam, qkey ORDER BY lam * score - (1 - lam) * worst DESC, rank) = 1
  FROM (
    SELECT r.step, r.lam, r.qkey, r.doc_key, r.score, r.rank, CASE WHEN r.step = 1 THEN s.s ELSE greatest(r.worst, s.s) END AS worst
    FROM mmr r JOIN mmr p ON p.qkey = r.qkey AND p.lam = r.lam AND p.pick JOIN sim s ON s.qkey = r.qkey AND s.x = p.doc_key AND s.y = r.doc_key
    WHERE NOT r.pick AND r.step < {k})),
diverse AS (SELECT lam, qkey, doc_key, score, step AS rank FROM mmr WHERE pick)
"""


@query
def mmr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return V.mmr(B.run(spark, sf, B.DIVERSE_K), B.vectors(spark, sf), [0.5], B.TOP_K)


_oracle("mmr_rerank", _MMR.format(lams="[0.5]", depth=50, k=10) + "SELECT lam, qkey AS qid, doc_key, round(score, 6) AS query_similarity, rank FROM diverse")

_SWEEP = _MMR.format(lams="[0.5, 0.6, 0.7, 0.8, 0.9, 1.0]", depth=100, k=100) + """,
arm AS (
  SELECT lam, qkey, doc_key, label, rank FROM (
    SELECT lam, qkey, doc_key, label, row_number() OVER (PARTITION BY lam, qkey ORDER BY rank) AS rank
    FROM diverse JOIN labels USING (doc_key) WHERE label <> 'unknown') WHERE rank <= 10)
"""


@query
def mmr_labeled_run(spark: SparkSession, sf: str) -> DataFrame:
    return B.diverse_run(spark, sf, [0.5]).select("lam", "qid", "doc_key", "label", "rank")


_oracle("mmr_labeled_run", _SWEEP.replace("[0.5, 0.6, 0.7, 0.8, 0.9, 1.0]", "[0.5]") + "SELECT lam, qkey AS qid, doc_key, label, rank FROM arm")


@query
def mmr_lambda_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return W.sweep(B.diverse_run(spark, sf, B.LAMBDAS), B.labels(spark, sf), B.qrels(spark, sf))


_oracle(
    "mmr_lambda_sweep",
    _SWEEP + """,
pooled AS (
  SELECT lam, count(DISTINCT qkey) AS q, count(*) FILTER (WHERE label = 'privileged') AS hp, count(*) FILTER (WHERE label = 'underrepresented') AS hu, count(*) AS n
  FROM arm GROUP BY 1),
ag AS (SELECT a.lam, a.qkey, a.rank, q.relevance AS g, coalesce(q.relevance, 0) AS relevance FROM arm a LEFT JOIN qrels q USING (qkey, doc_key) WHERE a.qkey IN (SELECT qkey FROM qrels)),
ad AS (
  SELECT lam, qkey, sum(relevance / log2(rank + 1)) AS dcg, coalesce(1 / min(rank) FILTER (WHERE relevance > 0), 0) AS rr FROM ag GROUP BY 1, 2),
am AS (SELECT lam, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg END), 4) AS mean_ndcg, round(avg(rr), 4) AS mrr FROM ad JOIN idcg USING (qkey) GROUP BY 1),
ac AS (SELECT lam, round(count(g) / count(*), 4) AS coverage FROM ag GROUP BY 1),
er AS (
  SELECT r.lam, l.label, q.relevance >= 2 AS y, a.doc_key IS NOT NULL AS got FROM (SELECT DISTINCT lam, qkey FROM arm) r JOIN qrels q USING (qkey)
  JOIN labels l ON l.doc_key = q.doc_key LEFT JOIN arm a ON a.lam = r.lam AND a.qkey = r.qkey AND a.doc_key = q.doc_key),
et AS (
  SELECT lam, round(avg(CASE WHEN got THEN 1.0 ELSE 0 END) FILTER (WHERE y AND label = 'privileged'), 4) AS tpr_priv, round(avg(CASE WHEN got THEN 1.0 ELSE 0 END) FILTER (WHERE y AND label = 'underrepresented'), 4) AS tpr_under,
    round(avg(CASE WHEN got THEN 1.0 ELSE 0 END) FILTER (WHERE NOT y AND label = 'privileged'), 4) AS fpr_priv, round(avg(CASE WHEN got THEN 1.0 ELSE 0 END) FILTER (WHERE NOT y AND label = 'underrepresented'), 4) AS fpr_under
  FROM er GROUP BY 1)
SELECT lam, round(hp / (b.n_priv * q), 6) AS priv_selection, round(hu / (b.n_under * q), 6) AS under_selection,
  round(hp / (b.n_priv * q) - hu / (b.n_under * q), 6) AS spd, round(CASE WHEN hu > 0 THEN (hp / (b.n_priv * q)) / (hu / (b.n_under * q)) END, 4) AS priv_under_ratio,
  round(hp / n, 6) AS priv_share, tpr_priv, tpr_under, greatest(abs(round(tpr_priv - tpr_under, 4)), abs(round(fpr_priv - fpr_under, 4))) AS eo_difference,
  coverage, CASE WHEN lam >= 0.5 THEN mean_ndcg END AS mean_ndcg, CASE WHEN lam >= 0.5 THEN mrr END AS mrr, lam >= 0.5 AS utility_trustworthy
FROM pooled CROSS JOIN base b JOIN am USING (lam) JOIN ac USING (lam) JOIN et USING (lam)""",
)


@query
def mmr_low_lambdas(spark: SparkSession, sf: str) -> DataFrame:
    """Below the safe lambda utility is masked."""
    return W.sweep(B.diverse_run(spark, sf, [0.2, 0.4, 0.5]), B.labels(spark, sf), B.qrels(spark, sf))


ORACLE["mmr_low_lambdas"] = ORACLE["mmr_lambda_sweep"].replace("[0.5, 0.6, 0.7, 0.8, 0.9, 1.0]", "[0.2, 0.4, 0.5]")

# fairness ---------------------------------------------------------------------


@query
def label_census(spark: SparkSession, sf: str) -> DataFrame:
    return P.label_census(read(spark, sf, "fairsearch_arxiv").select(B.label_of().alias("label")))


_oracle("label_census", f"SELECT {_LABEL} AS label, count(*) AS n FROM fairsearch_arxiv GROUP BY 1")


@query
def corpus_base_rates(spark: SparkSession, sf: str) -> DataFrame:
    return P.corpus_base_rates(B.labels(spark, sf))


_oracle("corpus_base_rates", "SELECT * FROM base")


@query
def parity_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return P.parity_per_query(B.audit_run(spark, sf))


_oracle("parity_per_query", "SELECT * FROM per_query")


@query
def parity_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return P.parity_pooled(B.audit_run(spark, sf), B.labels(spark, sf))


_oracle("parity_pooled", """,
h AS (SELECT count(DISTINCT qkey) AS n_queries, count(*) FILTER (WHERE label = 'privileged') AS hits_priv, count(*) FILTER (WHERE label = 'underrepresented') AS hits_under FROM audit),
r AS (SELECT *, hits_priv / (n_priv * n_queries) AS p, hits_under / (n_under * n_queries) AS u FROM h CROSS JOIN base)
SELECT n_queries, hits_priv, hits_under, round(p, 6) AS priv_selection, round(u, 6) AS under_selection, round(p - u, 6) AS spd,
  round(CASE WHEN u > 0 THEN p / u END, 4) AS priv_under_ratio FROM r""")


@query
def parity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.parity_summary(P.parity_per_query(B.audit_run(spark, sf)), P.corpus_base_rates(B.labels(spark, sf)))


_oracle("parity_summary", """,
m AS (SELECT count(*) AS n_queries, round(avg(priv_rate), 6) AS mean_priv_rate, round(avg(under_rate), 6) AS mean_under_rate, round(avg(spd), 6) AS mean_spd,
  round(avg(under_priv_ratio), 6) AS mean_under_priv_ratio FROM per_query)
SELECT m.*, priv_base_rate, round(mean_priv_rate - priv_base_rate, 6) AS priv_lift FROM m CROSS JOIN base""")


@query
def exposure_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return P.exposure_per_query(B.audit_run(spark, sf))


_oracle("exposure_per_query", "SELECT * FROM exposure")


@query
def exposure_summary(spark: SparkSession, sf: str) -> DataFrame:
    run = B.audit_run(spark, sf)
    return P.exposure_summary(P.exposure_per_query(run), P.parity_per_query(run))


_oracle("exposure_summary", "SELECT count(*) AS n_queries, " + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}" for c in ("share_priv", "share_under", "exposure_difference", "exposure_ratio", "priv_rate", "under_rate", "spd", "under_priv_ratio")
) + " FROM exposure JOIN per_query USING (qid)")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return P.judged_with_run(B.qrels(spark, sf), B.audit_run(spark, sf), B.labels(spark, sf))


@query
def confusion_rates(spark: SparkSession, sf: str) -> DataFrame:
    return P.confusion_rates(_judged(spark, sf).where("ran"))


_oracle("confusion_rates", "SELECT * FROM rated")


@query
def equalized_odds(spark: SparkSession, sf: str) -> DataFrame:
    return P.equalized_odds(P.confusion_rates(_judged(spark, sf).where("ran")))


_oracle("equalized_odds", """,
w AS (SELECT max(tpr) FILTER (WHERE label = 'privileged') AS tpr_priv, max(tpr) FILTER (WHERE label = 'underrepresented') AS tpr_under,
  max(fpr) FILTER (WHERE label = 'privileged') AS fpr_priv, max(fpr) FILTER (WHERE label = 'underrepresented') AS fpr_under FROM rated)
SELECT *, round(tpr_priv - tpr_under, 4) AS tpr_gap, round(fpr_priv - fpr_under, 4) AS fpr_gap,
  greatest(abs(round(tpr_priv - tpr_under, 4)), abs(round(fpr_priv - fpr_under, 4))) AS eo_difference FROM w""")


@query
def eo_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.odds_counts(_judged(spark, sf))


_oracle("eo_counts", """SELECT label, count(*) AS judged, count(*) FILTER (WHERE relevance >= 2) AS relevant, count(*) FILTER (WHERE retrieved = 1) AS retrieved,
  (SELECT count(DISTINCT qkey) FROM qrels WHERE qkey NOT IN (SELECT qkey FROM audit)) AS skipped_queries FROM ran GROUP BY 1""")

# utility ----------------------------------------------------------------------


@query
def ndcg_per_query(spark: SparkSession, sf: str) -> DataFrame:
    n = U.ndcg_per_query(B.audit_run(spark, sf), B.qrels(spark, sf))
    return n.select("qkey", *[F.round(c, 6).alias(c) for c in ("dcg", "idcg", "ndcg")])


_oracle("ndcg_per_query", "SELECT qkey, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(ndcg, 6) AS ndcg FROM ndcg")


@query
def mrr_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return U.reciprocal_rank(B.audit_run(spark, sf), B.qrels(spark, sf)).withColumn("rr", F.round("rr", 6))


_oracle("mrr_per_query", "SELECT qkey, round(rr, 6) AS rr FROM rr")


@query
def utility_summary(spark: SparkSession, sf: str) -> DataFrame:
    return U.utility_summary(B.audit_run(spark, sf), B.qrels(spark, sf))


_oracle("utility_summary", """SELECT round(avg(ndcg), 4) AS mean_ndcg, round(avg(rr), 4) AS mrr, count(ndcg) AS n_ndcg, count(rr) AS n_rr,
  count(*) FILTER (WHERE dcg IS NULL) AS n_missing FROM ndcg LEFT JOIN rr USING (qkey)""")


@query
def utility_delta(spark: SparkSession, sf: str) -> DataFrame:
    summary = U.utility_summary(B.diverse_run(spark, sf, [0.5, 1.0]), B.qrels(spark, sf), keys=("lam",))
    return U.utility_delta(summary, "lam", 1.0, 0.5)


_oracle("utility_delta", _SWEEP.replace("[0.5, 0.6, 0.7, 0.8, 0.9, 1.0]", "[0.5, 1.0]") + """,
ag AS (SELECT a.lam, a.qkey, a.rank, coalesce(q.relevance, 0) AS relevance FROM arm a LEFT JOIN qrels q USING (qkey, doc_key) WHERE a.qkey IN (SELECT qkey FROM qrels)),
ad AS (SELECT lam, qkey, sum(relevance / log2(rank + 1)) AS dcg, coalesce(1 / min(rank) FILTER (WHERE relevance > 0), 0) AS rr FROM ag GROUP BY 1, 2),
am AS (SELECT lam, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg END), 4) AS n, round(avg(rr), 4) AS m FROM ad JOIN idcg USING (qkey) GROUP BY 1)
SELECT round(max(n) FILTER (WHERE lam = 0.5) - max(n) FILTER (WHERE lam = 1.0), 4) AS delta_mean_ndcg,
  round(max(m) FILTER (WHERE lam = 0.5) - max(m) FILTER (WHERE lam = 1.0), 4) AS delta_mrr FROM am""")


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    return Q.relevant_pairs(read(spark, sf, "retrieval_queries"))


@query
def precision_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return U.precision_recall(B.run(spark, sf, B.TOP_K).withColumn("qkey", F.col("qid")), _relevant(spark, sf))


_PR = f""",
rel AS (SELECT DISTINCT lower({_norm('query')}) AS qkey, unnest(relevant_ids) AS doc_key FROM retrieval_queries WHERE len(relevant_ids) > 0),
goal AS (SELECT qkey, count(*) AS nr FROM rel WHERE doc_key IS NOT NULL GROUP BY 1),
got AS (SELECT h.qkey, count(*) AS n, count(r.doc_key) AS g FROM hits h LEFT JOIN rel r USING (qkey, doc_key) WHERE rank <= 10 GROUP BY 1),
pr AS (SELECT qkey, round(coalesce(g / n, 0), 4) AS precision, round(coalesce(g / nr, 0), 4) AS recall FROM goal LEFT JOIN got USING (qkey))
"""
_oracle("precision_recall_at_k", _PR + "SELECT * FROM pr")


@query
def pr_summary(spark: SparkSession, sf: str) -> DataFrame:
    return U.precision_recall_summary(precision_recall_at_k(spark, sf))


_oracle("pr_summary", _PR + "SELECT count(*) AS n_queries, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall FROM pr")


@query
def judged_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return U.judged_coverage(B.audit_run(spark, sf), B.qrels(spark, sf))


_oracle("judged_coverage", """SELECT count(*) AS n_hits, count(q.relevance) AS n_judged, round(count(q.relevance) / count(*), 4) AS coverage
FROM audit a LEFT JOIN qrels q USING (qkey, doc_key) WHERE a.qkey IN (SELECT qkey FROM qrels)""")

# judgments and pools ----------------------------------------------------------


@query
def qrels_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return B.qrels(spark, sf)


_oracle("qrels_last_wins", "SELECT * FROM qrels")


@query
def live_doc_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The paper_id of a judged row, else its title, else when it was judged."""
    rows = read(spark, sf, "qrels_flat").withColumn("at_us", F.unix_micros("judged_at"))
    return rows.groupBy(Q.live_doc_key(["paper_id", "title", "at_us"]).alias("doc_key")).agg(F.count("*").alias("n"))


ORACLE["live_doc_keys"] = "SELECT coalesce(paper_id, title, CAST(epoch_us(judged_at) AS VARCHAR)) AS doc_key, count(*) AS n FROM qrels_flat GROUP BY 1"


@query
def grade_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return O.grade_distribution(B.qrels(spark, sf))


_oracle("grade_distribution", "SELECT relevance, count(*) AS n FROM qrels GROUP BY 1")


@query
def query_set_load(spark: SparkSession, sf: str) -> DataFrame:
    return Q.query_set(read(spark, sf, "retrieval_queries"), "query")


ORACLE["query_set_load"] = f"""SELECT row_number() OVER (ORDER BY q, s) - 1 AS qid, s AS query, lower({_norm('q')}) AS qkey
FROM (SELECT query AS q, {_strip('query')} AS s FROM retrieval_queries) WHERE s <> ''"""


@query
def labeled_query_set(spark: SparkSession, sf: str) -> DataFrame:
    return Q.labeled_query_set(read(spark, sf, "retrieval_queries").where(F.size("relevant_ids") > 0)).select(
        "query", F.array_join(F.array_sort("relevant_ids"), ",").alias("relevant_ids"))


ORACLE["labeled_query_set"] = f"SELECT {_strip('query')} AS query, list_aggregate(list_sort(list_distinct(relevant_ids)), 'string_agg', ',') AS relevant_ids FROM retrieval_queries WHERE len(relevant_ids) > 0"


@query
def existing_queries(spark: SparkSession, sf: str) -> DataFrame:
    return Q.existing_queries(read(spark, sf, "qrels_flat").select("query"), read(spark, sf, "retrieval_queries"))


ORACLE["existing_queries"] = f"SELECT query FROM qrels_flat WHERE lower({_strip('query')}) IN (SELECT lower({_strip('query')}) FROM retrieval_queries)"


@query
def relevance_input(spark: SparkSession, sf: str) -> DataFrame:
    hits = B.run(spark, sf, B.TOP_K).withColumnRenamed("qid", "qkey")
    typed = hits.where("rank = 3").select("qkey", F.concat(F.lit("1, 2,"), F.col("doc_key"), F.lit(", 2 ,")).alias("typed"))
    return Q.parse_relevant(typed, hits).select("qkey", F.array_join("relevant_ids", ",").alias("relevant_ids"))


_oracle("relevance_input", "SELECT qkey, string_agg(doc_key, ',' ORDER BY doc_key) AS relevant_ids FROM hits WHERE rank <= 3 GROUP BY 1 HAVING count(*) = 3")


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    # at lambda 1 the re-ranking is the plain order: both runs come from one search
    both = V.mmr(B.run(spark, sf), B.vectors(spark, sf), [1.0, 0.5], B.POOL_K)
    return O.pool_of(both.select(F.col("qid").alias("qkey"), "doc_key", (F.col("lam") < 1).cast("int").alias("run"), "rank"), B.POOL_K)


@query
def pool_union(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf)


_POOL = _MMR.format(lams="[0.5]", depth=100, k=30) + """,
both_runs AS (SELECT qkey, doc_key, 0 AS run, rank FROM hits WHERE rank <= 30 UNION ALL SELECT qkey, doc_key, 1, rank FROM diverse),
pool AS (
  SELECT qkey, doc_key, row_number() OVER (PARTITION BY qkey ORDER BY run, rank, doc_key) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY qkey, doc_key ORDER BY run, rank) AS rn FROM both_runs) WHERE rn = 1),
open_pool AS (SELECT p.* FROM pool p ANTI JOIN qrels q USING (qkey, doc_key))
"""
_oracle("pool_union", _POOL + "SELECT * FROM pool")


@query
def unjudged_pool(spark: SparkSession, sf: str) -> DataFrame:
    return O.unjudged(_pool(spark, sf), B.qrels(spark, sf))


_oracle("unjudged_pool", _POOL + "SELECT * FROM open_pool")


@query
def batch_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return O.chunked(unjudged_pool(spark, sf), 50, ["qkey"], ["pos"])


_oracle("batch_chunks", _POOL + """, n AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY pos) AS i FROM open_pool)
SELECT qkey, doc_key, pos, (i - 1) // 50 AS batch, (i - 1) % 50 + 1 AS id FROM n""")


@query
def complete_batches(spark: SparkSession, sf: str) -> DataFrame:
    rel = B.qrels(spark, sf)
    batches = O.chunked(rel, 5, ["qkey"], ["doc_key"]).withColumn("batch", F.concat_ws("|", "qkey", "batch"))
    answers = batches.where("relevance > 0 or id <> 2").select("batch", "id", (F.col("relevance") * 2 - 1).alias("grade"), F.col("doc_key").alias("pos"))
    return Q.complete_batches(answers, batches.select("batch", "id", "qkey", "doc_key"))


_oracle("complete_batches", """, n AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY doc_key) AS i FROM qrels),
b AS (SELECT *, (i - 1) // 5 AS batch, relevance > 0 OR (i - 1) % 5 + 1 <> 2 AS answered FROM n)
SELECT qkey, doc_key, greatest(0, least(3, relevance * 2 - 1)) AS relevance FROM (SELECT *, bool_and(answered) OVER (PARTITION BY qkey, batch) AS whole FROM b) WHERE whole""")


@query
def auto_qrels(spark: SparkSession, sf: str) -> DataFrame:
    payload = B.papers(spark, sf, "title", "abstract").withColumnRenamed("paper_id", "doc_key")
    hits = B.run(spark, sf, B.POOL_K).withColumnRenamed("qid", "qkey")
    queries = hits.select("qkey", F.col("qkey").alias("query")).distinct()
    return Q.auto_qrels(hits, payload, queries, (0.60, 0.50, 0.40))


@query
def auto_qrels_by_title(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of an unknown year stand for points without paper_id, which their title tells apart."""
    known = F.when(F.col("year") > 1900, F.col("paper_id"))
    payload = B.papers(spark, sf, "title", "abstract", "year").select(F.col("paper_id").alias("doc_key"), "title", "abstract", known.alias("paper_id"))
    hits = B.run(spark, sf).withColumnRenamed("qid", "qkey")
    return Q.auto_qrels(hits, payload, hits.select("qkey", F.col("qkey").alias("query")).distinct(), (0.30, 0.25, 0.20))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(translate(lower({x}), ',.:;!?()[]{{}}\"''`/\\|-_', '                    '), '{ws}+'), lambda w: length(w) > 2))".replace(r"\\|", "\\|").replace(r'\"', '"')


def _tokens(x: str) -> str:
    return _TOKENS.format(x=_norm(f"coalesce({x}, '')"), ws=_WS)


_oracle("auto_qrels", f""",
t AS (
  SELECT h.qkey, h.doc_key, h.score, h.rank, {_tokens('h.qkey')} AS qt,
    {_tokens("coalesce(p.title, '') || ' ' || coalesce(p.abstract, '')")} AS tt
  FROM hits h JOIN papers p ON p.paper_id = h.doc_key WHERE h.rank <= 30),
o AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, tt)) / len(qt) END AS overlap FROM t),
j AS (SELECT *, CASE WHEN score >= 0.6 AND overlap >= 0.2 THEN 3 WHEN score >= 0.5 AND overlap >= 0.1 THEN 2 WHEN score >= 0.4 THEN 1 END AS relevance FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY rank) AS r FROM j WHERE relevance IS NOT NULL)
SELECT qkey, doc_key, r AS rank, relevance, round(score, 4) AS score, round(overlap, 4) AS lexical_overlap FROM r WHERE r <= 10""")

_oracle("auto_qrels_by_title", f""",
t AS (
  SELECT h.qkey, h.doc_key, h.score, h.rank, coalesce(CASE WHEN p.year > 1900 THEN p.paper_id END, nullif({_norm('p.title')}, '')) AS paper, {_tokens('h.qkey')} AS qt,
    {_tokens("coalesce(p.title, '') || ' ' || coalesce(p.abstract, '')")} AS tt
  FROM hits h JOIN papers p ON p.paper_id = h.doc_key),
o AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, tt)) / len(qt) END AS overlap FROM t),
j AS (SELECT *, CASE WHEN score >= 0.3 AND overlap >= 0.2 THEN 3 WHEN score >= 0.25 AND overlap >= 0.1 THEN 2 WHEN score >= 0.2 THEN 1 END AS relevance FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY qkey, paper ORDER BY rank) AS n FROM j WHERE relevance IS NOT NULL AND paper IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY rank) AS r FROM u WHERE n = 1)
SELECT qkey, doc_key, r AS rank, relevance, round(score, 4) AS score, round(overlap, 4) AS lexical_overlap FROM r WHERE r <= 10""")

# text -------------------------------------------------------------------------


@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "raw_snapshot").select("id", F.unix_micros("ingested_at").alias("at_us"), T.normalize_text("title").alias("title"), T.normalize_query("abstract").alias("abstract"))


ORACLE["normalize_text"] = f"SELECT id, epoch_us(ingested_at) AS at_us, {_norm('title')} AS title, lower({_norm('abstract')}) AS abstract FROM raw_snapshot"


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = read(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return tokens.select("doc_id", F.array_join(F.array_sort("t"), " ").alias("tokens"), F.size("t").alias("n"))


ORACLE["tokenize"] = f"SELECT doc_id, coalesce(list_aggregate(list_sort(t), 'string_agg', ' '), '') AS tokens, len(t) AS n FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"


@query
def lexical_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "qrels_flat").join(B.papers(spark, sf, "abstract").drop("vec_id"), "paper_id")
    return rows.select("query", "paper_id", F.unix_micros("judged_at").alias("at_us"), F.round(T.overlap_ratio(T.tokenize("query"), T.tokenize("abstract")), 6).alias("overlap"))


_oracle("lexical_overlap", f""", t AS (SELECT q.query, q.paper_id, q.judged_at, {_tokens('q.query')} AS a, {_tokens('p.abstract')} AS b FROM qrels_flat q JOIN papers p USING (paper_id))
SELECT query, paper_id, epoch_us(judged_at) AS at_us, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap FROM t""")


@query
def title_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "qrels_flat").select("query", "paper_id", "judged_at", "title").join(B.papers(spark, sf, "title").select("paper_id", F.col("title").alias("indexed")), "paper_id")
    return rows.select("query", "paper_id", F.unix_micros("judged_at").alias("at_us"), F.round(T.jaccard(F.col("title"), F.col("indexed")), 6).alias("similarity"))


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{_WS}+'), lambda w: w <> ''))"


_oracle("title_jaccard", f""", t AS (SELECT q.query, q.paper_id, q.judged_at, {_words('q.title')} AS a, {_words('p.title')} AS b FROM qrels_flat q JOIN papers p USING (paper_id))
SELECT query, paper_id, epoch_us(judged_at) AS at_us, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM t""")


@query
def sanitize_title(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "fairsearch_arxiv").select("vec_id", T.sanitize_title("title").alias("title"))


ORACLE["sanitize_title"] = "SELECT vec_id, substring(" + _norm(r"regexp_replace(regexp_replace(title, '[\r\n]', ' ', 'g'), '[\\$%&|<>{}()\[\]]', ' ', 'g')") + ", 1, 200) AS title FROM fairsearch_arxiv"


@query
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "fairsearch_arxiv").select("vec_id", T.embedding_text(F.col("title"), F.col("abstract")).alias("text"))


ORACLE["embedding_text"] = "SELECT vec_id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text FROM fairsearch_arxiv"


@query
def short_titles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "fairsearch_arxiv").select("vec_id", T.shorten(F.col("title"), 40).alias("title"))


ORACLE["short_titles"] = "SELECT vec_id, CASE WHEN length(title) > 40 THEN substring(title, 1, 37) || '...' ELSE title END AS title FROM fairsearch_arxiv"


@query
def id_from_url(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "fairsearch_arxiv").where("paper_id is not null")
    url = F.concat(F.when(F.col("year") > 2015, "https://arxiv.org/abs/").when(F.col("year") > 2010, "http://arxiv.org/abs/").otherwise("https://example.org/"), "paper_id", F.lit("v2"))
    return rows.select("vec_id", T.arxiv_id(url).alias("arxiv_id"))


ORACLE["id_from_url"] = "SELECT vec_id, CASE WHEN year > 2010 THEN split_part(paper_id || 'v2', 'v', 1) END AS arxiv_id FROM fairsearch_arxiv WHERE paper_id IS NOT NULL"


@query
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(F.lit("Here it is: ```json\n"), F.col("props"), F.lit("\n``` as asked"))
    return read(spark, sf, "events").select("event_id", T.tolerant_json(wrapped, "k BIGINT")["k"].alias("k"))


ORACLE["tolerant_json"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


@query
def build_context(spark: SparkSession, sf: str) -> DataFrame:
    payload = B.papers(spark, sf, "title", "abstract").withColumnRenamed("paper_id", "doc_key")
    hits = B.run(spark, sf, B.TOP_K).join(payload, "doc_key")
    return hits.groupBy("qid").agg(T.context_block(F.collect_list(F.struct("rank", "title", "abstract"))).alias("context"))


_oracle("build_context", r"""SELECT h.qkey AS qid, string_agg('[' || rank || '] Title: ' || coalesce(p.title, 'N/A') || chr(10) || '    Abstract: ' || coalesce(p.abstract, ''), chr(10) || chr(10) ORDER BY rank) AS context
FROM hits h JOIN papers p ON p.paper_id = h.doc_key WHERE rank <= 10 GROUP BY 1""")


@query
def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    payload = B.papers(spark, sf, "title", "abstract").withColumnRenamed("paper_id", "doc_key")
    hits = B.run(spark, sf, B.TOP_K).join(payload, "doc_key")
    return hits.groupBy("qid").agg(T.judge_request(F.col("qid"), F.collect_list(F.struct("rank", "title", "abstract"))).alias("request"))


_oracle("judge_requests", r"""SELECT h.qkey AS qid, 'Query: ' || h.qkey || chr(10) || chr(10) || 'Papers to judge:' || chr(10) ||
  string_agg(chr(10) || '[' || rank || '] Title: ' || coalesce(p.title, '') || chr(10) || 'Abstract: ' || substring(coalesce(p.abstract, ''), 1, 800), chr(10) ORDER BY rank) AS request
FROM hits h JOIN papers p ON p.paper_id = h.doc_key WHERE rank <= 10 GROUP BY 1""")


@query
def stance_requests(spark: SparkSession, sf: str) -> DataFrame:
    payload = B.papers(spark, sf, "title", "abstract").withColumnRenamed("paper_id", "doc_key")
    hits = B.run(spark, sf, B.TOP_K).join(payload, "doc_key")
    return hits.groupBy("qid").agg(T.stance_request(F.col("qid"), F.collect_list(F.struct("rank", "title", "abstract"))).alias("request"))


def _lines(text: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


_oracle("stance_requests", f"""SELECT h.qkey AS qid, 'Query:' || chr(10) || h.qkey || chr(10) || chr(10) || {_lines(T.STANCE_TASK)} || chr(10) ||
  string_agg(chr(10) || 'Paper ' || rank || chr(10) || coalesce(p.title, '') || chr(10) || coalesce(p.abstract, '') || chr(10), '' ORDER BY rank) AS request
FROM hits h JOIN papers p ON p.paper_id = h.doc_key WHERE rank <= 10 GROUP BY 1""")


@query
def summary_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Abstracts stand for generated summaries, titles for their queries."""
    rows = read(spark, sf, "fairsearch_arxiv").where("title is not null")
    return rows.select("vec_id", T.summary_request(F.col("title"), F.col("abstract")).alias("request"))


ORACLE["summary_requests"] = f"""SELECT vec_id, 'Query:' || chr(10) || title || chr(10) || chr(10) || 'Summary:' || chr(10) || coalesce(abstract, '') || chr(10) || chr(10) || {_lines(T.SUMMARY_TASK)} AS request
FROM fairsearch_arxiv WHERE title IS NOT NULL"""


@query
def summary_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a chatty model made of the judgments, some with escapes that are no JSON, some without JSON."""
    ratio = F.round(F.col("relevance") / 3, 2).cast("string")
    answer = F.when(F.col("relevance") == 0, F.lit("I cannot tell.")).otherwise(
        F.concat(F.lit("Sure:\n```json\n{\"note\": \"about $\\alpha$ and \\u12 it\\'s\", \"pro_consensus_ratio\": "), ratio, F.lit(", \"dissenting_ratio\": 0.25}\n``` as {asked}"))
    )
    rows = read(spark, sf, "qrels_flat").where("relevance is not null").select("query", F.unix_micros("judged_at").alias("at_us"), F.struct("query", "paper_id", F.unix_micros("judged_at").alias("at_us")).alias("id"), answer.alias("answer"))
    return M.summary_answers(rows).select("id.*", "summary_pro_ratio", "summary_dissenting_ratio")


ORACLE["summary_ratios"] = """SELECT query, paper_id, epoch_us(judged_at) AS at_us, round(relevance / 3, 2)::DOUBLE AS summary_pro_ratio, 0.25::DOUBLE AS summary_dissenting_ratio
FROM qrels_flat WHERE relevance > 0"""

# labels -----------------------------------------------------------------------

#: The tier of the test rules: institutions of these countries.
TIER_COUNTRIES = ("Zephyria", "Nordavia")


def _rules(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Rules from the table of canonical names, and the names that hold one of them."""
    names = read(spark, sf, "canonical_values").where("kind = 'institution'").select(F.col("canonical_name").alias("name"), "country")
    normal = names.select(L.normalized_name("name").alias("normalized"), "country").distinct()
    known = L.few(normal.select(F.struct("normalized", "country")), L.MAX_RULES)
    tier = sorted({(country, entry) for entry, country in known if country in TIER_COUNTRIES})
    entries = {entry for _, entry in tier}
    alike = sorted({entry for entry, _ in known if entry and entry.startswith("city university of ")} - entries)
    return spark.createDataFrame(tier, "tier string, entry string"), alike


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """(paper_id, affiliations): the last cached row of each paper."""
    rows = read(spark, sf, "affiliation_cache").where("paper_id is not null")
    return rows.groupBy("paper_id").agg(F.max(F.struct("cached_at", "affiliations"))["affiliations"].alias("affiliations"))


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cache = _cache(spark, sf)
    return cache, L.match_rules(cache.select(F.explode("affiliations").alias("name")), *_rules(spark, sf))


_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_THIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _fold(x: str) -> str:
    full, thin = _FULL.replace("'", "''"), _THIN.replace("'", "''")
    wide = f"translate(replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), '{full}{_SPACES}', '{thin}{' ' * len(_SPACES)}')"
    plain = rf"regexp_replace(strip_accents({wide}), '[^\x00-\x7F]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(lower({plain}), '[,.]', ' ', 'g'), '\s+', ' ', 'g'))"


_LABELS = rf"""
WITH cache AS (SELECT paper_id, affiliations FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY cached_at DESC, affiliations DESC) AS rn FROM affiliation_cache WHERE paper_id IS NOT NULL) WHERE rn = 1),
normal AS (SELECT {_fold('canonical_name')} AS entry, country AS tier FROM canonical_values WHERE kind = 'institution'),
rules AS (SELECT DISTINCT entry, tier FROM normal WHERE tier IN ('Zephyria', 'Nordavia')),
alike AS (SELECT DISTINCT entry FROM normal WHERE entry LIKE 'city university of %' AND entry NOT IN (SELECT entry FROM rules)),
mentions AS (SELECT paper_id, unnest(affiliations) AS name, generate_subscripts(affiliations, 1) - 1 AS pos FROM cache),
names AS (SELECT DISTINCT name, {_fold('name')} AS normalized FROM mentions WHERE name IS NOT NULL),
blanked AS (SELECT name, normalized, list_reduce(list_prepend(normalized, (SELECT coalesce(list(entry ORDER BY entry), []) FROM alike)), lambda a, b: replace(a, b, ' ')) AS t FROM names),
matched AS (
  SELECT b.name, any_value(b.normalized) AS normalized, arg_min(r.entry, r.tier || '|' || r.entry) AS trigger
  FROM blanked b LEFT JOIN rules r ON contains(b.t, r.entry) AND regexp_matches(b.t, '\b' || r.entry || '\b') GROUP BY 1),
facts AS (
  SELECT c.paper_id, count(m.pos) AS n, arg_min(t.trigger, m.pos) FILTER (WHERE t.trigger IS NOT NULL) AS trigger
  FROM cache c LEFT JOIN mentions m USING (paper_id) LEFT JOIN matched t ON t.name = m.name GROUP BY 1),
classified AS (SELECT paper_id, CASE WHEN n = 0 THEN 'unknown' WHEN trigger IS NOT NULL THEN 'privileged' ELSE 'underrepresented' END AS label, trigger FROM facts),
under AS (
  SELECT t.normalized, count(*) AS n_mentions FROM mentions m JOIN classified c ON c.paper_id = m.paper_id AND c.label = 'underrepresented' JOIN matched t ON t.name = m.name GROUP BY 1)
"""


@query
def institution_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return L.normalized_names(read(spark, sf, "authorships").select(F.col("raw_affiliation").alias("name")))


ORACLE["institution_normalize"] = f"SELECT DISTINCT raw_affiliation AS name, {_fold('raw_affiliation')} AS normalized FROM authorships WHERE raw_affiliation IS NOT NULL"


@query
def institution_classify(spark: SparkSession, sf: str) -> DataFrame:
    return L.classify(*_matched(spark, sf))


ORACLE["institution_classify"] = _LABELS + "SELECT * FROM classified"


@query
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_distribution(L.classify(*_matched(spark, sf)))


ORACLE["label_distribution"] = _LABELS + "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM classified GROUP BY 1"


@query
def trigger_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return L.trigger_histogram(L.classify(*_matched(spark, sf)))


ORACLE["trigger_histogram"] = _LABELS + "SELECT trigger, count(*) AS n_papers FROM classified WHERE label = 'privileged' GROUP BY 1"


@query
def trigger_examples(spark: SparkSession, sf: str) -> DataFrame:
    return L.trigger_examples(*_matched(spark, sf)).withColumn("examples", F.array_join("examples", " | "))


ORACLE["trigger_examples"] = _LABELS + """, e AS (SELECT trigger, name, row_number() OVER (PARTITION BY trigger ORDER BY name) AS r FROM matched WHERE trigger IS NOT NULL)
SELECT trigger, string_agg(name, ' | ' ORDER BY name) AS examples FROM e WHERE r <= 3 GROUP BY 1"""


def _under(spark: SparkSession, sf: str) -> DataFrame:
    cache, matched = _matched(spark, sf)
    return L.name_histogram(cache, L.classify(cache, matched), matched)


@query
def underrepresented_names(spark: SparkSession, sf: str) -> DataFrame:
    return _under(spark, sf)


ORACLE["underrepresented_names"] = _LABELS + "SELECT * FROM under"


@query
def most_common_names(spark: SparkSession, sf: str) -> DataFrame:
    return L.most_common(_under(spark, sf), 40)


ORACLE["most_common_names"] = _LABELS + "SELECT * FROM under ORDER BY n_mentions DESC, normalized LIMIT 40"


@query
def near_misses(spark: SparkSession, sf: str) -> DataFrame:
    return L.near_misses(_under(spark, sf), _rules(spark, sf)[0])


@query
def host_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "affiliation_cache").select("paper_id", "cached_at", L.institutional_names(F.col("affiliations"), ["archive", "portal", "repository"]).alias("a"))
    return rows.select("paper_id", F.unix_micros("cached_at").alias("at_us"), F.array_join("a", "|").alias("affiliations"), F.size("a").alias("n"))


ORACLE["host_filter"] = """SELECT paper_id, epoch_us(cached_at) AS at_us, coalesce(list_aggregate(a, 'string_agg', '|'), '') AS affiliations, len(a) AS n FROM (
  SELECT paper_id, cached_at, list_filter(affiliations, lambda x: NOT (contains(lower(x), 'archive') OR contains(lower(x), 'portal') OR contains(lower(x), 'repository'))) AS a FROM affiliation_cache)"""


@query
def payload_update(spark: SparkSession, sf: str) -> DataFrame:
    cache, matched = _matched(spark, sf)
    labels = L.classify(cache, matched).join(cache, "paper_id")
    points = read(spark, sf, "fairsearch_arxiv").select("vec_id", "paper_id", "institution_label", "affiliations")
    return L.update_payload(points, labels).withColumn("affiliations", F.array_join("affiliations", "|"))


ORACLE["payload_update"] = _LABELS + """SELECT f.vec_id, f.paper_id, CASE WHEN f.paper_id <> '' THEN coalesce(c.label, 'unknown') ELSE f.institution_label END AS institution_label,
  CASE WHEN f.paper_id <> '' THEN coalesce(list_aggregate(coalesce(a.affiliations, []), 'string_agg', '|'), '') ELSE list_aggregate(f.affiliations, 'string_agg', '|') END AS affiliations
FROM fairsearch_arxiv f LEFT JOIN classified c USING (paper_id) LEFT JOIN cache a USING (paper_id)"""


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the cache, each with an entry of the default rules, a look-alike or a host behind it, by its length."""
    known = [e for names in R_.TIERS.values() for e in names] + R_.LOOK_ALIKES + R_.HOSTS
    names = read(spark, sf, "affiliation_cache").select(F.explode("affiliations").alias("name")).where("name is not null").distinct()
    more = F.element_at(F.array(*[F.lit(k) for k in known]), (F.length("name") * 7 + F.length(F.regexp_replace("name", "[^aeiou]", "")) * 3) % len(known) + 1)
    return names.select(F.concat("name", F.lit(", "), F.initcap(more)).alias("name")).distinct()


_PROBES = f"""
WITH known AS (SELECT {[e for names in R_.TIERS.values() for e in names] + R_.LOOK_ALIKES + R_.HOSTS} AS k),
raw AS (SELECT DISTINCT n AS name FROM (SELECT unnest(affiliations) AS n FROM affiliation_cache) WHERE n IS NOT NULL),
probe AS (SELECT DISTINCT name || ', ' || k[CAST((length(name) * 7 + length(regexp_replace(name, '[^aeiou]', '', 'g')) * 3) % len(k) + 1 AS INT)] AS low FROM raw CROSS JOIN known)
"""


@query
def default_rule_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """The default tiers and look-alikes on all distinct names; tiers go in the order of their names."""
    return L.match_rules(_probes(spark, sf), L.default_rules(spark)).select(F.lower("name").alias("name"), "trigger")


ORACLE["default_rule_triggers"] = _PROBES + f""",
rules AS (SELECT unnest({[t for t, names in R_.TIERS.items() for _ in names]}) AS tier, unnest({[e for names in R_.TIERS.values() for e in names]}) AS entry),
norm AS (SELECT low, {_fold('low')} AS n FROM probe),
blanked AS (SELECT low, list_reduce(list_prepend(n, {R_.LOOK_ALIKES}), lambda a, b: replace(a, b, ' ')) AS t FROM norm)
SELECT lower(any_value(low)) AS name, arg_min(r.entry, r.tier || '|' || r.entry) AS trigger
FROM blanked b LEFT JOIN rules r ON contains(b.t, r.entry) AND regexp_matches(b.t, '\\b' || r.entry || '\\b') GROUP BY low"""


@query
def default_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return _probes(spark, sf).select(F.lower("name").alias("name"), L.is_institutional(F.col("name")).alias("institutional"))


ORACLE["default_hosts"] = _PROBES + f"SELECT lower(low) AS name, len(list_filter({R_.HOSTS}, lambda h: contains(lower(low), h))) = 0 AS institutional FROM probe"


@query
def missingness_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    points = read(spark, sf, "fairsearch_arxiv").select(B.label_of().alias("label"), "year")
    return L.coverage_by_stratum(points, "year")


_oracle("missingness_by_stratum", f"""SELECT year AS stratum, count(*) AS n, round(count(*) FILTER (WHERE l <> 'unknown') / count(*), 6) AS labeled_share,
  round(CASE WHEN count(*) FILTER (WHERE l <> 'unknown') > 0 THEN count(*) FILTER (WHERE l = 'privileged') / count(*) FILTER (WHERE l <> 'unknown') END, 6) AS priv_share
FROM (SELECT year, {_LABEL} AS l FROM fairsearch_arxiv) GROUP BY 1""")

# resume -----------------------------------------------------------------------


@query
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    work = read(spark, sf, "fairsearch_arxiv").select("vec_id", "paper_id")
    return R.remaining(work, read(spark, sf, "affiliation_cache"), ["paper_id"])


ORACLE["resume_anti"] = "SELECT vec_id, paper_id FROM fairsearch_arxiv f WHERE NOT EXISTS (SELECT 1 FROM affiliation_cache a WHERE a.paper_id = f.paper_id)"


@query
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    fresh = B.papers(spark, sf, "affiliations").drop("vec_id")
    merged = R.merge_cache(_cache(spark, sf), fresh, "paper_id", "affiliations", only_filled=True)
    return merged.withColumn("affiliations", F.array_join("affiliations", "|"))


ORACLE["cache_merge"] = _BASE + """,
old AS (SELECT paper_id, affiliations FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY cached_at DESC, affiliations DESC) AS r FROM affiliation_cache WHERE paper_id IS NOT NULL) WHERE r = 1),
new AS (SELECT paper_id, affiliations FROM papers WHERE len(affiliations) > 0)
SELECT coalesce(o.paper_id, n.paper_id) AS paper_id, coalesce(list_aggregate(coalesce(n.affiliations, o.affiliations), 'string_agg', '|'), '') AS affiliations
FROM old o FULL OUTER JOIN new n ON o.paper_id = n.paper_id"""


@query
def stage_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return R.stage_recovery(read(spark, sf, "affiliation_cache"), "paper_id", "affiliations")


ORACLE["stage_recovery"] = """SELECT count(*) AS attempted, count(*) FILTER (WHERE len(affiliations) > 0) AS recovered,
  count(*) - count(*) FILTER (WHERE len(affiliations) > 0) AS remaining FROM affiliation_cache"""

# corpus -----------------------------------------------------------------------


@query
def category_filter(spark: SparkSession, sf: str) -> DataFrame:
    raw = read(spark, sf, "raw_snapshot")
    return raw.where(C.category_filter(F.col("categories"))).select("id", "categories", F.unix_micros("ingested_at").alias("at_us"), C.category_filter(F.col("categories"), strict=True).alias("strict"))


ORACLE["category_filter"] = r"SELECT id, categories, epoch_us(ingested_at) AS at_us, regexp_matches(categories, '(^|\s)cs\.') AS strict FROM raw_snapshot WHERE contains(categories, 'cs.')"


@query
def clean_projection(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_papers(C.latest_versions(read(spark, sf, "raw_snapshot")).where(C.category_filter(F.col("categories"))))


ORACLE["clean_projection"] = f"""SELECT id AS paper_id, {_strip('title')} AS title, {_strip('abstract')} AS abstract, authors, categories AS category,
  TRY_CAST(coalesce(substring(update_date, 1, 4), '1900') AS INT) AS year
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_date DESC NULLS LAST, ingested_at DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM raw_snapshot WHERE id IS NOT NULL) WHERE rn = 1 AND contains(categories, 'cs.')"""


@query
def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return C.exact_sample(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 75)


ORACLE["deterministic_sample"] = "SELECT doc_id, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 75"


@query
def upsert_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "fairsearch_arxiv").select("vec_id", "paper_id", "title", "year")
    old, new = rows.where("year < 2020"), rows.where("year >= 2015").withColumn("title", F.concat(F.lit("new: "), F.col("title")))
    return C.upsert(old, new, "vec_id")


ORACLE["upsert_points"] = "SELECT vec_id, paper_id, CASE WHEN year >= 2015 THEN 'new: ' || title ELSE title END AS title, year FROM fairsearch_arxiv WHERE year IS NOT NULL"


def _works(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered records in the nested form, made of the authorships: structured and typed names, one location per lookup stage."""
    names = F.col("raw_affiliation")
    by_paper = read(spark, sf, "authorships").where("paper_id is not null").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("authorship_id", names.alias("n"), "lookup_stage"))).alias("a"))
    source = "named_struct('display_name', concat('Archive ', x.lookup_stage), 'host_organization_name', coalesce(x.n, ''), 'type', if(x.lookup_stage = 'stage1', 'repository', 'journal'))"
    return by_paper.select(
        "paper_id",
        F.expr("transform(a, x -> named_struct('institutions', array(named_struct('display_name', x.n)), 'raw_affiliation_strings', array(trim(x.n))))").alias("authorships"),
        F.expr(f"transform(a, x -> named_struct('landing_page_url', concat('http://arxiv.org/abs/', paper_id, 'v', cast(x.authorship_id % 3 as string)), 'source', {source}))").alias("locations"),
    )


@query
def record_institutions(spark: SparkSession, sf: str) -> DataFrame:
    got = C.by_landing_page(_works(spark, sf).withColumnRenamed("paper_id", "requested"))
    return got.select("paper_id", F.array_join(F.array_sort("institutions"), "|").alias("institutions"), F.size("institutions").alias("n"))


ORACLE["record_institutions"] = r"""
WITH a AS (SELECT DISTINCT paper_id, raw_affiliation AS n FROM authorships WHERE paper_id IS NOT NULL),
s AS (SELECT paper_id, n FROM a WHERE n IS NOT NULL AND n <> '' UNION SELECT paper_id, trim(n, ' ') FROM a WHERE n IS NOT NULL),
g AS (SELECT split_part(paper_id, 'v', 1) AS paper_id, list_sort(list(n)) AS l FROM s GROUP BY paper_id),
e AS (SELECT DISTINCT paper_id FROM a)
SELECT split_part(e.paper_id, 'v', 1) AS paper_id, coalesce(list_aggregate(l, 'string_agg', '|'), '') AS institutions, coalesce(len(l), 0) AS n
FROM e LEFT JOIN g ON g.paper_id = split_part(e.paper_id, 'v', 1)"""

@query
def result_label_mix(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_mix(B.with_labels(B.run(spark, sf, B.TOP_K), spark, sf))


_oracle("result_label_mix", "SELECT qkey AS qid, label, count(*) AS n FROM labeled WHERE rank <= 10 GROUP BY 1, 2")

# synthesis --------------------------------------------------------------------


def _stances(spark: SparkSession, sf: str) -> DataFrame:
    """(condition, id, pos, stance): judgments stand for stances, their month for the condition."""
    stance = F.when(F.col("relevance") == 3, "PRO-CONSENSUS").when(F.col("relevance") == 2, "NEUTRAL").when(F.col("relevance") == 1, "DISSENTING").when(F.col("relevance") == 0, "OTHER")
    condition = F.element_at(F.array(F.lit("baseline"), F.lit("mmr"), F.lit("mmr_prompt")), F.dayofmonth("judged_at") % 3 + 1)
    return read(spark, sf, "qrels_flat").where("relevance is not null").select(condition.alias("condition"), F.lower("query").alias("id"), "relevance", stance.alias("stance"))


_STANCES = """WITH s AS (
  SELECT ['baseline', 'mmr', 'mmr_prompt'][CAST(day(judged_at) % 3 + 1 AS INT)] AS condition, lower(query) AS id, relevance,
    CASE relevance WHEN 3 THEN 'PRO-CONSENSUS' WHEN 2 THEN 'NEUTRAL' WHEN 1 THEN 'DISSENTING' ELSE 'OTHER' END AS stance FROM qrels_flat WHERE relevance IS NOT NULL),
d AS (
  SELECT condition, id, count(*) AS n_docs, round(count(*) FILTER (WHERE stance = 'PRO-CONSENSUS') / count(*), 6) AS pro_share,
    round(count(*) FILTER (WHERE stance = 'NEUTRAL') / count(*), 6) AS neutral_share, round(count(*) FILTER (WHERE stance = 'DISSENTING') / count(*), 6) AS dissenting_share FROM s GROUP BY 1, 2),
m AS (SELECT condition, id, round(avg(relevance) / 3, 6) AS summary_pro_ratio FROM s GROUP BY 1, 2),
c AS (SELECT condition, id, pro_share, summary_pro_ratio, round(summary_pro_ratio - pro_share, 6) AS consensus_amplification, round(abs(summary_pro_ratio - pro_share), 6) AS absolute_gap FROM d JOIN m USING (condition, id))
"""


@query
def stance_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return Y.stance_distribution(_stances(spark, sf))


ORACLE["stance_distribution"] = _STANCES + "SELECT * FROM d"


@query
def consensus_amplification(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stances(spark, sf)
    summaries = rows.groupBy("condition", "id").agg(F.round(F.avg("relevance") / 3, 6).alias("summary_pro_ratio"))
    return Y.consensus_amplification(Y.stance_distribution(rows), summaries)


ORACLE["consensus_amplification"] = _STANCES + "SELECT * FROM c"

_CONDITIONS = ["baseline", "mmr", "mmr_prompt"]


@query
def condition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Y.condition_summary(consensus_amplification(spark, sf), ["consensus_amplification", "absolute_gap", "pro_share", "summary_pro_ratio"], _CONDITIONS)


ORACLE["condition_summary"] = _STANCES + """, l AS (
  SELECT condition, 'n' AS measure, count(*)::DOUBLE AS v FROM c GROUP BY 1
  UNION ALL SELECT condition, 'consensus_amplification', round(avg(consensus_amplification), 3) FROM c GROUP BY 1
  UNION ALL SELECT condition, 'absolute_gap', round(avg(absolute_gap), 3) FROM c GROUP BY 1
  UNION ALL SELECT condition, 'pro_share', round(avg(pro_share), 3) FROM c GROUP BY 1
  UNION ALL SELECT condition, 'summary_pro_ratio', round(avg(summary_pro_ratio), 3) FROM c GROUP BY 1)
SELECT measure, max(v) FILTER (WHERE condition = 'baseline') AS baseline, max(v) FILTER (WHERE condition = 'mmr') AS mmr, max(v) FILTER (WHERE condition = 'mmr_prompt') AS mmr_prompt FROM l GROUP BY 1"""


@query
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = consensus_amplification(spark, sf).unpivot(["condition", "id"], ["pro_share", "summary_pro_ratio"], "metric", "value")
    return Y.score_summary(long, _CONDITIONS)


ORACLE["score_summary"] = _STANCES + """, l AS (SELECT condition, 'pro_share' AS metric, pro_share AS v FROM c UNION ALL SELECT condition, 'summary_pro_ratio', summary_pro_ratio FROM c)
SELECT metric, round(avg(v) FILTER (WHERE condition = 'baseline'), 4) AS baseline, round(avg(v) FILTER (WHERE condition = 'mmr'), 4) AS mmr, round(avg(v) FILTER (WHERE condition = 'mmr_prompt'), 4) AS mmr_prompt FROM l GROUP BY 1"""


@query
def zip_conditions(spark: SparkSession, sf: str) -> DataFrame:
    rows = consensus_amplification(spark, sf).select("condition", "id", F.col("id").alias("query"), F.col("pro_share").alias("answer"))
    parts = [rows.where(F.col("condition") == c).drop("condition") for c in _CONDITIONS]
    return Y.zip_conditions(*parts, names=tuple(_CONDITIONS))


ORACLE["zip_conditions"] = _STANCES + """SELECT a.id, a.id AS query, a.pro_share AS baseline, b.pro_share AS mmr, p.pro_share AS mmr_prompt
FROM c a JOIN c b ON a.id = b.id AND b.condition = 'mmr' JOIN c p ON a.id = p.id AND p.condition = 'mmr_prompt' WHERE a.condition = 'baseline'"""


@query
def labeled_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "qrels_flat").where("paper_id is not null").groupBy(F.lower("query").alias("id"), F.col("paper_id").alias("pos")).agg(F.max("relevance").alias("g"))
    stances = rows.where("g is not null").select("id", "pos", F.concat(F.lit("S"), F.col("g").cast("string")).alias("stance"))
    return Y.label_documents(rows.select("id", "pos"), stances)


ORACLE["labeled_documents"] = """WITH r AS (SELECT lower(query) AS id, paper_id AS pos, max(relevance) AS g FROM qrels_flat WHERE paper_id IS NOT NULL GROUP BY 1, 2)
SELECT id, pos, 'S' || g AS stance FROM r WHERE id NOT IN (SELECT id FROM r WHERE g IS NULL)"""
