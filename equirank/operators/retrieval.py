"""Exact top-k search, rank-then-filter and greedy re-ranking for many queries in one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import usable

#: Bytes of query vectors and kept hits that a task holds at once (more queries are taken in further blocks), and scores held at once.
QUERY_BYTES, HITS_HELD, SCORES_AT_ONCE = 32_000_000, 2_000_000, 4_000_000
#: So few queries are one block, without counting them first.
FEW_QUERIES = 2_048
#: Scores are rounded to so many digits before ranking, so that ties do not depend on the order of summation.
SCORE_DIGITS = 9


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Best:
    """The k best (score, smaller id) per query among what was added, as long rows; compacted when they double."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """A matrix of scores, a row per id and a column per query."""
        floor = self.floor
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        at, q = np.nonzero(scores >= floor)
        self.rows.append((q, ids[at], scores[at, q]))
        self.held += len(q)
        if self.held > max(2 * self.k * len(self.floor), 100_000):
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, score = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else (np.empty(0, int), np.empty(0, object), np.empty(0))
        code = pd.factorize(ids, sort=True)[0]
        order = np.lexsort((code, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = rank == self.k - 1
        self.floor[q[last]] = score[last]
        keep = rank < self.k
        self.rows, self.held = [(q[keep], ids[keep], score[keep])], int(keep.sum())
        return self.rows[0]


def _score_batches(shared, k: int):
    """Per partition: the k + 1 best documents of each query (one may be excluded), kept over batches of bounded size."""

    def run(batches):
        qids, excluded, matrix = shared.value
        rows_at_once = max(1, SCORES_AT_ONCE // len(qids))
        best = _Best(len(qids), k + 1)
        for pdf in batches:
            ids = pdf["doc_key"].to_numpy()
            for lo in range(0, len(pdf), rows_at_once):
                v = _unit(np.stack(pdf["v"].iloc[lo : lo + rows_at_once].to_numpy()))
                best.add(ids[lo : lo + rows_at_once], np.round(v @ matrix.T, SCORE_DIGITS))
        q, d, score = best.compact()
        keep = np.array([excluded[a] is None or excluded[a] != b for a, b in zip(q, d)], dtype=bool)
        if keep.any():
            yield pd.DataFrame({"qid": qids[q[keep]], "doc_key": list(d[keep]), "score": score[keep]})

    return run


def _query_blocks(asked: DataFrame, k: int):
    """The queries on the driver, a block of bounded size at a time."""
    few = asked.limit(FEW_QUERIES + 1).toPandas()
    if len(few) <= FEW_QUERIES:
        if len(few):
            yield few.sort_values("qid", ignore_index=True)
        return
    facts = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    most = max(2, min(QUERY_BYTES // (8 * facts["size"]), HITS_HELD // (k + 1)))
    blocks = -(-facts["n"] // (most // 2))
    for b in range(blocks):
        # a block is about half of what is allowed, so that uneven hashing stays within it
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
        if len(part):
            yield part.sort_values("qid", ignore_index=True)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_key, score, rank): the k most similar documents of each query by cosine.

    queries: (qid, v[, exclude]), exclude being a doc_key never returned for that
    query; corpus: (doc_key, v), doc_key unique. Ties of the rounded score go to the
    smaller key. Rows without a usable vector take no part. Query vectors go to the
    tasks in blocks of bounded size, and each partition of documents keeps its own k
    best per query, so the shuffle carries at most k + 1 rows per query and partition;
    no vector is shuffled.
    """
    if "exclude" not in queries.columns:
        queries = queries.withColumn("exclude", F.lit(None).cast(corpus.schema["doc_key"].dataType))
    asked = queries.where(usable(F.col("v"))).select("qid", "exclude", "v")
    spark, docs = corpus.sparkSession, corpus.where(usable(F.col("v"))).select("doc_key", "v")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, doc_key {corpus.schema['doc_key'].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    for part in _query_blocks(asked, k):
        excluded = [None if pd.isna(x) else x for x in part["exclude"]]
        shared = spark.sparkContext.broadcast((part["qid"].to_numpy(), excluded, _unit(np.stack(part["v"].to_numpy()))))
        out = out.unionByName(docs.mapInPandas(_score_batches(shared, k), schema))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_key")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filter_after_rank(hits: DataFrame, condition: Column | str, k: int = 10, key: str = "qid") -> DataFrame:
    """Hits that meet the condition, ranked anew, first k. The depth of `hits` stays the limit: what lies beyond it never enters."""
    order = Window.partitionBy(key).orderBy("rank")
    kept = hits.where(condition).withColumn("labeled_rank", F.row_number().over(order)).where(F.col("labeled_rank") <= k)
    return kept.drop("rank").withColumnRenamed("labeled_rank", "rank")


def cut(run: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k)


def greedy_diverse(similarity: np.ndarray, pairs: np.ndarray, k: int, lam: float) -> list[int]:
    """Positions picked by maximal marginal relevance; ties go to the earlier candidate.

    The highest similarity to the picks so far is kept per candidate, so a pick costs one pass.
    """
    n = len(similarity)
    free = np.ones(n, dtype=bool)
    worst = np.zeros(n)
    picks: list[int] = []
    for step in range(min(k, n)):
        value = similarity.copy() if step == 0 else lam * similarity - (1 - lam) * worst
        value[~free] = -np.inf
        best = int(np.argmax(value))
        picks.append(best)
        free[best] = False
        worst = pairs[best].copy() if step == 0 else np.maximum(worst, pairs[best])
    return picks


def mmr(hits: DataFrame, corpus: DataFrame, lambdas: list[float], k: int = 10) -> DataFrame:
    """(lam, qid, doc_key, query_similarity, rank): the candidates re-ranked for each lambda.

    hits: a dense_topk() run to the depth of candidates wanted. Vectors are joined to
    the candidates only; all lambdas of a query are computed in one task from one
    matrix of bounded size (depth x depth).
    """
    candidates = hits.join(corpus.select("doc_key", "v"), "doc_key")
    lams = [float(x) for x in lambdas]
    key_type = hits.schema["doc_key"].dataType.simpleString()
    qid_type = hits.schema["qid"].dataType.simpleString()

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        unit = _unit(np.stack(pdf["v"].to_numpy()))
        sims, pairs = pdf["score"].to_numpy(), np.round(unit @ unit.T, SCORE_DIGITS)
        keys, out = pdf["doc_key"].to_numpy(), []
        for lam in lams:
            for rank, i in enumerate(greedy_diverse(sims, pairs, k, lam), start=1):
                out.append((lam, pdf["qid"].iloc[0], keys[i], round(float(sims[i]), 6), rank))
        return pd.DataFrame(out, columns=["lam", "qid", "doc_key", "query_similarity", "rank"])

    schema = f"lam double, qid {qid_type}, doc_key {key_type}, query_similarity double, rank int"
    return candidates.groupBy("qid").applyInPandas(rerank, schema)


def project_hits(hits: DataFrame, payload: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with payload columns, scores to four digits."""
    return hits.join(payload.select("doc_key", *columns), "doc_key", "left").withColumn("score", F.round("score", 4))
