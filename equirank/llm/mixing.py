"""Problem 8: a mix of sources in target shares of tokens, by cube-method balanced sampling.

A source of A tokens and a target of B tokens uses each of its documents
floor(B / A) times (its cap at most); the fraction left over is the inclusion
probability of one more use. The flight phase moves those probabilities through
the null space of the two balancing equations (documents and tokens): of three
undecided documents at a time it shifts probability along the direction that
leaves both totals unchanged until one of them is 0 or 1. Documents fly in
blocks; each block leaves at most two undecided, which fly again in the next
round, until a source has a single block; its last two land by a draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread

#: Runs of letters or digits, or single other non-blank characters.
TOKEN = r"(?U)[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BLOCK = 5_000
EPS = 1e-9


def plain_tokens(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def tokenizer_tokens(path: str):
    """Counts by a byte-level vocabulary file of ranks (one base64 token and its rank a line)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        enc = tiktoken.Encoding("counts", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        return texts.fillna("").map(lambda t: len(enc.encode_ordinary(t)))

    return count


def source_tokens(docs: DataFrame, tokens=None) -> DataFrame:
    """(doc_id, source, tokens): source trimmed and in lower case; a null text has 0 tokens."""
    count = plain_tokens("text") if tokens is None else tokens("text")
    return spread(docs.select("doc_id", "source", "text"), "doc_id").select("doc_id", F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")).alias("source"), count.alias("tokens"))


def mix_plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: (source, docs, available, target, whole, rest, reachable).

    target is target_bp x T / 10,000 for T tokens over all documents, also those of
    sources without a target. whole is how often every document is used, rest the
    probability of one more use; reachable is false where max_repeats uses fall
    short of the target or the source has no documents.
    """
    totals = counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    every = totals.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("t"))  # of the few sources: the texts are counted once
    facts = (
        targets.join(totals, "source", "left").withColumn("t", every.scalar())
        .withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("target", F.col("target_bp") * F.col("t") / 10000.0)
    )
    times = F.least(F.coalesce(F.try_divide("target", "available"), F.lit(0.0)), F.col("max_repeats").cast("double"))
    short = F.col("max_repeats") * F.col("available") * F.lit(10000) < F.col("target_bp") * F.col("t")
    return facts.withColumn("times", times).select(
        "source", "docs", "available", "target", F.floor("times").alias("whole"), (F.col("times") - F.floor("times")).alias("rest"),
        (~(short | (F.col("docs") == 0))).alias("reachable"), "t", "target_bp", "max_repeats",
    )


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase of one block: probabilities moved to 0 or 1 but for at most two; keeps sum(p) and sum(p x size)."""
    p, t = prob.astype(float).tolist(), size.astype(float).tolist()
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    draws = iter(rng.random(4 * len(todo) + 8).tolist())
    hand: list[int] = []
    at = 0
    while True:
        while len(hand) < 3 and at < len(todo):
            hand.append(todo[at])
            at += 1
        if len(hand) < 3:
            break
        a, b, c = hand
        v = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
        if v == (0.0, 0.0, 0.0):
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(hand, v) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(hand, v) if x)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        rest = []
        for k, x in zip(hand, v):
            y = p[k] + step * x
            p[k] = 0.0 if y <= EPS else 1.0 if y >= 1 - EPS else y
            if 0 < p[k] < 1:
                rest.append(k)
        hand = rest
    return np.array(p)


def _blocks(land: bool, seed: int):
    """The flight of one block; with `land` its last undecided documents are drawn."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF, len(pdf)])
        p = fly(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng)
        if land:
            p = np.where((p > EPS) & (p < 1 - EPS), rng.random(len(p)) < p, p).astype(float)
        return pdf[["doc_id", "source", "tokens"]].assign(p=p)

    return run


def _draw(counted: DataFrame, targets: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(plan, drawn): the plan and the documents of the mix with their copies; texts are counted once."""
    counted = checkpoint(counted)
    plan = checkpoint(mix_plan(counted, targets))
    rows = counted.join(plan.where("docs > 0").select("source", "whole", "rest"), "source")
    schema = "doc_id long, source string, tokens long, p double"
    open_ = rows.where(f"rest > {EPS}").select("doc_id", "source", "tokens", F.col("rest").alias("p"))
    decided, level = None, 0
    while True:
        most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, math.ceil(most / block))
        placed = open_.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level), F.lit(seed)), F.lit(blocks)))
        flown = checkpoint(placed.groupBy("source", "block").applyInPandas(_blocks(blocks == 1, seed), schema))
        done = flown.where("p in (0.0, 1.0)")
        decided = done if decided is None else decided.union(done)
        if blocks == 1:
            break
        open_, level = flown.where("p not in (0.0, 1.0)"), level + 1
    extra = decided.where("p = 1.0").select("doc_id", F.lit(1).alias("extra"))
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    drawn = rows.join(extra, "doc_id", "left").select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    return plan, drawn


def mix(counted: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mix, with how often each is used (1 at least).

    Documents of sources without a target are not used. doc_id must be unique.
    """
    return _draw(counted, targets, block, seed)[1]


def mix_report(counted: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(source, target_share, real_share, docs, tokens, reachable): the shares of the mix as drawn.

    A source is out of reach if it has no documents, or if the mix holds each of
    them max_repeats times and still fewer tokens than its target.
    """
    plan, drawn = _draw(counted, targets, block, seed)
    used = drawn.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    every = used.agg(F.sum("tokens").alias("all"))
    tokens = F.coalesce("tokens", F.lit(0))
    spent = (tokens == F.col("max_repeats") * F.col("available")) & (tokens * F.lit(10000) < F.col("target_bp") * F.col("t"))
    return (
        plan.join(used, "source", "left").withColumn("all", every.scalar())
        .select(
            "source", F.try_divide("target", "t").alias("target_share"), F.coalesce(F.try_divide(tokens, F.col("all")), F.lit(0.0)).alias("real_share"),
            F.coalesce("copies", F.lit(0)).alias("docs"), tokens.alias("tokens"), (~(spent | (F.col("docs") == 0))).alias("reachable"),
        )
    )
