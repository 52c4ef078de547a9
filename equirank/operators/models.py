"""Places where a caller supplies a model: encoders, generators, graders, scorers.

A model is a Python function on batches. What it has answered is kept by its keys,
so a run that broke off goes on where it stopped; what it answers is a table, and
everything behind it works as well on a table that was made elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.resume import remaining


def embed(df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], into: str = "embedding") -> DataFrame:
    """The rows with a column of unit vectors of the text; null texts are encoded as empty, zero vectors become null."""

    def run(batches):
        for pdf in batches:
            x = np.asarray(encode(list(pdf[text].fillna(""))), dtype=np.float64) if len(pdf) else np.empty((0, 1))
            n = np.linalg.norm(x, axis=1)
            yield pdf.assign(**{into: [list((v / s).astype(np.float32)) if s > 0 else None for v, s in zip(x, n)]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != into)
    return df.drop(into).mapInPandas(run, f"{fields}, `{into}` array<float>")


def answer_requests(contexts: DataFrame, questions: DataFrame, instructions: str) -> DataFrame:
    """(qid, instructions, request): the context of each question followed by the question. Questions without context keep an empty one."""
    joined = questions.select("qid", "query").join(contexts.select("qid", "context"), "qid", "left")
    request = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("query", F.lit("")))
    return joined.select("qid", F.lit(instructions).alias("instructions"), request.alias("request"))


class Exhausted(Exception):
    """Raised by a model or lookup whose budget is spent: nothing more is asked of it in this run."""


#: Seconds to wait after a refusal for too many requests, after an overload (times the attempt, at most) and base otherwise.
BUSY_WAIT, OVERLOAD_WAIT, OVERLOAD_MOST, BACKOFF = 60.0, 30.0, 120.0, 2.0


def wait_after(error: Exception, attempt: int) -> float:
    """Seconds to wait after the attempt (from 0) that ended in the error, by the status that its text names."""
    text = str(error)
    if "429" in text:
        return BUSY_WAIT
    if "503" in text:
        return min(OVERLOAD_WAIT * (attempt + 1), OVERLOAD_MOST)
    return BACKOFF ** (attempt + 1)


def retried(model: Callable[[pd.DataFrame], pd.DataFrame], attempts: int = 8, wait: Callable[[Exception, int], float] = wait_after, later: bool = False):
    """The model, asked again after a failure, up to `attempts` times for a batch.

    With `later` a batch that fails to the end gets no rows, so that its requests
    stay open for the next run; otherwise the last error is raised. After Exhausted
    it is not asked again in this process: its requests stay open with `later`.
    """
    spent: list[Exception] = []

    def ask(pdf: pd.DataFrame) -> pd.DataFrame | None:
        for attempt in range(attempts):
            if spent:
                break
            try:
                return model(pdf)
            except Exhausted as error:
                spent.append(error)
            except Exception as error:
                if attempt + 1 == attempts:
                    if not later:
                        raise
                    return None
                time.sleep(wait(error, attempt))
        if spent and not later:
            raise spent[0]
        return None

    return ask


def apply_model(requests: DataFrame, keys: list[str], model: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, batch: int | None = None) -> DataFrame:
    """The model's rows for each batch of requests; `schema` must hold the keys. A batch for which it returns None has no rows."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), batch or max(1, len(pdf))):
                answers = model(pdf.iloc[lo : lo + (batch or len(pdf))].reset_index(drop=True))
                if answers is not None and len(answers):
                    yield answers

    return requests.mapInPandas(run, schema)


def resume_model(
    requests: DataFrame, keys: list[str], model: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, path: str, batch: int = 50, at_once: int | None = None
) -> int:
    """Ask only for requests that the table at `path` does not answer yet and append the answers. Returns how many were added.

    Requests are asked in waves of `at_once` batches (the default parallelism), and
    each wave is kept as soon as it is answered: a failure loses no earlier wave, and
    the next call asks for the rest. Requests with null keys or given twice are asked once.
    """
    spark = requests.sparkSession
    at_once = at_once or spark.sparkContext.defaultParallelism

    def done() -> DataFrame | None:
        try:
            return spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    before = done()
    open_ = requests.dropDuplicates(keys)
    if before is not None:
        open_ = remaining(open_, before, keys)
    waves = -(-open_.count() // (batch * at_once))
    start = 0 if before is None else before.count()
    for wave in range(waves):
        mine = open_.where(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave)
        # the answers go straight to the table: nothing that was paid for is held in memory only
        answers = apply_model(mine.repartition(at_once, *keys), keys, model, schema, batch)
        answers.write.mode("append").parquet(path)
    after = done()
    return 0 if after is None else after.count() - start


def stance_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(id, pos, stance) from a model's JSON lists of titles and stances, by position; unreadable answers give no rows."""
    parsed = T.tolerant_json(F.col(text), "ARRAY<STRUCT<title: STRING, stance: STRING>>")
    return answers.select("id", F.posexplode(parsed).alias("pos", "s")).select("id", "pos", F.col("s.stance").alias("stance"))


def summary_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(id, summary_pro_ratio, summary_dissenting_ratio) from a model's JSON on a summary; unreadable answers give no rows."""
    parsed = T.tolerant_json(F.col(text), "pro_consensus_ratio DOUBLE, dissenting_ratio DOUBLE")
    read = answers.select("id", parsed.alias("s")).where("s is not null")
    return read.select("id", F.col("s.pro_consensus_ratio").alias("summary_pro_ratio"), F.col("s.dissenting_ratio").alias("summary_dissenting_ratio"))


def grade_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(batch, id, grade, pos) from a grader's JSON lists, for complete_batches()."""
    parsed: Column = T.tolerant_json(F.col(text), "ARRAY<STRUCT<id: INT, grade: INT>>")
    return answers.select("batch", F.posexplode(parsed).alias("pos", "s")).select("batch", "s.id", "s.grade", "pos")
