"""Query sets and graded judgments in one canonical long form (qkey, doc_key, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def query_set(queries: DataFrame, order: Column | str) -> DataFrame:
    """(qid, query, qkey): stripped non-empty queries, numbered from 0 in the given order; null queries are dropped.

    The numbering is for query sets, which are small; the order is one window.
    """
    kept = queries.where(F.length(T.strip("query")) > 0).select(T.strip("query").alias("query"), (F.col(order) if isinstance(order, str) else order).alias("o"))
    rank = F.row_number().over(Window.orderBy("o", "query")) - 1
    return kept.select(rank.alias("qid"), "query", T.normalize_query("query").alias("qkey"))


def labeled_query_set(queries: DataFrame) -> DataFrame:
    """(query, relevant_ids): queries with relevant ids, the ids as distinct strings; raises on a query without text or ids."""
    ids = F.array_distinct(F.transform("relevant_ids", lambda x: x.cast("string")))
    query = T.strip("query")
    bad = F.coalesce(F.length(query) == 0, F.lit(True)) | F.coalesce(F.size("relevant_ids") <= 0, F.lit(True))
    message = F.lit("a query needs text and relevant ids")
    return queries.select(F.when(bad, F.raise_error(message).cast("string")).otherwise(query).alias("query"), ids.alias("relevant_ids"))


def relevant_pairs(queries: DataFrame) -> DataFrame:
    """(qkey, doc_key) of queries that have relevant ids, once each."""
    return queries.where(F.size("relevant_ids") > 0).select(T.normalize_query("query").alias("qkey"), F.explode("relevant_ids").alias("doc_key")).where(
        "doc_key is not null").distinct()


def doc_key(columns: list[str], title: str | None = None) -> Column:
    """The first of the columns that is not blank, else the normalized lower-cased title; null without any."""
    parts = [F.nullif(T.strip(F.col(c).cast("string")), F.lit("")) for c in columns]
    if title:
        parts.append(F.nullif(T.normalize_query(title), F.lit("")))
    return F.coalesce(*parts)


def live_doc_key(columns: list[str]) -> Column:
    """The first column that is not null, as a string; raises without one."""
    found = F.coalesce(*[F.col(c).cast("string") for c in columns])
    return F.when(found.isNull(), F.raise_error(F.lit("a hit without id")).cast("string")).otherwise(found)


def canonical_qrels(flat: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """(qkey, doc_key, relevance): the last judgment of each pair by position, the higher grade of equal positions; null grades and keys are skipped."""
    rows = flat.where("relevance is not null").select(
        T.normalize_query("query").alias("qkey"), doc_key(keys, "title").alias("doc_key"), "relevance", F.col(position).alias("p")
    ).where("qkey is not null and doc_key is not null")
    # last wins as one aggregate with map-side combining: a hot query or pair is no problem
    return rows.groupBy("qkey", "doc_key").agg(F.max(F.struct("p", "relevance"))["relevance"].alias("relevance"))


def flatten_qrels(raw: DataFrame, shape: str) -> DataFrame:
    """Flat rows (query, paper_id, doc_id, title, relevance, pos) of one of the accepted shapes: flat, judgments or candidates."""
    if shape == "flat":
        return raw.select("query", "paper_id", F.lit(None).cast("string").alias("doc_id"), "title", "relevance", F.monotonically_increasing_id().alias("pos"))
    order = F.monotonically_increasing_id()
    each = raw.withColumn("q", order).select("query", "q", F.posexplode(shape).alias("i", "j"))
    return each.select("query", "j.paper_id", "j.doc_id", "j.title", "j.relevance", F.struct("q", "i").alias("pos"))


def qrels_shape(raw: DataFrame) -> str:
    """The shape of a file of judgments, decided by its first row."""
    first = raw.head(1)
    if not first:
        return "flat"
    row = first[0].asDict()
    return next((s for s in ("judgments", "candidates") if row.get(s) is not None), "flat")


def auto_relevance(score: Column, overlap: Column, cuts: tuple[float, float, float] = (0.60, 0.50, 0.40)) -> Column:
    """Grade by score and lexical overlap; null means no judgment."""
    high, middle, low = cuts
    return F.when((score >= high) & (overlap >= 0.20), 3).when((score >= middle) & (overlap >= 0.10), 2).when(score >= low, 1)


def auto_qrels(hits: DataFrame, payload: DataFrame, queries: DataFrame, cuts=(0.60, 0.50, 0.40), keep: int = 10) -> DataFrame:
    """(qkey, doc_key, rank, relevance, score, lexical_overlap): the first `keep` judged hits of each query, one per paper.

    hits: (qkey, doc_key, score, rank); payload: (doc_key, title, abstract[, paper_id]); queries: (qkey, query).
    With a paper_id in the payload a paper is told by it, or by its normalized title
    where it is null or empty; hits with neither are skipped. Otherwise doc_key tells papers.
    Hits without a grade do not stand in the way of a later one of the same paper.
    """
    blank = lambda c: F.coalesce(T.normalize_text(c), F.lit(""))
    known = [c for c in ("paper_id",) if c in payload.columns]
    texts = hits.join(payload.select("doc_key", "title", "abstract", *known), "doc_key").join(queries.select("qkey", "query"), "qkey")
    paper = F.coalesce(F.nullif(F.col("paper_id"), F.lit("")), F.nullif(blank("title"), F.lit(""))) if known else F.col("doc_key")
    combined = T.strip(F.concat(blank("title"), F.lit(" "), blank("abstract")))
    overlap = T.overlap_ratio(T.tokenize("query"), T.tokenize(combined))
    judged = texts.withColumn("lexical_overlap", overlap).withColumn("relevance", auto_relevance(F.col("score"), F.col("lexical_overlap"), cuts))
    judged = judged.withColumn("paper", paper).where("relevance is not null and paper is not null")
    once = Window.partitionBy("qkey", "paper").orderBy("rank")
    order = Window.partitionBy("qkey").orderBy("rank")
    return (
        judged.withColumn("o", F.row_number().over(once)).where("o = 1").withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
        .select("qkey", "doc_key", F.col("r").alias("rank"), "relevance", F.round("score", 4).alias("score"), F.round("lexical_overlap", 4).alias("lexical_overlap"))
    )


def clamp_grade(grade: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), grade))


def complete_batches(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """Graded papers of the batches in which every paper has a grade; ids out of range are ignored, the last answer per id counts.

    answers: (batch, id, grade, pos); batches: (batch, id, qkey, doc_key).
    """
    last = answers.groupBy("batch", "id").agg(F.max(F.struct("pos", "grade"))["grade"].alias("grade"))
    joined = batches.join(last, ["batch", "id"], "left")
    whole = joined.groupBy("batch").agg(F.count("*").alias("n"), F.count("grade").alias("g")).where("n = g").select("batch")
    return joined.join(whole, "batch", "left_semi").select("qkey", "doc_key", clamp_grade(F.col("grade")).alias("relevance"))


def existing_queries(new: DataFrame, known: DataFrame) -> DataFrame:
    """New queries that are known already, ignoring case and outer blanks."""
    keyed = known.select(F.lower(T.strip("query")).alias("k")).distinct()
    return new.withColumn("k", F.lower(T.strip("query"))).join(keyed, "k", "left_semi").drop("k")


def parse_relevant(inputs: DataFrame, hits: DataFrame) -> DataFrame:
    """(qkey, relevant_ids) from typed lists of ranks or ids (qkey, typed) against hits (qkey, doc_key, rank); raises on what is neither.

    A number in the range of the ranks is a rank; anything else must be the id of a hit.
    """
    typed = inputs.select("qkey", F.explode(F.split("typed", ",")).alias("t")).select("qkey", T.strip("t").alias("t")).where("t <> ''")
    by_rank = hits.select("qkey", F.col("rank").cast("string").alias("t"), F.col("doc_key").alias("ranked"))
    by_id = hits.select("qkey", F.col("doc_key").alias("t"), F.col("doc_key").alias("named"))
    found = typed.join(by_rank, ["qkey", "t"], "left").join(by_id, ["qkey", "t"], "left").withColumn("d", F.coalesce("ranked", "named"))
    checked = F.when(F.col("d").isNull(), F.raise_error(F.concat(F.lit("neither a rank nor an id: "), F.col("t"))).cast("string")).otherwise(F.col("d"))
    return found.groupBy("qkey").agg(F.array_sort(F.collect_set(checked)).alias("relevant_ids"))
