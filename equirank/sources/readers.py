"""Sources: files with explicit schemas, query sets, judgments and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..operators.labels import institutional_names
from ..operators.qrels import canonical_qrels, flatten_qrels, qrels_shape


def json_lines(spark: SparkSession, path: str, schema: str = S.RAW_PAPER) -> DataFrame:
    """One document a line; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document or array per file; a missing file raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def optional(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The table, or an empty one where the path does not exist."""
    try:
        reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST") if form == "json" else spark.read.schema(schema)
        return reader.format(form).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, query) of a JSON array of strings or of objects with a query; blank ones dropped, other shapes raise."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("pos", "item"))
    named = F.get_json_object("item", "$.query")
    is_object = F.col("item").rlike(r"^\s*\{")
    bad = is_object & named.isNull() | F.col("item").rlike(r"^\s*\[") | F.col("item").isNull()
    query = F.when(bad, F.raise_error(F.lit("queries must be strings or objects with a query")).cast("string")).when(is_object, named).otherwise(F.col("item"))
    return items.select("pos", T.strip(query).alias("query")).where("query <> ''")


def stance_queries(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, S.QUERY_STANCE)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(qkey, doc_key, relevance) of a file of judgments of any accepted shape; its first row decides the shape."""
    raw = json_document(spark, path, S.QRELS_NESTED)
    flat = flatten_qrels(raw, qrels_shape(raw))
    return canonical_qrels(flat, "pos", ["paper_id", "doc_id"])


def affiliation_cache(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, affiliations) of a JSON map; absent means empty; names of places of deposit are dropped on reading."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "paper_id string, affiliations array<string>")
    pairs = whole.select(F.explode(F.from_json("value", S.AFFILIATION_CACHE)).alias("paper_id", "affiliations"))
    return pairs.select("paper_id", institutional_names(F.coalesce("affiliations", F.array().cast("array<string>"))).alias("affiliations"))


def id_set(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id) of a JSON list; absent means empty."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "paper_id string")
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("paper_id")).distinct()


def judgment_cache(spark: SparkSession, path: str) -> DataFrame:
    """(qkey, doc_key, relevance) of a JSON map from "query||paper" to a grade; absent means empty."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "qkey string, doc_key string, relevance int")
    pairs = whole.select(F.explode(F.from_json("value", "map<string, int>")).alias("k", "relevance"))
    return pairs.select(F.regexp_extract("k", r"(?s)^(.*)\|\|(.*)$", 1).alias("qkey"), F.regexp_extract("k", r"(?s)^(.*)\|\|(.*)$", 2).alias("doc_key"), "relevance")
