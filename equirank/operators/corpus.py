"""Corpus build: category filter, projection, exact-size sample, and parsing of delivered affiliation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .labels import institutional_names, is_institutional


def category_filter(categories: Column, strict: bool = False) -> Column:
    """Computer-science papers by the substring "cs."; strict asks for a code that begins with it (physics.* otherwise passes)."""
    return categories.rlike(r"(^|\s)cs\.") if strict else categories.contains("cs.")


def clean_papers(raw: DataFrame) -> DataFrame:
    """Papers of raw snapshot rows: stripped title and abstract, year from the first four characters of the date, 1900 without one."""
    year = F.coalesce(F.substring("update_date", 1, 4), F.lit("1900")).try_cast("int")
    return raw.select(
        F.col("id").alias("paper_id"), T.strip("title").alias("title"), T.strip("abstract").alias("abstract"), "authors",
        F.col("categories").alias("category"), year.alias("year"),
    )


def latest_versions(raw: DataFrame, key: str = "id", order: tuple[str, ...] = ("update_date", "ingested_at")) -> DataFrame:
    """One row per key: the greatest by the order columns, nulls first. One aggregate with map-side combining."""
    rest = [c for c in raw.columns if c != key and c not in order]
    whole = F.struct(*order, *rest)
    return raw.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(whole).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in raw.columns if c != key])


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the smallest by a seeded digest of the key; raises if there are fewer.

    A cut-off is found from digest prefix counts (65,536 numbers at most), so only
    the rows of one prefix are ranked.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = df.withColumn("_d", digest).withColumn("_p", F.substring("_d", 1, 4))
    counts = marked.groupBy("_p").count().orderBy("_p").collect()
    left, edge = n, None
    for r in counts:
        if left <= r["count"]:
            edge = r["_p"]
            break
        left -= r["count"]
    if edge is None:
        if left > 0 or n < 0:
            raise ValueError(f"fewer than {n} rows")
        edge = ""
    last = marked.where(F.col("_p") == edge).withColumn("_r", F.row_number().over(Window.orderBy("_d", key))).where(F.col("_r") <= left).drop("_r")
    return marked.where(F.col("_p") < edge).unionByName(last).drop("_d", "_p")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the new table, and those of the old one whose key it lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def graph_institutions(works: DataFrame) -> DataFrame:
    """(…, institutions) of records with authorships and locations: structured names, typed names, hosts of institutional repositories; distinct, in order.

    Missing arrays count as empty; null names are dropped.
    """
    none = F.array().cast("array<string>")
    # per authorship structured and typed names alternate
    per_author = F.expr(
        "flatten(transform(authorships, a -> concat(coalesce(filter(transform(a.institutions, i -> i.display_name), n -> n <> ''), array()), "
        "coalesce(array_compact(a.raw_affiliation_strings), array()))))"
    )
    hosts = F.transform(
        F.filter("locations", lambda p: (p["source"]["type"] == "repository") & (F.coalesce(p["source"]["host_organization_name"], F.lit("")) != "")
                 & is_institutional(F.coalesce(p["source"]["display_name"], F.lit(""))) & is_institutional(p["source"]["host_organization_name"])),
        lambda p: p["source"]["host_organization_name"],
    )
    return works.withColumn("institutions", F.array_distinct(F.concat(F.coalesce(per_author, none), F.coalesce(hosts, none))))


def by_landing_page(works: DataFrame) -> DataFrame:
    """(paper_id, institutions): records matched back by their first abstract page."""
    ids = F.filter(F.transform("locations", lambda p: T.arxiv_id(p["landing_page_url"])), lambda x: x.isNotNull())
    return graph_institutions(works).withColumn("paper_id", F.get(ids, F.lit(0))).where("paper_id is not null").select("paper_id", "institutions")


def by_position(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(paper_id, institutions) of records aligned with the requested ids by (batch, pos); records without institutional names are left out."""
    names = F.expr("flatten(transform(filter(authors, a -> a.affiliations is not null), a -> array_compact(a.affiliations)))")
    kept = institutional_names(F.array_distinct(names))
    return requests.join(records, ["batch", "pos"]).select("paper_id", kept.alias("institutions")).where(F.size("institutions") > 0)


def by_doi(records: DataFrame) -> DataFrame:
    """(paper_id, institutions) of delivered DOI records; an empty array where none is named."""
    names = F.expr("flatten(transform(filter(message.author, a -> a.affiliation is not null), a -> filter(transform(a.affiliation, f -> f.name), n -> n <> '')))")
    return records.select("paper_id", F.coalesce(institutional_names(F.array_distinct(names)), F.array().cast("array<string>")).alias("institutions"))


def by_title(found: DataFrame, depth: int = 5, similarity: float = 0.5) -> DataFrame:
    """(paper_id, institutions) from search results (paper_id, wanted, pos, title, authorships, locations).

    The first of the first `depth` results whose title is close and that names
    institutions; an empty array if titles match but none does; absent otherwise.
    """
    close = graph_institutions(found.where(F.col("pos") < depth)).where(T.jaccard(F.col("wanted"), F.col("title")) >= similarity)
    first = F.min(F.when(F.size("institutions") > 0, F.struct("pos", "institutions")))["institutions"]
    return close.groupBy("paper_id").agg(F.coalesce(first, F.array().cast("array<string>")).alias("institutions"))
