"""The queries pN_... of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical, knn, leakage, lookalike, markup, mixing, mojibake, neardup, sampling
from .common import read

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1. near-duplicate records

WORK = {"width": 3, "similarity": 0.5}


def _works(spark: SparkSession, sf: str):
    return neardup.near_duplicates(read(spark, sf, "fairsearch_arxiv"), "paper_id", ["title", "abstract"], **WORK)


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(*_works(spark, sf), WORK["width"])
    return pairs.select(F.col("key_a").alias("paper_id_a"), F.col("key_b").alias("paper_id_b"))


@query
def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_groups(*_works(spark, sf)).withColumnRenamed("key", "paper_id")


_P1 = r"""
WITH RECURSIVE t AS (
  SELECT DISTINCT paper_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\p{L}\p{N}]+') AS w
  FROM fairsearch_arxiv WHERE paper_id IS NOT NULL),
s AS (
  SELECT DISTINCT paper_id, w, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT paper_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
n AS (SELECT paper_id, w, count(*) AS n FROM s GROUP BY 1, 2),
c AS (
  SELECT a.paper_id AS pa, a.w AS wa, b.paper_id AS pb, b.w AS wb, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.paper_id < b.paper_id GROUP BY 1, 2, 3, 4),
p AS (
  SELECT DISTINCT pa, pb, wa, wb FROM c JOIN n x ON x.paper_id = pa AND x.w = wa JOIN n y ON y.paper_id = pb AND y.w = wb
  WHERE c * 2 >= x.n + y.n - c)
"""
ORACLE["p1_found"] = _P1 + "SELECT DISTINCT pa AS paper_id_a, pb AS paper_id_b FROM p"
# texts of one paper may be near each other too, so that links of texts are not those of papers
ORACLE["p1_groups"] = _P1.replace("a.paper_id < b.paper_id", "(a.paper_id < b.paper_id OR a.paper_id = b.paper_id AND a.w < b.w)") + """,
l AS (SELECT DISTINCT least(wa, wb) AS u, greatest(wa, wb) AS v FROM p WHERE wa <> wb),
e AS (SELECT pa AS a, pb AS b FROM p UNION SELECT pb, pa FROM p UNION SELECT x.paper_id, y.paper_id FROM t x JOIN t y ON x.w = y.w AND len(x.w) > 0),
r AS (SELECT DISTINCT paper_id AS a, paper_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
d AS (SELECT w, count(*) AS n FROM (SELECT u AS w FROM l UNION ALL SELECT v FROM l) GROUP BY 1),
k AS (SELECT paper_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_links FROM t LEFT JOIN d USING (w) GROUP BY 1)
SELECT paper_id, work, n_links FROM (SELECT a AS paper_id, min(b) AS work FROM r GROUP BY 1) JOIN k USING (paper_id)"""


# 2. sample of target proportions


def _papers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sampling.latest_papers(read(spark, sf, "fairsearch_arxiv")), read(spark, sf, "sample_targets")


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quota_report(*_papers(spark, sf)).where("missing > 0").select("cell_id")


@query
def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quota_report(*_papers(spark, sf))


@query
def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quota_sample(*_papers(spark, sf))


_P2 = r"""
WITH last AS (
  SELECT paper_id, arg_max(struct_pack(c := category, l := institution_label, y := year), vec_id) AS r
  FROM fairsearch_arxiv WHERE paper_id IS NOT NULL GROUP BY paper_id),
p AS (
  SELECT paper_id, lower(regexp_extract(r.c, '[^\s,;]+', 0)) AS code,
    lower(regexp_replace(r.l, '^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g')) AS label, r.y AS year FROM last),
s AS (SELECT count(*) // 5 AS s FROM p),
c AS (
  SELECT t.cell_id, count(p.paper_id) AS available,
    greatest(any_value(t.min_rows), (any_value(t.target_bp) * any_value(s.s) + 9999) // 10000) AS needed
  FROM sample_targets t CROSS JOIN s
  LEFT JOIN p ON p.code = lower(trim(t.category)) AND p.label = lower(trim(t.institution_label)) AND p.year BETWEEN t.year_from AND t.year_to
  GROUP BY t.cell_id)
"""
ORACLE["p2_found"] = _P2 + "SELECT cell_id FROM c WHERE available < needed"
_SEATS = _P2.replace("SELECT t.cell_id, count(p.paper_id) AS available,", "SELECT t.cell_id, any_value(t.target_bp) AS target, any_value(t.min_rows) AS floor, count(p.paper_id) AS available,") + """,
k AS (SELECT cell_id, k, k <= floor AS first, CASE WHEN k > floor THEN (k - 0.5) / target END AS priority FROM (SELECT *, unnest(range(1, available + 1)) AS k FROM c) WHERE k <= floor OR target > 0),
o AS (SELECT *, row_number() OVER (ORDER BY first DESC, priority, cell_id) AS n FROM k),
q AS (SELECT cell_id, count(*) AS seats FROM o WHERE first OR n <= (SELECT s FROM s) GROUP BY 1)
"""
ORACLE["p2_report"] = _SEATS + """SELECT cell_id, available, CAST(needed AS BIGINT) AS needed, coalesce(seats, 0)::BIGINT AS seats, greatest(0, needed - available)::BIGINT AS missing,
  (SELECT s FROM s)::BIGINT AS asked FROM c LEFT JOIN q USING (cell_id)"""
ORACLE["p2_sample"] = _SEATS + """, r AS (
  SELECT p.paper_id, t.cell_id, t.target_bp, row_number() OVER (PARTITION BY t.cell_id ORDER BY md5('0:' || p.paper_id), p.paper_id) AS rank FROM sample_targets t
  JOIN p ON p.code = lower(trim(t.category)) AND p.label = lower(trim(t.institution_label)) AND p.year BETWEEN t.year_from AND t.year_to)
SELECT paper_id, cell_id, rank, CASE WHEN target_bp > 0 THEN (rank - 0.5) / target_bp END AS priority FROM r JOIN q USING (cell_id) WHERE rank <= seats"""


# 3. canonical values


@query
def p3_mapped(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "canonical_values")
    typed = (("authorships", "authorship_id", "raw_affiliation", "institution"), ("fairsearch_arxiv", "vec_id", "institution_label", "institution_label"))
    parts = [
        canonical.map_to_canonical(read(spark, sf, t), names, key=k, field=f, kind=kind).select(F.lit(t).alias("source_table"), "*")
        for t, k, f, kind in typed
    ]
    return parts[0].unionByName(parts[1])


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_mapped(spark, sf).select("source_table", "row_id", "ref_id")


@query
def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.unmatched_report(p3_mapped(spark, sf))


# 4. most similar vectors


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    near = knn.nearest(read(spark, sf, "fairsearch_arxiv").select("vec_id", "embedding"), "vec_id", "embedding", min_cosine=0.9)
    return knn.mutual_pairs(near).select(F.col("key_a").alias("vec_id_a"), F.col("key_b").alias("vec_id_b"))


@query
def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "fairsearch_arxiv").select("vec_id", "embedding")
    near = knn.nearest(rows, "vec_id", "embedding", queries=F.col("vec_id") % 20 == 0)
    return near.select(F.col("key").alias("vec_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")


_P4 = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM fairsearch_arxiv WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 12) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id{asking}),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s)
"""
ORACLE["p4_found"] = _P4.format(asking="") + "SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM n WHERE rank <= 10 AND cosine >= 0.9"
ORACLE["p4_neighbours"] = _P4.format(asking=" WHERE a.vec_id % 20 = 0") + "SELECT a AS vec_id, b AS neighbour_id, round(cosine, 6) AS cosine, rank FROM n WHERE rank <= 10"


# 5. look-alike text

_FIELD = ["source_table", "row_id", "field_name"]


@query
def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    fields = lookalike.corpus_fields(read(spark, sf, "fairsearch_arxiv"), read(spark, sf, "authorships"))
    return lookalike.normalize_values(fields, _FIELD)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    # what the operator changed; an accent that has no composed form stays, and is a case too
    found = (F.size("kinds") > 0) & (F.col("changed") | F.array_contains("kinds", lookalike.MARK))
    return p5_forms(spark, sf).where(found).select(*_FIELD)


def _p5_sql() -> str:
    """The cases by regular expressions on values and words, with the tables of look-alike letters of the operator."""
    alike, sure = "".join(lookalike.LOOK_ALIKES), "".join(c for c in lookalike.LOOK_ALIKES if c not in lookalike.ROUGH)
    accents = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in lookalike.ACCENT_BLOCKS)
    blanks = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
    hidden = r"\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
    foreign = f"regexp_matches(regexp_replace({{}}, '[{alike}\\p{{{{Latin}}}}]', '', 'g'), '\\p{{{{L}}}}')"
    return rf"""
WITH f AS (
  SELECT 'fairsearch_arxiv' AS source_table, vec_id AS row_id, 'title' AS field_name, title AS v FROM fairsearch_arxiv
  UNION ALL SELECT 'authorships', authorship_id, 'author_name', author_name FROM authorships
  UNION ALL SELECT 'authorships', authorship_id, 'raw_affiliation', raw_affiliation FROM authorships),
n AS (SELECT *, translate(v, '{lookalike._wide()}', '{lookalike._thin()}') AS t FROM f WHERE regexp_matches(v, '[^\x00-\x7F]')),
-- a hyphen belongs to the words on both of its sides
w AS (
  SELECT source_table, row_id, field_name, NOT {foreign.format('t')} AND regexp_matches(t, '\p{{Latin}}') AS latin_value,
    unnest(regexp_extract_all(replace(t, '-', '--'), '-?[\p{{L}}\p{{M}}\p{{Cf}}]+-?')) AS w FROM n),
k AS (
  SELECT DISTINCT source_table, row_id, field_name FROM w WHERE regexp_matches(w, '[{alike}]') AND (regexp_matches(w, '\p{{Latin}}') OR
    latin_value AND NOT {foreign.format('w')} AND regexp_matches(w, '[{sure}]') AND
    (regexp_matches(w, '\p{{Cyrillic}}') OR len(regexp_extract_all(w, '[{alike}]')) > 1 OR regexp_matches(w, '\p{{Lu}}') AND NOT contains(w, '-'))))
SELECT source_table, row_id, field_name FROM n
WHERE regexp_matches(v, '[\x{{FB00}}-\x{{FB06}}\x{{FF01}}-\x{{FFEE}}{accents}{blanks}{hidden}]')
UNION SELECT * FROM k"""


ORACLE["p5_found"] = _p5_sql()


# 6. markup residue


@query
def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.clean_values(markup.paper_fields(read(spark, sf, "fairsearch_arxiv")), ["vec_id", "field_name"])


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_clean(spark, sf).where(F.size("kinds") > 0).select("vec_id", "field_name")


# 7. leaked evaluation passages


@query
def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(read(spark, sf, "documents"), read(spark, sf, "eval_items"))


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


@query
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    leaks = p7_leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("containment").alias("most"))
    return (
        read(spark, sf, "eval_items").select("item_id", "category").join(leaks, "item_id", "left")
        .select("item_id", "category", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most", F.lit(0.0)).alias("most"))
    )


_P7 = r"""
WITH w AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id AS id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
d AS (SELECT DISTINCT id AS doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
e AS (SELECT DISTINCT id AS item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM e GROUP BY 1),
l AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN e USING (g) GROUP BY 1, 2)
"""
ORACLE["p7_found"] = _P7 + "SELECT doc_id, item_id FROM l JOIN n USING (item_id) WHERE c >= 0.4 * n"
ORACLE["p7_leaks"] = _P7 + "SELECT doc_id, item_id, c::DOUBLE / n AS containment FROM l JOIN n USING (item_id) WHERE c >= 0.4 * n"
ORACLE["p7_items"] = _P7 + """, k AS (SELECT item_id, count(*) AS n_docs, max(c::DOUBLE / n) AS most FROM l JOIN n USING (item_id) WHERE c >= 0.4 * n GROUP BY 1)
SELECT item_id, category, coalesce(n_docs, 0) AS n_docs, coalesce(most, 0.0)::DOUBLE AS most FROM eval_items LEFT JOIN k USING (item_id)"""


# 8. mix of sources


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.source_tokens(read(spark, sf, "documents"))


@query
def p8_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(_counted(spark, sf), read(spark, sf, "mix_targets"))
    return plan.select("source", "docs", "available", F.round("target", 4).alias("target"), "reachable")


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).where("not reachable").select("source")


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_counted(spark, sf), read(spark, sf, "mix_targets"))


@query
def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(_counted(spark, sf), read(spark, sf, "mix_targets"))


_P8 = r"""
WITH d AS (
  SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) AS source, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]')) AS tokens
  FROM documents),
a AS (SELECT source, count(*) AS docs, coalesce(sum(tokens), 0) AS available FROM d GROUP BY 1),
t AS (SELECT coalesce(sum(tokens), 0) AS t FROM d),
p AS (
  SELECT m.source, coalesce(docs, 0)::BIGINT AS docs, coalesce(available, 0)::BIGINT AS available, round(target_bp * t / 10000.0, 4)::DOUBLE AS target,
    NOT (coalesce(docs, 0) = 0 OR max_repeats * coalesce(available, 0) * 10000 < target_bp * t) AS reachable
  FROM mix_targets m CROSS JOIN t LEFT JOIN a ON a.source = m.source)
"""
ORACLE["p8_plan"] = _P8 + "SELECT * FROM p"
ORACLE["p8_found"] = _P8 + "SELECT source FROM p WHERE NOT reachable"


# 9. garbled text


@query
def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restore_texts(read(spark, sf, "documents"))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).select("doc_id")
