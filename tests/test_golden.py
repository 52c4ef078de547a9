"""Hand-worked cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from equirank.functions import rules as R
from equirank.functions import text as T
from equirank.functions import vector as X
from equirank.operators import corpus as C
from equirank.operators import fairness as P
from equirank.operators import labels as L
from equirank.operators import models as M
from equirank.operators import pools as O
from equirank.operators import qrels as Q
from equirank.operators import retrieval as V
from equirank.operators import synthesis as Y
from equirank.operators import utility as U


def one(df):
    return df.first().asDict()


def text(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values)], schema).select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


def run_of(spark, grades):
    run = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(len(grades))], "qkey string, doc_key string, rank int")
    return run, grades


def test_ndcg_and_reciprocal_rank(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qkey string, doc_key string, rank int")
    rel = spark.createDataFrame([("q", "a", 3), ("q", "c", 1), ("q", "x", 2), ("q", "y", 0)], "qkey string, doc_key string, relevance int")
    n = one(U.ndcg_per_query(run, rel))
    assert (round(n["dcg"], 6), round(n["idcg"], 6), round(n["ndcg"], 6)) == (3.5, 4.761860, 0.735007)
    assert one(U.reciprocal_rank(run, rel))["rr"] == 1.0
    late = spark.createDataFrame([("q", "c", 1)], "qkey string, doc_key string, relevance int")
    assert one(U.reciprocal_rank(run, late))["rr"] == pytest.approx(1 / 3)
    none = spark.createDataFrame([("q", "z", 0)], "qkey string, doc_key string, relevance int")
    assert one(U.reciprocal_rank(run, none))["rr"] == 0.0
    assert one(U.ndcg_per_query(run, none))["ndcg"] is None
    s = one(U.utility_summary(run, none))
    assert (s["mean_ndcg"], s["mrr"], s["n_ndcg"]) == (None, 0.0, 0)
    empty = run.limit(0)
    assert one(U.ndcg_per_query(empty, rel))["ndcg"] is None


def test_exposure(spark):
    labels = ["privileged", "underrepresented", "underrepresented", "privileged", "underrepresented"]
    run = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(labels)], "qid string, label string, rank int")
    e = one(P.exposure_per_query(run))
    assert (e["exposure_priv"], e["exposure_under"]) == (1.4307, 1.5178)
    assert (e["share_priv"], e["share_under"]) == (0.4852, 0.5148)
    assert (e["exposure_ratio"], e["exposure_difference"]) == (1.0609, -0.0295)


def test_parity_without_privileged(spark):
    run = spark.createDataFrame([("q", "underrepresented", i) for i in range(10)], "qid string, label string, rank int")
    p = one(P.parity_per_query(run))
    assert (p["priv_rate"], p["under_rate"], p["spd"], p["under_priv_ratio"]) == (0.0, 1.0, -1.0, None)


@pytest.mark.parametrize("hits, want", [((388, 612), (0.000526, 0.000332, 0.000195, 1.5864)), ((352, 648), (0.000477, 0.000351, 0.000126, 1.3593))])
def test_pooled_selection(spark, hits, want):
    rows = [(i % 100, "privileged") for i in range(hits[0])] + [(i % 100, "underrepresented") for i in range(hits[1])]
    run = spark.createDataFrame(rows, "qid int, label string")
    points = spark.range(7372).select(F.lit("privileged").alias("label")).union(spark.range(18447).select(F.lit("underrepresented").alias("label")))
    p = one(P.parity_pooled(run, points))
    assert (p["priv_selection"], p["under_selection"], p["spd"], p["priv_under_ratio"]) == want


@pytest.mark.parametrize(
    "priv, under, want",
    [((249, 191, 136, 259), (349, 338, 262, 490), (0.5659, 0.5080, 0.3443, 0.3484, 0.0579)), ((167, 273, 179, 216), (272, 415, 371, 381), (0.3795, 0.3959, 0.4532, 0.4934, 0.0402))],
)
def test_equalized_odds(spark, priv, under, want):
    rows = []
    for label, (tp, fn, fp, tn) in (("privileged", priv), ("underrepresented", under)):
        rows += [(label, 2, 1)] * tp + [(label, 3, 0)] * fn + [(label, 1, 1)] * fp + [(label, 0, 0)] * tn
    e = one(P.equalized_odds(P.confusion_rates(spark.createDataFrame(rows, "label string, relevance int, retrieved int"))))
    assert (e["tpr_priv"], e["tpr_under"], e["fpr_priv"], e["fpr_under"], e["eo_difference"]) == want


def angle(x):
    return [math.cos(x), math.sin(x)]


def diverse(spark, docs, lam, k=10):
    corpus = spark.createDataFrame([(n, angle(a)) for n, a in docs], "doc_key string, v array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, v array<double>")
    hits = V.dense_topk(queries, corpus, 50)
    return [r["doc_key"] for r in V.mmr(hits, corpus, [lam], k).orderBy("rank").collect()]


def test_diverse_ranking(spark):
    docs = [("a", 0.0), ("b", 0.1), ("c", -0.8), ("e", 1.4)]
    assert diverse(spark, docs, 1.0) == diverse(spark, docs, 0.7) == ["a", "b", "c", "e"]
    assert diverse(spark, docs, 0.3) == ["a", "e", "c", "b"]
    assert diverse(spark, docs, 0.3, 2) == ["a", "e"]


def test_diverse_ties_and_sizes(spark):
    assert V.greedy_diverse(np.array([0.5, 0.5]), np.array([[1, 0.2], [0.2, 1]]), 1, 0.5) == [0]
    assert V.greedy_diverse(np.array([]), np.empty((0, 0)), 5, 0.5) == []
    assert len(V.greedy_diverse(np.array([0.1, 0.2, 0.3]), np.eye(3), 9, 0.5)) == 3
    assert diverse(spark, [], 0.5) == []


def test_lambda_one_is_the_plain_order_and_prefixes_agree():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.sort(v @ v[0])[::-1]
    assert V.greedy_diverse(sims, v @ v.T, 40, 1.0) == list(range(40))
    assert V.greedy_diverse(sims, v @ v.T, 10, 0.6) == V.greedy_diverse(sims, v @ v.T, 30, 0.6)[:10]


def test_topk_edges(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("n", None), ("z", [0.0, 0.0]), ("h", [None, 1.0])], "doc_key string, v array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0], "b"), ("r", [1.0, 0.0], None), ("s", None, None)], "qid string, v array<double>, exclude string")
    got = [(r["qid"], r["doc_key"], r["rank"]) for r in V.dense_topk(queries, corpus, 5).orderBy("qid", "rank").collect()]
    assert got == [("q", "a", 1), ("r", "a", 1), ("r", "b", 2)]
    assert V.dense_topk(queries.limit(0), corpus, 5).count() == 0
    assert V.dense_topk(queries, corpus.limit(0), 5).count() == 0


def test_jvm_cosine_equals_batches(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row["c"] == pytest.approx(11 / math.sqrt(125))


def test_labeled_hit_beyond_depth_stays_out(spark):
    hits = spark.createDataFrame([("q", f"d{i}", i, "unknown") for i in range(1, 101)], "qid string, doc_key string, rank int, label string")
    beyond = spark.createDataFrame([("q", "late", 101, "privileged")], hits.schema)
    assert V.filter_after_rank(V.cut(hits.union(beyond), 100), F.col("label") != "unknown", 10).count() == 0


def test_tokens(spark):
    q = 'Fair-RAG: is it "fair"?\n(a_b) GNNs/LLMs'
    assert set(text(spark, T.tokenize, q)) == {"fair", "gnns", "llms", "rag"}
    assert text(spark, lambda a, b: T.overlap_ratio(T.tokenize(a), T.tokenize(b)), q, "Fair ranking with LLMs, and RAG.") == 0.75
    assert text(spark, T.tokenize, None) == []
    assert text(spark, lambda a, b: T.overlap_ratio(T.tokenize(a), T.tokenize(b)), None, "x") == 0.0


def test_similarity_of_titles(spark):
    assert round(text(spark, T.jaccard, "Attention is all you need", "attention is what you need"), 6) == 0.666667
    assert text(spark, T.jaccard, "", "x") == 0.0
    assert text(spark, T.sanitize_title, "A $\\alpha$-method {x}") == "A alpha -method x"
    assert text(spark, T.normalize_text, " a \n b ") == "a b"
    assert text(spark, lambda x: T.shorten(x, 8), "abcdefghij") == "abcde..."


@pytest.mark.parametrize("score, overlap, want", [(0.60, 0.20, 3), (0.60, 0.19, 2), (0.50, 0.10, 2), (0.50, 0.09, 1), (0.40, 0.0, 1), (0.39, 1.0, None)])
def test_auto_relevance(spark, score, overlap, want):
    assert spark.range(1).select(Q.auto_relevance(F.lit(score), F.lit(overlap)).alias("x")).first()["x"] == want


def test_classification(spark):
    names = [[], None, ["City University of Hong Kong"], ["ETH Zürich"], ["Universidade Federal do Amazonas"], ["Smith College"], ["x", "UNIVERSITY OF CALIFORNIA, BERKELEY"], ["Google Scholar"], ["University of Wisconsin-Madison"]]
    papers = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "paper_id string, affiliations array<string>")
    matched = L.match_rules(papers.select(F.explode("affiliations").alias("name")), L.default_rules(spark))
    got = {r["paper_id"]: (r["label"], r["trigger"]) for r in L.classify(papers, matched).collect()}
    under = ("underrepresented", None)
    assert got["0"] == got["1"] == ("unknown", None)
    assert [got[str(i)] for i in range(2, 9)] == [under, ("privileged", "eth zurich"), under, under, ("privileged", "university of california berkeley"), under, ("privileged", "university of wisconsin-madison")]
    assert len(set(sum(R.TIERS.values(), []))) == sum(map(len, R.TIERS.values()))


def test_hosts_and_audit(spark):
    df = spark.createDataFrame([(["arXiv.org", "MIT", None, "Zenodo"],)], "a array<string>")
    assert df.select(L.institutional_names(F.col("a")).alias("x")).first()["x"] == ["MIT"]
    hist = spark.createDataFrame([("carnegie melon university", 2), ("unrelated", 1)], "normalized string, n_mentions long")
    miss = L.near_misses(hist, L.default_rules(spark)).collect()
    assert [(r["normalized"], r["entry"]) for r in miss] == [("carnegie melon university", "carnegie mellon university")]


def test_corpus_build(spark):
    raw = spark.createDataFrame(
        [("1", " A ", "\n x ", "w", "cs.LG stat.ML", "2020-01-02"), ("2", "B", "y", "w", "math.CO", None), ("3", "C", None, None, "physics.optics", None)],
        "id string, title string, abstract string, authors string, categories string, update_date string",
    )
    kept = raw.where(C.category_filter(F.col("categories")))
    assert [r["id"] for r in kept.orderBy("id").collect()] == ["1", "3"]
    assert [r["id"] for r in raw.where(C.category_filter(F.col("categories"), strict=True)).collect()] == ["1"]
    rows = {r["paper_id"]: r for r in C.clean_papers(kept).collect()}
    assert (rows["1"]["title"], rows["1"]["abstract"], rows["1"]["year"], rows["3"]["year"], rows["3"]["abstract"]) == ("A", "x", 2020, 1900, None)


def test_exact_sample(spark):
    df = spark.range(500)
    a, b = (C.exact_sample(df.repartition(n), "id", 37) for n in (1, 9))
    assert a.count() == 37 and sorted(a.collect()) == sorted(b.collect())
    assert C.exact_sample(df, "id", 0).count() == 0 and C.exact_sample(df, "id", 500).count() == 500
    with pytest.raises(ValueError):
        C.exact_sample(df, "id", 501)


def test_precision_divides_by_what_there_is(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qkey string, doc_key string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "qkey string, doc_key string")
    got = {r["qkey"]: (r["precision"], r["recall"]) for r in U.precision_recall(run, rel, 10).collect()}
    assert got == {"q": (0.6667, 1.0), "r": (0.0, 0.0)}


def test_last_judgment_wins(spark):
    flat = spark.createDataFrame(
        [("Q  x", "p", "t", 1, 1), (" q X", "p", "t", 3, 2), ("q x", None, " A  B", 2, 3), ("q x", "p", "t", None, 9), (None, "p", "t", 1, 1), ("q x", " ", None, 1, 1)],
        "query string, paper_id string, title string, relevance int, pos int",
    )
    assert sorted(tuple(r) for r in Q.canonical_qrels(flat, "pos", ["paper_id"]).collect()) == [("q x", "a b", 2), ("q x", "p", 3)]


def test_coverage_leaves_out_unjudged_queries(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("none", "a", 1)], "qkey string, doc_key string, rank int")
    rel = spark.createDataFrame([("q", "a", 0)], "qkey string, doc_key string, relevance int")
    assert one(U.judged_coverage(run, rel)) == {"n_hits": 2, "n_judged": 1, "coverage": 0.5}


def test_stances(spark):
    docs = spark.createDataFrame([("c", "1", s) for s in ("PRO-CONSENSUS", "PRO-CONSENSUS", "DISSENTING", "OTHER")], "condition string, id string, stance string")
    d = Y.stance_distribution(docs)
    assert tuple(one(d)[k] for k in ("pro_share", "dissenting_share", "neutral_share")) == (0.5, 0.25, 0.0)
    summary = spark.createDataFrame([("c", "1", 0.4)], "condition string, id string, summary_pro_ratio double")
    c = one(Y.consensus_amplification(d, summary))
    assert (c["consensus_amplification"], c["absolute_gap"]) == (-0.1, 0.1)


def test_zip_raises_on_mismatch(spark):
    a = spark.createDataFrame([("1", "x", 1.0)], "id string, query string, answer double")
    b = spark.createDataFrame([("1", "y", 1.0)], "id string, query string, answer double")
    assert Y.zip_conditions(a, a, a, ("m", "n", "o")).count() == 1
    with pytest.raises(PySparkException):
        Y.zip_conditions(a, a, b, ("m", "n", "o")).collect()


def test_tolerant_json(spark):
    cases = {'text ```json\n{"a": 1}\n``` more': 1, '{"a": 2, "t": "it\\\'s"}': 2, '{"a": 3, "t": "$\\alpha$ \\u12"}': 3, "nothing": None, None: None}
    for raw, want in cases.items():
        got = text(spark, lambda x: T.tolerant_json(x, "a INT, t STRING"), raw)
        assert (got["a"] if got is not None else None) == want, raw
    got = text(spark, lambda x: T.tolerant_json(x, "ARRAY<STRUCT<s: STRING>>"), 'see [{"s": "A"}, {"s": "\\ell_1"}] end')
    assert [x["s"] for x in got] == ["A", "\\ell_1"]


def test_grades_and_batches(spark):
    batches = spark.createDataFrame([("b1", 1, "q", "x"), ("b1", 2, "q", "y"), ("b2", 1, "q", "z")], "batch string, id int, qkey string, doc_key string")
    answers = spark.createDataFrame([("b1", 1, 9, 0), ("b1", 2, -4, 1), ("b1", 7, 1, 2), ("b2", 5, 1, 0)], "batch string, id int, grade int, pos int")
    assert sorted(tuple(r) for r in Q.complete_batches(answers, batches).collect()) == [("q", "x", 3), ("q", "y", 0)]


def test_typed_relevance(spark):
    hits = spark.createDataFrame([("q", "id9", 1), ("q", "id7", 2)], "qkey string, doc_key string, rank int")
    typed = spark.createDataFrame([("q", "2, id9 ,2,")], "qkey string, typed string")
    assert one(Q.parse_relevant(typed, hits))["relevant_ids"] == ["id7", "id9"]
    with pytest.raises(PySparkException):
        Q.parse_relevant(spark.createDataFrame([("q", "3")], typed.schema), hits).collect()


def test_pool_keeps_first_occurrence(spark):
    run = lambda rows: spark.createDataFrame(rows, "qkey string, doc_key string, rank int")
    pool = O.pool_union([run([("q", "a", 1), ("q", "b", 2)]), run([("q", "c", 1), ("q", "a", 2)])], 2)
    assert [r["doc_key"] for r in pool.orderBy("pos").collect()] == ["a", "b", "c"]


def test_delivered_records(spark):
    schema = (
        "paper_id string, wanted string, pos int, title string, authorships array<struct<institutions: array<struct<display_name: string>>, raw_affiliation_strings: array<string>>>, "
        "locations array<struct<landing_page_url: string, source: struct<display_name: string, host_organization_name: string, type: string>>>"
    )
    source = lambda d, h, t: {"display_name": d, "host_organization_name": h, "type": t}
    author = [{"institutions": [{"display_name": "A"}, {"display_name": None}], "raw_affiliation_strings": ["a, b", "A"]}, {"institutions": None, "raw_affiliation_strings": None}]
    places = [
        {"landing_page_url": "x", "source": None}, {"landing_page_url": "https://arxiv.org/abs/1234.5v2", "source": source("arXiv", "Cornell", "repository")},
        {"landing_page_url": None, "source": source("Own", "Host U", "repository")}, {"landing_page_url": None, "source": source("J", "Pub", "journal")},
    ]
    works = spark.createDataFrame([("p", "a b", 0, "a b", [], []), ("p", "a b", 1, "a b c", author, places), ("p", "a b", 2, "z", author, places), ("n", "q r", 0, "q r", None, None)], schema)
    assert one(C.by_landing_page(works.where("pos = 1").drop("paper_id"))) == {"paper_id": "1234.5", "institutions": ["A", "a, b", "Host U"]}
    got = {r["paper_id"]: r["institutions"] for r in C.by_title(works).collect()}
    assert got == {"p": ["A", "a, b", "Host U"], "n": []}
    s2 = spark.createDataFrame([("b", 0, [{"affiliations": ["X", "arXiv"]}, {"affiliations": None}, {"affiliations": ["X"]}]), ("b", 1, None)], "batch string, pos int, authors array<struct<affiliations: array<string>>>")
    asked = spark.createDataFrame([("b", 0, "p"), ("b", 1, "r")], "batch string, pos int, paper_id string")
    assert [tuple(r) for r in C.by_position(asked, s2).collect()] == [("p", ["X"])]
    doi = spark.createDataFrame([("p", {"author": [{"affiliation": [{"name": "Y"}, {"name": ""}]}, {"affiliation": None}]}), ("r", None)], "paper_id string, message struct<author: array<struct<affiliation: array<struct<name: string>>>>>")
    assert {r["paper_id"]: r["institutions"] for r in C.by_doi(doi).collect()} == {"p": ["Y"], "r": []}


def test_query_sets(spark):
    qs = spark.createDataFrame([(" b ", None), ("", ["x"]), (None, None), ("A  a", ["1", "1", "2"])], "query string, relevant_ids array<string>")
    assert [(r["qid"], r["query"], r["qkey"]) for r in Q.query_set(qs, "query").orderBy("qid").collect()] == [(0, "b", "b"), (1, "A  a", "a a")]
    assert one(Q.labeled_query_set(qs.where("query = 'A  a'")))["relevant_ids"] == ["1", "2"]
    with pytest.raises(PySparkException):
        Q.labeled_query_set(qs).collect()


def test_models_are_supplied_and_resumed(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "doc_key string, text string")
    got = {r["doc_key"]: r["embedding"] for r in M.embed(docs, "text", lambda ts: np.array([[len(t) * 3.0, 0.0] for t in ts])).collect()}
    assert got == {"a": [1.0, 0.0], "b": None}
    asked = []

    def model(pdf):
        asked.extend(pdf["qid"])
        return pdf[["qid"]].assign(answer="yes")

    contexts = spark.createDataFrame([("1", "c")], "qid string, context string")
    questions = spark.createDataFrame([("1", "why"), ("2", None)], "qid string, query string")
    requests = M.answer_requests(contexts, questions, "be brief")
    assert [r["request"] for r in requests.orderBy("qid").collect()] == ["Context:\nc\n\nQuestion: why", "Context:\n\n\nQuestion: "]
    path = str(tmp_path / "answers")
    schema = "qid string, answer string"
    assert M.resume_model(requests, ["qid"], model, schema, path) == 2
    assert M.resume_model(requests, ["qid"], model, schema, path) == 0


def failing(folder, bad=(), error="boom", times=10**9):
    """(model, asked): a model that writes down what it is asked and fails on batches with a bad key, as often as told."""
    path, bad = f"{folder}/asked", set(bad)

    def asked():
        with open(path) as f:
            return f.read().split()

    def model(pdf):
        with open(path, "a") as f:
            f.write(",".join(pdf["qid"]) + "\n")
        with open(path) as f:
            n = len(f.read().split())
        if bad & set(pdf["qid"]) and n <= times:
            raise RuntimeError(error)
        return pdf[["qid"]].assign(answer="yes")

    return model, asked


def test_answered_batches_are_kept_when_a_later_one_fails(spark, tmp_path):
    requests = spark.createDataFrame([(f"q{i:02}",) for i in range(20)], "qid string")
    path, schema = str(tmp_path / "answers"), "qid string, answer string"
    waves = {}
    for (q,) in requests.collect():  # which wave asks for which request
        waves.setdefault(requests.where(F.col("qid") == q).select(F.pmod(F.xxhash64("qid"), F.lit(4))).first()[0], []).append(q)
    third, _ = failing(tmp_path, bad=waves[2][:1])
    with pytest.raises(PySparkException):
        M.resume_model(requests, ["qid"], third, schema, path, batch=5, at_once=1)
    kept = {r["qid"] for r in spark.read.parquet(path).collect()}
    assert kept == {*waves[0], *waves[1]}
    (tmp_path / "asked").unlink()
    fine, asked = failing(tmp_path)
    assert M.resume_model(requests, ["qid"], fine, schema, path, batch=5, at_once=1) == 20 - len(kept)
    assert sorted(q for line in asked() for q in line.split(",")) == sorted({*waves[2], *waves[3]})
    assert M.resume_model(requests, ["qid"], failing(tmp_path, bad=["q00"])[0], schema, path) == 0


def test_retries_and_requests_left_for_later(spark, tmp_path):
    import pandas as pd

    waits = []
    busy = M.retried(failing(tmp_path, bad=["a"], error="status 429", times=2)[0], attempts=4, wait=lambda e, n: waits.append(M.wait_after(e, n)) or 0.0)
    assert list(busy(pd.DataFrame({"qid": ["a"]}))["answer"]) == ["yes"] and waits == [60.0, 60.0]
    assert [M.wait_after(RuntimeError("503"), n) for n in (0, 1, 9)] == [30.0, 60.0, 120.0] and M.wait_after(RuntimeError("x"), 2) == 8.0
    never, _ = failing(tmp_path, bad=["a"])
    with pytest.raises(RuntimeError):
        M.retried(never, attempts=2, wait=lambda e, n: 0.0)(pd.DataFrame({"qid": ["a"]}))
    assert M.retried(never, attempts=2, wait=lambda e, n: 0.0, later=True)(pd.DataFrame({"qid": ["a"]})) is None
    calls = []

    def spent(pdf):
        calls.append(1)
        raise M.Exhausted("no budget")

    later = M.retried(spent, later=True)
    assert later(pd.DataFrame()) is None and later(pd.DataFrame()) is None and len(calls) == 1
    with pytest.raises(M.Exhausted):
        M.retried(spent)(pd.DataFrame())
    # what fails stays open, the rest is kept
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    path = str(tmp_path / "answers")
    model = M.retried(never, attempts=1, later=True)
    assert M.resume_model(requests, ["qid"], model, "qid string, answer string", path, batch=1) == 2
    assert {r["qid"] for r in spark.read.parquet(path).collect()} == {"b", "c"}


def test_near_misses_equal_the_plain_loop(spark):
    from difflib import SequenceMatcher

    entries = sorted(r["entry"] for r in L.default_rules(spark).select("entry").distinct().collect() if len(r["entry"]) > 4)
    rng = np.random.default_rng(2)
    names = {e.replace("university", "univrsity") for e in entries} | {e[::-1] for e in entries[:20]} | {"".join(rng.permutation(list(e))) for e in entries} | {"zürich eth", "x" * 300, "", "nyu"}
    want = set()
    for n in names:
        ratio, entry = max(((SequenceMatcher(None, n, e).ratio(), e) for e in entries), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if ratio >= 0.75:
            want.add((n, entry, round(ratio, 6)))
    hist = spark.createDataFrame([(n, 1) for n in names], "normalized string, n_mentions long")
    assert {tuple(r)[:3] for r in L.near_misses(hist, L.default_rules(spark)).collect()} == want and len(want) > 30


def test_labels_are_written_back_in_full(spark):
    points = spark.createDataFrame([(1, "p", "privileged", ["old"]), (2, "q", "privileged", ["old"]), (3, None, "privileged", ["old"]), (4, "", None, None)], "vec_id int, paper_id string, institution_label string, affiliations array<string>")
    new = spark.createDataFrame([("p", "underrepresented", ["new"])], "paper_id string, label string, affiliations array<string>")
    got = {r["vec_id"]: (r["institution_label"], r["affiliations"]) for r in L.update_payload(points, new).collect()}
    assert got == {1: ("underrepresented", ["new"]), 2: ("unknown", []), 3: ("privileged", ["old"]), 4: (None, None)}


def test_titles_tell_papers_without_id_apart(spark):
    hits = spark.createDataFrame([("q", f"d{i}", s, i) for i, s in enumerate((0.9, 0.9, 0.3, 0.9, 0.9, 0.9), start=1)], "qkey string, doc_key string, score double, rank int")
    payload = spark.createDataFrame([("d1", "A  b", "x", None), ("d2", "A b", "y", ""), ("d3", "other", "x", "p"), ("d4", "else", "x", "p"), ("d5", None, "x", None), ("d6", "A b", "x", "r")], "doc_key string, title string, abstract string, paper_id string")
    queries = spark.createDataFrame([("q", "words")], "qkey string, query string")
    assert [(r["doc_key"], r["rank"]) for r in Q.auto_qrels(hits, payload, queries).orderBy("rank").collect()] == [("d1", 1), ("d4", 2), ("d6", 3)]


def test_exposure_needs_a_query(spark):
    run = spark.createDataFrame([], "qid string, label string, rank int")
    with pytest.raises(PySparkException):
        P.exposure_summary(P.exposure_per_query(run), P.parity_per_query(run)).collect()


def test_model_answers(spark):
    text = '```json\n[{"title": "T", "stance": "NEUTRAL"}]\n```'
    stances = spark.createDataFrame([("1", text), ("2", "sorry"), ("3", None)], "id string, answer string")
    assert [tuple(r) for r in M.stance_answers(stances).collect()] == [("1", 0, "NEUTRAL")]
    grades = spark.createDataFrame([("b", '[{"id": 1, "grade": 2}]')], "batch string, answer string")
    assert [tuple(r) for r in M.grade_answers(grades).collect()] == [("b", 1, 2, 0)]


def test_topk_over_blocks_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    corpus = spark.createDataFrame([(f"d{i:03}", [float(x) for x in rng.integers(-2, 3, 4)] + [1.0]) for i in range(300)], "doc_key string, v array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in rng.integers(-2, 3, 4)] + [1.0]) for i in range(12)], "qid string, v array<double>")
    whole = sorted(map(tuple, V.dense_topk(queries, corpus, 7).collect()))
    monkeypatch.setattr(V, "FEW_QUERIES", 3)
    monkeypatch.setattr(V, "QUERY_BYTES", 8 * 8 * 5)
    monkeypatch.setattr(V, "SCORES_AT_ONCE", 60)
    assert sorted(map(tuple, V.dense_topk(queries, corpus, 7).collect())) == whole and len(whole) == 84
