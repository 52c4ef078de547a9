import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from equirank import schemas as S
from equirank.sources import readers, sinks
from equirank.streaming import resume


FAILURE = (PySparkException, Py4JJavaError)


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"id": "1", "title": "t"}\n{"id": "2"}\n')
    assert readers.json_lines(spark, good).count() == 2
    bad = put(tmp_path / "b.jsonl", '{"id": "1"}\n{"id": \n')
    with pytest.raises(FAILURE):
        readers.json_lines(spark, bad).collect()


def test_query_list(spark, tmp_path):
    p = put(tmp_path / "q.json", [" a ", {"query": "b\n"}, "", {"query": " "}])
    assert [tuple(r) for r in readers.query_list(spark, p).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(FAILURE):
        readers.query_list(spark, put(tmp_path / "r.json", [["x"]])).collect()


@pytest.mark.parametrize("shape", ["flat", "judgments", "candidates"])
def test_judgments_of_all_shapes(spark, tmp_path, shape):
    rows = [{"paper_id": "p", "title": "T", "relevance": 1}, {"paper_id": "p", "title": "T", "relevance": 3}, {"title": " Only  Title", "relevance": 2}, {"paper_id": "n", "relevance": None}]
    data = [{"query": "Q", **r} for r in rows] if shape == "flat" else [{"query": "Q", shape: rows}]
    got = readers.judgments(spark, put(tmp_path / "j.json", data)).collect()
    assert sorted(tuple(r) for r in got) == [("q", "only title", 2), ("q", "p", 3)]


def test_caches(spark, tmp_path):
    p = put(tmp_path / "c.json", {"1": ["MIT", "Figshare"], "2": [], "3": None})
    assert {r["paper_id"]: r["affiliations"] for r in readers.affiliation_cache(spark, p).collect()} == {"1": ["MIT"], "2": [], "3": []}
    assert readers.affiliation_cache(spark, str(tmp_path / "none.json")).count() == 0
    assert sorted(r[0] for r in readers.id_set(spark, put(tmp_path / "i.json", ["b", "a", "b"])).collect()) == ["a", "b"]
    assert readers.id_set(spark, str(tmp_path / "none2.json")).count() == 0
    grades = readers.judgment_cache(spark, put(tmp_path / "g.json", {"a || b||p1": 2}))
    assert [tuple(r) for r in grades.collect()] == [("a || b", "p1", 2)]
    assert readers.judgment_cache(spark, str(tmp_path / "none3.json")).count() == 0
    assert readers.optional(spark, str(tmp_path / "no"), S.PAPER).count() == 0
    with pytest.raises(FAILURE):
        readers.json_document(spark, str(tmp_path / "no"), S.PAPER).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "vec_id long, t string")
    sinks.write_parquet(df, str(tmp_path / "p"))
    new = spark.createDataFrame([(2, "B"), (3, "c")], "vec_id long, t string")
    sinks.write_points(new, str(tmp_path / "p"), str(tmp_path / "p2"))
    assert sorted(tuple(r) for r in readers.parquet(spark, str(tmp_path / "p2")).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_document(df.orderBy("vec_id"), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())[0] == {"vec_id": 1, "t": "a"}
    sinks.write_ids(df, str(tmp_path / "ids"), "t")
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b"]
    doc = json.loads(sinks.nested_document(df.agg(F.count("*").alias("n")), df).first()["value"])
    assert doc == {"summary": {"n": 2}, "per_query": [{"vec_id": 1, "t": "a"}, {"vec_id": 2, "t": "b"}]}


def test_stance_queries_and_tables(spark, tmp_path, capfd):
    p = put(tmp_path / "s.json", [{"id": 1, "category": "c", "query": "is it so"}, {"id": 2, "category": "d", "query": "or not"}])
    assert sorted(tuple(r) for r in readers.stance_queries(spark, p).select("id", "category", "query").collect()) == [(1, "c", "is it so"), (2, "d", "or not")]
    sinks.show_table(spark.createDataFrame([("a long query indeed", 0.5)], "query string, p double"), width=10)
    assert "a long ..." in capfd.readouterr().out


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "done")
    a = spark.createDataFrame([("1", 1), ("2", 1), ("2", 2)], "id string, n int")
    assert resume.append_once(a, path, ["id"]) == 2
    assert resume.append_once(a, path, ["id"]) == 0
    assert resume.append_once(a.union(spark.createDataFrame([("3", 1)], a.schema)), path, ["id"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_merge_cache(spark):
    old = spark.createDataFrame([("1", ["a"]), ("2", ["b"])], "k string, v array<string>")
    new = spark.createDataFrame([("2", []), ("3", ["c"])], "k string, v array<string>")
    merge = lambda **k: {r["k"]: r["v"] for r in resume.merge_cache(old, new, "k", "v", **k).collect()}
    assert merge() == {"1": ["a"], "2": [], "3": ["c"]}
    assert merge(only_filled=True) == {"1": ["a"], "2": ["b"], "3": ["c"]}
