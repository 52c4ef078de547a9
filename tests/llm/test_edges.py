"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns, hot groups."""

import contextlib
import math
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from equirank.llm import canonical, common, knn, leakage, lookalike, markup, mixing, mojibake, neardup, sampling

ABSTRACT = "the quick brown fox jumps over the lazy dog while seven wizards mix strange potions near the old stone bridge every single night"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1


def papers(spark, data):
    return spark.createDataFrame(data, "paper_id string, title string, abstract string, key int, class_key string, a int")


def test_near_duplicates_edges(spark):
    data = [
        ("p1", "A title", ABSTRACT, 1, "x", 0), ("p2", "A title", ABSTRACT + " again", 1, "x", 0), ("p3", "A TITLE!", ABSTRACT.upper(), 1, "x", 0), ("p1", "A title", ABSTRACT, 1, "x", 0),
        ("p4", None, None, 1, "x", 0), ("p5", "", "", 1, "x", 0), ("p6", "two words", None, 1, "x", 0), ("p7", "two words", "", 1, "x", 0), (None, "A title", ABSTRACT, 1, "x", 0),
        ("p8", "other", "completely different words about matrices and kernels in a long sentence without anything shared", 1, "x", 0), ("p9", "long", "w " * 200_000, 1, "x", 0),
    ]
    df = papers(spark, data)
    classes, links = neardup.near_duplicates(df, "paper_id", ["title", "abstract"], width=3, similarity=0.5)
    assert rows(neardup.near_duplicate_pairs(classes, links, 3)) == [("p1", "p2"), ("p1", "p3"), ("p2", "p3")]
    work = {r["key"]: r["work"] for r in neardup.near_duplicate_groups(classes, links).collect()}
    assert set(work) == {f"p{i}" for i in range(1, 10)} and work["p1"] == work["p2"] == work["p3"] != work["p8"] and work["p6"] == work["p7"]
    classes, links = neardup.near_duplicates(df.limit(0), "paper_id", ["title", "abstract"])
    assert neardup.near_duplicate_pairs(classes, links, 5).count() == 0 == neardup.near_duplicate_groups(classes, links).count()


def test_hot_anchors_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocabulary, 60))
    data = []
    for i in range(60):  # near copies of one text crowd the same anchors
        w = list(base)
        w[int(rng.integers(60))] = f"edit{i}"
        data.append((f"h{i:02}", "t", " ".join(w), 1, "x", 0))
    df = papers(spark, data)
    run = lambda: rows(neardup.near_duplicate_pairs(*neardup.near_duplicates(df, "paper_id", ["title", "abstract"], width=3, similarity=0.5), 3))
    whole = run()
    monkeypatch.setattr(neardup, "HOT", 7)
    monkeypatch.setattr(neardup, "WATCHED", 1)
    assert run() == whole and len(whole) > 1500


def test_works_join_the_texts_of_one_key(spark):
    other = "completely different words about matrices and kernels in a long sentence without anything shared at all"
    data = [("b", ABSTRACT), ("b", other), ("c", other + " now"), ("a", ABSTRACT + " again"), ("e", ""), ("f", None), ("g", "two words"), ("h", "Two, words!")]
    df = papers(spark, [(k, t, None, 1, "x", 0) for k, t in data])
    classes, links = neardup.near_duplicates(df, "paper_id", ["title", "abstract"], width=3, similarity=0.5)
    got = {r["key"]: (r["work"], r["n_links"]) for r in neardup.near_duplicate_groups(classes, links).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 2), "c": ("a", 1), "e": ("e", 0), "f": ("f", 0), "g": ("g", 0), "h": ("g", 0)}


def test_skewed_join_equals_the_plain_one(spark):
    left = spark.createDataFrame([("hot", i) for i in range(100)] + [(f"k{i}", i) for i in range(20)] + [(None, 1)], "k string, n int")
    right = spark.createDataFrame([("hot", "h"), ("k3", "three"), ("k99", "none")], "k string, v string")
    assert rows(common.join_skewed(left, right, "k", hot=10)) == rows(left.join(right, "k", "left"))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (5, 200), (200, 5)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in [*range(51), 200]} == {0} and {got[i] for i in (100, 101, 102)} == {100} and len(got) == 55
    assert common.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


# 2

CELLS = "cell_id int, category string, institution_label string, year_from int, year_to int, target_bp int, min_rows int"


def test_sample_edges(spark):
    data = [(i, f"p{i}", "CS.lg; cs.AI", " Privileged\t", 2010) for i in range(100)] + [(200 + i, f"q{i}", ", cs.CV", "unknown", 2012) for i in range(10)]
    data += [(300, "p0", "cs.CV", "unknown", 2012), (301, None, "cs.LG", "privileged", 2010), (302, "n", None, None, None), (303, "e", "", "", 1900)]
    df = spark.createDataFrame(data, "vec_id long, paper_id string, category string, institution_label string, year int").withColumn("cell_id", F.lit("clash"))
    targets = spark.createDataFrame([(1, "cs.LG", "privileged", 2010, 2010, 5000, 1), (2, "cs.CV", "unknown", 2000, 2020, 5000, 2), (3, "cs.XX", "unknown", 2000, 2020, 0, 1)], CELLS)
    latest = sampling.latest_papers(df)
    report = {r["cell_id"]: r.asDict() for r in sampling.quota_report(latest, targets).collect()}
    assert latest.count() == 112 and report[1]["available"] == 99 and report[2]["available"] == 11
    assert [report[i]["needed"] for i in (1, 2, 3)] == [11, 11, 1] and [report[i]["missing"] for i in (1, 2, 3)] == [0, 0, 1]
    sample = sampling.quota_sample(latest, targets).collect()
    assert len(sample) == 22 == len({r["paper_id"] for r in sample})
    assert sorted(r["rank"] for r in sample if r["cell_id"] == 1) == list(range(1, report[1]["seats"] + 1))
    assert sampling.quota_report(latest.limit(0), targets).where("missing > 0").count() == 3 and sampling.quota_sample(latest.limit(0), targets).count() == 0
    assert sampling.quota_report(latest, targets.limit(0)).count() == 0 == sampling.quota_sample(latest, targets.limit(0)).count()


def test_sample_ranks_hot_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANK_BLOCK", 10)
    data = [(i, f"p{i}", "a", "u", 2000) for i in range(300)]
    latest = sampling.latest_papers(spark.createDataFrame(data, "vec_id long, paper_id string, category string, institution_label string, year int"))
    targets = spark.createDataFrame([(1, "a", "u", 2000, 2000, 10000, 0)], CELLS)
    got = sampling.quota_sample(latest, targets).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 61))


def test_overlapping_cells_and_minima_beyond_the_size(spark):
    latest = sampling.latest_papers(spark.createDataFrame([(i, f"p{i:03}", "a", "u", 2000) for i in range(80)], "vec_id long, paper_id string, category string, institution_label string, year int"))
    targets = spark.createDataFrame([(1, "a", "u", 1990, 2010, 5000, 4), (2, "a", "u", 2000, 2000, 5000, 4), (3, None, "u", None, 2000, None, None)], CELLS)
    report = {r["cell_id"]: r.asDict() for r in sampling.quota_report(latest, targets).collect()}
    sample = sampling.quota_sample(latest, targets).collect()
    assert report[1]["available"] + report[2]["available"] == 80 and report[3]["available"] == 0  # each paper in one cell
    assert len(sample) == 16 == len({r["paper_id"] for r in sample}) and {c: sum(r["cell_id"] == c for r in sample) for c in (1, 2)} == {c: report[c]["seats"] for c in (1, 2)}
    greedy = spark.createDataFrame([(1, "a", "u", 1990, 2010, 10000, 30)], CELLS)
    r = sampling.quota_report(latest, greedy).first()
    assert (r["asked"], r["seats"], r["needed"], r["missing"]) == (16, 30, 30, 0) == (16, sampling.quota_sample(latest, greedy).count(), 30, 0)


def test_shares_of_the_mix_as_drawn(spark):
    rng = np.random.default_rng(6)
    data = [(i, f"s{i % 4}", "w " * int(rng.integers(1, 300))) for i in range(4000)]
    counted = mixing.source_tokens(spark.createDataFrame(data, "doc_id long, source string, text string"))
    targets = spark.createDataFrame([("s0", 4000, 3), ("s1", 3000, 2), ("s2", 2000, 1), ("s3", 1000, 1), ("s4", 0, 9)], "source string, target_bp int, max_repeats int")
    plan = {r["source"]: r for r in mixing.mix_plan(counted, targets).collect()}
    for seed in (0, 5):
        for r in mixing.mix_report(counted, targets, block=200, seed=seed).collect():
            assert abs(r["tokens"] - plan[r["source"]]["target"]) <= 2 * 300 and r["reachable"] == plan[r["source"]]["reachable"] == (r["source"] != "s4")
    assert sorted(mixing.mix(counted, targets, seed=1).collect()) == sorted(mixing.mix(counted.repartition(3), targets, seed=1).collect())
    assert sorted(mixing.mix(counted, targets, seed=1).collect()) != sorted(mixing.mix(counted, targets, seed=2).collect())


def test_divisor_seats_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        cells = [{"cell_id": i, "available": int(rng.integers(0, 40)), "target": int(rng.integers(0, 900)), "floor": int(rng.integers(0, 4))} for i in range(8)]
        seats = int(rng.integers(0, 200))
        got = sampling.divide_seats(cells, seats)
        want = {c["cell_id"]: min(c["floor"], c["available"]) for c in cells}
        queue = sorted(((k - 0.5) / c["target"], c["cell_id"], k) for c in cells if c["target"] for k in range(1, c["available"] + 1))
        for _, cell, k in queue:
            if sum(want.values()) >= seats:
                break
            if k > want[cell]:
                want[cell] += 1
        assert got == want


# 3

NAMES = "ref_id int, kind string, canonical_name string, acronym string, local_name string, city string, country string"


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(
        [(1, "institution", "Royal Academy of Gérnes", "RAGER", "Real Academia de Gérnes", "Gérnes", "Arkhania"), (2, "institution", "City University of Gérnes", "CUGER", None, "Gérnes", "Arkhania"),
         (3, "institution", "University of Gérnes", "UGER", None, "Gérnes", "Arkhania"), (4, "institution_label", "privileged", None, None, None, None), (5, "institution", None, None, None, None, None)], NAMES)


def test_canonical_edges(spark, names):
    typed = {
        "Royal Academy of Gérnes": None, "royal acad. of GERNES": 1, "Gérnes, University of": 3, "City Univ of Gernes; retired": 2, "Dept. of X, City University of Gérnes, 12345 Gérnes, Arkhania": 2,
        "Real Academia de Gérnes": 1, "uger": 3, "UGER, Gérnes": 3, "Royal Acadmey of Gérnes": 1, "RoyalAcademyofGérnes": 1, "Medical University of Gérnes": -1, "Department of Physics": -1,
        "Gérnes": -1, "?": -1, "N/A": -1, " ": None, "": None, None: None, "x" * 100_000: -1, "University оf Ｇérnes": 3,
    }
    data = [(i, v, 7) for i, v in enumerate(typed)] + [(99, "uger", 7)]
    df = spark.createDataFrame(data, "row_id long, value string, ref_id int")
    got = {r["row_id"]: r["ref_id"] for r in canonical.map_to_canonical(df, names, key="row_id", field="value", kind="institution").collect()}
    assert got == {i: w for i, w in enumerate(typed.values()) if w is not None} | {99: 3}
    labels = canonical.map_to_canonical(df, names, key="row_id", field="value", kind="institution_label")
    assert {r["ref_id"] for r in labels.collect()} == {-1}
    assert canonical.map_to_canonical(df, names.limit(0), key="row_id", field="value", kind="institution").where("ref_id <> -1").count() == 0
    assert canonical.map_to_canonical(df.limit(0), names, key="row_id", field="value", kind="institution").count() == 0
    assert canonical.unmatched_report(labels).where("value = 'uger'").first()["n_rows"] == 2


def test_automaton_by_brute_force():
    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = np.random.default_rng(2)
    entries = {"".join(rng.choice(list("abc"), int(rng.integers(1, 8)))) for _ in range(120)}
    trie = canonical.Trie({e: (e,) for e in entries})
    for _ in range(150):
        q = "".join(rng.choice(list("abc"), int(rng.integers(0, 8))))
        for bound in (0, 1, 2, 3):
            assert dict((v, d) for d, v in trie.search(q, bound)) == {e: distance(q, e) for e in entries if distance(q, e) <= bound}


def distances(word, matrix, lengths):
    """Edit distances with transpositions of one word to rows of padded character codes."""
    n, m = matrix.shape
    d = [[np.full(n, i + j) for j in range(m + 1)] for i in range(len(word) + 1)]
    for i in range(1, len(word) + 1):
        for j in range(1, m + 1):
            best = np.minimum(np.minimum(d[i - 1][j], d[i][j - 1]) + 1, d[i - 1][j - 1] + (matrix[:, j - 1] != ord(word[i - 1])))
            if i > 1 and j > 1:
                swapped = (matrix[:, j - 2] == ord(word[i - 1])) & (matrix[:, j - 1] == ord(word[i - 2]))
                best = np.where(swapped, np.minimum(best, d[i - 2][j - 2] + 1), best)
            d[i][j] = best
    return np.stack(d[-1])[lengths, np.arange(n)]


def test_a_hundred_thousand_entries(spark):
    import time

    rng = np.random.default_rng(12)
    cities = sorted({"".join(rng.choice(list("abdeiklmnorstu"), int(rng.integers(7, 10)))) for _ in range(100_000)})
    entries = [{"ref_id": i, "canonical_name": f"University of {c.title()}", "acronym": None, "local_name": None, "city": c.title()} for i, c in enumerate(cities)]
    start = time.time()
    index = canonical.Index(entries)
    assert time.time() - start < 60 and len(entries) > 99_000
    matrix = np.array([[ord(x) for x in c.ljust(9, "\0")] for c in cities])
    lengths = np.array([len(c) for c in cities])
    for i in range(25):
        w = list(cities[int(rng.integers(len(cities)))])
        for _ in range(i % 3):
            w[int(rng.integers(len(w)))] = str(rng.choice(list("abdeiklmnorstuxyz")))
        typed = "".join(w)
        far = distances(typed, matrix, lengths)
        ref, distance, tied, candidates = index.match(f"Dept. of Physics, Univ. of {typed.upper()}, Building 7")
        assert set(candidates) == set(np.flatnonzero(far <= 2)) and len(candidates) == len(set(candidates))
        if candidates:
            nearest = np.flatnonzero(far == far.min())
            assert (ref, distance, tied) == (nearest[0], far.min(), len(nearest) > 1)
        else:
            assert (ref, tied) == (-1, False)


def test_ties_segments_and_spelling(spark, names):
    rows_ = [(1, "institution", "Aster College", None, None, None, None), (2, "institution", "Astor College", None, None, None, None), (3, "institution", "A B C D E F", None, None, None, None), (4, "institution", "Nordkap Hochschule", None, None, None, None)]
    known = spark.createDataFrame(rows_, NAMES)
    typed = spark.createDataFrame([(1, "Astir College"), (2, "Aster Colege"), (3, "A, B; C | D (E) F"), (4, "Nordkap HS"), (5, "A, B; C | D (E)")], "row_id long, value string")
    run = lambda **x: {r["row_id"]: (r["ref_id"], r["tied"], r["candidates"]) for r in canonical.map_to_canonical(typed, known, key="row_id", field="value", kind="institution", **x).collect()}
    assert run() == {1: (1, True, [1, 2]), 2: (1, False, [1, 2]), 3: (3, False, [3]), 4: (-1, False, []), 5: (-1, False, [])}
    german = canonical.Spelling(abbreviations={"hs": "hochschule"}, noise=())
    assert run(spelling=german)[4] == (4, False, [4])


# 4


def test_vectors_edges(spark):
    unit = lambda *x: [float(v) for v in x]
    data = [(1, unit(1, 0, 0, 0)), (2, unit(2, 0, 0, 0)), (3, unit(1, 0.1, 0, 0)), (4, unit(0, 1, 0, 0)), (5, None), (6, unit(0, 0, 0, 0)), (7, [1.0, None, 0.0, 0.0]), (8, unit(1, 0)), (9, [float("nan")] * 4), (2, unit(2, 0, 0, 0))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash")).withColumn("v", F.lit(1))
    near = rows(knn.nearest(df, "vec_id", "embedding", size=4, k=2, min_cosine=0.9).select("key", "other", "rank"))
    assert near == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]
    full = knn.nearest(df, "vec_id", "embedding", size=4, k=10).groupBy("key").count()
    assert rows(full) == [(1, 3), (2, 3), (3, 3), (4, 3)]
    assert knn.nearest(df.limit(0), "vec_id", "embedding", size=4).count() == 0


def test_each_cell_has_a_partition_of_its_own(spark):
    for n in (1, 8, 64, 300):
        slots = common.partition_slots(spark, n)
        df = spark.createDataFrame([(x,) for x in slots for _ in range(3)], "slot int").repartition(n, "slot")
        at = df.select(F.spark_partition_id().alias("p"), "slot").distinct().collect()
        assert len(slots) == len(set(slots)) == n == len({r["p"] for r in at}) == len(at)


def test_crowded_cells_are_shared(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    run = lambda: rows(knn.nearest(df, "vec_id", "embedding", size=8, k=5, cell=64).select("key", "other", "rank"))
    whole = run()
    monkeypatch.setattr(knn, "VISITORS", 20)
    assert run() == whole and len(whole) == 3000


def test_a_vector_shared_by_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    other = rng.standard_normal((200, 8)).astype(float).tolist()
    data = [(i, [1.0] * 8) for i in range(100)] + [(100 + i, v) for i, v in enumerate(other)] + [(500, [1.0] * 7 + [1.001])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in knn.nearest(df, "vec_id", "embedding", size=8, k=10, min_cosine=0.9, cell=32).collect():
        got.setdefault(r["key"], {})[r["rank"]] = r["other"]
    assert [got[50][i] for i in range(1, 11)] == list(range(10)) and [got[3][i] for i in range(1, 11)] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert [got[500][i] for i in range(1, 11)] == list(range(10))


def test_disk_does_not_grow_with_the_cells(spark):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((16_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((500, 64))
    z -= (z * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    x[500:1000] = 0.92 * x[:500] + math.sqrt(1 - 0.92**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    common.ensure_checkpoint_dir(spark)
    sc = spark.sparkContext._jsc.sc()
    dirs = [d.getPath() for d in sc.env().blockManager().diskBlockManager().localDirs()] + [sc.getCheckpointDir().get().removeprefix("file:")]

    def on_disk():
        total = 0
        for top in dirs:
            for at, _, names in os.walk(top):
                for n in names:
                    with contextlib.suppress(OSError):  # just removed
                        total += os.path.getsize(os.path.join(at, n))
        return total

    floor, peak, over = on_disk(), [], threading.Event()

    def watch():
        while not over.wait(0.02):
            peak.append(on_disk())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {(r["key"], r["other"]) for r in knn.nearest(df, "vec_id", "embedding", min_cosine=0.9, cell=64).collect()}
    finally:
        over.set()
        watcher.join()
    planted = {(i, i + 500) for i in range(500)} | {(i + 500, i) for i in range(500)}
    assert len(planted - got) <= 6 and got <= planted
    assert max(peak) - floor < 8 * 16_000 * 64 * 4  # the vectors, two tables of them, and answers


def test_visits_in_waves_equal_those_at_once(spark, monkeypatch):
    rng = np.random.default_rng(17)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))], "vec_id long, embedding array<float>")
    run = lambda: rows(knn.nearest(df, "vec_id", "embedding", size=8, k=5, queries="vec_id % 2 = 0", cell=128).select("key", "other", "rank"))
    monkeypatch.setattr(knn, "VISITORS", 100_000)
    whole = run()
    monkeypatch.setattr(knn, "VISITORS", 1)  # a wave holds 600 visits
    kept = []
    monkeypatch.setattr(knn, "checkpoint", lambda df, drop=False: kept.append(1) or common.checkpoint(df, drop))
    assert run() == whole and len(whole) == 1500 and len(kept) > 3


def test_chance_to_share_a_cell():
    rng = np.random.default_rng(3)
    for directions in (8, 64, 512):
        a, b = rng.standard_normal((2, 4000, directions))
        same = np.mean(a.argmax(axis=1) == (0.9 * a + math.sqrt(0.19) * b).argmax(axis=1))
        assert abs(knn.shared_cell(directions, 0.9) - same) < 0.03
    tables = knn.Tables(8_000_000, 512, 64, 0.9, 1e-3, 1)
    met = knn.LOCAL * knn.shared_cell(tables.each, 0.9) ** tables.choices
    assert tables.cells * 512 >= 8_000_000 and (1 - met) ** tables.count <= 1e-3


# 5, 6, 9


def test_value_operators_edges(spark):
    values = ["plain", None, "", "е́ mixеd", "x" * 50_000 + " ", "Ａ", "plain"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string").withColumn("kinds", F.lit(1)).withColumn("at", F.lit(2)).withColumn("ch", F.lit(3))
    got = {r["id"]: (r["normalized"], r["kinds"]) for r in lookalike.normalize_values(df, ["id"]).collect()}
    assert got == {i: (lookalike.unify(v) if v else v, k) for i, (v, k) in enumerate(zip(values, [[], [], [], got[3][1], ["space"], ["compat"], []]))}
    assert "mark" in got[3][1] and "lookalike" in got[3][1]
    assert lookalike.normalize_values(df.limit(0), ["id"]).count() == 0
    texts = ["<b>x</b>", None, "", "plain", "a" * 100_000 + "\\emph{b}", "<b>x</b>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string").withColumn("clean", F.lit(1)).withColumn("kinds", F.lit(2))
    got = {r["id"]: (r["clean"], r["kinds"]) for r in markup.clean_values(df, ["id"]).collect()}
    assert got == {0: ("x", ["html"]), 1: (None, []), 2: ("", []), 3: ("plain", []), 4: ("a" * 100_000 + "b", ["latex"]), 5: ("x", ["html"])}
    assert markup.clean_values(df.limit(0), ["id"]).count() == 0


def test_garbled_edges(spark):
    good, bad = "Größe für alle", "Größe für alle".encode().decode("cp1252")
    texts = [good] * 5 + [bad, None, "", "ascii only", (good + " ") * 5000 + bad, bad]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("restored", F.lit(1)).withColumn("pieces", F.lit(1))
    got = {r["doc_id"]: (r["restored"], r["pieces"], r["lost"]) for r in mojibake.restore_texts(df).collect()}
    assert got == {5: (good, 2, False), 9: ((good + " ") * 5000 + good, 2, False), 10: (good, 2, False)}
    assert mojibake.restore_texts(df.limit(0)).count() == 0


def test_forms_equal_those_of_single_values(spark, sf, monkeypatch):
    texts = {v for f, t in (("title", "fairsearch_arxiv"), ("author_name", "authorships"), ("raw_affiliation", "authorships")) for (v,) in common.read(spark, sf, t).select(f).collect()}
    rng, signs = np.random.default_rng(9), list("ab -А́̂ｆﬁ​  оλяΑ，—é\n文字")
    texts |= {"".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(400)} | {"слово " * 3000, "文" * 5000, "x" * 20_000 + "é", ("wоrd " + "é" * 70) * 50}
    values = sorted(t for t in texts if t is not None)
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    for chunk in (lookalike.CHUNK, 3):
        monkeypatch.setattr(lookalike, "CHUNK", chunk)
        got = {r["id"]: r for r in lookalike.normalize_values(df, ["id"]).collect()}
        assert len(got) == len(values)
        for i, v in enumerate(values):
            assert got[i]["normalized"] == lookalike.unify(v) and got[i]["changed"] == (got[i]["normalized"] != v), v


# 7


def test_leakage_edges(spark, monkeypatch):
    passage = ABSTRACT
    part = " ".join(passage.split()[:13])
    docs = [(1, "intro " + passage + " end"), (2, part + " something else entirely"), (3, " ".join(passage.split()[:8])), (4, None), (5, ""), (6, "filler words " * 60_000 + passage), (7, passage.upper().replace(" ", "\n")), (7, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, passage, "q"), (2, None, "q"), (3, "too short", "q"), (4, "seventeen other words that never occur in any of the documents above are listed here", "q"), (5, passage, "q")], "item_id int, passage string, query string")
    want = [(1, 1), (1, 5), (2, 1), (2, 5), (6, 1), (6, 5), (7, 1), (7, 5)]
    assert rows(leakage.leaked_items(df, items).select("doc_id", "item_id")) == want
    monkeypatch.setattr(leakage, "BLOCK_ENTRIES", 1)
    assert rows(leakage.leaked_items(df, items).select("doc_id", "item_id")) == want
    assert leakage.leaked_items(df.limit(0), items).count() == 0 == leakage.leaked_items(df, items.limit(0)).count()


def test_passages_of_all_sizes_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    passages = [" ".join(rng.choice(vocabulary, n)) for n in (5, 6, 9, 20, 33, 36, 40, 60, 64, 70, 130, 200, 300, 700, 1500) for _ in range(4)]
    docs = []
    for i in range(300):
        p = passages[int(rng.integers(len(passages)))].split()
        at, n = int(rng.integers(len(p))), max(5, int(len(p) * rng.uniform(0.3, 1)))
        docs.append((i, " ".join([*rng.choice(vocabulary, int(rng.integers(0, 1500))), *p[at : at + n], *rng.choice(vocabulary, 40)])))
    runs = lambda t: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)}
    want = {(d, i) for d, t in docs for s in [runs(t)] for i, p in enumerate(passages) if len(runs(p) & s) >= 0.4 * len(runs(p))}
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items).select("doc_id", "item_id").collect()}
    assert got == want and len(want) > 80


def test_a_short_passage_costs_the_others_nothing():
    assert leakage.entries_of(1, 0.4, 1e-6) == 1 and leakage.entries_of(150, 0.4, 1e-6) < 320
    assert leakage.functions_needed(leakage.SEGMENT, 33, 0.4, 1e-6) <= leakage.MOST_FUNCTIONS


def test_enough_functions():
    for upper in (64, 512, 4096):
        n = leakage.functions_needed(upper, 60, 0.4, 1e-6)
        assert (1 - 24 / (upper + 36)) ** n <= 1e-6


# 8


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 3000).astype(float)
    p = np.full(3000, 0.37)
    out = mixing.fly(p, size, np.random.default_rng(1))
    assert np.count_nonzero((out > 0) & (out < 1)) <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    assert set(mixing.fly(np.array([0.0, 1.0]), np.array([1.0, 2.0]), rng)) == {0.0, 1.0}
    equal = mixing.fly(np.full(10, 0.5), np.full(10, 3.0), rng)
    assert equal.sum() == pytest.approx(5)


def test_mix_edges(spark):
    data = [(i, " Big " if i % 2 else "big", "a b c d " * (1 + i % 7)) for i in range(400)] + [(1000 + i, "small", "x y.") for i in range(5)] + [(2000, None, "z"), (2001, "big", None), (2002, "big", ""), (2003, "none", "q")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 6000, 3), ("small", 4000, 2), ("absent", 0, 1)], "source string, target_bp int, max_repeats int")
    counted = mixing.source_tokens(df)
    plan = {r["source"]: r.asDict() for r in mixing.mix_plan(counted, targets).collect()}
    assert plan["small"]["available"] == 15 and not plan["small"]["reachable"] and plan["big"]["reachable"] and not plan["absent"]["reachable"]
    drawn = mixing.mix(counted, targets, block=50).collect()
    assert {r["copies"] for r in drawn if r["source"] == "small"} == {2} and len(drawn) == len({r["doc_id"] for r in drawn})
    tokens = sum(r["copies"] * r["tokens"] for r in drawn if r["source"] == "big")
    assert abs(tokens - plan["big"]["target"]) <= 2 * max(r["tokens"] for r in drawn)
    assert mixing.mix(counted.limit(0), targets).count() == 0 and mixing.mix(counted, targets.limit(0)).count() == 0
    assert [r["tokens"] for r in mixing.mix_report(counted, targets).where("source = 'small'").collect()] == [30]


def test_tokenizer_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([(1, "s", "hello world"), (2, "s", None)], "doc_id long, source string, text string")
    assert [r["tokens"] for r in mixing.source_tokens(df, mixing.tokenizer_tokens(path)).orderBy("doc_id").collect()] == [2, 0]


def test_garbled_words_are_judged_alike_in_a_corpus_of_any_size(spark):
    good, other = ["wartość", "Índia", "Möllgård"], ["für", "été", "größe"]
    bad = [good[0].encode("iso8859-2").decode("latin-1"), "Ã�ndia", "M�llg�rd"]
    texts = [f"see {w} now" for w in [*good, good[0]]] + [f"see {w} now" for w in bad]
    for repeats in (1, 2000):  # 6,000 to 12 million other words beyond ASCII
        filler = spark.range(2000).selectExpr("id + 1000 AS doc_id", f"repeat('{' '.join(other)} ', {repeats}) AS text")
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(filler)
        got = {r["doc_id"]: r["restored"] for r in mojibake.restore_texts(df).collect()}
        assert got == {4 + i: f"see {w} now" for i, w in enumerate(good)}, repeats


def test_invisible_tags_and_variation_selectors_beyond_the_first_planes(spark):
    values = ["a\U000e0001b\U000e0041\U000e007fc", "x\U000e0100y", "\U000e01ef", "𝐀 plain"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    got = {r["id"]: (r["normalized"], r["kinds"]) for r in lookalike.normalize_values(df, ["id"]).collect()}
    assert {i: got[i] for i in (0, 1, 2)} == {0: ("abc", ["invisible"]), 1: ("xy", ["invisible"]), 2: ("", ["invisible"])}
    assert [lookalike.unify(v) for v in values[:3]] == ["abc", "xy", ""]
