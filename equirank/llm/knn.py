"""Problem 4: most similar vectors, by stable projections indexed by a kd-tree.

Unit vectors are projected to `dims` Gaussian directions: the squared projected
distance of two vectors is their squared distance times a chi-square variable of
`dims` degrees, so a neighbour at distance d lies within d x sqrt(quantile) of
the query with known probability. A kd-tree of median splits over the projected
space, fitted on a bounded sample, assigns every vector to one cell; a local
kd-tree inside each cell is built from all its vectors. A query is answered in
its own cell first, leaf by leaf in order of the projected gap, until the
chi-square test says that no nearer leaf is likely to improve its k-th distance;
with that distance it then visits the other cells that pass the same test.

The gap to a box counts only the coordinates outside the box, so the test takes
the quantile for that number of degrees.

Under a least cosine for all rows that single tree is not used: a query would visit a
share of the other cells that hardly falls as they grow in number, and its vector would
go to each. Instead every vector goes to one small cell in each of several independent
tables, the Gaussian directions with which its product is largest. Two vectors share a
cell of a table with a chance that follows from their cosine and the number of
directions alone, never from the data, so the number of tables follows from the chance
to miss a pair of just the least cosine. Inside a cell the local kd-tree and its test
are the same. Tables are worked off a few at a time and their shuffles are dropped.

Equal vectors are collapsed to one representative first and their members put
back afterwards, so a vector that a third of all rows share is searched once.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_skewed, partition_slots

#: Vectors of one cell, leaves of a local tree, and the sample that the splits are fitted on.
CELL, LEAF, SAMPLE = 16_384, 256, 20_000
#: Visitors of a cell in one task; a cell with more is copied to further tasks that share them.
VISITORS = 65_536
#: Vectors that are one cell by themselves, and of one cell of a table; directions of one choice (more cells take several choices);
#: tables at once, and tables above which the single tree is used; the confidence of the trees inside the cells for a pair at the least cosine.
ONE_CELL, TABLE_CELL, DIRECTIONS, WAVE, MOST_TABLES, LOCAL = 4_096, 512, 1_024, 2, 64, 0.99


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


@lru_cache(maxsize=64)
def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 50.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _gamma_share(degrees / 2, middle / 2) < p else (low, middle)
    return high


class Test:
    """The stopping test: may a box whose gap counts `degrees` coordinates hold a better neighbour?

    A neighbour at the k-th distance so far is found with the confidence `close`; one
    at the largest distance that counts at all with the confidence `wide`.
    """

    def __init__(self, dims: int, close: float, wide: float, far: float) -> None:
        self.close, self.wide = (
            np.array([1e-12] + [chi_square_quantile(p, c) for c in range(1, dims + 1)], dtype=np.float32) for p in (close, wide)
        )
        self.wide = self.wide * np.float32(far)

    def limit(self, kth: np.ndarray, degrees: np.ndarray) -> np.ndarray:
        """The largest squared gap that is still visited."""
        return np.minimum(kth * self.close[degrees], self.wide[degrees])


class Tree:
    """Median splits in heap order over projected vectors; cells are the nodes of the last level."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        size = 1 << depth
        self.axis, self.cut = np.zeros(size, np.int64), np.zeros(size, np.float32)
        groups = {1: np.arange(len(points))}
        for node in range(1, size):
            ix = groups.pop(node)
            if len(ix):
                axis = int(np.argmax(points[ix].std(axis=0)))
                cut = float(np.median(points[ix, axis]))
            else:
                axis, cut = 0, 0.0
            self.axis[node], self.cut[node] = axis, cut
            low = points[ix, axis] < cut
            groups[2 * node], groups[2 * node + 1] = ix[low], ix[~low]

    def home(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def visits(self, p: np.ndarray, kth: np.ndarray, test: Test) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose gap passes the test for the squared k-th distances."""
        row, node = np.arange(len(p)), np.ones(len(p), np.int64)
        gap = np.zeros(p.shape, np.float32)
        for _ in range(self.depth):
            axis = self.axis[node]
            off = p[row, axis] - self.cut[node]
            rows, nodes, gaps = [], [], []
            for side in (0, 1):
                outside = np.where((off >= 0) == bool(side), 0, np.abs(off)).astype(np.float32)
                g = gap.copy()
                at = np.arange(len(row))
                g[at, axis] = np.maximum(g[at, axis], outside)
                keep = (g * g).sum(axis=1) <= test.limit(kth[row], np.count_nonzero(g, axis=1))
                rows.append(row[keep])
                nodes.append(2 * node[keep] + side)
                gaps.append(g[keep])
            row, node, gap = np.concatenate(rows), np.concatenate(nodes), np.concatenate(gaps)
        return row, node - (1 << self.depth)


class Cell:
    """The vectors of one cell with their local kd-tree of tight leaf boxes."""

    def __init__(self, keys: np.ndarray, raw: np.ndarray, directions: np.ndarray, test: Test) -> None:
        self.test, self.directions = test, directions
        unit = raw.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        p = (unit @ directions).astype(np.float32)
        order, leaves = [], []
        stack = [np.arange(len(keys))]
        while stack:
            ix = stack.pop()
            if len(ix) <= LEAF:
                leaves.append(len(ix))
                order.append(ix)
                continue
            axis = int(np.argmax(p[ix].std(axis=0)))
            ix = ix[np.argpartition(p[ix, axis], len(ix) // 2)]
            stack += [ix[: len(ix) // 2], ix[len(ix) // 2 :]]
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        self.keys, self.unit = keys[order], unit[order]
        self.single = self.unit.astype(np.float32)
        self.ends = np.cumsum(leaves)
        self.starts = self.ends - np.array(leaves, np.int64)
        p = p[order]
        self.low = np.stack([p[a:b].min(axis=0) for a, b in zip(self.starts, self.ends)])
        self.high = np.stack([p[a:b].max(axis=0) for a, b in zip(self.starts, self.ends)])
        self.points = p

    def search(self, keys: np.ndarray, unit: np.ndarray, k: int, far: np.ndarray):
        """(query row, neighbour key, cosine) of up to k others per query nearer than `far` (squared), and the squared k-th distances."""
        rows, found, cosines, kth = [], [], [], far.copy()
        p = (unit @ self.directions).astype(np.float32)
        order = np.lexsort(p.T[::-1][:2])
        for lo in range(0, len(keys), 512):
            q = order[lo : lo + 512]
            at, who, cos, last = self._block(keys[q], unit[q], p[q], k, far[q])
            rows.append(q[at])
            found.append(who)
            cosines.append(cos)
            kth[q] = last
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), kth
        return np.concatenate(rows), np.concatenate(found), np.concatenate(cosines), kth

    def _block(self, keys, unit, p, k, far):
        n = len(keys)
        below = np.maximum(self.low[None] - p[:, None], 0)
        above = np.maximum(p[:, None] - self.high[None], 0)
        gap = below + above
        squared = np.einsum("qld,qld->ql", gap, gap)
        degrees = np.count_nonzero(gap, axis=2)
        single = unit.astype(np.float32)
        best = np.full((n, k), -2.0, np.float64)
        who = np.full((n, k), -1, np.int64)
        kth = far.astype(np.float64).copy()
        for leaf in np.argsort(squared.min(axis=0), kind="stable"):
            active = np.flatnonzero(squared[:, leaf] <= self.test.limit(kth, degrees[:, leaf]))
            if not len(active):
                continue
            a, b = self.starts[leaf], self.ends[leaf]
            cos = single[active] @ self.single[a:b].T
            floor = (1.0 - kth[active] / 2 - 1e-5).astype(np.float32)  # single precision only proposes
            x, y = np.divmod(np.flatnonzero(cos >= floor[:, None]), cos.shape[1])
            other = self.keys[a:b][y] != keys[active[x]]
            x, y = x[other], y[other]
            if not len(x):
                continue
            if len(x) > 4 * k * len(active):  # many proposals: only the best k (with a margin) of each query go on
                keep = min(cos.shape[1] - 1, 2 * k + 8)
                cut = np.partition(cos, cos.shape[1] - 1 - keep, axis=1)[:, cos.shape[1] - 1 - keep]
                good = cos[x, y] >= cut[x] - 1e-5
                x, y = x[good], y[good]
            exact = np.einsum("ij,ij->i", unit[active[x]], self.unit[a:b][y])
            had = np.unique(x)
            row = active[had]
            of = np.r_[np.repeat(np.arange(len(had)), k), np.searchsorted(had, x)]
            c = np.r_[best[row].ravel(), exact]
            w = np.r_[who[row].ravel(), self.keys[a:b][y]]
            top = np.lexsort((w, -c, of))
            of = of[top]
            top = top[np.arange(len(of)) - np.searchsorted(of, of) < k]  # each query has k entries at least
            best[row], who[row] = c[top].reshape(-1, k), w[top].reshape(-1, k)
            full = row[who[row, -1] != -1]
            kth[full] = np.minimum(kth[full], 2 - 2 * best[full, -1])
        at, col = np.nonzero(who != -1)
        near = 2 - 2 * best[at, col] <= far[at] + 1e-12
        at, col = at[near], col[near]
        return at, who[at, col], best[at, col], kth


def _unit(binary: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(binary), dtype="<f4").reshape(-1, size)
    unit = raw.astype(np.float64)
    return raw, unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _assign(size: int, directions: np.ndarray, tree: Tree):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf["v"].to_numpy()).astype("<f4")
                unit = raw.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                home = tree.home((unit @ directions).astype(np.float32))
                yield pd.DataFrame({"cell": home.astype(np.int32), "key": pdf["key"], "v": [x.tobytes() for x in raw], "query": pdf["query"]})

    return run


def _own_cell(size: int, directions: np.ndarray, tree: Tree, k: int, test: Test, far: float):
    """Rows of whole cells, sorted: local answers (kind 0) and the visits that they call for (kind 1)."""

    def finish(cell: int, part: list[pd.DataFrame]):
        pdf = pd.concat(part, ignore_index=True)
        raw, unit = _unit(pdf["v"], size)
        keys = pdf["key"].to_numpy()
        asked = np.flatnonzero(pdf["query"].to_numpy())
        if not len(asked):
            return
        index = Cell(keys, raw, directions, test)
        for lo in range(0, len(asked), 4096):
            q = asked[lo : lo + 4096]
            at, who, cos, kth = index.search(keys[q], unit[q], k, np.full(len(q), far))
            yield _rows(0, cell, keys[q][at], who, cos)
            row, to = tree.visits((unit[q] @ directions).astype(np.float32), kth.astype(np.float32), test)
            other = to != cell
            row, to = row[other], to[other]
            yield _rows(1, to, keys[q][row], np.full(len(row), -1), kth[row])

    return _by_cell(finish)


def _rows(kind: int, cell, key, other, value) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.int32(kind), "cell": np.broadcast_to(np.asarray(cell, np.int32), len(key)), "key": key, "other": other, "value": value})


def _project(directions: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                p = (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ directions
                yield pd.DataFrame({"key": pdf["key"], "p": list(p.astype(np.float32))})

    return run


def _by_cell(finish):
    def run(batches):
        now, part = None, []
        for pdf in batches:
            cells = pdf["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != now and part:
                    yield from finish(int(now), part)
                    part = []
                now = cells[lo]
                part.append(pdf.iloc[lo:hi])
        if part:
            yield from finish(int(now), part)

    return run


@lru_cache(maxsize=64)
def shared_cell(directions: int, cosine: float) -> float:
    """The chance that two unit vectors of this cosine have the largest product with the same one of so many Gaussian directions."""
    if directions == 1:
        return 1.0
    c, h = min(cosine, 0.9999), 0.02
    at = np.arange(-6 + h / 2, 6, h)
    x, y = at[:, None], at[None]
    mass = np.exp(-(x * x - 2 * c * x * y + y * y) / (2 * (1 - c * c)))
    mass /= mass.sum()
    below = mass.cumsum(axis=0) - mass / 2
    below = np.clip(below.cumsum(axis=1) - below / 2, 0, 1)
    return float(min(1.0, directions * (mass * below ** (directions - 1)).sum()))


class Tables:
    """Independent tables of cells, so many that a pair of just `cosine` meets in none with a chance of `miss` at most."""

    def __init__(self, n: int, rows: int, size: int, cosine: float, miss: float, seed: int) -> None:
        cells = max(1, -(-n // max(1, rows)))
        self.choices = max(1, math.ceil(math.log(cells) / math.log(DIRECTIONS) - 1e-9))
        self.each = math.ceil(cells ** (1 / self.choices) - 1e-9)
        self.size, self.seed, self.cells = size, seed, self.each**self.choices
        met = LOCAL * shared_cell(self.each, cosine) ** self.choices if cells > 1 else 1.0
        self.local = LOCAL if cells > 1 else 1 - miss  # what one table misses, the others find
        self.count = 1 if met >= 1 else math.ceil(math.log(miss) / math.log1p(-met)) if met > 1e-9 else MOST_TABLES + 1

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table; cells of different tables have different numbers."""
        out = np.zeros((len(unit), self.count), np.int64)
        single = unit.astype(np.float32)
        for t in range(self.count):
            rng = np.random.default_rng((self.seed, t))
            for _ in range(self.choices):
                out[:, t] = out[:, t] * self.each + (single @ rng.standard_normal((self.size, self.each), dtype=np.float32)).argmax(axis=1)
            out[:, t] += t * self.cells
        return out


def _place(tables: Tables):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf["v"].to_numpy()).astype("<f4")
                unit = raw.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                yield pd.DataFrame({"cells": list(tables.place(unit)), "key": pdf["key"], "v": [x.tobytes() for x in raw], "query": pdf["query"]})

    return run


def _within_cell(tables: Tables, dims: int, k: int, test: Test, far: float):
    """Rows of whole cells of tables, sorted: the answers inside each cell."""

    def finish(cell: int, part: list[pd.DataFrame]):
        pdf = pd.concat(part, ignore_index=True)
        asked = np.flatnonzero(pdf["query"].to_numpy())
        if len(pdf) < 2 or not len(asked):
            return
        raw, unit = _unit(pdf["v"], tables.size)
        keys = pdf["key"].to_numpy()
        directions = np.random.default_rng((tables.seed, cell // tables.cells, 1)).standard_normal((tables.size, dims))
        index = Cell(keys, raw, directions, test)
        for lo in range(0, len(asked), 4096):
            q = asked[lo : lo + 4096]
            at, who, cos, _ = index.search(keys[q], unit[q], k, np.full(len(q), far))
            if len(at):
                yield pd.DataFrame({"key": keys[q][at], "other": who, "value": cos})

    def run(batches):
        kept, n = [], 0
        for x in _by_cell(finish)(batches):
            kept.append(x)
            n += len(x)
            if n > 20_000:
                yield pd.concat(kept, ignore_index=True)
                kept, n = [], 0
        if kept:
            yield pd.concat(kept, ignore_index=True)

    return run


def _visited_cell(size: int, directions: np.ndarray, k: int, test: Test):
    """Sorted rows of cells, homes first (kind 0), then visitors (kind 1) with their k-th distance so far."""

    def run(batches):
        now, homes, index = None, [], None
        for pdf in batches:
            cells, kinds = pdf["cell"].to_numpy(), pdf["kind"].to_numpy()
            mark = cells.astype(np.int64) * 2 + kinds
            cuts = np.flatnonzero(np.diff(mark)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(mark)]):
                if lo == hi:
                    continue
                if cells[lo] != now:
                    now, homes, index = cells[lo], [], None
                part = pdf.iloc[lo:hi]
                if kinds[lo] == 0:
                    homes.append(part)
                    continue
                if index is None and homes:
                    whole = pd.concat(homes, ignore_index=True)
                    index = Cell(whole["key"].to_numpy(), _unit(whole["v"], size)[0], directions, test)
                    homes = []
                if index is None:
                    continue
                keys, unit = part["key"].to_numpy(), _unit(part["v"], size)[1]
                at, who, cos, _ = index.search(keys, unit, k, part["value"].to_numpy())
                yield pd.DataFrame({"key": keys[at], "other": who, "value": cos})

    return run


def distinct_vectors(df: DataFrame, key: str, vector: str, size: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (key, g1, g2); groups (g1, g2, rep, members) of equal vectors, with their `keep` smallest keys.

    Vectors that are null, of another length, zero, or hold nulls or no numbers take no part.
    """
    v = F.col(vector)
    fine = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    src = df.where(v.isNotNull() & F.col(key).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("key"), v.alias("v"))
    keyed = src.select("key", F.xxhash64("v").alias("g1"), F.xxhash64("v", F.lit(7)).alias("g2")).distinct()  # a row given twice counts once
    first = Window.partitionBy("g1", "g2").orderBy("key")
    groups = (
        keyed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
        .groupBy("g1", "g2").agg(F.array_sort(F.collect_set("key")).alias("members"))
        .select("g1", "g2", F.col("members")[0].alias("rep"), "members")
    )
    return keyed, groups


def _by_tables(reps: DataFrame, tables: Tables, k: int, far: float, dims: int, confidence: float) -> DataFrame:
    """(key, other, value): the answers of all tables, a few of them at a time; on disk are the vectors, those of one wave, and answers."""
    test = Test(dims, confidence, tables.local, far)
    homes = checkpoint(reps.mapInPandas(_place(tables), "cells array<int>, key long, v binary, query boolean"), drop=True)
    waves = []
    for lo in range(0, tables.count, WAVE):
        placed = homes.select(F.explode(F.slice("cells", lo + 1, WAVE)).alias("cell"), "key", "v", "query")
        found = placed.repartition("cell").sortWithinPartitions("cell").mapInPandas(
            _within_cell(tables, dims, k, test, far), "key long, other long, value double"
        )
        # rounded, so that ties do not depend on the order of summation
        met = found.groupBy("key", "other").agg(F.max(F.round("value", 12)).alias("value"))
        waves.append(checkpoint(met, drop=True))
    if len(waves) == 1:
        return waves[0]
    return reduce(DataFrame.unionByName, waves).groupBy("key", "other").agg(F.max("value").alias("value"))


def _by_visits(
    reps: DataFrame, n: int, size: int, k: int, far: float, dims: int, confidence: float, wide: float, cell: int, seed: int
) -> DataFrame:
    """(key, other, value): the answers of the cells of one tree, the own cell first, then those that pass the test."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((size, dims))
    depth = max(0, math.ceil(math.log2(max(1, n / cell))))
    fitted = np.empty((0, dims), np.float32)
    if depth:
        # about SAMPLE vectors, chosen by a hash of their keys; only their projections come to the driver
        share = min(1.0, SAMPLE / n)
        drawn = reps.where(F.xxhash64("key", F.lit(seed)) / F.lit(2.0**64) + 0.5 < share).select("key", "v")
        sample = drawn.mapInPandas(_project(directions), "key long, p array<float>").limit(2 * SAMPLE).toPandas().sort_values("key")
        fitted = np.stack(sample["p"].to_numpy())
    tree = Tree(fitted, depth)
    test = Test(dims, confidence, wide, far)

    homes = checkpoint(reps.mapInPandas(_assign(size, directions, tree), "cell int, key long, v binary, query boolean"), drop=True)
    cells = 1 << depth
    answers = "kind int, cell int, key long, other long, value double"
    # one partition per cell: hashing the numbers of the cells would leave some partitions empty and crowd others
    spark = reps.sparkSession
    slots = spark.createDataFrame(list(enumerate(partition_slots(spark, cells))), "cell int, slot int")
    at_home = homes.join(F.broadcast(slots), "cell").repartition(cells, "slot")
    own = checkpoint(at_home.sortWithinPartitions("cell").mapInPandas(_own_cell(size, directions, tree, k, test, far), answers), drop=True)
    local = own.where("kind = 0").select("key", "other", "value")
    # the visits are kept without vectors, which are joined to them on the way to the cells
    asked_for = own.where("kind = 1").select("cell", "kind", "key", "value")
    asking = homes.where("query").select("key", "v")
    found = [local]
    # a wave of cells at a time, each with about as many visits as there are vectors at most, unless one cell has more
    counted = [(r["cell"], r["count"]) for r in asked_for.groupBy("cell").count().orderBy("cell").collect()]  # one row per cell
    waves = [[]]
    for c, visitors in counted:
        if waves[-1] and sum(x for _, x in waves[-1]) + visitors > max(n, VISITORS):
            waves.append([])
        waves[-1].append((c, visitors))
    for wave in waves if counted else []:
        ways = [(c, -(-visitors // VISITORS)) for c, visitors in wave]
        tasks = sum(w for _, w in ways)
        free = iter(partition_slots(spark, tasks))
        desks = spark.createDataFrame([(c, [next(free) for _ in range(w)]) for c, w in ways], "cell int, slots array<int>")
        residents = homes.join(F.broadcast(desks), "cell").select("cell", F.lit(0).alias("kind"), "key", F.lit(0.0).alias("value"), "v", F.explode("slots").alias("slot"))
        guests = asked_for.join(F.broadcast(desks), "cell").join(asking, "key").select(
            "cell", "kind", "key", "value", "v", F.get("slots", F.pmod(F.xxhash64("key"), F.size("slots")).cast("int")).alias("slot")
        )
        visited = residents.unionByName(guests).repartition(tasks, "slot").sortWithinPartitions("cell", "kind").mapInPandas(
            _visited_cell(size, directions, k, test), "key long, other long, value double"
        )
        found.append(visited if len(waves) == 1 else checkpoint(visited, drop=True))
    # rounded, so that ties do not depend on the order of summation
    return reduce(DataFrame.unionByName, found).withColumn("value", F.round("value", 12))


def nearest(
    df: DataFrame, key: str, vector: str, *, size: int = 64, k: int = 10, min_cosine: float | None = None, queries=None, dims: int = 8,
    confidence: float = 0.99, wide: float = 0.9, miss: float = 1e-3, cell: int = CELL, seed: int = 1,
) -> DataFrame:
    """(key, other, cosine, rank): for each query row its k most similar other rows by cosine, ties by the smaller key.

    With `min_cosine` only neighbours of at least that cosine count, and one of just
    that cosine is missed with a chance of `miss` at most. Where that would take more than MOST_TABLES
    tables, and without it, one tree is searched: `confidence` holds for a neighbour at
    the k-th distance, `wide` for one at that bound. `queries` is a condition on the rows that ask; without it
    all rows do. Keys are integers; a row given twice counts once. Rows without a proper vector take no part; fewer than
    k others give fewer rows, an empty table none. The splits are fitted on about
    SAMPLE vectors (2 x SAMPLE at most); all vectors are indexed.
    """
    keyed, groups = distinct_vectors(df, key, vector, size, k + 1)
    groups = checkpoint(groups, drop=True)
    asking = keyed if queries is None else keyed.join(df.where(queries).select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    wanted = asking.select("g1", "g2").distinct().withColumn("query", F.lit(True)) if queries is not None else None
    reps = groups.select("rep", "g1", "g2")
    if wanted is not None:
        reps = reps.join(wanted, ["g1", "g2"], "left")
    else:
        reps = reps.withColumn("query", F.lit(True))
    vectors = df.select(F.col(key).alias("rep"), F.col(vector).alias("v"))
    reps = reps.join(vectors, "rep").dropDuplicates(["rep"]).select(F.col("rep").alias("key"), "v", F.coalesce("query", F.lit(False)).alias("query"))

    n = groups.count()
    far = 4.0 if min_cosine is None else 2 - 2 * min_cosine
    rows = n if n <= min(cell, ONE_CELL) else min(cell, TABLE_CELL)
    tables = Tables(n, rows, size, min_cosine, miss, seed) if min_cosine is not None and min_cosine > 0 else None
    if tables is not None and tables.count <= MOST_TABLES:
        pairs = _by_tables(reps, tables, k, far, dims, confidence)
    else:
        pairs = _by_visits(reps, n, size, k, far, dims, confidence, wide, cell, seed)
    if min_cosine is not None:
        pairs = pairs.where(F.col("value") >= min_cosine - 1e-12)

    # Back from representatives to rows: at most k + 1 members of each neighbour matter.
    member = groups.select(F.col("rep").alias("other"), "members")
    others = pairs.join(member, "other").select("key", "value", F.explode("members").alias("other"))
    itself = groups.where(F.size("members") > 1).select(F.col("rep").alias("key"), F.lit(1.0).alias("value"), F.explode("members").alias("other"))
    best = Window.partitionBy("key").orderBy(F.desc("value"), "other")
    listed = (
        others.unionByName(itself).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "other", "value"))).alias("list"))
        .join(groups.select(F.col("rep").alias("key"), "g1", "g2"), "key").drop("key")
    )
    mine = F.slice(F.filter("list", lambda x: x["other"] != F.col("key")), 1, k)
    # a vector that many rows share has many askers
    return (
        join_skewed(asking, listed, ["g1", "g2"]).where("list is not null").select("key", F.posexplode(mine).alias("rank", "x"))
        .select("key", F.col("x.other").alias("other"), F.col("x.value").alias("cosine"), (F.col("rank") + 1).alias("rank"))
    )


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of which at least one is among the other's neighbours."""
    return neighbours.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()
