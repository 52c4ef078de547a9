"""Problem 2: a sample that follows target proportions over cells, by divisor-method priorities.

Within a cell records have a random order (a seeded digest of the key). The record
of rank r in a cell of target t has the priority (r - 0.5) / t; each cell's
minimum goes first, then the globally smallest priorities are kept. A cell that
runs out of records simply has no further priorities, so its seats pass on to
the others. Because the k-th priority of a cell depends on k and t alone, the
cut-off is found from the highest rank of each cell (as many numbers as there are
cells); records are ranked in blocks, never a cell in one task. The report is
made of the ranks and of the sample as drawn.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

FIRST_CODE = r"[^\s,;]+"
#: Records of one cell that are ranked in one task, about.
RANK_BLOCK = 50_000
#: Most target cells, whose numbers come to the driver; more are refused.
MAX_CELLS = 100_000


def latest_papers(df: DataFrame) -> DataFrame:
    """(paper_id, code, label, year): one row per paper, from its row with the highest vec_id.

    code is the first category code in lower case, label is trimmed and in lower
    case; both are null where there is none. A null paper_id names no paper and is
    left out. Of equal vec_ids the largest remaining fields decide.
    """
    row = F.struct("vec_id", "category", "institution_label", "year")
    # max over a struct with map-side combining: a paper with many rows is no hot group
    newest = df.where("paper_id is not null").groupBy("paper_id").agg(F.max(row).alias("r"))
    code = F.lower(F.regexp_extract("r.category", FIRST_CODE, 0))
    label = F.lower(F.regexp_replace("r.institution_label", r"(?U)^\s+|\s+$", ""))
    return newest.select(
        "paper_id",
        F.when(code != "", code).alias("code"),
        F.when(label != "", label).alias("label"),
        F.col("r.year").alias("year"),
    )


def in_cells(papers: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """All papers with the cell they lie in: (paper_id, cell_id), cell_id null for none.

    The targets are matched by (code, label) and the year range; their table is a
    parameter of the job, so it is left to the planner to broadcast it by its size.
    A paper within several overlapping cells counts for one of them, by a seeded hash.
    """
    cells = targets.select(
        "cell_id",
        F.lower(F.trim("category")).alias("code"),
        F.lower(F.trim("institution_label")).alias("label"),
        "year_from",
        "year_to",
    )
    within = F.when(F.expr("year between year_from and year_to"), F.struct(F.xxhash64("paper_id", "cell_id", F.lit(seed)), "cell_id"))
    return papers.join(cells, ["code", "label"], "left").groupBy("paper_id").agg(F.min(within)["cell_id"].alias("cell_id"))


def divide_seats(cells: list[dict], seats: int) -> dict[int, int]:
    """Seats of each cell: its floor (as far as it has records), then the smallest priorities (k - 0.5) / target.

    cells: dicts with cell_id, available, target, floor. Cells of target 0 get their floor only. Ties go to the smaller cell_id.
    """
    got = {c["cell_id"]: min(c["floor"], c["available"]) for c in cells}

    def at(cut: float) -> dict[int, int]:
        return {
            c["cell_id"]: min(c["available"], max(got[c["cell_id"]], math.floor(cut * c["target"] + 0.5))) for c in cells
        }

    open_cells = [c for c in cells if c["target"] > 0]
    if not open_cells or sum(got.values()) >= seats:
        return got
    low, high = 0.0, max((c["available"] + 1) / c["target"] for c in open_cells)
    if sum(at(high).values()) <= seats:
        return at(high)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if sum(at(middle).values()) <= seats else (low, middle)
    out = at(low)
    # exact comparisons settle what rounding leaves open: first the seats that are left, then taken and open ones out of order
    target, open_seats = {c["cell_id"]: c["target"] for c in open_cells}, {c["cell_id"]: c["available"] for c in open_cells}
    after = lambda c: (Fraction(2 * out[c] + 1, 2 * target[c]), c)
    last = lambda c: (Fraction(2 * out[c] - 1, 2 * target[c]), c)
    left = seats - sum(out.values())
    while True:
        more = min((after(c) for c in target if out[c] < open_seats[c]), default=None)
        less = max((last(c) for c in target if out[c] > got[c]), default=None)
        if left > 0 and more:
            out[more[1]] += 1
            left -= 1
        elif more and less and more < less:
            out[more[1]] += 1
            out[less[1]] -= 1
        else:
            return out


def ranked(papers: DataFrame, targets: DataFrame, one_in: int, seed: int) -> tuple[DataFrame, list[dict]]:
    """((paper_id, cell_id, rank) of all papers in cells, the cells with available, needed and seats).

    S = floor(papers / one_in); needed is the larger of min_rows and target_bp x S / 10,000 rounded up.
    """
    cells = [r.asDict() for r in targets.select("cell_id", "target_bp", "min_rows").limit(MAX_CELLS + 1).collect()]
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    held = checkpoint(in_cells(papers, targets, seed))
    n = held.count()
    size, blocks = n // one_in, max(1, n // RANK_BLOCK)
    placed = held.where("cell_id is not null").withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.col("paper_id").cast("string"))))
    placed = placed.withColumn("block", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32 * blocks).cast("int"))
    counts = placed.groupBy("cell_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cell_id", "block").orderBy("order", "paper_id")
    ranks = checkpoint(placed.join(starts, ["cell_id", "block"]).select("paper_id", "cell_id", (F.row_number().over(inside) + F.col("start")).alias("rank")))
    last = {r["cell_id"]: r["n"] for r in ranks.groupBy("cell_id").agg(F.max("rank").alias("n")).collect()}
    for c in cells:
        target, floor = c["target_bp"] or 0, c["min_rows"] or 0
        c |= {"available": last.get(c["cell_id"], 0), "target": target, "floor": floor, "needed": max(floor, -(-target * size // 10_000)), "asked": size}
    seats = divide_seats(cells, size)
    return ranks, [c | {"seats": seats[c["cell_id"]]} for c in cells]


def _drawn(ranks: DataFrame, cells: list[dict]) -> DataFrame:
    known = ranks.sparkSession.createDataFrame([(c["cell_id"], c["seats"], c["target"]) for c in cells], f"cell_id {ranks.schema['cell_id'].dataType.simpleString()}, seats long, target long")
    kept = ranks.join(F.broadcast(known), "cell_id").where("rank <= seats")  # one row per target cell, checked above
    return kept.select("paper_id", "cell_id", "rank", F.try_divide(F.col("rank") - 0.5, F.col("target")).alias("priority"))


def quota_sample(papers: DataFrame, targets: DataFrame, one_in: int = 5, seed: int = 0) -> DataFrame:
    """(paper_id, cell_id, rank, priority): the sample of floor(papers / one_in) papers, as far as the cells have them.

    A null target or minimum counts as 0, and a cell of target 0 gets its minimum
    only. Minima come before all else: where they alone exceed the size asked for,
    the sample is just the minima, and larger (see quota_report). Without papers or
    targets the sample is empty.
    """
    return _drawn(*ranked(papers, targets, one_in, seed))


def quota_report(papers: DataFrame, targets: DataFrame, one_in: int = 5, seed: int = 0) -> DataFrame:
    """(cell_id, available, needed, seats, missing, asked) of each cell, from the ranks and the sample of quota_sample.

    available is the highest rank of the cell, seats the papers drawn from it,
    missing what it lacks to reach needed without repeats (0 where it is reached),
    asked the size S of the sample: seats that sum to more come from minima, to less
    from cells that are exhausted. With no papers S is 0 and only minima are needed;
    with no targets the report is empty.
    """
    ranks, cells = ranked(papers, targets, one_in, seed)
    drawn = {r["cell_id"]: r["count"] for r in _drawn(ranks, cells).groupBy("cell_id").count().collect()}
    rows = [(c["cell_id"], c["available"], c["needed"], drawn.get(c["cell_id"], 0), max(0, c["needed"] - c["available"]), c["asked"]) for c in cells]
    kind = targets.schema["cell_id"].dataType.simpleString()
    return papers.sparkSession.createDataFrame(rows, f"cell_id {kind}, available long, needed long, seats long, missing long, asked long")
