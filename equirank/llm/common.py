"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A plain scan of fewer partitions than there are cores, split by the keys for the Python or explode work behind it.

    Scans that are large enough and frames that are already shuffled stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, lower-cased."""
    return WORD.findall(text.lower()) if text else []


def hash64(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 200_000) -> None:
        self.bound, self.seen = bound, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self.seen) > self.bound:
            self.seen.clear()
        seen, out = self.seen, []
        for t in tokens:
            h = seen.get(t)
            if h is None:
                h = seen[t] = hash64(t)
            out.append(h)
        return np.array(out, dtype=np.uint64)


#: Odd multipliers that tell the positions of a shingle apart.
_POSITION = np.array(
    [(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(16)],
    dtype=np.uint64,
)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `width` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    mixed = mix(hashes)
    total = mixed[:n] * _POSITION[0]
    for i in range(1, width):
        total += mixed[i : i + n] * _POSITION[i]
    total = np.sort(mix(total))
    return total[np.r_[True, total[1:] != total[:-1]]]


def text_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a word sequence; equal for equal sequences."""
    return int(np.int64(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared checkpoint folder; make a folder only in local tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="equirank-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def checkpoint(df: DataFrame, drop: bool = False) -> DataFrame:
    """Cut the lineage into the shared folder; survives the loss of executors. With `drop` the shuffles of `df`, which then must not be used again, leave the disk at once."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if drop:
        plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc().cleaner()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and cleaner.isDefined():  # else they go when the driver collects its garbage
            for shuffle in list(plan.context().shuffleIds().keySet()):
                cleaner.get().doCleanupShuffle(int(shuffle), True)
    return kept


def join_skewed(rows: DataFrame, unique: DataFrame, keys: str | list[str], hot: int = 1_000_000) -> DataFrame:
    """rows left join unique, which holds each key once; keys with more than `hot` rows are salted and met in several tasks.

    At most (number of rows) / `hot` keys come to the driver.
    """
    keys = [keys] if isinstance(keys, str) else keys
    crowded = rows.groupBy(*keys).count().where(F.col("count") > hot).collect()
    if not crowded:
        return rows.join(unique, keys, "left")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    ways = rows.sparkSession.createDataFrame([(*(r[k] for k in keys), -(-r["count"] // hot)) for r in crowded], f"{schema}, _ways int")
    n, rest = F.coalesce("_ways", F.lit(1)), [c for c in rows.columns if c not in keys]
    salt = F.xxhash64(*rest) if rest else F.monotonically_increasing_id()
    left = rows.join(F.broadcast(ways), keys, "left").withColumn("_salt", F.pmod(salt, n).cast("int")).drop("_ways")
    right = unique.join(F.broadcast(ways), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_ways")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def partition_slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an integer that hash-partitioning by an integer column puts there, so that n groups get one partition each."""
    found: dict[int, int] = {}
    lo, step = 0, 16 * n + 64
    while len(found) < n:
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")
        rows = spark.range(lo, lo + step, 1, 1).groupBy(at).agg(F.min("id").alias("slot")).collect()
        found = {r["at"]: r["slot"] for r in rows} | found
        lo += step
    return [found[i] for i in range(n)]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node of each connected component.

    Alternating large-star and small-star steps, each one shuffle on the node
    with map-side combining; no component is ever gathered in one task.
    Raises if `rounds` steps leave the labels unsettled, never returns part of a result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    links = checkpoint(links)
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        small = checkpoint(small)
        changed = small.exceptAll(links).limit(1).count() + links.exceptAll(small).limit(1).count()
        links = small
        if not changed:
            break
    else:
        raise RuntimeError(f"components unsettled after {rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    leaves = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.unionByName(roots.join(leaves.select("node"), "node", "left_anti"))
