"""Problem 1: near-duplicate records, by anchor points of a covering code.

The fingerprint of a record is a word of 32-bit symbols: the minima of its word
sequences under pseudo-random orders, so that two records agree in each symbol
with a chance equal to the share of sequences they have in common. Symbols are
taken in blocks of k + 1. The anchors of a block are the code words of the
parity-check code of dimension k over the integers modulo 2^32: the words whose
symbols sum to 0. Its covering radius is 1, and every word lies within that
radius of k + 1 anchors (correct any one symbol by the syndrome). A record is
replicated to all of them; two records whose blocks differ in at most one symbol
always share an anchor. Records that meet are compared per anchor on 16 further
symbols, then on all, and what remains is verified by the exact share of common
sequences.

k is the length of the code: the number of anchors is 2^(32 k), and unrelated
records meet with a chance that falls geometrically with k. k follows from the
number of records and from how often sequences recur in them, and the number of
blocks from k, so that the recall is the same for every k while the comparisons
of a record stay bounded as the table grows.

Exact copies (equal word sequences) are collapsed to one class before that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, connected_components, hash64, join_skewed, mix, shingles, spread, text_key, words

#: Symbols that records which meet are compared on, of 4 bits each in one 64-bit lane, and the least share of wanted pairs that must pass.
LANE, PASS = 16, 0.9
#: The chance that a wanted pair differs in too many of all symbols to be verified.
UNLIKE = 1e-7
#: Most members of an anchor in one task, about; anchors with more are split. They are told by one in WATCHED of the records.
HOT, WATCHED = 20_000, 256
#: A comparison at an anchor costs about this share of a replica.
COMPARISON = 0.01
#: Records from which the recurrence of sequences is estimated, about, and the dimensions that are considered.
SAMPLE, DIMENSIONS = 20_000, (2, 3, 4, 5, 6)
DRAWN = 24  # symbols of each of them
#: Bits of the filter that tells which texts are taken apart again.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def _at_least(hits: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(hits, n + 1))


@dataclass(frozen=True)
class Code:
    """Blocks of k + 1 symbols; records that meet must agree in `agree` of the symbols of the lane."""

    k: int
    blocks: int
    agree: int

    @property
    def length(self) -> int:
        return self.k + 1

    @property
    def symbols(self) -> int:
        return self.blocks * self.length

    @property
    def replicas(self) -> int:
        return self.blocks * self.length

    def least(self, similarity: float) -> int:
        """In how many of all symbols a pair of that similarity agrees, but for a chance of UNLIKE."""
        return max(c for c in range(self.symbols + 1) if _at_least(c, self.symbols, similarity) >= 1 - UNLIKE)


def code_for(k: int, similarity: float, miss: float) -> Code:
    """The code of dimension k that misses a pair of just that similarity with a chance of at most `miss`."""
    same = similarity + (1 - similarity) / 16
    agree = max(c for c in range(LANE + 1) if _at_least(c, LANE, same) >= PASS)
    met = _at_least(k, k + 1, similarity) * _at_least(agree, LANE, same)
    blocks = 1 if met >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - met))
    return Code(k, max(blocks, 1 + -(-LANE // (k + 1)), -(-DRAWN // (k + 1))), agree)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of `count` 32-bit symbols per set of shingles: its minimum under each order; zeros for an empty set."""
    out = np.zeros((len(sets), count), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    i = np.arange(1, count + 1, dtype=np.uint64)
    factor, plus = ((mix(i * np.uint64(c)) >> np.uint64(32)).astype(np.uint32) for c in (0xD6E8FEB86659FD93, 0xA5A3564E27F8862F))
    factor |= np.uint32(1)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 60_000, "right")))
        rows = full[lo:hi]
        # shingles are well-mixed hashes; the multiplication and the shift order them anew for each symbol
        high = (np.concatenate([sets[r] for r in rows]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[rows]) - sizes[rows]
        for k in range(count):
            h = high * factor[k] + plus[k]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x7FEB352D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x846CA68B)
            h ^= h >> np.uint32(16)
            out[rows, k] = np.minimum.reduceat(h, starts)
        lo = hi
    return out


def _texts(pdf: pd.DataFrame, fields: list[str]) -> list[list[str]]:
    joined = pdf[fields[0]].fillna("")
    for f in fields[1:]:
        joined = joined + " " + pdf[f].fillna("")
    return [words(t) for t in joined]


def _sketch(fields: list[str], width: int, count: int):
    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            hashed = [hashes(d) for d in _texts(pdf, fields)]
            symbols = minima([shingles(h, width) for h in hashed], count)
            yield pd.DataFrame(
                {
                    "key": pdf["key"].to_numpy(),
                    # a text without words is no copy of another
                    "class_key": [text_key(h) if len(h) else hash64(f"without words: {k}") - (1 << 63) for h, k in zip(hashed, pdf["key"])],
                    "size": [len(h) for h in hashed],
                    "symbols": list(symbols.view(np.int32)),
                }
            )

    return run


def _anchors(symbols: np.ndarray, code: Code) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor, lane) columns of all replicas: per block, the anchors within the covering radius."""
    nibbles = (symbols * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint64)
    for b in range(code.blocks):
        at = np.arange(b * code.length, (b + 1) * code.length)
        word = symbols[:, at]
        syndrome = word.sum(axis=1, dtype=np.uint32)
        lane = np.zeros(len(symbols), np.uint64)
        for i, place in enumerate((at[-1] + 1 + np.arange(LANE)) % code.symbols):
            lane |= nibbles[:, place] << np.uint64(4 * i)
        for j in range(code.length):
            anchor = np.full(len(symbols), b, np.uint64)
            for i in range(code.length):
                symbol = word[:, i] - syndrome if i == j else word[:, i]
                anchor = mix(anchor ^ (symbol.astype(np.uint64) << np.uint64(16)))
            yield anchor.view(np.int64), lane.view(np.int64)


def _replicate(code: Code):
    """Rows (anchor, class_key, lane): each record at each anchor within the covering radius of its blocks."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            symbols = np.stack(pdf["symbols"].to_numpy()).view(np.uint32)[:, : code.symbols]
            keys = pdf["class_key"].to_numpy()
            for anchor, lane in _anchors(symbols, code):
                yield pd.DataFrame({"anchor": anchor, "class_key": keys, "lane": lane})

    return run


def _agreeing(x: Column, y: Column) -> Column:
    """In how many of the 4-bit symbols two lanes agree."""
    differ = x.bitwiseXOR(y)
    differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2))
    differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(LANE) - F.bit_count(differ)


def _compare(replicas: DataFrame, watched: DataFrame, agree: int) -> DataFrame:
    """(a, b), a < b: records that share an anchor and agree in enough symbols of the lane.

    `watched` holds the replicas of one in WATCHED records; anchors that are crowded
    in it are split: a member stays in one slice on one side and is in all slices of
    its anchor on the other, so that each pair meets in exactly one task.
    """
    crowded = watched.groupBy("anchor").count().where(F.col("count") * WATCHED > HOT)
    crowded = checkpoint(crowded.select("anchor", F.ceil(F.col("count") * WATCHED / HOT).cast("int").alias("ways")))
    left, right = replicas, replicas
    on = ["anchor"]
    if crowded.limit(1).count():
        known = replicas.join(crowded, "anchor", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
        left = known.withColumn("slice", F.pmod(F.xxhash64("class_key"), "ways").cast("int")).drop("ways")
        right = known.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
        on = ["anchor", "slice"]
    x, y = left.alias("x"), right.alias("y")
    met = (F.col("x.class_key") < F.col("y.class_key")) & (_agreeing(F.col("x.lane"), F.col("y.lane")) >= agree)
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return x.join(y, same & met).select(F.col("x.class_key").alias("a"), F.col("y.class_key").alias("b")).distinct()


def recurrence(symbols: np.ndarray, k: int) -> float:
    """The share of pairs of records that agree in k symbols, from the rows of a sample."""
    n, met, tried = len(symbols), 0.0, 0
    for lo in range(0, symbols.shape[1] - k + 1, k):
        _, counts = np.unique(np.ascontiguousarray(symbols[:, lo : lo + k]).view([("", symbols.dtype)] * k), return_counts=True)
        met += float((counts.astype(float) * (counts - 1)).sum())
        tried += 1
    return met / max(1.0, tried * n * (n - 1.0))


def choose_dimension(symbols: np.ndarray, records: int, similarity: float, miss: float) -> int:
    """The k of the least work: replicas, and comparisons that follow from the recurrence in the sample and the number of records."""
    if len(symbols) < 2:
        return DIMENSIONS[0]
    work = {k: code_for(k, similarity, miss).replicas * (1 + COMPARISON * records * recurrence(symbols, k)) for k in DIMENSIONS}
    return min(work, key=work.get)


class KeyFilter:
    """A Bloom filter of the column `key`: tells by the hash of a key whether it may be among them.

    Built by partial aggregates; its size is bounded by MOST_BITS whatever the number
    of keys. Beyond that more others pass, which costs time and no result.
    """

    def __init__(self, keys: DataFrame) -> None:
        at = keys.agg(F.approx_count_distinct("key")).first()[0]
        self.size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * at).bit_length()))
        place = F.explode(F.array(*[self._place(F.xxhash64("key"), i) + 1 for i in (0, 1)]))
        marked = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        parts = np.zeros((self.size >> 15, 1 << 12), np.uint8)
        for r in marked.toLocalIterator():
            parts[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
        self.bits = keys.sparkSession.sparkContext.broadcast(parts.ravel())

    def _place(self, h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, 7 + 25 * i).bitwiseAND(F.lit(self.size - 1))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bits, out = self.bits.value, np.ones(len(h), bool)
        for i in (0, 1):
            place = (h.view(np.uint64) >> np.uint64(7 + 25 * i)) & np.uint64(self.size - 1)
            out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _shingle_rows(fields: list[str], width: int, among: KeyFilter):
    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            pdf = pdf[among(pdf["h"].to_numpy())]
            if not len(pdf):
                continue
            docs = [hashes(d) for d in _texts(pdf, fields)]
            rows = [shingles(h, width).view(np.int64) for h in docs]
            yield pd.DataFrame({"class_key": [text_key(h) for h in docs], "shingles": rows})

    return run


def near_duplicates(
    df: DataFrame, key: str, fields: list[str], *, width: int = 5, similarity: float = 0.8, miss: float = 1e-4, dimension: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of records whose word sequences of `width` words agree in a share of at least `similarity`.

    classes: (key, class_key, size), each distinct key and text once; records with
    equal words share a class. links: (a, b, similarity) between two classes, a < b,
    once each. Null fields count as empty; a record whose key is null takes no part.
    Records with fewer than `width` words have no sequences and link to nothing, but
    equal ones share a class; a record without words has a class of its own. Extra
    columns are ignored, an empty table gives two empty ones.

    `miss` bounds the chance that a pair of just that similarity is not compared;
    it falls quickly above. `dimension` is the code's k; by default it follows from
    the number of records and a sample of about SAMPLE of them, which decides
    nothing else.
    """
    src = df.select(F.col(key).alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).where("key is not null")
    names = [f"f{i}" for i in range(len(fields))]
    schema = f"key {src.schema['key'].dataType.simpleString()}, class_key long, size int, symbols array<int>"
    sketch = lambda rows, count: rows.mapInPandas(_sketch(names, width, count), schema)
    if dimension is None:
        records = src.count()
        drawn = src.where(F.xxhash64("key", F.lit(1)) / F.lit(2.0**64) + 0.5 < SAMPLE / max(1, records))
        rows = sketch(spread(drawn), DRAWN).where(F.col("size") >= width).select("class_key", "symbols").limit(2 * SAMPLE).distinct().collect()
        symbols = np.array([r["symbols"] for r in rows], dtype=np.int32).reshape(len(rows), DRAWN)
        dimension = choose_dimension(symbols, records, similarity, miss)
    code = code_for(dimension, similarity, miss)
    sketched = checkpoint(sketch(spread(src), code.symbols))

    classes = sketched.select("key", "class_key", "size").distinct()
    long_enough = sketched.where(F.col("size") >= width).select("class_key", "symbols")
    one = long_enough.groupBy("class_key").agg(F.first("symbols").alias("symbols"))
    watched = long_enough.where(F.pmod(F.xxhash64("class_key"), F.lit(WATCHED)) == 0).dropDuplicates(["class_key"])
    replicate = lambda rows: rows.mapInPandas(_replicate(code), "anchor long, class_key long, lane long")
    met = _compare(replicate(one), replicate(watched), code.agree)
    # those that met are compared on all symbols before their texts are taken apart
    a, b = (one.select(F.col("class_key").alias(x), F.col("symbols").alias(f"s{x}")) for x in "ab")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    candidates = checkpoint(met.join(a, "a").join(b, "b").where(same >= code.least(similarity)).select("a", "b"))

    ids = candidates.select(F.col("a").alias("class_key")).union(candidates.select(F.col("b").alias("class_key"))).distinct()
    # One key stands for each class; only those texts are taken apart again, and no text is shuffled.
    wanted = sketched.groupBy("class_key").agg(F.min("key").alias("key")).join(ids, "class_key", "left_semi").select("key")
    rows = checkpoint(
        src.withColumn("h", F.xxhash64("key")).mapInPandas(_shingle_rows(names, width, KeyFilter(wanted)), "class_key long, shingles array<long>")
        .join(ids, "class_key", "left_semi")
        .groupBy("class_key").agg(F.first("shingles").alias("shingles"))
    )
    left = rows.select(F.col("class_key").alias("a"), F.col("shingles").alias("sa"))
    right = rows.select(F.col("class_key").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("double")
    links = (
        candidates.join(left, "a").join(right, "b")
        .select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), common.alias("c"))
        .select("a", "b", (F.col("c") / (F.col("n") - F.col("c"))).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
    return classes, links


def near_duplicate_pairs(classes: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of different keys in linked classes or in one class of at least `width` words."""
    classes = classes.where(F.col("size") >= width)
    links = checkpoint(links)
    member = classes.select("key", "class_key")
    across = (
        links.select("a", "b")
        .join(member.select(F.col("key").alias("x"), F.col("class_key").alias("a")), "a")
        .join(member.select(F.col("key").alias("y"), F.col("class_key").alias("b")), "b")
    )
    shared = classes.groupBy("class_key").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("class_key")
    many = classes.join(shared, "class_key", "left_semi")
    within = many.select("class_key", F.col("key").alias("x")).join(many.select("class_key", F.col("key").alias("y")), "class_key").where("x < y")
    return (
        across.select("x", "y").union(within.select("x", "y")).where("x <> y")
        .select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
    )


def near_duplicate_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, work, n_links): one row per key with the smallest key of its work and the number of links of its texts.

    A work is all that links, equal texts and keys given with several texts connect.
    Copies are not paired with each other: they share their class.
    """
    links, classes = checkpoint(links.select("a", "b")), checkpoint(classes)
    several = classes.groupBy("key").agg(F.min("class_key").alias("b"), F.max("class_key").alias("a")).where("a <> b")
    same_key = classes.join(several.select("key", "b"), "key").where("class_key <> b").select(F.col("class_key").alias("a"), "b")
    components = connected_components(links.unionByName(same_key)).select(F.col("node").alias("class_key"), "component")
    ends = links.select(F.col("a").alias("class_key")).union(links.select(F.col("b").alias("class_key")))
    degree = ends.groupBy("class_key").agg(F.count("*").alias("n_links"))
    first = classes.groupBy("class_key").agg(F.min("key").alias("first")).join(components, "class_key", "left").join(degree, "class_key", "left")
    first = checkpoint(first.select("class_key", "first", F.coalesce("component", "class_key").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    works = first.groupBy("component").agg(F.min("first").alias("work"))
    named = join_skewed(first, works, "component").select("class_key", "work", "n_links")
    return join_skewed(classes, named, "class_key").groupBy("key").agg(F.min("work").alias("work"), F.sum("n_links").alias("n_links"))
