"""Problem 7: evaluation passages inside documents, by size-partitioned MinHash containment search.

Sets of shingles fall into partitions by size (powers of two up to SEGMENT);
a longer document is cut into sets of SEGMENT. If sets of at most u shingles
share h shingles with a passage of q, each minimum agrees with a chance of at
least h / (u + q), and over all sets of a document those chances add up: with
h = t q in all, K functions miss the passage with a chance of at most
exp(-K t q / (u + q)). K follows from that for each partition. Passages whose
minima match are verified by their exact shingle containment in the document.

Passages fall into partitions by size too: K depends on a partition of documents
and one of passages, never on a short passage elsewhere. Passages so short that
they would need more than MOST_FUNCTIONS are found by a lookup of each of their
shingles, with the same exact verification.

Passages are the query side: they are taken in blocks of bounded size (minima and
shingles together), each block goes to all tasks, and the documents are read once
per block and never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, shingles, spread, words

#: Minima and shingles of passages that a task holds at once; a passage with more is a block of its own.
BLOCK_ENTRIES = 4_000_000
#: Most MinHash functions; passages that would need more are looked up by their shingles.
MOST_FUNCTIONS = 640
#: Shingles of the largest partition; the work on a document grows with its length, not with the square of it.
SEGMENT = 512


def functions_needed(upper: int, shortest: int, share: float, miss: float) -> int:
    """MinHash functions for sets of at most `upper` shingles and passages of at least `shortest`."""
    hits = max(1, math.ceil(share * shortest))
    return math.ceil(-math.log(miss) * (upper + shortest) / hits)


def _minima(parts: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash sketches, one row per set: the minimum of each of `count` multiply-and-add functions on the high 32 bits of its shingles.

    The shingles are well-mixed hashes, so that odd factors order them as good as at random.
    """
    i = np.arange(1, count + 1, dtype=np.uint64)
    factor = (mix(i) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    plus = (mix(i * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(parts), count), dtype=np.uint32)
    room = np.empty((max(map(len, parts), default=0), 128), dtype=np.uint32)
    for k, s in enumerate(parts):
        high = (s >> np.uint64(32)).astype(np.uint32)[:, None]
        for lo in range(0, count, 128):
            f, p = factor[lo : lo + 128], plus[lo : lo + 128]
            h = np.multiply(high, f[None, :], out=room[: len(s), : len(f)])
            h += p
            out[k, lo : lo + 128] = h.min(axis=0)
    return out


class _Index:
    """Sorted 64-bit keys with their owners, behind a table of bits that tells most absent keys at once."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.shift = np.uint64(64 - max(16, (8 * len(keys)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[self._slot(keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def hits(self, probe: np.ndarray):
        """(position in `probe`, owners) of each key that is there."""
        maybe = np.flatnonzero(self.seen[self._slot(probe)])
        left, right = np.searchsorted(self.keys, probe[maybe], "left"), np.searchsorted(self.keys, probe[maybe], "right")
        for i in np.flatnonzero(right > left):
            yield maybe[i], self.owners[left[i] : right[i]]


def size_level(n: int) -> int:
    """The partition of sets of n shingles: n lies above 2^(level - 1) and up to 2^level."""
    return (n - 1).bit_length()


def entries_of(n: int, share: float, miss: float) -> int:
    """Minima and shingles that a passage of n shingles takes up at most."""
    need = functions_needed(SEGMENT, n, share, miss)
    return n + (need if need <= MOST_FUNCTIONS else 0)


def _search(items: list[tuple[int, np.ndarray]], width: int, share: float, miss: float):
    ids, sets = np.array([i for i, _ in items]), [s for _, s in items]
    lengths = np.array([len(s) for s in sets])
    groups: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        groups.setdefault(size_level(int(n)), []).append(i)
    shortest = {g: int(lengths[rows].min()) for g, rows in groups.items()}
    looked_up = [i for g, rows in groups.items() if functions_needed(SEGMENT, shortest[g], share, miss) > MOST_FUNCTIONS for i in rows]
    sketched = {g: np.array(rows) for g, rows in groups.items() if rows[0] not in set(looked_up)}

    def run(batches):
        hashes = WordHashes()
        owner = np.repeat(np.arange(len(sets)), lengths)
        whole = _Index(np.concatenate(sets), owner)
        short = _Index(np.concatenate([sets[i] for i in looked_up]), np.repeat(looked_up, lengths[looked_up])) if looked_up else None
        known: dict[tuple[int, int], _Index] = {}

        def index(group: int, count: int) -> _Index:
            if (group, count) not in known:
                rows = sketched[group]
                key = (np.arange(count, dtype=np.uint64)[None, :] << np.uint64(32)) | _minima([sets[i] for i in rows], count)
                known[group, count] = _Index(key.ravel(), np.repeat(rows, count))
            return known[group, count]

        for pdf in batches:
            docs, found = pdf["doc_id"].to_numpy(), []
            held = [shingles(hashes(words(t)), width) for t in pdf["text"]]
            parts = [(d, s[a : a + SEGMENT]) for d, s in enumerate(held) for a in range(0, len(s), SEGMENT)]
            level = np.array([size_level(len(s)) for _, s in parts], dtype=int)
            matched: dict[int, set[int]] = {}
            for n in np.unique(level) if sketched else ():
                counts = {g: functions_needed(1 << int(n), shortest[g], share, miss) for g in sketched}
                most = max(counts.values())
                rows = np.flatnonzero(level == n)
                step = max(1, 1_000_000 // most)
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    probe = (np.arange(most, dtype=np.uint64)[None, :] << np.uint64(32)) | _minima([parts[r][1] for r in part], most)
                    for g, count in counts.items():
                        for at, who in index(g, count).hits(probe[:, :count].ravel()):
                            matched.setdefault(parts[part[at // count]][0], set()).update(who.tolist())
            if short and parts:
                ends = np.cumsum([len(s) for s in held])
                for at, who in short.hits(np.concatenate(held)):
                    matched.setdefault(int(np.searchsorted(ends, at, "right")), set()).update(who.tolist())
            for d, candidates in matched.items():
                # exact containment: the document's shingles among those of the candidates
                hit = [who for _, who in whole.hits(held[d])]
                if hit:
                    common = np.bincount(np.concatenate(hit), minlength=len(sets))
                    found += [(docs[d], ids[i], int(common[i]), int(lengths[i])) for i in sorted(candidates) if common[i] >= share * lengths[i] - 1e-9]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "common", "size"]).astype(
                {"doc_id": "int64", "item_id": "int64", "common": "int64", "size": "int64"}
            )

    return run


def leaked_items(docs: DataFrame, items: DataFrame, *, width: int = 5, share: float = 0.4, miss: float = 1e-6) -> DataFrame:
    """(doc_id, item_id, containment): documents that hold at least `share` of the distinct word runs of an item's passage.

    Null or empty texts hold nothing; passages with fewer than `width` words, null
    ones too, have no runs and leak nowhere. Extra columns are ignored; an empty
    table on either side gives an empty result.
    """
    passages = items.where("passage is not null and item_id is not null").select("item_id", "passage")
    spark = docs.sparkSession
    out = None
    hashes = WordHashes()
    block, total = [], 0

    def search(block):
        rows = spread(docs.where("text is not null").select("doc_id", "text"), "doc_id").mapInPandas(
            _search(block, width, share, miss), "doc_id long, item_id long, common long, size long"
        )
        return rows if out is None else out.union(rows)

    for r in passages.toLocalIterator():  # the test set, a block at a time
        h = hashes(words(r["passage"]))
        s = shingles(h, width)
        if not len(s):
            continue
        more = entries_of(len(s), share, miss)
        if block and total + more > BLOCK_ENTRIES:
            out, block, total = search(block), [], 0
        block.append((r["item_id"], s))
        total += more
    if block:
        out = search(block)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, common long, size long")
    return out.select("doc_id", F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), (F.col("common") / F.col("size")).alias("containment")).distinct()
