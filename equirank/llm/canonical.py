"""Problem 3: free-entered values mapped to a canonical list.

The entries and their alias paths (names in other order, local names, acronyms,
accents spelled out, abbreviated words) form a trie of words; each edge of it is
found by a trie of characters that a Levenshtein automaton walks (bit-parallel,
with transpositions, depth-first under a bound that grows with the word's
length). A value matches the entries whose path covers a whole segment of it,
within a bound on the total distance that grows with the path's length; what is
left over must not belong to the same segment. All such entries are returned, the
nearest first. Values with lost blanks are searched in a trie of the characters of
whole paths.

Both tries are sorted arrays, whose nodes are ranges: they take little more room
than the paths, and are built once per worker process. The reference list is a
parameter of the job: it goes to every task behind a check of its size. Every task
keeps the results of values it has seen, so hot values cost one search and nothing
is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .lookalike import unify

#: Most entries that are sent to the tasks; beyond it the list is refused, never cut.
MAX_ENTRIES = 200_000
SEEN = 200_000

#: Abbreviated words (fixed values).
ABBREVIATIONS = {
    "univ": "university", "uni": "university", "unv": "university", "inst": "institute", "tech": "technology", "technol": "technology",
    "coll": "college", "engrg": "engineering", "eng": "engineering", "engr": "engineering", "engng": "engineering", "sci": "science",
    "sc": "science", "acad": "academy", "lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories", "res": "research",
    "natl": "national", "dept": "department", "grp": "group",
}
#: Words around a name that say nothing about it (fixed values).
NOISE = ("the", "at", "visiting", "scholar", "formerly", "retired", "emeritus", "former", "now", "with", "group")
#: Words around a label that say nothing about it (fixed values).
LABEL_NOISE = ("group", "grp", "the")


@dataclass(frozen=True)
class Spelling:
    """What is known of how names are written: a parameter of the job, by default for institutions in English.

    A run of letters without blanks is taken apart if it holds the beginning of a
    word that stands in at least `common` of all alias paths.
    """

    abbreviations: dict[str, str] = field(default_factory=lambda: dict(ABBREVIATIONS))
    noise: tuple[str, ...] = NOISE
    label_noise: tuple[str, ...] = LABEL_NOISE
    common: float = 0.01


_LETTER = re.compile(r"[a-z0-9]+")
_SEGMENT = re.compile(r"[,;()\[\]|/\n\t]+| - | – ")
_SPELLED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ı": "i"})
_PLAIN = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.casefold().translate(_PLAIN) if not text.isascii() else text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def spelled(text: str) -> str:
    """Lower case with umlauts and the like spelled out."""
    return fold(unicodedata.normalize("NFC", text).casefold().translate(_SPELLED))


def bound_word(n: int) -> int:
    """Distance allowed for one word of n letters."""
    return 0 if n <= 3 else 1 if n <= 5 else 2


def bound_path(n: int) -> int:
    """Distance allowed for a whole path of n letters."""
    return 0 if n < 6 else 1 if n < 10 else 2 if n < 18 else 3


class Trie:
    """Sorted distinct sequences with the entries they stand for; a node is a range of them that share a beginning."""

    def __init__(self, held: dict) -> None:
        self.keys = sorted(held)
        self.values = [tuple(sorted(held[k])) for k in self.keys]
        self.longest = max(map(len, self.keys), default=0)
        self.first: dict = {}
        for i, k in enumerate(self.keys):
            if k:
                lo, _ = self.first.get(k[0], (i, i))
                self.first[k[0]] = (lo, i + 1)

    def child(self, lo: int, hi: int, depth: int, word: str) -> tuple[int, int]:
        """The range below a node of a trie of words."""
        if depth == 0:
            return self.first.get(word, (0, 0))
        prefix = self.keys[lo][:depth]
        start = bisect_left(self.keys, (*prefix, word), lo, hi)
        return start, bisect_left(self.keys, (*prefix, word + "\0"), start, hi)

    def get(self, key) -> tuple:
        at = bisect_left(self.keys, key)
        return self.values[at] if at < len(self.keys) and self.keys[at] == key else ()

    def search(self, text: str, bound: int) -> list[tuple[int, object]]:
        """All (distance, value) of strings within the bound.

        The automaton's state is a tuple of bit masks, one per number of edits: bit i
        says that i characters of the text are read. An empty state ends a branch.
        """
        n, keys = len(text), self.keys
        if n > self.longest + bound:
            return []
        where: dict[str, int] = {}
        for i, c in enumerate(text):
            where[c] = where.get(c, 0) | 1 << i
        full, last = (1 << (n + 1)) - 1, 1 << n
        start = tuple((1 << (e + 1)) - 1 & full for e in range(bound + 1))
        found: dict = {}
        # (range, depth, state, state before, character before)
        stack = [(0, len(keys), 0, start, (0,) * (bound + 1), "")]
        while stack:
            lo, hi, depth, state, before, prior = stack.pop()
            if lo < hi and len(keys[lo]) == depth:
                for e, mask in enumerate(state):
                    if mask & last:
                        for v in self.values[lo]:
                            if e < found.get(v, bound + 1):
                                found[v] = e
                        break
                lo += 1
            while lo < hi:
                c = keys[lo][depth]
                end = hi if keys[hi - 1][depth] == c else bisect_left(keys, keys[lo][:depth] + chr(ord(c) + 1), lo + 1, hi)
                m = where.get(c, 0)
                new = [(state[0] & m) << 1]
                for e in range(1, bound + 1):
                    up = state[e - 1]
                    x = (state[e] & m) << 1 | up | up << 1 | new[e - 1] << 1
                    if prior:  # two neighbours swapped: read text[i] = c and text[i + 1] = prior in one edit
                        x |= ((before[e - 1] & m) << 1 & where.get(prior, 0)) << 1
                    new.append(x & full)
                if any(new):
                    stack.append((lo, end, depth + 1, tuple(new), state, c))
                lo = end
        return sorted(((d, v) for v, d in found.items()), key=lambda x: (x[0], str(x[1])))


#: (ref_id or -1, distance, whether other entries are as near, all entries within the distance).
Match = tuple[int, int, bool, list[int]]
NOTHING: Match = (-1, 0, False, [])


def ranked(hits: list[tuple[int, int, int]]) -> Match:
    """The match of (distance, length of the path, ref_id): the nearest, then the longest path, then the smallest ref_id."""
    if not hits:
        return NOTHING
    order = sorted((d, -n, r) for d, n, r in hits)
    refs = list(dict.fromkeys(r for _, _, r in order))
    tied = len({r for d, n, r in order if (d, n) == order[0][:2]}) > 1
    return order[0][2], order[0][0], tied, refs


class Index:
    """The trie of entries with alias paths."""

    def __init__(self, entries: list[dict], spelling: Spelling = Spelling()) -> None:
        self.spelling = spelling
        paths: dict[tuple[str, ...], set[int]] = {}
        self.acronyms: dict[str, set[int]] = {}
        for e in entries:
            for form in (fold, spelled):
                self._aliases(e, form, paths)
        glued: dict[str, set[int]] = {}
        holding = Counter()  # in how many paths a word stands
        for path, refs in paths.items():
            holding.update(set(path))
            glued.setdefault("".join(path), set()).update(refs)
        self.paths, self.glued = Trie(paths), Trie(glued)
        self.vocabulary = set(holding)
        self.edges = Trie({w: (w,) for w in holding})
        self.stems = {w[:5] for w, n in holding.items() if n >= spelling.common * len(paths) and len(w) >= 5}
        self.word = lru_cache(maxsize=100_000)(lambda w: self.edges.search(w, bound_word(len(w))))

    def words_of(self, text: str) -> list[str]:
        short = self.spelling.abbreviations
        return [short.get(w, w) for w in _LETTER.findall(text)]

    def _aliases(self, e: dict, form, paths: dict) -> None:
        def add(path: list[str]) -> None:
            if path:
                paths.setdefault(tuple(path), set()).add(e["ref_id"])

        name, city = self.words_of(form(e["canonical_name"])), _LETTER.findall(form(e["city"] or ""))
        add(name)
        add(self.words_of(form(e["local_name"] or "")))
        if e["acronym"]:
            self.acronyms.setdefault(form(e["acronym"]), set()).add(e["ref_id"])
        n = len(city)
        at = next((i for i in range(len(name) - n + 1) if name[i : i + n] == city), None) if n else None
        if at is not None:
            rest = name[:at] + name[at + n :]
            bare = rest[:-1] if rest and rest[-1] == "of" else rest
            for path in (rest + city, city + rest, bare + city, city + bare, bare + ["of"] + city):
                add(path)

    def match(self, value: str) -> Match:
        """The entries that the value names; ref_id is -1 where it names none."""
        text = re.sub(r"<[^<>]*>|[^\s@]{1,64}@\S+", " ", unify(value))
        segments, noise = [], self.spelling.noise
        for s in _SEGMENT.split(re.sub(r"[_]+", " ", fold(text))):
            tokens = self.words_of(s)
            while tokens and (tokens[0] in noise or tokens[0].isdigit()):
                tokens.pop(0)
            while tokens and (tokens[-1] in noise or tokens[-1].isdigit()):
                tokens.pop()
            if tokens:
                segments.append(tokens)
        hits = []
        for i in range(len(segments)):
            run: list[str] = []
            for more in segments[i:]:  # as long as the trie has paths of that length
                run = run + more
                if len(run) > self.paths.longest:
                    break
                hits += [(d, len(run), r) for d, refs in self.paths_near(run) for r in refs]
        if not hits:
            hits = [(0, 1, r) for s in segments if len(s) == 1 for r in self.acronyms.get(s[0], ())]
        return ranked(hits or self.without_blanks(segments))

    def paths_near(self, run: list[str]) -> list[tuple[int, tuple[int, ...]]]:
        """(distance, entries) of the paths within the bound of a run of words."""
        bound = bound_path(sum(map(len, run)))
        trie = self.paths
        out, stack = [], [(0, 0, 0, len(trie.keys))]
        while stack:
            at, spent, lo, hi = stack.pop()
            if at == len(run):
                if len(trie.keys[lo]) == at:
                    out.append((spent, trie.values[lo]))
                continue
            for d, w in self.word(run[at]):
                if spent + d <= bound:
                    below = trie.child(lo, hi, at, w)
                    if below[0] < below[1]:
                        stack.append((at + 1, spent + d, *below))
        return out

    def without_blanks(self, segments: list[list[str]]) -> list[tuple[int, int, int]]:
        hits = []
        for i in range(len(segments)):
            run: list[str] = []
            for more in segments[i:]:
                run = run + more
                text = "".join(run)
                if len(text) > self.glued.longest + 3:
                    break
                # blanks are lost or misplaced: a very long word, or more than one very short one
                odd = any(len(w) > 14 and any(s in w for s in self.stems) for w in run)
                split = sum(w not in self.vocabulary and len(w) <= 4 for w in run) > 0 and len(run) > 1
                bound = bound_path(len(text)) if odd or split else 0
                if bound:
                    hits += [(d, len(text), r) for d, r in self.glued.search(text, bound)]
                else:
                    hits += [(0, len(text), r) for r in self.glued.get(text)]
        return hits


class Labels:
    """A short list of single words: trie search with alias paths for their beginnings."""

    def __init__(self, entries: list[dict], spelling: Spelling = Spelling()) -> None:
        self.noise, names = spelling.label_noise, {}
        for e in entries:
            names.setdefault(re.sub(r"[^a-z]", "", fold(e["canonical_name"])), set()).add(e["ref_id"])
        self.trie = Trie(names)
        self.begins: dict[str, set[int]] = {}
        for name, refs in names.items():
            for k in range(3, len(name)):
                self.begins.setdefault(name[:k], set()).update(refs)

    def match(self, value: str) -> Match:
        words = [w for w in _LETTER.findall(fold(unify(value))) if w not in self.noise]
        text = "".join(words)
        if not text or text.isdigit():
            return NOTHING
        found = self.trie.search(text, 0 if len(text) < 5 else 1 if len(text) < 7 else 2)
        if found:
            return ranked([(d, 0, r) for d, r in found])
        refs = self.begins.get(text, ())
        return ranked([(0, 0, r) for r in refs]) if len(refs) == 1 else NOTHING


def load_entries(canonical: DataFrame, kind: str) -> list[dict]:
    """The entries of a kind on the driver, behind a check of their number."""
    rows = canonical.where((F.col("kind") == kind) & F.col("canonical_name").isNotNull() & F.col("ref_id").isNotNull())
    rows = rows.select("ref_id", "canonical_name", "acronym", "local_name", "city").orderBy("ref_id").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries of kind {kind}")
    return [r.asDict() for r in rows]


_BUILT: dict[str, Index | Labels] = {}


def _index(token: str, entries: list[dict], kind: str, spelling: Spelling) -> Index | Labels:
    """The index of a list, built once per worker process; the last few are kept."""
    if token not in _BUILT:
        while len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[token] = Labels(entries, spelling) if kind == "institution_label" else Index(entries, spelling)
    return _BUILT[token]


def _map_values(entries, kind: str, spelling: Spelling):
    token = uuid.uuid4().hex

    def run(batches):
        index = None
        seen: dict[str, Match] = {}
        for pdf in batches:
            index = index or _index(token, entries.value, kind, spelling)
            if len(seen) > SEEN:
                seen.clear()
            for v in set(pdf["value"]) - seen.keys():
                seen[v] = index.match(v)
            got = [seen[v] for v in pdf["value"]]
            yield pdf.assign(
                ref_id=pd.array([m[0] for m in got], dtype="int32"), distance=pd.array([m[1] for m in got], dtype="int32"),
                tied=[m[2] for m in got], candidates=[m[3] for m in got],
            )

    return run


def map_to_canonical(df: DataFrame, canonical: DataFrame, *, key: str, field: str, kind: str, spelling: Spelling = Spelling()) -> DataFrame:
    """(row_id, value, ref_id, distance, tied, candidates): every value that is not null, not blank and not exactly a canonical name.

    ref_id is -1 for values that name no entry. candidates are all entries within
    the distance that the length allows, the nearest first; ref_id is the first of
    them, and tied tells that others are as near by as long a path, where the
    smallest ref_id goes first. Repeated values and keys keep all their rows; an
    empty list of entries leaves every value unmatched.
    """
    entries = load_entries(canonical, kind)
    names = df.sparkSession.createDataFrame([(e["canonical_name"],) for e in entries], "value string")
    src = spread(df.select(F.col(key).alias("row_id"), F.col(field).alias("value")).where(F.col("value").rlike(r"(?U)\S")), "row_id")
    open_ = src.join(F.broadcast(names), "value", "left_anti")  # as many as entries, checked above
    shared = df.sparkSession.sparkContext.broadcast(entries)
    schema = f"row_id {src.schema['row_id'].dataType.simpleString()}, value string, ref_id int, distance int, tied boolean, candidates array<int>"
    return open_.select("row_id", "value").mapInPandas(_map_values(shared, kind, spelling), schema)


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """(value, n_rows): the values that name no entry and how often they occur."""
    return mapped.where("ref_id = -1").groupBy("value").agg(F.count("*").alias("n_rows"))
