"""Problem 9: text garbled by a wrong character encoding, by noisy-channel decoding.

Corpus side: frequencies of all words and signs beyond ASCII, counted over all
documents; words are looked up by equi-joins. Channel side: per piece of text a lattice whose arcs keep a character
or read a run of characters as the bytes of one UTF-8 character under one of the
wrong encodings; a lost byte is a wildcard. Viterbi search finds the likeliest
reading under the corpus frequencies; single-byte mix-ups (Cyrillic or Central
European text read as Western) are arcs over whole runs of letters, weighed by the
word frequencies; runs with lost bytes are read along arcs in which U+FFFD is any
byte, words by the word frequencies. A second Viterbi search runs over the pieces
of each garbled document, with the mix-ups that it is sure to hold as states, so
that words too short or too rare to tell by themselves are read like those around.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread

#: Encodings that UTF-8 is mistaken for, and pairs (read as, meant) of single-byte mix-ups.
MISREAD = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac-roman", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp1254", "cp1253")
MIXED_UP = (
    ("cp1252", "cp1251"), ("latin-1", "iso8859-2"), ("cp1252", "cp1250"), ("cp1252", "koi8-r"), ("latin-1", "iso8859-5"),
    ("cp1252", "cp1253"), ("cp1252", "mac-roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"),
    ("koi8-r", "cp1251"), ("cp1250", "cp1252"), ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"),
)
LOST = "�"
#: Steps of decoding, for text encoded several times.
DEPTH = 3
#: Weights of the search over a document: a piece garbled for sure, the bounds of one that is not, one without such a reading, a change of state.
SURE, DOUBT, UNREAD, CHANGE = 6.0, 3.0, 0.5, 2.0
#: Pieces that must be garbled for sure under a mix-up before it is a state.
ATTESTED = 2
_PIECE = re.compile(r"[^ \t\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters and characters beyond ASCII.
_RUN = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_EDGE = "¿¡«»“”„‚‘’…–—°€ "
_COUNTED = r"[\p{L}\p{M}]+|[^\p{L}\p{M}\s\x00-\x7F]"


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n): the distinct pieces without blanks that go beyond ASCII, and how often they occur."""
    pieces = F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w.rlike(r"[^\x00-\x7F]"))
    return docs.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def word_counts(pieces: DataFrame) -> DataFrame:
    """(w, n): all words and single signs with a character beyond ASCII, over all documents."""
    tokens = F.filter(F.regexp_extract_all("piece", F.lit(f"({_COUNTED})"), F.lit(1)), lambda w: w.rlike(r"[^\x00-\x7F]"))
    return pieces.select(F.explode(tokens).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))


def sign_counts(words: DataFrame) -> tuple[dict[str, int], int]:
    """(counts of the signs beyond ASCII in all words, number of words); as many entries as there are characters at most.

    A sign seen once may be the garbled one itself and gives no evidence.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    signs = words.select(F.explode(F.filter(F.split("w", ""), lambda c: c.rlike(r"[^\x00-\x7F]"))).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    return {r["c"]: r["n"] for r in signs.where("n > 1").collect()}, total


@lru_cache(maxsize=None)
def _byte_table(codec: str) -> dict[str, int]:
    """Character -> byte; undefined positions of a code page are read as control characters, as lenient decoders do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if codec.startswith("cp125"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def _has_sequence(bytes_: list[int]) -> bool:
    """A lead byte stands before as many continuation bytes as it asks for: without one there is nothing to read."""
    for i, b in enumerate(bytes_):
        k = _length(b) if b >= 0xC2 else 0
        if k and i + k <= len(bytes_) and all(0x80 <= x <= 0xBF for x in bytes_[i + 1 : i + k]):
            return True
    return False


def _script(c: str) -> str:
    o = ord(c)
    return "cyr" if 0x400 <= o <= 0x52F else "grk" if 0x370 <= o <= 0x3FF else "lat" if o < 0x250 or 0x1E00 <= o <= 0x1EFF else "oth"


@lru_cache(maxsize=None)
def _undefined(codec: str | None) -> frozenset[int]:
    """Bytes that have no character in a code page and so are lost first."""
    out = set()
    for b in range(0x80, 0x100) if codec else ():
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out.add(b)
    return frozenset(out)


def arcs(w: str, codec: str | None) -> list[tuple[int, int, str | tuple | None]]:
    """(start, end, reading) over a run with lost bytes, where U+FFFD stands for any lead or continuation byte.

    A reading is a character, the byte pattern of one character (None for a lost
    byte), or None for a run of lost bytes alone, which may be several characters.
    """
    table = _byte_table(codec) if codec else {}
    bytes_ = [None if c == LOST else table.get(c, 0) if ord(c) > 127 else 0 for c in w]
    inner = [b is None or 0x80 <= b <= 0xBF for b in bytes_]
    out, i, n = [], 0, len(w)
    while i < n:
        b, reading = bytes_[i], w[i]
        k = _length(b or 0)
        if k and i + k <= n and all(inner[i + 1 : i + k]):
            pattern = tuple(bytes_[i : i + k])
            if None in pattern:
                reading = pattern
            else:
                try:
                    reading = bytes(pattern).decode("utf-8")
                except UnicodeDecodeError:
                    k = 1
        elif b is None:
            k = 1
            while i + k < n and w[i + k] == LOST:
                k += 1
            reading = None
            if k == 1:  # a lost lead byte before continuation bytes
                while k < 4 and i + k < n and bytes_[i + k] and inner[i + k]:
                    k += 1
                reading = (None, *bytes_[i + 1 : i + k]) if k > 1 else None
        else:
            k = 1
        out.append((i, i + k, reading))
        i += k
    return out


def segments(read: list, sign) -> list:
    """(start, end, text or arcs): signs and whole words as text, words with lost bytes as their arcs."""
    out, word = [], []

    def close() -> None:
        if word:
            whole = all(isinstance(r, str) for _, _, r in word)
            out.append((word[0][0], word[-1][1], "".join(r for _, _, r in word) if whole else list(word)))
            word.clear()

    for start, end, r in read:
        if isinstance(r, tuple) and r[0] in (0xC2, 0xE2):  # the lead bytes of most signs
            r = sign(r) or r
        if isinstance(r, str) and not r.isalpha():
            close()
            out.append((start, end, r))
        else:
            word.append((start, end, r))
    close()
    return out


def _outline(w: str) -> str:
    return "=" + _BEYOND.sub("*", w)


def keys(w: str) -> set[str]:
    """Runs of one to three characters of a word, with their place from the start or the end or without, and the word's outline."""
    n = len(w)
    return {f"{p}:{w[i : i + k]}" for k in (1, 2, 3) for i in range(n - k + 1) for p in (i, i + k - n - 1, "")} | {_outline(w)}


def key_of(seen: str, word: list) -> str | None:
    """A key that all words have that the seen one may be: its longest known run, placed from an end without a run of unknown length between.

    None if nothing of the word is known.
    """
    n = len(word)
    loose = [i for i, (_, _, r) in enumerate(word) if r is None]
    first, last = (loose[0], loose[-1]) if loose else (n, -1)
    known = []
    for k in (3, 2, 1):
        for i in range(n - k + 1):
            part = [r for _, _, r in word[i : i + k]]
            if all(isinstance(r, str) for r in part):
                if i + k <= first:
                    return f"{i}:{''.join(part)}"
                if i > last:
                    return f"{i + k - n - 1}:{''.join(part)}"
                known.append(f":{''.join(part)}")
    outline = _outline(seen)
    return outline if outline != "=*" else known[0] if known else None


def matches(seen: str, word: str, codec: str | None) -> bool:
    """A path through the lattice of the seen run spells the word: kept characters, and UTF-8 bytes of which some are lost.

    Without an encoding, each lost character may also stand for one character beyond ASCII.
    """
    table = _byte_table(codec) if codec else {}

    def path(single: bool) -> bool:
        ends = {0}
        for c in word:
            b, after = c.encode(), set()
            for i in ends:
                if seen[i : i + 1] == c:
                    after.add(i + 1)
                if len(b) > 1 and single and seen[i : i + 1] == LOST:
                    after.add(i + 1)
                if len(b) > 1 and not single and i + len(b) <= len(seen) and all(s == LOST or table.get(s) == x for s, x in zip(seen[i : i + len(b)], b)):
                    after.add(i + len(b))
            ends = after
        return len(seen) in ends

    return path(False) or codec is None and path(True)


class Decoder:
    """Finds and restores garbled pieces under given corpus frequencies."""

    def __init__(self, counts: dict[str, int], signs: dict[str, int] | None = None, total: int | None = None) -> None:
        """`counts` are those of all words; or `signs` and `total` are given, and each piece gets the counts it needs."""
        self.words = counts
        self.total = (sum(counts.values()) if total is None else total) + 1
        if signs is None:
            signs = {}
            for w, n in counts.items():
                for c in w:
                    if ord(c) > 127:
                        signs[c] = signs.get(c, 0) + n
        self.signs, self.sign_total = signs, sum(signs.values()) + 1
        self.own: set[str] = set()
        self.best: dict[tuple[str, str | None], tuple[str, int]] | None = None
        self.by_length: dict[int, list[tuple[str, int]]] = {}
        for c, n in self.signs.items():
            if not c.isalpha() and c != LOST:
                self.by_length.setdefault(len(c.encode()), []).append((c, n))
        self.grams: dict[str, list[str]] = {}
        for w in counts:
            if w[0].isalpha():
                for key in keys(w):
                    self.grams.setdefault(key, []).append(w)
        self.piece = lru_cache(maxsize=200_000)(self._piece)

    def sign_cost(self, c: str) -> float:
        return 0.0 if ord(c) < 128 else -math.log((self.signs.get(c, 0) + 0.01) / self.sign_total)

    def plausible(self, c: str) -> bool:
        """The character is part of normal text of this corpus or at least of normal writing."""
        if ord(c) < 128:
            return False
        n = self.signs.get(c, 0)
        common = "‘’“”„‚–—…«»‹›€£°±§·×÷¿¡•™©®µªº¼½¾²³¹ ­" + "−≤≥≠≈∞→←↑↓∂∑∏∫√∆Ω"
        return c in common or n * 20_000 >= self.sign_total or n >= 2 and unicodedata.category(c)[0] == "L" and _script(c) != "oth"

    def count(self, word: str) -> int:
        n = self.words.get(word, 0)
        if n == 1 and word in self.own:  # only here
            n = 0
        return n if n else self.words.get(word.lower(), 0) // 2

    def viterbi(self, text: str, codec: str, favour: float = 0.0) -> str:
        """The cheapest reading of the piece: each arc keeps a character or reads the bytes of one UTF-8 character.

        `favour` is taken off the cost of reading, for a second opinion where signs alone do not decide.
        """
        table = _byte_table(codec)
        n = len(text)
        bytes_ = [table.get(c, 0) if ord(c) > 127 else 0 for c in text]
        best = [(0.0, -1, "")] + [(math.inf, -1, "")] * n
        for i in range(n):
            cost = best[i][0]
            c = text[i]
            # a character kept inside garbled text costs what it costs in the corpus; control characters are never meant
            keep = cost + (30.0 if "\x80" <= c <= "\x9f" else self.sign_cost(c))
            if keep < best[i + 1][0]:
                best[i + 1] = (keep, i, c)
            k = _length(bytes_[i])
            if k and i + k <= n and all(0x80 <= b <= 0xBF for b in bytes_[i + 1 : i + k]):
                try:
                    d = bytes(bytes_[i : i + k]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                step = cost + self.sign_cost(d) - favour + (0.0 if self.plausible(d) or self.again(d) else 25.0)
                if step < best[i + k][0]:
                    best[i + k] = (step, i, d)
        out, i = [], n
        while i > 0:
            out.append(best[i][2])
            i = best[i][1]
        return "".join(reversed(out))

    @staticmethod
    def again(c: str) -> bool:
        """What a first decoding of doubly encoded text gives: a lead or continuation byte as a Western character."""
        return "\x80" <= c <= "ÿ" or c in _byte_table("cp1252")

    def sane(self, before: str, after: str) -> bool:
        """The decoded words hold together: one script, no lower-case tail on capitals, known signs only."""
        for w in _WORD.findall(after):
            if w.isascii() or w in before:
                continue
            if len({_script(c) for c in w}) > 1 and self.count(w) == 0:
                return False
            if re.search(r"[^\W\d_a-z]{2}", w) and re.search(r"[^\x00-\x7f]", w) and self.count(w) == 0:
                head = [c for c in w if c.isupper()]
                tail = [c for c in w if c.islower() and ord(c) > 127]
                if len(head) >= 2 and tail and w[-1] in tail and not any(c.islower() and ord(c) < 128 for c in w):
                    return False
        return True

    def likelihood(self, text: str) -> float:
        """Log-likelihood of a piece by its words and signs beyond ASCII."""
        score = 0.0
        for w in _WORD.findall(text):
            if not w.isascii():
                n = self.count(w)
                score += math.log((n + 0.02) / self.total) if n else math.log(0.02 / self.total) - 0.5 * sum(
                    0 if ord(c) < 128 else 1 if self.plausible(c) else 6 for c in w
                )
        for c in text:
            if ord(c) > 127 and not c.isalpha():
                n = self.signs.get(c, 0) + 0.02
                score += math.log(n / self.total) * (2 if "\x80" <= c <= "\x9f" else 1)
        return score

    def _piece(self, text: str) -> tuple[str, bool]:
        """(restored, garbled) of a piece without blanks."""
        garbled, now = False, text
        self.own = set(_WORD.findall(text))
        for _ in range(DEPTH):
            found = self.misread(now)
            if found is None:
                break
            now, garbled = found, True
        if not garbled:
            found = self.mixed_up(now)
            if found is not None:
                now, garbled = found, True
        if LOST in now:
            now, garbled = self.fill(now), True
        if _CONTROL.search(text):
            garbled = True
        return now, garbled

    def readings(self, text: str) -> Iterator[tuple[str, str]]:
        """(reading, the reading read again) under each encoding; doubly encoded text reads well only after the second step."""
        for codec in MISREAD:
            table = _byte_table(codec)
            holds = lambda t: _has_sequence([table.get(c, 0) if ord(c) > 127 else 0 for c in t])  # noqa: E731, B023
            if not holds(text):
                continue
            for favour in (0.0, 12.0):
                out = self.viterbi(text, codec, favour)
                if out != text and all(self.plausible(c) or self.again(c) or c in text for c in out if ord(c) > 127):
                    yield out, self.viterbi(out, codec) if holds(out) else out

    def misread(self, text: str) -> str | None:
        base, best, reading = self.likelihood(text), None, None
        for out, again in self.readings(text):
            if not self.sane(text, out):
                continue
            gain = max(self.likelihood(out), self.likelihood(again) if self.sane(out, again) else -math.inf) - base
            # every decoded character explains two or more: reward the compression
            gain += 2.0 * (len(text) - len(out))
            if gain > 0 and (best is None or gain > best):
                best, reading = gain, out
        return reading

    @staticmethod
    def mixtures(text: str, edge: str = _EDGE) -> Iterator[tuple[int, str, str, str]]:
        """(pair, reading, longest word of the text, longest word of the reading) under each pair of single-byte encodings.

        Punctuation (`edge`) at the ends of a word is meant as such.
        """
        words = [w.strip(edge) if edge else w for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        words = [w for w in words if not w.isascii()]
        if not words:
            return
        word = max(words, key=len)
        letters = [c for c in word if ord(c) > 127]
        for pair, (read_as, meant) in enumerate(MIXED_UP):
            table = _byte_table(read_as)
            if any(c not in table for c in letters):
                continue
            out = text
            for w in words:
                try:
                    new = b"".join(bytes([table[c]]) if ord(c) > 127 else c.encode() for c in w).decode(meant)
                except (KeyError, UnicodeDecodeError):
                    new = w
                out = out.replace(w, new, 1)
            if out == text:
                continue
            new_words = [w for w in _WORD.findall(out) if not w.isascii()]
            if not new_words:
                continue
            longest = max(new_words, key=len)
            yield pair, out, word, longest

    def likelier(self, word: str, longest: str) -> tuple[int, int]:
        """Counts of the word as it is and as it may be meant."""
        return max(self.count(w) for w in _WORD.findall(word) or [word]), self.count(longest)

    def alternatives(self, text: str) -> list[tuple[int, str, float]]:
        """(pair, reading, gain) of the single-byte mix-ups under which the piece would be a known word; signs at its ends may be letters."""
        out: dict[int, tuple[int, str, float]] = {}
        for edge in (_EDGE, ""):
            for pair, reading, word, longest in self.mixtures(text, edge):
                was, known = self.likelier(word, longest)
                gain = math.log((known + 1) / (was + 0.5))
                if known and (pair not in out or gain > out[pair][2]):
                    out[pair] = (pair, reading, gain)
        return list(out.values())

    def mixed_up(self, text: str) -> str | None:
        best, reading = None, None
        for _, out, word, longest in self.mixtures(text):
            letters = [c for c in word if ord(c) > 127]
            was, known = self.likelier(word, longest)
            whole = len(letters) == len(word)
            if known > was and (len(longest) >= 3 and (len(letters) > 1 or not word.isalpha() or was == 0)):
                gain = math.log((known + 1) / (was + 0.5))
            elif whole and len(word) >= 5 and was == 0 and _script(longest[0]) == "cyr" and len({_script(c) for c in longest}) == 1 and _script(word[0]) == "lat" and (longest.islower() or longest.istitle()):
                gain = 0.1
            else:
                continue
            if best is None or gain > best:
                best, reading = gain, out
        return reading

    def needs(self, text: str) -> tuple[set[str], set[tuple[str, str, str]]] | None:
        """What decoding the piece may look up: words, and (key, word with lost bytes, encoding). None if there is no other reading."""
        reached, level, words, other = {text}, {text}, set(_WORD.findall(text)), False
        for _ in range(DEPTH):
            found = set()
            for t in level:
                for out, again in self.readings(t):
                    words.update(_WORD.findall(out), _WORD.findall(again))
                    found.add(out)
            level = found - reached
            reached |= level
        for edge in (_EDGE, ""):
            for _, out, word, longest in self.mixtures(text, edge):
                words.update((word, longest))
                words.update(_WORD.findall(word))
                other = True
                if LOST in text and edge:
                    reached.add(out)
        lost = set()
        for run in (r for t in reached if LOST in t for r in _RUN.findall(t) if LOST in r):
            for codec in (None, *MISREAD):
                for start, end, segment in self.segments(run, codec):
                    key = None if isinstance(segment, str) else key_of(run[start:end], segment)
                    if key:
                        lost.add((key, run[start:end], codec or ""))
        if not (other or len(reached) > 1 or LOST in text or _CONTROL.search(text)):
            return None
        words |= {w.lower() for w in words}
        return {w for w in words if not w.isascii()}, lost

    def fill(self, text: str) -> str:
        """Runs with lost bytes, read under the encoding that leaves the fewest lost and then makes the likeliest words."""

        def run(m: re.Match) -> str:
            w, best, reading = m[0], None, m[0]
            if LOST not in w:
                return w
            for codec in (None, *MISREAD):
                out, score = self.read_lost(w, codec)
                rank = (-out.count(LOST), score)
                if out != w and (best is None or rank > best):
                    best, reading = rank, out
            return reading

        return _RUN.sub(run, text)

    def read_lost(self, w: str, codec: str | None) -> tuple[str, float]:
        """(reading, log-likelihood) of a run: single signs by the sign frequencies, words by the word frequencies."""
        out, score = [], 0.0
        for start, end, segment in self.segments(w, codec):
            if isinstance(segment, str):
                out.append(segment)
                continue
            seen = w[start:end]
            found = self.fitting(seen, segment, codec)
            if found:
                x, n = found
                score += math.log(n / self.total)
                out.append(x)
            else:
                score += math.log(0.02 / self.total)
                out.append(seen)
        return "".join(out), score

    def segments(self, w: str, codec: str | None) -> list:
        return segments(arcs(w, codec), lambda p: self.sign(p, codec))

    def fitting(self, seen: str, segment: list, codec: str | None) -> tuple[str, int] | None:
        """The most frequent word, not garbled itself, that the seen one may be, and its count."""
        if self.best is not None:
            return self.best.get((seen, codec or ""))
        fit = [x for x in self.grams.get(key_of(seen, segment), ()) if matches(seen, x, codec) and not self.piece(x)[1]]
        return min(((x, self.words[x]) for x in fit), key=lambda f: (-f[1], f[0]), default=None)

    def sign(self, pattern: tuple[int | None, ...], codec: str | None) -> str | None:
        """The most frequent sign other than a letter with these bytes; bytes that the encoding leaves undefined come first."""
        undefined = _undefined(codec)
        fit = []
        for c, n in self.by_length.get(len(pattern), ()):
            b = c.encode()
            if all(p is None or p == x for p, x in zip(pattern, b)) and self.plausible(c):
                fit.append((all(p is not None or x in undefined for p, x in zip(pattern, b)), n, c))
        return max(fit)[2] if fit else None

    def text(self, text: str) -> tuple[str, int, bool]:
        """(restored, garbled pieces, characters still lost)."""
        return _replace(text, self.piece)


def _replace(text: str, read) -> tuple[str, int, bool]:
    if text.isascii():
        return text, 0, False
    out, at, hits = [], 0, 0
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece.isascii():
            continue
        restored, garbled = read(piece)
        if garbled:
            hits += 1
        if restored != piece:
            out += [text[at : m.start()], restored]
            at = m.end()
    out.append(text[at:])
    restored = "".join(out)
    return restored, hits, LOST in restored


def _needs(model):
    def run(batches):
        decoder = Decoder({}, *model.value)
        for pdf in batches:
            rows = [(p, f) for p in pdf["piece"] if (f := decoder.needs(p)) is not None]
            yield pd.DataFrame(
                {"piece": [p for p, _ in rows], "words": [sorted(f[0]) for _, f in rows], "lost": [[dict(zip(("key", "seen", "codec"), x)) for x in sorted(f[1])] for _, f in rows]}
            )

    return run


def _decode(model):
    """Per piece: how it is restored (null if it is not garbled by itself), the mix-ups that give just that, and its readings under others."""

    def run(batches):
        decoder = Decoder({}, *model.value)
        for pdf in batches:
            out = []
            for piece, counts, best in zip(pdf["piece"], pdf["counts"], pdf["best"]):
                decoder.words = {} if counts is None else {x["w"]: x["n"] for x in counts}
                decoder.best = {} if best is None else {(x["seen"], x["codec"]): (x["w"], x["n"]) for x in best}
                restored, garbled = decoder._piece(piece)
                if garbled:
                    out.append((piece, restored, [pair for pair, reading, *_ in decoder.mixtures(piece) if reading == restored], []))
                else:
                    others = [{"pair": pair, "reading": reading, "gain": gain} for pair, reading, gain in decoder.alternatives(piece)]
                    if others:
                        out.append((piece, None, [], others))
            yield pd.DataFrame(out, columns=["piece", "restored", "pairs", "others"])

    return run


def _keys(batches):
    for pdf in batches:
        rows = [(k, w, n) for w, n in zip(pdf["w"], pdf["n"]) if w[0].isalpha() for k in keys(w)]
        yield pd.DataFrame(rows, columns=["key", "w", "n"])


def _matching(batches):
    for pdf in batches:
        yield pdf[[matches(s, w, c or None) for s, w, c in zip(pdf["seen"], pdf["w"], pdf["codec"])]]


def _wanted(pieces: DataFrame, model) -> DataFrame:
    """(id, piece, words, lost): what has another reading, and what is to be looked up for it."""
    wanted = pieces.select("piece").mapInPandas(_needs(model), "piece string, words array<string>, lost array<struct<key: string, seen: string, codec: string>>")
    return checkpoint(wanted.withColumn("id", F.monotonically_increasing_id()))


DECODED = "piece string, restored string, pairs array<int>, others array<struct<pair: int, reading: string, gain: double>>"


def _decoded(wanted: DataFrame, words: DataFrame, best: DataFrame | None, model) -> DataFrame:
    """The rows of _decode() of the pieces that are garbled by themselves or have other readings."""
    counts = wanted.select("id", F.explode("words").alias("w")).join(words, "w").groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("counts"))
    read = wanted.select("id", "piece").join(counts, "id", "left")
    if best is None:
        read = read.withColumn("best", F.lit(None).cast("array<struct<seen: string, codec: string, w: string, n: bigint>>"))
    else:
        asked = wanted.select("id", F.explode("lost").alias("l")).select("id", "l.seen", "l.codec")
        read = read.join(asked.join(best, ["seen", "codec"]).groupBy("id").agg(F.collect_list(F.struct("seen", "codec", "w", "n")).alias("best")), "id", "left")
    return read.select("piece", "counts", "best").mapInPandas(_decode(model), DECODED)


def _best_words(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """(seen, codec, w, n): for each word with lost bytes the most frequent of the given words that it may be."""
    lost = wanted.select(F.explode("lost").alias("l")).select("l.*").distinct()
    keyed = words.mapInPandas(_keys, "key string, w string, n long")
    fits = lost.join(keyed, "key").select("seen", "codec", "w", "n").mapInPandas(_matching, "seen string, codec string, w string, n long")
    top = fits.groupBy("seen", "codec").agg(F.min(F.struct((-F.col("n")).alias("n"), "w")).alias("x"))
    return top.select("seen", "codec", "x.w", (-F.col("x.n")).alias("n"))


def _context(pieces: list[str], known: dict[str, dict]) -> dict[int, str]:
    """Readings, by position, of pieces that are not garbled by themselves but stand among pieces of one mix-up.

    Viterbi search over the pieces; the states are no mix-up (-1) and those with
    ATTESTED different sure pieces.
    """
    sure: dict[int, set[str]] = {}
    for p in set(pieces):
        for pair in known[p]["pairs"] if p in known else ():
            sure.setdefault(int(pair), set()).add(p)
    states = [-1, *(pair for pair, held in sorted(sure.items()) if len(held) >= ATTESTED)]
    if len(states) == 1:
        return {}
    readings = [{} if p not in known else {x["pair"]: (x["reading"], x["gain"]) for x in known[p]["others"]} for p in pieces]
    score, back = [0.0] * len(states), []
    for p, other in zip(pieces, readings):
        top = max(range(len(states)), key=score.__getitem__)
        came = [i if score[i] >= score[top] - CHANGE else top for i in range(len(states))]
        back.append(came)
        worth = []
        for state in states:
            if p in known and known[p]["restored"] is not None:
                worth.append(SURE if p in sure.get(state, ()) else 0.0)
            elif state == -1:
                worth.append(0.0)
            else:
                worth.append(min(DOUBT, max(-DOUBT, other[state][1] + 1)) if state in other else -UNREAD)
        score = [(score[i] if i == came[i] else score[top] - CHANGE) + w for i, w in enumerate(worth)]
    out, at = {}, max(range(len(states)), key=score.__getitem__)
    for i in range(len(pieces) - 1, -1, -1):
        if states[at] in readings[i]:
            out[i] = readings[i][states[at]][0]
        at = back[i][at]
    return out


def _restore(batches):
    for pdf in batches:
        rows = []
        for text, found in zip(pdf["text"], pdf["found"]):
            known = {x["piece"]: x for x in found}
            pieces = [m[0] for m in _PIECE.finditer(text) if not m[0].isascii()]
            around, at = _context(pieces, known), iter(range(len(pieces)))

            def read(p: str) -> tuple[str, bool]:
                i = next(at)
                if p in known and known[p]["restored"] is not None:
                    return known[p]["restored"], True
                return (around[i], True) if i in around else (p, False)

            rows.append(_replace(text, read))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "restored": [r[0] for r in rows], "pieces": [r[1] for r in rows], "lost": [r[2] for r in rows]})


def restore_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, pieces, lost): documents with at least one garbled piece and their restored text.

    pieces counts the garbled pieces (runs without blanks); lost tells whether
    characters could not be had back. Null, empty and pure ASCII texts are never
    garbled and are not decoded.

    Only the counts of signs go to the driver. Each distinct piece with another
    reading looks up the words of its readings, and the words that fit its lost
    bytes, in the counts of all words by equi-joins.
    """
    src = spread(docs.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7F]")), "doc_id")
    pieces = checkpoint(piece_counts(src))
    words = checkpoint(word_counts(pieces))
    model = docs.sparkSession.sparkContext.broadcast(sign_counts(words))
    wanted = _wanted(pieces, model)
    lossy = wanted.where(F.size("lost") > 0)
    decoded = checkpoint(_decoded(wanted.where(F.size("lost") == 0), words, None, model))
    if lossy.limit(1).count():  # lost bytes are read as words of pieces that are not garbled themselves
        whole = pieces.where(~F.col("piece").contains(LOST)).join(decoded.where("restored is not null"), "piece", "left_anti")
        decoded = decoded.unionByName(_decoded(lossy, words, _best_words(lossy, word_counts(whole)), model))
    # equal texts are met once, told by 128 bits
    keyed = src.withColumn("t", F.xxhash64("text")).withColumn("u", F.xxhash64("text", F.lit(9)))
    held = F.array_distinct(F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w.rlike(r"[^\x00-\x7F]")))
    found = (
        keyed.select("t", "u", F.explode(held).alias("piece")).join(decoded, "piece")
        .groupBy("t", "u").agg(F.collect_set(F.struct("piece", "restored", "pairs", "others")).alias("found"))
        .where(F.exists("found", lambda x: x["restored"].isNotNull()))
    )
    return keyed.join(found, ["t", "u"]).select("doc_id", "text", "found").mapInPandas(_restore, "doc_id long, restored string, pieces long, lost boolean")
