"""Problem 5: one form for text that looks the same.

Values with a character beyond ASCII are exploded to positioned code points;
stretches of pure ASCII between them stay whole. A table of mappings is joined to them: compatibility forms (full-width,
half-width, ligatures), spaces, invisible characters, canonical decompositions
and look-alike letters of other scripts. Combining marks are ordered by their
class behind their base, pairs are recomposed, and the strings are rebuilt.

Look-alike letters are replaced only in words that mix them with Latin letters,
and in words made of look-alikes alone within a value that is otherwise Latin;
a single Greek letter is a symbol unless it is a capital that stands free of
hyphens, and text truly in another script is kept.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import spread

#: Letters of other scripts and the Latin letters they look like (fixed values).
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y", "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "α": "a", "γ": "y", "τ": "t", "η": "n",
    "Օ": "O", "Տ": "S", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
}

#: Letters whose shape is only roughly Latin: replaced in mixed words, never a reason to call a word a look-alike by itself.
ROUGH = set("кмтвнгпικαυγτηУ")

#: Blocks of combining accents; the vowel signs of other scripts are not among them.
ACCENT_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))

INVISIBLE = "invisible"
SPACE = "space"
COMPAT = "compat"
MARK = "mark"
LOOKALIKE = "lookalike"
KINDS = (INVISIBLE, SPACE, COMPAT, MARK, LOOKALIKE)


def _form(cp: int) -> tuple[str, str | None] | None:
    """(target, kind) of a code point whose form changes; kind is None for a canonical decomposition."""
    c = chr(cp)
    cat = unicodedata.category(c)
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c], LOOKALIKE
    if cat == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return "", INVISIBLE
    if cat == "Zs" and c != " ":
        return " ", SPACE
    decomposition = unicodedata.decomposition(c)
    if 0xFB00 <= cp <= 0xFB06 or 0xFF01 <= cp <= 0xFFEE or decomposition.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKD", c), COMPAT
    if any(lo <= cp <= hi for lo, hi in ACCENT_BLOCKS):
        return c, MARK
    if decomposition and not decomposition.startswith("<") and not 0xAC00 <= cp <= 0xD7A3:
        return unicodedata.normalize("NFD", c), None
    return None


@lru_cache(maxsize=1)
def _mapping_rows() -> list[tuple[str, str, str | None, bool]]:
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xF0000 <= cp:  # surrogates and the private planes
            continue
        form = _form(cp)
        if form:
            out.append((chr(cp), form[0], form[1], chr(cp) in ROUGH))
    return out


def mapping(spark: SparkSession) -> DataFrame:
    """(ch, target, kind): some thousand rows, bounded by the character set."""
    return spark.createDataFrame(pd.DataFrame([r[:3] for r in _mapping_rows()], columns=["ch", "target", "kind"]))


_CLASS = "[" + "".join(LOOK_ALIKES) + "]"
_SURE = "[" + "".join(c for c in LOOK_ALIKES if c not in ROUGH) + "]"
#: Letters of a word, with what may hide between them.
_WORD = r"\p{L}\p{M}\p{Cf}"
_ODD_LETTER, _ODD_OTHER = rf"[{_WORD}&&[^\x00-\x7F]]", rf"[^\x00-\x7F{_WORD}]"
#: A value in pieces: words that go beyond ASCII, other single characters that do, and the stretches between.
_PIECES = rf"([{_WORD}]*{_ODD_LETTER}[{_WORD}]*|{_ODD_OTHER}|[\x00-\x7F]+?(?=(?<![{_WORD}])[{_WORD}]*{_ODD_LETTER}|{_ODD_OTHER}|\z))"
#: Characters of a piece that are gathered at once.
CHUNK = 1024


def _true_other(word: Column) -> Column:
    """The word holds a letter of another script that is no look-alike."""
    return word.rlike(rf"(?!{_CLASS})(?!\p{{IsLatin}})\p{{L}}")


def normalize_values(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys + (normalized, kinds, changed): values with their one form, the kinds of characters that were found, and whether the form differs.

    Values without a character beyond ASCII, empty and null ones keep their form and
    skip the character work; kinds is empty for values that hold none of the kinds.
    A combining accent without a composed form is found but stays as it is.
    The keys must name each row once; extra columns and repeated values are allowed.
    Characters are gathered by pieces of CHUNK first, so that the state of a long
    text is about as large as the text.
    """
    spark = df.sparkSession
    beyond = F.coalesce(F.col(value).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = df.where(~beyond).select(*keys, F.col(value).alias("normalized"), F.array().cast("array<string>").alias("kinds"), F.lit(False).alias("changed"))
    rest = spread(df.where(beyond).select(*keys, F.col(value).alias("_value")), *keys)
    narrow = lambda c: F.translate(c, _wide(), _thin())  # noqa: E731  full-width letters are Latin letters here
    # What is known of a value or a piece is settled before it is exploded, so that long texts are looked at once.
    by_value = rest.select(
        *keys, F.xxhash64("_value").alias("_was"), F.regexp_extract_all("_value", F.lit(_PIECES), F.lit(1)).alias("_pieces"),
        (~_true_other(F.col("_value")) & narrow(F.col("_value")).rlike(r"\p{IsLatin}")).alias("_latin"),
    )
    side = lambda i, cut: F.coalesce(cut(F.get(F.col("_pieces"), i), F.lit(1)), F.lit(" "))
    around = F.transform("_pieces", lambda p, i: F.struct(p.alias("piece"), F.concat(side(i - 1, F.right), side(i + 1, F.left)).alias("by")))
    by_piece = by_value.select(*keys, "_was", "_latin", F.posexplode(around).alias("_at", "_p"))
    piece = F.col("_p.piece")
    thin = narrow(piece)
    latin = thin.rlike(r"\p{IsLatin}")
    others = F.size(F.regexp_extract_all(thin, F.lit(f"({_CLASS})"), F.lit(1)))
    alone = (
        F.col("_latin") & ~latin & ~_true_other(piece) & thin.rlike(_SURE) & (thin.rlike(r"\p{IsCyrillic}") | (others > 1) | (thin.rlike(r"\p{Lu}") & ~F.col("_p.by").contains("-")))
    )
    signs = F.when(piece.rlike(r"[^\x00-\x7F]"), F.split(piece, "")).otherwise(F.array(piece))
    exploded = by_piece.select(*keys, "_was", "_at", (latin | alone).alias("_swap"), signs.alias("_signs")).select(
        *keys, "_was", "_at", "_swap", F.posexplode("_signs").alias("_pos", "ch")
    )
    mapped = exploded.join(F.broadcast(mapping(spark)), "ch", "left")  # bounded by the character set
    kept = (F.col("kind") == LOOKALIKE) & ~F.col("_swap")
    target = F.when(kept | (F.col("kind").isNull() & F.col("target").isNull()), F.col("ch")).otherwise(F.col("target"))
    held = mapped.select(*keys, "_was", "_at", F.floor(F.col("_pos") / CHUNK).alias("_chunk"), F.struct("_pos", target.alias("t")).alias("_r"), F.when(~kept, F.col("kind")).alias("_kind"))
    # one shuffle for both steps
    pieces = held.repartition(*keys).groupBy(*keys, "_was", "_at", "_chunk").agg(F.collect_list("_r").alias("_r"), F.collect_set("_kind").alias("_kinds"))
    pieces = pieces.select(*keys, "_was", F.struct("_at", "_chunk", F.array_join(F.transform(F.array_sort("_r"), lambda x: x["t"]), "").alias("t")).alias("_r"), "_kinds")
    gathered = pieces.groupBy(*keys, "_was").agg(F.collect_list("_r").alias("_r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_kinds")))).alias("kinds"))
    joined = F.array_join(F.transform(F.array_sort("_r"), lambda x: x["t"]), "")
    rebuilt = gathered.select(*keys, "_was", recompose(joined).alias("normalized"), "kinds")
    return plain.unionByName(rebuilt.select(*keys, "normalized", "kinds", (F.xxhash64("normalized") != F.col("_was")).alias("changed")))


def _wide() -> str:
    return "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))


def _thin() -> str:
    return "".join(chr(65 + i) for i in range(26)) + "".join(chr(97 + i) for i in range(26))


@lru_cache(maxsize=1)
def _pairs() -> dict[tuple[str, str], str]:
    """(base, mark) -> composed character, without the excluded compositions."""
    out = {}
    for cp in range(0xC0, 0x12000):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (chr(int(x, 16)) for x in d.split(" "))
            out[a, b] = c
    return out


def compose(text: str) -> str:
    """Order the combining marks behind each base by class and compose what has a composed form."""
    if text.isascii():
        return text
    pairs, out, marks = _pairs(), [], []

    def close() -> None:
        marks.sort(key=unicodedata.combining)
        base, left, blocked = out[-1] if out else "", [], 0
        for m in marks:
            k = unicodedata.combining(m)
            joined = pairs.get((base, m)) if base and k > blocked else None
            if joined:
                base = joined
            else:
                left.append(m)
                blocked = k
        if out:
            out[-1] = base
        out.extend(left)
        marks.clear()

    for c in text:
        if unicodedata.combining(c):
            marks.append(c)
        else:
            if marks:
                close()
            out.append(c)
    if marks:
        close()
    return "".join(out)


@F.pandas_udf(StringType())
def recompose(texts: pd.Series) -> pd.Series:
    return texts.map(compose, na_action="ignore")


def corpus_fields(papers: DataFrame, authorships: DataFrame) -> DataFrame:
    """(source_table, row_id, field_name, value): the titles, author names and affiliations; each table is read once."""
    def part(df: DataFrame, table: str, key: str, *fields: str) -> DataFrame:
        values = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")
        return df.select(F.lit(table).alias("source_table"), F.col(key).alias("row_id"), values).select("source_table", "row_id", "x.field_name", "x.value")

    return part(papers, "fairsearch_arxiv", "vec_id", "title").unionByName(part(authorships, "authorships", "authorship_id", "author_name", "raw_affiliation"))


def unify(text: str) -> str:
    """The same form for one value in Python, for operators that work on single strings."""
    if text.isascii():
        return text
    forms, out = _forms(), []
    foreign = any(c not in LOOK_ALIKES and c.isalpha() and not _is_latin(c) for c in text)
    has_latin = any(_is_latin(c) for c in text)
    word: list[str] = []
    before = " "

    def close(after: str = " ") -> None:
        if word:
            latin = any(_is_latin(c) for c in word)
            letters = [c for c in word if c.isalpha()]
            alone = (
                not latin and not foreign and has_latin and all(c in LOOK_ALIKES for c in letters)
                and any(c not in ROUGH for c in letters)
                and (len(letters) > 1 or any("Ѐ" <= c <= "ԯ" for c in letters) or letters[0].isupper() and "-" not in before + after)
            )
            for c in word:
                target, kind = forms.get(c, (c, None))
                out.append(c if kind == LOOKALIKE and not (latin or alone) else target)
            word.clear()

    for c in text:
        if c.isalpha() or unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cf":
            word.append(c)
        else:
            close(c)
            before = c
            out.append(forms.get(c, (c, None))[0])
    close()
    return compose("".join(out))


@lru_cache(maxsize=1)
def _forms() -> dict[str, tuple[str, str | None]]:
    return {r[0]: (r[1], r[2]) for r in _mapping_rows()}


@lru_cache(maxsize=100_000)
def _is_latin(c: str) -> bool:
    return c.isalpha() and ("LATIN" in unicodedata.name(c, ""))
