"""Scalar text functions; all but fold_ascii stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that tokenize() reads as blanks (fixed values).
PUNCTUATION = ",.:;!?()[]{}\"'`/\\|-_"


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column | str) -> Column:
    """White space of any kind collapsed to single blanks and stripped; null stays null."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_query(x: Column | str) -> Column:
    return F.lower(normalize_text(x))


def tokenize(x: Column | str) -> Column:
    """Distinct words of more than two characters, in order of first occurrence; null gives an empty array."""
    plain = F.translate(F.lower(normalize_text(F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit("")))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.array_distinct(F.filter(F.split(plain, r"(?U)\s+"), lambda w: F.length(w) > 2))


def overlap_ratio(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's tokens that the text holds; 0 without tokens."""
    n = F.size(query_tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_tokens, text_tokens)) / n)


def word_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the lower-cased word sets of two texts; 0 if either is empty."""
    x, y = word_set(a), word_set(b)
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(common / (F.size(x) + F.size(y) - common))


def sanitize_title(x: Column | str) -> Column:
    """A title fit for a search request: no operators, single blanks, 200 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(x, r"[\r\n]", " "), r"[\\$%&|<>{}()\[\]]", " ")
    return F.substring(normalize_text(plain), 1, 200)


@F.pandas_udf(StringType())
def _fold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def fold_ascii(x: Column | str) -> Column:
    """Compatibility decomposition without what is not ASCII. Apply it to distinct names, not to every row."""
    return _fold(x)


def normalize_institution(folded: Column) -> Column:
    """Of a folded name: lower case, commas and full stops as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), "[,.]", " "), r"\s+", " "))


def shorten(x: Column, width: int) -> Column:
    """The text, cut to `width` characters with an ellipsis."""
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x)


def embedding_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def arxiv_id(url: Column) -> Column:
    """The id of an abstract page, cut at the first v; null for other addresses."""
    rest = F.regexp_extract(url, r"^https?://arxiv\.org/abs/(.*)$", 1)
    return F.when(url.rlike(r"^https?://arxiv\.org/abs/"), F.split(rest, "v")[0])


def json_span(text: Column) -> Column:
    """The JSON part of a chatty answer: without code fences, from the first bracket to the last of its kind; null without one."""
    bare = F.trim(F.replace(F.replace(text, F.lit("`json"), F.lit("")), F.lit("`"), F.lit("")))
    found = F.regexp_extract(bare, r"(?s)^[^\[{]*(?:(\[.*\])|(\{.*\})).*$", 0)
    span = F.when(bare.rlike(r"(?s)^[^\[{]*\["), F.regexp_extract(bare, r"(?s)^[^\[{]*(\[.*\])", 1)).otherwise(
        F.regexp_extract(bare, r"(?s)^[^\[{]*(\{.*\})", 1)
    )
    return F.when(found == "", None).otherwise(F.replace(span, F.lit("\\'"), F.lit("'")))


def tolerant_json(text: Column, schema: str) -> Column:
    """from_json of json_span(); where that fails, once more with illegal backslashes escaped. Null if both fail."""
    span = json_span(text)
    repaired = F.regexp_replace(span, r'\\(?:u(?![0-9a-fA-F]{4})|(?!["\\/bfnrtu]))', r"\\\\")
    first = F.from_json(span, schema)
    legal = ~span.rlike(r'(?<!\\)(?:\\\\)*\\(?:u(?![0-9a-fA-F]{4})|(?!["\\/bfnrtu]))')
    return F.when(legal, first).otherwise(F.from_json(repaired, schema))


def context_block(hits: Column) -> Column:
    """Numbered titles and abstracts of an array of (rank, title, abstract), blank lines between."""
    return F.array_join(
        F.transform(
            F.array_sort(hits),
            lambda h, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] Title: "), F.coalesce(h["title"], F.lit("N/A")),
                F.lit("\n    Abstract: "), F.coalesce(h["abstract"], F.lit("")),
            ),
        ),
        "\n\n",
    )


def judge_request(query: Column, papers: Column, abstract_chars: int = 800) -> Column:
    """The query and its numbered papers, abstracts cut to `abstract_chars`: the text sent to a grader."""
    lines = F.transform(
        F.array_sort(papers),
        lambda p, i: F.concat(
            F.lit("\n["), (i + 1).cast("string"), F.lit("] Title: "), F.coalesce(p["title"], F.lit("")),
            F.lit("\nAbstract: "), F.substring(F.coalesce(p["abstract"], F.lit("")), 1, abstract_chars),
        ),
    )
    return F.concat(F.lit("Query: "), query, F.lit("\n\nPapers to judge:\n"), F.array_join(lines, "\n"))


#: What a model is asked for; the names of the stances and fields are those that stance_answers() and summary_answers() read.
STANCE_TASK = (
    "State for each paper whether it supports the accepted position (PRO-CONSENSUS), challenges it (DISSENTING) or takes no clear side (NEUTRAL).\n"
    'Answer in JSON only, one entry per paper: [{"title": "...", "stance": "PRO-CONSENSUS"}]'
)
SUMMARY_TASK = (
    "State which share of the summary supports the accepted position and which share challenges it.\n"
    'Answer in JSON only: {"pro_consensus_ratio": 0.0, "dissenting_ratio": 0.0}'
)


def stance_request(query: Column, papers: Column, task: str = STANCE_TASK) -> Column:
    """The query, the task and the numbered papers of an array of (rank, title, abstract): the text sent to a model that labels stances."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    each = F.transform(
        F.array_sort(papers), lambda p, i: F.concat(F.lit("\nPaper "), (i + 1).cast("string"), F.lit("\n"), blank(p["title"]), F.lit("\n"), blank(p["abstract"]), F.lit("\n"))
    )
    return F.concat(F.lit("Query:\n"), query, F.lit(f"\n\n{task}\n"), F.array_join(each, ""))


def summary_request(query: Column, summary: Column, task: str = SUMMARY_TASK) -> Column:
    """The query, a generated summary and the task: the text sent to a model that weighs the summary; a null summary is sent as empty."""
    return F.concat(F.lit("Query:\n"), query, F.lit("\n\nSummary:\n"), F.coalesce(summary, F.lit("")), F.lit(f"\n\n{task}"))
