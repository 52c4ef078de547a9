"""Institution labels: rule matching, classification, joins onto points, and the offline audit of the labels."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import fold_ascii, normalize_institution

#: Most rules that a join or a task holds at once.
MAX_RULES = 100_000
PRIV, UNDER = "privileged", "underrepresented"


def default_rules(spark: SparkSession) -> DataFrame:
    """(tier, entry): the union of the tiers; an entry of two tiers appears in both."""
    return spark.createDataFrame([(t, e) for t, names in R.TIERS.items() for e in names], "tier string, entry string")


def few(rows: DataFrame, most: int = 10_000) -> list:
    """The values of a small one-column table, as parameters of a job need them; more than `most` are refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return [r[0] for r in got]


def is_institutional(name: Column, hosts: list[str] | None = None) -> Column:
    """The name holds none of the parts of names of places where papers are deposited; null for null."""
    low = F.lower(name)
    bad = F.lit(False)
    for h in hosts if hosts is not None else R.HOSTS:
        bad = bad | low.contains(h)
    return ~bad


def institutional_names(names: Column, hosts: list[str] | None = None) -> Column:
    return F.filter(names, lambda n: is_institutional(n, hosts))


def blank_look_alikes(normalized: Column, look_alikes: list[str]) -> Column:
    """The look-alikes replaced by a blank one after the other."""
    for x in look_alikes:
        normalized = F.replace(normalized, F.lit(x), F.lit(" "))
    return normalized


def normalized_name(name: Column | str) -> Column:
    """A name in normal form; Arrow work, best on distinct names."""
    return normalize_institution(fold_ascii(name))


def normalized_names(names: DataFrame) -> DataFrame:
    """(name, normalized): distinct non-null names in normal form; Arrow work on distinct names only."""
    distinct = names.select("name").where("name is not null").distinct()
    return distinct.select("name", normalized_name("name").alias("normalized"))


def match_rules(names: DataFrame, rules: DataFrame, look_alikes: list[str] | None = None) -> DataFrame:
    """(name, normalized, trigger): the first rule entry, by tier and entry, that occurs in the name on word boundaries; null without one.

    The words of each name meet the first words of the entries in an equi-join, and
    the spans that begin there the entries in another, so neither names nor rules
    are crossed and the work per name does not grow with the number of rules.
    """
    blank = R.LOOK_ALIKES if look_alikes is None else look_alikes
    known = few(rules.select(F.struct("tier", F.lower("entry").alias("entry"))).distinct(), MAX_RULES)
    spark = names.sparkSession
    entries = F.broadcast(spark.createDataFrame([tuple(r) for r in known], "tier string, entry string"))  # checked above
    begins: dict[str, set[int]] = {}
    for r in known:
        parts = _PIECE.findall(r["entry"] or "")
        if parts:
            begins.setdefault(parts[0], set()).add(len(parts))
    starts = F.broadcast(spark.createDataFrame([(w, sorted(n)) for w, n in begins.items()], "piece string, lengths array<int>"))
    base = normalized_names(names)
    pieces = _pieces(blank_look_alikes(F.col("normalized"), blank))
    # from each piece that begins an entry, the runs of pieces of just the lengths of such entries
    placed = base.select("name", pieces.alias("pieces")).select("name", "pieces", F.posexplode("pieces").alias("at", "piece")).join(starts, "piece")
    run = F.transform("lengths", lambda n: F.array_join(F.slice("pieces", F.col("at") + 1, n), ""))
    spans = placed.select("name", F.explode(run).alias("entry"))
    first = spans.join(entries, "entry").groupBy("name").agg(F.min(F.struct("tier", "entry"))["entry"].alias("trigger"))
    return base.join(first, "name", "left")


_PIECE = re.compile(r"(\w+|\W)", re.ASCII)


def _pieces(text: Column) -> Column:
    """Words and what stands between them, so that runs of pieces end on word boundaries."""
    return F.regexp_extract_all(text, F.lit(_PIECE.pattern), F.lit(1))


def classify(papers: DataFrame, matched: DataFrame) -> DataFrame:
    """(paper_id, label, trigger) from (paper_id, affiliations): unknown without names, privileged if any name has a trigger, else underrepresented.

    trigger is that of the first such name. Null affiliations count as none.
    """
    exploded = papers.select("paper_id", F.posexplode_outer("affiliations").alias("pos", "name"))
    joined = exploded.join(matched.select("name", "trigger"), "name", "left")
    first = F.min(F.when(F.col("trigger").isNotNull(), F.struct("pos", "trigger")))["trigger"]
    facts = joined.groupBy("paper_id").agg(F.count("pos").alias("n"), first.alias("trigger"))
    label = F.when(F.col("n") == 0, "unknown").when(F.col("trigger").isNotNull(), PRIV).otherwise(UNDER)
    return facts.select("paper_id", label.alias("label"), "trigger")


def update_payload(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with the institution_label and affiliations of `labels` (paper_id, label, affiliations), written back in full.

    A paper without a row there becomes unknown with no affiliations, so that no old
    label stays; points without paper_id (null or empty) are left as they are.
    """
    new = labels.select("paper_id", F.col("label").alias("new_label"), F.col("affiliations").alias("new_affiliations"))
    named = F.coalesce(F.col("paper_id") != "", F.lit(False))
    return (
        points.join(new, "paper_id", "left")
        .withColumn("institution_label", F.when(named, F.coalesce("new_label", F.lit("unknown"))).otherwise(F.col("institution_label")))
        .withColumn("affiliations", F.when(named, F.coalesce("new_affiliations", F.array().cast("array<string>"))).otherwise(F.col("affiliations")))
        .drop("new_label", "new_affiliations")
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    """(label, n, share), the shares over the few labels."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def trigger_histogram(classified: DataFrame) -> DataFrame:
    """(trigger, n_papers) of privileged papers, by their first matching name."""
    return classified.where(F.col("label") == PRIV).groupBy("trigger").agg(F.count("*").alias("n_papers"))


def trigger_examples(papers: DataFrame, matched: DataFrame, n: int = 3) -> DataFrame:
    """(trigger, examples): the first `n` distinct matching names in alphabetical order.

    Names are distinct and cut to the first n before they are gathered.
    """
    names = papers.select(F.explode("affiliations").alias("name")).distinct().join(matched.where("trigger is not null"), "name")
    order = Window.partitionBy("trigger").orderBy("name")
    kept = names.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return kept.groupBy("trigger").agg(F.array_sort(F.collect_list("name")).alias("examples"))


def name_histogram(papers: DataFrame, classified: DataFrame, matched: DataFrame, label: str = UNDER) -> DataFrame:
    """(normalized, n_mentions) of all names of the papers with the label; mentions, not papers."""
    wanted = papers.join(classified.where(F.col("label") == label).select("paper_id"), "paper_id", "left_semi")
    return (
        wanted.select(F.explode("affiliations").alias("name")).join(matched.select("name", "normalized"), "name")
        .groupBy("normalized").agg(F.count("*").alias("n_mentions"))
    )


def most_common(histogram: DataFrame, n: int = 40) -> DataFrame:
    """The n most frequent rows, ties by name: a report."""
    count, name = histogram.columns[1], histogram.columns[0]
    return histogram.orderBy(F.desc(count), name).limit(n)


def _letter_counts(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(letters) + 1), dtype=np.uint8)
    for row, text in zip(out, texts):
        for c in text:
            row[letters.get(c, -1)] = min(255, int(row[letters.get(c, -1)]) + 1)
    return out


def near_misses(histogram: DataFrame, rules: DataFrame, threshold: float = 0.75, min_length: int = 5) -> DataFrame:
    """(normalized, entry, ratio, n_mentions): names whose best sequence ratio to a rule entry reaches the threshold; ties keep the first entry by name.

    The rules go to the tasks behind a check of their number. The letters that a name
    has in common with an entry, wherever they stand, bound the ratio from above:
    that bound is taken for all entries at once, and only entries that it lets
    through are compared, the best bound first.
    """
    entries = sorted(e for e in few(rules.select("entry").distinct(), MAX_RULES) if len(e) >= min_length)

    def best(batches):
        letters = {c: i for i, c in enumerate(sorted(set("".join(entries))))}
        # letters of no entry are counted last and never shared
        counts, lengths = _letter_counts(entries, letters)[:, :-1], np.array([len(e) for e in entries])
        matcher = SequenceMatcher(None, autojunk=True)
        for pdf in batches:
            out = []
            for name, count in zip(pdf["normalized"], pdf["n_mentions"]):
                bound = 2 * np.minimum(counts, _letter_counts([name], letters)[:, :-1]).sum(axis=1) / np.maximum(1, lengths + len(name))
                top, entry = 0.0, None
                able = np.flatnonzero(bound >= threshold - 1e-9)
                for i in able[np.argsort(-bound[able], kind="stable")]:
                    if bound[i] < top - 1e-9:
                        break
                    matcher.set_seqs(name, entries[i])
                    ratio = matcher.ratio()
                    if ratio > top or ratio == top and entries[i] < entry:
                        top, entry = ratio, entries[i]
                if entry is not None and top >= threshold:
                    out.append((name, entry, round(top, 6), count))
            yield pd.DataFrame(out, columns=["normalized", "entry", "ratio", "n_mentions"])

    return histogram.select("normalized", "n_mentions").mapInPandas(best, "normalized string, entry string, ratio double, n_mentions long")


def coverage_by_stratum(points: DataFrame, stratum: Column | str) -> DataFrame:
    """(stratum, n, labeled_share, priv_share) by stratum; priv_share among the labeled, null without any."""
    s = F.col(stratum) if isinstance(stratum, str) else stratum
    labeled = F.count_if(F.col("label").isin(PRIV, UNDER))
    return points.groupBy(s.alias("stratum")).agg(
        F.count("*").alias("n"), F.round(labeled / F.count("*"), 6).alias("labeled_share"),
        F.round(F.try_divide(F.count_if(F.col("label") == PRIV).cast("double"), labeled), 6).alias("priv_share"),
    )
