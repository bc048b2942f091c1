"""How distinctive a term is per record (problem 4).

Weighted log-odds of a record against the rest of the collection with an informative Dirichlet
prior from the collection's own counts, divided by its standard error (z-scores):

    prior_w = strength * count_w / total
    delta   = ln((y + prior_w) / (n + strength - y - prior_w)) - ln((r + prior_w) / (N + strength - r - prior_w))
    z       = delta / sqrt(1 / (y + prior_w) + 1 / (r + prior_w))

with y of the record's n tokens being the term, and r of the rest's N tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.normal_form import look_alikes, reading_form
from samewise.session import cut

#: Longest runs of Latin letters (accented ones of U+00C0 to U+017F, without the signs for times and division) and digits.
RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-ſ0-9]+")
_DIGIT = re.compile("[0-9]")
#: All that terms are made of: such runs, runs of ideographs, and runs of letters of other scripts.
WORDS = re.compile("[A-Za-zÀ-ÖØ-öø-ſ0-9]+|([\u3400-\u4dbf\u4e00-\u9fff]+)|[^\\W_]+")


def latin_words(form: str, least: int = 4) -> list[str]:
    """Runs of at least ``least`` characters and no digit, in lower case."""
    return [t.lower() for t in RUNS.findall(form) if len(t) >= least and not _DIGIT.search(t)]


def all_terms(form: str) -> list[str]:
    """Every word in lower case; of a run of ideographs, which has no blanks, each two neighbours."""
    out: list[str] = []
    for m in WORDS.finditer(form):
        w = m[0]
        out += [w[i : i + 2] for i in range(len(w) - 1)] if m[1] and len(w) > 2 else [w.lower()]
    return out


def terms(df: DataFrame, key: str, text: str, of: Callable[[str], list[str]] = all_terms) -> DataFrame:
    """(record, term, y, n): counts of the terms of each record, which is a key with one of its texts, and of all its terms.

    Terms are taken from the text's one form. Repeated rows count once. Null, empty and termless texts have no rows.
    """
    table = look_alikes(df.sparkSession)

    @F.pandas_udf("array<struct<term: string, y: int>>")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"term": w, "y": y} for w, y in Counter(of(reading_form(t, table))).items()])

    rows = df.select(F.col(f"`{key}`").alias("record"), F.col(f"`{text}`").alias("raw")).filter("record is not null and raw is not null").distinct().select("record", count("raw").alias("ts"))
    one = rows.select("record", F.aggregate("ts", F.lit(0), lambda s, t: s + t["y"]).alias("n"), F.explode("ts").alias("t"))
    return one.select("record", "t.term", "t.y", "n")


def distinctiveness(df: DataFrame, key: str, text: str, strength: float = 1000.0, of: Callable[[str], list[str]] = all_terms) -> DataFrame:
    """(record, term, y, n, records, z): every term of every record with its number of records and its z-score.

    The terms are read and written once. The counts of the collection are partial aggregates, so a term of a third of all records is combined before its
    shuffle; in the join that hands them back such a term is split by the adaptive skew join. Ties have equal scores.
    """
    one = cut(terms(df, key, text, of))
    stats = one.groupBy("term").agg(F.sum("y").alias("count"), F.count("*").alias("records"))
    total = one.agg(F.sum("y").alias("total"))
    stats = stats.crossJoin(F.broadcast(total))  # one row
    prior = strength * F.col("count") / F.col("total")
    rest, rest_all = F.col("count") - F.col("y"), F.col("total") - F.col("n")
    delta = F.log((F.col("y") + prior) / (F.col("n") + strength - F.col("y") - prior)) - F.log((rest + prior) / (rest_all + strength - rest - prior))
    z = F.when(F.col("total") > F.col("count"), delta / F.sqrt(1 / (F.col("y") + prior) + 1 / (rest + prior))).otherwise(0.0)
    return one.join(stats, "term").select("record", "term", "y", "n", "records", z.alias("z"))


def p4_scores(listings: DataFrame, of: Callable[[str], list[str]] = all_terms) -> DataFrame:
    """(sku_id, term, records, z) of every term of every title: words of all scripts, and neighbouring ideographs."""
    return distinctiveness(listings, "sku_id", "sku_name_chi", of=of).select(F.col("record").alias("sku_id"), "term", "records", F.round("z", 6).alias("z"))


def p4_found(listings: DataFrame, lo: int = 2, hi: int = 4) -> DataFrame:
    """(sku_id, term): the words of Latin letters that stand in the titles of lo to hi listings.

    The range of listings alone decides, by definition; that every term has a score is the operator's part.
    """
    return p4_scores(listings, latin_words).filter(F.col("records").between(lo, hi) & F.col("z").isNotNull()).select("sku_id", "term")
