"""Mixing sources to target weights (problem 8) by weighted fair queueing.

Every use of a document (a source of up to ``max_repeats`` passes, each shuffled anew) gets a virtual
finish time: the tokens of its source up to and with this use, divided by the source's target
weight. The mix is all uses with a finish time within the budget, in the order of finish times.

The running sums are exact and distributed: uses fall into buckets by their shuffle key, the totals of
the buckets (few numbers a source) are summed up once, and only inside a bucket a window runs.
No task ever holds a whole source, and no row is dropped to escape skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.tokens import TOKENIZER, token_count

#: Uses a bucket holds on average.
BUCKET_ROWS = 20_000


def uses(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """All allowed uses of the documents: source, doc_id, tokens, pass, finish, for sources with a positive target.

    ``sized`` has doc_id, source and tokens. Documents without source or of an unlisted one take no part; empty ones cost nothing
    and are used. Equal shuffle keys are ordered by doc_id, repeated ids by their size.
    """
    t = targets.select("source", F.col("target_share").cast("double").alias("weight"), F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats")).filter("source is not null and weight > 0 and max_repeats > 0")
    rows = sized.select("doc_id", "source", "tokens").join(t, "source").withColumn("pass", F.explode(F.sequence(F.lit(1), "max_repeats"))).withColumn("key", F.xxhash64("doc_id", "pass", F.lit(seed)))
    # a pass of a source is a row of its own in the totals: passes follow each other
    per = rows.groupBy("source", "pass").agg(F.count("*").alias("n"))
    rows = rows.join(F.broadcast(per), ["source", "pass"])  # sources x passes: the size of the table of targets
    rows = rows.withColumn("bucket", F.floor((F.col("key").cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / BUCKET_ROWS)))
    totals = rows.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("t"))
    before = totals.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "pass", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("inside", F.sum("tokens").over(inside)).join(before, ["source", "pass", "bucket"]).select("source", "doc_id", "tokens", "pass", ((F.col("before") + F.col("inside")) / F.col("weight")).alias("finish"))


def capacities(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, available (tokens of one pass), docs: one row for each target."""
    per = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"))
    return targets.filter("source is not null").join(per, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("docs", F.lit(0)).alias("docs"))


def largest_budget(capacity: DataFrame) -> float:
    """The tokens of the largest mix that meets every target that can be met: the least of capacity / share. One number reaches the driver.

    Sources that can give no token take no part in the minimum; ``report`` tells that they are not met.
    """
    got = capacity.filter("target_share > 0 and available > 0 and max_repeats > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).first()[0]
    return float(got or 0.0)


def whole_budget(capacity: DataFrame) -> float:
    """All tokens of the listed sources: a mix as large as the corpus, in which scarce sources are repeated and may still run dry."""
    return float(capacity.filter("target_share > 0").agg(F.sum("available")).first()[0] or 0.0)


def mix(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, pass, tokens, finish) of the mix, range-sorted by finish time.

    Without a budget, the largest that meets every target of a source that has tokens to give. With a larger one, sources that run dry stay below their share.
    """
    if budget is None:
        budget = largest_budget(capacities(sized, targets))
    return uses(sized, targets, seed).filter(F.col("finish") <= F.lit(float(budget))).orderBy("finish", "source", "pass", "doc_id").select("doc_id", "source", "pass", "tokens", "finish")


def report(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17) -> DataFrame:
    """One row for each target: wanted and actual share, tokens and uses, highest pass, and whether the target was met.

    ``met`` is false where the source ran dry before its share of the budget, and for every positive target of a mix without tokens; shares of an empty
    mix are 0. ``short`` is how many tokens the source's share of the budget lacks.
    """
    capacity = capacities(sized, targets)
    if budget is None:
        budget = largest_budget(capacity)
    got = uses(sized, targets, seed).filter(F.col("finish") <= F.lit(float(budget))).groupBy("source").agg(F.sum("tokens").alias("mixed"), F.count("*").alias("uses"), F.max("pass").alias("passes"))
    rows = capacity.join(got, "source", "left").fillna(0, ["mixed", "uses", "passes"])
    total = rows.agg(F.sum("mixed").alias("total"))
    given = F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    asked = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)) * F.lit(float(budget))
    return rows.crossJoin(F.broadcast(total)).select(
        "source",
        "target_share",
        "max_repeats",
        "docs",
        "available",
        "mixed",
        "uses",
        F.col("passes").cast("int").alias("passes"),
        F.when(F.col("total") > 0, F.round(F.col("mixed") / F.col("total"), 6)).otherwise(0.0).alias("actual_share"),
        ((F.coalesce("target_share", F.lit(0.0)) <= 0) | ((F.col("total") > 0) & (given >= asked - 1e-6))).alias("met"),
        F.greatest(F.ceil(asked - given - 1e-6), F.lit(0)).cast("bigint").alias("short"),
    )


def sized_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return documents.select("doc_id", "source", token_count("text", path).alias("tokens"))
