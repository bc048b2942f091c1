"""Consolidating pairwise matches into groups (problem 3).

Minimum labels are propagated across edges and accelerated with pointer jumping:

* every record's parent becomes the least record among itself and its neighbours (one partial
  aggregate over the edges: a record with a third of all pairs is combined before the shuffle);
* pointers jump (parent := parent of parent) until they rest;
* edges are rewritten between the roots, loops and repeats dropped, and the next round begins on
  what is left, until no label changes.

Records are numbered once in key order, so all rounds shuffle longs and the least number is the
least key. Each round is written to the shared folder
(a checkpoint that keeps true sizes); nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.session import cut, forget


def _numbered(edges: DataFrame) -> DataFrame:
    """(key, id): ids increase with the keys. Range partitions keep the order across partitions, the written table keeps it across retries."""
    keys = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return cut(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id()))


def _rest(parents: DataFrame, max_jumps: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer jumping: (id, parent) with every parent replaced by its root, and the tables it reads.

    A written round holds two jumps of the records whose pointer still moved; one that rests points to its root for good and is not written again.
    """
    resting, tables, moving = None, [parents], parents
    for _ in range(max_jumps):
        everything = moving if resting is None else resting.unionByName(moving)
        up = everything.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        two = moving.withColumn("was", F.col("parent"))
        for _ in range(2):
            two = two.join(up, "parent", "left").select("id", "was", F.coalesce("above", "parent").alias("parent"))
        jumped = cut(two.select("id", "parent", (F.col("parent") != F.col("was")).alias("moved")))
        if resting is None:
            forget(parents)
            tables.clear()
        tables.append(jumped)
        rest, moving = jumped.filter("not moved").drop("moved"), jumped.filter("moved").drop("moved")
        resting = rest if resting is None else resting.unionByName(rest)
        if moving.isEmpty():
            return resting, tables
    raise RuntimeError("pointers still move")


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(member, component_id) for every record of a pair; component_id is the smallest key linked to it.

    Null ends and loops are no pairs, repeated and reversed pairs count once, an empty table gives an empty result.
    """
    edges = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut(edges)
    ids = _numbered(edges)
    left, right = ids.select(F.col("key").alias("a"), F.col("id").alias("u")), ids.select(F.col("key").alias("b"), F.col("id").alias("v"))
    links = cut(edges.join(left, "a").join(right, "b").select("u", "v"))
    forget(edges)
    labels = cut(ids.select("id", F.col("id").alias("label")))
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots, read = _rest(cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("least")).select("id", F.least("id", "least").alias("parent"))))
        relabelled = cut(labels.join(roots.select(F.col("id").alias("label"), "parent"), "label", "left").select("id", F.coalesce("parent", "label").alias("label")))
        ru, rv = roots.select(F.col("id").alias("u"), F.col("parent").alias("ru")), roots.select(F.col("id").alias("v"), F.col("parent").alias("rv"))
        left_over = cut(links.join(ru, "u").join(rv, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        forget(links, labels, *read)
        links, labels = left_over, relabelled
    else:
        raise RuntimeError("labels still change")
    names = ids.select(F.col("id").alias("label"), F.col("key").alias("component_id"))
    return labels.join(ids, "id").join(names, "label").select(F.col("key").alias("member"), "component_id")


def p3_found(candidate_pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sku_id, component_id): a row is a match if both records are given and differ and score >= threshold; null scores are no matches."""
    return components(candidate_pairs.filter(F.col("score") >= threshold), "sku_a", "sku_b").select(F.col("member").alias("sku_id"), "component_id")
