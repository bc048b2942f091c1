"""Queries of the text-preparation operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from samewise.llm import brands, components, distinct_terms, mixing, normal_form, same_product, sentences, tokens
from samewise.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.p1_found(table(spark, sf_dir, "listings"), table(spark, sf_dir, "sku_groups"), table(spark, sf_dir, "brand_ref"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_form.p2_found(table(spark, sf_dir, "listings"), table(spark, sf_dir, "brand_ref"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.p3_found(table(spark, sf_dir, "candidate_pairs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_terms.p4_found(table(spark, sf_dir, "listings"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_terms.p4_scores(table(spark, sf_dir, "listings"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_product.p5_found(table(spark, sf_dir, "listings"), table(spark, sf_dir, "brand_ref"), table(spark, sf_dir, "unit_ref"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.p7_ids(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(cut(mixing.sized_documents(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(cut(mixing.sized_documents(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets"))


def p8_shares_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mix as large as the corpus: sources that run dry are reported as not met."""
    sized, targets = cut(mixing.sized_documents(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets")
    return mixing.report(sized, targets, mixing.whole_budget(mixing.capacities(sized, targets)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.p9_found(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_shares_whole": p8_shares_whole, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            with recursive e as (select sku_a a, sku_b b from candidate_pairs where score >= 0.5 and sku_a is not null and sku_b is not null and sku_a <> sku_b
                                 union select sku_b, sku_a from candidate_pairs where score >= 0.5 and sku_a is not null and sku_b is not null and sku_a <> sku_b),
            r(x, y) as (select distinct a, a from e union select r.x, e.b from r join e on r.y = e.a)
            select x as sku_id, min(y) as component_id from r group by x
        """
    }
