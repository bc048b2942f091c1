"""Listings to attribute records, and the processed table with its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.config import DEFAULT_PACK, DomainPack
from samewise.functions import extract as X
from samewise.functions import text as T
from samewise.session import cut

TEXTS = ("sku_name_chi", "brand_name_chi", "pack_size_chi", "origin_chi", "summary_chi", "description_chi")


def latest(listings: DataFrame, key: str = "sku_id", order: str = "row_ord") -> DataFrame:
    """One row for each key: the first delivery in row order."""
    w = Window.partitionBy(key).orderBy(order)
    return listings.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, votes): the most frequent value of each key; ties go to the one that came first in row order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "first", value)
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(key, value, "votes")


def first_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the first row of each key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def build_attributes(listings: DataFrame, use_form: bool = True, pack: DomainPack = DEFAULT_PACK, order: str = "row_ord") -> DataFrame:
    """The attribute record of each listing: codes, brand, content, pack count, form, places.

    Missing is never a conflict: unknown form, content or place are UNKNOWN, null and []. ``use_form=False`` blanks the form.
    Two joins: a listing's code prefix to the prefix's brand (votes of all listings), short codes to the pool's suffixes.
    """
    df = latest(listings, order=order)
    df = df.withColumns({f"n_{c}": T.nfkc(c) for c in TEXTS})
    unit = F.coalesce(
        *[
            F.when(u.isNotNull(), F.struct(u["value"].alias("value"), u["uom"].alias("uom"), u["n"].alias("n"), F.lit(src).alias("source")))
            for src, u in (("name", X.unit_of(T.clean_title("n_sku_name_chi", pack), pack)), ("pack_size", X.unit_of(F.col("n_pack_size_chi"), pack)), ("summary", X.unit_of(F.col("n_summary_chi"), pack)), ("description", X.unit_of(F.col("n_description_chi"), pack)))
        ]
    )
    form = X.form_of(F.col("n_sku_name_chi"), F.col("n_summary_chi"), pack) if use_form else F.struct(F.lit("UNKNOWN").alias("form"), F.lit(0.0).alias("conf"), F.lit(None).cast("string").alias("source"))
    df = df.select(
        "sku_id",
        F.col(order).alias("row_ord"),
        F.col("n_sku_name_chi").alias("title"),
        F.col("n_brand_name_chi").alias("brand_raw"),
        F.col("n_summary_chi").alias("summary"),
        T.clean_title("n_sku_name_chi", pack).alias("clean_title"),
        X.eans("sku_id", "n_sku_name_chi", "n_summary_chi", "n_pack_size_chi", "n_description_chi").alias("ean"),
        X.short_codes("n_sku_name_chi", "n_summary_chi").alias("codes"),
        X.brand_key(F.col("n_brand_name_chi"), pack).alias("brand_key"),
        unit.alias("unit"),
        X.pack_count("n_sku_name_chi", "n_pack_size_chi", pack=pack).alias("told_count"),
        form.alias("f"),
        X.origins("n_origin_chi", pack).alias("origin"),
    )
    # a barrier: the joins below read these rows five times, and reading texts costs far more than a table
    df = X.propagate_eans(cut(df))
    df = df.withColumn("gs1", X.gs1_prefix(F.array_min("ean_all")))
    prefixes = df.filter("brand_key <> ''").select(F.explode("ean").alias("e"), "brand_raw", "row_ord").withColumn("gs1", X.gs1_prefix("e"))
    canonical = majority(prefixes, "gs1", "brand_raw", "row_ord").select("gs1", F.col("brand_raw").alias("gs1_brand"))
    df = df.join(canonical, "gs1", "left")
    named = F.when(F.col("brand_key") != "", F.col("brand_raw"))
    return df.select(
        "sku_id",
        "row_ord",
        "title",
        "clean_title",
        "summary",
        "brand_raw",
        "brand_key",
        F.coalesce("gs1_brand", named).alias("brand_canonical"),
        F.when(F.col("gs1_brand").isNotNull(), "gs1").when(named.isNotNull(), "field").alias("brand_source"),
        F.when(F.col("gs1_brand").isNotNull(), F.concat(F.lit("GS1:"), "gs1")).otherwise(F.col("brand_key")).alias("brand_id"),
        "ean",
        "ean_all",
        "ean_source",
        "gs1",
        F.col("unit.value").alias("unit_value"),
        F.col("unit.uom").alias("unit_uom"),
        F.col("unit.source").alias("unit_source"),
        F.coalesce("unit.n", "told_count").alias("pack_count"),
        F.col("f.form").alias("form"),
        F.col("f.conf").alias("form_conf"),
        F.col("f.source").alias("form_source"),
        "origin",
    )


def processed(listings: DataFrame, attributes: DataFrame, signatures: DataFrame) -> DataFrame:
    """The listings' columns and twelve derived ones; sets as sorted joined text."""
    derived = attributes.join(signatures, "sku_id", "left").select(
        "sku_id",
        "clean_title",
        F.array_join("ean_all", ";").alias("ean"),
        "ean_source",
        "brand_canonical",
        "brand_key",
        "unit_value",
        "unit_uom",
        "pack_count",
        F.col("form").alias("product_form"),
        F.col("form_conf").alias("form_confidence"),
        F.array_join("origin", "/").alias("origin_normalized"),
        F.array_join(F.coalesce("signature", F.array().cast("array<string>")), ";").alias("variant_signature"),
    )
    return latest(listings).join(derived, "sku_id", "left")


def processed_faults(listings: DataFrame, done: DataFrame) -> DataFrame:
    """(fault, n) of a processed table against its listings: lost or added rows, repeated keys, missing required values. No rows: valid."""
    want = listings.filter("sku_id is not null").select("sku_id").distinct()
    checks = [
        want.join(done, "sku_id", "left_anti").agg(F.lit("missing").alias("fault"), F.count("*").alias("n")),
        done.join(want, "sku_id", "left_anti").agg(F.lit("added").alias("fault"), F.count("*").alias("n")),
        done.groupBy("sku_id").count().filter("count > 1").agg(F.lit("repeated").alias("fault"), F.count("*").alias("n")),
        done.filter("clean_title is null or product_form is null or pack_count is null").agg(F.lit("null").alias("fault"), F.count("*").alias("n")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.filter("n > 0")
