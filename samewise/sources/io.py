"""Tables in and out: listings, labels, earlier groups, reports, caches, manifests."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.text import col

LISTING_COLUMNS = ("category_code", "category_path", "sku_id", "sku_name_chi", "brand_name_chi", "pack_size_chi", "origin_chi", "summary_chi", "description_chi", "main_image_url")
GROUP_COLUMNS = ("sku_id", "group_id", "group_name", "group_size", "brand_canonical", "product_form", "unit", "origin", "pack_count", "ean", "sku_name", "method_version", "dataset_sha256")
LABELS = "sku_a string, sku_b string, label int, evidence string"


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of an xlsx, csv or parquet table: all texts trimmed, blank ones null, rows without any text dropped, row_ord kept or given."""
    if path.endswith(".xlsx"):
        from samewise.sources import xlsx

        xlsx.register(spark)
        df = spark.read.format("xlsx").option("path", path).load()
    elif path.endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        df = spark.read.parquet(path)
    names = [c for c, t in df.dtypes if t == "string"]
    df = df.withColumns({c: F.nullif(F.trim(col(f"`{c}`")), F.lit("")) for c in names}).filter(F.coalesce(*[F.col(f"`{c}`") for c in names]).isNotNull())
    return df if "row_ord" in df.columns else df.withColumn("row_ord", F.monotonically_increasing_id())


def read_label_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct label pairs, smaller key first."""
    raw = spark.read.csv(path, schema=LABELS, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return raw.select(F.least("sku_a", "sku_b").alias("sku_a"), F.greatest("sku_a", "sku_b").alias("sku_b"), "label", "evidence").distinct()


def read_previous(spark: SparkSession, path: str | None) -> DataFrame:
    """(sku_id, group_id) of an earlier run; a missing table is an empty one."""
    empty = spark.createDataFrame([], "sku_id string, group_id string")
    if not path:
        return empty
    try:
        df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    return df.select("sku_id", "group_id").distinct()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True)
    if "metrics" not in df.columns:
        raise ValueError(f"{path} has no metrics")
    return df


def mapping_faults(groups: DataFrame, listings: DataFrame) -> DataFrame:
    """(fault, n): repeated keys, blank ids, listings without a group, groups of unknown listings. No rows: valid."""
    want = listings.filter("sku_id is not null").select("sku_id").distinct()
    rows = [
        groups.groupBy("sku_id").count().filter("count > 1").agg(F.lit("repeated").alias("fault"), F.count("*").alias("n")),
        groups.filter("sku_id is null or trim(sku_id) = '' or group_id is null or trim(group_id) = ''").agg(F.lit("blank").alias("fault"), F.count("*").alias("n")),
        want.join(groups, "sku_id", "left_anti").agg(F.lit("missing").alias("fault"), F.count("*").alias("n")),
        groups.join(want, "sku_id", "left_anti").agg(F.lit("unknown").alias("fault"), F.count("*").alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("n > 0")


def validate_mapping(groups: DataFrame, listings: DataFrame) -> None:
    if faults := mapping_faults(groups, listings).collect():
        raise ValueError("; ".join(f"{r.n} {r.fault}" for r in faults))


# -- sinks


def groups_table(clusters: DataFrame, ids: DataFrame, names: DataFrame, attributes: DataFrame, version: str, sha: str) -> DataFrame:
    """The 13 columns of a finished grouping, larger groups first."""
    from samewise.functions.text import plain_number

    size = clusters.groupBy("cluster").agg(F.count("*").cast("int").alias("group_size"))
    rows = clusters.join(ids, "cluster").join(names.select("cluster", F.col("name").alias("group_name")), "cluster").join(size, "cluster").join(attributes, "sku_id")
    unit = F.coalesce(F.concat(plain_number("unit_value"), "unit_uom"), F.lit(""))
    rows = rows.select("sku_id", "group_id", "group_name", "group_size", "brand_canonical", F.col("form").alias("product_form"), unit.alias("unit"), F.array_join("origin", "/").alias("origin"), "pack_count", F.array_join("ean_all", ";").alias("ean"), F.col("title").alias("sku_name"), F.lit(version).alias("method_version"), F.lit(sha).alias("dataset_sha256"))
    return rows.orderBy(F.desc("group_size"), "group_id", "sku_id")


def candidate_scores_table(scores: DataFrame) -> DataFrame:
    """sku_a, sku_b, score (eight decimals, blank where vetoed), sources joined by ;, cosine."""
    return scores.select("sku_a", "sku_b", F.when(F.col("vetoed"), "").otherwise(F.format_string("%.8f", "score")).alias("score"), F.array_join(F.array_sort("sources"), ";").alias("sources"), F.col("embedding_cosine")).orderBy("sku_a", "sku_b")


def write_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """csv or parquet by the path's ending; partitioned, unless a small artefact is wanted as one file."""
    w = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    w.option("header", True).csv(path) if path.endswith(".csv") else w.parquet(path)


def content_hash(df: DataFrame) -> str:
    """Order-insensitive fingerprint of a table's rows: count, xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, x, s = df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(2**31)))).first()
    return f"{n}-{x or 0:x}-{s or 0:x}"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of a file or of all files of a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter(~F.col("file").rlike("^[_.]"))


def dataset_sha256(spark: SparkSession, path: str) -> str:
    """The sha256 of a file; of a folder that of its files' sorted digests."""
    digests = sorted(r.sha256 for r in file_digests(spark, path).select("sha256").collect())
    return digests[0] if len(digests) == 1 else hashlib.sha256("\n".join(digests).encode()).hexdigest()


def write_manifest(path: str, tables: dict[str, DataFrame], files: dict[str, str] | None = None) -> dict:
    """Row counts and row fingerprints of tables, and the sha256 of the files of inputs and outputs, as JSON."""
    out: dict = {name: {"rows": df.count(), "fingerprint": content_hash(df)} for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    for name, where in (files or {}).items():
        out.setdefault(name, {})["sha256"] = dataset_sha256(spark, where)
    write_json(path, out)
    return out


def write_json(path: str, value: dict) -> None:
    """A driver-side artefact (a report, a model), written whole or not at all."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(f"{path}.tmp").write_text(json.dumps(value, ensure_ascii=False, indent=1))
    os.replace(f"{path}.tmp", path)


def export_listings(listings: DataFrame, groups: DataFrame) -> DataFrame:
    """The listings' ten columns in order and exactly two more."""
    return listings.join(groups.select("sku_id", "group_id", "group_name"), "sku_id", "left").select(*[c for c in LISTING_COLUMNS if c in listings.columns], "group_id", "group_name")


def export_workbook(listings: DataFrame, groups: DataFrame, path: str) -> int:
    """The delivered workbook: every listing in its order with group id and name. An incomplete mapping, or rows whose order cannot be told, are refused."""
    from samewise.sources import xlsx

    validate_mapping(groups, listings)
    if "row_ord" not in listings.columns:
        raise ValueError("listings have no row_ord, so their order cannot be kept")
    rows = listings.join(groups.select("sku_id", "group_id", "group_name"), "sku_id", "left").select("row_ord", *[c for c in LISTING_COLUMNS if c in listings.columns], "group_id", "group_name")
    return xlsx.write(rows, path, ["row_ord"])


def check_order(before: DataFrame, after: DataFrame, order: str = "row_ord", key: str = "sku_id") -> None:
    """Refuse a processed table whose rows stand in another order than the listings it was made of."""
    moved = before.select(order, F.col(key).alias("was")).join(after.select(order, key), order, "full").filter(~F.col("was").eqNullSafe(F.col(key))).count()
    if moved:
        raise ValueError(f"{moved} rows stand in another place than before")


def metrics_rows(rows: DataFrame, digits: int = 4) -> DataFrame:
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@dataclass(frozen=True)
class Paths:
    """Where a run writes: switches that are not the default get folders of their own, so that no experiment overwrites a default run."""

    root: str
    method: str
    use_form: bool = True
    use_ann: bool = True
    use_records: bool = False

    @property
    def folder(self) -> str:
        extra = "".join(x for x, on in (("-no-form", not self.use_form), ("-exact", not self.use_ann), ("-records", self.use_records)) if on)
        return f"{self.root}/{'experiments/' if extra else ''}{self.method}{extra}"

    def of(self, name: str) -> str:
        return f"{self.folder}/{name}"


def review_method(path: str, fallback: str = "hybrid_fusion") -> str:
    """The best method of a metrics JSON, the fallback where there is none."""
    try:
        return json.loads(Path(path).read_text()).get("best_method") or fallback
    except (OSError, ValueError, AttributeError):
        return fallback


def secret(name: str) -> str | None:
    """A service's key from the driver's environment; never logged or put into a plan."""
    return os.environ.get(name) or None
