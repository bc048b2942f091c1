"""Increments: new deliveries are matched against the index of what is there, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions import text as T


def first_deliveries(stream: DataFrame, key: str = "sku_id", time: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """A stream without redeliveries that come within the watermark; state is bounded by it."""
    return stream.filter(F.col(key).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def title_keys(df: DataFrame) -> DataFrame:
    return df.select("sku_id", T.fold(T.packfree(T.nfkc("sku_name_chi"))).alias("title_key")).filter("title_key <> ''")


def match_batch(batch: DataFrame, index: DataFrame) -> DataFrame:
    """(sku_id, group_id) of a batch: the group of the index's equal title key, the least where several; else a group of its own by title key."""
    keys = title_keys(batch).dropDuplicates(["sku_id"])
    known = index.join(keys.select("title_key").distinct(), "title_key", "left_semi").groupBy("title_key").agg(F.min("group_id").alias("group_id"))
    return keys.join(known, "title_key", "left").select("sku_id", "title_key", F.coalesce("group_id", F.concat(F.lit("K_"), F.substring(F.sha2("title_key", 256), 1, 16))).alias("group_id"))


def start(stream: DataFrame, index_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Match a stream of listings against a growing parquet index; each batch id is written once, so a repeated batch changes nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            index = spark.read.parquet(index_path).filter(F.col("batch") != batch_id)
        except AnalysisException as e:  # no index yet; any other failure is one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            index = spark.createDataFrame([], "sku_id string, title_key string, group_id string, batch bigint")
        done = match_batch(batch.join(index.select("sku_id"), "sku_id", "left_anti"), index)
        done.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index_path)
        if sink:
            sink(done, batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
