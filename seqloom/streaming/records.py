"""Off-target records that arrive over time: late and resent rows, running totals per guide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "guide_id int, chrom string, start long, strand string, mm int, cfd double, cfd2 double, run_id string, loaded_at timestamp"
KEYS = ["guide_id", "chrom", "start", "strand", "mm", "cfd", "cfd2", "run_id"]


def read(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Records of Parquet files as they appear in a folder, so many at a time."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files).parquet(folder)


def unique(records: DataFrame, late: str = "30 days") -> DataFrame:
    """Records without resent ones; state older than ``late`` before the newest record is dropped."""
    return records.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(KEYS)


def totals(records: DataFrame) -> DataFrame:
    """Running number of records, sum and largest score per guide."""
    known = records.where("guide_id is not null")
    return known.groupBy("guide_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("cfd").alias("cfd_sum"), F.max("cfd").alias("max_cfd"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The totals of every guide from the folders that :func:`write_totals` keeps."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("guide_id", "batch")]
    return rows.groupBy("guide_id").agg(F.max_by(F.struct(*values), "batch").alias("__x")).select("guide_id", "__x.*")


def daily(records: DataFrame, late: str = "30 days") -> DataFrame:
    """Records and score sums per day of arrival, final once a day is ``late`` in the past."""
    day = F.window("loaded_at", "1 day")
    rows = records.withWatermark("loaded_at", late).groupBy(day).agg(F.count(F.lit(1)).alias("rows"), F.sum("cfd").alias("cfd_sum"))
    return rows.select(F.col("window.start").alias("day"), "rows", "cfd_sum")


def write_totals(records: DataFrame, path: str, checkpoint: str, late: str = "30 days"):
    """Keeps the totals of all records seen so far, resent ones left out, in a Parquet folder per batch; a batch that runs again replaces its own.

    A batch holds the guides that it changed: :func:`current` takes the last of each.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return totals(unique(records, late)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
