"""Landed pages as a stream: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators.extract import element, plain, without_noise


def landed_pages(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string, landed timestamp") -> DataFrame:
    """Parquet files of pages as they land."""
    return spark.readStream.schema(schema).parquet(folder)


def fresh_pages(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """(landed, url, title): pages with each canonical URL once while the watermark remembers it; state older than `late` goes."""
    rows = pages.withWatermark("landed", late).withColumn("url", canonical_url(F.col("url")))
    return rows.dropDuplicatesWithinWatermark(["url"]).select("landed", "url", plain(element(without_noise(F.col("html")), "title")).alias("title"))


def landing_counts(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(begins, host, n): pages landed in each window, by host; a window is final when the watermark has passed it."""
    host = F.regexp_extract(canonical_url(F.col("url")), "//www\\.([^/]*)", 1)
    counts = pages.withWatermark("landed", late).groupBy(F.window("landed", window).alias("w"), host.alias("host")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("begins"), "host", "n")


def land(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "1 hour", partitions: int | None = None) -> None:
    """Takes in what has landed in a folder since the last time, and ends: fresh_pages of the new files are added to the table at `out`, which files count is written there, too.

    What has been read, the URLs that are remembered and the watermark are in the checkpoint, so a pass that is broken off is taken up where it was, and no row comes twice or is lost. State is
    bounded by what lands within `late`. `partitions` is the number of its parts, fixed by the first pass; the session's number of shuffle partitions if none is given. Other queries' settings stay as they are.
    """
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    if partitions:
        session.conf.set("spark.sql.shuffle.partitions", partitions)
    stream = fresh_pages(landed_pages(session, folder), late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
