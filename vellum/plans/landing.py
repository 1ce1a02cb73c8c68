"""The query of pages that land little by little, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import new_folder
from ..sources.tables import table
from ..streaming.pages import land
from .extract import META_SQL

# Six arrivals: (minute, which pages, whose URL begins how, minutes that they are late). Every page lands in one of the first four. Some land again half an hour
# later, some too late for the watermark, and some again when they are long forgotten, after an arrival that has moved the watermark on.
_ARRIVALS = (
    *((30 * k, f"page_id % 4 = {k}", "p", 0) for k in range(4)),
    *((30 * k + 30, f"page_id % 4 = {k} AND page_id % 3 = 0", "p", 0) for k in range(3)),
    (90, "page_id % 7 = 0", "late", 290),
    (360, "page_id % 50 = 1", "later", 0),
    (400, "page_id % 5 = 0", "p", 0),
)
#: Parts of the remembered URLs; a table of a whole site has more.
PARTS = 4
#: The minute from which arrivals count: a stream's watermark begins with the epoch.
_FIRST = 10_000_000


def fresh_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they were taken in by six passes over a folder that fills, each a stream that begins where the one before ended."""
    pages = table(spark, sf_dir, "pages")
    folder, out, checkpoint = (new_folder(spark, name) for name in ("landing", "fresh", "passes"))
    for minute in sorted({a[0] for a in _ARRIVALS}):
        rows = None
        for at, which, name, late in _ARRIVALS:
            if at == minute:
                url = F.concat(F.lit(f"http://m.pages.example/{name}/"), F.col("page_id").cast("string"), F.lit(f"?at={minute}"))
                part = pages.where(which).select("page_id", url.alias("url"), "html", F.timestamp_seconds(F.lit(60 * (_FIRST + minute - late))).alias("landed"))
                rows = part if rows is None else rows.unionByName(part)
        rows.write.mode("append").parquet(folder)
        land(spark, folder, out, checkpoint, partitions=PARTS)
    fresh = spark.read.schema("landed timestamp, url string, title string").parquet(out)
    return fresh.select((F.unix_seconds("landed") / 60 - _FIRST).cast("long").alias("minute"), "url", "title")


QUERIES = {"fresh_landings": fresh_landings}

ORACLE = {
    # Each page at its first landing, those that came after the watermark not at all, and what had been forgotten once more.
    "fresh_landings": f"""
WITH l AS (
  SELECT 30 * (page_id % 4) AS minute, 'p' AS name, page_id FROM pages
  UNION ALL SELECT 360, 'later', page_id FROM pages WHERE page_id % 50 = 1
  UNION ALL SELECT 400, 'p', page_id FROM pages WHERE page_id % 5 = 0)
SELECT minute::BIGINT AS minute, 'http://www.pages.example/' || name || '/' || page_id AS url, m.title
FROM l JOIN (SELECT page_id, title FROM ({META_SQL})) m USING (page_id)""",
}
