"""Links that lead on from page to page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import shared_folder

#: Rounds after which the parts of the pages seen become one.
MERGE = 10


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def chains(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, place, url): the pages reached from starts(url) by links(from_url, to_url), a page once, at its least distance.

    Each round follows the links of the pages found last and leaves out those seen before, until there is
    no new page: chains of any length are walked to their end, and cycles end.
    """
    links = _cut(links.select("from_url", "to_url").where("to_url IS NOT NULL").distinct())
    found = _cut(starts.select(F.col("url").alias("start"), F.lit(0).alias("place"), "url").distinct())
    seen, place = found, 0
    while not found.isEmpty():
        place += 1
        new = found.join(links, F.col("url") == F.col("from_url")).select("start", F.lit(place).alias("place"), F.col("to_url").alias("url")).distinct()
        found = _cut(new.join(seen.select("start", "url"), ["start", "url"], "left_anti").select("start", "place", "url"))
        seen = seen.unionByName(found)
        if place % MERGE == 0:
            seen = _cut(seen.coalesce(found.sparkSession.sparkContext.defaultParallelism))
    return seen


def paged(starts: DataFrame, links: DataFrame) -> DataFrame:
    """As chains, where a page has one next page: of several links the first by target is followed.

    The links of each round lead twice as far as those of the one before, so a chain of n pages takes as many rounds as n has
    binary digits; a round that finds no new page ends it, as in a cycle.
    """
    jump = _cut(links.where("to_url IS NOT NULL").groupBy("from_url").agg(F.min("to_url").alias("to_url")))
    seen, step = _cut(starts.select(F.col("url").alias("start"), F.lit(0).cast("long").alias("place"), "url").distinct()), 1
    known = seen.count()
    while True:
        more = seen.join(jump, F.col("url") == F.col("from_url")).select("start", (F.col("place") + step).alias("place"), F.col("to_url").alias("url"))
        seen = _cut(seen.unionByName(more).groupBy("start", "url").agg(F.min("place").alias("place")).select("start", "place", "url"))
        now = seen.count()
        if now == known:
            return seen
        known, step = now, 2 * step
        onward = jump.select(F.col("from_url").alias("to_url"), F.col("to_url").alias("further"))
        jump = _cut(jump.join(onward, "to_url").select("from_url", F.col("further").alias("to_url")))


def same_folder(links: DataFrame) -> DataFrame:
    """Links that stay in the folder of their page: a chapter's next page, not the next chapter."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    return links.where(folder(F.col("from_url")) == folder(F.col("to_url")))
