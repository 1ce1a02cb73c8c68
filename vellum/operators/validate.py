"""Validation of numbering and of cross-references; issues are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .segment import gaps


def sequence_issues(refs: DataFrame, whole: bool | None = None) -> DataFrame:
    """(package, unit, kind, number, detail) of refs(package, unit, ord, number, href).

    duplicate: a number that several references have, with their targets in order. order: a reference
    whose number is neither its predecessor's nor the one after that, with the predecessor's.
    missing: the first of a run of numbers between the least and the greatest that none has, with the last if there are
    several: a run is one row, however long. Numbering may begin anywhere.
    """
    whole = scan.fits(refs, "package") if whole is None else whole
    rows = refs.select("package", "unit", "number", "ord", "href").where("number IS NOT NULL")
    issue = lambda df, kind, detail: df.select("package", "unit", F.lit(kind).alias("kind"), F.col("number").cast("long").alias("number"), detail.alias("detail"))
    several = rows.groupBy("package", "unit", "number").agg(F.collect_list(F.struct("ord", "href")).alias("items")).where(F.size("items") > 1)
    jumps = scan.running(rows, ["package", "unit"], ["ord", "href"], whole, _before=scan.previous(F.col("number"))).withColumn("before", F.col("_before.x")).where("number <> before AND number <> before + 1")
    runs = gaps(rows, ["package", "unit"]).withColumnRenamed("first", "number")
    last = F.when(F.col("last") > F.col("number"), F.concat_ws(" ", F.lit("to"), F.col("last").cast("string"))).otherwise("")
    found = issue(several, "duplicate", F.array_join(F.transform(F.sort_array("items"), lambda i: i["href"]), "; "))
    return found.unionByName(issue(jumps, "order", F.concat_ws(" ", F.lit("after"), F.col("before").cast("string")))).unionByName(issue(runs, "missing", last))


def cross_reference_issues(refs: DataFrame) -> DataFrame:
    """(package, kind, href, number, other): refs(package, source, ord, href, number) of the sources nav, ncx and document held against each other.

    Of several ncx references to one target the last counts. Every nav reference should have an
    ncx one and a document, of its number; every ncx reference a nav one.
    """
    of = lambda s: F.col("source") == s
    number = F.col("number").cast("long")
    # What is said of a target is a row; references then meet it one by one, so that one with very many of them is never an array.
    targets = refs.groupBy(F.col("package").alias("of"), F.col("href").alias("target")).agg(
        F.count_if(of("nav")).alias("n_nav"),
        F.max_by(F.when(of("ncx"), number), F.when(of("ncx"), F.col("ord"))).alias("ncx"),
        F.min_by(F.when(of("document"), number), F.when(of("document"), F.col("ord"))).alias("document"),
    )
    rows = refs.where(of("nav") | of("ncx")).select("package", "href", "source", number.alias("n"))
    rows = rows.join(targets, F.col("package").eqNullSafe(F.col("of")) & F.col("href").eqNullSafe(F.col("target")))
    none, n, ncx, document = F.lit(None).cast("long"), F.col("n"), F.col("ncx"), F.col("document")
    issue = lambda kind, other: F.struct(F.lit(kind).alias("kind"), n.alias("number"), other.alias("other"))
    of_nav = F.array_compact(
        F.array(
            F.when(ncx.isNull(), issue("missing from ncx", none)).when(ncx != n, issue("ncx number", ncx)),
            F.when(document.isNull(), issue("missing document", none)).when(document != n, issue("document number", document)),
        )
    )
    lone = F.array_compact(F.array(F.when(F.col("n_nav") == 0, issue("missing from nav", none))))
    return rows.select("package", "href", F.explode(F.when(of("nav"), of_nav).otherwise(lone)).alias("i")).select("package", "i.kind", "href", "i.number", "i.other")


def report(issues: DataFrame, refs: DataFrame) -> DataFrame:
    """(package, n_refs, n_issues, failed): every package, and how many references and issues it has."""
    counted = issues.groupBy("package").agg(F.count("*").alias("n_issues"))
    return refs.groupBy("package").agg(F.count("*").alias("n_refs")).join(counted, "package", "left").select("package", "n_refs", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (F.coalesce("n_issues", F.lit(0)) > 0).alias("failed"))


def totals(report: DataFrame) -> DataFrame:
    """(n_packages, n_failed, n_refs, n_issues): what a report of all packages comes to; one row, zeros for none."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return report.agg(F.count("*").alias("n_packages"), F.count_if("failed").alias("n_failed"), count("n_refs").alias("n_refs"), count("n_issues").alias("n_issues"))


def package_issues(refs: DataFrame) -> DataFrame:
    """(package, kind, href, number, detail): all that is wrong with packages whose refs(package, source, ord, href, title, number, unit) are given.

    Contents lists are held against their own numbering, and against the ncx and the documents; of the titles only those with a number count.
    damaged: a file or an entry that can't be read: "not a package", "checksum", "markup" for what isn't well-formed, or the error. A document of
    another unit than its reference is of another number.
    """
    numbered = refs.where("number IS NOT NULL")
    none = F.lit(None).cast("long")
    told = F.when(F.col("href") == "", F.regexp_extract("title", "^[^:]*", 0)).when(F.col("title") == "checksum", "checksum").when(F.col("title").rlike(r": line \d+, column \d+$"), "markup").otherwise(F.col("title"))
    damaged = refs.where("source = 'error'").select("package", F.lit("damaged").alias("kind"), "href", none.alias("number"), told.alias("detail"))
    sequence = sequence_issues(numbered.where("source = 'nav'")).select("package", "kind", F.lit("").alias("href"), "number", F.trim(F.concat_ws(" ", "unit", "detail")).alias("detail"))
    crossed = cross_reference_issues(numbered).select("package", "kind", "href", "number", F.coalesce(F.col("other").cast("string"), F.lit("")).alias("detail"))
    return damaged.unionByName(sequence).unionByName(crossed)


def package_report(refs: DataFrame) -> DataFrame:
    """report of packages, those that can't be read among them; n_refs are the numbered references of the contents lists."""
    issues = package_issues(refs).groupBy(F.col("package").alias("of")).agg(F.count("*").alias("n_issues"))
    own = refs.groupBy("package").agg(F.count_if((F.col("source") == "nav") & F.col("number").isNotNull()).alias("n_refs"))
    found = own.join(issues, F.col("package") == F.col("of"), "left").select("package", "n_refs", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
    return found.withColumn("failed", F.col("n_issues") > 0)
