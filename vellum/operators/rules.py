"""Extraction by a table of rules: a new source is rows, not code."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import selectors

#: A rule: of the pages of a source, the field that it fills; the elements' selector; the attribute that is the value, or null for the text; a pattern whose
#: first group is the value, or null; how many values there are at most, or null; the attribute that is given beside it; whether only the first of each of that counts; its turn, if a field has several.
RULES = "source string, field string, turn int, selector string, attribute string, pattern string, most int, beside string, once boolean"
_RULE = "array<struct<field:string,turn:int,selector:string,attribute:string,pattern:string,most:int,beside:string,once:boolean>>"


def filled(page: str, rules: list) -> Iterator[tuple[str, int, str, str | None]]:
    """(field, ord, value, beside) of a page: of a field's rules the first in turn that finds anything. Empty values don't count."""
    found = selectors.elements(page)
    done: set[str] = set()
    for rule in sorted(rules, key=lambda r: (r["field"], r["turn"] or 0)):
        if rule["field"] in done:
            continue
        n, seen = 0, set()
        for e in selectors.selected(found, rule["selector"]):
            value = selectors.text_of(e.inside) if rule["attribute"] is None else e.attributes.get(rule["attribute"], "")
            if rule["pattern"] is not None:
                m = re.search(rule["pattern"], value)
                value = " ".join((m[1] or "").split()) if m else ""
            beside = e.attributes.get(rule["beside"]) if rule["beside"] else None
            if not value or rule["beside"] and beside is None or rule["once"] and beside in seen:
                continue
            seen.add(beside)
            n += 1
            yield rule["field"], n, value, beside
            if n == rule["most"]:
                break
        if n:
            done.add(rule["field"])


class _Filled:
    """A page's fields by the rules of its source: of each rule the values, in order."""

    def eval(self, html: str, rules: list) -> Iterator[tuple]:
        if html and rules:
            yield from filled(html, rules)


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(the columns of pages but html, field, ord, value, beside): pages(source, html) by the rules (RULES) of their source.

    Rules of a null source are for pages of sources that have none. Pages whose source has no rules, and null pages, give no rows. The rules are one row a source, joined by it, so they may be many.
    """
    names = [c.split()[0] for c in RULES.split(", ")][1:]
    by_source = rules.groupBy(F.col("source").alias("of")).agg(F.collect_list(F.struct(*names)).cast(_RULE).alias("rules"))
    known = by_source.select(F.col("of").alias("known")).where("known IS NOT NULL")
    rows = pages.join(known, F.col("source") == F.col("known"), "left").join(by_source, F.col("known").eqNullSafe(F.col("of")))
    fill = F.udtf(_Filled, returnType="field string, ord int, value string, beside string")
    rest = [c for c in pages.columns if c != "html"]
    return rows.select(*rest, "html", "rules").lateralJoin(fill(F.col("html").outer(), F.col("rules").outer())).select(*rest, "field", "ord", "value", "beside")
