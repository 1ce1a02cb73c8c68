"""Every query of the library by name, with the SQL that gives the same rows."""

from .plans import books, extract, landing, publish, search, segment

_PLANS = (extract, search, segment, publish, books, landing)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
