"""All queries of the engine proper with their SQL counterparts.

A query module offers ``QUERIES``: name -> (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

from rollbook.plans import coverage, listed, matrices, members, places, publications, records, rollcalls, rosters, texts, timelines, votes

MODULES = (votes, members, listed, timelines, coverage, records, texts, rollcalls, rosters, matrices, publications, places)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
