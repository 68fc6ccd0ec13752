"""Whether what was derived equals what is derived again, and whether the pages of a document agree.

Groups of rows are compared by digests that no order changes, so a table of any
size is compared with one row a group on either side, and what differs is named
by its group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(columns: Sequence[str]) -> Column:
    """64 bits of a row; a null is told from any value and from a null in another place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def digests(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, total and mixed of each group: the number of its rows, the sum of their digests and their exclusive or. Equal multisets of rows have equal ones."""
    h = rows.select(*by, row_digest(columns).alias("_h"))
    return h.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("total"), F.bit_xor("_h").alias("mixed"))


def differing_groups(published: DataFrame, recomputed: DataFrame, *, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups whose rows are not the same multiset on both sides, with the number of rows on each; a group that one side lacks has 0 there.

    Two shuffles of one row a group and task; null is a group like any other.
    Different multisets pass for equal with odds of about 1 in 2^64.
    """
    a = digests(published, by, columns)
    b = digests(recomputed, by, columns).withColumnsRenamed({c: f"_{c}" for c in (*by, "n", "total", "mixed")})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    both = a.join(b, same, "full_outer")
    equal = F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_total")) & F.col("mixed").eqNullSafe(F.col("_mixed"))
    return both.where(~equal).select(*[F.when(F.col("n").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in by], F.coalesce("n", F.lit(0)).alias("n_published"), F.coalesce("_n", F.lit(0)).alias("n_recomputed"))


def differing_pages(rows: DataFrame, *, doc: str, page: str, columns: Sequence[str]) -> DataFrame:
    """Documents whose pages do not hold the same rows: entity, page (the first) and differs (the first that is unlike it).

    For pages that must have them in the same order, ``columns`` holds the
    place. A page without any row is none: let every page have one.
    """
    of = digests(rows, [doc, page], columns)
    by = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = of.withColumns({f"_{c}": F.first(c).over(by) for c in ("n", "total", "mixed", page)})
    unlike = first.where((F.col("n") != F.col("_n")) | (F.col("total") != F.col("_total")) | (F.col("mixed") != F.col("_mixed")))
    return unlike.groupBy(F.col(doc).alias("entity"), F.col(f"_{page}").alias("page")).agg(F.min(page).alias("differs"))


def sessions_differ(found: DataFrame, listed: DataFrame, *, doc: str, heading: Column, label: Column) -> DataFrame:
    """Documents whose own heading names another session than the list that they were found by (entity, detail), spaces and compatibility forms apart; one without a heading differs from any."""
    a = found.select(F.col(doc).alias("entity"), heading.alias("_heading"))
    b = listed.select(F.col(doc).alias("_doc"), label.alias("_label"))
    both = b.join(a, F.col("_doc") == F.col("entity"), "left")
    detail = F.concat(F.lit("listed as "), F.col("_label"), F.lit(", headed "), F.coalesce("_heading", F.lit("nothing")))
    return both.where(~F.coalesce(F.col("_heading") == F.col("_label"), F.lit(False))).select(F.col("_doc").alias("entity"), detail.alias("detail"))
