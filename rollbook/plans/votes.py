"""Roll-call queries: orders are roll calls, line status the group, return flag the vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.operators.majority import group_majority
from rollbook.session import table


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS roll_call", "l_linenumber AS seat", "l_suppkey AS member",
        "l_linestatus AS grp",
        "CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'none' END AS vote",
    )


def _group_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_majority(_votes(spark, sf_dir), call="roll_call", group="grp", vote="vote")


QUERIES = {
    "group_majority": (
        _group_majority,
        """
        SELECT l_orderkey AS roll_call, l_linestatus AS grp,
               count(*) FILTER (l_returnflag = 'A') AS yes,
               count(*) FILTER (l_returnflag = 'R') AS no,
               count(*) AS total,
               CASE WHEN yes > no THEN 'yes' WHEN no > yes THEN 'no' END AS majority
        FROM lineitem GROUP BY ALL
        """,
    ),
}
