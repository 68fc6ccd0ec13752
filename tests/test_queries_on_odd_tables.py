"""Queries over small tables with values that the driver's smallest ones lack."""

import time

from pyspark.sql import functions as F

import __spark_entry__
from rollbook.operators import lattice


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_zip_of_numbers_over_four_digits(spark, tmp_path):
    sf = put(spark, tmp_path, customer=([(8,), (9,), (1234,), (10001,), (123456,)], "c_custkey long"))
    got = {r.c_custkey: r.zip for r in __spark_entry__.queries()["zip_normalize"](spark, sf).collect()}
    assert got == {8: "0080008", 9: None, 1234: "2341234", 10001: None, 123456: None}


def test_decisions_of_orders_and_of_parts(spark, tmp_path):
    sf = put(
        spark, tmp_path, orders=([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long"), part=([(1, "B", 5), (2, "B", 5), (3, "C", 5)], "p_partkey long, p_brand string, p_size int"),
        lineitem=([(1, 1, 1.0, "A", "F"), (1, 1, 50.0, "A", "F"), (2, 2, 1.0, "N", "F"), (2, 2, 50.0, "A", "O"), (3, 3, 2.0, "R", "O")], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string"))
    got = {(r.kind, r.key): r.decision for r in __spark_entry__.queries()["unanimous_decision"](spark, sf).collect()}
    assert got == {("order", 1): "F", ("order", 2): None, ("order", 3): "O", ("part", 1): "A", ("part", 2): None, ("part", 3): "R"}


def test_trimming_stops_where_nothing_is_cut(spark):
    xs = [float(i) for i in range(12000)]
    df = spark.createDataFrame([([-50.0, *xs],)], "x array<double>")
    began = time.perf_counter()
    assert df.select(lattice.trimmed(F.col("x")).alias("o")).first().o == xs
    assert time.perf_counter() - began < 30
