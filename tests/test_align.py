"""Alignment to a fitted list: by hashed keys, in the list's order."""

import time

from pyspark.sql import functions as F

from inferna.functions import parse as P


def test_align_is_by_hashed_keys(spark):
    names = [f"n{i}" for i in range(2000)]
    maps = spark.range(400, numPartitions=1).select(F.map_from_entries(F.transform(F.sequence(F.lit(1000), F.lit(2999)), lambda i: F.struct(F.concat(F.lit("n"), i.cast("string")), i.cast("double")))).alias("m"))
    start = time.time()
    total = maps.select(F.aggregate(P.align(F.col("m"), names), F.lit(0.0), lambda a, x: a + x).alias("t")).agg(F.sum("t")).first()[0]
    assert total == 400 * sum(range(1000, 2000))
    assert time.time() - start < 30   # 1.6 billion comparisons by a scan for each name


def test_align_keeps_order_nulls_and_repeated_names(spark):
    rows = spark.sql("SELECT map('b', 2D, 'z', 9D, 'a', CAST(NULL AS DOUBLE)) AS m UNION ALL SELECT CAST(NULL AS map<string,double>)")
    got = sorted(r.a for r in rows.select(P.align(F.col("m"), ["c", "b", "a", "b"]).alias("a")).collect())
    assert got == [[0, 0, 0, 0], [0, 2, 0, 2]]
    assert [r.a for r in rows.select(P.align(F.col("m"), []).alias("a")).collect()] == [[], []]
