"""The measured size of a table, by which it is broadcast or not."""

from pyspark.sql import functions as F

from chronotext.session import fits_broadcast


def test_broadcast_size_counts_nested_bytes(spark):
    rows = spark.range(100).select(F.encode(F.repeat(F.lit("x"), 10_000), "utf-8").alias("b"))
    assert not fits_broadcast(rows, 900_000) and fits_broadcast(rows, 1_100_000)
    nested = spark.range(100).select(
        F.create_map(F.lit("k"), F.array(F.repeat(F.lit("x"), 10_000))).alias("m"), F.struct(F.repeat(F.lit("y"), 10_000).alias("t")).alias("s"),
        F.array(F.struct(F.repeat(F.lit("z"), 10_000).alias("t"))).alias("a"),
    )
    assert not fits_broadcast(nested, 2_900_000) and fits_broadcast(nested, 3_300_000)
    assert fits_broadcast(spark.range(10).select(F.lit(None).cast("binary").alias("b"), F.lit(None).cast("array<string>").alias("a")), 2000)
