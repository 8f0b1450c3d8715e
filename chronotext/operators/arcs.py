"""Arc geometry for distances between pairs of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronotext.functions.divergence import rescale

# A line, the origin and width of a year on the axis, and the output ranges.
YEAR_PAIR = r"\A(\d+)-(\d+),([.0-9]+)"
AXIS_YEAR = 1800
YEAR_WIDTH = 6
STROKE = (3.0, 0.01)
OPACITY = (0.5, 0.01)


def parse_year_pairs(lines: DataFrame) -> DataFrame:
    """(year1, year2, log_distance) from ``y1-y2,distance``; other lines and distance 0 go."""
    year1, year2, distance = (
        F.regexp_extract("value", YEAR_PAIR, group).try_cast("double") for group in (1, 2, 3)
    )
    return (
        lines.where(F.col("value").rlike(YEAR_PAIR))
        .select(year1.alias("year1"), year2.alias("year2"), distance.alias("distance"))
        .where(F.col("distance") > 0)
        .select("year1", "year2", F.ln("distance").alias("log_distance"))
    )


def arcs(pairs: DataFrame) -> DataFrame:
    """(year1, year2, cx, r, stroke_width, opacity) of each pair of years."""
    span = pairs.agg(F.struct(F.min("log_distance").alias("low"), F.max("log_distance").alias("high"))).scalar()
    low, high = F.col("span.low"), F.col("span.high")
    return pairs.withColumn("span", span).select(
        "year1",
        "year2",
        (((F.col("year1") + F.col("year2")) / 2 - AXIS_YEAR) * YEAR_WIDTH).alias("cx"),
        ((F.col("year2") - F.col("year1")) * YEAR_WIDTH / 2).alias("r"),
        rescale("log_distance", low, high, *STROKE).alias("stroke_width"),
        rescale("log_distance", low, high, *OPACITY).alias("opacity"),
    )
