"""Statistics of a data set: dimension, greatest coordinate, size, radii."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vector import max_abs


def statistics(points: DataFrame, ratio: int) -> DataFrame:
    """One row: d, t, n and n_radii. Fails at run time if vectors differ in length."""
    row = points.agg(F.max(F.size("coords")).alias("d"), F.min(F.size("coords")).alias("least"), F.max(max_abs(F.col("coords"))).alias("t"), F.count(F.lit(1)).alias("n"))
    d = F.when(F.col("d") == F.col("least"), F.col("d")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("int"))
    radii = 1 + F.floor(F.log(F.sqrt(F.col("d").cast("double")) * F.col("t")) / math.log(ratio))
    return row.select(d.alias("d"), F.col("t").cast("int").alias("t"), "n", radii.cast("int").alias("n_radii"))


def radius_ladder(stats: DataFrame, ratio: int) -> DataFrame:
    """radius_id, radius and limit (ratio * radius) of the radii of one row of statistics."""
    ids = stats.select(F.explode(F.sequence(F.lit(0), F.col("n_radii") - 1)).alias("radius_id"))
    radius = F.pow(F.lit(float(ratio)), "radius_id").cast("long")
    return ids.select("radius_id", radius.alias("radius"), (radius * ratio).alias("limit"))


def read_statistics(spark: SparkSession, path: str) -> Row:
    """The stored row of statistics; ValueError if a number is below 1."""
    row = spark.read.parquet(path).first()
    wrong = [c for c in ("d", "t", "n", "n_radii") if row is None or row[c] is None or row[c] < 1]
    if wrong:
        raise ValueError(f"stored statistics are not valid: {', '.join(wrong)}")
    return row
