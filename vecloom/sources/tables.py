"""Points and queries out of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def embedding_points(spark: SparkSession, sf_dir: str, scale: int = 100) -> DataFrame:
    """id, coords: embeddings times scale, rounded half up to integers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rounded = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale + 0.5).cast("int"))
    return rows.select(F.col("vec_id").alias("id"), rounded.alias("coords"))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coords of five small integers for each line of an order."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int"), cents("l_discount"), cents("l_tax"), day).alias("coords"))


def first_queries(points: DataFrame, count: int) -> DataFrame:
    """qid (0-based place by id), coords of the first count points; count rows pass through one task."""
    first = points.orderBy("id").limit(count)
    return first.select((F.row_number().over(Window.orderBy("id")) - 1).alias("qid"), "coords")


def without_first(points: DataFrame, count: int) -> DataFrame:
    """The points that are no queries."""
    return points.join(points.orderBy("id").limit(count).select("id"), "id", "left_anti")
