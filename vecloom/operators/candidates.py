"""Collisions of queries and points, their budget, and what is left to verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["part", "radius_id", "table_id", "bucket_id"]


def collide(query_buckets: DataFrame, point_buckets: DataFrame, how: str = "inner") -> DataFrame:
    """part, radius_id, radius, table_id, qid, id of equal buckets; how="left" keeps queries without any."""
    return query_buckets.join(point_buckets.select(*KEYS, "id"), KEYS, how).drop("bucket_id")


def within_budget(hits: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """Adds pos, the place of a collision in the order of table and id, and keeps the first budget of each group.
    The bound is a literal, so that the engine cuts before it shuffles."""
    place = Window.partitionBy(*by).orderBy("table_id", "id")
    return hits.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= budget)


def affordable(query_buckets: DataFrame, point_buckets: DataFrame, budget: int) -> DataFrame:
    """The rows of query_buckets, of one radius and marked for broadcast if they are few, whose table comes before the
    query has spent its budget; the collisions of all others are beyond it. Buckets are counted, not expanded, so that
    large ones cost no more than their points."""
    held = point_buckets.join(query_buckets.select(*KEYS).distinct(), KEYS, "left_semi")
    sizes = held.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("met"))
    earlier = Window.partitionBy("part", "qid").orderBy("table_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = query_buckets.join(sizes, KEYS).withColumn("spent", F.coalesce(F.sum("met").over(earlier), F.lit(0)))
    return spent.where(F.col("spent") < budget).drop("met", "spent")


def first_met(hits: DataFrame, by: list[str]) -> DataFrame:
    """One row for each (by, id): where it was met first, in the order of radius and table."""
    return hits.groupBy(*by, "id").agg(F.min(F.struct("radius_id", "table_id", "radius")).alias("f")).select(*by, "id", "f.radius_id", "f.table_id", "f.radius")


def with_splits(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds split_start, the greatest start (starts: split_start, distinct) not above id; rows before the first go.
    Starts and ids are dealt to cells of equal width, as many as there are starts; a cell without an own start below
    an id hands on the greatest of the cells before, of which there is a row for each cell. So no id meets more than
    the starts of its cell."""
    low, high, n = starts.agg(F.min("split_start"), F.max("split_start"), F.count(F.lit(1))).first()
    if not n:
        return rows.limit(0).withColumn("split_start", F.lit(None).cast("long"))
    width = max(1, -(-(high - low + 1) // n))
    cell = lambda x: F.least(F.floor((x - low) / F.lit(width)), F.lit(n)).cast("long")
    listed = starts.withColumn("cell", cell(F.col("split_start"))).groupBy("cell").agg(F.array_sort(F.collect_list("split_start")).alias("starts"), F.max("split_start").alias("last"))
    cells = starts.sparkSession.range(n + 1).withColumnRenamed("id", "cell").join(listed, "cell", "left")
    group = F.floor(F.col("cell") / 4096)
    before = lambda by: Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    grouped = cells.withColumn("group", group)
    tops = grouped.groupBy("group").agg(F.max("last").alias("top")).withColumn("far", F.max("top").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)))
    known = grouped.join(tops.select("group", "far"), "group").withColumn("handed", F.coalesce(F.max("last").over(before(["group"])), "far")).select("cell", "starts", "handed")
    found = rows.where(F.col("id") >= low).withColumn("cell", cell(F.col("id"))).join(known, "cell")
    own = F.array_max(F.filter(F.coalesce("starts", F.array().cast("array<bigint>")), lambda x: x <= F.col("id")))
    return found.withColumn("split_start", F.coalesce(own, "handed")).drop("cell", "starts", "handed")
