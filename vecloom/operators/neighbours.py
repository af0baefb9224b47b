"""Distances, the nearest k, exact search, and how good a result is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.functions.vector import l2

#: Queries that are broadcast, or held beside each point, at once.
BATCH = 10_000


def with_distance(pairs: DataFrame, points: DataFrame, queries: DataFrame, on: list[str] | None = None) -> DataFrame:
    """pairs (qid, id, ...) with coords of the point and dist to the query. A batch of queries is broadcast; more join."""
    asked = queries.select("qid", F.col("coords").alias("asked"))
    asked = F.broadcast(asked) if queries.limit(BATCH + 1).count() <= BATCH else asked
    return pairs.join(points, on or ["id"]).join(asked, "qid").withColumn("dist", l2(F.col("coords"), F.col("asked"))).drop("asked")


def nearest(rows: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest of each query (and of by), by distance and id: adds rank. The engine cuts to k before and after
    its shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid", *by).orderBy("dist", "id"))).where(F.col("rank") <= k)


def exact_neighbours(points: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = (), batch: int = BATCH) -> DataFrame:
    """qid, rank, id, dist by comparing every point with a stated set of queries, which is broadcast batch by batch.
    by: columns of points within which the nearest are sought."""
    batches = max(1, -(-queries.count() // batch))
    kept = None
    for i in range(batches):
        mine = queries.where(F.pmod(F.xxhash64("qid"), F.lit(batches)) == i) if batches > 1 else queries
        held = F.broadcast(mine.agg(F.collect_list(F.struct("qid", "coords")).alias("asked")))  # of near batch queries
        rows = points.join(held).withColumn("q", F.explode("asked")).select(*by, "q.qid", "id", l2(F.col("coords"), F.col("q.coords")).alias("dist"))
        near = nearest(rows, k, by)
        kept = near if kept is None else kept.unionByName(near)
    return kept


def ratios(results: DataFrame, truth: DataFrame, query_count: int) -> DataFrame:
    """qid, found and ratio of every query: the mean of dist over true dist at each rank found. Equal zeros are 1; a
    query without results has no ratio. valid: no ratio lies below 1, which would be an error."""
    each = F.when((F.col("dist") == 0) & (F.col("true_dist") == 0), 1.0).when(F.col("true_dist") > 0, F.col("dist") / F.col("true_dist"))
    asked = truth.select("qid").distinct().where(F.col("qid") < query_count)
    joined = results.select("qid", "rank", "dist").join(truth.select("qid", "rank", F.col("dist").alias("true_dist")), ["qid", "rank"])
    scored = joined.groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.avg(each).alias("ratio"))
    df = asked.join(scored, "qid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return df.withColumn("valid", F.col("ratio").isNull() | (F.col("ratio") > 1) | (F.abs(F.col("ratio") - 1) < 1e-5))


def summary(scored: DataFrame, k: int, query_count: int) -> DataFrame:
    """One row: average_ratio over the queries answered, strict_ratio (their sum over all queries asked), and missed,
    the queries without k results."""
    missed = (F.lit(query_count) - F.count_if(F.col("found") == k)).alias("missed")
    return scored.agg(F.avg("ratio").alias("average_ratio"), (F.sum("ratio") / query_count).alias("strict_ratio"), missed)
