"""Partitioned search: every data partition is searched on its own, and the nearest k are merged.

One plan for all radii. A query spends a budget of collisions in each partition and radius; the first radius that
exhausts it ends the query there. In strict mode a point is judged at the radius at which it was met first and a
query that never exhausts its budget returns nothing from that partition; complete mode judges at the last radius
searched and returns what it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.operators.candidates import first_met, within_budget
from vecloom.operators.neighbours import nearest, with_distance


def search_partitioned(hits: DataFrame, points: DataFrame, queries: DataFrame, k: int, ratio: int, budgets: dict[int, int], radii: list[int], strict: bool = False) -> DataFrame:
    """qid, rank, id, dist from hits (part, radius_id, radius, table_id, qid, id). budgets: collisions by part."""
    by = ["part", "qid"]
    own = F.create_map(*(F.lit(x) for pair in budgets.items() for x in pair))[F.col("part")]
    spent = within_budget(hits, max(budgets.values()), [*by, "radius_id"]).withColumn("own", own).where(F.col("pos") <= F.col("own"))
    stop = F.min(F.when(F.col("pos") == F.col("own"), F.col("radius_id"))).over(Window.partitionBy(*by))
    spent = spent.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("radius_id") <= F.col("stop")))
    if strict:
        met = first_met(spent.where(F.col("stop").isNotNull()), by).withColumn("limit", F.col("radius") * ratio)
    else:
        at = F.array(*(F.lit(r).cast("long") for r in radii))
        limit = F.get(at, F.coalesce("stop", F.lit(len(radii) - 1))) * ratio
        met = spent.select(*by, "id", limit.alias("limit")).distinct()
    near = with_distance(met, points, queries, ["part", "id"]).where(F.col("dist") < F.col("limit"))
    return nearest(near.select("qid", "id", "dist"), k).select("qid", "rank", "id", "dist")
