"""Iterative search: one index, one plan for each radius, and only unfinished queries go on.

A query is finished with k points within ratio * radius, or after the last radius. What it has found is carried to
the next radius. The loop writes its small state to the shared folder each time, so that plans do not grow and a
lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.candidates import within_budget
from vecloom.operators.neighbours import nearest, with_distance
from vecloom.plans.scratch import kept


def merge_state(state: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
    """The nearest k of what was known and what is new, each point once."""
    both = found if state is None else state.select("qid", "id", "dist").unionByName(found)
    return nearest(both.dropDuplicates(["qid", "id"]), k)


def unfinished(active: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The active queries with fewer than k points."""
    full = state.groupBy("qid").count().where(F.col("count") >= k)
    return active.join(full, "qid", "left_anti")


def search_iterative(hits_at: Callable[[int, DataFrame], DataFrame], points: DataFrame, queries: DataFrame, k: int, ratio: int, budget: int, radii: list[int]) -> tuple[DataFrame, int]:
    """qid, rank, id, dist, and the number of radii searched. hits_at(radius_id, active): the collisions (table_id, qid,
    id) at one radius of the queries (qid) that are still active; no other radius is hashed or read for it."""
    active, state, done = queries.select("qid"), None, 0
    for i, radius in enumerate(radii):
        pairs = within_budget(hits_at(i, active), budget, ["qid"]).select("qid", "id").distinct()
        near = with_distance(pairs, points, queries).where(F.col("dist") < ratio * radius).select("qid", "id", "dist")
        state, done = kept(merge_state(state, near, k)), i + 1
        active = kept(unfinished(active, state, k))
        if active.isEmpty():
            break
    return state.select("qid", "rank", "id", "dist"), done
