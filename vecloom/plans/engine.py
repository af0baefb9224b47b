"""Build an index, store it, search it, or all of these, with parameters derived from the data."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.config import LshConfig
from vecloom.operators import index as ix
from vecloom.operators.candidates import affordable, collide
from vecloom.operators.params import LshParams, derived_params, params_from, params_table
from vecloom.operators.stats import read_statistics, statistics
from vecloom.plans.iterative import search_iterative
from vecloom.plans.partitioned import search_partitioned
from vecloom.plans.scratch import kept

#: Buckets of queries that are broadcast at once.
MOST_ASKED = 200_000


@dataclass
class Index:
    """An index: of the plan, where nothing is computed until it is stored or searched, or stored under path."""

    config: LshConfig
    statistics: dict[str, int]
    points: DataFrame
    params: list[LshParams]
    buckets: DataFrame
    path: str | None = None

    @property
    def radii(self) -> list[int]:
        return [self.config.ratio**i for i in range(self.statistics["n_radii"])]

    @property
    def budgets(self) -> dict[int, int]:
        return {p.part: self.config.budget(p.tables) for p in self.params}


@dataclass
class Answer:
    """results: qid, rank, id, dist. radii: how many were searched."""

    results: DataFrame
    radii: int


def build(points: DataFrame, config: LshConfig, queries: DataFrame | None = None) -> Index:
    """Statistics of points, and of queries, whose coordinates must lie in the same domain; then parameters for each
    partition, by its own number of points; then buckets for all radii."""
    every = points if queries is None else points.select("coords").unionByName(queries.select("coords"))
    found = statistics(every, config.ratio).first().asDict()
    placed = ix.with_part(points, config.partitions).withColumn("split_start", F.col("id") - F.pmod("id", F.lit(config.split_rows)))
    sizes = {r[0]: r[1] for r in placed.groupBy("part").count().collect()}  # a row for each partition
    params = [derived_params(p, found["d"], found["t"], n, config.ratio, config.seed, config.blocks) for p, n in sorted(sizes.items())]
    return from_parameters(placed, params, config, found | {"n": sum(sizes.values())})


def from_parameters(placed: DataFrame, params: list[LshParams], config: LshConfig, found: dict[str, int]) -> Index:
    """An index of points with part and split_start by parameters that are given."""
    out = Index(config, found, placed, params, placed)
    return replace(out, buckets=ix.hashed(placed.drop("split_start"), params, out.radii))


def save(index: Index, path: str) -> Index:
    """Stores points, parameters, buckets, statistics, splits and settings; the index that reads them. Fails if path
    holds one."""
    spark = index.points.sparkSession
    meta = spark.createDataFrame([(*(int(index.statistics[c]) for c in ("d", "t", "n", "n_radii")), json.dumps(asdict(index.config)))], "d int, t int, n long, n_radii int, config string")
    splits = index.points.select("split_start").distinct()
    ix.store(path, index.points, params_table(spark, index.params), index.buckets.drop("radius"), meta, splits)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """The index stored under path, with validated statistics and parameters."""
    meta = read_statistics(spark, f"{path}/statistics").asDict()
    config = LshConfig(**json.loads(meta.pop("config")))
    params = params_from(spark.read.parquet(f"{path}/params"))
    return Index(config, meta, spark.read.parquet(f"{path}/points"), params, spark.read.parquet(f"{path}/buckets"), path)


def in_every_part(index: Index, queries: DataFrame) -> DataFrame:
    """queries with part, in every partition."""
    parts = F.broadcast(queries.sparkSession.createDataFrame([(p.part,) for p in index.params], "part int"))
    return queries.join(parts)


def query_hits(index: Index, queries: DataFrame) -> DataFrame:
    """Collisions at every radius."""
    return collide(ix.hashed(in_every_part(index, queries), index.params, index.radii), index.buckets)


def hits_by_radius(index: Index, queries: DataFrame, budget: int | None = None) -> Callable[[int, DataFrame], DataFrame]:
    """Collisions at one radius of the queries still active. Buckets are read by radius; those of an index that is not
    stored are hashed for each radius anew, as far as they are needed. budget: collisions that a query may spend, in
    the order of tables; those of later tables are left out."""
    every = in_every_part(index, queries)
    tables = max((p.tables for p in index.params), default=0) * len(index.params)
    vectors = index.points.drop("split_start")

    def rows(i: int, upto: int | None = None) -> DataFrame:
        if index.path is None:
            return ix.hashed(vectors, index.params, index.radii, i, upto)
        found = index.buckets.where(F.col("radius_id") == i)
        return found if upto is None else found.where(F.col("table_id") < upto)

    def at(i: int, active: DataFrame) -> DataFrame:
        mine = ix.hashed(every.join(active, "qid", "left_semi"), index.params, index.radii, i)
        if active.limit(MOST_ASKED // max(1, tables) + 1).count() * tables > MOST_ASKED:
            return collide(mine, rows(i))
        mine = F.broadcast(kept(mine))
        if budget is None:
            return collide(mine, rows(i))
        mine = kept(affordable(mine, rows(i), budget))
        last = mine.agg(F.max("table_id")).first()[0]
        return collide(F.broadcast(mine), rows(i, 0 if last is None else last + 1))

    return at


def answer(index: Index, queries: DataFrame, iterative: bool = False, strict: bool = False) -> Answer:
    """The nearest of queries. The iterative search takes an index of one partition."""
    config = index.config
    if iterative:
        if config.partitions != 1:
            raise ValueError("the iterative search takes one partition")
        if index.path is None:
            index = replace(index, points=kept(index.points))
        queries = kept(queries)  # else every radius reads and orders the points for them
        return Answer(*search_iterative(hits_by_radius(index, queries, index.budgets[0]), index.points, queries, config.k, config.ratio, index.budgets[0], index.radii))
    points = index.points.select("part", "id", "coords")
    return Answer(search_partitioned(query_hits(index, queries), points, queries, config.k, config.ratio, index.budgets, index.radii, strict), len(index.radii))


def search(index: Index, queries: DataFrame, iterative: bool = False, strict: bool = False) -> DataFrame:
    """qid, rank, id, dist."""
    return answer(index, queries, iterative, strict).results


def build_and_search(points: DataFrame, queries: DataFrame, config: LshConfig, **how: bool) -> DataFrame:
    return search(build(points, config, queries), queries, **how)


class Phases(dict):
    """Seconds by phase: phases.timed("build", action)."""

    def timed(self, phase: str, action: Callable):
        began = time.perf_counter()
        out = action()
        self[phase] = round(time.perf_counter() - began, 3)
        return out
