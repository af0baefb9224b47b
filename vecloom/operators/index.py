"""Buckets of points and queries, and the index that holds them.

Projections are computed once: since half the domain is a multiple of the width and radii are whole numbers, the
bucket numbers of every radius are whole divisions of the unit radius's. Hash parameters are broadcast; their size
is that of the tables, not of the data, and is checked. Columns state the buckets for any engine; hashed() gives the
same numbers by matrices, for tables of many projections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.config import SCALE, WIDTH
from vecloom.functions.vector import LIFT, MODULUS, at_radius, base_values, fold, partition_of
from vecloom.operators.params import LshParams, params_table

#: Numbers that broadcast hash parameters may hold (8 bytes each), and projections that hashed() holds at once.
MOST_PARAMETERS, HELD = 16_000_000, 1 << 20


def with_part(points: DataFrame, partitions: int) -> DataFrame:
    return points.withColumn("part", partition_of(F.col("id"), partitions))


def base_buckets(vectors: DataFrame, params: DataFrame, parameters: int) -> DataFrame:
    """vectors (with part and coords) times the tables of their part: adds table_id, base and s. parameters: how many
    numbers params holds; beyond MOST_PARAMETERS the join is left to the engine."""
    side = F.broadcast(params) if parameters <= MOST_PARAMETERS else params
    hashed = vectors.join(side, "part")
    return hashed.withColumn("base", base_values(F.col("coords"), F.col("projections"), F.col("half"))).drop("projections", "half")


def buckets(based: DataFrame, radii: list[int], only: int | None = None) -> DataFrame:
    """A row for each radius, or for the one at place only: adds radius_id, radius and bucket_id; drops base, s and
    coords."""
    rungs = F.array(*(F.struct(F.lit(i).alias("radius_id"), F.lit(r).cast("long").alias("radius")) for i, r in enumerate(radii) if only in (None, i)))
    rows = based.withColumn("rung", F.explode(rungs)).select("*", "rung.radius_id", "rung.radius")
    return rows.withColumn("bucket_id", fold(at_radius(F.col("base"), F.col("radius")), F.col("s"))).drop("rung", "base", "s", "coords")


def hashed(vectors: DataFrame, params: list[LshParams], radii: list[int], only: int | None = None, upto: int | None = None) -> DataFrame:
    """The rows of buckets() over base_buckets(), without s, of the first upto tables: numpy computes them a matrix at a
    time. Workers need no module but numpy and pyarrow."""
    spark = vectors.sparkSession
    if sum(p.a.size for p in params) > MOST_PARAMETERS:
        rows = buckets(base_buckets(vectors, params_table(spark, params), MOST_PARAMETERS + 1), radii, only)
        return rows if upto is None else rows.where(F.col("table_id") < upto)
    keys = [f for f in vectors.schema.fields if f.name != "coords"]
    known = {p.part: (p.a[:upto], p.b[:upto], np.array([p.s[p.block(i)] for i in range(p.tables)], np.int64)[:upto], np.array([p.block(i) for i in range(p.tables)], np.int32)[:upto], p.half) for p in params}
    held = spark.sparkContext.broadcast(known)
    rungs = [(i, r) for i, r in enumerate(radii) if only in (None, i)]
    added = T.StructType.fromDDL("block_id int, table_id int, radius_id int, radius long, bucket_id long")
    out = T.StructType([*keys, *added.fields])
    names, most, unit, lift, modulus, scale, width = [f.name for f in out.fields], HELD, SCALE * WIDTH, LIFT, MODULUS, SCALE, WIDTH

    def based(coords: pa.Array, a: np.ndarray, b: np.ndarray, half: int) -> np.ndarray:
        """Unit-radius bucket numbers: vectors x tables x projections."""
        tables, m, d = a.shape
        lengths = coords.value_lengths()
        x = coords.flatten()
        if coords.null_count or x.null_count or len(x) != d * len(coords) or lengths.to_numpy().min(initial=d) < d:
            raise ValueError("a vector lies outside the domain of the hash parameters")
        x, flat = x.to_numpy().astype(np.int64).reshape(-1, d), a.reshape(-1, d)
        greatest = int(np.abs(flat).sum(axis=1).max(initial=0)) * int(np.abs(x).max(initial=0))
        # doubles hold such sums exactly, in any order
        sums = (x.astype(float) @ flat.T.astype(float)).astype(np.int64) if greatest < 1 << 53 else x @ flat.T
        base = (sums.reshape(len(x), tables, m) + b + half * scale) // unit
        if not ((base >= 0) & (base * width < 2 * half)).all():
            raise ValueError("a vector lies outside the domain of the hash parameters")
        return base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            for part in np.unique(parts):
                if part not in held.value or not len(held.value[part][0]):
                    continue
                a, b, s, blocks, half = held.value[part]
                mine = batch.filter(pa.array(parts == part))
                step = max(1, most // max(1, a.shape[0] * a.shape[1]))
                for first in range(0, mine.num_rows, step):
                    rows = mine.slice(first, step)
                    base = based(rows.column("coords"), a, b, half)
                    n, tables, m = base.shape
                    place = pa.array(np.repeat(np.arange(n), tables))
                    own = [rows.column(f).take(place) for f in names[:-5]]
                    own += [pa.array(np.tile(blocks, n)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n))]
                    for i, radius in rungs:
                        products = (base // radius * s).astype(np.int32)  # the lower 32 bits
                        bucket = np.zeros((n, tables), np.int64)
                        for j in range(m):
                            bucket += products[:, :, j]
                            bucket[bucket < 0] += lift
                            bucket %= modulus
                        rung = [pa.array(np.full(n * tables, i, np.int32)), pa.array(np.full(n * tables, radius, np.int64))]
                        yield pa.RecordBatch.from_arrays([*own, *rung, pa.array(bucket.reshape(-1))], names=names)

    return vectors.select(*(f.name for f in keys), "coords").mapInArrow(run, out)


def bucket_lists(rows: DataFrame) -> DataFrame:
    """The grouped view: ids (ascending) of every bucket. For reports and lookups; searches join the rows instead."""
    return rows.groupBy("part", "radius_id", "table_id", "bucket_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def store(path: str, points: DataFrame, params: DataFrame, rows: DataFrame, meta: DataFrame, splits: DataFrame) -> None:
    """points, params, buckets, statistics and the starts of data splits under path. Points lie by part and split,
    buckets by radius, block and part, so that a search reads only what it needs. Fails if something is there."""
    meta.coalesce(1).write.mode("errorifexists").parquet(f"{path}/statistics")
    splits.coalesce(1).write.mode("errorifexists").parquet(f"{path}/splits")
    params.write.mode("errorifexists").partitionBy("part", "block_id").parquet(f"{path}/params")
    points.repartition("part", "split_start").write.mode("errorifexists").partitionBy("part", "split_start").parquet(f"{path}/points")
    rows.repartition("radius_id", "block_id", "part", "table_id", F.pmod("bucket_id", F.lit(16))).write.mode("errorifexists").partitionBy("radius_id", "block_id", "part").parquet(f"{path}/buckets")


def block_sizes(params: DataFrame) -> DataFrame:
    """part, block_id and tables: how many tables each block holds."""
    return params.groupBy("part", "block_id").agg(F.count(F.lit(1)).alias("tables"))
