"""Helpers that several operators share: table reading, scratch tables, single evaluation, running sums."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII letters; lower-casing in the contracts touches these alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that separates words: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
#: Rows that one window group of a running sum holds on average, and fine groups per coarse one.
GROUP_ROWS, COARSE = 256, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def shipped(spark: SparkSession) -> None:
    """Sends the package to the Python workers where they could not import it from their path."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if "vecloom.zip" not in context._python_includes and not any(p and Path(p).resolve() == root for p in known):
        folder = tempfile.mkdtemp()  # the driver serves the file itself
        context.addPyFile(shutil.make_archive(f"{folder}/vecloom", "zip", root, "vecloom"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Local sessions that name none, as in tests, get their own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing. The table goes
    when it is released, or with the session's Python."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in tables:
        _drop(df.sparkSession, df._written)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving memory back to the system after its last batch: Spark keeps its Python workers for
    later stages, and what they hold on to counts there."""

    @wraps(run)
    def run_tidily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return run_tidily


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_sum(df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the earlier rows of the same keys, in the order of levels and then of order.

    levels are columns that cut a key's rows into ordered groups, coarse to fine. Each group is summed on its
    own and starts at its offset, so that a key with most of the rows is spread over as many tasks as it has
    groups. Keys and levels must not be null.
    """
    before = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not levels:
        return df.withColumn(out, before.cast("long"))
    groups, offset = [*keys, *levels], f"_offset{len(levels)}"
    sums = df.groupBy(*groups).agg(F.sum(value).alias("_sum"))
    offsets = running_sum(sums, keys, levels[:-1], levels[-1:], "_sum", offset).drop("_sum")
    return df.withColumn("_in", before).join(offsets, groups).withColumn(out, (F.col("_in") + F.col(offset)).cast("long")).drop("_in", offset)


def in_order(df: DataFrame, order: Sequence, sums: dict[str, str]) -> tuple[DataFrame, tuple[int, ...]]:
    """Adds the sum of each column over the earlier rows in the order of all rows, which must be total, as the name
    given; and the totals. Rows are sorted into ranges, each range is summed on its own and starts at its offset, of
    which the driver sees one for each range."""
    ranged = written(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    totals = {r[0]: [int(x or 0) for x in r[1:]] for r in ranged.groupBy("_range").agg(*(F.sum(c).cast("decimal(38,0)") for c in sums.values())).collect()}
    past, offsets = [0] * len(sums), []
    for part in sorted(totals):
        offsets.append((part, *past))
        past = [a + b for a, b in zip(past, totals[part], strict=True)]
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    names = {out: f"_offset_{out}" for out in sums}
    starts = df.sparkSession.createDataFrame(offsets or [(-1, *past)], ", ".join(["_range int", *(f"{n} long" for n in names.values())]))
    out = ranged.withColumns({o: F.coalesce(F.sum(c).over(own), F.lit(0)) for o, c in sums.items()}).join(F.broadcast(starts), "_range")  # a row for each range
    return out.withColumns({o: (F.col(o) + F.col(n)).cast("long") for o, n in names.items()}).drop("_range", *names.values()), tuple(past)


def spread(digest: Column, groups: Column) -> tuple[Column, Column]:
    """Levels for running_sum out of a hexadecimal digest: its place among groups, in the digest's order."""
    fine = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * groups / F.lit(2.0**32)).cast("long")
    return F.floor(fine / COARSE).cast("long"), fine
