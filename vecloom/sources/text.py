"""Text layouts: data sets and queries (id c1 ... cd), ground truth (id d1 ... dk under a header), results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_points(spark: SparkSession, path: str, zero_based: bool = False, glob: str | None = None) -> DataFrame:
    """id, coords. zero_based: ids count from 0 instead of the files' 1. glob: only files of such names."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    parts = reader.text(path).where(F.trim("value") != "").select(_fields(F.col("value")).alias("f"))
    id_ = F.col("f")[0].cast("long") - int(zero_based)
    return parts.select(id_.alias("id"), F.slice("f", F.lit(2), F.size("f") - 1).cast("array<int>").alias("coords"))


def positioned(spark: SparkSession, path: str, count: int) -> DataFrame:
    """value and at (from 0) of the first count lines that are not blank, in the order in which the files hold them."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("i"))
    first = spark.read.text(path).select("value", at.alias("at")).where(F.trim("value") != "").orderBy("at").limit(count)
    return first.select("value", (F.row_number().over(Window.orderBy("at")) - 1).alias("at"))


def read_queries(spark: SparkSession, path: str, count: int) -> DataFrame:
    """qid (0-based place), coords of the first count rows of the file; the ids themselves are not used."""
    rows = positioned(spark, path, count).select("at", _fields(F.col("value")).alias("f"))
    return rows.select(F.col("at").alias("qid"), F.slice("f", F.lit(2), F.size("f") - 1).cast("array<int>").alias("coords"))


def read_ground_truth(spark: SparkSession, path: str, query_count: int, k: int) -> DataFrame:
    """qid (0-based place), rank (from 1), dist. The first line promises queries and neighbours; fails if these are
    fewer than are asked for."""
    lines = positioned(spark, path, query_count + 1).select("at", _fields(F.col("value")).alias("f"))
    header = lines.where("at = 0").first()
    if header is None or len(header.f) != 2:
        raise ValueError("the ground truth does not begin with its numbers of queries and neighbours")
    n, most = map(int, header.f)
    if n < query_count or most < k:
        raise ValueError(f"the ground truth has {n} queries with {most} neighbours")
    rows = lines.where("at > 0").select((F.col("at") - 1).alias("qid"), F.posexplode(F.slice("f", 2, k).cast("array<double>")).alias("rank", "dist"))
    return rows.withColumn("rank", F.col("rank") + 1)


def write_ground_truth(near: DataFrame, path: str, query_count: int, k: int) -> None:
    """A line with the numbers of queries and neighbours, then a line (id d1 ... dk) for each query (qid, rank, dist)."""
    rows = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "dist"))).alias("d"))
    lines = rows.select("qid", F.concat_ws(" ", (F.col("qid") + 1).cast("string"), F.array_join(F.transform("d", lambda x: x["dist"].cast("string")), " ")).alias("value"))
    head = near.sparkSession.createDataFrame([(-1, f"{query_count} {k}")], "qid int, value string")
    lines.unionByName(head).orderBy("qid").coalesce(1).select("value").write.mode("overwrite").text(path)


def result_lines(results: DataFrame, with_id: bool) -> DataFrame:
    """qid, value: per query its number and count, then a line for each neighbour, then an empty line."""
    own = F.concat_ws(" ", F.col("dist").cast("string"), *([F.col("id").cast("string")] if with_id else []), F.array_join(F.col("coords").cast("array<string>"), " "))
    rows = results.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", own.alias("line")))).alias("rows"))
    return rows.select("qid", F.concat_ws("\n", F.concat_ws(" ", F.col("qid").cast("string"), F.col("n").cast("string")), F.array_join(F.col("rows.line"), "\n"), F.lit("")).alias("value"))


def write_results(results: DataFrame, path: str, with_id: bool) -> None:
    result_lines(results, with_id).orderBy("qid").select("value").write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str, with_id: bool) -> DataFrame:
    """qid, rank, id (null without ids), dist, coords. Records end at empty lines; empty files are skipped."""
    records = spark.read.option("lineSep", "\n\n").option("pathGlobFilter", "part*").text(path).where(F.trim("value") != "")
    lines = records.select(F.split(F.trim("value"), "\n").alias("l"))
    lines = lines.select(F.split(F.col("l")[0], " ")[0].cast("int").alias("qid"), F.posexplode(F.slice("l", F.lit(2), F.size("l") - 1)).alias("rank", "line"))
    parts = lines.select("qid", F.col("rank") + 1, F.split("line", " ").alias("f")).toDF("qid", "rank", "f")
    id_ = F.col("f")[1].cast("long") if with_id else F.lit(None).cast("long")
    skip = 2 + int(with_id)
    return parts.select("qid", "rank", id_.alias("id"), F.col("f")[0].cast("double").alias("dist"), F.slice("f", F.lit(skip), F.size("f") - skip + 1).cast("array<int>").alias("coords"))


def write_points(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.col("coords").cast("array<string>"), " ")).alias("value")).write.mode("overwrite").text(path)
