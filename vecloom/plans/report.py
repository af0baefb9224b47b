"""How good and how fast a search was, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.neighbours import ratios, summary


def report_lines(results: DataFrame, truth: DataFrame, k: int, query_count: int) -> DataFrame:
    """qid and line of each query: how many were found, their distances, the ratio; an error mark if it is below 1."""
    scored = ratios(results, truth, query_count)
    found = results.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist"))), lambda x: x["dist"]).alias("dists"))  # k at most
    parts = [F.concat(F.lit("query "), F.col("qid").cast("string")), F.concat(F.lit("found "), F.col("found").cast("string"))]
    parts += [F.concat(F.lit("distances "), F.array_join(F.transform("dists", lambda x: F.format_number(x, 4)), " "))]
    parts += [F.concat(F.lit("ratio "), F.format_number("ratio", 6)), F.when(~F.col("valid"), F.lit("SMALLER THAN ONE"))]
    return scored.join(found, "qid", "left").select("qid", F.concat_ws("; ", *parts).alias("line"))


def report(results: DataFrame, truth: DataFrame, k: int, query_count: int, seconds: dict[str, float], radii: int) -> str:
    """Every query's line, both averages, missed queries, seconds of the phases and radii searched."""
    lines = [r.line for r in report_lines(results, truth, k, query_count).orderBy("qid").collect()]  # query_count at most
    total = summary(ratios(results, truth, query_count), k, query_count).first()
    lines += [f"average ratio of answered queries {total.average_ratio}", f"average ratio of all queries {total.strict_ratio}", f"missed queries {total.missed}"]
    return "\n".join([*lines, *(f"{phase} {s} s" for phase, s in seconds.items()), f"radii searched {radii}", ""])


def write_report(spark, text: str, path: str) -> None:
    """As one file, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
