"""Query batches that arrive as a stream, answered one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.plans.engine import Index, search


def answer_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends (batch, qid, rank, id, dist) to Parquet under path for a stream of (qid, coords)."""

    def answer(batch: DataFrame, number: int) -> None:
        search(index, batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
