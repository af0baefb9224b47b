"""A corpus from raw documents to shards: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame of documents; between stages it is written as
Parquet and read again. All stages but the last return the columns of documents, the last adds shard.

Defined results. Nulls: a null text scores by the bias alone, is near to nothing, holds no benchmark passage, and goes in
mixing, as every text without words does: the mix consists of words. A null doc_id stays through the near-duplicate
stage, a null source is a source, null labels teach nothing. Texts of any length are read whole. Ties: of near copies the
least doc_id stays, and of rows that share a doc_id one; sources are ordered by name, documents of one by a digest of
their id, copies by slot and id. Repeated rows are scored and searched alike, and are reduced by the near-duplicate
stage unless their doc_id is null. Empty tables give empty results; without labels of both kinds, nothing is toxic. Extra
columns of documents are carried through whatever their names, but for one named shard, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import decontaminate, mixing, near_dup, sharding, toxicity
from vecloom.llm.common import table, written

SHARDS = 8
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages train a model and confirm links on sets of shingles; SQL has no equal of that.
ORACLE_SQL = None


def keeps_extra_columns(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with columns other than those of documents under names of no meaning while it runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENTS}
        out = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        replaced = [c for c in out.columns if c in hidden]
        return out.drop(*(hidden[c] for c in replaced)).withColumnsRenamed({h: c for c, h in hidden.items() if c not in replaced})

    return run_stage


@keeps_extra_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. The model learns from the labels of these documents."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "__toxic").where(F.col("__toxic") < toxicity.THRESHOLD).drop("__toxic")


@keeps_extra_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group. Of rows that share a doc_id one stays; rows without a
    doc_id all stay."""
    found = near_dup.near_duplicates(docs).where("kept and doc_id is not null")
    kept = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")))
    once = docs.join(kept.where("__rows = 1"), "doc_id", "left_semi")
    many = docs.join(kept.where("__rows > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(many).unionByName(docs.where("doc_id is null")).select(*docs.columns)


@keeps_extra_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    flagged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), report="__report")
    return flagged.where(~F.col("__report.contaminated")).drop("__report")


@keeps_extra_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words: not at all, once or twice, in the order of the schedule's
    slots. The schedule takes a stretch of each source's shuffled stream, so only documents at its end are taken in part;
    these are rounded to the nearest number of copies. Rows alike in id, source and size share what they take."""
    plan = mixing.mix(docs)
    taken = mixing.taken_words(plan).join(plan.sources.select("sid", "source"), "sid").where("size > 0")
    copies = taken.groupBy("doc_id", "source", "size").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("__copies"), F.min("first_slot").alias("__first"), F.min("repeat_slot").alias("__again")).where("__copies > 0")
    copies = copies.withColumnsRenamed({"doc_id": "__doc", "source": "__source", "size": "__size"})
    sized = docs.withColumn("__words", mixing.word_count(F.col("text")))
    held = sized.join(copies, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    shown = held.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    slot = F.when(F.col("__copy") > 1, F.coalesce("__again", "__first")).otherwise(F.coalesce("__first", "__again"))
    return shown.withColumn("__slot", slot).orderBy("__slot", "doc_id", "__copy").select(*docs.columns)


@keeps_extra_columns
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard, of SHARDS shards of nearly equal bytes; equal texts share a shard."""
    rows = sharding.sized(docs)
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    return docs.withColumn("shard", sharding.shard_of(sharding.group_key(F.col("text")), sharding.minimax_cuts(groups, SHARDS)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
