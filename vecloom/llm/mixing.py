"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule has N slots, N a power of two. Slot j is the van der Corput point j (its bits reversed); mapped
through the sources' cumulative targets it names a source, so that every stretch of the schedule holds each
source in proportion. Slots are ranked per source. A source's documents, shuffled by a digest of their ids,
form one stream of words that is cut into blocks of equal numbers of words; the slot of rank r takes block
r mod blocks. Documents join the ranked slots on (source, block). A document is first shown at the first slot that
takes a word of it, and repeated at the first slot of the source's second pass that does. Built-in column functions only.

Bit reversal is its own inverse, so each source lists the slots of the points it owns without a join.

Blocks are too coarse for a source with few slots. One with fewer than FEW_SLOTS is not cut into blocks: its slots,
one at least, share its target's whole words evenly, in the order of its stream, which starts again at its end. It
gets exactly the floor of its target. A source too small to own a point shares the slot of the point at its place.

Ranks and stream offsets are running sums over bounded groups (common.running_sum), so a source that holds a
third of all rows is no single task. Sources are numbered and filled by running sums over ranges (in_order), so there
may be millions of them.

Defined results: a null text has size 0, takes nothing and is still returned; null is a source of its own,
the last; a null doc_id is shuffled like an empty id. Repeated rows take their turn one after another. Empty
tables give empty results. Extra columns are ignored. Reruns agree, as nothing random is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLANKS, GROUP_ROWS, in_order, running_sum, spread, written

#: Fixed values of the contract: weights of the sources in turn, share of all words, passes over a source at most.
WEIGHTS, SHARE_NUM, SHARE_DEN, MOST_PASSES = (5, 2, 1), 3, 2, 2
#: Slots that the smallest target gets, words of a block at least and at most. The number of slots follows.
LEAST_SLOTS, LEAST_BLOCK, MOST_BLOCK = 1024, 64, 65536
#: Slots below which a source is not cut into blocks: a slot more or less would be over a thirtieth of its target.
FEW_SLOTS = 32
#: Points of one source that one row lists.
LISTED = 4096


@dataclass(frozen=True)
class Mix:
    """docs: doc_id, sid, size, start (its place in the source's stream). sources: sid, source, source_size,
    target, blocks, first and last (the points it owns or shares), few (slots, so no blocks) and words (whole words of
    the target). schedule: slot, sid, rank, block, epoch; for a source of few slots the slot of rank r takes words
    r * words div blocks to (r + 1) * words div blocks of its repeated stream, blocks being its number of slots."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def water_filled(sources: DataFrame) -> DataFrame:
    """Adds weight, target, from sid (1, 2, ... in order) and source_size. What a source cannot take is reshared
    by weight: sources in the order of cap over weight fill up until the common level lies below their own."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    df = sources.withColumn("weight", weight).withColumn("cap_by_weight", F.col("source_size") * MOST_PASSES / F.col("weight"))
    df, (size, heavy) = in_order(df, ["cap_by_weight", "sid"], {"capped": "source_size", "light": "weight"})
    left = F.lit(size).cast("long") * SHARE_NUM - F.col("capped") * MOST_PASSES * SHARE_DEN
    df = df.withColumn("level", left / ((F.lit(heavy).cast("long") - F.col("light")) * SHARE_DEN).cast("double"))
    fitting = F.min(F.when(F.col("level") <= F.col("cap_by_weight"), F.struct("cap_by_weight", "sid", "level")))
    common = F.lit(df.agg(fitting["level"].alias("level")).first()[0]).cast("double")
    target = F.when(F.col("cap_by_weight") <= common, F.col("source_size") * MOST_PASSES).otherwise(F.col("weight") * common)
    return df.withColumn("target", target.cast("double")).drop("cap_by_weight", "level", "capped", "light")


def _power_of_two(x: float) -> int:
    return 1 << max(0, int(x) - 1).bit_length()


def _reversed_bits(x: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else x


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, sid and rank for each of slots points; sources has first and last, the points that each owns."""
    bits = slots.bit_length() - 1
    owned = sources.where("last > first").select("sid", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / LISTED), F.floor((F.col("last") - 1) / LISTED))).alias("part"))
    listed = F.sequence(F.greatest("first", F.col("part") * LISTED), F.least("last", (F.col("part") + 1) * LISTED) - 1)
    points = owned.repartition("sid", "part").select("sid", F.explode(listed).alias("point"))
    named = points.select(_reversed_bits(F.col("point"), bits).alias("slot"), "sid", F.lit(1).alias("one"))
    fine = F.floor(F.col("slot") / (4 * GROUP_ROWS))
    named = named.withColumns({"coarse": F.floor(fine / 1024), "fine": fine})
    return running_sum(named, ["sid"], ["coarse", "fine"], ["slot"], "one", "rank").select("slot", "sid", "rank")


def mix(docs: DataFrame) -> Mix:
    """Plans the mix of all docs (doc_id, text, source)."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    named, _ = in_order(named.withColumn("one", F.lit(1)), [F.asc_nulls_last("source")], {"sid": "one"})
    sources = water_filled(named.drop("one").withColumn("sid", (F.col("sid") + 1).cast("int")))
    sources, (total,) = in_order(sources.withColumn("words", F.floor("target").cast("long")), ["sid"], {"before": "words"})
    sources = sources.withColumns({"past": F.col("before") + F.col("words"), "all": F.lit(total).cast("long")}).drop("before")
    least = sources.agg(F.coalesce(F.min(F.when(F.col("words") > 0, F.col("words"))), F.lit(1))).first()[0]
    slots = min(_power_of_two(max(LEAST_SLOTS * total / least, total / MOST_BLOCK, 1)), max(_power_of_two(total / LEAST_BLOCK), _power_of_two(total / MOST_BLOCK), 1))
    own = {"first": F.expr(f"cast(coalesce((cast(past - words as decimal(19,0)) * {slots}) div nullif(all, 0), 0) as bigint)"), "last": F.expr(f"cast(coalesce((cast(past as decimal(19,0)) * {slots}) div nullif(all, 0), 0) as bigint)")}
    own["last"] = F.greatest(own["last"], F.when(F.col("words") > 0, own["first"] + 1).otherwise(own["first"]))
    few = (F.col("words") > 0) & (F.col("last") - F.col("first") < FEW_SLOTS)
    blocks = F.greatest(F.ceil((F.col("last") - F.col("first")) * (F.col("source_size") / F.col("target"))), F.ceil((F.col("last") - F.col("first")) / MOST_PASSES), F.lit(1))
    sources = sources.withColumns(own).withColumn("few", few).withColumn("blocks", F.when(F.col("few"), F.col("last") - F.col("first")).otherwise(F.coalesce(blocks, F.lit(1))).cast("long"))
    sources = written(sources.select("sid", "source", "source_size", "target", "n_docs", "blocks", "first", "last", "few", "words"))
    plan = schedule(sources, slots).join(sources.select("sid", "blocks"), "sid")
    plan = written(plan.select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch")))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.join(sources.select(F.col("source").alias("_source"), "sid", "n_docs"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("digest", digest)
    coarse, fine = spread(F.col("digest"), F.ceil(F.col("n_docs") / GROUP_ROWS))
    keyed = keyed.withColumns({"fine": fine}).withColumn("coarse", F.floor(F.col("fine") / 1024))
    placed = running_sum(keyed.select("doc_id", "sid", "size", "digest", "coarse", "fine"), ["sid"], ["coarse", "fine"], ["digest", "size"], "size", "start")
    return Mix(placed.select("doc_id", "sid", "size", "start"), sources, plan)


def taken_words(m: Mix) -> DataFrame:
    """doc_id, sid, size, start, taken (the words of each document that the slots' blocks take, and repeats), and
    first_slot and repeat_slot, the slots at which it is first shown and first repeated; null if it is not."""
    by = m.sources.select("sid", "source_size", "blocks", "few", "words")
    at = "cast((cast({} as decimal(19,0)) * blocks {}) div source_size as bigint)"
    first, last = F.expr(at.format("start + 1", "- 1")), F.expr(at.format("start + size", "- 1"))
    placed = m.docs.where("size > 0").join(by, "sid")
    rest = F.least(F.greatest(F.expr("words % source_size") - F.col("start"), F.lit(0)), F.col("size"))
    # of a few slots, the one that takes the document's first word in either pass
    rank = "case when {0} < words then cast((cast({0} + 1 as decimal(19,0)) * blocks - 1) div words as bigint) end"
    whole = placed.where("few").select("doc_id", "sid", "size", "start", (F.expr("words div source_size") * F.col("size") + rest).alias("taken"), F.expr(rank.format("start")).alias("r0"), F.expr(rank.format("(start + source_size)")).alias("r1"))
    for r, out in (("r0", "first_slot"), ("r1", "repeat_slot")):
        whole = whole.join(m.schedule.select("sid", F.col("rank").alias(r), F.col("slot").alias(out)), ["sid", r], "left").drop(r)
    held = placed.where("not few").drop("few", "words").withColumn("block", F.explode(F.sequence(first, last)))
    edge = "cast((cast({} as decimal(19,0)) * source_size) div blocks as bigint)"
    overlap = F.least(F.expr(edge.format("block + 1")), F.col("start") + F.col("size")) - F.greatest(F.expr(edge.format("block")), F.col("start"))
    slot = lambda epoch: F.min(F.when(F.col("epoch") == epoch, F.col("slot")))
    taken = m.schedule.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), slot(0).alias("s0"), slot(1).alias("s1"))
    rows = held.withColumn("words", overlap).where("words > 0").join(taken, ["sid", "block"], "left")
    some = rows.groupBy("doc_id", "sid", "size", "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"), F.min("s0").alias("first_slot"), F.min("s1").alias("repeat_slot"))
    none = F.lit(None).cast("long")
    empty = m.docs.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), none.alias("first_slot"), none.alias("repeat_slot"))
    return some.unionByName(whole).unionByName(empty)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return taken_words(m).join(m.sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken", "first_slot", "repeat_slot")


def _power_sql(x: str) -> str:
    return f"(2 ** ceil(log2(greatest(floor({x}), 1))))::BIGINT"


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
OP5_SQL = f"""
WITH z AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM z GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[(sid - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {MOST_PASSES} / {list(WEIGHTS)}[(sid - 1) % {len(WEIGHTS)} + 1] AS r FROM n),
f AS (SELECT *, ((sum(source_size) OVER ()) * {SHARE_NUM} - coalesce(sum(source_size) OVER (ORDER BY r, sid {_BEFORE}), 0) * {MOST_PASSES * SHARE_DEN})::DOUBLE
        / (((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY r, sid {_BEFORE}), 0)) * {SHARE_DEN})::DOUBLE AS level FROM w),
c AS (SELECT arg_min(level, (r, sid)) AS common FROM f WHERE level <= r),
t AS (SELECT sid, source, source_size, (CASE WHEN r <= common THEN source_size * {MOST_PASSES} ELSE weight * common END)::DOUBLE AS target FROM f, c),
g AS (SELECT coalesce(sum(floor(target)), 0)::DOUBLE AS total, coalesce(min(floor(target)) FILTER (floor(target) > 0), 1)::DOUBLE AS least FROM t),
s AS (SELECT least({_power_sql(f"greatest({LEAST_SLOTS} * total / least, total / {MOST_BLOCK}, 1)")}, greatest({_power_sql(f"total / {LEAST_BLOCK}")}, {_power_sql(f"total / {MOST_BLOCK}")})) AS slots, total::BIGINT AS total FROM g),
o AS (SELECT t.*, ((sum(floor(target)::BIGINT) OVER (ORDER BY sid) * slots) // total - (coalesce(sum(floor(target)::BIGINT) OVER (ORDER BY sid {_BEFORE}), 0) * slots) // total)::BIGINT AS own FROM t, s),
b AS (SELECT *, coalesce(greatest(ceil(own * (source_size / target)), ceil(own / {MOST_PASSES}), 1), 1)::BIGINT AS blocks FROM o),
d AS (SELECT rid, doc_id, size, b.*, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size {_BEFORE}), 0)::BIGINT AS start FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source),
j AS (SELECT (SELECT slots FROM s) AS slots, unnest(range((SELECT slots FROM s))) AS slot),
v AS (SELECT slot, coalesce(list_sum(list_transform(range(0, log2(slots)::BIGINT), lambda i: ((slot >> i) & 1) << (log2(slots)::BIGINT - 1 - i))), 0)::BIGINT AS point FROM j),
own_ AS (SELECT sid, blocks, coalesce(sum(own) OVER (ORDER BY sid {_BEFORE}), 0)::BIGINT AS lo, sum(own) OVER (ORDER BY sid)::BIGINT AS hi FROM b),
h AS (SELECT sid, slot, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM v JOIN own_ ON point >= lo AND point < hi),
q AS (SELECT sid, rank % blocks AS i, min(slot) FILTER (rank < blocks) AS s0, min(slot) FILTER (rank >= blocks AND rank < 2 * blocks) AS s1 FROM h GROUP BY ALL),
k AS (SELECT rid, sid, source_size, blocks, own, start, size, unnest(range(((start + 1) * blocks - 1) // source_size, ((start + size) * blocks - 1) // source_size + 1)) AS i FROM d WHERE size > 0),
y AS (SELECT rid, sum((least((i + 1) * source_size // blocks, start + size) - greatest(i * source_size // blocks, start)) * (CASE WHEN i < own THEN (own - 1 - i) // blocks + 1 ELSE 0 END))::BIGINT AS taken, min(s0) AS first_slot, min(s1) AS repeat_slot FROM k LEFT JOIN q USING (sid, i)
  WHERE least((i + 1) * source_size // blocks, start + size) > greatest(i * source_size // blocks, start) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, repeat_slot FROM d LEFT JOIN y USING (rid)
"""
