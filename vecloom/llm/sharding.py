"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group. Groups stand in the order of a text digest, and the sequence is cut
into contiguous shards so that the fullest shard is as small as possible: a binary search over the capacity, each
step checked greedily, finds the smallest feasible one, and the cuts of its greedy check are the shard borders.

The search never sees the groups one by one. It starts from at most CELLS sums over equal stretches of digest
space. Cutting at stretch borders only bounds the optimum from above, cutting anywhere from below. The stretches
that may hold a cut of any capacity between the bounds are split further until they hold single groups, or few
enough groups to list. The rest stay sums. The driver thus holds a bounded number of sums at any input size, and
a group that fills a third of the table is one number. Rows find their shard by comparing their digest with the
cuts, without a join; places within a shard are running sums over bounded groups.

Defined results: a null text has size 1, like an empty one, but is a group of its own. Repeated rows are equal
texts and share a shard. One group larger than a fair share makes its shard that large; other shards may then be
empty, as may any when there are fewer groups than shards. Empty tables give empty results. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import GROUP_ROWS, running_sum, spread, written

#: Bits of the digest that order groups; stretches that a pass sums at most; groups listed at most.
BITS, STEP, LISTED = 60, 14, 1 << 18


def group_key(text: Column) -> Column:
    """The first 60 bits of the text's SHA-256; nulls come last of all."""
    return F.coalesce(F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long"), F.lit(1 << BITS))


def greedy(sums: list[int], capacity: int, shards: int, whole: bool) -> list[int] | None:
    """Where shards end if each is filled up to capacity: positions on the running sums. Not whole: anywhere.
    None if shards do not reach the end."""
    ends, at = [], 0
    for _ in range(shards):
        limit = at + capacity
        at = sums[bisect_right(sums, limit) - 1] if whole else min(limit, sums[-1])
        ends.append(at)
    return ends if at >= sums[-1] else None


def smallest(sums: list[int], shards: int, whole: bool = True) -> int:
    """The smallest capacity with which greedy filling needs no more than shards."""
    low, high = 0, sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(sums, middle, shards, whole) is None:
            low = middle + 1
        else:
            high = middle
    return high


def minimax_cuts(groups: DataFrame, shards: int, step: int = STEP, listed: int = LISTED) -> list[int]:
    """The keys at which shards 1, 2, ... begin, from groups (key, bytes) with a row for each group."""
    def summed(df: DataFrame, spans: list[tuple[int, int]], width: int) -> list[tuple[int, int, int, int]]:
        """First key, end, bytes and groups of the stretches of 2^width keys within the spans."""
        span = shard_of(F.col("key"), [first for first, _ in spans[1:]])
        sums = df.groupBy(span.alias("span"), F.shiftright("key", width).alias("cell")).agg(F.sum("bytes"), F.count(F.lit(1)))
        return sorted((max(c << width, spans[i][0]), min((c + 1) << width, spans[i][1]), n, k) for i, c, n, k in sums.collect())

    cells = summed(groups, [(0, 2 << BITS)], BITS + 1 - step)
    while cells:
        sums = [0, *accumulate(c[2] for c in cells)]
        exact = [c[1] - c[0] == 1 or c[3] == 1 for c in cells]
        low = max(smallest(sums, shards, whole=False), max((c[2] for c, e in zip(cells, exact, strict=True) if e), default=0))
        high = smallest(sums, shards)
        spans = [(i, i + 1) for i, c in enumerate(cells) if c[2] > low and not exact[i]]
        if not spans:  # then every stretch fits into low, and greedy filling with low moves on
            at = 0
            for end in greedy(sums, high, shards, False) or []:
                at = sums[bisect_right(sums, at + low) - 1]
                spans.append((max(bisect_right(sums, at) - 1, 0), min(bisect_right(sums, end), len(cells))))
        # single groups of a size to be reckoned with (16 a shard at most) stay as they are
        spans = [run for x in _joined(spans) for run in _runs(x, [e and c[2] * 2 * shards > low for c, e in zip(cells, exact, strict=True)]) if not all(exact[run[0] : run[1]])]
        if not spans:
            ends = greedy(sums, high, shards, True) or []
            return [cells[i][0] if (i := bisect_right(sums, e) - 1) < len(cells) else 2 << BITS for e in ends[:-1]]
        split = [c for first, last in spans for c in cells[first:last]]
        widest = max(c[1] - c[0] for first, last in spans for c, e in zip(cells[first:last], exact[first:last], strict=True) if not e)
        narrow = 0 if sum(c[3] for c in split) <= listed else max(0, (widest - 1).bit_length() - step)
        keys = [(cells[first][0], cells[last - 1][1]) for first, last in spans]
        inside = reduce(or_, ((F.col("key") >= a) & (F.col("key") < b) for a, b in keys))
        keep = [c for i, c in enumerate(cells) if not any(first <= i < last for first, last in spans)]
        cells = sorted(keep + summed(groups.where(inside), keys, narrow))
    return []


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _runs(span: tuple[int, int], apart: list[bool]) -> list[tuple[int, int]]:
    """span without the items set apart."""
    edges = [span[0] - 1, *(i for i in range(*span) if apart[i]), span[1]]
    return [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if a + 1 < b]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key, size and text_crc32 of docs (doc_id, text)."""
    return docs.select("doc_id", group_key(F.col("text")).alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def shard_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie at or before key."""
    return sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (places 0, 1, ... in the shard, in the order of a digest of the id)."""
    rows = written(sized(docs))
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    n = rows.count()
    placed = rows.withColumn("shard", shard_of(F.col("key"), minimax_cuts(groups, shards)))
    placed = placed.withColumns({"digest": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "one": F.lit(1)})
    _, fine = spread(F.col("digest"), F.lit(-(-n // (GROUP_ROWS * shards)) or 1))
    placed = placed.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / 1024))
    return running_sum(placed, ["shard"], ["coarse", "fine"], ["digest", "size", "text_crc32"], "one", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op8_shard(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
