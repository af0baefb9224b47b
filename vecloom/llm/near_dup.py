"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document has a signature of COORDINATES minima of hashed 5-word shingles. Documents with equal shingle sets
form one class, and classes are posted under each (coordinate, value) pair. Two classes are candidates if they
collide in at least MATCHES coordinates:

* Prefix: values are ordered by how many classes hold them, rarest first. Classes that collide often enough must
  meet within the first COORDINATES - MATCHES + 1 values of both, so only those are posted.
* Skip: values that a single class holds can meet nothing; they use up the prefix without being posted, and a
  class with fewer than MATCHES shared values is skipped as a whole.
* Count: for each pair that meets, all collisions are counted, and pairs below MATCHES go. So do pairs whose sketches
  (one byte for each of BINS bins of the hash space, that of the bin's least hash) are further apart than chance
  allows for sets as similar as PERCENT.

Links are then confirmed on the full sets of shingle hashes. At a similarity of 0.75 the chance to miss MATCHES of
COORDINATES collisions is 4e-6 for a pair, that to fail the sketches 4e-6, and less for closer pairs.

Groups of thousands of near copies are not expanded into all pairs; what is in one component needs no further
comparison. First each class meets one class alone: the most connected one (the pivot) of most of its lists. Then it
meets the pivots of its lists that are still in other components. Lists that hold several components even then, one of
those with the same classes, are compared in blocks of at most BLOCK classes: those outside the list's largest component with each other and with that
component's. Only pairs of different components, of fitting sizes and sketches leave a block: first the likeliest one
of each class. Classes in no such pair are done, as components only grow. When these pairs are confirmed and joined,
what remains is compared in full, so no link between components is lost: each class then brings its crossing shingles,
those that a class of another component holds too (a pair has nothing else in common), if they are enough for any link.
Pairs are decided inside their block, and a block tells no more than one link for each pair of components.

Components come from contraction: each node points to its least neighbour, pointers are followed to their ends by
doubling, and links between the ends remain. Both loops are logarithmic, also for long chains of versions. A class that
a third of all pairs name is spread over several keys before the sets are joined. All intermediate tables are written
to the shared folder, and deleted after their last reader.

Defined results: texts without words, and nulls, have no shingles and are linked with nothing. A null doc_id is
linked with nothing, has a null component_id and is kept. Rows that share a doc_id count as one document, linked by any
of its texts; repeated rows count once. Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm import wordhash as wh
from vecloom.llm.common import released, shipped, tidy, written

SHINGLE, PERCENT = 5, 75
COORDINATES, MATCHES = 48, 22
#: Bins of a sketch, and by how many standard deviations a pair's equal bins may fall short of what PERCENT expects.
BINS, SLACK = 256, 4.5
#: Classes of one side of a block, pairs compared at once, and pairs of one class under one key.
BLOCK, PAIRS, KEY_PAIRS = 2048, 1 << 17, 2000
#: Keys with more pairs than that, as rows of a broadcast.
MOST_BUSY = 200_000
_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(22)).integers(1, 1 << 64, COORDINATES, dtype=np.uint64) | _U(1)
_MARKS = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 64, COORDINATES, dtype=np.uint64)


def shingles(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of rows of text, repeats included, and the offsets of the rows among them."""
    hashes, offsets = wh.words(data, places, wh.VISIBLE)
    counts = np.diff(offsets)
    every = wh.windows(hashes, SHINGLE)
    kept = every[wh.whole(offsets, SHINGLE, len(every))]
    sizes = np.maximum(counts - SHINGLE + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        before = np.concatenate([[0], np.cumsum(sizes)])[short]
        whole = [wh.mixed(wh.windows(hashes[offsets[r] : offsets[r + 1]], int(counts[r])) ^ _U(counts[r])) for r in short]
        kept = np.insert(kept, before, np.concatenate(whole))
        sizes[short] = 1
    return kept, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """For each bin, by the top byte, a byte from 1 to 255 of the least hash in it, or 0: of sorted distinct hashes."""
    bins = (own >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = own[first] % _U(255) + _U(1)
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of sketches may be of similar enough sets, and their estimated similarity in thousandths. sizes: of
    both sets together. The bins in use show so many of the union's hashes, drawn without putting back."""
    held = np.count_nonzero(a | b, axis=1)
    equal = np.count_nonzero((a == b) & (a > 0), axis=1)
    share = PERCENT / 100
    union = np.maximum(sizes / (1 + share), held)
    spread = np.sqrt(share * (1 - share) * held * (union - held) / np.maximum(union - 1, 1))
    return equal >= share * held - SLACK * spread - 1, 1000 * equal // np.maximum(held, 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = wh.column(batch.column("text"))
        for a, b in wh.slices(places):
            found, offsets = shingles(data[places[a] : places[b]], places[a : b + 1] - places[a])
            full = np.flatnonzero(np.diff(offsets))
            tokens = np.zeros((len(full), COORDINATES), _U)
            if len(full):
                for k in range(COORDINATES):
                    tokens[:, k] = np.minimum.reduceat(found * _FACTORS[k], offsets[full])
                tokens = wh.mixed(tokens ^ _MARKS)
            n, digest, sketches = np.zeros(b - a, np.int64), [None] * (b - a), [None] * (b - a)
            for r in full:
                own = np.unique(found[offsets[r] : offsets[r + 1]])
                n[r], digest[r], sketches[r] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), sketch(own)
            ends = np.zeros(b - a + 1, np.int32)
            ends[1:] = np.cumsum(np.where(np.diff(offsets) > 0, COORDINATES, 0))
            signature = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.reshape(-1).view(np.int64)))
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(digest, pa.binary()), signature, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "signature", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle hashes of every row, as bytes."""
    for batch in batches:
        data, places = wh.column(batch.column("text"))
        for a, b in wh.slices(places):
            found, offsets = shingles(data[places[a] : places[b]], places[a : b + 1] - places[a])
            own = [np.unique(found[offsets[r] : offsets[r + 1]]).tobytes() for r in range(b - a)]
            digest = [hashlib.blake2b(x, digest_size=16).digest() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(digest, pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "digest", "own"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        ok = alike(_sketches(batch.column("sketch_a")), _sketches(batch.column("sketch_b")), sizes)[0]
        yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(ok)) for x in ("a", "b")], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for r, (x, y) in enumerate(zip(batch.column("own_a"), batch.column("own_b"), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
            if len(x) and 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[r] = 100 * common >= PERCENT * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(linked)) for x in ("a", "b")], names=["a", "b"])


def _comparing(likeliest: bool):
    """The likeliest pair of each row of blocks, whose rows follow each other in the order of value, i, j and side, so
    that each row with any likely pair is named; or, from the rows' crossing shingles, a link for each two components
    that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            keys = np.stack([held.column(x).to_numpy() for x in ("value", "i", "j")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            if starts[-1]:  # the last block may go on
                yield from _block_pairs(held.slice(0, int(starts[-1])), keys[:, : starts[-1]], starts[:-1], likeliest)
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            keys = np.stack([held.column(x).to_numpy() for x in ("value", "i", "j")])
            yield from _block_pairs(held, keys, np.zeros(1, np.int64), likeliest)

    return run


def _block_pairs(rows: pa.RecordBatch, keys: np.ndarray, starts: np.ndarray, likeliest: bool) -> Iterator[pa.RecordBatch]:
    n_rows = rows.num_rows
    node, comp, n, side = (rows.column(x).to_numpy() for x in ("node", "comp", "n", "side"))
    crossing = None if likeliest else [np.frombuffer(v.as_buffer(), _U) for v in rows.column("crossing")]
    reach = n if likeliest else np.array([len(x) for x in crossing])
    sketches, sizes = _sketches(rows.column("sketch")), np.diff(np.append(starts, n_rows))
    end = np.repeat(starts + sizes, sizes)
    middle = np.repeat(starts + np.add.reduceat(1 - side, starts), sizes)
    first = np.where(keys[1] == keys[2], np.arange(n_rows) + 1, middle)
    count = np.where(side == 0, end - first, 0)
    past = np.cumsum(count)
    named = np.zeros(n_rows, bool)
    at = 0
    while at < n_rows:
        stop = max(at + 1, int(np.searchsorted(past, past[at] - count[at] + PAIRS, "right")))
        many = count[at:stop]
        x = np.repeat(np.arange(at, stop), many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at:stop], many)
        # no more can be common than the smaller reach, and what is common is in neither's rest
        fit = (comp[x] != comp[y]) & ((100 + PERCENT) * np.minimum(reach[x], reach[y]) >= PERCENT * (n[x] + n[y]))
        x, y = x[fit], y[fit]
        if len(x):
            ok, estimate = alike(sketches[x], sketches[y], n[x] + n[y])
            x, y, estimate = x[ok], y[ok], estimate[ok]
            if likeliest:
                best = _best(x, estimate)
                named[x[best]] = named[y[best]] = True
                rest = np.flatnonzero(~named[y])
                rest = rest[_best(y[rest], estimate[rest])]
                named[y[rest]] = True
                best = np.concatenate([best, rest])
                x, y = x[best], y[best]
            else:
                x, y = _linked(x, y, np.argsort(-estimate, kind="stable"), comp, n, crossing)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])
        at = stop


def _best(rows: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """For each different row, where it has its greatest estimate."""
    order = np.lexsort((estimate, rows))
    return order[np.flatnonzero(np.diff(rows[order], append=-1))]


def _linked(x: np.ndarray, y: np.ndarray, order: np.ndarray, comp: np.ndarray, n: np.ndarray, crossing: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, in the order given, those that are similar enough; one for each two components."""
    out, known = [], set()
    low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
    for k in order.tolist():
        ends = low[k], high[k]
        if ends not in known:
            a, b = x[k], y[k]
            both = np.sort(np.concatenate([crossing[a], crossing[b]]), kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= PERCENT * (n[a] + n[b] - common):
                known.add(ends)
                out.append(k)
    return x[out], y[out]


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node reachable over links (a, b), for every node that has a link."""
    labels = None
    links = written(links.where("a <> b").distinct())
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        roots = written(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
        while True:  # each pass makes the way to the end three times as short
            up = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_up"))  # noqa: E731, B023
            higher = roots.join(up("root"), "root").withColumnRenamed("root_up", "next").join(up("next"), "next")
            higher = written(higher.select("node", F.col("next_up").alias("root"), (F.col("next_up") != F.col("next")).alias("moved")))
            settled = higher.where("moved").isEmpty()
            released(roots)
            roots = higher
            if settled:
                break
        if labels is None:
            labels = written(roots.select("node", F.col("root").alias("comp")))
        else:
            before, labels = labels, written(labels.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
            released(before)
        to = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: E731, B023
        moved = links.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        before, links = links, written(moved.where("a <> b").distinct())
        released(before, roots)
    if labels is None:
        labels = written(links.select(F.col("a").alias("node"), F.col("b").alias("comp")))
    released(links)
    return labels


def _relabelled(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """labels after the components in joined, of components and of nodes without a label, became one."""
    moved = labels.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("last")), "comp", "left")
    return written(moved.select("node", F.coalesce("last", "comp").alias("comp")).unionByName(joined.join(labels, "node", "left_anti")))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _beside(pairs: DataFrame, table: DataFrame, end: str, other: str) -> DataFrame:
    """pairs with the columns of table (node, ...) for one end. A node that many pairs name is one key for every
    KEY_PAIRS of them, and its row of the table is copied as often."""
    own = [F.col(c).alias(f"{c}_{end}") for c in table.columns if c != "node"]
    busy = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("named")).where(F.col("named") > KEY_PAIRS)
    n = busy.limit(MOST_BUSY + 1).count()
    if not n:
        return pairs.join(table.select(F.col("node").alias(end), *own), end)
    busy = busy.select(end, F.ceil(F.col("named") / KEY_PAIRS).cast("int").alias("ways"))
    busy = F.broadcast(busy) if n <= MOST_BUSY else busy
    ways = F.coalesce("ways", F.lit(1))
    copies = table.withColumnRenamed("node", end).join(busy, end, "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    spread = pairs.join(busy, end, "left").withColumn("way", F.pmod(F.xxhash64(other), ways).cast("int")).drop("ways")
    return spread.join(copies.select(end, "way", *own), [end, "way"]).drop("way")


def _confirm(pairs: DataFrame, profiles: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough collisions and near enough sketches whose full shingle sets are similar enough."""
    pairs = written(pairs)
    met = _beside(_beside(pairs, profiles, "b", "a"), profiles, "a", "b").where(F.size(F.array_intersect("shared_a", "shared_b")) >= MATCHES)
    likely = written(met.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(tidy(_likely), "a long, b long"))
    links = written(_beside(_beside(likely, sets, "b", "a"), sets, "a", "b").select("a", "b", "own_a", "own_b").mapInArrow(tidy(_confirmed), "a long, b long").distinct())
    released(pairs, likely)
    return links


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with these as a_comp and b_comp."""
    to = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    placed = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return placed.withColumns({"a_comp": F.coalesce("a_comp", "a"), "b_comp": F.coalesce("b_comp", "b")}).where("a_comp <> b_comp")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with what links joins, of which both are then deleted."""
    if links.isEmpty():
        released(links)
        return labels
    joined = components(_apart(links, labels).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    out = _relabelled(labels, joined)
    released(labels, links, joined)
    return out


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("own")]
        for a in range(0, len(own), 256):
            many, part = [len(x) for x in own[a : a + 256]], batch.slice(a, 256)
            columns = [np.repeat(part.column(c).to_numpy(), many) for c in ("node", "comp")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(own[a : a + 256]))], names=["node", "comp", "hash"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [v.values.to_numpy() for v in batch.column("hashes")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.sort(x.view(_U)).tobytes() for x in lists], pa.binary())], names=["node", "crossing"])


def _crossings(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node and crossing, the shingles (as sorted bytes) that a node of another component holds too, of those nodes
    (node, comp, n) that have enough of them for any link."""
    hashes = written(sets.join(nodes, "node").select("node", "comp", "own").mapInArrow(tidy(_exploded), "node long, comp long, hash long"))
    shared = hashes.groupBy("hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("hash")
    held = hashes.join(shared, "hash").select("node", "hash")
    enough = held.groupBy("node").agg(F.count(F.lit(1)).alias("reach")).join(nodes, "node").where(100 * F.col("reach") >= PERCENT * F.col("n"))
    listed = held.join(enough.select("node"), "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    out = written(listed.mapInArrow(tidy(_packed), "node long, crossing binary"))
    released(hashes)
    return out


def _several(placed: DataFrame) -> DataFrame:
    """The lists of placed (value, node, comp) that hold several components, one of those that hold the same classes:
    the component of most classes, and the numbers of blocks in it and outside."""
    mixed = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    sizes = placed.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("m"), *mixed)
    lists = sizes.groupBy("value").agg(F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"), F.sum("m").alias("all"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    lists = lists.where("comps > 1").groupBy("all", "x", "y").agg(F.min(F.struct("value", "most")).alias("least")).select("least.*", "all")
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    return written(lists.select("value", F.col("most.comp").alias("most"), blocks(F.col("most.m")).alias("ins"), blocks(F.col("all") - F.col("most.m")).alias("outs")))


def _list_pairs(postings: DataFrame, labels: DataFrame, profiles: DataFrame, sets: DataFrame, likeliest: bool) -> DataFrame:
    """Pairs (a, b) between components that share a list, compared in blocks: the likeliest of each class, or, without
    a further test, links."""
    placed = written(postings.join(labels, "node", "left").select("value", "node", F.coalesce("comp", "node").alias("comp")))
    several, known = _several(placed), profiles.select("node", "n", "sketch")
    if not likeliest:
        nodes = written(placed.join(several.select("value"), "value", "left_semi").select("node", "comp").distinct().join(profiles.select("node", "n"), "node"))
        crossings = _crossings(nodes, sets)
        all_placed, placed, all_several = placed, written(placed.join(crossings.select("node"), "node", "left_semi")), several
        released(all_placed, all_several, nodes)
        several, known = _several(placed), known.join(crossings, "node")
    rows = placed.join(several, "value").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("comp") == F.col("most"), F.col("ins")).otherwise(F.col("outs"))).cast("int"))
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own, outs = F.col("own"), F.col("outs")
    inside = F.transform(F.sequence(F.lit(0), outs - 1), lambda i: pair(i, outs + own, F.lit(1)))
    outside = F.transform(F.sequence(F.lit(0), outs + F.col("ins") - 1), lambda k: pair(F.least(k, own), F.greatest(k, own), (k < own)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("comp") == F.col("most"), inside).otherwise(outside))).select("value", "at.*", "node", "comp")
    rows = rows.join(known, "node").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "side")
    rows = rows.select("value", "i", "j", "side", "node", "comp", *(c for c in known.columns if c != "node"))
    pairs = written(rows.mapInArrow(tidy(_comparing(likeliest)), "a long, b long").distinct())
    released(placed, several)
    return pairs


def _set_table(docs: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """node and own, the bytes of its set, of classes (node, first: a document that has it)."""
    rows = docs.join(classes.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = rows.mapInArrow(tidy(_sets), "doc_id long, digest binary, own binary").withColumn("node", F.xxhash64("digest")).drop("digest")
    sets = sets.join(classes.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"], "left_semi")
    if repeated.isEmpty():
        return written(sets.drop("doc_id"))
    again = repeated.select("doc_id")
    return written(sets.join(again, "doc_id", "left_anti").drop("doc_id").unionByName(sets.join(again, "doc_id", "left_semi").dropDuplicates(["node"]).drop("doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of docs (doc_id, text)."""
    shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = docs.mapInArrow(tidy(_signed), "doc_id long, n_shingles long, digest binary, signature array<long>, sketch binary")
    signed = written(signed.withColumn("node", F.when(F.col("digest").isNotNull(), F.xxhash64("digest"))).drop("digest"))
    posted = signed.where("node is not null and doc_id is not null")
    classes = written(posted.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.any_value(x).alias(x) for x in ("n_shingles", "signature", "sketch"))))
    values = classes.select("node", F.explode("signature").alias("value"))
    held = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = values.join(held, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    listed = listed.where(F.size("values") >= MATCHES).select("node", F.col("values.value").alias("shared"))
    profiles = written(listed.join(classes.select("node", "first", F.col("n_shingles").alias("n"), "sketch"), "node"))
    repeated = written(posted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("low"), F.max("node").alias("high")).where("rows > 1"))
    sets = _set_table(docs, profiles.select("node", "first"), repeated)
    prefix = F.slice("shared", F.lit(1), F.size("shared") - MATCHES + 1)
    postings = written(profiles.select("node", F.size("shared").alias("n"), F.explode(prefix).alias("value")))
    profiled = profiles.select("node", "n", "shared", "sketch")

    best = F.max(F.struct("n", "node"))
    pivots = postings.groupBy("value").agg(best["node"].alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    meets = written(postings.join(pivots, "value").where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("times")))
    nearest = meets.groupBy("node").agg(F.max(F.struct("times", "pivot"))["pivot"].alias("pivot"))
    both = posted.join(repeated.where("low <> high").select("doc_id", "low"), "doc_id").select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = _confirm(nearest.select(F.col("pivot").alias("a"), F.col("node").alias("b")), profiled, sets)
    labels = components(links.unionByName(both))
    released(links)
    others = _apart(meets.select(*_ordered(F.col("pivot"), F.col("node"))).distinct(), labels)
    labels = _merged(labels, _confirm(others.select("a", "b"), profiled, sets))
    released(meets)
    pairs = _list_pairs(postings, labels, profiles, sets, True)
    labels = _merged(labels, _confirm(pairs, profiled, sets))
    likely = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()  # no others have links left
    labels = _merged(labels, _list_pairs(postings.join(likely, "node", "left_semi"), labels, profiles, sets, False))
    released(pairs, postings, profiles, sets, repeated)

    placed = classes.select("node", "first").join(labels, "node")
    least = placed.groupBy("comp").agg(F.min("first").alias("component"))
    named = written(classes.select("node", "first").join(placed.join(least, "comp").select("node", "component"), "node", "left").select("node", F.coalesce("component", "first").alias("component_id")))
    released(classes, labels)
    out = signed.drop("signature", "sketch").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
k AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
