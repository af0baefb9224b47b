"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and characters beyond ASCII. The hash of every GRAM consecutive
words is taken, and of each WINDOW_WORDS-word window the least of its hashes is its fingerprint. A shared window
has the same fingerprint on both sides, so joining fingerprints finds every shared span of that length. Neighbouring
windows mostly have the same least hash, so a document looks up one fingerprint for each run of them; the windows of
the runs that hit are extended to whole windows, whose 64-bit hash and word hashes must equal those of a benchmark
window. Items shorter than a window are fingerprinted as wholes, for which every place of a document is looked up.

Equal benchmark texts are one text with several ids, and equal windows one window with several texts, so a document
marks a place once and lists a window's texts once, however often either repeats.

The benchmark is a stated query set: it is taken in blocks of at most block_words words (running sums of the sizes of
its texts tell a text's block; longer texts are cut into overlapping parts), each block is broadcast, its size thereby
bound, and all documents pass by it. One block does for benchmarks of a million words; with more blocks, the hits
found so far are written to the shared folder between passes.

Defined results: a null or empty text, like one without words, has no words and no hits. Null or wordless items
match nothing; a null item_id still marks words but is not counted or listed; repeated item_ids count once.
Repeated documents are judged alike. An empty benchmark leaves all clean, an empty table gives an empty result,
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import wordhash as wh
from vecloom.llm.common import GROUP_ROWS, ascii_lower, released, running_sum, shipped, spread, tidy, written

WINDOW_WORDS, GRAM = 10, 5
#: Words of one broadcast block of the benchmark: some 40 bytes each in the index.
BLOCK_WORDS = 2_000_000
_HITS, _ITEMS = "__hits", "__items"
#: What is told of a document, in the columns' order.
REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_FILTER = np.uint64((1 << 16) - 1)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The least GRAM-word hash in each window of WINDOW_WORDS words (rows' borders ignored)."""
    grams, n = wh.windows(hashes, GRAM), max(len(hashes) - WINDOW_WORDS + 1, 0)
    out = grams[:n].copy()
    for i in range(1, WINDOW_WORDS - GRAM + 1):
        np.minimum(out, grams[i : i + n], out=out)
    return out


class Index:
    """The windows of one block of texts by length. Of each distinct window: its hash (sorted), where its words begin
    in words, and which texts hold it (holders, between two offsets)."""

    def __init__(self, ids: list[list[str]], texts: pa.Array) -> None:
        self.ids = ids
        self.words, offsets = wh.words(*wh.column(texts), wh.ALNUM)
        sizes = np.diff(offsets)
        rows = np.repeat(np.arange(len(ids)), sizes)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({min(int(n), WINDOW_WORDS) for n in sizes if n}):
            at = np.flatnonzero(wh.whole(offsets, length, len(self.words)))
            if length < WINDOW_WORDS:
                at = at[sizes[rows[at]] == length]
            found = wh.windows(self.words, length)[at]
            order = np.lexsort((at, found))
            found, at = found[order], at[order]
            first = np.flatnonzero(np.diff(found, prepend=~found[:1]))
            pairs = np.unique(np.stack([np.repeat(np.arange(len(first)), np.diff(np.append(first, len(found)))), rows[at]]), axis=1)
            ends = np.searchsorted(pairs[0], np.arange(len(first) + 1))
            self.lengths[length] = found[first], at[first], ends, pairs[1]
            prints = np.unique(fingerprints(self.words)[at]) if length == WINDOW_WORDS else found[first]
            low = np.zeros(1 << 16, bool)
            low[(prints & _FILTER).astype(np.int64)] = True
            self.marks[length] = prints, low

    def hits(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: places of the documents' words at which a window of the texts begins, and which window."""
        for length, (found, begins, _, _) in self.lengths.items():
            prints, low = self.marks[length]
            if length == WINDOW_WORDS:
                mine = fingerprints(hashes)
                heads = np.flatnonzero(np.diff(mine, prepend=~mine[:1]))  # runs of windows with one least hash
            else:
                mine = wh.windows(hashes, length)
                heads = np.arange(len(mine))
            near = np.flatnonzero(low[(mine[heads] & _FILTER).astype(np.int64)])
            at = np.searchsorted(prints, mine[heads[near]])
            near = near[prints[np.minimum(at, len(prints) - 1)] == mine[heads[near]]]
            if not len(near):
                continue
            ends = np.append(heads, len(mine))
            many = ends[near + 1] - heads[near]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(heads[near], many)
            at = at[wh.whole(offsets, length, len(hashes))[at]]
            words = hashes[at[:, None] + np.arange(length)]
            full = wh.rows_hashed(words)
            window = np.minimum(np.searchsorted(found, full), len(found) - 1)
            same = (found[window] == full) & (self.words[begins[window][:, None] + np.arange(length)] == words).all(axis=1)
            if same.any():
                yield length, at[same], window[same]

    def holders(self, length: int, windows: np.ndarray) -> list[str]:
        """The ids of the texts that hold any of the windows."""
        _, _, ends, texts = self.lengths[length]
        rows = np.unique(np.concatenate([texts[ends[w] : ends[w + 1]] for w in np.unique(windows)]))
        return [x for r in rows for x in self.ids[r]]


def _pass(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in batches:
            data, places = wh.column(batch.column("text"))
            for first, last in wh.slices(places, 4 * wh.PIECE):
                base = places[first]
                hashes, offsets = wh.words(data[base : places[last]], places[first : last + 1] - base, wh.ALNUM)
                part = batch.slice(first, last - first)
                hits = [x or [] for x in part.column(_HITS).to_pylist()]
                items = [x or [] for x in part.column(_ITEMS).to_pylist()]
                for length, at, windows in block.hits(hashes, offsets):
                    docs = np.searchsorted(offsets, at, "right") - 1
                    starts = np.flatnonzero(np.diff(docs, prepend=-1))
                    for first_hit, past in zip(starts, np.append(starts[1:], len(docs)), strict=True):
                        d = docs[first_hit]
                        hits[d] = hits[d] + ((at[first_hit:past] - offsets[d]) * 16 + length).tolist()
                        items[d] = items[d] + block.holders(length, windows[first_hit:past])
                new = [pa.array([sorted(set(x)) for x in found], kind) for found, kind in ((hits, pa.list_(pa.int64())), (items, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *new], names=part.schema.names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = wh.column(batch.column("text"))
        n_words = np.concatenate([np.diff(wh.words(data[places[a] : places[b]], places[a : b + 1] - places[a], wh.ALNUM)[1]) for a, b in wh.slices(places, 4 * wh.PIECE)] or [np.zeros(0, np.int64)])
        n_hit, listed = np.zeros(len(n_words), np.int64), [x or [] for x in batch.column(_ITEMS).to_pylist()]
        for d, hits in enumerate(batch.column(_HITS).to_pylist()):
            if hits:
                edge = np.zeros(n_words[d] + 1, np.int64)
                at = np.array(hits, np.int64)
                np.add.at(edge, at >> 4, 1)
                np.add.at(edge, (at >> 4) + (at & 15), -1)
                n_hit[d] = np.count_nonzero(np.cumsum(edge))
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
        report = [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0)]
        names = [field.split()[0] for field in REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.StructArray.from_arrays(report, names)], names=[*batch.schema.names[:-2], "__report"])


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> DataFrame:
    """block, text and ids (of the items with that text): no more than 2 * block_words words in a block."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("text is not null")
    # a word takes two bytes with what parts it from the next, so this bounds the words
    sized = sized.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids"), (F.floor(F.octet_length("text") / 2) + 1).alias("size"))
    own = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    step, past = F.lit(block_words), F.lit(block_words + WINDOW_WORDS - 1)  # each window lies in one part
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("own") - WINDOW_WORDS, F.lit(0)) / step).cast("int")), lambda i: F.array_join(F.slice("own", i * step + 1, past), " "))
    long = sized.where(F.col("size") > block_words).withColumn("own", own).select("ids", F.explode(parts).alias("text"))
    every = sized.where(F.col("size") <= block_words).select("ids", "text").unionByName(long)
    every = written(every.withColumns({"size": F.least((F.floor(F.octet_length("text") / 2) + 1).cast("long"), F.lit(block_words + WINDOW_WORDS)), "digest": F.sha2("text", 256), "one": F.lit(1)}))
    n = every.count()
    coarse, fine = spread(F.col("digest"), F.lit(-(-n // GROUP_ROWS) or 1))
    placed = running_sum(every.withColumns({"coarse": coarse, "fine": fine}), ["one"], ["coarse", "fine"], ["digest"], "size", "before")
    out = written(placed.select(F.floor(F.col("before") / block_words).alias("block"), "text", "ids"))
    released(every)
    return out


def contamination_hits(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, which have a text column, with __hits (16 * place of a shared window's first word + its length in words)
    and __items (ids as strings, sorted) at the end, against benchmark (item_id, text)."""
    shipped(docs.sparkSession)
    spark = docs.sparkSession
    texts = benchmark_blocks(benchmark, block_words)
    blocks = 1 + (texts.agg(F.max("block")).first()[0] or 0)
    df = docs.withColumns({_HITS: F.array().cast("array<long>"), _ITEMS: F.array().cast("array<string>")})
    for i in range(blocks):
        block = texts.where(F.col("block") == i).toArrow()
        if block.num_rows:
            index = spark.sparkContext.broadcast(Index(block.column("ids").to_pylist(), block.column("text")))
            df = df.mapInArrow(tidy(_pass(index)), df.schema)
            if i + 1 < blocks:
                df = written(df)
    return df


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, report: str = "report") -> DataFrame:
    """docs, which have a text column, with a struct of the fields of REPORT."""
    hits = contamination_hits(docs, benchmark, block_words)
    schema = T.StructType([*docs.schema.fields, T.StructField("__report", T.StructType.fromDDL(REPORT))])
    return hits.mapInArrow(tidy(_summed), schema).withColumnRenamed("__report", report)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).select("doc_id", "report.*")


OP3_SQL = r"""
WITH norm AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id, w, least(len(w), 10) AS l FROM norm WHERE side = 'b' AND len(w) > 0),
bw AS (SELECT DISTINCT id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM items)),
docs AS (SELECT rid, id, w FROM norm WHERE side = 'd'),
dw AS (SELECT rid, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: {'i': i, 's': array_to_string(w[i:i + l - 1], ' ')}), recursive := true) FROM docs, (SELECT DISTINCT l FROM items) WHERE len(w) >= l),
hit AS (SELECT rid, dw.i, dw.l, bw.id FROM dw JOIN bw USING (l, s)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT docs.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""
