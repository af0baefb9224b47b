"""The pipeline's stages, each against a restatement of what it must keep that shares no code with it."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_operators import brute_groups, brute_scores, brute_trained, smallest_capacity

from vecloom.llm import toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans(text, benchmark):
    """Whether the text holds a window of ten words of an item, or a whole item of fewer."""
    lowered = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    words = lowered(text)
    for item in benchmark:
        own = lowered(item)
        size = min(len(own), 10)
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        if any(tuple(words[i : i + size]) in windows for i in range(len(words) - size + 1)):
            return True
    return False


def targets(sizes, weights):
    """Shares of 150 % of all words by weight, no more than twice a source's size, the excess reshared."""
    left, open_, out = 1.5 * sum(sizes.values()), dict(weights), {}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_every_stage_and_the_run(spark, folder):
    clash = [f"d.n_chars as `{c}`" for c in ("__toxic", "__words", "__report", "shard", "comp", "extra_0")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").alias("d").selectExpr("doc_id", "text", "lang", "source", "n_chars", *clash)
    columns, before = docs.columns, docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert sorted(out.columns) == sorted(columns) and all(r["comp"] == r["n_chars"] == r["extra_0"] for r in rows)
        after = [r.doc_id for r in rows]
        if name == "toxicity":
            known = {}
            for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
                if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
                    known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
            taught = [(r.text, known[r.doc_id]) for r in before if r.doc_id in known]
            scores = brute_scores(brute_trained(taught), [r.text for r in before])
            clear = {r.doc_id: s < toxicity.THRESHOLD for r, s in zip(before, scores, strict=True) if abs(s - toxicity.THRESHOLD) > 0.02}
            assert all((d in after) == kept for d, kept in clear.items()) and len(clear) > 0.9 * len(before)
        if name == "near_duplicates":
            assert sorted(after) == sorted(d for d, (_, least) in brute_groups([(r.doc_id, r.text) for r in before]).items() if d == least)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert sorted(after) == sorted(r.doc_id for r in before if not spans(r.text, items))
        if name == "mixing":
            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
            by_source = {}
            for r in before:
                by_source[r.source] = by_source.get(r.source, 0) + size[r.doc_id]
            order = sorted(by_source, key=lambda s: (s is None, s or ""))
            target = targets(by_source, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
            times = {d: after.count(d) for d in set(after)}
            assert set(after) <= {d for d, n in size.items() if n} and max(times.values()) <= 2
            largest = max(size.values())
            for s in order:
                got = sum(size[r.doc_id] * times.get(r.doc_id, 0) for r in before if r.source == s)
                assert abs(got - target[s]) <= largest
        if name == "sharding":
            assert sorted(after) == sorted(r.doc_id for r in before)
            held = {}
            for r in rows:
                held.setdefault(r.text, set()).add(r.shard)
            assert all(len(s) == 1 for s in held.values()) and {r.shard for r in rows} <= set(range(8))
            import hashlib

            groups = {}
            for r in rows:
                key = hashlib.sha256((r.text or "").encode()).hexdigest()[:15]
                groups[key] = groups.get(key, 0) + len((r.text or "").encode()) + 1
            load = np.bincount([r.shard for r in rows], [len((r.text or "").encode()) + 1 for r in rows], 8)
            assert max(load) == smallest_capacity([groups[k] for k in sorted(groups)], 8)
        docs, before = spark.createDataFrame(rows, out.schema), rows
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_copies_follow_the_schedule(spark, folder):
    """Every source is spread over the whole mix: each half holds near half of its words."""
    text = "w " * 40
    docs = spark.createDataFrame([(i, text, "en", "abc"[i % 3], len(text)) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    shown = [r.source for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()]
    for s in "abc":
        assert shown[: len(shown) // 2].count(s) == pytest.approx(shown.count(s) / 2, abs=0.1 * len(shown))
