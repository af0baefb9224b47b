"""Operators against brute force, round trips, held-out accuracy, and in their less common paths."""

import bisect
import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.llm import common, decontaminate, licenses, mixing, near_dup, quality, secrets, sharding, token_count, toxicity, url_filter, wordhash
from vecloom.llm.queries import queries


def docs_of(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def test_rules_joined_equal_rules_inlined(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    columns = ["page_id", "host", "path", "rule", "verdict", "pattern"]
    inline, joined = (sorted(map(repr, url_filter.filter_urls(pages, inline_rules=n).select(columns).collect())) for n in (256, 0))
    assert inline == joined
    assert {r.verdict for r in url_filter.filter_urls(pages, rules=()).collect()} == {"allow"}


def test_rule_is_filed_under_its_rarest_token():
    rule = url_filter.host_path_rule("block", "example.com", "/en/7")
    assert rule.tokens == ("example", "com", "en")
    assert list(url_filter.rarest_index([rule], {"example": 5, "com": 9, "en": 2})) == ["en"]


@pytest.mark.parametrize(
    ("line", "tokens", "fits", "not_fits"),
    [
        ("||cheap-pills.", ("cheap", "pills"), ["cheap-pills.example.org/en", "m.cheap-pills.net/"], ["not-cheap-pills.net/", "a.com/cheap-pills."]),
        ("||tracker.net^", ("tracker", "net"), ["tracker.net", "x.tracker.net/a"], ["tracker.network/", "mytracker.net/"]),
        ("/banner/*/top^", ("banner", "top"), ["a.com/banner/x/TOP/", "a.com/banner/x/y/top"], ["a.com/banner/top", "a.com/banner/x/topper"]),
        ("/login.php|", ("login", "php"), ["a.com/login.php"], ["a.com/login.phpx"]),
        ("/(^|[.-])casino[0-9]*\\./", (), ["casino12.com/", "my-casino.org/"], ["casinos.com/"]),
        ("/ads/track/", (), ["x.com/ads/tracker"], ["x.com/ad/track"]),
        ("@@||good.org^", ("good", "org"), ["good.org/spam"], ["bad.org/good.org"]),
    ],
)
def test_lines_of_a_filter_list(line, tokens, fits, not_fits):
    rule = url_filter.list_rule(line)
    assert rule.tokens == tokens and rule.action == ("allow" if line.startswith("@@") else "block")
    pattern = rule.pattern.replace(r"\z", r"\Z")
    assert all(re.search(pattern, u) for u in fits) and not any(re.search(pattern, u) for u in not_fits)


def test_thousands_of_rules_equal_every_rule_tried(spark):
    r = random.Random(2)
    names = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(400)]
    lines = [f"||{r.choice(names)}-{r.choice(names)}." for _ in range(3000)] + [f"/{n}/*{r.choice(names)}^" for n in names[:50]] + [f"@@||{n}.org^" for n in names[:20]] + ["/aa+b/", "! no rule", ""]
    rules = url_filter.list_rules(lines)
    urls = [f"http://{r.choice(names)}{r.choice('.-')}{r.choice(names)}.org/{r.choice(names)}/{r.choice(names)}" for _ in range(1500)]
    urls += [f"http://{x.strip('|.')}.net/" for x in lines[:200]] * 2 + [None]
    found = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string"), rules).collect()
    compiled = [(x, re.compile(x.pattern.replace(r"\z", r"\Z"))) for x in rules]
    for row in found:
        fit = max(((x.weight, x.name, x.action) for x, p in compiled if p.search(row.host + row.path)), default=(0, None, "allow"))
        assert (row.pattern, row.verdict) == fit[1:]


def test_words_longer_than_a_piece_end_with_their_row():
    rows = ["x" * (3 * wordhash.PIECE - 5), "ab cd", "y" * (wordhash.PIECE + 9) + " z", "", "é" * wordhash.PIECE, "end"]
    data, offsets = wordhash.column(pa.array(rows))
    hashes, counts = wordhash.words(data, offsets, wordhash.VISIBLE)
    assert np.diff(counts).tolist() == [len(t.split()) for t in rows]
    alone = [wordhash.words(*wordhash.column(pa.array([t])), wordhash.VISIBLE)[0] for t in rows]
    assert (np.concatenate(alone) == hashes).all()


def test_repeats_of_items_and_windows_are_no_product(spark):
    """10,000 equal items against a text that repeats them 10,000 times."""
    text = "aa bb cc dd ee ff gg hh ii jj kk ll "
    found = decontaminate.decontaminate(docs_of(spark, [(1, text * 10_000)]), docs_of(spark, [(i, text) for i in range(10_000)], "item_id long, text string")).first().report
    assert (found.n_hit, found.n_items) == (120_000, 10_000)


def test_items_larger_than_a_block_are_cut(spark):
    r = random.Random(1)
    words = [r.choice([f"w{k}" for k in range(300)]) for _ in range(3000)]
    bench = docs_of(spark, [(1, " ".join(words)), (2, "a b c"), (2, "a b c"), (3, " ".join(words[:40]))], "item_id long, text string")
    docs = docs_of(spark, [(i, " ".join(words[i * 53 : i * 53 + r.randint(5, 60)])) for i in range(56)])
    whole, cut = (sorted(map(repr, decontaminate.decontaminate(docs, bench, block_words=n).select("doc_id", "report.*").collect())) for n in (10**6, 700))
    assert whole == cut
    sizes = {r.block: r.n for r in decontaminate.benchmark_blocks(bench, 700).selectExpr("block", "size(split(text, ' ')) n").groupBy("block").agg(F.sum("n").alias("n")).collect()}
    assert len(sizes) > 3 and max(sizes.values()) <= 1400


def test_a_hundred_thousand_spans_in_one_text(spark):
    n = 100_000
    text = "".join(f"token=abcdef{i} " for i in range(n))
    row = secrets.scan_secrets(docs_of(spark, [(1, text + "login: bob " + "Ab3" * 14)])).selectExpr("size(base) as n", "element_at(base, -1) as last", "linked").first()
    assert (row.n, row.last.stop) == (n, len(text) - 1)
    assert [(s.start, s.kind) for s in row.linked] == [(len(text), 4), (len(text) + 11, 5)]


def test_blocks_of_the_benchmark_give_the_same_hits(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    whole, blocks = (sorted(decontaminate.decontaminate(docs, bench, block_words=n).select("doc_id", "report.*").collect()) for n in (10**6, 60))
    assert whole == blocks and any(r.contaminated for r in whole)


def test_toxicity_learns_only_from_rows_that_are_not_held_out(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        words, toxic = [r.choice(vocabulary) for _ in range(r.randint(30, 200))], int(i % 4 == 0)
        if toxic:
            words[:: 20] = [r.choice(["nastyword", "vileterm", "badphrase"]) for _ in words[:: 20]]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - toxic))
    docs = docs_of(spark, [*rows, (1000, None), (1001, ""), (None, "nastyword")])
    model = toxicity.trained(docs, docs_of(spark, labels, "doc_id long, toxic int"))
    scores = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scores[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    assert scores[1000] == scores[1001]
    known, misspelt, clean = model.scores(pa.array([f"{' '.join(vocabulary[:15])} {w}" for w in ("nastyword", "nastywerd", "river")]))
    assert misspelt > clean and known > clean


def grams_of(text):
    """Buckets of the character n-grams of a text, one after another, in plain Python."""
    mask, out = (1 << 64) - 1, []
    letters = "".join(c if ord(c) >= 128 else chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalnum() else "\0" for c in f"\0{text or ''}\0")
    factors = [int(f) for f in toxicity._FACTORS]
    for n in range(toxicity.LEAST_N, toxicity.MOST_N + 1):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if "\0" not in gram[1:-1]:
                x = sum((ord(c) + 1) * f for c, f in zip(gram, factors)) & mask
                for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                    x = ((x ^ (x >> 33)) * factor) & mask
                out.append((x ^ (x >> 33)) >> (64 - toxicity.BUCKET_BITS))
    return out


def dense_model(bags, labels, used, seed=7):
    """Joint training on a dense matrix, written without the shortcuts: vectors, averages, two logits, softmax."""
    place = {g: i for i, g in enumerate(used)}
    x = np.zeros((len(bags), len(used)))
    for row, bag in enumerate(bags):
        for g in bag:
            if g in place:
                x[row, place[g]] += 1 / len(bag)
    rng = np.random.Generator(np.random.PCG64(seed))
    v, w, bias = rng.normal(0, 0.1, (len(used), toxicity.DIMENSIONS)), rng.normal(0, 0.5, (2, toxicity.DIMENSIONS)), np.zeros(2)
    taught = np.array([{1: toxicity.TOXIC_WEIGHT, 0: 1.0, -1: 0.0}[y] for y in labels])
    taught /= taught.sum()
    truth = np.array([[y == 0, y == 1] for y in labels], float)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (v, w, bias)]
    for step in range(1, toxicity.STEPS + 1):
        mean = toxicity.SCALE * x @ v
        logits = mean @ w.T + bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (e / e.sum(axis=1, keepdims=True) - truth) * taught[:, None]
        gradients = [toxicity.SCALE * x.T @ (error @ w) + toxicity.DECAY * v, error.T @ mean, error.sum(axis=0)]
        for p, g, (m, s) in zip((v, w, bias), gradients, state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= toxicity.RATE * (1 - step / (toxicity.STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return dict(zip(used, v @ (w[1] - w[0]))), bias[1] - bias[0]


def logit_of(bag, model):
    return toxicity.SCALE * sum(model[0].get(g, 0.0) for g in bag) / max(len(bag), 1) + model[1]


def brute_trained(rows):
    """The model of (text, label) rows, with the bias that its folds teach."""
    bags, labels = [grams_of(t) for t, _ in rows], [y for _, y in rows]
    held = lambda kept: collections.Counter(g for i in kept for g in set(bags[i]))
    used = sorted(g for g, n in held(range(len(rows))).items() if n >= toxicity.LEAST_TEXTS)
    numbers, bias = dense_model(bags, labels, used)
    fold = [sum(z == labels[i] for z in labels[:i]) % toxicity.FOLDS for i in range(len(rows))]
    if min(labels.count(0), labels.count(1)) >= toxicity.FOLDS:
        logits = [0.0] * len(rows)
        for k in range(toxicity.FOLDS):
            n = held(i for i in range(len(rows)) if fold[i] != k)
            model = dense_model(bags, [-1 if f == k else y for f, y in zip(fold, labels)], used)
            known = {g: x for g, x in model[0].items() if n[g] >= toxicity.LEAST_TEXTS}, model[1]
            for i in (i for i in range(len(rows)) if fold[i] == k):
                logits[i] = logit_of(bags[i], known)
        best, cut = -1.0, max(logits) + 1.0
        for c in sorted(set(logits), reverse=True):
            caught, false = (np.mean([x >= c for x, y in zip(logits, labels) if y == z]) for z in (1, 0))
            if false <= toxicity.MOST_FALSE and caught - false > best:
                best, cut = caught - false, (c + max([x for x in logits if x < c], default=c)) / 2
        bias += np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)) - cut
    return numbers, bias


def brute_scores(model, texts):
    return [1 / (1 + np.exp(-np.clip(logit_of(grams_of(t), model), -60, 60))) for t in texts]


def test_toxicity_equals_a_plain_trainer_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, several texts of one doc_id, clashing columns."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeiourstlné") for _ in range(r.randint(2, 7))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(12)) + (" Nasty-Word" if i % 3 == 0 else "")) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " ... "), (43, "z" * 50_000), (None, "nastyword"), (7, rows[7][1]), (9, "aaa first of all"), (9, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(44)] + [(3, 0), (5, None), (None, 1)]
    docs = docs_of(spark, [(*x, "s", 1.5) for x in rows], "doc_id long, text string, digest string, score double")
    known = docs_of(spark, [(*x, "d") for x in labels], "doc_id long, toxic int, digest string")
    texts = {}
    for i, t in rows:
        own = hashlib.sha256((t or "").encode()).hexdigest(), t or ""
        texts[i] = min(own, texts.get(i, own))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    taught = sorted((hashlib.md5(str(i).encode()).hexdigest(), texts[i][1], int(i % 3 == 0)) for i in range(44) if not held(i) and i != 5)
    expected = brute_trained([x[1:] for x in taught])
    for _ in range(2):  # reruns agree
        out = toxicity.score(docs, toxicity.trained(docs, known), "found").collect()
        assert [r.found for r in out] == pytest.approx(brute_scores(expected, [t for _, t in rows]), abs=1e-3)
        assert all(r.score == 1.5 for r in out)


def test_scores_do_not_depend_on_pieces(monkeypatch):
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS), 0.1)
    texts = pa.array(["some words here " * 40, None, "", "ü" * 500, "short"])
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity.wh, "PIECE", 64)
    assert np.allclose(whole, model.scores(texts))


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    r = random.Random(1)
    sources = ["a", "b", "c", None, "z"]
    rows = [(i, "w " * r.randint(0, 60), sources[0] if i % 3 else sources[i % 5]) for i in range(1500)]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(None, "n n n", "a"), (9000, None, "b"), (9001, " ", None)]
    docs = docs_of(spark, rows, "doc_id long, text string, source string")
    m = mixing.mix(docs)
    taken = mixing.taken_words(m).collect()
    assert len(taken) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in taken)
    total = {s.sid: s for s in m.sources.collect()}
    assert abs(sum(s.target for s in total.values()) - 1.5 * sum(s.source_size for s in total.values())) < 1e-3
    for sid, s in total.items():
        assert s.target <= 2 * s.source_size + 1e-6
        assert abs(sum(x.taken for x in taken if x.sid == sid) - s.target) <= 0.03 * s.target + 64
    again = mixing.taken_words(mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(repr, taken)) == sorted(map(repr, again))


def test_small_sources_get_their_exact_words_beside_millions(spark):
    sizes = {"a": 2_000_000, "b": 5, "c": 3_000_000, "d": 20, "e": 50, "f": 1_000_000, "g": 200, None: 7}
    rows = [(f"{s}{i}", "w " * (n // 10 if n >= 1000 else 5), s) for s, n in sizes.items() for i in range(10 if n >= 1000 else n // 5)]
    rows.append(("rest", "w w", None))
    m = mixing.mix(docs_of(spark, rows, "doc_id string, text string, source string"))
    taken, slots = mixing.taken_words(m).collect(), {r.sid: r["count"] for r in m.schedule.groupBy("sid").count().collect()}
    assert len(taken) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in taken)
    for s in m.sources.collect():
        got = sum(x.taken for x in taken if x.sid == s.sid)
        assert slots[s.sid] == s.last - s.first >= 1
        assert got == int(s.target) if s.source_size < 1000 else abs(got - s.target) <= 0.001 * s.target


def filled(sizes, weights):
    """Targets by resharing the excess until none is above its cap."""
    total, capped = 1.5 * sum(sizes), set()
    while True:
        left = total - sum(2 * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [2 * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(out) if i not in capped and t > 2 * sizes[i]}
        if not above:
            return out
        capped |= above


def test_targets_equal_resharing_step_by_step(spark):
    r = random.Random(2)
    for n in (1, 2, 7, 25):
        sizes = [r.choice([1, 10, 1000, 5000]) for _ in range(n)]
        df = mixing.water_filled(spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "sid int, source_size long"))
        found = [x.target for x in df.orderBy("sid").collect()]
        assert found == pytest.approx(filled(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)]))


def test_targets_of_more_words_than_an_int_holds_thrice(spark):
    """Some 5 GB of documents, whose number of words fits an int where three times it does not."""
    for sizes in ([400_000_000, 300_000_000, 100_000_000], [2_000_000_000, 10, 2_000_000_000]):
        df = mixing.water_filled(spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "sid int, source_size long"))
        found = [r.target for r in df.orderBy("sid").collect()]
        assert found == pytest.approx(filled(sizes, [mixing.WEIGHTS[i % 3] for i in range(3)]))


def test_schedule_spreads_every_source(spark):
    sources = spark.createDataFrame([(1, 0, 600), (2, 600, 900), (3, 900, 1024)], "sid int, first long, last long")
    slots = mixing.schedule(sources, 1024).orderBy("slot").collect()
    assert [s.slot for s in slots] == list(range(1024))
    for start in range(0, 1024, 128):
        held = sum(s.sid == 1 for s in slots[start : start + 128])
        assert abs(held - 75) <= 2
    for sid in (1, 2, 3):
        assert [s.rank for s in slots if s.sid == sid] == list(range(sum(s.sid == sid for s in slots)))


def test_running_sum_over_levels(spark):
    rows = [(k, i, (i * 37) % 11) for k in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, v long").withColumns({"fine": F.expr("i div 10"), "coarse": F.expr("i div 100")})
    got = {(r.k, r.i): r.before for r in common.running_sum(df, ["k"], ["coarse", "fine"], ["i"], "v", "before").collect()}
    for k in (1, 2):
        for i in range(300):
            assert got[k, i] == sum(v for kk, j, v in rows if kk == k and j < i)


def greedy_cuts(sizes, capacity):
    """Where filling one shard after another starts a new one; None if an item is larger than a shard."""
    cuts, held = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if held + size > capacity:
            cuts.append(i)
            held = 0
        held += size
    return cuts


@pytest.mark.parametrize("lang", ["fi", None, "en"])
def test_quality_tells_prose_from_noise_in_any_language(spark, lang):
    r = random.Random(7)
    common = "the of and to in a is that it for".split()
    vocabulary = ["".join(r.choice("aeiouäy") if i % 2 else r.choice("klmnprstvh") for i in range(r.randint(3, 9))) for _ in range(400)]
    prose = [" ".join((r.choice(common) if r.random() < 0.35 else r.choice(vocabulary)).capitalize() if r.random() < 0.1 else r.choice(vocabulary) if r.random() < 0.6 else r.choice(common) for _ in range(200)) + "." for _ in range(60)]
    noise = [" ".join("".join(r.choice("0123456789#%&*$@XZQ") for _ in range(r.randint(2, 8))) for _ in range(200)) for _ in range(4)]
    docs = docs_of(spark, [(i, t, lang) for i, t in enumerate(prose + noise)], "doc_id long, text string, lang string")
    found = {x.doc_id: (x.base_failed, x.kept) for x in quality.judge(docs).collect()}
    assert all(found[i] == (False, i < len(prose)) for i in range(len(prose) + len(noise)))


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        cuts = greedy_cuts(sizes, middle)
        if cuts is not None and len(cuts) < shards:
            high = middle
        else:
            low = middle + 1
    return low


@pytest.mark.parametrize("how", [{}, {"step": 4, "listed": 0}, {"step": 3, "listed": 10}])
def test_shards_are_as_small_as_can_be(spark, how):
    r = random.Random(6)
    for n, hot in ((3, False), (40, False), (1500, True)):
        keys = sorted(r.sample(range(1 << 60), n))
        sizes = [r.randint(1, 50) for _ in keys]
        if hot:
            sizes[n // 3] = sum(sizes)
        cuts = sharding.minimax_cuts(spark.createDataFrame(list(zip(keys, sizes)), "key long, bytes long"), 8, **how)
        load = [0] * 8
        for k, s in zip(keys, sizes):
            load[bisect.bisect_right(cuts, k)] += s
        assert max(load) == smallest_capacity(sizes, 8)


def test_small_partitions_equal_all_ways_to_cut():
    for sizes in ([3, 1, 4, 1, 5], [9, 1, 1], [2, 2, 2, 2]):
        ways = [sum(sizes[a:b]) for n in (1, 2) for a, b in [(0, 1)]] and min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in itertools.combinations(range(1, len(sizes)), 2))
        assert smallest_capacity(sizes, 3) == ways


def test_rows_of_a_shard_are_numbered_and_equal_texts_stay_together(spark, folder):
    out = queries()["op8_shard"](spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    by_text = {}
    for r in out:
        text = docs[r.doc_id]
        by_text.setdefault(text, set()).add(r.shard)
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
    assert all(len(s) == 1 for s in by_text.values())


@pytest.fixture(scope="module")
def tokenizer():
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return tokenizers.Tokenizer.from_file(path), token_count.Counter(f.read())


def test_token_counts_equal_the_library(spark, folder, tokenizer):
    library, _ = tokenizer
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries()["op7_token_counts"](spark, folder).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_transducer_equals_the_library_on_odd_strings(tokenizer):
    library, counter = tokenizer
    r = random.Random(4)
    letters = "etaoin shrdlu  \n\n\t'sstllve0123456789.,!?ÉéüßñöЖ中文😀  \x85\x1c"
    found = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    found += ["".join(r.choice(["<|endoftext|>", "the", "ing", " ", "<|", "\n"]) for _ in range(r.randint(0, 20))) for _ in range(1000)]
    found += ["a" * 5000, " " * 300 + "x", "-" * 999, "ab " * 40000]
    expected = [len(e.ids) for e in library.encode_batch(found, add_special_tokens=False)]
    assert [counter.count(t) for t in found] == expected
    for size in (7, 100):
        assert [counter.whole([counter.chunk(t[i : i + size]) for i in range(0, len(t), size)]) for t in found] == expected


def test_long_texts_are_counted_in_chunks(spark, tokenizer):
    import public_tokenizers

    library, _ = tokenizer
    texts = ["word, and more<|endoftext|>  here\n" * 300, "x" * 5000, "", None, "a b", " " * 3000, "né中 " * 2000]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    found = token_count.count_tokens(docs_of(spark, [(i, t) for i, t in enumerate(texts)]), vocabulary, long=1000, chunk=37).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="normalizer"):
        token_count.Counter(vocabulary.replace('"normalizer":null', '"normalizer":{"type":"NFC"}').replace('"normalizer": null', '"normalizer": {"type": "NFC"}'))


def brute_groups(rows):
    """Shingle sets, and the least id of everything reachable over similar pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    original = [r.choice(vocabulary) for _ in range(100)]
    rows = [(i, None if i == 3 else "") for i in range(2, 5)]
    for i in range(10, 90):  # one group of copies with so many changes that few pairs are similar enough
        copy = list(original)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(100)] = r.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(original[:50] + [r.choice(vocabulary) for _ in range(50)])) for i in range(90, 130)]
    rows += [(130, "a b"), (131, "A  B"), (132, "a b c"), (133, " ".join(original)), (134, " ".join(original))]
    expected = brute_groups(rows)
    found = near_dup.near_duplicates(docs_of(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == expected
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


@pytest.fixture
def counted(monkeypatch):
    """Counts the tables that near_dup writes; blocks and keys are so small that every group is split."""
    tables = []
    keep = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df: tables.append(1) or keep(df))
    for name, value in (("BLOCK", 16), ("KEY_PAIRS", 5), ("PAIRS", 100)):
        monkeypatch.setattr(near_dup, name, value)
    return tables


def test_versions_of_a_drifting_text_and_templates_equal_brute_force(spark, counted):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    text, rows = [r.choice(vocabulary) for _ in range(120)], []
    for i in range(200):
        rows.append((i, " ".join(text)))
        for _ in range(4):
            text[r.randrange(120)] = r.choice(vocabulary)
    parts = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(20)]
    rows += [(1000 + i, " ".join(parts[k] for k in sorted(r.sample(range(20), 10)))) for i in range(250)]
    found = near_dup.near_duplicates(docs_of(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_groups(rows)


def test_a_long_chain_needs_few_rounds(spark, counted):
    links = docs_of(spark, [(i, i + 1) for i in range(1000)], "a long, b long")
    assert {r.comp for r in near_dup.components(links).collect()} == {0} and len(counted) <= 15


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    found = near_dup.near_duplicates(docs_of(spark, [(None, text), (5, text), (5, text), (3, text), (8, "other"), (8, None)])).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in found if x.doc_id is not None) == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 8, True), (8, 8, True)]
    assert [(x.component_id, x.kept) for x in found if x.doc_id is None] == [(None, True)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100)], "a long, b long")
    assert {r.node: r.comp for r in near_dup.components(links).collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50}


def test_whole_licences_are_found_whatever_their_form(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.replace(" ", "\n").upper()), (2, mit + " and more"), (3, mit.replace("sublicense", "sub-license")), (4, "Copyright 2020")]
    found = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert found == {1: "MIT", 2: None, 3: "MIT", 4: None}


def test_licences_are_found_as_published(spark):
    own = {f.stem: f.read_text(encoding="utf-8") for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    mit = textwrap.fill(next(t for n, t in licenses.KNOWN if n == "MIT"), 78)
    bsd = own["BSD-2-Clause"].replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS", 1)
    texts = [(n, t) for n, t in own.items()]
    texts += [("MIT", f"{title}\n\nCopyright (c) 2020 Someone\n\n{mit}\n") for title in ("MIT License", "The MIT License (MIT)")]
    texts += [("MIT", f"MIT License\n\nCopyright Foo contributors.\n\n{mit}"), ("MIT", f"Copyright Foo contributors.\n{mit}"), (None, f"{mit}\nand more"), (None, "MIT License"), (None, "Copyright Foo\n")]
    texts += [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2021, Someone\nAll rights reserved.\n\n{bsd}")]
    texts += [("Apache-2.0", own["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 Someone")), ("Apache-2.0", own["Apache-2.0"].split("   APPENDIX")[0])]
    found = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, [(i, t) for i, (_, t) in enumerate(texts)])).collect()}
    assert [found[i] for i in range(len(texts))] == [n for n, _ in texts]
