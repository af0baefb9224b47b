"""Column functions on values worked out by hand, formulas, searches against a sequential model, text and index round trips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vecloom.config import SCALE, WIDTH, LshConfig
from vecloom.functions import formulas, random as columns, vector
from vecloom.operators import candidates, index, neighbours
from vecloom.operators.params import make_params, params_table
from vecloom.operators.stats import radius_ladder, statistics
from vecloom.plans import engine
from vecloom.plans.iterative import search_iterative
from vecloom.plans.partitioned import search_partitioned
from vecloom.sources import text

GRID = [(1, [0, 0]), (2, [3, 4]), (3, [6, 8]), (4, [10, 0])]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(GRID, "id long, coords array<int>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ints(*values):
    return F.array(*(F.lit(v).cast("int") for v in values))


def test_vector_functions(spark):
    assert one(spark, vector.dot(ints(1, -2, 3), ints(4, 5, 6))) == 12
    assert one(spark, vector.l2(ints(0, 0), ints(3, 4))) == 5.0
    assert one(spark, vector.max_abs(ints(3, -7, 5))) == 7
    assert [one(spark, vector.compare_ints(F.lit(a), F.lit(b))) for a, b in ((1, 2), (2, 2), (3, 2))] == [-1, 0, 1]
    assert [one(spark, vector.compare_doubles(F.lit(a), F.lit(1.0))) for a in (0.9, 1 + 5e-7, 1.1)] == [-1, 0, 1]
    assert [one(spark, vector.clock(F.lit(s).cast("long"))) for s in (0, 3661, 360000)] == ["00:00:00", "01:01:01", "100:00:00"]
    assert one(spark, vector.split_start(F.lit(7).cast("long"), [0, 5, 10])) == 5


def test_fold_wraps_products_at_32_bits(spark):
    def plain(values, factors):
        r = 0
        for v, s in zip(values, factors):
            x = (v * s + 2**31) % 2**32 - 2**31
            r = (r + x if r + x >= 0 else r + x + 2**32 - 5) % (2**31 - 1)
        return r

    r = random.Random(1)
    for _ in range(20):
        values, factors = ([r.randrange(1, limit) for _ in range(4)] for limit in (2**30, 2**29))
        longs = [F.array(*(F.lit(x).cast("long") for x in xs)) for xs in (values, factors)]
        assert one(spark, vector.fold(*longs)) == plain(values, factors)


def test_larger_radii_divide_the_unit_radius():
    r = random.Random(2)
    for _ in range(1000):
        x, radius = r.randrange(10**9), r.choice([1, 2, 3, 8, 27])
        assert x // (WIDTH * SCALE * radius) == x // (WIDTH * SCALE) // radius


def test_formulas():
    p1, p2 = formulas.probabilities(2)
    assert (p1, p2) == pytest.approx((0.800532, 0.609543), abs=2e-5)
    assert formulas.probabilities(3)[1] == pytest.approx(0.465185, abs=2e-5)
    for n, m, tables in ((125, 10, 10), (500, 13, 19), (10000, 19, 69), (1048576, 29, 634)):
        assert (formulas.projections_needed(n, 2), formulas.tables_needed(m, 2)) == (m, tables)
    assert formulas.radius_count(2, 10, 2) == 4 and formulas.domain_bits(2, 10) == 5
    assert math.isclose(formulas.normal_pdf(0), 1 / math.sqrt(2 * math.pi))


def test_config_is_validated():
    for bad in ({"ratio": 1}, {"k": 0}, {"partitions": 0}, {"k": 20, "max_k": 10}):
        with pytest.raises(ValueError):
            LshConfig(**bad)
    with pytest.raises(ValueError):
        formulas.domain_bits(2**20, 2**20)


def test_statistics_of_a_grid(spark, grid):
    assert tuple(statistics(grid, 2).first()) == (2, 10, 4, 4)
    assert [r.radius for r in radius_ladder(statistics(grid, 2), 2).collect()] == [1, 2, 4, 8]
    ragged = grid.unionByName(spark.createDataFrame([(5, [1])], grid.schema))
    with pytest.raises(Exception, match="differ in length"):
        statistics(ragged, 2).collect()


def test_exact_neighbours_break_ties_by_id(spark, grid):
    asked = spark.createDataFrame([(0, [0, 0])], "qid int, coords array<int>")
    assert [(r.rank, r.id, r.dist) for r in neighbours.exact_neighbours(grid, asked, 4).orderBy("rank").collect()] == [(1, 1, 0.0), (2, 2, 5.0), (3, 3, 10.0), (4, 4, 10.0)]


def vectors(seed, n, d=6, t=30):
    r = random.Random(seed)
    return [(i, [r.randint(-t, t) for _ in range(d)]) for i in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    """Points, queries, parameters of two parts, and the same as plain values."""
    points, asked = vectors(1, 300), [(i, v) for i, v in vectors(2, 12)]
    params = [make_params(p, 6, 30, 2, 3, 5) for p in range(2)]
    table, size = params_table(spark, params), sum(p.a.size for p in params)
    p = index.with_part(spark.createDataFrame(points, "id long, coords array<int>"), 2)
    q = spark.createDataFrame(asked, "qid int, coords array<int>")
    radii = [1, 2, 4, 8, 16, 32, 64]
    every = q.join(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("part"))))
    hits = candidates.collide(index.buckets(index.base_buckets(every, table, size), radii), index.buckets(index.base_buckets(p, table, size), radii).drop("radius"))
    return points, asked, params, radii, p, q, hits


def test_buckets_by_matrices_equal_buckets_by_columns(spark, world):
    _, _, params, radii, p, _, _ = world
    key = ["part", "id", "block_id", "table_id", "radius_id", "radius", "bucket_id"]
    rows = lambda df: sorted(map(tuple, df.select(key).collect()))
    table = params_table(spark, params)
    expected = rows(index.buckets(index.base_buckets(p, table, 0), radii))
    assert rows(index.hashed(p, params, radii)) == expected
    assert rows(index.hashed(p, params, radii, 3, 2)) == [r for r in expected if r[4] == 3 and r[3] < 2]
    with pytest.raises(Exception, match="outside the domain"):
        index.hashed(p.withColumn("coords", F.transform("coords", lambda x: x + 10**8)), params, radii).collect()


def test_collisions_beyond_the_budget_are_not_expanded(spark):
    """Equal points fill a bucket of every table; no more tables are searched than the budget pays for."""
    points = spark.range(500).select("id", F.array(F.lit(3), F.lit(4)).alias("coords"))
    asked = points.where("id < 5").select(F.col("id").cast("int").alias("qid"), "coords")
    held = engine.build(points, LshConfig(k=3), asked)
    budget = held.budgets[0]
    all_of, paid = (engine.hits_by_radius(held, asked, b)(0, asked.select("qid")) for b in (None, budget))
    first = lambda df: sorted(map(tuple, candidates.within_budget(df, budget, ["qid"]).select("qid", "table_id", "id", "pos").collect()))
    assert all_of.count() == 5 * 500 * held.params[0].tables and paid.count() == 5 * 500 * -(-budget // 500)
    assert first(all_of) == first(paid) and len(first(paid)) == 5 * budget


def bucket(params, table, radius, coords):
    r = 0
    for a, b, s in zip(params.a[table], params.b[table], params.s[params.block(table)]):
        v = (sum(int(x) * c for x, c in zip(a, coords)) + int(b) + params.half * SCALE) // (WIDTH * SCALE) // radius
        x = (v * int(s) + 2**31) % 2**32 - 2**31
        r = (r + x if r + x >= 0 else r + x + 2**32 - 5) % (2**31 - 1)
    return r


def dist(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def modelled(points, asked, params, radii, k, ratio, factor, strict):
    """Every partition by itself: radii, then tables, then ids, until the budget is spent; then the nearest of all."""
    found = {qid: [] for qid, _ in asked}
    for p in params:
        own = [(i, v) for i, v in points if (i * 2654435761 & 0xFFFFFFFF) % len(params) == p.part]
        budget = factor * p.tables + k
        for qid, q in asked:
            met, stop = {}, None
            for r in radii:
                spent = 0
                for t in range(p.tables):
                    mine = bucket(p, t, r, q)
                    for i, v in own:
                        if spent < budget and bucket(p, t, r, v) == mine:
                            spent += 1
                            met.setdefault(i, (r, dist(v, q)))
                if spent == budget:
                    stop = r
                    break
            if strict and stop is None:
                continue
            last = stop or radii[-1]
            found[qid] += [(d, i) for i, (r, d) in met.items() if d < ratio * (r if strict else last)]
    return sorted((qid, rank + 1, i) for qid, rows in found.items() for rank, (d, i) in enumerate(sorted(rows)[:k]))


@pytest.mark.parametrize("strict", [False, True])
def test_partitioned_search_equals_the_sequential_model(world, strict):
    points, asked, params, radii, p, q, hits = world
    found = search_partitioned(hits, p, q, 5, 2, {x.part: 3 * x.tables + 5 for x in params}, radii, strict)
    assert sorted((r.qid, r["rank"], r.id) for r in found.collect()) == modelled(points, asked, params, radii, 5, 2, 3, strict)


def test_iterative_search_equals_the_sequential_model(world):
    points, asked, params, radii, p, q, hits = world
    k, ratio, budget, known = 5, 2, 3 * params[0].tables + 5, dict(points)
    state, active, steps = {qid: {} for qid, _ in asked}, {qid for qid, _ in asked}, 0
    own = [(i, v) for i, v in points if (i * 2654435761 & 0xFFFFFFFF) % 2 == 0]
    for r in radii:
        steps += 1
        for qid, v in asked:
            if qid in active:
                met = [i for t in range(params[0].tables) for i, x in own if bucket(params[0], t, r, x) == bucket(params[0], t, r, v)][:budget]
                new = {i: dist(known[i], v) for i in met if dist(known[i], v) < ratio * r}
                state[qid] = dict(sorted({**state[qid], **new}.items(), key=lambda x: (x[1], x[0]))[:k])
        active = {qid for qid in active if len(state[qid]) < k}
        if not active:
            break
    part = hits.where("part = 0")
    at = lambda i, active: part.where(F.col("radius_id") == i).join(active, "qid", "left_semi")
    found, done = search_iterative(at, p, q, k, ratio, budget, radii)
    assert done == steps
    assert sorted((r.qid, r.id) for r in found.collect()) == sorted((qid, i) for qid, s in state.items() for i in s)


def test_built_index_finds_near_points_and_ratios_are_valid(spark):
    points = spark.createDataFrame(vectors(7, 400), "id long, coords array<int>")
    asked = spark.createDataFrame(vectors(8, 10), "qid int, coords array<int>")
    truth = neighbours.exact_neighbours(points, asked, 5)
    for how in ({"config": LshConfig(k=5, partitions=3)}, {"config": LshConfig(k=5), "iterative": True}):
        found = engine.build_and_search(points, asked, **how)
        scored = neighbours.ratios(found, truth, 10)
        rows = scored.collect()
        assert len(rows) == 10 and all(r.valid for r in rows)
        best = neighbours.summary(scored, 5, 10).first()
        assert 1 <= best.average_ratio < 1.5 and 0 <= best.missed <= 10


def test_self_query_has_ratio_one_and_unanswered_queries_are_missed(spark, grid):
    truth = spark.createDataFrame([(0, 1, 0.0), (1, 1, 2.0)], "qid int, rank int, dist double")
    found = spark.createDataFrame([(0, 1, 0.0)], "qid int, rank int, dist double")
    rows = {r.qid: (r.found, r.ratio) for r in neighbours.ratios(found, truth, 2).collect()}
    assert rows == {0: (1, 1.0), 1: (0, None)}
    assert neighbours.summary(neighbours.ratios(found, truth, 2), 1, 2).first().missed == 1


def test_more_partitions_than_points(spark, grid):
    asked = spark.createDataFrame([(0, [1, 1])], "qid int, coords array<int>")
    found = engine.build_and_search(grid, asked, LshConfig(k=2, partitions=8))
    assert {r.id for r in found.collect()} <= {1, 2, 3, 4}


def test_text_round_trip(spark, grid, tmp_path):
    text.write_points(grid, f"{tmp_path}/ds")
    assert sorted(text.read_points(spark, f"{tmp_path}/ds").collect()) == sorted(grid.collect())
    assert [r.id for r in text.read_points(spark, f"{tmp_path}/ds", zero_based=True).orderBy("id").collect()] == [0, 1, 2, 3]
    assert [tuple(r) for r in text.read_queries(spark, f"{tmp_path}/ds", 2).orderBy("qid").collect()] == [(0, [0, 0]), (1, [3, 4])]
    (tmp_path / "gt").write_text("2 3\n1 0.0 5.0 10.0\n2 1.5 2.5 3.5\n")
    assert [tuple(r) for r in text.read_ground_truth(spark, f"{tmp_path}/gt", 2, 2).orderBy("qid", "rank").collect()] == [(0, 1, 0.0), (0, 2, 5.0), (1, 1, 1.5), (1, 2, 2.5)]
    with pytest.raises(ValueError):
        text.read_ground_truth(spark, f"{tmp_path}/gt", 3, 2)
    (tmp_path / "one").write_text("2 1\n9 0.5\n3 1.5\n")
    assert [tuple(r) for r in text.read_ground_truth(spark, f"{tmp_path}/one", 2, 1).orderBy("qid").collect()] == [(0, 1, 0.5), (1, 1, 1.5)]
    for with_id in (True, False):
        rows = spark.createDataFrame([(0, 1, 7, 1.5, [1, -2]), (0, 2, 8, 2.5, [0, 3]), (1, 1, 9, 0.0, [5, 5])], "qid int, rank int, id long, dist double, coords array<int>")
        text.write_results(rows, f"{tmp_path}/out", with_id)
        expected = [(*r[:2], r.id if with_id else None, *r[3:]) for r in rows.collect()]
        assert sorted(tuple(r) for r in text.read_results(spark, f"{tmp_path}/out", with_id).collect()) == sorted(expected)


def test_index_round_trip(spark, grid, tmp_path):
    config = LshConfig(k=2, partitions=2, blocks=2, split_rows=2)
    built = engine.build(grid, config)
    held = engine.save(built, f"{tmp_path}/index")
    assert held.config == config and held.radii == built.radii and held.statistics == built.statistics
    for mine, theirs in zip(held.params, built.params, strict=True):
        assert all((getattr(mine, x) == getattr(theirs, x)).all() for x in "abs") and mine.bits == theirs.bits and mine.blocks == 2
    key = ["part", "radius_id", "block_id", "table_id", "bucket_id", "id"]
    assert sorted(map(tuple, held.buckets.select(key).collect())) == sorted(map(tuple, built.buckets.select(key).collect()))
    assert sorted(map(tuple, held.points.select("id", "split_start").collect())) == [(1, 0), (2, 2), (3, 2), (4, 4)]
    with pytest.raises(Exception, match="(?i)exist"):
        engine.save(built, f"{tmp_path}/index")
    spark.createDataFrame([(2, 0, 4, 1, "{}")], "d int, t int, n long, n_radii int, config string").write.mode("overwrite").parquet(f"{tmp_path}/index/statistics")
    with pytest.raises(ValueError, match="not valid: t"):
        engine.load(spark, f"{tmp_path}/index")


def test_vectors_outside_the_domain_fail(spark, grid):
    built = engine.build(grid, LshConfig(k=2))
    far = spark.createDataFrame([(0, [10**6, -(10**6)])], "qid int, coords array<int>")
    with pytest.raises(Exception, match="outside the domain"):
        engine.search(built, far).collect()


def test_exact_neighbours_in_batches(spark):
    points = spark.createDataFrame(vectors(1, 60), "id long, coords array<int>")
    asked = spark.createDataFrame(vectors(2, 30), "qid long, coords array<int>")
    one, many = (sorted(map(tuple, neighbours.exact_neighbours(points, asked, 3, batch=n).collect())) for n in (1000, 4))
    assert one == many and len(one) == 90


def test_splits_by_uneven_starts(spark):
    r = random.Random(3)
    starts = sorted({r.choice([r.randint(0, 100), r.randint(10**6, 10**6 + 50), 10**9]) for _ in range(80)})
    ids = [*starts, *(x + 1 for x in starts), *(r.randint(0, 2 * 10**9) for _ in range(200)), -5]
    found = candidates.with_splits(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(x,) for x in starts], "split_start long")).collect()
    assert sorted((x.id, x.split_start) for x in found) == sorted((i, max(x for x in starts if x <= i)) for i in ids if i >= starts[0])
    row = spark.range(1).select(*(vector.split_start(F.lit(i).cast("long"), starts).alias(f"c{k}") for k, i in enumerate(ids))).first()
    assert list(row) == [max((x for x in starts if x <= i), default=None) for i in ids]


def test_command_line_builds_searches_and_reports(spark, tmp_path):
    from vecloom.__main__ import run

    points, asked = vectors(4, 120), vectors(5, 6)
    for name, rows in (("ds", points), ("q", asked)):
        (tmp_path / name).write_text("".join(f"{i + 1} {' '.join(map(str, v))}\n" for i, v in rows))
    near = [sorted(dist(v, x) for _, x in points)[:1] for _, v in asked]
    (tmp_path / "gt").write_text("6 1\n" + "".join(f"{i + 1} {d[0]}\n" for i, d in enumerate(near)))
    names = {"baseDir": "index", "dataSetFileName": "ds", "querySetFileName": "q", "groundTruthFileName": "gt", "localStatResultFile": "report"}
    values = {k: f"{tmp_path}/{v}" for k, v in names.items()} | {"querySetSize": "6", "kNeighbors": "1", "partNum": "2"}
    (tmp_path / "site.xml").write_text("<configuration>" + "".join(f"<property><name>{k}</name><value>{v}</value></property>" for k, v in values.items()) + "</configuration>")
    assert run(spark, ["-b", "-c", f"{tmp_path}/site.xml"]) is None
    out = run(spark, ["-s", "-c", f"{tmp_path}/site.xml"])
    assert "missed queries 0" in out and "radii searched" in out and "search " in out and out.count("ratio 1.000000") >= 3 and "SMALLER" not in out
    assert spark.read.text(f"{tmp_path}/report", wholetext=True).first()[0].strip() == out.strip()
    both = run(spark, ["-bs", "-c", f"{tmp_path}/site.xml", "-D", f"baseDir={tmp_path}/other", "-D", "partNum=1", "--iterative"])
    assert "statistics " in both and "build " in both
    with pytest.raises(ValueError, match="unknown settings: nonsense"):
        run(spark, ["-b", "-D", "nonsense=1"])
    with pytest.raises(ValueError, match="no path is set for index"):
        run(spark, ["-s", "-D", "ratio=2"])


def test_random_columns(spark):
    row = spark.range(20000).select(columns.gaussian(5, 2, 1).alias("g"), columns.uniform(-1, 1, 2).alias("u"), columns.zipf(0, 100, 1.0, 3).alias("z"), columns.digits(3, 4).alias("d"), columns.bounded_digits(10, 20, 5).alias("b"))
    s = row.agg(F.avg("g").alias("g"), F.min("u").alias("low"), F.max("u").alias("high"), F.avg((F.col("z") == 0).cast("int")).alias("z"), F.max("d").alias("d"), F.min("b").alias("b")).first()
    assert abs(s.g - 5) < 0.1 and -1 <= s.low < s.high < 1 and s.d <= 999 and s.b >= 10
    assert abs(s.z - 1 / sum(1 / i for i in range(1, 101))) < 0.02


def test_streamed_batches_get_the_same_answers(spark, grid, tmp_path):
    from vecloom.streaming import answer_stream

    asked = spark.createDataFrame([(0, [1, 1]), (1, [9, 1])], "qid int, coords array<int>")
    built = engine.build(grid, LshConfig(k=2), asked)
    asked.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in")
    answer_stream(stream, built, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    found = sorted((r.qid, r["rank"], r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == sorted((r.qid, r["rank"], r.id) for r in engine.search(built, asked).collect()) and found
