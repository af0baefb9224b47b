"""The engine's queries over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.config import SCALE, WIDTH, LshConfig
from vecloom.functions import formulas, random, vector
from vecloom.operators import candidates, index, neighbours
from vecloom.operators.params import make_params, params_from, params_sql, params_table
from vecloom.operators.stats import radius_ladder, read_statistics, statistics
from vecloom.plans import engine
from vecloom.plans.engine import build_and_search
from vecloom.plans.iterative import merge_state, unfinished
from vecloom.plans.partitioned import search_partitioned
from vecloom.plans.scratch import checkpointed, scratch_path
from vecloom.sources import tables, text

CONFIG = LshConfig(k=10, ratio=2, query_count=50, partitions=3, blocks=2, seed=1)
#: Parameters that do not depend on the data, so that SQL can state them: 64 dimensions, coordinates up to 64. Queries
#: named ..._derived search and evaluate with parameters that follow from the data instead.
ONE = [make_params(0, 64, 64, 6, 5, CONFIG.seed)]
PARTS = [make_params(p, 64, 64, 4, 4, CONFIG.seed) for p in range(CONFIG.partitions)]
RADII = [2**i for i in range(9)]
#: The same tables in two blocks, each with fold coefficients of its own.
BLOCKS = [make_params(0, 64, 64, 6, 5, CONFIG.seed, blocks=2)]
SIZE = sum(p.a.size for p in (*ONE, *PARTS))
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.without_first(tables.embedding_points(spark, sf_dir), CONFIG.query_count)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_queries(tables.embedding_points(spark, sf_dir), CONFIG.query_count)


# --- SQL building blocks -------------------------------------------------------------------------------------------

E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100 + 0.5)::INTEGER) AS coords FROM embeddings)"
PQ = f"{E}, q AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS qid, coords FROM e ORDER BY id LIMIT 50), p AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM e ORDER BY id LIMIT 50))"


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i])::BIGINT * ({a}[i] - {b}[i])))::DOUBLE)"


def _hashed(name: str, source: str, key: str, radii: list[int] = RADII) -> str:
    """CTEs name_v (base values) and name (buckets) of source, which has part, the key and coords."""
    rungs = ", ".join(f"({i}, {r}::BIGINT)" for i, r in enumerate(radii))
    product = "(((v // radius) * s + 2147483648) & 4294967295) - 2147483648"
    return f"""{name}_v AS (SELECT x.part, {key}, table_id, proj_id, s,
  ((list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * coords[i])) + b + half * {SCALE}) // {WIDTH * SCALE})::BIGINT AS v FROM {source} x JOIN lsh USING (part)),
{name} AS (SELECT part, {key}, table_id, radius_id, radius, list_reduce(list_prepend(0::BIGINT, list({product} ORDER BY proj_id)),
  lambda r, x: (CASE WHEN r + x >= 0 THEN r + x ELSE r + x + {vector.LIFT} END) % {vector.MODULUS})::BIGINT AS bucket_id
  FROM {name}_v, (VALUES {rungs}) rungs(radius_id, radius) GROUP BY ALL)"""


def _lsh(params) -> str:
    return f"lsh AS (SELECT * FROM {params_sql(params)})"


PART = f"(((id * 2654435761) & 4294967295) % {CONFIG.partitions})::INTEGER"
ONE_SQL = f"{PQ}, {_lsh(ONE)}, p1 AS (SELECT 0 AS part, * FROM p), q1 AS (SELECT 0 AS part, * FROM q), {_hashed('pb', 'p1', 'id')}, {_hashed('qb', 'q1', 'qid')}"
PARTS_SQL = f"{PQ}, {_lsh(PARTS)}, p1 AS (SELECT {PART} AS part, * FROM p), q1 AS (SELECT part, qid, coords FROM q, (SELECT DISTINCT part FROM lsh)), {_hashed('pb', 'p1', 'id')}, {_hashed('qb', 'q1', 'qid')}"
HITS = "hits AS (SELECT part, radius_id, qb.radius, table_id, qid, id FROM qb JOIN pb USING (part, radius_id, table_id, bucket_id))"
B1, BP = CONFIG.budget(ONE[0].tables), CONFIG.budget(PARTS[0].tables)


def _one(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return index.base_buckets(vectors.withColumn("part", F.lit(0)), params_table(spark, ONE), SIZE)


def _hits(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    pb = index.buckets(_one(spark, points(spark, sf_dir)), RADII).drop("radius")
    return candidates.collide(index.buckets(_one(spark, asked(spark, sf_dir)), RADII), pb, how)


def _part_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = params_table(spark, PARTS)
    own = index.with_part(points(spark, sf_dir), CONFIG.partitions)
    parts = spark.createDataFrame([(p.part,) for p in PARTS], "part int")
    q = asked(spark, sf_dir).join(F.broadcast(parts))
    return candidates.collide(index.buckets(index.base_buckets(q, table, SIZE), RADII), index.buckets(index.base_buckets(own, table, SIZE), RADII).drop("radius"))


# --- sources, statistics, formulas ---------------------------------------------------------------------------------


@query(f"WITH {E} SELECT id, list_sum(coords)::BIGINT AS total, len(coords) AS d FROM e")
def points_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.embedding_points(spark, sf_dir).select("id", F.aggregate("coords", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("coords").alias("d"))


@query(f"WITH {PQ} SELECT qid, coords[1] AS first, coords[64] AS last FROM q")
def queries_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("qid", F.col("coords")[0].alias("first"), F.col("coords")[63].alias("last"))


STATS = "st AS (SELECT max(len(coords)) AS d, max(list_max(list_transform(coords, lambda x: abs(x)))) AS t, count(*) AS n FROM {})"


@query(f"WITH {E}, {STATS.format('e')} SELECT d, t, n, (1 + floor(ln(sqrt(d::DOUBLE) * t) / ln(2)))::INTEGER AS n_radii FROM st")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(tables.embedding_points(spark, sf_dir), CONFIG.ratio)


@query("SELECT 5 AS d, max(greatest(l_quantity::INTEGER, l_linenumber, floor(l_discount * 100 + 0.5)::INTEGER, floor(l_tax * 100 + 0.5)::INTEGER, abs(date_diff('day', DATE '1992-01-01', l_shipdate::DATE))))::INTEGER AS t, count(*) AS n, (1 + floor(ln(sqrt(5::DOUBLE) * max(greatest(l_quantity::INTEGER, l_linenumber, abs(date_diff('day', DATE '1992-01-01', l_shipdate::DATE))))) / ln(2)))::INTEGER AS n_radii FROM lineitem")
def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(tables.lineitem_points(spark, sf_dir), CONFIG.ratio)


@query(f"WITH {E}, {STATS.format('e')}, r AS (SELECT unnest(range(0, (1 + floor(ln(sqrt(d::DOUBLE) * t) / ln(2)))::BIGINT)) AS i FROM st) SELECT i::INTEGER AS radius_id, (2 ** i)::BIGINT AS radius, (2 ** i)::BIGINT * 2 AS \"limit\" FROM r")
def radius_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_ladder(stats(spark, sf_dir), CONFIG.ratio)


_CDF = "(SELECT sum(exp(-((-10 + i * 0.0001) ** 2) / 2) / sqrt(2 * pi())) * 0.0001 FROM range(0, ((10 - {x}) / 0.0001)::BIGINT) t(i))"
_PROB = "1 - 2 * {cdf} - 2 / (sqrt(2 * pi()) * {x}) * (1 - exp(-{x} * {x} / 2))"


@query("SELECT c, round(p1, 3) AS p1, round(p2, 3) AS p2 FROM (VALUES " + ", ".join(f"({c}, {_PROB.format(x='4.0', cdf=_CDF.format(x='4.0'))}, {_PROB.format(x=str(4.0 / c), cdf=_CDF.format(x=str(4.0 / c)))})" for c in (2, 3, 4)) + ") v(c, p1, p2)")
def lsh_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, *(round(p, 3) for p in formulas.probabilities(c))) for c in (2, 3, 4)], "c int, p1 double, p2 double")


_P1, _P2 = formulas.probabilities(2)


@query(f"SELECT n, ceil(ln(n) / ln(1 / {_P2!r}))::INTEGER AS m, ceil({_P1!r} ** -ceil(ln(n) / ln(1 / {_P2!r})))::INTEGER AS tables, (3 * ceil({_P1!r} ** -ceil(ln(n) / ln(1 / {_P2!r}))) + 10)::INTEGER AS budget FROM (VALUES (125), (500), (2000), (10000), (60000), (262144), (1048576)) v(n)")
def lsh_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for n in (125, 500, 2000, 10000, 60000, 262144, 1048576):
        m = formulas.projections_needed(n, 2)
        rows.append((n, m, formulas.tables_needed(m, 2), CONFIG.budget(formulas.tables_needed(m, 2))))
    return spark.createDataFrame(rows, "n int, m int, tables int, budget int")


@query("WITH b AS (SELECT least(t // (19 // 4), 3)::INTEGER AS block_id FROM range(0, 19) r(t)) SELECT block_id, count(*) AS tables, sum(count(*)) OVER ()::BIGINT AS all_tables FROM b GROUP BY block_id")
def block_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 tables in 4 blocks; the sizes add up to the tables again."""
    rows = spark.range(19).select(vector.block_of(F.col("id"), 19, 4).alias("block_id")).groupBy("block_id").agg(F.count(F.lit(1)).alias("tables"))
    return rows.join(F.broadcast(rows.agg(F.sum("tables").alias("all_tables"))))


@query(f"WITH {E}, {STATS.format('e')}, {_lsh(ONE)}, f AS (SELECT ceil(log2(d) + log2(t)) AS f, t FROM st), w AS (SELECT max(f)::INTEGER AS f, max(greatest((2 ** f)::BIGINT, (2 * (list_sum(list_transform(a, lambda x: abs(x))) * t + b)) // {SCALE * WIDTH}))::BIGINT AS most FROM lsh, f) SELECT f, (floor(log2(most)) + 1)::INTEGER AS u, ((2 ** (floor(log2(most)) + 1)) * {WIDTH})::BIGINT AS domain FROM w")
def hash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = params_table(spark, ONE).select(F.explode("projections").alias("p"))
    st = stats(spark, sf_dir).select("t", F.ceil(F.log2("d") + F.log2("t")).alias("f"))
    reach = vector._total(F.transform("p.a", F.abs))
    most = F.max(F.greatest(F.pow(F.lit(2.0), "f").cast("long"), F.floor(2 * (reach * F.col("t") + F.col("p.b")) / F.lit(SCALE * WIDTH)).cast("long")))
    row = table.join(F.broadcast(st)).agg(F.max("f").cast("int").alias("f"), most.alias("most"))
    u = (F.floor(F.log2("most")) + 1).cast("int")
    return row.select("f", u.alias("u"), (F.pow(F.lit(2.0), u) * WIDTH).cast("long").alias("domain"))


# --- hashing and index ---------------------------------------------------------------------------------------------


@query(f"WITH {ONE_SQL} SELECT id, table_id, proj_id, v FROM pb_v")
def base_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, points(spark, sf_dir)).select("id", "table_id", F.posexplode("base").alias("proj_id", "v"))


@query(f"WITH {ONE_SQL} SELECT id, table_id, radius_id, bucket_id FROM pb")
def bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.buckets(_one(spark, points(spark, sf_dir)), RADII).select("id", "table_id", "radius_id", "bucket_id")


@query(f"SELECT part, count(*) AS n, min(id) AS first FROM (SELECT vec_id AS id, (((vec_id * 2654435761) & 4294967295) % {CONFIG.partitions})::INTEGER AS part FROM embeddings) GROUP BY part")
def partition_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_part(tables.embedding_points(spark, sf_dir), CONFIG.partitions).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(f"WITH {ONE_SQL} SELECT radius_id, table_id, bucket_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM pb GROUP BY ALL")
def hash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.bucket_lists(index.buckets(_one(spark, points(spark, sf_dir)), RADII))
    return rows.select("radius_id", "table_id", "bucket_id", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _index(spark: SparkSession, sf_dir: str, params, partitions: int = 1) -> engine.Index:
    config = replace(CONFIG, partitions=partitions, blocks=params[0].blocks, split_rows=100)
    own = index.with_part(points(spark, sf_dir), partitions).withColumn("split_start", F.col("id") - F.pmod("id", F.lit(config.split_rows)))
    return engine.from_parameters(own, params, config, {"d": 64, "t": 64, "n": own.count(), "n_radii": len(RADII)})


def _stored(spark: SparkSession, sf_dir: str, params, partitions: int = 1) -> engine.Index:
    """Stored in the shared folder and loaded again."""
    return engine.save(_index(spark, sf_dir, params, partitions), scratch_path(spark))


@query(f"WITH {ONE_SQL} SELECT radius_id, 0 AS block_id, table_id, bucket_id, count(*) AS n FROM pb GROUP BY ALL")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, ONE).buckets.groupBy("radius_id", "block_id", "table_id", "bucket_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ONE_SQL.replace(params_sql(ONE), params_sql(BLOCKS))} SELECT radius_id, least(table_id // 2, 1)::INTEGER AS block_id, table_id, bucket_id, count(*) AS n FROM pb GROUP BY ALL")
def block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash tables stored in two blocks, each read on its own."""
    rows = _stored(spark, sf_dir, BLOCKS).buckets
    both = rows.where("block_id = 0").unionByName(rows.where("block_id = 1"))
    return both.groupBy("radius_id", "block_id", "table_id", "bucket_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_lsh(BLOCKS)}, b AS (SELECT part, least(table_id // 2, 1)::INTEGER AS block_id, count(DISTINCT table_id) AS tables FROM lsh GROUP BY ALL) SELECT *, sum(tables) OVER ()::BIGINT AS all_tables FROM b")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tables each stored block holds, and all blocks together."""
    rows = index.block_sizes(spark.read.parquet(f"{_stored(spark, sf_dir, BLOCKS).path}/params"))
    return rows.join(F.broadcast(rows.agg(F.sum("tables").alias("all_tables"))))


@query(f"WITH {_lsh(PARTS)} SELECT part, table_id, proj_id, list_sum(a)::BIGINT AS total, b, s, half FROM lsh")
def params_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters stored, read as parameters, and as a table again."""
    read = params_from(spark.read.parquet(f"{_stored(spark, sf_dir, PARTS, CONFIG.partitions).path}/params"))
    rows = params_table(spark, read).select("part", "table_id", "half", F.posexplode("projections").alias("proj_id", "p"), "s")
    return rows.select("part", "table_id", "proj_id", vector._total(F.col("p.a")).alias("total"), F.col("p.b").alias("b"), F.get("s", "proj_id").alias("s"), "half")


@query(f"WITH {PQ} SELECT 64 AS d, 64 AS t, count(*) AS n, {len(RADII)} AS n_radii FROM p")
def statistics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_statistics(spark, f"{_stored(spark, sf_dir, ONE).path}/statistics")
    return spark.createDataFrame([(read.d, read.t, read.n, read.n_radii)], "d int, t int, n long, n_radii int")


@query(f"WITH {PQ} SELECT {PART.replace('(((id', '((((id').replace('INTEGER', 'INTEGER)')} AS part, (id - id % 100)::BIGINT AS split_start, count(*) AS n, min(id) AS first, sum(list_sum(coords))::BIGINT AS total FROM p GROUP BY ALL")
def split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points stored by partition and data split; each split is read on its own."""
    held = _stored(spark, sf_dir, PARTS, CONFIG.partitions)
    starts = spark.read.parquet(f"{held.path}/splits").withColumn("split_start", F.col("split_start").cast("long"))
    rows = held.points.withColumn("split_start", F.col("split_start").cast("long")).join(starts, "split_start", "left_semi")
    return rows.groupBy("part", "split_start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.sum(vector._total(F.col("coords"))).alias("total"))


# --- candidates ----------------------------------------------------------------------------------------------------


@query(f"WITH {ONE_SQL}, {HITS} SELECT qid, radius_id, count(*) AS collisions FROM hits GROUP BY ALL")
def bucket_collide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("qid", "radius_id").agg(F.count(F.lit(1)).alias("collisions"))


@query(f"WITH {ONE_SQL} SELECT qid, radius_id, table_id, count(pb.id) AS collisions FROM qb LEFT JOIN pb USING (part, radius_id, table_id, bucket_id) GROUP BY ALL")
def bucket_collide_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "left").groupBy("qid", "radius_id", "table_id").agg(F.count("id").alias("collisions"))


@query(f"WITH {ONE_SQL}, {HITS} SELECT qid, radius_id, table_id, id, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, radius_id ORDER BY table_id, id) AS pos FROM hits) WHERE pos <= {B1}")
def budget_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.within_budget(_hits(spark, sf_dir), B1, ["qid", "radius_id"]).select("qid", "radius_id", "table_id", "id", "pos")


@query(f"WITH {ONE_SQL}, {HITS} SELECT qid, id, min(radius_id) AS radius_id, arg_min(table_id, (radius_id, table_id)) AS table_id FROM hits GROUP BY qid, id")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.first_met(_hits(spark, sf_dir), ["qid"]).select("qid", "id", "radius_id", "table_id")


STARTS = [0, 60, 200, 333, 450]


@query(f"WITH s AS (SELECT unnest({STARTS})::BIGINT AS split_start) SELECT vec_id AS id, split_start, vec_id - split_start AS relative FROM embeddings ASOF JOIN s ON vec_id >= split_start")
def split_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    found = candidates.with_splits(ids, spark.createDataFrame([(s,) for s in STARTS], "split_start long"))
    return found.select("id", "split_start", (F.col("id") - F.col("split_start")).alias("relative"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS id FROM lineitem), s AS (SELECT DISTINCT p_partkey AS split_start FROM part WHERE p_size < 10) SELECT l_orderkey, l_linenumber, split_start, id - split_start AS relative FROM l ASOF JOIN s ON id >= split_start")
def split_asof_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders by the greatest of many, unevenly spread starts."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"))
    starts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 10").select(F.col("p_partkey").alias("split_start")).distinct()
    return candidates.with_splits(rows, starts).select("l_orderkey", "l_linenumber", "split_start", (F.col("id") - F.col("split_start")).alias("relative"))


@query(f"WITH {ONE_SQL}, {HITS}, c AS (SELECT DISTINCT radius_id, qid, id FROM hits) SELECT radius_id, (SELECT max(x) FROM unnest({STARTS}) t(x) WHERE x <= id)::BIGINT AS split_start, qid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM c GROUP BY ALL")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hits(spark, sf_dir).select("radius_id", "qid", "id").distinct().withColumn("split_start", vector.split_start(F.col("id"), STARTS))
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    return found.groupBy("radius_id", "split_start", "qid").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


NEAR = f"near AS (SELECT c.qid, c.id, c.radius, {_l2('p.coords', 'q.coords')} AS dist FROM {{}} c JOIN p USING (id) JOIN q ON q.qid = c.qid)"


@query(f"WITH {ONE_SQL}, {HITS}, c AS (SELECT qid, id, min(radius) AS radius FROM hits GROUP BY ALL), {NEAR.format('c')} SELECT qid, id, round(dist, 6) AS dist FROM near WHERE dist < 2 * radius")
def verify_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = candidates.first_met(_hits(spark, sf_dir), ["qid"]).select("qid", "id", "radius")
    near = neighbours.with_distance(met, points(spark, sf_dir), asked(spark, sf_dir)).where("dist < 2 * radius")
    return near.select("qid", "id", F.round("dist", 6).alias("dist"))


# --- neighbours and searches ---------------------------------------------------------------------------------------

ALL = f"d AS (SELECT qid, id, {_l2('p.coords', 'q.coords')} AS dist FROM p, q), x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)"
EXACT = f"WITH {PQ}, {ALL} SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM x WHERE rank <= 10"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query(EXACT)
def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbours.exact_neighbours(points(spark, sf_dir), asked(spark, sf_dir), CONFIG.k))


@query(EXACT)
def topk_partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of each partition first, then of all, in one scan."""
    own = index.with_part(points(spark, sf_dir), CONFIG.partitions)
    return _rounded(neighbours.nearest(neighbours.exact_neighbours(own, asked(spark, sf_dir), CONFIG.k, by=("part",)).drop("rank"), CONFIG.k))


def _partitioned_sql(strict: bool) -> str:
    met = (
        "SELECT part, qid, id, arg_min(radius, (radius_id, table_id)) AS radius FROM kept WHERE stop IS NOT NULL GROUP BY ALL"
        if strict
        else f"SELECT DISTINCT part, qid, id, ({RADII})[coalesce(stop, {len(RADII) - 1}) + 1] AS radius FROM kept"
    )
    return f"""WITH {PARTS_SQL}, {HITS},
spent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, qid, radius_id ORDER BY table_id, id) AS pos FROM hits) WHERE pos <= {BP}),
stopped AS (SELECT *, min(CASE WHEN pos = {BP} THEN radius_id END) OVER (PARTITION BY part, qid) AS stop FROM spent),
kept AS (SELECT * FROM stopped WHERE stop IS NULL OR radius_id <= stop), c AS ({met}), {NEAR.format("c")},
x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM near WHERE dist < 2 * radius)
SELECT qid, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM x WHERE rank <= 10"""


def _partitioned(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    own = index.with_part(points(spark, sf_dir), CONFIG.partitions)
    budgets = {p.part: CONFIG.budget(p.tables) for p in PARTS}
    return search_partitioned(_part_hits(spark, sf_dir), own, asked(spark, sf_dir), CONFIG.k, CONFIG.ratio, budgets, RADII, strict)


@query(_partitioned_sql(False))
def search_partitioned_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_partitioned(spark, sf_dir, False))


@query(_partitioned_sql(True))
def search_partitioned_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_partitioned(spark, sf_dir, True))


def _iterative_ctes(radii: list[int], all_active: bool = False) -> str:
    """The loop unrolled: s0, s1, ... are the states, a0, a1, ... the queries still active before each radius.
    all_active: every query goes on."""
    out = ["a0 AS (SELECT qid FROM q)", "s_ AS (SELECT 0 AS qid, 0::BIGINT AS id, 0.0::DOUBLE AS dist WHERE false)"]
    before = "s_"
    for i, r in enumerate(radii):
        out.append(f"c{i} AS (SELECT DISTINCT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY table_id, id) AS pos FROM hits WHERE radius_id = {i} {"" if all_active else f"AND qid IN (SELECT qid FROM a{i})"}) WHERE pos <= {B1})")
        out.append(f"n{i} AS (SELECT c.qid, c.id, {_l2('p.coords', 'q.coords')} AS dist FROM c{i} c JOIN p USING (id) JOIN q ON q.qid = c.qid)")
        out.append(f"s{i} AS (SELECT qid, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, dist FROM {before} UNION SELECT qid, id, dist FROM n{i} WHERE dist < {2 * r})) WHERE rank <= 10)")
        out.append(f"a{i + 1} AS (SELECT qid FROM a{i} WHERE qid NOT IN (SELECT qid FROM s{i} GROUP BY qid HAVING count(*) >= 10))")
        before = f"s{i}"
    return ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out)


ITER_SQL = f"WITH {ONE_SQL}, {HITS.replace('AS (', 'AS MATERIALIZED (', 1)}, "


@query(f"{ITER_SQL}{_iterative_ctes(RADII)} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank, id, round(dist, 6) AS dist FROM s{len(RADII) - 1}")
def search_iteratively(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine.search(_index(spark, sf_dir, ONE), asked(spark, sf_dir), iterative=True))


@query(_partitioned_sql(False))
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitioned search of an index that was stored and loaded."""
    return _rounded(engine.search(_stored(spark, sf_dir, PARTS, CONFIG.partitions), asked(spark, sf_dir)))


@query(f"{ITER_SQL}{_iterative_ctes(RADII)} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank, id, round(dist, 6) AS dist FROM s{len(RADII) - 1}")
def stored_search_iteratively(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The iterative search of a stored index, of which each step reads one radius."""
    return _rounded(engine.search(_stored(spark, sf_dir, ONE), asked(spark, sf_dir), iterative=True))


def _derived(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
    """A search whose projections, tables, budget and radii follow from the tables themselves, so that no SQL states them."""
    config = replace(CONFIG, partitions=1) if how.get("iterative") else CONFIG
    return build_and_search(points(spark, sf_dir), asked(spark, sf_dir), config, **how)


@query()
def search_partitioned_complete_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_derived(spark, sf_dir))


@query()
def search_partitioned_strict_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_derived(spark, sf_dir, strict=True))


@query()
def search_iteratively_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_derived(spark, sf_dir, iterative=True))


def _states(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """What is known of every query after each radius, none of them finished."""
    own, queries_, state, out = _index(spark, sf_dir, ONE), asked(spark, sf_dir), None, []
    at, every = engine.hits_by_radius(own, queries_), queries_.select("qid")
    for i, radius in enumerate(RADII):
        pairs = candidates.within_budget(at(i, every), B1, ["qid"]).select("qid", "id").distinct()
        near = neighbours.with_distance(pairs, own.points, queries_).where(F.col("dist") < 2 * radius)
        state = checkpointed(merge_state(state, near.select("qid", "id", "dist"), CONFIG.k))
        out.append(state)
    return out


def _every(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].withColumn("radius_id", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("radius_id", F.lit(i)))
    return out


@query(f"{ITER_SQL}{_iterative_ctes(RADII, True)} " + " UNION ALL ".join(f"SELECT {i} AS radius_id, qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank, id, round(dist, 6) AS dist FROM s{i}" for i in range(len(RADII))))
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _every(_states(spark, sf_dir))
    return states.select("radius_id", "qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query(f"{ITER_SQL}{_iterative_ctes(RADII, True)} " + " UNION ALL ".join(f"SELECT {i} AS radius_id, qid FROM q WHERE qid NOT IN (SELECT qid FROM s{i} GROUP BY qid HAVING count(*) >= 10)" for i in range(len(RADII))))
def remaining_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = asked(spark, sf_dir).select("qid")
    return _every([unfinished(active, state, CONFIG.k) for state in _states(spark, sf_dir)])


# --- evaluation and text -------------------------------------------------------------------------------------------

FOUND = _partitioned_sql(False).rsplit("SELECT qid, rank", 1)[0]
RATIO = f"{FOUND}, {ALL.replace('x AS', 'g AS')}, r AS (SELECT q.qid, count(x.rank) AS found, avg(CASE WHEN x.dist = 0 AND g.dist = 0 THEN 1.0 WHEN g.dist > 0 THEN x.dist / g.dist END) AS ratio FROM q LEFT JOIN (SELECT * FROM x WHERE rank <= 10) x ON x.qid = q.qid LEFT JOIN g ON g.qid = x.qid AND g.rank = x.rank GROUP BY q.qid)"


def _scored(spark: SparkSession, sf_dir: str, search: Callable[[SparkSession, str], DataFrame] = lambda spark, sf_dir: _partitioned(spark, sf_dir, False)) -> DataFrame:
    truth = neighbours.exact_neighbours(points(spark, sf_dir), asked(spark, sf_dir), CONFIG.k)
    return neighbours.ratios(search(spark, sf_dir), truth, CONFIG.query_count)


@query(f"{RATIO} SELECT qid, found, round(ratio, 6) AS ratio, (ratio IS NULL OR ratio > 1 OR abs(ratio - 1) < 1e-5) AS valid FROM r")
def eval_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("qid", "found", F.round("ratio", 6).alias("ratio"), "valid")


@query(f"{RATIO} SELECT round(avg(ratio), 6) AS average_ratio, round(sum(ratio) / 50, 6) AS strict_ratio, (50 - count(*) FILTER (found = 10))::BIGINT AS missed FROM r")
def eval_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.summary(_scored(spark, sf_dir), CONFIG.k, CONFIG.query_count).select(F.round("average_ratio", 6).alias("average_ratio"), F.round("strict_ratio", 6).alias("strict_ratio"), "missed")


@query()
def eval_ratio_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _derived).select("qid", "found", F.round("ratio", 6).alias("ratio"), "valid")


@query()
def eval_missed_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.summary(_scored(spark, sf_dir, _derived), CONFIG.k, CONFIG.query_count).select(F.round("average_ratio", 6).alias("average_ratio"), F.round("strict_ratio", 6).alias("strict_ratio"), "missed")


SQUARES = f"d AS (SELECT qid, id, p.coords AS coords, list_sum(list_transform(range(1, 65), lambda i: (p.coords[i] - q.coords[i])::BIGINT * (p.coords[i] - q.coords[i])))::BIGINT AS dist FROM p, q), x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)"


def _squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours with coords; dist is the square, whose text is the same in every engine."""
    near = neighbours.exact_neighbours(points(spark, sf_dir), asked(spark, sf_dir), CONFIG.k)
    return near.withColumn("dist", F.round(F.pow("dist", F.lit(2.0))).cast("long")).join(points(spark, sf_dir), "id")


@query(f"WITH {PQ}, {SQUARES} SELECT qid, qid || ' ' || count(*) || chr(10) || string_agg(dist || ' ' || id || ' ' || array_to_string(coords, ' '), chr(10) ORDER BY rank) || chr(10) AS value FROM x WHERE rank <= 10 GROUP BY qid")
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.result_lines(_squared(spark, sf_dir), True)


@query(f"WITH {PQ}, {SQUARES} SELECT qid, rank::INTEGER AS rank, id, dist::DOUBLE AS dist, list_sum(coords)::BIGINT AS total FROM x WHERE rank <= 10")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to text and back, neighbours among them, and the results to text and back."""
    path = scratch_path(spark)
    text.write_points(points(spark, sf_dir), f"{path}/points")
    read = text.read_points(spark, f"{path}/points")
    near = neighbours.exact_neighbours(read, asked(spark, sf_dir), CONFIG.k).withColumn("dist", F.round(F.pow("dist", F.lit(2.0))).cast("long"))
    text.write_results(near.join(read, "id"), f"{path}/results", True)
    return text.read_results(spark, f"{path}/results", True).select("qid", "rank", "id", "dist", F.aggregate("coords", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {E}, x AS (SELECT row_number() OVER (ORDER BY id DESC) - 1 AS qid, coords FROM e) SELECT qid, coords[1] AS first, list_sum(coords)::BIGINT AS total FROM x WHERE qid < 50")
def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries out of a text file count by their place in it, whatever their ids: here from the greatest id down."""
    path = scratch_path(spark)
    text.write_points(tables.embedding_points(spark, sf_dir).orderBy(F.desc("id")).coalesce(1), path)
    return text.read_queries(spark, path, CONFIG.query_count).select("qid", F.col("coords")[0].alias("first"), vector._total(F.col("coords")).alias("total"))


def _truth_text(k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark)
        near = neighbours.exact_neighbours(points(spark, sf_dir), asked(spark, sf_dir), k)
        text.write_ground_truth(near.withColumn("dist", F.round(F.pow("dist", F.lit(2.0)))), path, CONFIG.query_count, k)
        return text.read_ground_truth(spark, path, CONFIG.query_count, k)

    return run


for _k in (1, 10):  # one neighbour a query makes every line as short as the first
    _truth = _truth_text(_k)
    _truth.__name__ = f"ground_truth_{_k}"
    query(f"WITH {PQ}, {SQUARES} SELECT qid, rank::INTEGER AS rank, dist::DOUBLE AS dist FROM x WHERE rank <= {_k}")(_truth)


# --- scalar functions ----------------------------------------------------------------------------------------------


@query("SELECT event_id, lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, event_id * 977 AS s FROM events)")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", vector.clock(F.col("event_id") * 977).alias("clock"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_tax - l_discount > 1e-6 THEN 1 WHEN l_discount - l_tax > 1e-6 THEN -1 ELSE 0 END)::INTEGER AS doubles, sign(l_partkey - l_suppkey)::INTEGER AS ints FROM lineitem")
def compare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", vector.compare_doubles(F.col("l_tax"), F.col("l_discount")).alias("doubles"), vector.compare_ints(F.col("l_partkey"), F.col("l_suppkey")).alias("ints"))


@query("SELECT n_nationkey, n_nationkey || ' ' || n_name || ' ' || n_regionkey AS line, nullif(n_regionkey, 0) IS NOT DISTINCT FROM nullif(n_nationkey % 5, 0) AS same FROM nation")
def record_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    same = vector.record_equal([(F.nullif("n_regionkey", F.lit(0)), F.nullif(F.col("n_nationkey") % 5, F.lit(0)))])
    return df.select("n_nationkey", vector.record_text(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("line"), same.alias("same"))


@query(f"WITH {ONE_SQL}, m AS (SELECT radius_id, table_id, bucket_id, list(id ORDER BY id) AS ids FROM pb GROUP BY ALL) SELECT qid, radius_id, table_id, coalesce(len(ids), 0)::INTEGER AS n, coalesce(ids[1], -1) AS first FROM qb LEFT JOIN m USING (radius_id, table_id, bucket_id)")
def bucket_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["radius_id", "table_id", "bucket_id"]
    lists = index.bucket_lists(index.buckets(_one(spark, points(spark, sf_dir)), RADII))
    found = index.buckets(_one(spark, asked(spark, sf_dir)), RADII).join(lists.select(*keys, "ids"), keys, "left")
    return found.select("qid", "radius_id", "table_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n"), F.coalesce(F.get("ids", F.lit(0)), F.lit(-1)).alias("first"))


@query("SELECT label, count(*)::INTEGER + 1 AS n, -1::BIGINT AS head, max(vec_id) AS last, 0 AS cleared FROM embeddings GROUP BY label")
def bucket_list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepend to, measure, read and clear a list."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    longer = ids.withColumn("ids", F.array_prepend("ids", F.lit(-1).cast("long")))
    return longer.select("label", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("head"), F.element_at("ids", -1).alias("last"), F.size(F.slice("ids", 1, 0)).alias("cleared"))


#: Draws that are shown, and draws that settle every rounded moment: the nearest to an edge is the tenth Zipf share, 0.0004
#: from it and over four of its standard errors with so many. Seeds go by partition, so the number of these is fixed.
DRAWN, SETTLED, DRAWN_PARTS = 200_000, 30_000_000, 32
_HARMONIC = sum(1 / i for i in range(1, 101))


@query(f"SELECT 5.0::DOUBLE AS gaussian_mean, 2.0::DOUBLE AS gaussian_deviation, 0.68::DOUBLE AS gaussian_inside, 0.0::DOUBLE AS uniform_mean, 0.58::DOUBLE AS uniform_deviation, {1 / _HARMONIC:.2f}::DOUBLE AS zipf_first, {sum(1 / i for i in range(1, 11)) / _HARMONIC:.2f}::DOUBLE AS zipf_tenth, 0.5::DOUBLE AS digits_mean, 0.9::DOUBLE AS digits_long, 15.0::DOUBLE AS bounded_mean, true AS inside")
def random_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and shares of the generators, rounded to what so many draws settle."""
    df = _drawn(spark, SETTLED)
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    inside = F.min(F.col("uniform").between(-1, 1) & F.col("zipf").between(0, 100) & F.col("digits").between(0, 10**10 - 1) & F.col("bounded").between(10, 20))
    row = df.agg(F.avg("gaussian"), F.stddev("gaussian"), share(F.abs(F.col("gaussian") - 5) < 2), F.avg("uniform"), F.stddev("uniform"), share(F.col("zipf") < 1), share(F.col("zipf") < 10), F.avg(F.col("digits") / 10**10), share(F.col("digits") >= 10**9), F.avg("bounded"), inside.alias("inside"))
    places = {"gaussian_mean": 1, "gaussian_deviation": 1, "gaussian_inside": 2, "uniform_mean": 1, "uniform_deviation": 2, "zipf_first": 2, "zipf_tenth": 2, "digits_mean": 2, "digits_long": 2, "bounded_mean": 1}
    named = row.toDF(*places, "inside")
    return named.select(*(F.expr(f"cast(abs(round({c}, {n})) as double)").alias(c) for c, n in places.items()), "inside")


@query("SELECT 0.0::DOUBLE AS a_mean, 1.0::DOUBLE AS a_deviation, 0.5::DOUBLE AS b_mean, 0.3::DOUBLE AS b_deviation, true AS b_inside, 0.5::DOUBLE AS s_mean, true AS s_inside, 4 AS block_coefficients")
def parameter_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections are normal, shifts uniform in their domain, fold coefficients uniform and drawn for each block."""
    p = make_params(0, 64, 64, 40, 100, CONFIG.seed, blocks=4)
    domain = (1 << formulas.domain_bits(64, 64)) * WIDTH * SCALE
    table = params_table(spark, [p])
    each = table.select("block_id", "s", F.explode("projections").alias("p"))
    a = each.select(F.explode("p.a").alias("a")).agg(F.abs(F.round(F.avg("a") / SCALE, 1)).alias("a_mean"), F.round(F.stddev("a") / SCALE, 1).alias("a_deviation"))
    b = each.select((F.col("p.b") / domain).alias("b")).agg(F.round(F.avg("b"), 1).alias("b_mean"), F.round(F.stddev("b"), 1).alias("b_deviation"), F.min(F.col("b").between(0, 1)).alias("b_inside"))
    s = table.select("s").distinct().select(F.col("s").alias("own"), F.explode("s").alias("s")).agg(F.round(F.avg("s") / (1 << 29), 1).alias("s_mean"), F.min((F.col("s") >= 1) & (F.col("s") < 1 << 29)).alias("s_inside"), F.countDistinct("own").cast("int").alias("block_coefficients"))
    return a.join(b).join(s)  # one row each


def _drawn(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, DRAWN_PARTS).select("id", random.gaussian(5, 2, 1).alias("gaussian"), random.uniform(-1, 1, 2).alias("uniform"), random.zipf(0, 100, 1.0, 3).alias("zipf"), random.digits(10, 4).alias("digits"), random.bounded_digits(10, 20, 5).alias("bounded"))


@query()
def random_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, DRAWN)


@query()
def brp_lsh_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in bucketed random projection, for comparison."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    as_vectors = lambda df, key: df.select(key, array_to_vector(F.col("coords").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=64.0, numHashTables=5, seed=1).fit(as_vectors(points(spark, sf_dir), "id"))
    pairs = model.approxSimilarityJoin(as_vectors(asked(spark, sf_dir), "qid"), as_vectors(points(spark, sf_dir), "id"), 150.0, "dist")
    return _rounded(neighbours.nearest(pairs.select(F.col("datasetA.qid").alias("qid"), F.col("datasetB.id").alias("id"), "dist"), CONFIG.k))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
