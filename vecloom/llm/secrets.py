"""Secret scan: multipart credential linking.

Base spans (assignments, access identifiers, long hexadecimal runs) are reported wherever they stand. Weak
parts (an account name, an opaque run of characters, an endpoint) mean little alone. Each lies within a scope,
the SCOPE code points around it, and an interval join within the document keeps a weak part only where its
complement shares that scope: an opaque run beside an identifier, an account name beside a secret, an endpoint
beside both. The join sorts a document's intervals and sweeps them once forward and once backward, so a text
full of parts costs no pairs. Offsets and sweeps are running sums and maxima over arrays, taken chunk by chunk (scan),
since an array that grows by one element is copied each time: n spans cost n^1.5 small steps, 100,000 in one text a few
seconds. Built-in column functions only; no shuffle.

Defined results: a null text has no spans, like an empty one. Repeated rows are scanned alike, an empty table
gives an empty result, and extra columns of the input are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import let

#: Code points between two parts that still share a scope.
SCOPE = 200
#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "endpoint", "ident", "opaque")
BASE, IDENTIFIERS, SECRETS = (0, 1, 2), (1, 4), (0, 2, 5)


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _any(*words: str) -> str:
    return "(" + "|".join(map(_either, words)) + ")"


_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed values, except for the weak kinds: the patterns of the contract, case spelt out so that only A-Z fold.
PATTERNS = {
    "assign": "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")" + _SET + r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "endpoint": r"(?:https?|ftp|s3|amqp|mysql|redis|postgresql)://[A-Za-z0-9._:@-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "ident": _any("access_key_id", "client_id", "account", "username", "login") + _SET + r"([A-Za-z0-9_.@+-]+)",
    "opaque": r"[A-Za-z0-9+/_-]{32,}",
}
#: Characters that the second group must have; a shorter match is dropped but still consumes its text.
LEAST_VALUE = {"assign": 6, "ident": 3}
_SPAN = "array<struct<start:int,stop:int,kind:int>>"


def scan(items: Column, zero: Column, joined: Callable[[Column, Column], Column], out: str) -> Column:
    """For each of items, what joined makes of zero and all items before it. joined is associative, zero its neutral
    element, out their type. Chunks as long as there are chunks are scanned on their own, then their totals."""

    def one(x: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast(f"array<{out}>").alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct(joined(acc["at"], v).cast(out).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def chunked(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), lambda c: one(F.slice(x, c * size + 1, size)))

        def moved(chunks: Column) -> Column:
            before = one(F.transform(chunks, lambda c: c["at"]))["out"]
            return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c["out"], lambda v: joined(b, v).cast(out))))

        return let(chunks, moved)

    return let(items, lambda x: F.when(F.size(x) > 32, chunked(x)).when(F.size(x) > 0, one(x)["out"]).otherwise(F.array().cast(f"array<{out}>")))


def _spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches: the text splits into gaps and matches, whose lengths add up to offsets."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind in LEAST_VALUE else found
    none = F.array().cast(_SPAN)

    def located(x: Column) -> Column:
        starts = scan(F.transform(x, lambda p: p["gap"] + p["size"]), F.lit(0), lambda a, b: a + b, "int")
        spans = F.zip_with(x, starts, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("stop"), F.lit(rank).alias("kind"), p["keep"].alias("keep")))
        return F.transform(F.filter(spans, lambda p: p["keep"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["kind"].alias("kind")))

    def piece(p: Column) -> Column:
        keep = F.length(p["value"]) >= LEAST_VALUE.get(kind, 0)
        if kind == "opaque":  # neither a plain word nor a rule of dashes
            keep = keep & F.rlike(p["match"], F.lit("[0-9]")) & F.rlike(p["match"], F.lit("[A-Za-z]"))
        return F.struct(F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"), keep.alias("keep"))

    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"), value.alias("value")).cast("array<struct<gap:string,match:string,value:string>>")
    matches = F.filter(pieces, lambda p: p["match"].isNotNull())  # the last gap has none
    return F.when(F.rlike(text, F.lit(pattern)), let(F.transform(matches, piece), located)).otherwise(none)


def _sweep(parts: Column, forward: bool) -> Column:
    """For each part, in order: is an identifier or a secret of this side in its scope, and does a base span of
    this side overlap it; by the nearest edge of each sort of part before it. Backward, places are negative."""
    edges, far = "struct<i:int,s:int,b:int>", F.lit(-(1 << 30))
    sorts = {"i": IDENTIFIERS, "s": SECRETS, "b": BASE}
    own = lambda p: F.struct(*(F.when(p["kind"].isin(*kinds), p["stop"] if forward else -p["start"]).otherwise(far).alias(e) for e, kinds in sorts.items()))
    most = lambda a, b: F.struct(*(F.greatest(a[e], b[e]).alias(e) for e in sorts))

    def seen(x: Column) -> Column:
        nearest = scan(F.transform(x, own), F.struct(*(far.alias(e) for e in sorts)).cast(edges), most, edges)
        gap = lambda p, at, e: (p["start"] if forward else -p["stop"]) - at[e]
        return F.zip_with(x, nearest, lambda p, at: F.struct((gap(p, at, "i") <= SCOPE).alias("i"), (gap(p, at, "s") <= SCOPE).alias("s"), (gap(p, at, "b") < 0).alias("b")))

    return let(parts, seen) if forward else F.reverse(let(F.reverse(parts), seen))


def _linked(parts: Column) -> Column:
    """The weak parts of a sorted array whose complement shares their scope."""

    def judged(p: Column, before: Column, after: Column) -> Column:
        i, s, b = (before[x] | after[x] for x in "isb")
        keep = F.when(p["kind"] == 5, i & ~b).when(p["kind"] == 4, s & ~b).when(p["kind"] == 3, i & s & ~b).otherwise(False)
        return F.struct(p.alias("p"), keep.alias("keep"))

    sides = F.arrays_zip(parts.alias("p"), _sweep(parts, True).alias("before"), _sweep(parts, False).alias("after"))
    rows = F.transform(sides, lambda x: judged(x["p"], x["before"], x["after"]))
    return F.transform(F.filter(rows, lambda x: x["keep"]), lambda x: x["p"])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and linked: arrays of (start, stop, kind), kind an index of KINDS, both sorted."""
    known = set(docs.columns)
    names = {k: next(n for n in (f"_{k}", f"_{k}_", f"_{k}__") if n not in known) for k in KINDS}
    source = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({names[k]: _spans(source, k) for k in KINDS})
    base = F.array_sort(F.concat(*(F.col(names[k]) for k in KINDS[:3])))
    weak = F.concat(*(F.col(names[k]) for k in KINDS[3:]))
    linked = F.when(F.size(weak) > 0, let(F.array_sort(F.concat(weak, *(F.col(names[k]) for k in KINDS[:3]))), _linked)).otherwise(F.array().cast(_SPAN))
    return found.withColumns({"base": base, "linked": linked}).drop(*names.values())


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"]))), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_secrets(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"))


def _op2_sql() -> str:
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in PATTERNS.items()}
    found = " UNION ALL ".join(
        f"SELECT rid, {r} AS kind, string_split_regex(t, {quoted[k]}) AS g, regexp_extract_all(t, {quoted[k]}, 0) AS f, regexp_extract_all(t, {quoted[k]}, {2 if k in LEAST_VALUE else 0}) AS v, {LEAST_VALUE.get(k, 0)} AS least FROM d WHERE regexp_matches(t, {quoted[k]})"
        for r, k in enumerate(KINDS)
    )
    names = ", ".join(f"'{k}'" for k in KINDS)
    near = f"greatest(a.start, b.start) - least(a.stop, b.stop) <= {SCOPE}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT rid, kind, g, f, v, least, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT rid, kind, f[i] AS match, length(v[i]) >= least AS ok,
        (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::BIGINT AS start FROM e),
p AS (SELECT rid, kind, start, start + length(match) AS stop FROM s
      WHERE ok AND (kind <> 5 OR (regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]')))),
w AS (SELECT a.rid, a.kind, a.start, a.stop,
        bool_or(b.kind IN (1, 4) AND {near}) AS i, bool_or(b.kind IN (0, 2, 5) AND {near}) AS s,
        bool_or(b.kind < 3 AND greatest(a.start, b.start) < least(a.stop, b.stop)) AS o
      FROM p a JOIN p b ON a.rid = b.rid AND NOT (a.kind = b.kind AND a.start = b.start) WHERE a.kind > 2 GROUP BY ALL),
spans AS (SELECT rid, kind, start, stop FROM p WHERE kind < 3 UNION ALL
          SELECT rid, kind, start, stop FROM w WHERE NOT o AND ((kind = 5 AND i) OR (kind = 4 AND s) OR (kind = 3 AND i AND s))),
n AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
        string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
        string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS every FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN n USING (rid)
"""


OP2_SQL = _op2_sql()
