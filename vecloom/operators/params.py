"""Hash parameters: seeded on the driver, held as fixed-point integers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vecloom.config import SCALE, WIDTH
from vecloom.functions import formulas


@dataclass(frozen=True)
class LshParams:
    """Of one part: tables of m projections (a: m x d scaled integers, b: m scaled shifts) and, for each block of
    tables, m fold coefficients."""

    part: int
    a: np.ndarray  # [tables, m, d]
    b: np.ndarray  # [tables, m]
    s: np.ndarray  # [blocks, m]
    bits: int

    @property
    def tables(self) -> int:
        return self.a.shape[0]

    @property
    def blocks(self) -> int:
        return self.s.shape[0]

    def block(self, table: int) -> int:
        """Equal blocks, of which the last takes the rest."""
        return min(table // (self.tables // self.blocks), self.blocks - 1)

    @property
    def half(self) -> int:
        """Half the shifted domain 2^bits * WIDTH; adding it makes every projection positive."""
        return (1 << self.bits) * WIDTH // 2


def make_params(part: int, d: int, t: int, m: int, tables: int, seed: int, blocks: int = 1) -> LshParams:
    """a ~ N(0, 1), b uniform in [0, 2^f * WIDTH), s uniform in [1, 2^29)."""
    if blocks > tables:
        raise ValueError(f"{tables} tables cannot be divided into {blocks} blocks")
    f = formulas.domain_bits(d, t)
    rng = np.random.Generator(np.random.PCG64([seed, part]))
    a = np.rint(rng.standard_normal((tables, m, d)) * SCALE).astype(np.int64)
    b = np.rint(rng.uniform(0, (1 << f) * WIDTH, (tables, m)) * SCALE).astype(np.int64)
    s = rng.integers(1, 1 << 29, (blocks, m))
    return LshParams(part, a, b, s, hash_bits(a, b, t, f))


def hash_bits(a: np.ndarray, b: np.ndarray, t: int, f: int) -> int:
    """u: bits of the greatest bucket number, and of 2^f at least."""
    most = int((2 * (np.abs(a).sum(axis=-1) * t + b) // (SCALE * WIDTH)).max(initial=0))
    bits = max(1 << f, most).bit_length()
    if bits > 30:
        raise ValueError("bucket numbers need more than 30 bits")
    return bits


def derived_params(part: int, d: int, t: int, n: int, ratio: int, seed: int, blocks: int = 1) -> LshParams:
    """With as many projections and tables as n points ask for; a part of one point gets one projection."""
    m = formulas.projections_needed(n, ratio, least=1)
    return make_params(part, d, t, m, formulas.tables_needed(m, ratio), seed, blocks)


SCHEMA = "part int, block_id int, table_id int, projections array<struct<a:array<bigint>,b:bigint>>, s array<bigint>, half bigint"


def params_table(spark: SparkSession, params: list[LshParams]) -> DataFrame:
    """part, block_id, table_id, projections (structs of a and b), s and half: a row for each table of each part."""
    rows = [(p.part, p.block(i), i, [(list(map(int, x)), int(y)) for x, y in zip(p.a[i], p.b[i], strict=True)], list(map(int, p.s[p.block(i)])), p.half) for p in params for i in range(p.tables)]
    return spark.createDataFrame(rows, SCHEMA)


def params_from(table: DataFrame) -> list[LshParams]:
    """The parameters of a params_table; as many rows as there are tables, which the driver held when it made them."""
    found: dict[int, list] = {}
    for r in table.orderBy("part", "table_id").collect():
        found.setdefault(r.part, []).append(r)
    out = []
    for part, rows in sorted(found.items()):
        if [r.table_id for r in rows] != list(range(len(rows))):
            raise ValueError(f"tables of part {part} are missing")
        s = {r.block_id: r.s for r in rows}
        a = np.array([[p.a for p in r.projections] for r in rows], np.int64)
        b = np.array([[p.b for p in r.projections] for r in rows], np.int64)
        out.append(LshParams(part, a, b, np.array([s[i] for i in range(len(s))], np.int64), (2 * rows[0].half // WIDTH).bit_length() - 1))
    return out


def params_sql(params: list[LshParams]) -> str:
    """The same rows as SQL VALUES: part, table_id, proj_id, a, b, s, half."""
    rows = [f"({p.part}, {i}, {j}, [{', '.join(map(str, p.a[i, j]))}]::BIGINT[], {p.b[i, j]}::BIGINT, {p.s[p.block(i)][j]}::BIGINT, {p.half}::BIGINT)" for p in params for i in range(p.tables) for j in range(p.a.shape[1])]
    return "(VALUES " + ", ".join(rows) + ") lsh(part, table_id, proj_id, a, b, s, half)"
