"""Settings of an index and of a search, validated before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed value: the bucket width of the hash family.
WIDTH = 4
#: Projections and shifts are integers scaled by this, so that every engine computes the same buckets.
SCALE = 1 << 16


@dataclass(frozen=True)
class LshConfig:
    """ratio: the approximation factor c. prune_factor: collisions that a query may spend are prune_factor * tables + k.
    partitions: data partitions of the partitioned search. blocks: blocks of hash tables, each with fold coefficients of
    its own. split_rows: ids that one data split spans. seed: of all parameters. max_k: neighbours in the ground truth."""

    k: int = 10
    ratio: int = 2
    prune_factor: int = 3
    query_count: int = 50
    partitions: int = 1
    blocks: int = 1
    split_rows: int = 100_000
    seed: int = 1
    max_k: int | None = None

    def __post_init__(self) -> None:
        if self.ratio < 2:
            raise ValueError("ratio must be an integer of 2 or more: with 1 the radii never grow")
        for name in ("k", "prune_factor", "query_count", "partitions", "blocks", "split_rows"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if self.max_k is not None and self.max_k < self.k:
            raise ValueError("the ground truth has fewer neighbours than k")

    def budget(self, tables: int) -> int:
        return self.prune_factor * tables + self.k
