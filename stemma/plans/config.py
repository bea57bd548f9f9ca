"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Window and hash of the index, shards and thresholds of a search.

    ``max_docs_per_hash`` drops windows that more documents hold from a search;
    None keeps all.
    """

    window: int = 30
    hash_width: int = 24
    slack: int = 3
    shards: int = 2
    min_hits: int = 8
    limit: int | None = 10
    max_docs_per_hash: int | None = None

    def __post_init__(self):
        for name, low, high in (("window", 8, 256), ("hash_width", 12, 64), ("slack", 0, self.window - 1), ("shards", 1, 1 << 16), ("min_hits", 1, 1 << 31)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.shards & (self.shards - 1):
            raise ValueError("shards must be a power of two")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit must not be negative")

    @property
    def shard_size(self) -> int:
        return (1 << self.hash_width) // self.shards
