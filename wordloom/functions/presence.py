"""Boolean filters over the words (or any query-side entities) a candidate holds.

Filters are built from Python operators: ``has("magic") & ~(has("trick") | has("dragon"))``. They become a Column over one
flag per entity, which the candidates' aggregate computes anyway. An unknown entity is in no candidate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Presence:
    names: frozenset
    build: Callable[[Callable[[object], Column]], Column]

    def __and__(self, other: Presence) -> Presence:
        return Presence(self.names | other.names, lambda flag: self.build(flag) & other.build(flag))

    def __or__(self, other: Presence) -> Presence:
        return Presence(self.names | other.names, lambda flag: self.build(flag) | other.build(flag))

    def __invert__(self) -> Presence:
        return Presence(self.names, lambda flag: ~self.build(flag))


def has(entity) -> Presence:
    return Presence(frozenset([entity]), lambda flag: flag(entity))


EVERY = Presence(frozenset(), lambda flag: F.lit(True))
NONE = Presence(frozenset(), lambda flag: F.lit(False))
