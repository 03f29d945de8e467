"""Versioned cache of key sets.

The key of an entry covers the join clause (map order does not matter, list
order does) and the versions of every index it reads at any depth, so a write
to a nested lookup makes the outer entry stale too.  Planning runs no job:
an entry is marked to persist when a search first computes it, and is weighed
(by its encoded size) when statistics are read or too many entries are
unweighed; then the oldest used go first.  A key set whose plan is estimated at
several times the capacity is not kept at all.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import threading
from collections import OrderedDict

from pyspark import StorageLevel

from .operators.terms import TermsResult
from .plans.dsl import FilterJoin, joins_in, parse_filter_join

#: Bytes of encoded key sets.
DEFAULT_CAPACITY = 268_435_456


def cache_key(fj: FilterJoin, catalog) -> str:
    body = json.dumps(dataclasses.asdict(dataclasses.replace(fj, field="", name=None, boost=1.0)), sort_keys=True, default=str)
    names: set[str] = {i.name for i in catalog.resolve(fj.indices)}
    for spec in joins_in(fj.query):
        names |= {i.name for i in catalog.resolve(parse_filter_join(spec).indices)}
    return hashlib.sha256(f"{body}|{catalog.versions(sorted(names))}".encode()).hexdigest()


#: Estimated bytes, as a multiple of the capacity, over which a key set is not kept; and most entries not weighed yet.
HOPELESS, UNWEIGHED = 8, 16


def estimate(made: TermsResult) -> int | None:
    """Bytes by the optimiser's statistics, which need no job; None if they know nothing."""
    size = int(str(made.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


class TermsCache:
    def __init__(self, capacity: int = DEFAULT_CAPACITY):
        self.capacity = capacity
        self._entries: OrderedDict[str, TermsResult] = OrderedDict()
        self._weights: dict[str, int] = {}
        self._lock = threading.RLock()
        self.hits = self.misses = self.loads = self.evictions = 0

    def get_or_add(self, fj: FilterJoin, catalog, made: TermsResult) -> tuple[TermsResult, bool]:
        key = cache_key(fj, catalog)
        with self._lock:
            if key in self._entries:
                self._entries.move_to_end(key)
                self.hits += 1
                return self._entries[key], True
            self.misses += 1
            if self.capacity <= 0 or (estimate(made) or 0) > HOPELESS * self.capacity:
                return made, False
            kept = TermsResult(made.df.distinct().persist(StorageLevel.MEMORY_AND_DISK), made.dtype, made.encoding, made.hits, made.limit, True)
            self.loads += 1
            self._entries[key] = kept
            if len(self._entries) - len(self._weights) > UNWEIGHED:
                self._weigh()
        return kept, False

    def _drop(self, key: str) -> None:
        self._entries.pop(key).df.unpersist()
        self._weights.pop(key, None)

    def _weigh(self) -> None:
        """Weighs what is not weighed yet and evicts the oldest used down to the capacity."""
        for key in [k for k in self._entries if k not in self._weights]:
            self._weights[key] = self._entries[key].size_in_bytes
            if self._weights[key] > self.capacity:
                self._drop(key)
        while sum(self._weights.values()) > self.capacity:
            self._drop(next(iter(self._entries)))
            self.evictions += 1

    def clear(self) -> None:
        with self._lock:
            for key in list(self._entries):
                self._drop(key)

    def stats(self) -> dict:
        with self._lock:
            self._weigh()
            n = self.hits + self.misses
            return {"size": len(self._entries), "size_in_bytes": sum(self._weights.values()), "request_count": n, "hit_count": self.hits, "hit_rate": self.hits / n if n else 1.0, "miss_count": self.misses, "miss_rate": self.misses / n if n else 0.0, "load_count": self.loads, "eviction_count": self.evictions}
