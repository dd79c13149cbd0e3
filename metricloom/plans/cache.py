"""Two caches: scanned points (persisted frames) and finished charts.

Versions are read before anything is loaded, so a write during a load can't leave old data under a new
version.
"""

from __future__ import annotations

import threading
from collections import Counter, OrderedDict
from collections.abc import Sequence

from pyspark.sql import functions as F

from ..frame import PointFrame
from .stores import MemoryStore, Store

#: FNV-1a, 64 bits: offset and prime.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def stable_hash(text: str) -> int:
    """FNV-1a over UTF-16 code units; the same in every process."""
    out = FNV_OFFSET
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        out = ((out ^ int.from_bytes(raw[i : i + 2], "little")) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return out


class Versions:
    """A number for every tenant, metric and entity, raised by writes."""

    def __init__(self):
        self.numbers: Counter = Counter()

    def bump(self, tenant: str, metric: str | None, entity: int | None) -> None:
        self.numbers[(tenant, metric, entity)] += 1

    def stamp(self, tenant: str, metrics: Sequence[str], entity: int | None) -> tuple:
        scopes = [(tenant, None, None), (tenant, None, entity)]
        scopes += [(tenant, m, e) for m in metrics for e in {None, entity}]
        return tuple(self.numbers[s] for s in scopes)


class SliceCache:
    """Persisted points by scope, bucketed already where the report begins with that.

    A request loads only the entities that no slice of its scope holds up to date.  Slices none of whose
    entities are up to date are dropped, and once a scope has ``most_slices`` of them they are joined into one.
    """

    def __init__(self, most: int = 64, most_slices: int = 8):
        self.most, self.most_slices, self.versions, self.lock = most, most_slices, Versions(), threading.RLock()
        self.slices: OrderedDict[tuple, list[tuple[dict, PointFrame]]] = OrderedDict()
        self.loads = 0

    @staticmethod
    def scope(tenant: str, metrics, report, dims, head, context) -> tuple:
        bucketed = None if head is None else (head.identity, context.calendar)
        return tenant, tuple(metrics), report.timeframe, None if dims is None else tuple(sorted(dims)), bucketed

    def points(self, tenant: str, metrics, report, source, dims, head=None, context=None) -> PointFrame:
        with self.lock:
            scope = self.scope(tenant, metrics, report, dims, head, context)
            held = self.slices.setdefault(scope, [])
            self.slices.move_to_end(scope)
            self._drop_outdated(held, tenant, metrics)
            wanted = [None] if report.entities is None else list(dict.fromkeys(report.entities))
            left = {e: self.versions.stamp(tenant, metrics, e) for e in wanted}
            parts = []
            for known, frame in held:
                if use := [e for e in left if e in known]:
                    parts.append(frame if len(use) == len(known) else frame.having(frame.df.where(F.col(frame.entity).isin(use))))
                    left = {e: s for e, s in left.items() if e not in known}
            if left:
                self.loads += 1
                entities = None if None in left else list(left)
                fresh = source.points(metrics, entities, report.timeframe, dims) if head is None else source.rolled(metrics, entities, report.timeframe, dims, head, context)
                fresh = fresh.having(fresh.df.persist())
                held.append((left, fresh))
                parts.append(fresh)
            out = parts[0]
            for p in parts[1:]:
                out = out.having(out.df.unionByName(p.df))
            if len(held) > self.most_slices:
                self._join(held)
            while len(self.slices) > self.most:
                for _, frame in self.slices.popitem(last=False)[1]:
                    frame.df.unpersist()
            return out

    def _drop_outdated(self, held: list, tenant: str, metrics) -> None:
        """Entities that were written to since leave their slices; empty slices go."""
        for known, frame in list(held):
            for e in [e for e, stamp in known.items() if self.versions.stamp(tenant, metrics, e) != stamp]:
                del known[e]
            if not known:
                held[:] = [x for x in held if x[1] is not frame]
                frame.df.unpersist()

    @staticmethod
    def _join(held: list) -> None:
        """One slice of all that the slices of entities hold up to date; it reads them from memory when first used."""
        several = [x for x in held if None not in x[0]]
        if len(several) < 2:
            return
        known, df = {}, None
        for entities, frame in several:
            part = frame.df.where(F.col(frame.entity).isin(list(entities)))
            df = part if df is None else df.unionByName(part)
            known |= entities
        joined = several[0][1].having(df.persist())
        joined.df.count()  # before the parts go
        for _, frame in several:
            frame.df.unpersist()
        held[:] = [x for x in held if None in x[0]] + [(known, joined)]

    def invalidate(self, tenant: str, metric: str | None = None, entity: int | None = None) -> None:
        with self.lock:
            self.versions.bump(tenant, metric, entity)

    def clear(self) -> None:
        with self.lock:
            for held in self.slices.values():
                for _, frame in held:
                    frame.df.unpersist()
            self.slices.clear()


class ChartCache:
    """Finished charts in a store (by default in memory, bounded by their marks), tagged by what they show."""

    def __init__(self, most_marks: int = 1_000_000, store: Store | None = None):
        self.store = store or MemoryStore(most_marks)

    def key(self, report, calendar, theme=None) -> tuple | None:
        """None if a transform has no stable identity."""
        identities = [t.identity for t in report.transforms]
        if None in identities:
            return None
        return (report.tenant, report.metric, report.entities, report.timeframe, tuple(identities), report.view, report.dimensions, report.minimum_denominator, report.comparison, calendar, theme)

    def get(self, key: tuple) -> dict | None:
        return self.store.get(key)

    def put(self, key: tuple, chart: dict, touched: tuple) -> None:
        tenant, metrics, entities = touched
        shown = (None,) if entities is None else (*entities, None)
        tags = {(tenant, m, e) for m in (*metrics, None) for e in shown}
        if entities is None:
            tags |= {(tenant, m, "all") for m in (*metrics, None)}
        self.store.put(key, chart, 1 + sum(len(s["marks"]) for s in chart["series"]), tags)

    def invalidate(self, tenant: str, metric: str | None = None, entity: int | None = None) -> None:
        self.store.remove_tagged((tenant, metric, entity))
        if entity is not None:
            self.store.remove_tagged((tenant, metric, "all"))
