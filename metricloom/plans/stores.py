"""Key-value stores with tags: in memory, expiring, in layers."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable


class Store:
    def get(self, key: Hashable):
        """The value, or None."""
        raise NotImplementedError

    def put(self, key: Hashable, value, weight: int = 1, tags: Iterable[Hashable] = ()) -> None:
        raise NotImplementedError

    def remove(self, key: Hashable) -> None:
        raise NotImplementedError

    def remove_tagged(self, tag: Hashable) -> None:
        raise NotImplementedError

    def entry(self, key: Hashable):
        """(value, weight, tags) or None, for layers that copy entries up."""
        raise NotImplementedError


class MemoryStore(Store):
    """Least recently used first out, bounded by weight; what is heavier than the bound is not kept."""

    def __init__(self, most: int = 10_000):
        self.most, self.weight, self.lock = most, 0, threading.RLock()
        self.entries: OrderedDict = OrderedDict()
        self.tagged: dict[Hashable, set] = {}

    def entry(self, key):
        with self.lock:
            if key not in self.entries:
                return None
            self.entries.move_to_end(key)
            return self.entries[key]

    def get(self, key):
        found = self.entry(key)
        return None if found is None else found[0]

    def put(self, key, value, weight=1, tags=()):
        with self.lock:
            self.remove(key)
            if weight > self.most:
                return
            self.entries[key] = (value, weight, frozenset(tags))
            self.weight += weight
            for tag in self.entries[key][2]:
                self.tagged.setdefault(tag, set()).add(key)
            while self.weight > self.most:
                self.remove(next(iter(self.entries)))

    def remove(self, key):
        with self.lock:
            found = self.entries.pop(key, None)
            if found is None:
                return
            self.weight -= found[1]
            for tag in found[2]:
                self.tagged[tag].discard(key)
                if not self.tagged[tag]:
                    del self.tagged[tag]

    def remove_tagged(self, tag):
        with self.lock:
            for key in list(self.tagged.get(tag, ())):
                self.remove(key)


class ExpiringStore(Store):
    """Entries of another store that end after so many seconds."""

    def __init__(self, inner: Store, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.inner, self.seconds, self.clock = inner, seconds, clock

    def entry(self, key):
        found = self.inner.entry(key)
        if found is None:
            return None
        (until, value), weight, tags = found
        if self.clock() >= until:
            self.inner.remove(key)
            return None
        return value, weight, tags

    def get(self, key):
        found = self.entry(key)
        return None if found is None else found[0]

    def put(self, key, value, weight=1, tags=()):
        self.inner.put(key, (self.clock() + self.seconds, value), weight, tags)

    def remove(self, key):
        self.inner.remove(key)

    def remove_tagged(self, tag):
        self.inner.remove_tagged(tag)


class LayeredStore(Store):
    """Asks its layers in order; a hit is copied, tags and all, to the layers before it."""

    def __init__(self, *layers: Store):
        self.layers = layers

    def entry(self, key):
        for i, layer in enumerate(self.layers):
            found = layer.entry(key)
            if found is not None:
                for before in self.layers[:i]:
                    before.put(key, *found)
                return found
        return None

    def get(self, key):
        found = self.entry(key)
        return None if found is None else found[0]

    def put(self, key, value, weight=1, tags=()):
        for layer in self.layers:
            layer.put(key, value, weight, tags)

    def remove(self, key):
        for layer in self.layers:
            layer.remove(key)

    def remove_tagged(self, tag):
        for layer in self.layers:
            layer.remove_tagged(tag)
