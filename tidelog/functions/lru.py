"""A least-recently-used map, for point reads on the driver."""

from __future__ import annotations

from collections import OrderedDict


class Lru:
    def __init__(self, capacity: int):
        self._items: OrderedDict = OrderedDict()
        self.resize(capacity)

    def __len__(self) -> int:
        return len(self._items)

    def __contains__(self, key) -> bool:
        return key in self._items

    def get(self, key, default=None):
        if key not in self._items:
            return default
        self._items.move_to_end(key)
        return self._items[key]

    def peek(self, key, default=None):
        return self._items.get(key, default)

    def put(self, key, value) -> None:
        self._items[key] = value
        self._items.move_to_end(key)
        self._trim()

    def remove(self, key) -> bool:
        return self._items.pop(key, self) is not self

    def resize(self, capacity: int) -> None:
        if capacity < 0:
            raise ValueError("capacity must not be negative")
        self.capacity = capacity
        self._trim()

    def clear(self) -> None:
        self._items.clear()

    def _trim(self) -> None:
        while len(self._items) > self.capacity:
            self._items.popitem(last=False)
