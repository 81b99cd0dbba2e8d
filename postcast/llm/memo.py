"""Bounded memory of results inside a Python worker."""
from __future__ import annotations

from collections.abc import Callable, Hashable


class Memo(dict):
    """Results of ``make`` by argument, emptied when ``most`` are held (frequent
    arguments come back at once, and keeping track of use would cost more than it
    saves).  Keys of over ``longest`` characters are not kept.  It only saves time:
    a result never depends on what is remembered."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: Hashable):
        out = self.make(key)
        if not isinstance(key, str) or len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out
