"""A bounded memory of results, for values that repeat a lot within a task."""

from __future__ import annotations

from collections.abc import Iterable


class Recent:
    """Results of the keys met last: ``known`` holds at least those of the current group.

    When ``known`` outgrows ``size`` it becomes ``older``; keys that are met again
    move back, so frequent keys stay and memory is bounded by both parts.
    """

    def __init__(self, size: int):
        self.size = size
        self.known: dict = {}
        self.older: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The keys whose results the caller has to put into ``known``."""
        if len(self.known) > self.size:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for key in keys:
            if key not in known:
                if key in older:
                    known[key] = older[key]
                else:
                    new.append(key)
        return new
