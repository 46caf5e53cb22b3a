"""Cached tables: reloaded when their version changes or their time is up."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Snapshot:
    """A table that is loaded once a version, for at most `seconds`, by one caller at a time.

    version() is cheap (a write counter, a commit number, a row count). The table is persisted on executors, spilling to their
    disks; the one before is released when a new one takes its place. A lost executor's blocks are computed again from the source.
    """

    def __init__(self, load: Callable[[], DataFrame], version: Callable[[], object] = lambda: None, seconds: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.load, self.version, self.seconds, self.clock = load, version, seconds, clock
        self._lock, self._held = threading.Lock(), None

    def get(self) -> DataFrame:
        with self._lock:
            now, current = self.clock(), self.version()
            if self._held:
                table, held, since = self._held
                if held == current and (self.seconds is None or now - since < self.seconds):
                    return table
                self._drop()
            table = self.load().persist(StorageLevel.MEMORY_AND_DISK)
            self._held = table, current, now
            return table

    def _drop(self) -> None:
        if self._held:
            self._held[0].unpersist()
        self._held = None

    def clear(self) -> None:
        with self._lock:
            self._drop()
