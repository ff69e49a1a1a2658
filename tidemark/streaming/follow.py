"""Following a table: batches of its changes as new versions come, each handled once.

A follower keeps the last version it has handled as an application transaction of a target table, or as a file; a batch
that fails is handled again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import VersionNotFound
from tidemark.sources.changes import Changes
from tidemark.sources.snapshot import Snapshot
from tidemark.sources.storage import Storage


class Follower:
    """Calls ``handle(changes, first, last)`` for versions not handled yet; progress stands in ``state`` (a file path)."""

    def __init__(self, spark: SparkSession, root: str, state: str, start: int = 0, most_versions: int = 1000):
        self.spark, self.root, self.state, self.start, self.most = spark, root, state, start, most_versions
        self.storage = Storage(spark, state)

    def handled(self) -> int:
        """The last handled version; one before the start if there is none."""
        if self.storage.head(self.state) is None:
            return self.start - 1
        return json.loads(self.storage.read(self.state))["version"]

    def run_once(self, handle: Callable[[DataFrame, int, int], None]) -> int | None:
        """Handles the next versions, if any; the last of them."""
        latest, done = Snapshot.load(self.spark, self.root).version, self.handled()
        if latest <= done:
            return None
        first, last = done + 1, min(latest, done + self.most)
        handle(Changes(self.spark, self.root, first, last).to_df(), first, last)
        self.storage.put(self.state, json.dumps({"version": last}).encode(), overwrite=True)
        return last

    def run(self, handle: Callable[[DataFrame, int, int], None], until: int, pause: float = 1.0, give_up: float = 60.0) -> int:
        """Handles versions until ``until`` is done."""
        began = time.monotonic()
        while self.handled() < until:
            if self.run_once(handle) is None:
                if time.monotonic() - began > give_up:
                    raise VersionNotFound(f"version {until} has not come")
                time.sleep(pause)
        return self.handled()
