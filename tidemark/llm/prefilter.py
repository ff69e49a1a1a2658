"""A filter of fixed size for long keys: rows that cannot have a partner are left out before a shuffle join.

Its size does not grow with the data. Where more keys are set than it can tell apart it only lets more rows through;
the join behind it is exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64

BITS = 1 << 25
#: Bytes that go to the driver as one; small, as a task with few keys sends nearly one for each.
BLOCK = 512


def key_filter(keys: DataFrame, bits: int = BITS) -> Broadcast:
    """Broadcast bits of the one long column of ``keys``; merged by block on the executors, bits / 8 bytes in all."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for h in (mix64(x), mix64(x + np.uint64(9))):
                i = (h & np.uint64(bits - 1)).astype(np.int64)
                np.bitwise_or.at(packed, i >> 3, (128 >> (i & 7)).astype(np.uint8))
        packed = packed.reshape(-1, BLOCK)
        at = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(at), pa.array([packed[i].tobytes() for i in at], pa.binary())], names=["at", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint8)
                blocks[at] = blocks[at] | part if at in blocks else part
        yield pa.record_batch([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["at", "bits"])

    merged = keys.where(F.col(keys.columns[0]).isNotNull()).mapInArrow(mark, "at long, bits binary").repartition("at").mapInArrow(merge, "at long, bits binary")
    packed = np.zeros((bits // 8 // BLOCK, BLOCK), np.uint8)
    for r in merged.collect():  # every block once, so bits / 8 bytes at most; a local iterator would be a job for each partition
        packed[r["at"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(packed.ravel())


def passes(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the filter."""
    x, mask = keys.view(np.uint64), np.uint64(len(packed) * 8 - 1)

    def has(i: np.ndarray) -> np.ndarray:
        return (packed[i >> np.uint64(3)] >> (np.uint64(7) - (i & np.uint64(7))).astype(np.uint8)) & 1 > 0

    return has(mix64(x) & mask) & has(mix64(x + np.uint64(9)) & mask)
