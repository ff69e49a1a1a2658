"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session hands rows to Python in batches of at most ``most`` bytes (or one longer row).

    By default only rows are counted, and ten thousand long texts are more than a worker should hold.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows (all of them where there are fewer), chosen by a hash of ``key``.

    The choice does not depend on partitioning or order. It is only for fitting models.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 30)) + 1
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < share)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set."""
    ctx = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if not path:
        path = "file:///tmp/tidemark-checkpoints"
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(path)
    return path


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and executors may be lost."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the cluster drop the shuffle files and checkpoints of steps that nothing refers to any more.

    Spark's cleaner does so when the driver's JVM collects its garbage, by itself only every half hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and len + 1 offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 4 << 20, rows: int = 1 << 40):
    """(first row, last row + 1, bytes, offsets) of runs of at most ``rows`` rows and ``most`` bytes, or one longer row."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longer words than this are hashed by hashlib.
BLOCKWISE = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [MASK], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """For every place of the bytes the number that its next eight bytes make, zeros behind the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", wide.tobytes(), strides=(1,))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans: each block of eight bytes is mixed in by itself, longer spans go through BLAKE2."""
    at = eights(data) if at is None else at
    size = end - start
    h = mix64((size.astype(np.uint64) + np.uint64(1)) * _FACTOR)
    live = np.flatnonzero((size > 0) & (size <= BLOCKWISE))
    for k in range(0, BLOCKWISE, 8):
        live = live[size[live] > k] if k else live
        if not len(live):
            break
        block = at[start[live] + k] & _TAIL[np.minimum(size[live] - k, 8)]
        h[live] = mix64((h[live] ^ block) + _FACTOR)
    for i in np.flatnonzero(size > BLOCKWISE).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Equal numbers from 1 for equal spans, told by their bytes; the hashes only bring equal ones together."""
    order = np.argsort(hashes)
    size, first = (end - start)[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    again = np.flatnonzero(~new)
    odd = size[again] != size[again - 1]
    many = np.where(odd, 0, size[again])
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    apart = data[np.repeat(first[again], many) + step] != data[np.repeat(first[again - 1], many) + step]
    if odd.any() or apart.any():  # spans that share a hash by chance
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(data[i:j].tobytes(), len(seen) + 1) for i, j in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


#: A number for each byte value, and an odd base with its inverse modulo 2 ** 64.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``span_hash`` hashes any span of the bytes in constant time."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal byte spans wherever they stand; 64 bits."""
    inverse = powers(INVERSE, len(sums))
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: np.ndarray):
    """Words (runs of bytes that ``inside`` marks, never across rows) of lower-cased rows.

    Returns start and end of each word, the row of each word, each word's hash, and the lower-cased bytes.
    """
    text = lower[data]
    held = inside[text]
    first = held.copy()
    first[1:] &= ~held[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    first[edge] = held[edge]
    start = np.flatnonzero(first)
    last = held.copy()
    last[:-1] &= ~held[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row, hash_spans(text, start, end), text


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table
