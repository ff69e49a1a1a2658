"""Deletion vectors: their codec, and rows filtered by them.

A vector is a set of 64-bit row positions: a magic number, then 32-bit roaring bitmaps by their upper halves. It stands
inline in the log in Z85 text, or in a file behind a size and before a CRC-32.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import DeletionVectorError
from tidemark.sources.storage import Storage, same_path

#: Fixed values of the format.
MAGIC, COOKIE, COOKIE_RUNS = 1681511377, 12346, 12347
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
_digit = {c: i for i, c in enumerate(Z85)}


def z85_encode(data: bytes) -> str:
    """Text of 5 characters for every 4 bytes; zeros fill up the last 4."""
    data += b"\0" * (-len(data) % 4)
    out = []
    for (v,) in struct.iter_unpack(">I", data):
        out.append("".join(Z85[v // 85**k % 85] for k in (4, 3, 2, 1, 0)))
    return "".join(out)


def z85_decode(text: str) -> bytes:
    if len(text) % 5:
        raise DeletionVectorError("Z85 text of odd length")
    try:
        return b"".join(struct.pack(">I", sum(_digit[c] * 85 ** (4 - k) for k, c in enumerate(text[i : i + 5]))) for i in range(0, len(text), 5))
    except (KeyError, struct.error) as e:
        raise DeletionVectorError("invalid Z85 text") from e


def encode_rows(rows: Iterable[int]) -> bytes:
    """The bytes of a set of row positions, magic number first."""
    x = np.unique(np.fromiter(rows, np.uint64))
    tops = np.unique(x >> np.uint64(32))
    out = [struct.pack("<IQ", MAGIC, len(tops))]
    for top in tops.tolist():
        low = (x[(x >> np.uint64(32)) == top] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        keys, first = np.unique(low >> 16, return_index=True)
        parts = np.split((low & 0xFFFF).astype("<u2"), first[1:])
        head = struct.pack("<II", COOKIE, len(keys)) + b"".join(struct.pack("<HH", k, len(p) - 1) for k, p in zip(keys.tolist(), parts, strict=True))
        at, offsets, bodies = 4 + 4 + 8 * len(keys), [], []
        for p in parts:
            if len(p) <= 4096:
                body = p.tobytes()
            else:
                bits = np.zeros(65536, np.uint8)
                bits[p] = 1
                body = np.packbits(bits, bitorder="little").tobytes()
            offsets.append(at)
            bodies.append(body)
            at += len(body)
        out += [struct.pack("<I", top), head, struct.pack(f"<{len(offsets)}I", *offsets), *bodies]
    return b"".join(out)


def decode_rows(data: bytes) -> np.ndarray:
    """The sorted row positions of the bytes."""
    try:
        magic, n = struct.unpack_from("<IQ", data)
        if magic != MAGIC:
            raise DeletionVectorError(f"unknown magic number {magic}")
        at, out = 12, [np.zeros(0, np.int64)]
        for _ in range(n):
            (top,) = struct.unpack_from("<I", data, at)
            low, at = _bitmap(data, at + 4)
            out.append(low.astype(np.int64) + (top << 32))
        return np.concatenate(out)
    except (struct.error, ValueError) as e:
        raise DeletionVectorError("the vector ends too early") from e


def _bitmap(data: bytes, at: int) -> tuple[np.ndarray, int]:
    (cookie,) = struct.unpack_from("<I", data, at)
    at += 4
    runs = cookie & 0xFFFF == COOKIE_RUNS
    if runs:
        n = (cookie >> 16) + 1
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
    elif cookie == COOKIE:
        (n,) = struct.unpack_from("<I", data, at)
        flags, at = np.zeros(n, np.uint8), at + 4
    else:
        raise DeletionVectorError(f"unknown bitmap {cookie}")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if not runs or n >= 4:
        at += 4 * n
    out = [np.zeros(0, np.int64)]
    for (key, less), run in zip(heads.tolist(), flags.tolist(), strict=True):
        if run:
            (k,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            low = np.concatenate([np.arange(s, s + m + 1) for s, m in pairs.tolist()]) if k else np.zeros(0, np.int64)
            at += 2 + 4 * k
        elif less + 1 <= 4096:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append(low + (key << 16))
    return np.concatenate(out), at


def file_of(blobs: list[bytes]) -> tuple[bytes, list[int]]:
    """A vector file with the blobs, and the offset of each."""
    out, offsets = bytearray(b"\x01"), []
    for b in blobs:
        offsets.append(len(out))
        out += struct.pack(">I", len(b)) + b + struct.pack(">I", zlib.crc32(b))
    return bytes(out), offsets


def blob_at(content: bytes, offset: int, size: int) -> bytes:
    """A vector's bytes in a file, checked."""
    if not content or content[0] != 1:
        raise DeletionVectorError("unknown version of a vector file")
    (n,) = struct.unpack_from(">I", content, offset)
    if n != size:
        raise DeletionVectorError(f"size {n} in the file, {size} in the log")
    blob = content[offset + 4 : offset + 4 + n]
    if len(blob) != n or struct.unpack_from(">I", content, offset + 4 + n)[0] != zlib.crc32(blob):
        raise DeletionVectorError("the vector's checksum does not hold")
    return blob


def vector_path(dv: dict, root: str) -> str | None:
    """The file of a vector; None if it is inline."""
    kind, text = dv["storageType"], dv["pathOrInlineDv"]
    if kind == "i":
        return None
    if kind == "p":
        return text
    if kind != "u" or len(text) < 20:
        raise DeletionVectorError(f"unknown vector {kind}")
    prefix, name = text[:-20], uuid.UUID(bytes=z85_decode(text[-20:]))
    return f"{root}/{prefix + '/' if prefix else ''}deletion_vector_{name}.bin"


#: Bytes of vectors in one file.
FILE_BYTES = 32 << 20


def write_vectors(storage: Storage, sets: dict[str, Iterable[int]], inline_below: int = 0) -> dict[str, dict]:
    """Vectors for some keys, in new files or inline if shorter than ``inline_below`` bytes; their descriptors."""
    return write_encoded(storage, ((k, encode_rows(rows := sorted(set(v))), len(rows)) for k, v in sets.items()), inline_below)


def write_encoded(storage: Storage, vectors: Iterable[tuple[str, bytes, int]], inline_below: int = 0, most: int = FILE_BYTES) -> dict[str, dict]:
    """Descriptors of vectors (key, bytes, rows), which are written in files of about ``most`` bytes as they come."""
    out: dict[str, dict] = {}
    held: list[tuple[str, bytes, int]] = []

    def flush() -> None:
        name = uuid.uuid4()
        content, offsets = file_of([b for _, b, _ in held])
        storage.put(f"{storage.root}/deletion_vector_{name}.bin", content)
        for (k, b, n), at in zip(held, offsets, strict=True):
            out[k] = {"storageType": "u", "pathOrInlineDv": z85_encode(name.bytes), "offset": at, "sizeInBytes": len(b), "cardinality": n}
        held.clear()

    for k, b, n in vectors:
        if len(b) < inline_below:
            out[k] = {"storageType": "i", "pathOrInlineDv": z85_encode(b), "offset": None, "sizeInBytes": len(b), "cardinality": n}
            continue
        held.append((k, b, n))
        if sum(len(x) for _, x, _ in held) >= most:
            flush()
    if held:
        flush()
    return out


def encoded(rows: DataFrame) -> DataFrame:
    """(file, vector, n) of positions (file, row), encoded by the executors; a file's positions come to one task."""

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(part["row"].to_numpy())
        return pd.DataFrame({"file": part["file"].iloc[:1], "vector": [encode_rows(own)], "n": [len(own)]})

    return rows.select("file", F.col("row").cast("long").alias("row")).groupBy("file").applyInPandas(encode, "file string, vector binary, n long")


def read_vector(storage: Storage, dv: dict) -> np.ndarray:
    """One vector's rows, read by the driver."""
    path = vector_path(dv, storage.root)
    if path is None:
        return decode_rows(z85_decode(dv["pathOrInlineDv"])[: dv["sizeInBytes"]])
    return decode_rows(blob_at(storage.read(path), dv["offset"] or 0, dv["sizeInBytes"]))


def deleted_rows(spark: SparkSession, root: str, vectors: list[tuple[str, dict]]) -> DataFrame:
    """(file, row) of every deleted row; ``vectors`` has the file and the descriptor. Decoded by the executors."""

    def pages(f: str, blob: bytes) -> Iterator[pd.DataFrame]:
        found = decode_rows(blob)
        for i in range(0, len(found), 100_000):
            yield pd.DataFrame({"file": f, "row": found[i : i + 100_000]})

    return _decoded(spark, root, vectors, pages, "file string, row long")


#: Rows of a chunk of a row map, bytes of maps that are broadcast at once, and by one scan in all.
CHUNK, MAP_BYTES, MAPS_BYTES = 4096, 32 << 20, 512 << 20


def map_bytes(rows: int | None, cardinality: int) -> int:
    """What the row map of a file takes at most; more than can be broadcast if the number of rows is not known."""
    if rows is None:
        return MAP_BYTES + 1
    chunks = rows // CHUNK + 1
    return 512 + 4 * chunks + CHUNK // 8 * min(chunks, cardinality)


def row_map(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as the number of each chunk that holds any (-1 for others), and the bits of those chunks in words."""
    chunks, own = np.unique(rows // CHUNK, return_inverse=True)
    at = np.full(int(chunks[-1]) + 1 if len(chunks) else 0, -1, np.int32)
    at[chunks] = np.arange(len(chunks))
    words = np.zeros(len(chunks) * CHUNK // 64, np.uint64)
    which, first = np.unique(own * (CHUNK // 64) + rows % CHUNK // 64, return_index=True)
    if len(rows):
        words[which] = np.bitwise_or.reduceat(np.uint64(1) << (rows & 63).astype(np.uint64), first)
    return at, words.view(np.int64)


def row_maps(spark: SparkSession, root: str, vectors: list[tuple[str, dict]]) -> DataFrame:
    """(file, at, words): the row map of each vector, one row each, for ``is_in``."""

    def whole(f: str, blob: bytes) -> Iterator[pd.DataFrame]:
        at, words = row_map(decode_rows(blob))
        yield pd.DataFrame({"file": [f], "at": [at], "words": [words]})

    return _decoded(spark, root, vectors, whole, "file string, at array<int>, words array<long>")


def is_in(at: Column, words: Column, row: Column) -> Column:
    """Whether a row map holds the position; false without a map."""
    chunk = F.get(at, F.shiftright(row, CHUNK.bit_length() - 1).cast("int"))
    word = F.get(words, chunk * (CHUNK // 64) + F.shiftright(row, 6).bitwiseAND(CHUNK // 64 - 1).cast("int"))
    return F.coalesce(F.getbit(word, row.bitwiseAND(63).cast("int")) == 1, F.lit(False))


def _decoded(spark: SparkSession, root: str, vectors: list[tuple[str, dict]], pages: Callable[[str, bytes], Iterator[pd.DataFrame]], shape: str) -> DataFrame:
    """What ``pages`` makes of each vector's file and bytes, on the executors."""
    plain, by_path = [], {}
    for f, dv in vectors:
        if (path := vector_path(dv, root)) is None:
            plain.append((f, dv["pathOrInlineDv"], dv["sizeInBytes"]))
        else:
            by_path.setdefault(same_path(path), (path, []))[1].append((f, dv["offset"] or 0, dv["sizeInBytes"]))

    def inline(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f, text, size in part.itertuples(index=False):
                yield from pages(f, z85_decode(text)[:size])

    def in_files(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, own, content in part.itertuples(index=False):
                if content is None:
                    raise DeletionVectorError(f"no vector file {path}")
                for x in own:
                    yield from pages(x["file"], blob_at(bytes(content), x["offset"], x["size"]))

    out = spark.createDataFrame(plain, "file string, inline string, size int").mapInPandas(inline, shape)
    if by_path:  # a vector file is read once, whatever number of data files it is for
        own = spark.createDataFrame([(k, x) for k, (_, x) in by_path.items()], "path string, own array<struct<file:string,offset:int,size:int>>")
        content = spark.read.format("binaryFile").load([p for p, _ in by_path.values()]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        found = own.join(content, "path", "left").mapInPandas(in_files, shape)
        out = found if not plain else out.unionAll(found)
    return out


def file_key(path: F.Column) -> F.Column:
    """A scanned file's path, decoded, in one spelling."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/*", "/")

