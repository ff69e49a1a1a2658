"""Exact Jaccard join on word shingles, by partitioning the universe of shingles.

Sets of sizes up to T share a scheme: a hash deals the universe into m segments, more than the H = (a + b) / 9 elements
in which two sets of similarity 0.8 can differ, so at least one segment is equal in both. A scheme covers a band of
sizes and the part of the next band that may still be similar; a set writes its segments' hashes under the schemes of
its own band and, if small enough, of the band below. For small bands the scheme may use segments that tolerate one
difference instead (a segment and all its one-deletions are written; such a segment stands for two differences): the
allocation takes the number of such segments with the least cost, which is keys written plus expected chance matches.
Empty segments are no evidence and are written only by sets that have so many that the pigeonhole needs them.

Texts with the same words in the same order are one member, named by a 128-bit BLAKE2 digest of them; tasks drop copies among
their own rows before they shuffle keys. Members that share a key are a group. Groups with the same members count once.
A group's members are dealt into blocks of bounded size, each with some members of the first block beside it, and every
member is paired with the nearest that it meets. All pairs must pass a bound that loses no link: parity sketches (each
shingle flips one bit) differ in at most as many bits as the sets differ in elements. Pairs are verified on the words
of the texts, by their bytes. Once the components of these links are known, groups that still hold more than one are gone
through again: first within blocks, then between two blocks, the components are spanned by forests of nearest pairs, fewer
pairs than twice the components, and these are verified. Of the components that are left after both, all pairs that pass
the bound are verified. So neither copies that are connected already nor the components of a family are expanded into all
their pairs, no task holds more than two blocks of a group, and no link that could connect two components is missed.

What rests on hashes: that sequences with one 128-bit digest are equal, that groups with one 128-bit sum are equal, and a
set's size, counted in 64-bit shingle hashes (words are hashed by mixing blocks of eight bytes, not by a polynomial).

Defined results: null or empty texts and texts without words have an empty set, 0 shingles, and are their own component;
texts of any length are taken whole; repeated rows are linked as equal sets; rows without a key are not joined by it
but keep their row; an empty table gives no rows; columns of other names, whatever they are, are not looked at, and
``without_near_copies`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.llm.common import ascii_lower, bounded_batches, buffers, cut, mix64, numbered, pieces, release, table, words_of
from tidemark.llm.components import components, joined
from tidemark.llm.prefilter import key_filter, passes

SIZE, NUMBER, BASE = 5, 80, 100
LOWER = ascii_lower()
WORD = np.ones(256, bool)
WORD[9:14] = WORD[32] = False
#: Powers of two of the bits of the shortest and the longest sketch.
SKETCH = (10, 16)
#: Members of a block; members of the first block that stand beside every other block of their group.
BLOCK, HUBS = 1024, 16
#: Forests by which components in a unit are spanned, the next without the pairs of those before; pairs held before they are thinned to forests.
FORESTS, HELD = 2, 100_000
#: Parts into which the members of a component are dealt to learn its name.
SALTS = 32
#: Digests that a task remembers, so as to drop copies early; more copies than that are dropped later.
REMEMBERED = 200_000


def shingles(words: tuple[np.ndarray, ...], n: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ordered by row and hash, and the row of each; ``words`` as by ``words_of``."""
    row, word = words[2], words[3]
    k = max(0, len(word) - size + 1)
    whole = np.flatnonzero(row[:k] == row[size - 1 :]) if k else np.zeros(0, np.int64)
    h = np.full(len(whole), size, np.uint64)
    for i in range(size):
        h = mixed(h, word[whole + i])
    hashes, rows = [h], [row[whole]]
    many = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(many)])
    for length in range(1, size):  # shorter texts: the whole sequence
        r = np.flatnonzero(many == length)
        h = np.full(len(r), length, np.uint64)
        for i in range(length):
            h = mixed(h, word[first[r] + i])
        hashes.append(h)
        rows.append(r)
    h, r = mix64(np.concatenate(hashes)), np.concatenate(rows)
    if len(r) > len(rows[0]):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    edge = np.searchsorted(r, np.arange(n + 1))
    for i in np.flatnonzero(np.diff(edge) > 1).tolist():
        h[edge[i] : edge[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], r[keep]


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def digests(words: tuple[np.ndarray, ...], n: int) -> list[bytes]:
    """128 bits for each row's sequence of words."""
    start, end, row, _, text = words
    # Every word and one space after it.
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(first[-1]) - np.repeat(first[:-1], size)
    line = np.append(text, np.uint8(32))[np.repeat(start, size) + step]
    line[first[1:] - 1] = 32
    edge = first[np.searchsorted(row, np.arange(n + 1))].tolist()
    line = line.tobytes()
    return [hashlib.blake2b(line[i:j], digest_size=16).digest() for i, j in zip(edge[:-1], edge[1:], strict=True)]


def exact_shingles(words: tuple[np.ndarray, ...], n: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row as numbers that are equal for equal shingles only, ordered by number, and the rows."""
    start, end, row, word, text = words
    many = np.bincount(row, minlength=n)
    number = np.concatenate([numbered(text, start, end, word), np.zeros(size, np.int64)])
    first = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(len(row)) - first[row]
    at = np.flatnonzero(place <= np.maximum(many[row] - size, 0))
    left = many[row[at]] - place[at]
    # Shorter texts are filled up with 0, which is no word's number.
    folded, bound = np.where(left > 0, number[at], 0), int(number.max(initial=0)) + 1
    top = bound
    for i in range(1, size):
        if top * bound >= 1 << 62:
            folded = np.unique(folded, return_inverse=True)[1].astype(np.int64)
            top = len(folded) + 1
        folded, top = folded * bound + np.where(left > i, number[at + i], 0), top * bound
    folded = np.unique(folded, return_inverse=True)[1].astype(np.int64)
    pair = np.unique(folded * n + row[at])
    return pair // n, pair % n


class Schemes:
    """Bands of set sizes, and for each the number of exact and of one-deletion segments."""

    def __init__(self, ratio: float = 1.4, chance: float = 0.05, crowd: float = 1e5):
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * ratio)))
        self.tops = np.array(tops, np.int64)
        self.differ = (self.tops + self.tops * BASE // NUMBER) // 9
        self.loose = np.zeros(len(tops), np.int64)
        self.exact = self.differ + 1 + np.where(self.differ > 8, self.differ * 3 // 100 + 1, 0)
        for k in range(len(tops)):
            if tops[k] > 64:
                break
            self.loose[k], self.exact[k] = min(((x, max(0, int(self.differ[k]) + 1 - 2 * x)) for x in range(0, int(self.differ[k]) // 2 + 2)), key=lambda p: (self.cost(tops[k], *p, chance, crowd), p))
        self.segments = self.loose + self.exact

    @staticmethod
    def cost(size: int, loose: int, exact: int, chance: float, crowd: float) -> float:
        """Keys that a set of this size writes, and its expected matches by chance among ``crowd`` others."""
        per = size / (loose + exact)
        return exact * (1 + crowd * chance**per) + loose * (1 + per) * (1 + crowd * chance ** max(per - 1, 0))


SCHEMES = Schemes()


def sketches(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of all rows one after the other, and len + 1 offsets: a power of two of bits, for larger sets more.

    A longer sketch is folded onto a shorter one by exclusive or.
    """
    size = np.bincount(row, minlength=n)
    bits = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), *SKETCH)
    first = np.concatenate([[0], np.cumsum(bits)])
    at = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & (bits[row] - 1).astype(np.uint64)
    odd = (np.bincount(first[row] + at.astype(np.int64), minlength=int(first[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), first // 64


def folded(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sketches flat[first:last] folded to the length of the shortest, one a row."""
    size = last - first
    least = int(size.min())
    out = np.zeros((len(first), least), np.uint64)
    for length in np.unique(size).tolist():
        own = np.flatnonzero(size == length)
        whole = flat[first[own][:, None] + np.arange(length)]
        out[own] = np.bitwise_xor.reduce(whole.reshape(len(own), length // least, least), axis=1)
    return out


def keys_of(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that each row's set writes, and the row of each key."""
    size = np.bincount(row, minlength=n)
    band = np.searchsorted(SCHEMES.tops, size)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for below in (0, 1):
        k = band - below
        writes = (size > 0) & (k >= 0)
        if below:
            writes &= size <= SCHEMES.tops[np.maximum(k, 0)] * BASE // NUMBER
        part = writes[row]
        hh, rr = h[part], row[part]
        # Cells: the segments of each writing row, one row after the other.
        m = np.where(writes, SCHEMES.segments[np.maximum(k, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        segment = (mix64(hh ^ (k[rr].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(16)) % m[rr].astype(np.uint64)
        cell = base[rr] + segment.astype(np.int64)
        value = mix64(hh + np.uint64(1))
        total = np.zeros(int(base[-1]), np.uint64)
        np.add.at(total, cell, value)
        many = np.bincount(cell, minlength=len(total))
        own = np.repeat(np.arange(n), m)
        seg = np.arange(len(total)) - base[own]
        tag = mix64((k[own].astype(np.uint64) << np.uint64(32)) + seg.astype(np.uint64) + np.uint64(5))
        held = many > 0
        keys.append(mix64(total ^ tag)[held])
        rows.append(own[held])
        # One-deletions of the loose segments, which are the first ones.
        loose = seg < SCHEMES.loose[k[own]]
        each = (loose & (many > 1))[cell]
        keys.append(mix64((total[cell[each]] - value[each]) ^ tag[cell[each]]))
        rows.append(rr[each])
        # What the segments with evidence can stand for; sets that need more write their empty segments too.
        stands = np.bincount(own[held], weights=np.where(loose & (many > 1), 2, 1)[held], minlength=n)
        most = (np.minimum(SCHEMES.tops[np.maximum(k, 0)], size) + size * BASE // NUMBER) // 9 if not below else (SCHEMES.tops[np.maximum(k, 0)] + size) // 9
        needs = (writes & (stands < most + 1))[own]
        # A loose segment of one element is empty after its deletion.
        empty = np.flatnonzero(needs & (~held | (loose & (many == 1))))
        keys.append(mix64(tag[empty]))
        rows.append(own[empty])
    return np.concatenate(keys), np.concatenate(rows)


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    return words_of(data, offsets, WORD, LOWER)


def nick(digest: list[bytes]) -> np.ndarray:
    """The first eight bytes of digests, under which members are looked up."""
    return np.frombuffer(b"".join(digest), ">i8")[::2].astype(np.int64) if digest else np.zeros(0, np.int64)


class Fresh:
    """Tells which digests a task has not met yet; forgets all from time to time."""

    def __init__(self, most: int = REMEMBERED):
        self.seen: set[bytes] = set()
        self.most = most

    def rows(self, digest: list[bytes]) -> np.ndarray:
        out = []
        for i, d in enumerate(digest):
            if d not in self.seen:
                if len(self.seen) >= self.most:
                    self.seen = set()
                self.seen.add(d)
                out.append(i)
        return np.array(out, np.int64)


def written_keys(docs: DataFrame, text: str) -> DataFrame:
    """(key, m) of every text, m being the member's nick."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(0), 2 << 20):
                words = words_in(data, offsets)
                digest = digests(words, b - a)
                new = np.zeros(b - a, bool)
                new[fresh.rows(digest)] = True
                own = new[words[2]]
                h, row = shingles((*(w[own] for w in words[:4]), words[4]), b - a)
                key, own = keys_of(h, row, b - a)
                m = nick(digest)
                for i in range(0, len(key), 200_000):
                    yield pa.record_batch([pa.array(key[i : i + 200_000].view(np.int64)), pa.array(m[own[i : i + 200_000]])], names=["key", "m"])

    return docs.select(text).mapInArrow(write, "key long, m long")


def members(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, d, n_shingles, sketch, t) of every row; d is the member's digest, t a hash of the text."""
    kind = docs.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1), 2 << 20):
                n, words = b - a, words_in(data, offsets)
                h, row = shingles(words, n)
                flat, first = sketches(h, row, n)
                bits = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(a, n), pa.array(digests(words, n), pa.binary()), pa.array(np.bincount(row, minlength=n).astype(np.int64)), bits, batch.column(2).slice(a, n)], names=["key", "d", "n_shingles", "sketch", "t"])

    return docs.select(F.col(key), F.col(text), F.xxhash64(text)).mapInArrow(make, f"key {kind}, d binary, n_shingles long, sketch array<long>, t long")


def groups_of(keys: DataFrame, block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """(g1, g2, block, m): the members of each group of two or more, by blocks; ``hub`` marks the first block's members beside others.

    A group is named by two sums over its members, so groups with the same members have one name. A group that outgrows what is
    held is written as it comes, under its key's name; then a member may stand in more than one of its blocks.
    """

    def emit(g1: np.ndarray, g2: np.ndarray, at: np.ndarray, m: np.ndarray, hub: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(g1), pa.array(g2), pa.array(at.astype(np.int32)), pa.array(m), pa.array(np.full(len(m), hub))], names=["g1", "g2", "block", "m", "hub"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_m, many = None, [], 0  # the open group: its key, its members not yet written, and how many were written
        head = np.zeros(0, np.int64)

        def write_out() -> Iterator[pa.RecordBatch]:
            """The held members of a group too large to hold, after those already written."""
            nonlocal many, head, held_m
            m = np.unique(np.concatenate(held_m))
            if many == 0:
                head = m[:hubs]
            at = (many + np.arange(len(m))) // block
            name = np.full(len(m), held_key)
            yield emit(name, ~name, at, m, False)
            for k in range(max(1, -(-many // block)), (many + len(m) - 1) // block + 1):
                name = np.full(len(head), held_key)
                yield emit(name, ~name, np.full(len(head), k), head, True)
            many += len(m)
            held_m = []

        def whole(key: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Complete groups; most are of one member and go at once."""
            edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
            many = np.flatnonzero(~(edge[1:] & edge[:-1]))
            if not len(many):
                return
            many = many[np.lexsort((m[many], key[many]))]
            key, m = key[many], m[many]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (m[1:] != m[:-1])
            key, m = key[new], m[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            u = m.view(np.uint64)
            g1 = np.add.reduceat(mix64(u ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)
            g2 = np.add.reduceat(mix64(u + np.uint64(0x14057B7EF767814F)), first).view(np.int64)
            _, one = np.unique(np.stack([g1, g2], axis=1), axis=0, return_index=True) if len(first) else (None, first)
            one = one[size[one] > 1]
            if not len(one):
                return
            many = size[one]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            g1, g2 = g1[one], g2[one]
            yield emit(np.repeat(g1, many), np.repeat(g2, many), step // block, m[np.repeat(first[one], many) + step], False)
            for i in np.flatnonzero(many > block).tolist():
                for k in range(1, (int(many[i]) - 1) // block + 1):
                    head = m[first[one[i]] : first[one[i]] + hubs]
                    yield emit(np.full(len(head), g1[i]), np.full(len(head), g2[i]), np.full(len(head), k), head, True)

        def close() -> Iterator[pa.RecordBatch]:
            if held_m and many:
                yield from write_out()
            elif held_m:
                m = np.concatenate(held_m)
                yield from whole(np.full(len(m), held_key), m)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held_key is not None and key[0] == held_key:
                end = int((key != held_key).argmax()) if key[-1] != held_key else len(key)
                held_m.append(m[:end])
                key, m = key[end:], m[end:]
            if len(key):
                yield from close()
                cut_at = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if key[0] != key[-1] else 0
                if cut_at:
                    yield from whole(key[:cut_at], m[:cut_at])
                held_key, held_m, many = key[-1], [m[cut_at:]], 0
            if sum(map(len, held_m)) > 64 * block:
                held_m = [np.unique(np.concatenate(held_m))]
                if len(held_m[0]) > 32 * block:
                    yield from write_out()
        yield from close()

    dealt = keys.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(group, "g1 long, g2 long, block int, m long, hub boolean").distinct()


def changes(batch: pa.RecordBatch | pa.Table, by: int) -> np.ndarray:
    """Which rows differ from the next one in any of the first ``by`` columns, all of them numbers."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for i in range(by):
        v = batch.column(i).to_numpy()
        out |= v[1:] != v[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[pa.Table]:
    """The rows of sorted batches again, cut so that rows with equal numbers in the first ``by`` columns stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.flatnonzero(changes(batch, by))
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(by)):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            at = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def forests(c1: np.ndarray, c2: np.ndarray, far: np.ndarray, many: int = FORESTS) -> np.ndarray:
    """Places of the links (c1, c2) of the least spanning forest by ``far``, and of the next ones among the links that are left.

    What they are for a union of links, they are for the union of their forests.
    """
    order = np.lexsort((np.maximum(c1, c2), np.minimum(c1, c2), far))
    above: list[dict[int, int]] = [{} for _ in range(many)]
    out = []
    for at, a, b in zip(order.tolist(), c1[order].tolist(), c2[order].tolist(), strict=True):
        for up in above:
            x, y = a, b
            while (z := up.get(x, x)) != x:
                up[x] = x = up.get(z, z)
            while (z := up.get(y, y)) != y:
                up[y] = y = up.get(z, z)
            if x != y:
                up[x] = y
                out.append(at)
                break
    return np.array(out, np.int64)


def near_pairs(units: DataFrame, mode: str) -> DataFrame:
    """Pairs (a, b) of members' digests within a unit that pass the bound; units has g1, g2, i, j, block, d, n, sketch, component.

    ``nearest``: for each member only the nearest, in any unit, that is no larger. ``forest``: the nearest pairs that span the
    components of a unit. ``all``: all pairs of different components. In a unit of two blocks the latter two look only across them.
    """
    nearest = mode == "nearest"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 4):
            t = t.combine_chunks()
            block, n = t.column(4).to_numpy(), t.column(5).to_numpy()
            name = np.array(t.column(6).to_pylist(), object)
            comp = np.unique(np.array(t.column(7).to_pylist(), object), return_inverse=True)[1]
            lists = t.column(8).combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
            flat, place = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
            place -= place[0]
            edge = np.concatenate([[0], np.flatnonzero(changes(t, 4)) + 1, [len(n)]])
            found: dict[tuple[bytes, bytes], int] = {}
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                # By size and name (a member's component is itself at first), so that each member but the first of them all has an earlier one.
                order = lo + np.lexsort((comp[lo:hi], n[lo:hi]))
                bits = folded(flat, place[lo:hi], place[lo + 1 : hi + 1])
                held, many = [], 0
                across = not nearest and block[lo:hi].min() != block[lo:hi].max()
                for at in range(0, hi - lo, 128):
                    x = order[at : at + 128]
                    # Sizes ascend: only members from the first that is large enough up to this block matter.
                    least = -(-int(n[x[0]]) * NUMBER // BASE)
                    y = order[np.searchsorted(n[order[: at + len(x)]], least) : at + len(x)]
                    fits = (len(y) - len(x) + np.arange(len(x)))[:, None] > np.arange(len(y))[None, :]
                    fits &= n[y][None, :] * BASE >= n[x][:, None] * NUMBER
                    if not nearest:
                        fits &= comp[x][:, None] != comp[y][None, :]
                    if across:
                        fits &= block[x][:, None] != block[y][None, :]
                    i, j = np.nonzero(fits)
                    apart = np.zeros(len(i), np.int64)
                    step = max(1, 400_000 // bits.shape[1])
                    for p in range(0, len(i), step):
                        q = slice(p, p + step)
                        apart[q] = np.bitwise_count(bits[x[i[q]] - lo] ^ bits[y[j[q]] - lo]).sum(axis=1)
                    near = apart <= (n[x[i]] + n[y[j]]) // 9
                    i, j, apart = i[near], j[near], apart[near]
                    if nearest:
                        best = np.lexsort((apart, i))
                        best = best[np.concatenate([[True], i[best][1:] != i[best][:-1]])] if len(best) else best
                        i, j, apart = i[best], j[best], apart[best]
                    if mode == "forest":
                        far = apart / (n[x[i]] + n[y[j]])
                        two = np.minimum(comp[x[i]], comp[y[j]]) * len(n) + np.maximum(comp[x[i]], comp[y[j]])
                        best = np.lexsort((far, two))
                        best = best[np.concatenate([[True], two[best][1:] != two[best][:-1]])] if len(best) else best
                        held.append(np.stack([x[i[best]], y[j[best]], apart[best]]))
                        many += len(best)
                        last = at + 128 >= hi - lo
                        if not last and many < HELD:
                            continue
                        p, q, apart = np.concatenate(held, axis=1)
                        keep = forests(comp[p], comp[q], apart / (n[p] + n[q]))
                        p, q, apart = p[keep], q[keep], apart[keep]
                        held, many = [np.stack([p, q, apart])], 0
                        if not last:
                            continue
                        x, y, i, j = p, q, np.arange(len(p)), np.arange(len(p))
                    # The larger one first, and of equals the later name.
                    for p, q, r, w in zip(name[x[i]], name[y[j]], (n[x[i]] == n[y[j]]).tolist(), apart.tolist(), strict=True):
                        if p != q:
                            found[(q, p) if r and p < q else (p, q)] = w
                    if len(found) >= 100_000:
                        yield pairs_batch(found)
                        found = {}
            yield pairs_batch(found)

    unit = ["g1", "g2", "i", "j"]
    dealt = units.select(*unit, "block", "n", "d", "component", "sketch").repartition(*unit).sortWithinPartitions(*unit)
    found = dealt.mapInArrow(search, "a binary, b binary, apart long")
    if nearest:  # of all units
        found = found.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pairs_batch(found: dict[tuple[bytes, bytes], int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p for p, _ in found], pa.binary()), pa.array([q for _, q in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["a", "b", "apart"])


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs of members that are similar, by their words. ``sets`` has a hash ``t`` of a text of each member ``d``.

    A filter of fixed size picks the texts that any pair needs before they are shuffled; false positives fall to the join.
    """
    wanted = cut(docs.sparkSession, pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct().join(sets.select("d", "t").hint("merge"), "d"))
    shared = key_filter(wanted.select("t"))
    release(docs.sparkSession)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            some = batch.filter(pa.array(passes(shared.value, batch.column(1).to_numpy())))
            for a, b, data, offsets in pieces(some.column(0), 2 << 20):
                digest = digests(words_in(data, offsets), b - a)
                new = pa.array(fresh.rows(digest))
                yield pa.record_batch([pa.array(digest, pa.binary()), some.column(0).slice(a, b - a)], names=["d", "text"]).take(new)

    hashed = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("t")).where("text is not null")
    texts = hashed.mapInArrow(pick, "d binary, text string").join(wanted.select("d").hint("merge"), "d", "left_semi").groupBy("d").agg(F.first("text").alias("text"))
    both = pairs.join(texts.select(F.col("d").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("d").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in pieces(batch.column(2), 1 << 20):
                part = batch.slice(lo, hi - lo)
                n = part.num_rows
                number, row = exact_shingles(words_in(*buffers(pa.concat_arrays([part.column(2), part.column(3)]))), 2 * n)
                many = np.bincount(row, minlength=2 * n)
                nx, ny = many[:n], many[n:]
                # The rows x and n + x are one pair.
                order = np.lexsort((number, row % n))
                number, row = number[order], row[order] % n
                shared = np.bincount(row[1:][(number[1:] == number[:-1]) & (row[1:] == row[:-1])], minlength=n)
                linked = pa.array((BASE * shared >= NUMBER * (nx + ny - shared)) & (nx > 0))
                yield part.select(["a", "b"]).filter(linked)

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


def nick_of(column: str) -> Column:
    """``nick`` as an expression."""
    return F.conv(F.hex(F.substring(column, 1, 8)), 16, -10).cast("long").alias("m")


def links_and_members(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, hubs: int = HUBS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's member (key, d, n_shingles), the component of each member that has links (node, component), and links (a, b).

    The links connect all that any links connect; they are verified, but are not all that there are.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = cut(spark, members(docs, text, key))
    groups = cut(spark, groups_of(written_keys(docs, text), block, hubs))
    sets = rows.where("n_shingles > 0").groupBy("d").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("t").alias("t")).withColumn("m", nick_of("d"))
    sets = cut(spark, sets.join(groups.select("m").distinct().hint("merge"), "m", "left_semi"))
    release(spark)
    known = groups.join(sets.drop("t").hint("merge"), "m").drop("m")
    tried = cut(spark, near_pairs(known.select("*", F.col("block").alias("i"), F.col("block").alias("j"), F.col("d").alias("component")), "nearest"))
    release(spark)
    links = cut(spark, verified(tried, sets, docs, text))
    release(spark)
    found = components(links)
    release(spark)
    large = not groups.where("block > 0").isEmpty()
    for mode, where in (("forest", "within"), ("forest", "between"), ("all", "both")):
        # What may still connect two components: groups that hold more than one, by blocks and in pairs of blocks.
        of = sets.select("m", "d").join(found.withColumnRenamed("node", "d").hint("merge"), "d", "left").select("m", "d", F.coalesce("component", "d").alias("component"))
        own = groups.join(of.hint("merge"), "m")
        apart = own.where("not hub").groupBy("g1", "g2").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("block").alias("last")).where("lo <> hi")
        if where == "between":
            if not large:
                continue
            apart = apart.where("last > 0")
        split = own.where("true" if where == "within" else "not hub").join(apart.select("g1", "g2", "last").hint("merge"), ["g1", "g2"]).join(sets.select("d", "n", "sketch").hint("merge"), "d")
        others = F.array("block") if where == "within" else F.sequence(F.lit(0), F.col("last"))
        split = split.select("*", F.explode(others).alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        if where == "between":
            split = split.where("i < j")
        rest = cut(spark, near_pairs(split, mode).join(tried.hint("merge"), ["a", "b"], "left_anti"))
        release(spark)
        if rest.isEmpty():
            continue
        more = cut(spark, verified(rest, sets, docs, text))
        tried, links = tried.unionAll(rest), links.unionAll(more)
        if not more.isEmpty():
            found = joined(found, more, links)
        release(spark)
    return rows.drop("sketch", "t"), found, links


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the least key that links lead to)."""
    rows, found, _ = links_and_members(docs, text, key, block, hubs)
    own = rows.where("n_shingles > 0").groupBy("d").agg(F.min("key").alias("id"))
    linked = found.withColumnRenamed("node", "d").join(own.hint("merge"), "d").withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id")).select("*", salts)  # a large component is many tasks
    named = linked.join(least.hint("merge"), ["component", "salt"]).select("d", "component_id")
    named = own.join(named.hint("merge"), "d", "left").select("d", F.coalesce("component_id", "id").alias("component_id"))
    of = rows.join(named.hint("merge"), "d", "left")
    return of.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def without_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is the least of a component; of rows with the same key and text one, and all rows without a key.

    Rows that may not simply stay are picked by a filter of fixed size before anything is shuffled.
    """
    of = jaccard_join(docs, text, key).groupBy(F.col(key).alias("id")).agg(F.max(F.col(key) == F.col("component_id")).alias("least"), F.count("*").alias("n"))
    other = cut(docs.sparkSession, of.where("id is not null and (not least or n > 1)").select("id", "least"))
    some = key_filter(other.select(F.xxhash64("id").alias("h")))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(passes(some.value, batch.column(1).to_numpy()))], names=["row", "other"])

    row = docs.select(F.struct("*").alias("row"), F.xxhash64(key).alias("h"))
    row = row.mapInArrow(may, StructType([StructField("row", docs.schema), StructField("other", BooleanType())]))
    id_of = F.col("row").getField(key)
    asked = row.where("other").select("row", id_of.alias("id"), F.col("row").getField(text).alias("said")).join(other.hint("merge"), "id", "left")
    doubles = asked.where("least").dropDuplicates(["id", "said"])
    return row.where("not other").select("row.*").unionAll(asked.where("least is null").unionAll(doubles.select(*asked.columns)).select("row.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT DISTINCT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
), c AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component_id, d.doc_id) AS BIGINT) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
