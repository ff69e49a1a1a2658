"""Suffix-array dedup: every byte of a 100-byte string that also starts earlier is removed.

1. Each 100-byte window is charged to an anchor, the 32 bytes in it with the least hash. Equal windows have equal anchors
   at equal offsets, so only anchors that occur twice can carry a repeat. Anchors are 3 in 100 of the positions.
2. Occurrences of an anchor with equal context (all bytes of the windows charged to it) repeat the earliest of them in
   full. Tasks find these among their own rows before anything is shuffled, by comparing bytes, so a passage that many
   documents share is one row per task. Between tasks contexts are equal if two hashes of them are, 110 bits in all, which
   mix in blocks of eight bytes by themselves. What they find is written once: the spans of the repeats beside the rows that stand for them.
3. What remains are anchors with different contexts. Their contexts are sorted as suffixes, blockwise: contexts are laid
   out with anchors at multiples of the cover's period, the ranks of the suffixes at difference-cover places are
   computed once by doubling, and then one bucket of suffixes (those at one offset from their anchor) is sorted at a
   time, by the first bytes and, for ties, by the rank of the next cover place. Neighbours with 100 equal bytes are
   repeats. Classes are handled in runs of bounded size; of a class with very many contexts the windows' 128-bit
   hashes are grouped over all tasks instead.

Order is by key, then by start. Rows without a key come first. Defined results: null and empty texts, and those under 100
bytes, lose nothing; keys are whole numbers, or can be cast to them without loss (another key raises an error); rows with equal key and text are one document and all keep what it keeps; if texts differ under
one key, what is repeated in any of them is cut at the same places in all; an empty table gives no rows; columns of other names
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, buffers, cut, eights, mix64, pieces, prefix_hash, span_hash, table
from tidemark.llm.jaccard import whole_groups
from tidemark.llm.prefilter import key_filter, passes

LENGTH, GRAM = 100, 32
#: A difference cover: every distance modulo PERIOD is a difference of two of its places.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
NULL_KEY = -(1 << 63)
#: Two windows with one anchor share this many bytes before it or after it; TAG bits of each side's hash are kept.
HALF, TAG = (LENGTH - GRAM) // 2, 18
CROWD = 100_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor places, their hashes, first and last window start charged to each, two hashes of its context, and side tags.

    A side's tag is 0 if no window charged to the anchor has HALF bytes on that side.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - gram + 1
    span = length - gram + 1
    long = np.flatnonzero(np.diff(offsets) >= length)
    if n <= 0 or not len(long):
        return none, none.view(np.uint64), none, none, none.view(np.uint64), none.view(np.uint64), none, none
    sums = prefix_hash(data)
    at = np.arange(n, dtype=np.int64)
    value = span_hash(sums, at, at + gram)
    # Least value in each stretch of ``span`` places, the leftmost of equals, by doubling.
    low, place, have = value, at.astype(np.int32), 1
    while have < span:
        step = min(have, span - have)
        m = len(low) - step
        right = low[step:] < low[:m]
        low, place, have = np.where(right, low[step:], low[:m]), np.where(right, place[step:], place[:m]), have + step
    count = np.diff(offsets)[long] - length + 1
    start = np.repeat(offsets[long] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    charged = place[start].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], charged[1:] != charged[:-1]]))
    first, last = start[head], start[np.append(head[1:], len(start)) - 1]
    a = charged[head]
    context, other = context_hashes(data, first, last + length, a - first)
    half, mask = (length - gram) // 2, np.uint64((1 << TAG) - 1)
    before, after = a - first >= half, last + length - a - gram >= half
    left = np.where(before, (span_hash(sums, np.maximum(a - half, 0), a) & mask) | np.uint64(1), np.uint64(0))
    right = np.where(after, (span_hash(sums, a, np.minimum(a + gram + half, len(data))) & mask) | np.uint64(1), np.uint64(0))
    return a, value[a], first, last, context, other, left.astype(np.int64), right.astype(np.int64)


def context_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of byte spans and of how far in their anchors stand."""
    at, size = eights(data), end - start
    seed = (size << 8 | before).astype(np.uint64)
    x, y = mix64(seed + np.uint64(0x2545F4914F6CDD1D)), mix64(seed + np.uint64(0x94D049BB133111EB))
    for k in range(0, int(size.max(initial=0)), 8):
        live = np.flatnonzero(size > k)
        block = at[start[live] + k]
        left = size[live] - k
        block = np.where(left < 8, block & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), block)
        x[live] = mix64((x[live] ^ block) + np.uint64(0x9E3779B97F4A7C15))
        w = (y[live] + block) * np.uint64(0xD6E8FEB86659FD93)
        y[live] = w ^ (w >> np.uint64(32))
    return x, mix64(y)


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes that start at x and y are equal."""
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    apart = data[np.repeat(x, size) + step] != data[np.repeat(y, size) + step]
    out = np.ones(len(x), bool)
    out[np.repeat(np.arange(len(x)), size)[apart]] = False
    return out


def anchor_rows(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Anchors (h, c, k, doc, at) that are the first of their context in their task's piece, and the spans of the rest.

    Where a piece ends may differ from plan to plan. So both come from one pass, written once, packed by piece.
    ``c`` packs a hash of the context and the left tag, ``k`` is its other hash; ``at`` the anchor's place, how far before it the first and the last
    window start (7 bits each), and the right tag.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1), 1 << 19):
                a, h, first, last, c, k, left, right = anchors(data, offsets)
                begin, size = first, last + LENGTH - first
                row = np.searchsorted(offsets, a, "right") - 1
                doc = batch.column(0).slice(lo, hi - lo).to_numpy()[row]
                a, first, last = a - offsets[row], first - offsets[row], last - offsets[row]
                at = (((a << 14) | ((a - first) << 7) | (a - last)) << TAG) | right
                c = (c >> np.uint64(TAG) << np.uint64(TAG)) | left.astype(np.uint64)
                order = np.lexsort((at, doc, k, c, h))
                same = np.zeros(len(order), bool)
                same[1:] = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]]) & (k[order[1:]] == k[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
                twin = np.flatnonzero(same)
                for i in range(0, len(twin), 4096):
                    own = twin[i : i + 4096]
                    same[own] = same_bytes(data, begin[order[own]], begin[order[own - 1]], size[order[own]])
                o = later(order, same, doc, at)
                spans = spans_batch(doc[o], first[o], last[o] + LENGTH)
                o = order[~same]
                rows = pa.record_batch([pa.array(h[o].view(np.int64)), pa.array(c[o].view(np.int64)), pa.array(k[o].view(np.int64)), pa.array(doc[o]), pa.array(at[o])], names=["h", "c", "k", "doc", "at"])
                yield pa.record_batch([pa.array([packed(rows)], pa.binary()), pa.array([packed(spans)], pa.binary())], names=["anchors", "spans"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield from pa.ipc.open_stream(blob.as_buffer())

    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc"), F.col(text).alias("text"))
    found = cut(docs.sparkSession, keyed.mapInArrow(find, "anchors binary, spans binary"))
    return found.select("anchors").mapInArrow(unpack, "h long, c long, k long, doc long, at long"), found.select("spans").mapInArrow(unpack, "doc long, s long, e long")


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def later(order: np.ndarray, same: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted runs of equals, those that stand after the first, other than exact doubles of it."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    real = same & ((doc[order] != doc[order[head]]) | (at[order] != at[order[head]]))
    return order[real]


def spans_batch(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Spans as a batch, those of one document merged where they touch."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    if len(doc):
        group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 40
        reach = np.maximum.accumulate(group + e)
        head = np.flatnonzero(np.concatenate([[True], (group + s)[1:] > reach[:-1]]))
        e = reach[np.append(head[1:], len(doc)) - 1] - group[head]
        doc, s = doc[head], s[head]
    return pa.record_batch([pa.array(doc), pa.array(s), pa.array(e)], names=["doc", "s", "e"])


def cover_ranks(text: np.ndarray) -> np.ndarray:
    """For every place of the text that is in the cover, the rank of its suffix among those; elsewhere 0.

    Suffixes are ranked by PERIOD bytes first and then by doubling; the place PERIOD later is in the cover, too.
    """
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    wide = np.concatenate([text, np.zeros(PERIOD + 8, np.uint8)])
    views = [np.frombuffer(wide[i : i + (len(wide) - i) // 8 * 8].tobytes(), ">u8") for i in range(8)]
    word = lambda p: np.choose(p % 8, [v[np.minimum(p // 8, len(v) - 1)] for v in views])
    parts = [word(at), word(at + 8), word(at + 16), word(at + 24) >> 8]
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(at), np.int64)
    differs = np.zeros(len(at), bool)
    for p in parts:
        differs[1:] |= p[order[1:]] != p[order[:-1]]
    new[order] = np.cumsum(differs) + 1
    rank = np.zeros(n + PERIOD, np.int64)
    rank[at], step = new, PERIOD
    while step < 2 * LENGTH + PERIOD:
        after = rank[np.minimum(at + step, n + PERIOD - 1)]
        both = rank[at] * (len(at) + 2) + after
        order = np.argsort(both, kind="stable")
        new[order] = np.cumsum(np.concatenate([[0], both[order[1:]] != both[order[:-1]]])) + 1
        rank[at], step = new, step * 2
    return rank[:n]


def repeats_of(h: np.ndarray, doc: np.ndarray, a: np.ndarray, before: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Windows (doc, start) that also start earlier, among contexts whose anchors stand ``before`` bytes in.

    The contexts are laid out anew so that every anchor's place is a multiple of PERIOD; then equal windows stand at
    equal places modulo PERIOD and need the same step to the next cover place.
    """
    n, size = len(h), np.diff(offsets)
    lead = -(-int(before.max()) // PERIOD) * PERIOD
    room = -(-(size - before + PERIOD) // PERIOD) * PERIOD + lead
    anchor = np.concatenate([[0], np.cumsum(room)[:-1]]) + lead
    text = np.zeros(int(room.sum()) + LENGTH, np.uint8)
    shift = np.repeat(anchor - before - offsets[:-1], size)
    text[np.arange(len(data)) + shift] = data
    rank = cover_ranks(text)
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    wide = np.concatenate([text, np.zeros(16, np.uint8)])
    heads = np.lib.stride_tricks.sliding_window_view(wide, 8)
    docs, starts = [], []
    for x in range(LENGTH - GRAM + 1):  # a bucket: the suffixes that start x bytes before their anchor
        own = np.flatnonzero((before >= x) & (size - before + x >= LENGTH))
        if len(own) < 2:
            continue
        i = anchor[own] - x
        step = min((c - (-x)) % PERIOD for c in COVER)
        tie = rank[i + step]
        first = np.ascontiguousarray(heads[i]).view(">u8").ravel()
        keys = [a[own], doc[own], tie]
        for d in range(8, step, 8):
            keys.append(np.ascontiguousarray(heads[i + d]).view(">u8").ravel())
        order = np.lexsort([*keys[:3], *keys[:2:-1], first])
        i, own = i[order], own[order]
        equal = np.zeros(len(i), bool)
        for lo in range(1, len(i), 65536):
            p = np.arange(lo, min(lo + 65536, len(i)))
            equal[p] = (windows[i[p]] == windows[i[p - 1]]).all(axis=1)
        # Suffixes with the same 100 bytes stand together, but beyond them the ranks decide; the earliest is sought in all.
        run = np.cumsum(~equal)
        again = np.lexsort((a[own], doc[own], run))
        own, run = own[again], run[again]
        same = np.concatenate([[False], run[1:] == run[:-1]])
        twin = later(np.arange(len(own)), same, doc[own], a[own])
        docs.append(doc[own[twin]])
        starts.append(a[own[twin]] - x)
    none = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(starts)) if docs else (none, none)


def resolved(contexts: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Spans of repeats among contexts (h, doc, a, before, context), class by class."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            h, doc, a, before = (t.column(i).to_numpy() for i in range(4))
            data, offsets = buffers(as_text(t.column(4)))
            d, s = repeats_of(h, doc, a, before, data, offsets)
            return spans_batch(d, s, s + LENGTH)

        held, size = [], 0
        for t in whole_groups(batches):
            held.append(t)
            size += t.nbytes
            if size >= most:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "doc long, s long, e long")


def as_text(column: pa.ChunkedArray) -> pa.Array:
    """A binary column under a string type, for ``buffers``."""
    c = column.combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    kind = pa.large_string() if pa.types.is_large_binary(c.type) else pa.string()
    return pa.Array.from_buffers(kind, len(c), c.buffers(), null_count=0, offset=c.offset)


def crowded(contexts: DataFrame) -> DataFrame:
    """The same spans as ``resolved``, for classes of any size: by 128-bit hashes of windows, grouped over all tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, doc, a, before = (batch.column(i).to_numpy() for i in range(4))
            data, offsets = buffers(as_text(pa.chunked_array([batch.column(4)])))
            count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
            at = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            row = np.repeat(np.arange(len(a)), count)
            sums, back = prefix_hash(data), prefix_hash(255 - data[::-1])
            x = span_hash(sums, at, at + LENGTH)
            y = span_hash(back, len(data) - at - LENGTH, len(data) - at)
            start = a[row] - before[row] + at - offsets[row]
            yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(doc[row]), pa.array(start)], names=["x", "y", "doc", "s"])

    each = contexts.select("h", "doc", "a", "before", "context").mapInArrow(windows, "x long, y long, doc long, s long")
    first = each.groupBy("x", "y").agg(F.min(F.struct("doc", "s")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return each.join(first.select("x", "y", "f"), ["x", "y"]).where((F.col("doc") != F.col("f.doc")) | (F.col("s") != F.col("f.s"))).select("doc", "s", (F.col("s") + LENGTH).alias("e"))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(doc, spans): all spans (s, e) in bytes, not yet merged, of documents that repeat something."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    order = Window.partitionBy("h").orderBy("c", "k", "doc", "at")
    firsts, local = anchor_rows(docs, text, key)
    seen = firsts.withColumns({"was": F.lag("c").over(order), "too": F.lag("k").over(order), "next": F.lead("c").over(order)}).where("was is not null or next is not null")
    run = Window.partitionBy("h", "c", "k").orderBy("doc", "at")
    lead = seen.withColumns({"fdoc": F.first("doc").over(run), "fat": F.first("at").over(run)})
    seen = cut(spark, lead.select("h", "c", "doc", "at", (F.col("was").eqNullSafe(F.col("c")) & F.col("too").eqNullSafe(F.col("k"))).alias("full"), (F.col("doc") == F.col("fdoc")).alias("d"), (F.col("at") == F.col("fat")).alias("p")))
    place = F.shiftright("at", 14 + TAG)
    span = [F.col("doc"), (place - F.shiftright("at", 7 + TAG).bitwiseAND(127)).alias("s"), (place - F.shiftright("at", TAG).bitwiseAND(127) + LENGTH).alias("e")]
    whole = seen.where("full and not (d and p)").select(*span)
    # Of the first of each context those that share a side with another context of the anchor.
    low = F.lit((1 << TAG) - 1).cast("long")
    still = seen.where("not full").select("h", "doc", "at", F.col("c").bitwiseAND(low).alias("l"), F.col("at").bitwiseAND(low).alias("r"))
    shares = lambda t: (F.col(t) != 0) & (F.count("*").over(Window.partitionBy("h", t)) > 1)
    still = still.withColumns({"sl": shares("l"), "sr": shares("r")}).where("sl or sr")
    still = cut(spark, still.select("h", F.count("*").over(Window.partitionBy("h")).alias("g"), "doc", "at"))

    some = key_filter(still.select("doc"))
    wanted = still.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "g")).alias("anchors"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(some.value, batch.column(0).to_numpy())))

    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc"), F.col(text).alias("text"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1), 1 << 20):
                lists = batch.column(2).slice(lo, hi - lo)
                flat = lists.flatten()
                count = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                row = np.repeat(np.arange(hi - lo), count)
                h, at, g = (flat.field(i).to_numpy() for i in range(3))
                at = at >> TAG
                a, before, last = at >> 14, (at >> 7) & 127, at & 127
                s, e = offsets[row] + a - before, offsets[row] + a - last + LENGTH
                fits = e <= offsets[row + 1]
                h, g, a, before, row, s, e = (v[fits] for v in (h, g, a, before, row, s, e))
                size = e - s
                index = np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[index]))])
                doc = batch.column(0).slice(lo, hi - lo).to_numpy()[row]
                yield pa.record_batch([pa.array(h), pa.array(doc), pa.array(a), pa.array(before), context, pa.array(g)], names=["h", "doc", "a", "before", "context", "g"])

    found = keyed.mapInArrow(pick, "doc long, text string").join(wanted, "doc").select("doc", "text", "anchors")
    contexts = found.mapInArrow(cut_out, "h long, doc long, a long, before long, context binary, g long")
    few = resolved(contexts.where(F.col("g") <= crowd).drop("g"))
    spans = local.unionAll(whole).unionAll(few)
    if still.where(F.col("g") > crowd).limit(1).count():
        spans = spans.unionAll(crowded(cut(spark, contexts.where(F.col("g") > crowd))))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    spans = cut(spark, repeated_spans(docs, text, key))
    some = key_filter(spans.select("doc"))
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("__doc"), F.col(text).alias("__text"))

    def split(with_spans: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = passes(some.value, batch.column(1).to_numpy())
                yield batch.filter(pa.array(may if with_spans else ~may))

        return keyed.mapInArrow(pick, f"`{key}` {kind}, __doc long, __text string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1), 4 << 20):
                n, lists = hi - lo, batch.column(2).slice(lo, hi - lo)
                flat = lists.flatten()
                count = np.diff(lists.offsets.to_numpy()) if len(flat) else np.zeros(n, np.int64)
                row = np.repeat(np.arange(n), count)
                edge = np.zeros(len(data) + 1, np.int32)
                for name, sign in (("s", 1), ("e", -1)):
                    at = offsets[row] + flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else row
                    np.add.at(edge, np.minimum(at, offsets[row + 1]), sign)
                gone = np.cumsum(edge[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = offsets[1:-1][offsets[1:-1] < len(data)]
                first[inner] = gone[inner]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
                n_removed, n_spans = (x[offsets[1:]] - x[offsets[:-1]] for x in sums)
                kept = [hashlib.sha256((own if not m else own[~gone[i:j]]).tobytes()).hexdigest() for i, j, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n_removed.tolist(), strict=True) for own in (data[i:j],)]
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    shape = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    none = F.lit(None).cast("array<struct<s:long,e:long>>")
    some_cut = split(True).join(spans.withColumnRenamed("doc", "__doc"), "__doc", "left").select(key, "__text", "spans").mapInArrow(measure, shape)
    return some_cut.unionAll(split(False).select(key, "__text", none.alias("spans")).mapInArrow(measure, shape))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
