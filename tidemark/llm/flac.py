"""Media columns: texts as 8-bit mono FLAC, written and read back without loss.

The codec is written for whole batches: streams are cut into frames, and each step (predictor, Rice parameter, bit
packing, bit reading, checksums) runs over all frames of a batch at once. Reading parses the stream's metadata and frames, walks
Rice codes sample by sample in step for all frames, restores fixed and general linear predictors, and verifies the
frame header CRC-8, the frame CRC-16 and the MD5 of the samples. The decoded PCM comes as blocks with the
offset of their first sample, so a reader can seek.

The payload of a text is its UTF-8 bytes and zeros up to a positive multiple of 64. Byte b is stored as sample b - 128.

Defined results: a null text is empty and has a payload of 64 zeros; texts of any length are stored whole; repeated rows
get equal streams; an empty table gives no rows; columns other than those named are not looked at, whatever their names.
Damaged streams raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, pieces, table

BLOCK, RATE, SEEK = 1024, 8000, 4
#: Order of the general predictors that are written, bits of their coefficients, and how many of these are behind the point.
ORDER, PRECISION, SHIFT = 4, 12, 9
HEAD = 4 + 4 + 34


def _crc_table(bits: int, poly: int, most: int) -> np.ndarray:
    """[d, b]: what byte b does to the checksum if d bytes follow it."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    one = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        one = np.where(one & top, (one << 1) ^ poly, one << 1) & mask
    out = np.zeros((most, 256), np.uint16)
    out[0] = one
    for d in range(1, most):
        last = out[d - 1].astype(np.int64)
        out[d] = ((last << 8) & mask) ^ one[(last >> (bits - 8)) & 255]
    return out


_tables: dict[tuple[int, int], np.ndarray] = {}


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int, poly: int) -> np.ndarray:
    """CRC of each span [start, end) of the bytes, in FLAC's manner (initial value 0, no reflection)."""
    size = end - start
    most = int(size.max(initial=1))
    if (t := _tables.get((bits, poly))) is None or len(t) < most:
        t = _tables[bits, poly] = _crc_table(bits, poly, max(most, BLOCK + 64))
    offset = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(start - offset[:-1], size) + np.arange(offset[-1])
    left = np.repeat(end, size) - 1 - index
    part = t[left, data[index]]
    return np.bitwise_xor.reduceat(part, offset[:-1]) if len(size) else np.zeros(0, np.uint16)


def coded_number(n: int) -> bytes:
    """A frame number in the UTF-8-like code of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> (6 * more), *(0x80 | (n >> (6 * k)) & 0x3F for k in range(more - 1, -1, -1))])


def frame_head(number: int, size: int) -> bytes:
    """Sync code, fixed block size; size and rate in explicit or table form; mono, 8 bits; number; CRC-8."""
    head = bytearray(b"\xff\xf8")
    exact = size == BLOCK
    head.append((0b1010 if exact else 0b0111) << 4 | 0b0100)  # 1024 samples or 16 bits at the end; 8 kHz
    head.append(0b0000_001_0)
    head += coded_number(number)
    if not exact:
        head += struct.pack(">H", size - 1)
    return bytes(head)


def predictors(x: np.ndarray, inside: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Quantised general predictors of each row's frame (12 bits, SHIFT behind the point) and whether they are usable.

    Autocorrelation of the frame, then Levinson's and Durbin's recursion for all frames at once.
    """
    y = np.where(inside, x, 0).astype(np.float32)
    lags = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : y.shape[1] - k]) for k in range(order + 1)], axis=1).astype(np.float64)
    error = lags[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), order))
    for i in range(order):
        k = (lags[:, i + 1] - (a[:, :i] * lags[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    q = np.rint(a * (1 << SHIFT)).astype(np.int32)
    return q, (abs(q) < 1 << (PRECISION - 1)).all(axis=1)


def encode(samples: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for the samples (-128..127) of each row."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    frames = -(-length // BLOCK)
    row = np.repeat(np.arange(n), frames)
    number = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(frames)[:-1]]), frames)
    start = offsets[row] + number * BLOCK
    size = np.minimum(BLOCK, offsets[row + 1] - start)
    x = np.zeros((len(row), BLOCK), np.int32)
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    x[inside] = samples
    # Fixed predictors of order 0 to 2; the one with the least sum of residuals, then its Rice parameter.
    residuals = [x, *(np.diff(x, n=k, axis=1, prepend=np.zeros((len(x), k), np.int32)) for k in (1, 2))]
    sums = np.stack([np.where(inside & (np.arange(BLOCK) >= k), np.abs(r), 0).sum(axis=1) for k, r in enumerate(residuals)], axis=1)
    order = sums.argmin(axis=1)
    order = np.where(size > 4, order, 0)
    res = np.choose(order[:, None], residuals)
    coded = (res << 1) ^ (res >> 31)
    kept = inside & (np.arange(BLOCK)[None, :] >= order[:, None])
    cost = np.stack([np.where(kept, (coded >> k) + 1 + k, 0).sum(axis=1) for k in range(9)], axis=1)
    rice, cost = cost.argmin(axis=1), cost.min(axis=1)
    # A general predictor where it saves more than its coefficients and a twentieth of the frame cost.
    weights, usable = predictors(x, inside)
    g = np.flatnonzero(usable & (size > 4 * ORDER))
    guess = np.zeros((len(g), BLOCK - ORDER), np.int32)
    for k in range(ORDER):
        guess += weights[g, k][:, None] * x[g, ORDER - 1 - k : BLOCK - 1 - k]
    lres = np.zeros((len(g), BLOCK), np.int32)
    lres[:, ORDER:] = x[g, ORDER:] - (guess >> SHIFT)
    lcoded = (lres << 1) ^ (lres >> 31)
    lkept = inside[g] & (np.arange(BLOCK)[None, :] >= ORDER)
    lcost = np.stack([np.where(lkept, (lcoded >> k) + 1 + k, 0).sum(axis=1) for k in range(3, 9)], axis=1)
    lrice, lcost = lcost.argmin(axis=1) + 3, lcost.min(axis=1)
    extra = 9 + ORDER * PRECISION
    better = lcost + 8 * ORDER + extra < 0.95 * (cost[g] + 8 * order[g])
    general = np.zeros(len(row), bool)
    general[g[better]] = True
    coded[g[better]], kept[g[better]] = lcoded[better], lkept[better]
    order[g[better]], rice[g[better]], cost[g[better]] = ORDER, lrice[better], lcost[better]
    extra = np.where(general, extra, 0)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    verbatim = ~constant & (cost + 10 + extra + 8 * order >= 8 * size)
    rice_coded = ~constant & ~verbatim
    general &= rice_coded

    heads = [frame_head(a, b) for a, b in zip(number.tolist(), size.tolist(), strict=True)]
    kinds = np.where(constant, 0, np.where(verbatim, 0b000010, np.where(general, (0b100000 | (ORDER - 1)) << 1, (0b001000 | order) << 1)))
    bits = np.where(constant, 8, np.where(verbatim, 8 * size, 8 * order + extra + 2 + 4 + 4 + cost))
    body = 1 + -(-bits // 8)
    head_size = np.array([len(h) + 1 for h in heads], np.int64)
    total = head_size + body + 2
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(at[-1]) + 16, np.uint8)
    flat = np.frombuffer(b"".join(h + b"\0" for h in heads), np.uint8)
    h_at = np.concatenate([[0], np.cumsum(head_size)])
    out[np.repeat(at[:-1] - h_at[:-1], head_size) + np.arange(h_at[-1])] = flat
    out[at[:-1] + head_size - 1] = checksums(out, at[:-1], at[:-1] + head_size - 1, 8, 0x07)
    first = at[:-1] + head_size
    out[first] = kinds
    byte = (x & 255).astype(np.uint8)
    out[first[constant] + 1] = byte[constant, 0]
    f, i = np.nonzero(inside & verbatim[:, None])
    out[first[f] + 1 + i] = byte[f, i]
    for k in range(ORDER):
        f = np.flatnonzero(rice_coded & (order > k))
        out[first[f] + 1 + k] = byte[f, k]
    f = np.flatnonzero(general)
    if len(f):
        begin = (first[f] + 1) * 8 + 8 * ORDER
        put_bits(out, begin + 4, np.full(len(f), PRECISION - 1), np.full(len(f), 4))
        put_bits(out, begin + 9, np.full(len(f), SHIFT), np.full(len(f), 5))
        for k in range(ORDER):
            put_bits(out, begin + 9 + (k + 1) * PRECISION, weights[f, k] & ((1 << PRECISION) - 1), np.full(len(f), PRECISION))
    # Rice coded residuals, in one partition: value bits behind as many zeros as the quotient says.
    f, i = np.nonzero(kept & rice_coded[:, None])
    if len(f):
        fields = np.flatnonzero(rice_coded)
        k, u = rice[f], coded[f, i]
        width = (u >> k) + 1 + k
        ends = np.cumsum(width)
        begin = np.searchsorted(f, fields)
        before = np.repeat(ends[begin] - width[begin], np.diff(np.append(begin, len(f))))
        end = (first[f] + 1) * 8 + 8 * order[f] + extra[f] + 10 + ends - before
        put_bits(out, (first[fields] + 1) * 8 + 8 * order[fields] + extra[fields] + 10, rice[fields], np.full(len(fields), 4))
        put_bits(out, end, (1 << k) | (u & ((1 << k) - 1)), k + 1)
    crc = checksums(out, at[:-1], at[1:] - 2, 16, 0x8005)
    out[at[1:] - 2], out[at[1:] - 1] = crc >> 8, crc & 255

    data, streams = out.tobytes(), []
    edge = np.concatenate([[0], np.cumsum(frames)])
    raw = samples.astype(np.int8)
    for r in range(n):
        lo, hi = int(edge[r]), int(edge[r + 1])
        sizes = total[lo:hi]
        points = range(0, hi - lo, SEEK)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(length[r])).to_bytes(8, "big") + hashlib.md5(raw[offsets[r] : offsets[r + 1]].tobytes()).digest()
        seek = b"".join(struct.pack(">QQH", p * BLOCK, int(at[lo + p] - at[lo]), int(size[lo + p])) for p in points)
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[at[lo] : at[hi]])
    return streams


def put_bits(out: np.ndarray, end: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Ors values of up to 16 bits into the bytes so that each ends before bit ``end``; ends ascend in each frame."""
    last = (end - 1) >> 3
    v = value.astype(np.int64) << (7 - ((end - 1) & 7))
    for back in range(3):
        part = ((v >> (8 * back)) & 255).astype(np.uint8)
        some = np.flatnonzero(part)
        place, part = last[some] - back, part[some]
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(some) else some
        if len(head):
            out[place[head]] |= np.bitwise_or.reduceat(part, head)


class Frames:
    """Places and headers of the frames of a batch of streams."""

    def __init__(self, streams: list[bytes]):
        self.data = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
        self.total, self.md5, self.first, self.seek = [], [], [], []
        base, starts, rows = 0, [], []
        for r, s in enumerate(streams):
            at, last, sizes = 4, False, None
            if s[:4] != b"fLaC":
                raise ValueError("not a FLAC stream")
            points: list[tuple[int, int, int]] = []
            while not last:
                last, kind, n = s[at] >> 7 == 1, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
                body = s[at + 4 : at + 4 + n]
                if kind == 0:
                    packed = int.from_bytes(body[10:18], "big")
                    if (packed >> 36) & 31 != 7 or (packed >> 41) & 7:
                        raise ValueError("only 8-bit mono streams")
                    self.total.append(packed & ((1 << 36) - 1))
                    self.md5.append(body[18:34])
                    sizes = int.from_bytes(body[0:2], "big")
                elif kind == 3:
                    points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, n, 18)]
                at += 4 + n
            self.seek.append(points)
            starts.append(base + at)
            rows.append(r)
            self.block = sizes
            base += len(s)
        self.ends = np.cumsum([len(s) for s in streams])
        self.start, self.row = np.array(starts, np.int64), np.array(rows, np.int64)


def read_heads(data: np.ndarray, at: np.ndarray):
    """Block size, frame number and length of the header of the frames that begin at the given places."""
    if not (((data[at] == 0xFF) & (data[at + 1] == 0xF8)).all()):
        raise ValueError("lost synchronisation")
    code = data[at + 2] >> 4
    lead = data[at + 4].astype(np.int64)
    more = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, 4))))
    number = np.where(more == 0, lead, lead & ((1 << np.maximum(6 - more, 0)) - 1))
    for k in range(1, 5):
        number = np.where(more >= k, (number << 6) | (data[at + 4 + k] & 63), number)
    tail = at + 5 + more
    wide = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    size = np.where(code == 6, data[tail].astype(np.int64) + 1, np.where(code == 7, ((data[tail].astype(np.int64) << 8) | data[tail + 1]) + 1, np.where(code >= 8, 256 << np.maximum(code.astype(np.int64) - 8, 0), 576 << np.maximum(code.astype(np.int64) - 2, 0))))
    length = 5 + more + wide
    if (checksums(data, at, at + length, 8, 0x07) != data[at + length]).any():
        raise ValueError("a frame header's checksum does not hold")
    return size, number, length + 1


def decode(streams: list[bytes], offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all streams, one after the other, and the offsets of the streams; checks every checksum."""
    f = Frames(streams)
    data = f.data
    window = data.astype(np.uint64)
    window = (window[:-7] << np.uint64(56)) | (window[1:-6] << np.uint64(48)) | (window[2:-5] << np.uint64(40)) | (window[3:-4] << np.uint64(32)) | (window[4:-3] << np.uint64(24)) | (window[5:-2] << np.uint64(16)) | (window[6:-1] << np.uint64(8)) | window[7:]
    offsets = np.concatenate([[0], np.cumsum(f.total)]).astype(np.int64)
    out = np.zeros(int(offsets[-1]), np.int8)
    # A frame's end is known once it is read. Seek points give many places to start from; from each, frames follow.
    at = np.array([s + p[1] for s, points in zip(f.start.tolist(), f.seek, strict=True) for p in points or [(0, 0, 0)]], np.int64)
    to = np.array([o + p[0] for o, points in zip(offsets[:-1].tolist(), f.seek, strict=True) for p in points or [(0, 0, 0)]], np.int64)
    stop = np.concatenate([np.where(np.diff(at, append=-1) > 0, np.append(at[1:], 0), 0)]) if len(at) else at
    owner = np.repeat(np.arange(len(streams)), [max(1, len(p)) for p in f.seek])
    same = np.append(owner[1:] == owner[:-1], False)
    stop = np.where(same, stop, f.ends[owner])
    while len(at):
        size, _, head = read_heads(data, at)
        x, end_bit = read_subframes(data, window, (at + head) * 8, size)
        end = -(-end_bit // 8)
        if (checksums(data, at, end, 16, 0x8005) != (data[end].astype(np.int64) << 8 | data[end + 1])).any():
            raise ValueError("a frame's checksum does not hold")
        inside = np.arange(x.shape[1])[None, :] < size[:, None]
        out[np.repeat(to, size) + np.nonzero(inside)[1]] = x[inside]
        at, to = end + 2, to + size
        live = at < stop
        at, to, stop = at[live], to[live], stop[live]
    for r, digest in enumerate(f.md5):
        if hashlib.md5(out[offsets[r] : offsets[r + 1]].tobytes()).digest() != digest:
            raise ValueError("the samples' checksum does not hold")
    return out, offsets


def read_subframes(data: np.ndarray, window: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of mono subframes that begin at the given bits, and the bit after each."""
    n, most = len(at), int(size.max())

    def take(bit: np.ndarray, width) -> np.ndarray:
        """Up to 32 bits at each place."""
        w = np.asarray(width).astype(np.uint64)
        v = window[bit >> 3] << (bit & 7).astype(np.uint64)
        return np.where(w > 0, v >> np.minimum(np.uint64(64) - w, np.uint64(63)), np.uint64(0)).astype(np.int64)

    signed = lambda v, width: v - ((v >> (width - 1)) << width)
    x = np.zeros((n, most), np.int64)
    kind, wasted = take(at + 1, 6), take(at + 7, 1)
    if wasted.any() or (take(at, 1) != 0).any():
        raise ValueError("unsupported subframe")
    at = at + 8
    lpc, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if not (lpc | fixed | (kind <= 1)).all():
        raise ValueError("unknown subframe")
    end = at.copy()
    c = kind == 0
    x[c] = signed(take(at[c], 8), 8)[:, None]
    end[c] += 8
    for r in np.flatnonzero(kind == 1):
        x[r, : size[r]] = data[at[r] >> 3 : (at[r] >> 3) + size[r]].view(np.int8) if at[r] % 8 == 0 else signed(take(at[r] + 8 * np.arange(size[r]), 8), 8)
        end[r] += 8 * size[r]
    live = np.flatnonzero(lpc | fixed)
    if not len(live):
        return x, end
    order = np.where(lpc, (kind & 31) + 1, kind & 7)[live]
    p, block = at[live], size[live]
    for k in range(int(order.max(initial=0))):
        has = order > k
        x[live[has], k] = signed(take(p[has] + 8 * k, 8), 8)
    p = p + 8 * order
    weights, shift = np.zeros((len(live), 32), np.int64), np.zeros(len(live), np.int64)
    general = lpc[live]
    if general.any():
        width = take(p, 4) + 1
        shift = np.where(general, take(p + 4, 5), 0)
        for k in range(int(order[general].max())):
            has = general & (order > k)
            weights[has, k] = signed(take(p[has] + 9 + k * width[has], width[has]), width[has])
        p = p + np.where(general, 9 + order * width, 0)
    for o, w in ((1, (1,)), (2, (2, -1)), (3, (3, -3, 1)), (4, (4, -6, 4, -1))):
        weights[np.ix_(~general & (order == o), range(o))] = w
    wide = take(p, 2)
    if (wide > 1).any():
        raise ValueError("unknown residual coding")
    bits, escape = np.where(wide == 1, 5, 4), np.where(wide == 1, 31, 15)
    parts = 1 << take(p + 2, 4)
    p = p + 6
    per = block // parts
    rice, raw = np.zeros(len(live), np.int64), np.full(len(live), -1, np.int64)
    lag = int(order.max(initial=0))
    res = np.zeros((len(live), most), np.int64)
    full = int(block.min())
    alone = bool((parts == 1).all())
    for i in range(most):
        on = None if i >= lag and i < full else np.flatnonzero((i >= order) & (i < block))
        if on is not None and not len(on):
            continue
        at_part = (i == order) if alone else ((i == order) | (i % per == 0))
        fresh = np.flatnonzero(at_part & (i >= order) & (i < block)) if (i <= lag or not alone) else ()
        if len(fresh):
            rice[fresh] = take(p[fresh], bits[fresh])
            p[fresh] += bits[fresh]
            raw[fresh] = -1
            e = fresh[rice[fresh] == escape[fresh]]
            raw[e] = take(p[e], 5)
            p[e] += 5
        q, k = (p, rice) if on is None else (p[on], rice[on])
        v = window[q >> 3] << (q & 7).astype(np.uint64)
        # Zeros before the first one: the exponent of the value as a float; values are cut to 32 bits to be exact.
        top = (v >> np.uint64(32)).astype(np.float64)
        zeros = 32 - np.frexp(top)[1]
        if (zeros >= 32).any() or (zeros + k > 48).any():
            rest = np.flatnonzero((zeros >= 32) | (zeros + k > 48))
            for j in rest.tolist():  # a very long run of zeros
                b = int(q[j])
                while not (data[b >> 3] >> (7 - (b & 7))) & 1:
                    b += 1
                zeros[j] = b - q[j]
        low = take(q + zeros + 1, k)
        u = (zeros << k) | low
        r = (u >> 1) ^ -(u & 1)
        step = zeros + 1 + k
        escaped = raw >= 0 if on is None else raw[on] >= 0
        if escaped.any():
            e = np.flatnonzero(escaped)
            w = raw[e] if on is None else raw[on][e]
            r[e] = np.where(w > 0, signed(take(q[e], w), np.maximum(w, 1)), 0)
            step[e] = w
        if on is None:
            res[:, i] = r
            p += step
        else:
            res[on, i] = r
            p[on] += step
    end[live] = p
    # Restoring: fixed predictors are repeated sums; general ones go sample by sample in step.
    own = x[live]
    for o in range(5):
        g = np.flatnonzero(~general & (order == o))
        if not len(g):
            continue
        if o == 0:
            own[g] = res[g]
            continue
        seeds = own[g, :o]
        for i in range(o, most) if o > 2 else ():
            seeds_i = sum(weights[g[0], k] * own[g, i - 1 - k] for k in range(o))
            own[g, i] = seeds_i + res[g, i]
        if o <= 2:
            y = res[g].copy()
            if o == 1:
                y[:, 0] = seeds[:, 0]
                own[g] = np.cumsum(y, axis=1)
            else:
                d = y
                d[:, 0], d[:, 1] = 0, seeds[:, 1] - seeds[:, 0]
                d = np.cumsum(d, axis=1)
                d[:, 0] = seeds[:, 0]
                own[g] = np.cumsum(d, axis=1)
    for o in np.unique(order[general]).tolist():
        g = np.flatnonzero(general & (order == o))
        # One row a sample, one column a frame; what is computed behind a frame's end is not looked at.
        y, r, w = (np.ascontiguousarray(v.T) for v in (own[g], res[g], weights[g, :o]))
        for i in range(o, most):
            guess = w[0] * y[i - 1]
            for k in range(1, o):
                guess += w[k] * y[i - 1 - k]
            y[i] = (guess >> shift[g]) + r[i]
        own[g] = y.T
    x[live] = own
    return x, end


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row and zeros up to a positive multiple of 64."""
    size = np.diff(offsets)
    room = np.maximum(1, -(-size // 64)) * 64
    at = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(int(at[-1]), np.uint8)
    out[np.repeat(at[:-1] - offsets[:-1], size) + np.arange(len(data))] = data
    return out, at


def as_flac(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's payload as a FLAC stream."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1), 1 << 20):
                payload, at = payloads(data, offsets)
                media = encode(payload.astype(np.int32) - 128, at)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(store, f"`{key}` {kind}, n_bytes long, media binary")


def runs(column: pa.Array, most: int = 2 << 20):
    """(first, last + 1, values) of runs of rows of a binary column of about ``most`` bytes."""
    at, size, held = 0, 0, []
    for i, v in enumerate(column):
        held.append(v.as_py())
        size += len(held[-1])
        if size >= most:
            yield at, i + 1, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, len(column), held


def blocks_of(streams: list[bytes], samples: int) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its PCM blocks: the offset of the first sample, and up to ``samples`` decoded samples."""
    out, offsets = decode(streams)
    return [[(i, out[lo + i : min(lo + i + samples, hi)]) for i in range(0, hi - lo, samples)] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media", samples: int = 1 << 16) -> DataFrame:
    """(key, block, sample_offset, n_samples, pcm): the decoded samples of each stream as signed bytes, in seekable blocks."""
    bounded_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, streams in runs(batch.column(1)):
                rows = [(a + r, i // samples, i, pcm.tobytes()) for r, own in enumerate(blocks_of(streams, samples)) for i, pcm in own]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([len(x[3]) for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.binary())],
                    names=[key, "block", "sample_offset", "n_samples", "pcm"],
                )

    return media.select(key, column).mapInArrow(read, f"`{key}` {kind}, block long, sample_offset long, n_samples long, pcm binary")


def features(media: DataFrame, key: str = "doc_id", samples: int = 1 << 16) -> DataFrame:
    """Digests of what is read back from the stored streams, and a feature of the signal.

    The streams are read as PCM blocks, and each block is put where its sample offset says.
    """
    bounded_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, streams in runs(batch.column(2)):
                blocks = blocks_of(streams, samples)
                offsets = np.concatenate([[0], np.cumsum([own[-1][0] + len(own[-1][1]) for own in blocks])]).astype(np.int64)
                out = np.zeros(int(offsets[-1]), np.int8)
                for at, own in zip(offsets[:-1].tolist(), blocks, strict=True):
                    for i, pcm in own:
                        out[at + i : at + i + len(pcm)] = pcm
                data = (out.astype(np.int16) + 128).astype(np.uint8)
                whole = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(b - a)]
                size = np.diff(offsets)
                energy = np.sqrt(np.add.reduceat(out.astype(np.float64) ** 2, offsets[:-1]) / size)
                flips = np.concatenate([[0], np.cumsum(np.concatenate([[False], (out[1:] >= 0) != (out[:-1] >= 0)]))])
                crossings = flips[offsets[1:]] - flips[offsets[:-1] + 1]
                feature = [f"rms={e:.4f};crossings={c};blocks={-(-int(n) // BLOCK)}" for e, c, n in zip(energy, crossings, size, strict=True)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(size),
                        pa.array([hashlib.sha256(x).hexdigest() for x in whole]),
                        pa.array([zlib.crc32(x[-64:]) for x in whole], pa.int64()),
                        pa.array([len(x) for x in streams], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in streams]),
                        pa.array(feature),
                    ],
                    names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    shape = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(key, "n_bytes", "media").mapInArrow(read, shape)


def op8_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return features(as_flac(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
