import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import flac as C


def round_trip(rows):
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    streams = C.encode(np.concatenate(rows).astype(np.int32), offsets)
    out, at = C.decode(streams)
    assert np.array_equal(at, offsets)
    for i, r in enumerate(rows):
        assert np.array_equal(out[at[i] : at[i + 1]], r)
    return streams


def test_signals_of_all_kinds():
    rng = np.random.default_rng(0)
    wave = (60 * np.sin(np.arange(5000) / 9)).astype(int)
    rows = [np.full(64, 5), rng.integers(-128, 128, 64), rng.integers(-128, 128, 3000), wave, np.cumsum(rng.integers(-1, 2, 9000)).clip(-128, 127), np.array([-128, 127] * 700), np.full(1024, -128), rng.integers(-2, 3, 1025)]
    streams = round_trip(rows)
    assert len(streams[3]) < 0.7 * len(wave)  # predictors and Rice codes do save


def test_general_predictors_are_written_and_read():
    """A resonance that fixed predictors miss: the stream gets smaller and comes back."""
    rng = np.random.default_rng(3)
    x = [0.0] * 4
    for _ in range(6000):
        x.append(1.6 * np.cos(1.1) * x[-1] - 0.64 * x[-2] + rng.normal(0, 6))
    rows = [np.array(x).round().clip(-128, 127).astype(int)]
    stream = round_trip(rows)[0]
    frames = C.Frames([stream])
    assert any(stream[i] >> 1 >= 32 for i in range(int(frames.start[0]) + 6, int(frames.start[0]) + 8))
    assert len(stream) < 0.75 * len(rows[0])


def one_stream(stream):
    """The samples of a stream, decoded bit by bit by the format's rules, apart from the codec."""
    text = "".join(format(b, "08b") for b in stream)
    at = 8 * 4
    last = False
    while not last:
        last, kind, n = text[at] == "1", int(text[at + 1 : at + 8], 2), int(text[at + 8 : at + 32], 2)
        if kind == 0:
            total = int(text[at + 32 + 108 : at + 32 + 144], 2)
        at += 32 + 8 * n
    out = []

    def take(n, signed=False):
        nonlocal at
        v = int(text[at : at + n], 2) if n else 0
        at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    while len(out) < total:
        assert take(16) == 0xFFF8
        code = take(4)
        take(12)
        lead = take(8)
        take(8 * max(0, len(format(lead, "08b").split("0")[0]) - 1))
        size = 1 << 10 if code == 10 else take(16) + 1
        take(8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            own = [take(8, True)] * size
        elif kind == 1:
            own = [take(8, True) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            own, shift, w = [take(8, True) for _ in range(order)], 0, [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order if order < 5 else 0]
            if kind >= 32:
                bits, shift = take(4) + 1, take(5)
                w = [take(bits, True) for _ in range(order)]
            assert take(2) == 0 and take(4) == 0
            rice = take(4)
            for _ in range(size - order):
                q = text.index("1", at) - at
                at += q + 1
                u = (q << rice) | take(rice)
                own.append((sum(a * b for a, b in zip(w, own[::-1], strict=False)) >> shift) + ((u >> 1) ^ -(u & 1)))
        out += own
        at = -(-at // 8) * 8 + 16
    return out


def test_streams_are_read_by_an_independent_decoder():
    rng = np.random.default_rng(4)
    rows = [np.cumsum(rng.integers(-3, 4, 2500)).clip(-128, 127), rng.integers(-128, 128, 1100), np.full(64, 3), (50 * np.sin(np.arange(1500) / 3)).astype(int), np.frombuffer(b"some words and more words, again and again " * 40, np.uint8).astype(int) - 128]
    for r, stream in zip(rows, round_trip(rows), strict=True):
        assert one_stream(stream) == r.tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=5))
def test_any_bytes(parts):
    round_trip([np.frombuffer(p, np.int8).astype(int) for p in parts])


def test_damage_is_found():
    stream = bytearray(round_trip([np.random.default_rng(1).integers(-50, 50, 4000)])[0])
    for at in (100, 1500, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises(ValueError):
            C.decode([bytes(bad)])


def bits(*fields):
    text = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    return int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big")


def test_general_predictor_partitions_and_escapes():
    """A frame made by hand: order-2 predictor, two partitions, of which one holds raw residuals."""
    x = [10, 12]
    residuals = [1, -2, 3, 0, -1, 2, 0, 1, -3, 2, 1, 0, -1, 1]
    for r in residuals:
        x.append(((3 * x[-1] - 1 * x[-2]) >> 1) + r)
    size = 16
    rice = [((r << 1) ^ (r >> 31)) for r in residuals[:6]]
    fields = [(0, 1), (32 + 1, 6), (0, 1), (x[0], 8), (x[1], 8), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (1, 4), (1, 4)]
    for u in rice:
        fields += [(1, (u >> 1) + 1), (u & 1, 1)]
    fields += [(15, 4), (4, 5)] + [(r, 4) for r in residuals[6:]]
    head = C.frame_head(0, size)
    head += bytes([int(C.checksums(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), 8, 7)[0])])
    frame = head + bits(*fields)
    crc = int(C.checksums(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16, 0x8005)[0])
    frame += crc.to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | size).to_bytes(8, "big") + hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert C.decode([stream])[0].tolist() == x


def test_query_columns(spark, docs):
    texts = {1: None, 2: "", 3: "a", 4: "é" * 32, 5: "x" * 64, 6: "long text " * 20_000}
    rows = [*texts.items(), (3, "a"), (None, "b")]
    got = C.features(C.as_flac(docs(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        b = ((texts[r["doc_id"]] if r["doc_id"] else "b") or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 3}) == 1
    assert C.features(C.as_flac(docs([]))).count() == 0


def test_blocks_are_seekable(spark, docs):
    text = "0123456789" * 1000
    blocks = C.pcm_blocks(C.as_flac(docs([(1, text)])), samples=4096).orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [0, 4096, 8192]
    pcm = b"".join(b["pcm"] for b in blocks)
    assert bytes((np.frombuffer(pcm, np.int8).astype(int) + 128).tolist())[: len(text)].decode() == text
