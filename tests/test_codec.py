import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.errors import DeletionVectorError, PredicateError, SchemaError, TableError, UnsupportedFeature
from tidemark.features import Properties, Protocol, interval_ms
from tidemark.functions import expressions as E
from tidemark.functions import skipping as K
from tidemark.functions.values import escape_folder, partition_folder, unescape_folder
from tidemark.operators import vectors as V
from tidemark.plans.checksum import Checksum, Histogram, boundaries
from tidemark.sources.log import LogFile, Segment, log_file
from tidemark.sources.storage import Status, decode_path, encode_path


@settings(max_examples=50, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 200_000), st.integers(1 << 32, (1 << 32) + 300), st.just((1 << 40) + 7)), max_size=300))
def test_vectors_round_trip(rows):
    assert V.decode_rows(V.encode_rows(rows)).tolist() == sorted(rows)


def test_dense_vectors_and_files():
    rows = set(range(0, 150_000, 2)) | set(range(70_000, 90_000))
    blob = V.encode_rows(rows)
    assert V.decode_rows(blob).tolist() == sorted(rows)
    content, (first, second) = V.file_of([blob, V.encode_rows({5})])
    assert V.blob_at(content, first, len(blob)) == blob
    assert V.decode_rows(V.blob_at(content, second, len(V.encode_rows({5})))).tolist() == [5]
    damaged = bytearray(content)
    damaged[first + 30] ^= 1
    with pytest.raises(DeletionVectorError):
        V.blob_at(bytes(damaged), first, len(blob))
    with pytest.raises(DeletionVectorError):
        V.decode_rows(b"\0" * 12)


def test_run_containers():
    import struct

    head = struct.pack("<IQ", V.MAGIC, 1) + struct.pack("<I", 0)
    bitmap = struct.pack("<I", V.COOKIE_RUNS | (0 << 16)) + b"\x01" + struct.pack("<HH", 2, 9) + struct.pack("<H", 2) + struct.pack("<HHHH", 1, 3, 100, 5)
    assert V.decode_rows(head + bitmap).tolist() == [(2 << 16) + x for x in [1, 2, 3, 4, 100, 101, 102, 103, 104, 105]]


@given(st.binary(max_size=40))
def test_z85(data):
    assert V.z85_decode(V.z85_encode(data))[: len(data)] == data


def test_z85_known_value():
    assert V.z85_encode(bytes.fromhex("864FD26FB559F75B")) == "HelloWorld"


def test_vector_path():
    import uuid

    name = uuid.UUID("d2c639aa-8816-431a-aaf6-d3fe2512ff61")
    assert V.vector_path({"storageType": "u", "pathOrInlineDv": "ab" + V.z85_encode(name.bytes)}, "/t") == f"/t/ab/deletion_vector_{name}.bin"
    assert V.vector_path({"storageType": "p", "pathOrInlineDv": "s3://b/x.bin"}, "/t") == "s3://b/x.bin"


@given(st.text(max_size=20))
def test_folders_and_paths(text):
    if text and "\0" not in text:
        assert unescape_folder(escape_folder(text)) == text
    assert decode_path(encode_path(text)) == text


def test_partition_folder():
    assert partition_folder(["a", "b=c"], {"a": "x/y", "b=c": None}) == "a=x%2Fy/b%3Dc=__HIVE_DEFAULT_PARTITION__/"


def test_log_names():
    kind = lambda n: (f := log_file(Status(n, n, 1, 0, False))) and (f.kind, f.version)
    assert kind("00000000000000000007.json") == ("commit", 7)
    assert kind("7.json") is None and kind("_last_checkpoint") is None
    assert kind("00000000000000000007.checkpoint.parquet") == ("checkpoint", 7)
    assert kind("00000000000000000007.checkpoint.0000000001.0000000002.parquet") == ("multi_checkpoint", 7)
    assert kind("00000000000000000007.checkpoint.0000000003.0000000002.parquet") is None
    assert kind("00000000000000000007.00000000000000000009.compacted.json") == ("compacted", 7)
    assert kind("00000000000000000007.crc") == ("crc", 7)


def test_cover_takes_the_widest_compacted_files():
    commits = [LogFile(f"{v}", "commit", v, 1, upto=v) for v in range(3, 11)]
    compacted = [LogFile("a", "compacted", 4, 1, upto=6), LogFile("b", "compacted", 5, 1, upto=6), LogFile("c", "compacted", 1, 1, upto=4), LogFile("d", "compacted", 8, 1, upto=12)]
    assert [f.path for f in Segment(10, [], commits, compacted).cover()] == ["10", "9", "8", "7", "a", "3"]


def test_histogram_and_checksum():
    b = boundaries()
    assert len(b) == 95 and b == sorted(b) and b[1] == 8192 and b[-1] == 256 << 30
    h = Histogram()
    h.add(0)
    h.add(8192)
    h.add(1 << 50)
    assert (h.counts[0], h.counts[1], h.counts[-1]) == (1, 1, 1)
    with pytest.raises(TableError):
        h.add(20_000, -1)
    c = Checksum({}, {}, 1, 10, histogram=None)
    after = c.apply([{"commitInfo": {"inCommitTimestamp": 5}}, {"add": {"size": 7}}, {"remove": {"size": 10}}, {"txn": {"appId": "a", "version": 1}}, {"domainMetadata": {"domain": "d", "configuration": "x", "removed": False}}])
    assert (after.num_files, after.num_bytes, after.in_commit_timestamp, after.domains) == (1, 7, 5, {"d": "x"})
    lost = after.apply([{"remove": {}}])
    with pytest.raises(TableError):
        lost.data()


def test_checksum_of_operations():
    c = Checksum({}, {}, 1, 10, histogram=None)
    assert c.apply([{"commitInfo": {"operation": "MERGE"}}, {"add": {"size": 7}}]).num_files == 2
    assert c.apply([{"commitInfo": {"operation": "ADD COLUMNS"}}, {"metaData": {"id": "x"}}]).num_files == 1
    assert c.apply([{"commitInfo": {"operation": "ANALYZE STATS"}}, {"add": {"size": 10}}]).validity == "untrackable"
    after = c.carried([{"txn": {"appId": "a", "version": 1}}, {"domainMetadata": {"domain": "d", "configuration": "x", "removed": False}}])
    assert after.txns is None and after.domains is None


@pytest.mark.parametrize("rows", [[], [0], [63, 64], [4095, 4096, 70_000], list(range(5000)), [1 << 33, (1 << 33) + 4096]])
def test_row_maps_hold_their_rows(rows):
    at, words = V.row_map(np.array(rows, np.int64))
    found = [c * 4096 + i for c, k in enumerate(at.tolist()) if k >= 0 for i in range(4096) if words[k * 64 + i // 64] >> (i % 64) & 1]
    assert found == rows
    assert 4 * len(at) + 8 * len(words) <= V.map_bytes(max(rows, default=0) + 1, len(rows))


def test_properties_and_protocol():
    p = Properties.of({"delta.appendOnly": "TRUE", "delta.checkpointInterval": "0", "delta.new": "x", "own": "y", "delta.dataSkippingStatsColumns": "a, `b,c`"})
    assert p["appendOnly"] is True and p["checkpointInterval"] == 10 and p["dataSkippingStatsColumns"] == ["a", "b,c"]
    assert p.unknown.keys() == {"delta.checkpointInterval", "delta.new", "own"}
    assert interval_ms("interval 2 days") == 172_800_000
    for bad in ("interval 1 month", "interval -1 day", "2 days"):
        with pytest.raises(TableError):
            interval_ms(bad)
    Protocol(1, 2).gate("W")
    with pytest.raises(UnsupportedFeature):
        Protocol(99, 2).gate("S")
    with pytest.raises(UnsupportedFeature):
        Protocol.modern({"typeWidening"}).gate("W")
    with pytest.raises(UnsupportedFeature):
        Protocol(3, 7, ("what",), ("what",)).gate("S")
    assert Protocol.modern({"rowTracking"}).writer_features == ("domainMetadata", "rowTracking")


def test_schema_rules():
    s = T.StructType.fromDDL("a int, b struct<c: string, d: array<struct<e: long>>>")
    S.validate(s, False)
    for bad in ("a int, A int", "`x y` int"):
        with pytest.raises(SchemaError):
            S.validate(T.StructType.fromDDL(bad), False)
    with pytest.raises(SchemaError):
        S.validate(T.StructType([]), False)
    mapped, last = S.assign_mapping(s)
    assert last == 5 and sorted(f.metadata[S.FIELD_ID] for f in S.every(mapped)) == [1, 2, 3, 4, 5]
    assert S.physical_path(mapped, ("b", "c"), "name")[1].startswith("col-")
    assert S.can_read_as(T.StructType.fromDDL("a int"), T.StructType.fromDDL("a long, z string"))
    assert not S.can_read_as(T.StructType.fromDDL("a int"), T.StructType.fromDDL("A int"))
    assert not S.can_read_as(T.StructType.fromDDL("a long"), T.StructType.fromDDL("a int"))
    assert S.widens(T.DecimalType(5, 2), T.DecimalType(12, 4)) and not S.widens(T.DecimalType(5, 2), T.DecimalType(5, 3))
    d = S.diff(mapped, T.StructType([*mapped.fields[1:], T.StructField("n", T.LongType())]))
    assert (d.added, d.removed) == (["n"], ["a"])
    kind = S.stats_schema(S.nullable(s), set(), 1)
    assert kind["minValues"].dataType.names == ["a"]


def test_where_parser():
    e = E.parse_where("a.`b c` <= 3 AND NOT x IN (1, 'it''s') OR y IS NOT NULL")
    assert isinstance(e, E.Or) and e.refs() == {("a", "b c"), ("x",), ("y",)}
    assert E.parse_where("DATE '2020-02-03'") == E.Lit(dt.date(2020, 2, 3), T.DateType())
    assert E.parse_where("1.50").value == Decimal("1.50")
    assert E.parse_where("-2 * 3").depth() == 2
    for bad in ("a =", "a BETWEEN 1", "(a = 1", "a ! b", "a IS 3", "a NOT 3", "DATE 'x'", "a LIKE 'b' c"):
        with pytest.raises(PredicateError):
            E.parse_where(bad)


def test_constants():
    value = lambda t: K.constant(E.parse_where(t))
    assert value("1 < 2 AND 3 = 3") is True and value("1 = 2 OR NULL") is None and value("NULL AND FALSE") is False
    assert value("2 IN (1, NULL)") is None and value("NULL IS NULL") is True
    assert K.never(E.parse_where("a = 1 AND 1 > 2")) and not K.never(E.parse_where("a = 1"))
    safe = K.null_safe(E.parse_where("NOT a < 3"))
    assert isinstance(safe, E.And) and safe.args[-1] == E.Compare((E.col("a"), E.lit(3)), ">=")


def test_column_names():
    assert E.col("a.`b.c`.`d``e`").path == ("a", "b.c", "d`e")
    assert np.array(E.col("x").path).tolist() == ["x"]
