import json
import os
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import errors as X
from tidemark.errors import TransactionError
from tidemark.functions import expressions as E
from tidemark.operators.vectors import read_vector
from tidemark.plans.checkpoint import checksum_of
from tidemark.plans.commit import CatalogCommitter, MemoryCatalog, publish
from tidemark.plans.transaction import Transaction
from tidemark.sources import log as L
from tidemark.sources.snapshot import Snapshot
from tidemark.sources.storage import Storage
from tidemark.streaming.follow import Follower
from tidemark.table import Table

DDL = "id long, v double, s string, d date, p string, flag boolean"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "t")


@pytest.fixture
def rows(spark):
    def make(low, high):
        d = spark.range(low, high, 1, 2)
        return d.select(
            "id", (F.col("id") / 4).alias("v"), F.concat(F.lit("s" * 40), F.col("id").cast("string")).alias("s"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("d"),
            F.when(F.col("id") % 5 > 0, F.concat(F.lit("k /%"), (F.col("id") % 5).cast("string"))).alias("p"), F.when(F.col("id") % 2 == 0, F.lit(True)).alias("flag"),
        )

    return make


def ids(d):
    return sorted(r["id"] for r in d.select("id").collect())


def same(a, b):
    key = lambda d: sorted(map(str, d.collect()))
    assert key(a.select(*b.columns)) == key(b)


WHERES = ["id < 10", "id >= 90 OR p = 'k /%1'", "p IS NULL", "p IS NOT NULL AND NOT id > 20", "flag IS NULL AND v <= 5.0", "d = DATE '2024-01-05'", "p IN ('k /%2', 'x') AND d BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'", "p IS DISTINCT FROM 'k /%3'", "flag AND id % 7 = 3", "NOT (p = 'k /%4' AND id < 50)", "s > 'ssss'", "s = 'q'", "NULL", "id IN (1, 200, 99)"]


def test_skipping_never_loses_rows(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 50), partition_by=["p"])
    t.append(rows(50, 100))
    source = rows(0, 100)
    skipped = 0
    for w in WHERES:
        scan = t.scan().where(w)
        want = source.where("false" if w == "NULL" else w)
        assert ids(scan.to_df()) == ids(want), w
        assert set(ids(want)) <= set(ids(scan.pruned_only().to_df())), w
        skipped += scan.files().count() < t.scan().files().count()
    assert skipped >= 8
    assert t.scan().where("s = 'q'").files().count() == 0
    assert t.scan().where("id < 10").skip_stats().files().count() == t.scan().files().count()


def test_statistics(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 20).coalesce(1))
    s = json.loads(t.snapshot().files().first()["stats"])
    assert s["numRecords"] == 20 and s["nullCount"]["flag"] == 10 and s["minValues"]["id"] == 0 and s["maxValues"]["d"] == "2024-01-20"
    assert s["minValues"]["s"] == "s" * 32 and s["maxValues"]["s"] > "s" * 40 and "flag" not in s["minValues"]


def test_versions_and_conflicts(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10))
    a, b = t.transaction(), t.transaction()
    a.append(rows(10, 20)).commit()
    with pytest.raises(X.CommitConflict):
        b.append(rows(20, 30)).commit()
    with pytest.raises(X.TransactionError):
        a.commit()
    assert ids(t.to_df()) == list(range(20)) and ids(t.to_df(version=0)) == list(range(10))
    with pytest.raises(X.VersionNotFound):
        t.snapshot(5)
    with pytest.raises(X.TableNotFound):
        Snapshot.load(spark, root + "-none")
    with pytest.raises(X.TableError):
        Table.create(spark, root, data=rows(0, 1))
    with pytest.raises(X.SchemaError):
        t.append(rows(0, 1).withColumn("more", F.lit(1)))


def test_concurrent_writers_one_wins(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 5))
    txns, won = [t.transaction().append(rows(k * 10, k * 10 + 5)) for k in (1, 2, 3)], []

    def run(x):
        try:
            x.commit()
            won.append(x)
        except X.CommitConflict:
            pass

    threads = [threading.Thread(target=run, args=(x,)) for x in txns]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and t.snapshot().version == 1


def test_gaps_and_broken_logs(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 5))
    t.append(rows(5, 6))
    t.append(rows(6, 7))
    s = t.snapshot().storage
    s.put(f"{root}/_delta_log/_last_checkpoint", b"not json")
    assert ids(t.to_df()) == list(range(7))
    s.put(f"{root}/_delta_log/{2:020d}.crc", b"malformed")
    assert ids(t.to_df()) == list(range(7))
    s.delete(f"{root}/_delta_log/{1:020d}.json")
    with pytest.raises(X.InvalidLog):
        t.snapshot()


def test_deletion_vectors_add_up(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 40), partition_by=["p"], properties={"delta.enableDeletionVectors": "true"})
    t.delete("id % 3 = 0")
    t.delete("id % 4 = 0")
    want = [i for i in range(40) if i % 3 and i % 4]
    assert ids(t.to_df()) == want and ids(t.scan().where("id > 30").to_df()) == [i for i in want if i > 30]
    t.checkpoint()
    assert ids(t.to_df()) == want
    f = t.snapshot().files().where("deletionVector is not null").first()
    assert len(read_vector(t.snapshot().storage, f["deletionVector"].asDict())) == f["deletionVector"]["cardinality"]
    with pytest.raises(X.TransactionError):
        t.transaction().delete_rows({"missing": [1]})
    plain = Table.create(spark, root + "2", data=rows(0, 5))
    with pytest.raises(X.TransactionError):
        plain.delete("id = 1")


@pytest.mark.parametrize("mode", ["name", "id"])
def test_column_mapping(spark, root, mode):
    d = spark.range(20).select(F.col("id").alias("the id"), F.struct((F.col("id") * 2).alias("x.y"), F.array(F.struct(F.col("id").alias("deep;"))).alias("l")).alias("in ner"), (F.col("id") % 3).cast("string").alias("p t"))
    t = Table.create(spark, root, data=d, partition_by=["p t"], properties={"delta.columnMapping.mode": mode})
    same(t.to_df(), d)
    assert t.scan().where("`in ner`.`x.y` >= 30").to_df().count() == 5
    t.alter().add_column(T.StructField("new one", T.StringType())).commit()
    assert t.to_df().where("`new one` is null").count() == 20
    raw = spark.read.parquet(*[f"{root}/{r['path']}" for r in t.snapshot().files().select("path").collect()])
    assert all(c.startswith("col-") for c in raw.columns)


def test_row_ids_and_metadata_columns(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10), properties={"delta.enableRowTracking": "true"})
    before = {r["id"]: r["row_id"] for r in t.scan().select("id", "row_id").to_df().collect()}
    t.append(rows(10, 15))
    after = {r["id"]: r["row_id"] for r in t.scan().select("id", "row_id").to_df().collect()}
    assert all(after[k] == v for k, v in before.items()) and sorted(after.values()) == list(range(15))
    assert t.snapshot().row_id_high_water_mark() == 14
    with pytest.raises(X.UnsupportedFeature):
        t.scan().select("row_commit_version")
    with pytest.raises(X.UnsupportedFeature):
        Table.create(spark, root + "2", data=rows(0, 2)).scan().select("row_id").to_df()


def test_commits_keep_a_checksum_up(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10), properties={"delta.enableDeletionVectors": "true", "delta.feature.domainMetadata": "supported"})
    t.append(rows(10, 20))
    assert t.snapshot().checksum is None  # version 0 has none, so none is carried on
    t.write_checksum()
    t.transaction().append(rows(20, 30)).transaction_id("a", 3).set_domain("d", "x").commit()
    t.delete("id = 25")
    t.transaction("DELETE").remove_files(t.scan().files().limit(1)).commit()
    s = t.snapshot()
    c = s.checksum
    assert s.version == 4 and (c.num_files, c.num_bytes) == tuple(s.files().agg(F.count("*"), F.sum("size")).first())
    assert c.txns["a"]["version"] == 3 and c.domains == {"d": "x"} and sum(c.histogram.counts) == c.num_files
    s.storage.delete(f"{root}/_delta_log/{4:020d}.crc")
    assert t.snapshot().domains == {"d": "x"} and checksum_of(t.snapshot()).num_bytes == c.num_bytes
    Transaction(t.snapshot(), operation="ANALYZE STATS").append(rows(30, 31)).commit()
    assert t.snapshot().checksum is None


def test_files_of_other_writers(spark, root, rows, tmp_path):
    t = Table.create(spark, root, data=rows(0, 10), partition_by=["p"], properties={"delta.dataSkippingStatsColumns": "id,d"})
    change = t.transaction().info(job="loader", timestamp="not this")
    kind = change.stats_schema()
    assert kind["minValues"].dataType.names == ["id", "d"] and kind["numRecords"].dataType == T.LongType()
    rows(50, 60).where("p is null").drop("p").coalesce(1).write.parquet(f"{root}/outside")
    file = next(Path(root, "outside").glob("part-*.parquet"))
    n = spark.read.parquet(str(file)).count()
    stats = {"numRecords": n, "minValues": {"id": 50, "d": "2024-01-01"}, "maxValues": {"id": 59, "d": "2024-01-30"}, "nullCount": {"id": 0, "d": 0}}
    change.add_files([{"path": f"outside/{file.name}", "partitionValues": {"p": None}, "size": file.stat().st_size, "modificationTime": 0, "stats": json.dumps(stats)}]).commit()
    assert ids(t.to_df()) == [*range(10), 50, 55] and t.scan().where("id >= 50").files().count() == 1
    info = json.loads(Path(root, "_delta_log", f"{1:020d}.json").read_text().splitlines()[0])["commitInfo"]
    assert info["job"] == "loader" and isinstance(info["timestamp"], int)


def test_scan_counters(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 40).coalesce(1))
    t.append(rows(40, 60).coalesce(1))
    t.transaction("DELETE").remove_files(t.scan().where("id < 5").files()).commit()
    t.append(rows(60, 80).coalesce(1))
    m = t.scan().where("id >= 70").metrics()
    assert (m["adds_seen"], m["removes_seen"], m["live_files"], m["kept_files"], m["skipped_files"]) == (3, 1, 2, 1, 1)
    assert m["other_actions"] == 6  # four commit infos, protocol and metadata
    assert 0 < m["kept_bytes"] < m["live_bytes"] and t.scan().where("1 = 2").metrics()["kept_files"] == 0


def test_statistics_of_nan_and_negative_zero(spark, root):
    """Spark takes NaN for the greatest value, so a file's maximum is NaN where it holds one, and -0.0 equals 0.0."""
    x = [float("nan"), 1.0, -0.0]
    t = Table.create(spark, root, data=spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, x double").coalesce(1))
    t.append(spark.createDataFrame([(3, float("nan")), (4, None)], "id long, x double").coalesce(1))
    t.append(spark.createDataFrame([(5, 0.0), (6, -2.0)], "id long, x double").coalesce(1))
    for w, want in {"x > 5.0": [0, 3], "x < 0.5": [2, 5, 6], "x = 0.0": [2, 5], "x <= -0.0": [2, 5, 6], "x >= 0.0": [0, 1, 2, 3, 5], "x IS NULL": [4], "x < -1.0": [6]}.items():
        scan = t.scan().where(w)
        assert ids(scan.to_df()) == want, w
        assert set(want) <= set(ids(scan.pruned_only().to_df())), w
    assert t.scan().where("x < -1.0").files().count() == 1


@pytest.mark.parametrize("most", [None, 1100, 0])
def test_rows_under_vectors_by_maps_and_by_positions(spark, root, rows, monkeypatch, most):
    """All in one block of maps, in several blocks, and by anti joins give the same rows."""
    if most is not None:
        from tidemark.sources import changes, scan

        monkeypatch.setattr(scan, "MAP_BYTES", most)
        monkeypatch.setattr(changes, "MAP_BYTES", most)
    t = Table.create(spark, root, data=rows(0, 9000).coalesce(1), partition_by=["p"], properties={"delta.enableChangeDataFeed": "true", "delta.enableDeletionVectors": "true"})
    t.append(rows(9000, 9010))
    t.delete("id % 3 = 0 AND id < 8990")
    t.delete("id % 5 = 1")
    left = [i for i in range(9010) if i % 5 != 1 and (i % 3 or i >= 8990)]
    d = t.to_df()
    assert ids(d) == left
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftAnti" in plan) == (most == 0)
    got = {(r["id"], r["_commit_version"]) for r in t.changes(2, 3).to_df().where("_change_type = 'delete'").collect()}
    assert got == {(i, 2) for i in range(0, 8990, 3)} | {(i, 3) for i in range(9010) if i % 5 == 1 and (i % 3 or i >= 8990)}


def test_change_feed_skips_files(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10).coalesce(1), properties={"delta.enableChangeDataFeed": "true", "delta.enableDeletionVectors": "true"})
    t.append(rows(10, 20).coalesce(1))
    t.delete("id IN (3, 12)")
    t.transaction("DELETE").remove_files(t.scan().where("id >= 10").files()).commit()
    every, some = t.changes(0), t.changes(0).where("id >= 12")
    assert (every.files().count(), some.files().count()) == (5, 3)
    same(some.to_df(), every.to_df().where("id >= 12"))


def test_change_feed(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10), properties={"delta.enableChangeDataFeed": "true", "delta.enableDeletionVectors": "true"})
    t.append(rows(10, 12))
    t.delete("id < 3")
    t.transaction().no_data_change().append(rows(50, 51)).commit()
    got = {(r["id"], r["_change_type"], r["_commit_version"]) for r in t.changes(0).to_df().collect()}
    assert got == {(i, "insert", 0) for i in range(10)} | {(i, "insert", 1) for i in (10, 11)} | {(i, "delete", 2) for i in range(3)}
    assert t.changes(1, 2).where("id > 10").select("id", "_change_type").to_df().count() == 1
    seen = []
    f = Follower(spark, root, root + "-state/progress.json", most_versions=2)
    f.run(lambda d, a, b: seen.append((a, b, d.count())), until=3)
    assert seen == [(0, 1, 12), (2, 3, 3)] and f.run_once(lambda *x: None) is None
    t.alter().add_column(T.StructField("z", T.LongType())).commit()
    with pytest.raises(X.ChangeFeedError):
        t.changes(0)
    with pytest.raises(X.ChangeFeedError):
        Table.create(spark, root + "2", data=rows(0, 2)).changes(0)
    with pytest.raises(X.TransactionError):
        t.transaction().append(rows(0, 1)).remove_files(t.scan().files()).commit()


@pytest.mark.parametrize("options", [{}, {"parts": 2}, {"v2": True}, {"v2": True, "as_json": True}, {"v2": True, "sidecars": False}])
def test_checkpoints(spark, root, rows, options):
    t = Table.create(spark, root, data=rows(0, 20), partition_by=["p"], properties={"delta.checkpointPolicy": "v2", "delta.feature.domainMetadata": "supported", "delta.checkpoint.writeStatsAsStruct": "true"})
    t.transaction().append(rows(20, 25)).transaction_id("app", 3).set_domain("d", "x").commit()
    t.transaction().remove_files(t.scan().where("p = 'k /%1'").files()).commit()
    t.checkpoint(**options)
    s = t.snapshot()
    for v in range(3):
        s.storage.delete(f"{root}/_delta_log/{v:020d}.json")
    t.append(rows(30, 32))
    s = t.snapshot()
    assert s.segment.checkpoint_version == 2 and [f.version for f in s.segment.commits] == [3]
    assert ids(t.to_df()) == [i for i in range(25) if i % 5 != 1] + [30, 31]
    assert s.app_version("app") == 3 and s.domains == {"d": "x"} and s.app_version("none") is None
    assert t.scan().where("id < 5 AND p = 'k /%2'").files().count() == 1
    assert L.read_hint(s.storage)["version"] == 2


def test_checksum_and_refresh(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10), properties={"delta.enableInCommitTimestamps": "true"})
    first = t.snapshot()
    assert first.refreshed() is first
    done = t.append(rows(10, 20))
    second = first.refreshed()
    assert second.version == 1 and ids(second.scan().to_df()) == list(range(20))
    with pytest.raises(X.VersionNotFound):
        second.refreshed(0)
    assert t.write_checksum() and not t.write_checksum()
    c = t.snapshot().checksum
    assert (c.num_files, c.num_bytes) == tuple(second.files().agg(F.count("*"), F.sum("size")).first())
    carried = checksum_of(first).apply(done.actions)
    assert (carried.num_files, carried.num_bytes, carried.histogram.counts) == (c.num_files, c.num_bytes, c.histogram.counts)


def test_history(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 1), properties={"delta.enableInCommitTimestamps": "true"})
    for k in range(1, 4):
        t.append(rows(k, k + 1))
    h = t.snapshot().history()
    ts = [h.commit_timestamp(v) for v in range(4)]
    assert ts == sorted(set(ts))
    assert [h.latest_as_of(x) for x in ts] == [h.first_after(x) for x in ts] == [0, 1, 2, 3]
    assert h.latest_as_of(ts[3] + 10**6) == 3 and h.versions_between(ts[1], ts[2]) == (1, 2)
    for bad in (lambda: h.latest_as_of(ts[0] - 1), lambda: h.first_after(ts[3] + 1), lambda: h.versions_between(ts[2], ts[1])):
        with pytest.raises(X.TimestampOutOfRange):
            bad()
    plain = Table.create(spark, root + "2", data=rows(0, 1))
    assert plain.snapshot(timestamp=int(time.time() * 1000) + 60_000).version == 0


def test_not_null_nested_types_and_defaults(spark, root):
    s = T.StructType.fromDDL("a int not null, m map<string, array<int>>, t timestamp_ntz, n decimal(10,3), b binary")
    t = Table.create(spark, root, s)
    assert "timestampNtz" in t.snapshot().protocol.features() and "invariants" in t.snapshot().protocol.features()
    rows = spark.sql("select 1 as a, map('x', array(1, 2)) as m, timestamp_ntz '2024-01-01 10:00:00.123456' as t, cast(1.5 as decimal(10,3)) as n, cast('q' as binary) as b")
    t.append(rows)
    t.append(spark.sql("select 2 as a"))
    assert [tuple(r) for r in t.to_df().orderBy("a").select("a", "n").collect()] == [(1, rows.first()["n"]), (2, None)]
    assert t.scan().where("t >= TIMESTAMP_NTZ '2024-01-01 10:00:00.123400'").to_df().count() == 1
    with pytest.raises(Exception, match="must not be null"):
        t.append(spark.sql("select cast(null as int) as a"))


def test_clustering_and_append_only(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 10), cluster_by=["id", "d"], properties={"delta.appendOnly": "true"})
    assert t.snapshot().clustering_columns() == [("id",), ("d",)]
    with pytest.raises(X.TransactionError):
        t.transaction().remove_files(t.scan().files()).commit()
    with pytest.raises(X.TransactionError):
        t.transaction().add_files([{"path": "x", "partitionValues": {}, "size": 1, "modificationTime": 0, "stats": '{"numRecords": 1}'}]).commit()
    with pytest.raises(X.SchemaError):
        Table.create(spark, root + "2", data=rows(0, 1), cluster_by=["flag"])


def test_catalog(spark, root, rows):
    catalog = MemoryCatalog(most_unpublished=2)
    t = Table.create(spark, root, data=rows(0, 5), committer=CatalogCommitter(catalog, "t"))
    t.append(rows(5, 6))
    t.append(rows(6, 7))
    assert ids(t.to_df()) == list(range(7))
    with pytest.raises(X.RetryableCommit):
        t.append(rows(7, 8))
    assert publish(t.snapshot().storage, catalog, "t") == 2
    t.append(rows(7, 8))
    assert ids(t.to_df()) == list(range(8)) and ids(t.to_df(version=1)) == list(range(6))
    with pytest.raises(X.TransactionError):
        Transaction(t.snapshot())
    with pytest.raises(X.TransactionError):
        t.alter().add_column(T.StructField("z", T.LongType())).commit()


def test_opaque_predicates(spark, root, rows):
    t = Table.create(spark, root, data=rows(0, 100).repartitionByRange(4, "id"))
    near = E.Opaque((E.col("id"),), function=lambda c: F.abs(c - 10) < 3, skipping=lambda stats, negated: None if negated else (stats(("id",)).low < 13) & (stats(("id",)).high > 7))
    scan = t.scan().where(near)
    assert ids(scan.to_df()) == [8, 9, 10, 11, 12] and scan.files().count() == 1
    with pytest.raises(X.SchemaError):
        t.scan().where("nothing = 1")


def test_transform_keeps_places(spark):
    d = spark.sql("select 1 as a, named_struct('x', 1, 'y', 2) as s, 3 as c")
    e = E.Transform(insert=[("x", "z", E.lit(9))], drop={"y"}, path=("s",))
    assert d.select(*e.columns(d.schema)).first().asDict(True) == {"a": 1, "s": {"x": 1, "z": 9}, "c": 3}
    with pytest.raises(X.PredicateError):
        E.Transform(drop={"none"}).columns(d.schema)


def test_of_many_writers_one_puts_a_version(spark, tmp_path):
    """Threads here, and another process with a JVM of its own, put the same files."""
    storage = Storage(spark, str(tmp_path))
    other = """
import sys
from pyspark.sql import SparkSession
from tidemark.sources.storage import Storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
s, won = Storage(spark, sys.argv[1]), 0
open(sys.argv[1] + "/ready", "w").close()
for i in range(40):
    try:
        s.put_if_absent(f"{s.root}/{i:020d}.json", b"other" * 1000)
        won += 1
    except FileExistsError:
        pass
print("won", won)
"""
    root = Path(__file__).resolve().parents[1]
    child = subprocess.Popen([sys.executable, "-c", other, str(tmp_path)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, cwd=root, env={**os.environ, "PYTHONPATH": str(root)})
    began = time.time()
    while not (tmp_path / "ready").exists() and time.time() - began < 60:
        time.sleep(0.01)

    def put(name):
        won = 0
        for i in range(40):
            try:
                storage.put_if_absent(f"{storage.root}/{i:020d}.json", name.encode() * 5000)
                won += 1
            except FileExistsError:
                pass
        return won

    with ThreadPoolExecutor(4) as pool:
        won = sum(pool.map(put, "abcd"))
    out, _ = child.communicate(timeout=120)
    assert won + int(out.split("won")[1]) == 40
    files = sorted(tmp_path.glob("*.json"))
    assert len(files) == 40 and not list(tmp_path.glob("_*"))
    for f in files:
        data = f.read_bytes()
        assert data in (b"other" * 1000, *(c.encode() * 5000 for c in "abcd"))


def test_a_store_without_exclusive_puts_is_refused(spark, tmp_path, monkeypatch):
    storage = Storage(spark, str(tmp_path))
    monkeypatch.setattr("tidemark.sources.storage.EXCLUSIVE", {})
    with pytest.raises(TransactionError):
        storage.put_if_absent(f"{storage.root}/x.json", b"x")


def test_deletes_over_deletes_and_many_files_in_one_vector_file(spark, tmp_path):
    rows = spark.range(1000).repartition(7)
    t = Table.create(spark, str(tmp_path / "t"), data=rows, properties={"delta.enableDeletionVectors": "true"})
    t.delete("id % 10 = 0")
    t.delete("id % 15 = 0")
    assert len(list((tmp_path / "t").glob("deletion_vector_*.bin"))) == 2
    assert sorted(r["id"] for r in t.to_df().collect()) == [i for i in range(1000) if i % 10 and i % 15]
    assert sum(r["deletionVector"]["cardinality"] for r in t.snapshot().files().collect()) == len({i for i in range(1000) if not i % 10 or not i % 15})
