"""Checkpoints, the pointer to the last one, and version checksums of a snapshot."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.functions.values import parse_value
from tidemark.operators.replay import newest_of, tombstones
from tidemark.operators.stats import size_histogram
from tidemark.plans.checksum import Checksum, Histogram, boundaries
from tidemark.sources import log as L
from tidemark.sources.snapshot import Snapshot

ROWS_A_SIDECAR = 50_000


def live_actions(snapshot: Snapshot) -> tuple[DataFrame, DataFrame]:
    """What a checkpoint keeps: file actions, and protocol, metadata, transactions and domains."""
    shape = {f.name: f.dataType for f in L.ACTIONS}
    now = int(time.time() * 1000)
    blank = lambda d, kind: d.select(*(F.col(kind).cast(t).alias(n) if n == kind else F.lit(None).cast(t).alias(n) for n, t in shape.items()))
    add_fields = [f.name for f in shape["add"]]
    adds = snapshot.files().withColumn("dataChange", F.lit(False)).select(F.struct(*add_fields).alias("add"))
    gone = tombstones(snapshot.commits, snapshot.checkpoint_actions, now - snapshot.properties["deletedFileRetentionDuration"])
    gone = gone.select(F.col("remove").withField("dataChange", F.lit(False)).alias("remove"))
    actions = snapshot.actions()
    txns = newest_of(actions, "txn", "appId")
    keep = snapshot.properties["setTransactionRetentionDuration"]
    if keep is not None:
        txns = txns.where(F.col("txn.lastUpdated").isNull() | (F.col("txn.lastUpdated") > now - keep))
    domains = newest_of(actions, "domainMetadata", "domain").where("not coalesce(domainMetadata.removed, false)")
    spark = snapshot.spark
    one = lambda kind, value: spark.createDataFrame([(value,)], T.StructType([T.StructField(kind, shape[kind])]))
    fill = lambda t, v: {f.name: (fill(f.dataType, v.get(f.name)) if isinstance(f.dataType, T.StructType) and v.get(f.name) is not None else v.get(f.name)) for f in t}
    rest = blank(one("protocol", fill(shape["protocol"], snapshot.protocol.action())), "protocol")
    rest = rest.unionByName(blank(one("metaData", fill(shape["metaData"], snapshot.metadata.action())), "metaData"))
    rest = rest.unionByName(blank(txns, "txn")).unionByName(blank(domains, "domainMetadata"))
    return blank(adds, "add").unionByName(blank(gone, "remove")), rest


def with_stats(files: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Statistics in the forms that the table asks for: JSON, structs, and typed partition values."""
    as_json, as_struct = snapshot.properties["checkpoint.writeStatsAsJson"], snapshot.properties["checkpoint.writeStatsAsStruct"]
    add = F.col("add")
    if as_struct:
        physical_parts = {snapshot.physical_name(c) for c in snapshot.metadata.partition_columns}
        kind = S.stats_schema(snapshot.physical_schema, physical_parts, None)
        new = add.withField("stats_parsed", F.from_json(F.col("add.stats"), kind))
        if snapshot.metadata.partition_columns:
            fields = [S.find(snapshot.schema, c) for c in snapshot.metadata.partition_columns]
            parts = [parse_value(F.element_at("add.partitionValues", F.lit(snapshot.physical_name(f.name))), f.dataType).alias(snapshot.physical_name(f.name)) for f in fields]
            new = new.withField("partitionValues_parsed", F.struct(*parts))
        files = files.withColumn("add", F.when(add.isNotNull(), new))
    if not as_json:
        files = files.withColumn("add", F.when(F.col("add").isNotNull(), F.col("add").withField("stats", F.lit(None).cast("string"))))
    return files


def checkpoint(snapshot: Snapshot, v2: bool | None = None, sidecars: bool = True, as_json: bool = False, rows_a_sidecar: int = ROWS_A_SIDECAR, parts: int | None = None) -> int:
    """Writes a checkpoint of the snapshot's version and points to it; the number of actions in it.

    V1: ``parts`` files; if None as many as it takes at ``rows_a_sidecar`` file actions each. V2: a manifest in Parquet or JSON, and file actions in sidecars unless told otherwise.
    """
    storage, version = snapshot.storage, snapshot.version
    if v2 is None:
        v2 = snapshot.properties["checkpointPolicy"] == "v2" and "v2Checkpoint" in snapshot.protocol.features()
    folder = f"{storage.root}/{L.LOG}"
    files, rest = live_actions(snapshot)
    files = with_stats(files, snapshot)
    v1_columns = [n for n in ("txn", "add", "remove", "metaData", "protocol", "domainMetadata")]

    def write(d: DataFrame, n: int) -> list[str]:
        """Writes n Parquet files under a temporary name; their paths."""
        temp = f"{folder}/_tmp_{uuid.uuid4().hex}"
        d.repartition(n).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(temp)
        return [s.path for s in storage.walk(temp) if s.name.endswith(".parquet")]

    def move(paths: list[str], names: list[str]) -> None:
        for p, n in zip(paths, names, strict=True):
            if storage.head(n):
                storage.delete(n)
            storage.rename(p, n)
        storage.delete(paths[0].rsplit("/", 1)[0])

    if not v2:
        every = files.select(*v1_columns).unionByName(rest.select(*v1_columns), allowMissingColumns=True)
        if "stats_parsed" in files.schema["add"].dataType.names:
            every = files.select(*v1_columns).unionByName(rest.select("txn", "metaData", "protocol", "domainMetadata"), allowMissingColumns=True)
        paths = write(every, max(1, -(-files.count() // rows_a_sidecar)) if parts is None else parts)
        n = len(paths)
        names = [f"{folder}/{version:020d}.checkpoint.parquet"] if n == 1 else [f"{folder}/{version:020d}.checkpoint.{i:010d}.{n:010d}.parquet" for i in range(1, n + 1)]
        move(paths, names)
        size = snapshot.spark.read.parquet(*names).count()
        write_hint(snapshot, {"version": version, "size": size, **({"parts": n} if n > 1 else {})})
        return size

    side: list[dict] = []
    count = files.count()
    if sidecars and count:
        paths = write(files.select("add", "remove"), max(1, -(-count // rows_a_sidecar)))
        targets = [f"{folder}/{L.SIDECARS}/{uuid.uuid4()}.parquet" for _ in paths]
        move(paths, targets)
        for t in targets:
            s = storage.head(t)
            side.append({"path": s.name, "sizeInBytes": s.size, "modificationTime": s.mtime})
    name = f"{folder}/{version:020d}.checkpoint.{uuid.uuid4()}.{'json' if as_json else 'parquet'}"
    own = rest if sidecars else files.unionByName(rest, allowMissingColumns=True)
    if as_json:
        lines = [json.dumps({"checkpointMetadata": {"version": version}})] + [json.dumps({"sidecar": s}) for s in side]
        lines += [r["j"] for r in own.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
        storage.put(name, "\n".join(lines).encode() + b"\n")
    else:
        shape = {f.name: f.dataType for f in L.ACTIONS}
        extra = [(None, {"version": version, "tags": None})] + [({**s, "tags": None}, None) for s in side]
        heads = snapshot.spark.createDataFrame(extra, T.StructType([T.StructField("sidecar", shape["sidecar"]), T.StructField("checkpointMetadata", shape["checkpointMetadata"])]))
        columns = [*v1_columns, "sidecar", "checkpointMetadata"]
        own = own.select(*(c for c in columns if c in own.columns and c not in ("sidecar", "checkpointMetadata"))).unionByName(heads, allowMissingColumns=True)
        move(write(own, 1), [name])
    size = count + rest.count() + 1 + len(side)
    write_hint(snapshot, {"version": version, "size": size, "v2Checkpoint": {"path": name.rsplit("/", 1)[1]}})
    return size


def write_hint(snapshot: Snapshot, hint: dict) -> None:
    """The pointer to the last checkpoint, unless there is a newer one."""
    old = L.read_hint(snapshot.storage)
    if old is None or old["version"] <= hint["version"]:
        snapshot.storage.put(f"{snapshot.root}/{L.LOG}/{L.HINT}", json.dumps(hint).encode(), overwrite=True)


def checksum_of(snapshot: Snapshot, bounds: list[int] | None = None) -> Checksum:
    """The snapshot's checksum, from its file if there is one, else from the table, with bins of these lower bounds."""
    if snapshot.checksum is not None:
        return snapshot.checksum
    histogram = Histogram(bounds or boundaries())
    for r in size_histogram(snapshot.files(), histogram.bounds).collect():
        histogram.counts[r["bin"]], histogram.totals[r["bin"]] = r["files"], r["bytes"]
    txns = {r["appId"]: {k: v for k, v in r.asDict().items() if v is not None} for r in newest_of(snapshot.actions(), "txn", "appId").select("txn.*").collect()}
    ts = snapshot.timestamp() if snapshot.enabled("inCommitTimestamp", "enableInCommitTimestamps") else None
    return Checksum(snapshot.protocol.action(), snapshot.metadata.action(), sum(histogram.counts), sum(histogram.totals), ts, txns, snapshot.domains, histogram)


def write_checksum(snapshot: Snapshot, checksum: Checksum | None = None, bounds: list[int] | None = None) -> bool:
    """Writes the version's checksum file; False if it is there already. Later commits carry its bins on."""
    try:
        snapshot.storage.put(f"{snapshot.root}/{L.LOG}/{snapshot.version:020d}.crc", (checksum or checksum_of(snapshot, bounds)).data())
        return True
    except FileExistsError:
        return False
