"""Transactions: what a version adds, removes and sets, committed as a whole or not at all."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.errors import SchemaError, TransactionError
from tidemark.functions import expressions as E
from tidemark.functions.values import serialize_value, values_of_path
from tidemark.operators.stats import file_stats
from tidemark.operators.vectors import deleted_rows, encoded, file_key, read_vector, write_encoded, write_vectors
from tidemark.plans.commit import Committer, FileCommitter
from tidemark.sources.log import LOG, LogFile
from tidemark.sources.snapshot import Metadata, Snapshot
from tidemark.sources.storage import decode_path, encode_path, same_path

ENGINE = "tidemark"


@dataclass(frozen=True)
class Committed:
    """A commit that went through. ``since_checkpoint``: commits that a new checkpoint would save readers from."""

    version: int
    timestamp: int
    actions: list[dict]
    since_checkpoint: int


class Transaction:
    """A change to an existing table; the base snapshot's version + 1 is what it commits."""

    def __init__(self, snapshot: Snapshot, committer: Committer | None = None, operation: str = "WRITE"):
        snapshot.protocol.gate("W")
        managed = bool({"catalogManaged", "catalogOwned-preview"} & snapshot.protocol.features())
        self.base, self.committer, self.operation = snapshot, committer or FileCommitter(), operation
        if managed != self.committer.catalog_managed:
            raise TransactionError("the table and the committer must both be managed by a catalog, or neither")
        self.data_change, self.blind, self.engine_info = True, False, ENGINE
        self.parameters: dict[str, str] = {}
        self.more_info: dict[str, str] = {}
        self.adds: list[dict] = []
        self.removes: list[dict] = []
        self.pairs: list[tuple[dict, dict]] = []
        self.cdc: list[dict] = []
        self.txns: dict[str, int] = {}
        self.domains: dict[str, dict] = {}
        self.metadata: Metadata | None = None
        self.protocol = None
        self.done = False

    # What to do

    def no_data_change(self) -> Transaction:
        """Files are only rearranged; change feeds leave the commit out."""
        self.data_change = False
        return self

    def blind_append(self) -> Transaction:
        self.blind = True
        return self

    def transaction_id(self, app: str, version: int) -> Transaction:
        """Marks what an application has written, for writes that happen once."""
        if app in self.txns:
            raise TransactionError(f"{app} is set twice")
        self.txns[app] = version
        return self

    def set_domain(self, domain: str, configuration: str) -> Transaction:
        return self._domain(domain, {"domain": domain, "configuration": configuration, "removed": False})

    def remove_domain(self, domain: str) -> Transaction:
        """A tombstone with the last configuration; nothing if there is none."""
        old = self.base.domains.get(domain)
        return self._domain(domain, {"domain": domain, "configuration": old or "", "removed": True}, write=old is not None)

    def _domain(self, domain: str, action: dict, write: bool = True) -> Transaction:
        if domain.startswith("delta."):
            raise TransactionError(f"{domain} is a system domain")
        if "domainMetadata" not in self.base.protocol.features():
            raise TransactionError("the table does not support domain metadata")
        if domain in self.domains:
            raise TransactionError(f"{domain} is set twice")
        if write:
            self.domains[domain] = action
        return self

    def append(self, rows: DataFrame) -> Transaction:
        """Writes rows as data files of this transaction."""
        self.adds += write_files(self.base, rows, self.data_change)
        return self

    def stats_schema(self) -> T.StructType:
        """The statistics that ``add_files`` should bring, by physical names, as a writer outside would gather them."""
        return stats_kind(self.base)[1]

    def info(self, **fields: str) -> Transaction:
        """More fields of the commit's own description, beside those that every commit has."""
        self.more_info |= fields
        return self

    def add_files(self, adds: Iterable[dict]) -> Transaction:
        """Files that are written already: path, partitionValues, size, modificationTime, stats."""
        for a in adds:
            missing = {"path", "partitionValues", "size", "modificationTime"} - a.keys()
            if missing:
                raise TransactionError(f"an added file lacks {sorted(missing)}")
            self.adds.append({**a, "dataChange": self.data_change})
        return self

    def add_changes(self, rows: DataFrame) -> Transaction:
        """Change rows with ``_change_type``, as files of the change feed."""
        for a in write_files(self.base, rows, False, extra=T.StructType([T.StructField("_change_type", T.StringType())]), folder="_change_data"):
            self.cdc.append({"path": a["path"], "partitionValues": a["partitionValues"], "size": a["size"], "dataChange": False})
        return self

    def remove_files(self, files: DataFrame) -> Transaction:
        """Tombstones for files of a scan's file list."""
        now = int(time.time() * 1000)
        stats = F.coalesce("stats", F.to_json("stats_parsed")) if "stats_parsed" in files.columns else F.col("stats")
        for r in files.select("path", "partitionValues", "size", stats.alias("stats"), "tags", "deletionVector", "baseRowId", "defaultRowCommitVersion").toLocalIterator():
            self.removes.append(_slim({**r.asDict(True), "deletionTimestamp": now, "dataChange": self.data_change, "extendedFileMetadata": True}))
        return self

    def delete_rows(self, rows: dict[str, Iterable[int]]) -> Transaction:
        """Deletion vectors for rows of files by path; rows that are deleted already stay so."""
        live = self._files_by_path(set(rows))
        sets = {}
        for path, which in rows.items():
            old = live[path]["deletionVector"]
            sets[path] = set(int(x) for x in which) | (set(read_vector(self.base.storage, old).tolist()) if old else set())
        return self.update_vectors(write_vectors(self.base.storage, sets))

    def delete_where(self, predicate: str | E.Expr) -> Transaction:
        """Deletion vectors for all rows of the predicate.

        Positions, those deleted before among them, are encoded by the executors; the driver writes the vectors as they come.
        """
        storage, scan = self.base.storage, self.base.scan().where(predicate)
        found = scan.select("_file", "row_index").to_df().select(F.col("_file").alias("file"), F.col("row_index").alias("row"))
        known, old = {}, []
        for r in scan.files().select("path", "deletionVector").toLocalIterator():
            file = storage.uri(storage.absolute(decode_path(r["path"])))
            known[file] = r["path"]
            if r["deletionVector"] is not None:
                old.append((file, r["deletionVector"].asDict()))
        if old:
            touched = found.select("file").distinct()
            found = found.unionAll(deleted_rows(self.base.spark, self.base.root, old).join(touched, "file", "left_semi"))
        vectors = ((known[r["file"]], bytes(r["vector"]), r["n"]) for r in encoded(found).toLocalIterator())
        return self.update_vectors(write_encoded(storage, vectors))

    def _files_by_path(self, paths: set[str]) -> dict[str, dict]:
        wanted = self.base.spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
        live = {r["path"]: r.asDict(True) for r in self.base.files().join(wanted, "path").collect()}
        if missing := paths - live.keys():
            raise TransactionError(f"no live file {sorted(missing)[0]}")
        return live

    def update_vectors(self, vectors: dict[str, dict]) -> Transaction:
        """New deletion vectors for live files by path: a remove and an add of each."""
        if "deletionVectors" not in self.base.protocol.features():
            raise TransactionError("the table does not support deletion vectors")
        now = int(time.time() * 1000)
        for path, old in sorted(self._files_by_path(set(vectors)).items()):
            old.pop("version", None)
            stats = json.loads(old["stats"]) if old.get("stats") else {}
            new = {**old, "deletionVector": vectors[path], "dataChange": self.data_change, "stats": json.dumps({**stats, "tightBounds": False}) if stats else None}
            gone = {k: v for k, v in old.items() if k not in ("modificationTime", "clusteringProvider")}
            self.pairs.append((_slim({**gone, "deletionTimestamp": now, "dataChange": self.data_change, "extendedFileMetadata": True}), _slim(new)))
        return self

    def set_metadata(self, metadata: Metadata) -> Transaction:
        self.metadata = metadata
        return self

    # Committing

    def _check(self) -> None:
        snap = self.base
        if self.done:
            raise TransactionError("the transaction has been committed")
        if self.blind and (not self.adds or self.removes or self.pairs or self.cdc or not self.data_change):
            raise TransactionError("a blind append adds files and does nothing else")
        if self.data_change and snap.properties["appendOnly"] and "appendOnly" in snap.protocol.features() and (self.removes or self.pairs):
            raise TransactionError("the table is append only")
        if self.data_change and snap.enabled("changeDataFeed", "enableChangeDataFeed") and self.adds and self.removes and not self.cdc:
            raise TransactionError("adding and removing data at once needs change files in a table with a change feed")
        clustering = snap.clustering_columns(physical=True) if "clustering" in snap.protocol.features() else None
        for a in self.adds:
            stats = json.loads(a["stats"]) if a.get("stats") else {}
            for path in clustering or ():
                missing = [top for top in ("nullCount", "minValues", "maxValues") if not _has(stats.get(top), path)]
                if missing and not (missing != ["nullCount"] and _has(stats.get("nullCount"), path) and _at(stats["nullCount"], path) == stats.get("numRecords")):
                    raise TransactionError(f"file {a['path']} lacks statistics of clustering column {'.'.join(path)}")

    def _tracked(self, adds: list[dict], version: int) -> list[dict]:
        """First row ids above the table's highest, in order of the files."""
        if "rowTracking" not in self.base.protocol.features() or self.base.properties["rowTrackingSuspended"]:
            return adds
        mark, out = self.base.row_id_high_water_mark(), []
        for a in adds:
            n = json.loads(a["stats"]).get("numRecords") if a.get("stats") else None
            if n is None:
                raise TransactionError("row tracking needs the number of records of each file")
            out.append({**a, "baseRowId": mark + 1, "defaultRowCommitVersion": version})
            mark += n
        if out:
            self.domains["delta.rowTracking"] = {"domain": "delta.rowTracking", "configuration": json.dumps({"rowIdHighWaterMark": mark}), "removed": False}
        return out

    def actions(self, version: int) -> tuple[list[dict], int]:
        now = int(time.time() * 1000)
        info = {**self.more_info, "timestamp": now, "operation": self.operation, "operationParameters": self.parameters, "isBlindAppend": self.blind, "engineInfo": self.engine_info, "txnId": str(uuid.uuid4())}
        if self.base.enabled("inCommitTimestamp", "enableInCommitTimestamps"):
            now = max(now, self.base.timestamp() + 1)
            info = {"inCommitTimestamp": now, **info}
        adds = self._tracked(self.adds, version)
        out: list[dict] = [{"commitInfo": info}]
        if self.protocol is not None:
            out.append({"protocol": self.protocol.action()})
        if self.metadata is not None:
            out.append({"metaData": self.metadata.action()})
        out += [{"add": a} for a in adds]
        out += [{"txn": {"appId": k, "version": v, "lastUpdated": now}} for k, v in self.txns.items()]
        out += [{"domainMetadata": d} for d in self.domains.values()]
        out += [{"remove": r} for r in self.removes]
        for gone, new in self.pairs:
            out += [{"remove": gone}, {"add": new}]
        return out + [{"cdc": c} for c in self.cdc], now

    def commit(self) -> Committed:
        """Puts the next version into the log; CommitConflict if another writer was first."""
        self._check()
        version = self.base.version + 1
        actions, now = self.actions(version)
        self.committer.commit(self.base.storage, version, actions)
        self.done = True
        self._carry(version, actions)
        return Committed(version, now, actions, version - (self.base.segment.checkpoint_version if self.base.segment.checkpoint else -1))

    def _carry(self, version: int, actions: list[dict]) -> None:
        """The checksum of the new version, from that of the base if it has one; the commit stands whether or not this works."""
        if self.committer.catalog_managed or self.base.checksum is None:
            return
        try:
            self.base.storage.put(f"{self.base.root}/{LOG}/{version:020d}.crc", self.base.checksum.carried(actions).data())
        except Exception:  # readers take the log where there is no checksum
            pass

    def snapshot_after(self, done: Committed) -> Snapshot:
        """The committed version, from the base and the commit alone where storage has it under its usual name."""
        tail: Sequence[LogFile] = ()
        if self.committer.catalog_managed and done.version:
            tail = self.committer.catalog.tail(self.committer.table, self.base.root)
            return Snapshot.load(self.base.spark, self.base.root, tail=tail, max_version=done.version)
        return self.base.refreshed(done.version)


def _slim(action: dict) -> dict:
    return {k: v for k, v in action.items() if v is not None}


def _has(stats: dict | None, path: tuple[str, ...]) -> bool:
    for p in path:
        if not isinstance(stats, dict) or p not in stats:
            return False
        stats = stats[p]
    return True


def _at(stats: dict, path: tuple[str, ...]):
    for p in path:
        stats = stats[p]
    return stats


def write_files(snapshot: Snapshot, rows: DataFrame, data_change: bool = True, extra: T.StructType | None = None, folder: str | None = None) -> list[dict]:
    """Writes rows as Parquet files below the table's root and returns their add actions.

    Columns are matched by name. Partition columns go into folder names (and into the files only if the table says so);
    rows are clustered by them first, so that each partition has few files. NOT NULL columns are checked while writing.
    """
    spark, schema, mapping = snapshot.spark, snapshot.schema, snapshot.mapping
    have = {f.name.lower(): f for f in rows.schema}
    wanted = [*schema, *(extra or ())]
    unknown = have.keys() - {f.name.lower() for f in wanted}
    if unknown:
        raise SchemaError(f"the table has no columns {sorted(unknown)}")
    partition = list(snapshot.metadata.partition_columns)
    phys = S.physical(schema, mapping)
    names = dict(zip(schema.names, phys.names, strict=True))
    cols, parts = [], []
    for f in wanted:
        own = have.get(f.name.lower())
        if own is None:
            if not f.nullable:
                raise SchemaError(f"column {f.name} must not be null")
            c = F.lit(None).cast(f.dataType)
        else:
            if not S.widens(own.dataType, f.dataType) and not S.can_read_as(S.nullable(own.dataType), S.nullable(_bare(f.dataType))) and not isinstance(own.dataType, T.NullType):
                raise SchemaError(f"column {f.name} is {f.dataType.simpleString()}, not {own.dataType.simpleString()}")
            c = F.col(f"`{own.name}`")
            if not f.nullable:
                c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"column {f.name} must not be null")))
        name = names.get(f.name, f.name)
        kind = next((p.dataType for p in phys if p.name == name), f.dataType)
        if f.name in partition:
            parts.append((f.name, name, serialize_value(c, f.dataType)))
            if "materializePartitionColumns" not in snapshot.protocol.features():
                continue
        if own is None or _bare(own.dataType) != _bare(kind):
            c = c.cast(_bare(kind))
        cols.append(c.alias(name, metadata={"parquet.field.id": f.metadata["delta.columnMapping.id"]} if mapping == "id" and f.name in names else {}))
    stage = uuid.uuid4().hex
    stage = f"{folder}/{stage}" if folder else stage[:2] + "/" + stage if mapping != "none" else f"part-{stage}"
    target = f"{snapshot.root}/{stage}"
    keys = [f"__p{i}" for i in range(len(parts))]
    d = rows.select(*cols, *(v.alias(k) for k, (_, _, v) in zip(keys, parts, strict=True)))
    if mapping == "id":  # the ids of nested fields, too
        ids = {f.name: f for f in phys}
        d = d.to(T.StructType([ids.get(f.name, f) for f in d.schema]))
    if keys:
        d = d.repartition(*keys)
    had = spark.conf.get("spark.sql.parquet.fieldId.write.enabled", None)
    if mapping == "id":
        spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
    writer = d.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    (writer.partitionBy(*keys) if keys else writer).parquet(target)
    if mapping == "id":
        spark.conf.set("spark.sql.parquet.fieldId.write.enabled", had) if had is not None else spark.conf.unset("spark.sql.parquet.fieldId.write.enabled")
    files = [s for s in snapshot.storage.walk(target) if s.name.endswith(".parquet")]
    if not files:
        return []
    data_schema, kind = stats_kind(snapshot)
    scan = spark.read.schema(data_schema).option("__globPaths__", "false").parquet(*(s.path for s in files))
    stats = {same_path(r["file"]): r for r in file_stats(scan, kind).withColumn("file", file_key(F.col("file"))).toLocalIterator()}
    out = []
    for s in files:
        relative = same_path(s.path).removeprefix(same_path(snapshot.root) + "/")
        found = values_of_path(relative, keys)
        r = stats.get(same_path(s.path))
        if r is None:
            continue  # a file without rows
        out.append({"path": encode_path(relative), "partitionValues": {p: found[k] for k, (_, p, _) in zip(keys, parts, strict=True)}, "size": s.size, "modificationTime": s.mtime, "dataChange": data_change, "stats": r["stats"]})
    return out


def stats_kind(snapshot: Snapshot) -> tuple[T.StructType, T.StructType]:
    """The columns that data files of the table hold, and the statistics that they need, both by physical names."""
    schema, mapping, features = snapshot.schema, snapshot.mapping, snapshot.protocol.features()
    parts = {snapshot.physical_name(c) for c in snapshot.metadata.partition_columns}
    data_schema = T.StructType([T.StructField(f.name, f.dataType) for f in S.physical(schema, mapping) if f.name not in parts or "materializePartitionColumns" in features])
    clustering = set(snapshot.clustering_columns(physical=True) or ()) if "clustering" in features else set()
    only = snapshot.properties["dataSkippingStatsColumns"]
    paths = None
    if only is not None:
        listed = [S.physical_path(schema, S.resolve(schema, E.col(c).path)[0], mapping) for c in only]
        paths = {p for p, _ in S.leaves(data_schema) if any(p[: len(x)] == x for x in listed)} | clustering
    limit = snapshot.properties["dataSkippingNumIndexedCols"]
    return data_schema, S.stats_schema(data_schema, parts, None if limit < 0 else limit, paths, clustering)


def _bare(kind: T.DataType) -> T.DataType:
    from tidemark.sources.scan import _plain

    return _plain(kind)
