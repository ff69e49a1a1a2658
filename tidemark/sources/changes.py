"""Change data feed: the rows that each version of a range inserted, deleted or updated.

A commit with change files is described by them alone. Otherwise added files are inserts and removed files deletes, and a
file that is removed and added in one commit under two deletion vectors gives the rows by which the vectors differ. Files are
skipped by partition values and by the statistics that adds and removes carry; vectors come to the rows as in scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.errors import ChangeFeedError
from tidemark.features import Protocol
from tidemark.functions import expressions as E
from tidemark.functions.values import parse_value
from tidemark.operators.vectors import MAP_BYTES, deleted_rows, is_in, map_bytes, row_maps
from tidemark.sources import log as L
from tidemark.sources.scan import FILES_AT_ONCE, _plain, records_of_marked
from tidemark.sources.snapshot import Metadata, Snapshot
from tidemark.sources.storage import Storage, decode_path

CHANGE, VERSION, TIME = "_change_type", "_commit_version", "_commit_timestamp"


class Changes:
    """A change feed of versions ``start`` to ``end`` (the latest if None)."""

    def __init__(self, spark: SparkSession, root: str, start: int, end: int | None = None):
        self.spark, self.storage = spark, Storage(spark, root)
        self.commits = L.change_segment(self.storage, start, end)
        self.start, self.end = start, self.commits[-1].version
        self.last = Snapshot.load(spark, root, self.end)
        first = Snapshot.load(spark, root, start)
        for s in (first, self.last):
            s.protocol.gate("C")
            if not s.properties["enableChangeDataFeed"]:
                raise ChangeFeedError(f"version {s.version} has no change feed")
        if first.schema != self.last.schema:
            raise ChangeFeedError("the schema changes in the range")
        self.columns: tuple[str, ...] | None = None
        self.predicate: E.Expr | None = None
        self.actions = L.read_commits(spark, self.commits)
        for r in self.actions.where(f"version > {start} and (metaData is not null or protocol is not null)").select("metaData", "protocol", "version").collect():
            if r["metaData"] is not None:
                m = Metadata.of(r["metaData"].asDict(True))
                if m.schema != self.last.schema:
                    raise ChangeFeedError(f"version {r['version']} changes the schema")
                if m.configuration.get("delta.enableChangeDataFeed", "false").lower() != "true":
                    raise ChangeFeedError(f"version {r['version']} ends the change feed")
            if r["protocol"] is not None:
                Protocol.of(r["protocol"].asDict(True)).gate("C")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.last.schema, T.StructField(CHANGE, T.StringType()), T.StructField(VERSION, T.LongType()), T.StructField(TIME, T.TimestampType())])

    def select(self, *columns: str) -> Changes:
        self.columns = columns
        return self

    def where(self, predicate: str | E.Expr) -> Changes:
        """A predicate on table columns."""
        e = E.parse_where(predicate) if isinstance(predicate, str) else predicate
        self.predicate = E.resolved(e, self.last.schema)
        return self

    def files(self) -> DataFrame:
        """(version, kind, path, partitionValues, dv, other, stats): files that may hold rows; ``other`` is a pair's second vector."""
        a = self.actions
        with_cdc = a.where("cdc is not null").select("version").distinct()
        cdc = a.where("cdc is not null").select("version", F.lit("cdc").alias("kind"), "cdc.path", "cdc.partitionValues", F.lit(None).cast(L._dv).alias("dv"), F.lit(None).cast(L._dv).alias("other"), F.lit(None).cast("string").alias("stats"))
        plain = a.join(with_cdc, "version", "left_anti")
        adds = plain.where("add is not null and add.dataChange").select("version", "add.path", F.struct("add.partitionValues", "add.deletionVector", "add.stats").alias("a"))
        gone = plain.where("remove is not null and remove.dataChange").select("version", "remove.path", F.struct("remove.partitionValues", "remove.deletionVector", "remove.stats").alias("r"))
        both = adds.join(gone, ["version", "path"], "full_outer")
        pair = F.col("a").isNotNull() & F.col("r").isNotNull()
        kind = F.when(pair, "pair").when(F.col("a").isNotNull(), "insert").otherwise("delete")
        values = F.coalesce("a.partitionValues", "r.partitionValues")
        dv = F.when(F.col("a").isNotNull(), F.col("a.deletionVector")).otherwise(F.col("r.deletionVector"))
        rest = both.select("version", kind.alias("kind"), "path", values.alias("partitionValues"), dv.alias("dv"), F.when(pair, F.col("r.deletionVector")).alias("other"), F.coalesce("a.stats", "r.stats").alias("stats"))
        found = cdc.unionByName(rest)
        return found if self.predicate is None else self.last.scan().where(self.predicate).pruned(found).select(*found.columns)

    def to_df(self) -> DataFrame:
        out, block = None, []
        for r in self.files().withColumn("records", F.coalesce(records_of_marked("dv"), records_of_marked("other"))).drop("stats").toLocalIterator():
            block.append(r)
            if len(block) == FILES_AT_ONCE:
                out, block = self._union(out, block), []
        if block:
            out = self._union(out, block)
        if out is None:
            out = self.spark.createDataFrame([], self.schema)
        if self.predicate is not None:
            out = out.where(self.predicate.to_column())
        return out.select(*(f"`{c}`" for c in (self.columns or self.schema.names)))

    def _times(self) -> list[tuple[int, int]]:
        history = self.last.history()
        return [(f.version, history.commit_timestamp(f.version)) for f in self.commits]

    def _union(self, out: DataFrame | None, block: list) -> DataFrame:
        for kind in ("cdc", "insert", "delete", "pair"):
            rows = [r for r in block if r["kind"] == kind]
            if rows:
                part = self._read(kind, rows)
                out = part if out is None else out.unionByName(part)
        return out

    def _read(self, kind: str, rows: list) -> DataFrame:
        snap, spark = self.last, self.spark
        mapping, partition = snap.mapping, set(snap.metadata.partition_columns)
        data = [f for f in snap.schema if f.name not in partition]
        phys = S.physical(T.StructType(data), mapping) if data else T.StructType([])
        if mapping == "id":
            spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        shape = T.StructType([*phys, T.StructField(CHANGE, T.StringType())]) if kind == "cdc" else phys
        paths = [self.storage.absolute(decode_path(r["path"])) for r in rows]
        raw = spark.read.schema(shape).option("__globPaths__", "false").parquet(*sorted(set(paths)))
        logical = [F.col(f"`{p.name}`").cast(S.nullable(_plain(f.dataType))).alias(f.name) for f, p in zip(data, phys, strict=True)]
        d = raw.select(*logical, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *([CHANGE] if kind == "cdc" else []))
        times = dict(self._times())
        keys = [self.storage.uri(p) for p in paths]
        names = [snap.physical_name(c) for c in snap.metadata.partition_columns]
        table = [(k, r["version"], times[r["version"]], *((r["partitionValues"] or {}).get(n) for n in names)) for k, r in zip(keys, rows, strict=True)]
        const = spark.createDataFrame(table, "__file string, __version long, __time long" + "".join(f", __part_{i} string" for i in range(len(names))))
        d = d.join(F.broadcast(const), "__file")
        tagged = lambda vs: [(f"{v}:{k}", dv) for k, v, dv in vs]
        at = F.concat(F.col("__version").cast("string"), F.lit(":"), F.col("__file"))
        a = [(k, r["version"], r["dv"].asDict()) for k, r in zip(keys, rows, strict=True) if r["dv"] is not None]
        b = [(k, r["version"], r["other"].asDict()) for k, r in zip(keys, rows, strict=True) if r["other"] is not None]
        size = sum(map_bytes(r["records"], v["cardinality"]) for r in rows for v in (r["dv"], r["other"]) if v is not None)

        def among(d: DataFrame, vectors: list, name: str) -> DataFrame:
            """The rows with whether the vectors hold them."""
            if not vectors:
                return d.withColumn(name, F.lit(False))
            maps = row_maps(spark, self.storage.root, tagged(vectors)).toDF("__at", "__chunks", "__words")
            return d.join(F.broadcast(maps), "__at", "left").withColumn(name, is_in(F.col("__chunks"), F.col("__words"), F.col("__row"))).drop("__chunks", "__words")

        if (a or b) and size <= MAP_BYTES:
            d = among(among(d.withColumn("__at", at), a, "__gone"), b, "__before")
            if kind == "pair":
                d = d.where("__gone <> __before").withColumn(CHANGE, F.when(F.col("__gone"), F.lit("delete")).otherwise(F.lit("insert")))
            else:
                d = d.where("not __gone")
                d = d if kind == "cdc" else d.withColumn(CHANGE, F.lit(kind))
        elif kind == "pair":
            none = spark.createDataFrame([], "file string, row long")
            now = deleted_rows(spark, self.storage.root, tagged(a)) if a else none
            before = deleted_rows(spark, self.storage.root, tagged(b)) if b else none
            changed = now.join(before, ["file", "row"], "left_anti").withColumn(CHANGE, F.lit("delete")).unionByName(before.join(now, ["file", "row"], "left_anti").withColumn(CHANGE, F.lit("insert")))
            d = d.withColumn("__at", at).join(changed.withColumnRenamed("file", "__at").withColumnRenamed("row", "__row"), ["__at", "__row"])
        else:
            if a:
                gone = deleted_rows(spark, self.storage.root, tagged(a)).toDF("__at", "__row")
                d = d.withColumn("__at", at).join(gone, ["__at", "__row"], "left_anti")
            if kind != "cdc":
                d = d.withColumn(CHANGE, F.lit(kind))
        parts = {f: parse_value(F.col(f"__part_{i}"), S.find(snap.schema, f).dataType) for i, f in enumerate(snap.metadata.partition_columns)}
        d = d.withColumns({**parts, VERSION: F.col("__version"), TIME: F.timestamp_millis(F.col("__time"))})
        return d.select(*(f"`{c}`" for c in self.schema.names))
