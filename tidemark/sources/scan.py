"""Table scans: the files of a snapshot that a predicate needs, and their rows.

The file list is a DataFrame that Spark prunes by partition values and statistics. Only what survives comes to the driver,
as paths for Spark's Parquet reader, which prunes columns and row groups. Constants of files (partition values, first
row ids) come to the rows by a broadcast join on the file's path; the files are taken in blocks of bounded number so that no
broadcast grows with the table. Files with deletion vectors are read apart: their vectors come to the rows as bit maps, by a
broadcast join in blocks of bounded bytes, so that no row is shuffled. Beyond the bytes that a scan may broadcast in all, or
where the log doesn't tell a file's number of rows, the rows are anti-joined with the deleted positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.errors import SchemaError, UnsupportedFeature
from tidemark.functions import expressions as E
from tidemark.functions.skipping import Stats, never, null_safe, skipping_filter
from tidemark.functions.values import parse_value
from tidemark.operators.vectors import MAP_BYTES, MAPS_BYTES, deleted_rows, is_in, map_bytes, row_maps
from tidemark.sources.storage import decode_path

#: Metadata columns that a scan can add, and their types.
ROW_INDEX, ROW_ID, FILE, COMMIT_VERSION = "row_index", "row_id", "_file", "row_commit_version"
META = {ROW_INDEX: T.LongType(), ROW_ID: T.LongType(), FILE: T.StringType()}
FILES_AT_ONCE = 50_000


class Scan:
    """A builder: each method returns a changed copy; ``files`` and ``to_df`` run nothing by themselves but listing."""

    def __init__(self, snapshot):
        self.snapshot = snapshot
        self.columns: tuple[str, ...] | None = None
        self.predicate: E.Expr | None = None
        self.meta: tuple[str, ...] = ()
        self.exact = True
        self.stats_mode: tuple[str, tuple[str, ...]] = ("predicate", ())
        self.base: DataFrame | None = None

    def _with(self, **changes) -> Scan:
        out = Scan.__new__(Scan)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("stats_type",)} | changes
        return out

    def select(self, *columns: str) -> Scan:
        """Top-level columns in this order; metadata columns by name if the table has none of that name."""
        known = {f.name.lower() for f in self.snapshot.schema}
        if any(c == COMMIT_VERSION and c not in known for c in columns):
            raise UnsupportedFeature(f"{COMMIT_VERSION} cannot be read")
        meta = tuple(c for c in columns if c in META and c.lower() not in known)
        own = tuple(S.find(self.snapshot.schema, c).name for c in columns if c not in meta)
        return self._with(columns=own, meta=meta)

    def where(self, predicate: str | E.Expr) -> Scan:
        """Rows that satisfy WHERE text or an expression tree; several calls narrow."""
        e = E.parse_where(predicate) if isinstance(predicate, str) else predicate
        e = E.resolved(e, self.snapshot.schema)
        return self._with(predicate=e if self.predicate is None else E.And((self.predicate, e)))

    def pruned_only(self) -> Scan:
        """Only files are skipped; rows are not filtered."""
        return self._with(exact=False)

    def all_stats(self) -> Scan:
        return self._with(stats_mode=("all", ()))

    def stats_columns(self, *columns: str) -> Scan:
        return self._with(stats_mode=("columns", columns))

    def skip_stats(self) -> Scan:
        """Statistics are not read, so no file is skipped by them."""
        return self._with(stats_mode=("none", ()))

    def from_files(self, files: DataFrame) -> Scan:
        """Starts from an earlier file list of the same table instead of the whole log (its ``upto`` version and before)."""
        return self._with(base=files)

    # Files

    @property
    def partition_schema(self) -> T.StructType:
        names = self.snapshot.metadata.partition_columns
        return T.StructType([S.find(self.snapshot.schema, c) for c in names])

    def _wanted_stats(self) -> set[tuple[str, ...]] | None:
        mode, columns = self.stats_mode
        refs = self.predicate.refs() if self.predicate is not None else set()
        if mode == "none":
            return set()
        if mode == "all":
            return None
        paths = {(*S.resolve(self.snapshot.schema, E.col(c).path)[0],) for c in columns} | refs
        return {S.physical_path(self.snapshot.schema, p, self.snapshot.mapping) for p in paths}

    def files(self) -> DataFrame:
        """Live files that may hold rows of the predicate.

        Columns of the add action, ``version``, ``partition`` (typed values), ``stats_parsed``.
        """
        snap = self.snapshot
        snap.protocol.gate("S")
        return self.pruned(snap.files() if self.base is None else self._continued())

    def pruned(self, live: DataFrame) -> DataFrame:
        """Those of some files (partitionValues, stats) that may hold rows of the predicate, with typed values and statistics."""
        live, keep = self._judged(live)
        return live if keep is None else live.where(keep)

    def metrics(self) -> dict[str, int]:
        """Counters of the scan's replay, from two aggregates: what the log holds, and what the predicate leaves of it."""
        snap = self.snapshot
        others = [f.name for f in snap.actions().schema if f.name not in ("add", "remove", "cdc", "version")]
        log = snap.actions().agg(F.count("add").alias("adds_seen"), *(F.count(c).alias(c) for c in others)).first()
        removes = snap.commits.agg(F.count("remove").alias("n")).first()["n"]
        live, keep = self._judged(snap.files() if self.base is None else self._continued())
        keep = F.lit(True) if keep is None else keep
        r = live.agg(F.count("*").alias("live"), F.sum("size").alias("bytes"), F.sum(F.when(keep, 1)).alias("kept"), F.sum(F.when(keep, F.col("size"))).alias("kept_bytes")).first()
        return {
            "adds_seen": log["adds_seen"], "removes_seen": removes, "other_actions": sum(log[c] for c in others), "live_files": r["live"], "live_bytes": r["bytes"] or 0,
            "kept_files": r["kept"] or 0, "kept_bytes": r["kept_bytes"] or 0, "skipped_files": r["live"] - (r["kept"] or 0),
        }

    def _judged(self, live: DataFrame) -> tuple[DataFrame, Column | None]:
        """The files with typed values and statistics, and whether each is kept; None if all are."""
        snap = self.snapshot
        mapping = snap.mapping
        parts = [parse_value(F.element_at("partitionValues", F.lit(S.physical_path(snap.schema, (f.name,), mapping)[0])), f.dataType).alias(f.name) for f in self.partition_schema]
        live = live.withColumn("partition", F.struct(*parts) if parts else F.lit(None).cast("struct<none:string>"))
        physical_parts = {snap.physical_name(c) for c in snap.metadata.partition_columns}
        wanted = self._wanted_stats()
        kind = S.stats_schema(snap.physical_schema, physical_parts, None, wanted)
        live = live.withColumn("stats_parsed", F.from_json("stats", kind) if wanted is None or wanted else F.lit(None).cast(kind))
        if self.predicate is None:
            return live, None
        if never(self.predicate):
            return live, F.lit(False)
        keep = skipping_filter(null_safe(self.predicate), lambda p: self._stats_of(p, kind))
        return live, ~keep.eqNullSafe(F.lit(False))

    def _continued(self) -> DataFrame:
        from tidemark.operators.replay import file_actions, newest

        upto = self.base.agg(F.max("version")).first()[0]
        newer = newest(file_actions(self.snapshot.commits.where(F.col("version") > (upto if upto is not None else -1))))
        shape = [c for c in self.base.columns if c not in ("partition", "stats_parsed")]
        from tidemark.operators.replay import dv_id

        old = self.base.select(*shape).withColumn("__dv", F.coalesce(dv_id("deletionVector"), F.lit("")))
        gone = newer.select(F.col("path"), F.col("dv").alias("__dv"))
        return old.join(gone, ["path", "__dv"], "left_anti").select(*shape).unionByName(newer.where("add is not null").select("add.*", "version"))

    def _stats_of(self, path: tuple[str, ...], kind: T.StructType) -> Stats | None:
        snap = self.snapshot
        path, field = S.resolve(snap.schema, path)
        if len(path) == 1 and path[0] in snap.metadata.partition_columns:
            return Stats(None, None, None, None, exact=F.col("partition").getField(path[0]))
        phys = S.physical_path(snap.schema, path, snap.mapping)

        def at(top: str) -> Column | None:
            c, t = F.col("stats_parsed").getField(top), kind
            try:
                t = t[top].dataType
                for p in phys:
                    c, t = c.getField(p), t[p].dataType
            except KeyError:
                return None
            return c

        return Stats(at("minValues"), at("maxValues"), at("nullCount"), F.col("stats_parsed.numRecords"))

    def scan_files(self) -> Iterator[dict]:
        """The files one by one, as dictionaries."""
        for r in self.files().select("path", "size", "modificationTime", "stats", "deletionVector", "partitionValues", "baseRowId").toLocalIterator():
            yield r.asDict(True)

    # Rows

    @cached_property
    def output(self) -> T.StructType:
        s = self.snapshot.schema
        own = list(s) if self.columns is None else [S.find(s, c) for c in self.columns]
        return T.StructType([*own, *(T.StructField(m, META[m]) for m in self.meta)])

    def to_df(self) -> DataFrame:
        """The rows: logical columns, deletion vectors applied, filtered unless ``pruned_only``."""
        snap, spark = self.snapshot, self.snapshot.spark
        if ROW_ID in self.meta and not snap.enabled("rowTracking", "enableRowTracking"):
            raise UnsupportedFeature("row ids need row tracking")
        found = self.files().select("path", "partitionValues", "deletionVector", "baseRowId", records_of_marked("deletionVector").alias("records"))
        out: DataFrame | None = None
        left = MAPS_BYTES  # of what the scan may broadcast in maps
        block: list = []
        for r in found.toLocalIterator():
            block.append(r)
            if len(block) == FILES_AT_ONCE:
                (out, left), block = self._joined(out, block, left), []
        if block:
            out, _ = self._joined(out, block, left)
        if out is None:
            return spark.createDataFrame([], self.output)
        return out.select(*(f"`{f.name}`" for f in self.output))

    def _joined(self, before: DataFrame | None, block: list, left: int) -> tuple[DataFrame, int]:
        """``before`` and the rows of the files; what is left of the bytes of maps."""
        groups: list[tuple[list, str | None]] = [([r for r in block if r["deletionVector"] is None], None)]
        beyond, held = [], MAP_BYTES
        for r in block:
            if r["deletionVector"] is None:
                continue
            size = map_bytes(r["records"], r["deletionVector"]["cardinality"])
            if size > min(left, MAP_BYTES):
                beyond.append(r)
                continue
            left, held = left - size, held + size
            if held > MAP_BYTES:
                groups.append(([], "map"))
                held = size
            groups[-1][0].append(r)
        for rows, marked in [*groups, (beyond, "rows")]:
            if rows:
                part = self._read(rows, marked)
                before = part if before is None else before.unionByName(part)
        return before, left

    def _read(self, rows: list, marked: str | None) -> DataFrame:
        snap = self.snapshot
        spark, storage, mapping = snap.spark, snap.storage, snap.mapping
        partition = set(snap.metadata.partition_columns)
        refs = {p[0] for p in self.predicate.refs()} if self.predicate is not None and self.exact else set()
        asked = {f.name for f in self.output} | {S.find(snap.schema, c).name for c in refs}
        data = [f for f in snap.schema if f.name in asked and f.name not in partition]
        wanted_parts = [f for f in self.partition_schema if f.name in asked]
        phys = [S.physical(T.StructType([f]), mapping)[0] for f in data]
        row_id_name = snap.properties["rowTracking.materializedRowIdColumnName"]
        read_schema = list(phys)
        if ROW_ID in self.meta and row_id_name:
            read_schema.append(T.StructField(row_id_name, T.LongType()))
        if mapping == "id":
            spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        paths = [storage.absolute(decode_path(r["path"])) for r in rows]
        reader = spark.read.schema(T.StructType(read_schema)).option("__globPaths__", "false")
        if mapping == "id" or any(isinstance(x.dataType, T.VariantType) for x in phys):
            reader = reader.option("mergeSchema", "false")
        raw = reader.parquet(*paths)
        logical = [F.col(f"`{p.name}`").cast(S.nullable(_plain(f.dataType))).alias(f.name) if p.dataType != f.dataType else F.col(f"`{p.name}`").alias(f.name) for f, p in zip(data, phys, strict=True)]
        need_index = marked is not None or ROW_INDEX in self.meta or ROW_ID in self.meta
        constants = bool(wanted_parts) or ROW_ID in self.meta
        extra = []
        if marked is not None or constants:
            extra.append(F.col("_metadata.file_path").alias("__file"))
        if FILE in self.meta:
            extra.append(F.col("_metadata.file_path").alias(FILE))
        if need_index:
            extra.append(F.col("_metadata.row_index").alias("__row"))
        if ROW_ID in self.meta and row_id_name:
            extra.append(F.col(f"`{row_id_name}`").alias("__row_id"))
        d = raw.select(*logical, *extra)
        vectors = [(storage.uri(p), r["deletionVector"].asDict()) for p, r in zip(paths, rows, strict=True)] if marked else []
        if marked == "map":
            maps = row_maps(spark, storage.root, vectors).toDF("__file", "__at", "__words")
            d = d.join(F.broadcast(maps), "__file", "left").where(~is_in(F.col("__at"), F.col("__words"), F.col("__row"))).drop("__at", "__words")
        elif marked == "rows":
            d = d.join(deleted_rows(spark, storage.root, vectors).toDF("__file", "__row"), ["__file", "__row"], "left_anti")
        if constants:
            d = d.join(F.broadcast(self._constants(paths, rows, wanted_parts)), "__file", "left")
            d = d.withColumns({f.name: parse_value(F.col(f"__part_{i}"), f.dataType) for i, f in enumerate(wanted_parts)})
        if ROW_INDEX in self.meta:
            d = d.withColumn(ROW_INDEX, F.col("__row"))
        if ROW_ID in self.meta:
            fresh = F.col("__base") + F.col("__row")
            d = d.withColumn(ROW_ID, F.coalesce(F.col("__row_id"), fresh) if row_id_name else fresh)
        if self.predicate is not None and self.exact:
            d = d.where(self.predicate.to_column().cast("boolean"))
        return d.select(*(f"`{f.name}`" for f in self.output))

    def _constants(self, paths: list[str], rows: list, parts: list[T.StructField]) -> DataFrame:
        """One row per file: its key, first row id, and partition values as text. At most FILES_AT_ONCE rows."""
        names = [self.snapshot.physical_name(f.name) for f in parts]
        table = [(self.snapshot.storage.uri(p), r["baseRowId"], *((r["partitionValues"] or {}).get(n) for n in names)) for p, r in zip(paths, rows, strict=True)]
        shape = "__file string, __base long" + "".join(f", __part_{i} string" for i in range(len(names)))
        return self.snapshot.spark.createDataFrame(table, shape)


def records_of_marked(vector: str) -> Column:
    """The number of rows that the log tells of a file with a deletion vector."""
    return F.when(F.col(vector).isNotNull(), F.get_json_object("stats", "$.numRecords").cast("long"))


def _plain(kind: T.DataType) -> T.DataType:
    """A type without field metadata, for casts."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_plain(kind.keyType), _plain(kind.valueType), kind.valueContainsNull)
    return kind


def check_readable(have: T.StructType, want: T.StructType) -> None:
    """Refuses files whose types do not widen to the table's."""
    if not S.can_read_as(S.nullable(have), S.nullable(want)):
        raise SchemaError("the file's schema cannot be read as the table's")
