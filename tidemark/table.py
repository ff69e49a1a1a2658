"""The short way in: open, create, read, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.plans.checkpoint import checkpoint, write_checksum
from tidemark.plans.commit import Committer
from tidemark.plans.tables import AlterTable, create_table
from tidemark.plans.transaction import Committed, Transaction
from tidemark.sources.changes import Changes
from tidemark.sources.scan import Scan
from tidemark.sources.snapshot import Snapshot


class Table:
    """A table at a path."""

    def __init__(self, spark: SparkSession, root: str, committer: Committer | None = None):
        self.spark, self.root, self.committer = spark, root, committer

    @staticmethod
    def create(spark: SparkSession, root: str, schema: T.StructType | None = None, data: DataFrame | None = None, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), properties: dict[str, str] | None = None, committer: Committer | None = None) -> Table:
        """A new table with the schema, or with that of ``data``, whose rows it then holds."""
        if schema is None:
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in data.schema])
        create_table(spark, root, schema, partition_by, cluster_by, properties, data, committer)
        return Table(spark, root, committer)

    def snapshot(self, version: int | None = None, timestamp: int | None = None) -> Snapshot:
        c = self.committer
        if c is not None and c.catalog_managed:
            latest, _ = c.catalog.commits(c.table)
            tail = [f for f in c.catalog.tail(c.table, self.root) if version is None or f.version <= version]
            return Snapshot.load(self.spark, self.root, None if version is None else version, timestamp, tail, latest if version is None else version)
        return Snapshot.load(self.spark, self.root, version, timestamp)

    def scan(self, version: int | None = None, timestamp: int | None = None) -> Scan:
        return self.snapshot(version, timestamp).scan()

    def to_df(self, version: int | None = None, timestamp: int | None = None) -> DataFrame:
        return self.scan(version, timestamp).to_df()

    def transaction(self, operation: str = "WRITE") -> Transaction:
        return Transaction(self.snapshot(), self.committer, operation)

    def append(self, rows: DataFrame) -> Committed:
        return self.transaction().append(rows).blind_append().commit()

    def delete(self, predicate: str) -> Committed:
        """Deletes rows by deletion vectors."""
        return self.transaction("DELETE").delete_where(predicate).commit()

    def alter(self) -> AlterTable:
        return AlterTable(self.snapshot(), self.committer)

    def changes(self, start: int, end: int | None = None) -> Changes:
        return Changes(self.spark, self.root, start, end)

    def checkpoint(self, **options) -> int:
        return checkpoint(self.snapshot(), **options)

    def write_checksum(self, bounds: list[int] | None = None) -> bool:
        return write_checksum(self.snapshot(), bounds=bounds)
