"""Command line: version, metadata, schema, files, actions, changes and rows of a table."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tidemark.table import Table


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("what", choices=["version", "metadata", "schema", "files", "actions", "changes", "read"])
    p.add_argument("path")
    p.add_argument("--version", type=int)
    p.add_argument("--columns", nargs="*", help="columns to read; row_index, row_id and _file may be among them")
    p.add_argument("--where")
    p.add_argument("--limit", type=int)
    p.add_argument("--start", type=int, default=0, help="first version of changes")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    t = Table(spark, a.path)
    if a.what == "changes":
        d = t.changes(a.start, a.version).to_df()
    else:
        s = t.snapshot(a.version)
        if a.what == "version":
            return print(s.version)
        if a.what == "metadata":
            return print(json.dumps({"protocol": s.protocol.action(), "metaData": s.metadata.action()}, indent=1))
        if a.what == "schema":
            return print(s.schema.treeString())
        scan = s.scan().where(a.where) if a.where else s.scan()
        d = s.actions() if a.what == "actions" else scan.files() if a.what == "files" else (scan.select(*a.columns) if a.columns else scan).to_df()
    for line in (d.limit(a.limit) if a.limit is not None else d).toJSON().toLocalIterator():
        print(line)
    return None


if __name__ == "__main__":
    main()
