"""Partition values: typed columns to strings of the log and back, and the folders they name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaError

#: Fixed values of the folder layout.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = set("\"#%'*/:=?\\\x7f{[]^") | {chr(i) for i in range(1, 32)}


def parse_value(value: Column, kind: T.DataType) -> Column:
    """A partition string as its type; the empty string is null, a malformed one an error."""
    v = F.when(value != "", value)
    if isinstance(kind, T.StringType):
        return v
    if isinstance(kind, T.BinaryType):
        return F.encode(v, "UTF-8")
    if isinstance(kind, T.BooleanType):
        return F.lower(v).cast("boolean")
    if isinstance(kind, T.DateType):
        return F.to_date(v, "yyyy-MM-dd")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise SchemaError(f"{kind.simpleString()} cannot partition a table")
    return v.cast(kind)


def serialize_value(value: Column, kind: T.DataType) -> Column:
    """A typed partition value as a string; null and empty ones are null."""
    if isinstance(kind, T.TimestampType):
        text = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(kind, T.TimestampNTZType):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.BinaryType):
        text = F.decode(value, "UTF-8")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise SchemaError(f"{kind.simpleString()} cannot partition a table")
    else:
        text = value.cast("string")
    return F.when(text != "", text)


def escape_folder(value: str | None) -> str:
    """A value as a folder name."""
    if value is None or value == "":
        return NULL_FOLDER
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


def unescape_folder(name: str) -> str | None:
    if name == NULL_FOLDER:
        return None
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def partition_folder(columns: Sequence[str], values: dict[str, str | None]) -> str:
    return "".join(f"{escape_folder(c)}={escape_folder(values[c])}/" for c in columns)


def values_of_path(path: str, columns: Sequence[str]) -> dict[str, str | None]:
    """The values in the folders of a decoded path."""
    found = {}
    for part in path.split("/"):
        name, eq, value = part.partition("=")
        if eq and unescape_folder(name) in columns:
            found[unescape_folder(name)] = unescape_folder(value)
    return {c: found.get(c) for c in columns}


def map_to_struct(values: Column, schema: T.StructType) -> Column:
    """A map of strings as a struct, every key parsed as a partition value; missing keys are null."""
    return F.struct(*(parse_value(F.element_at(values, F.lit(f.name)), f.dataType).alias(f.name) for f in schema))
