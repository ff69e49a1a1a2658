"""Table schemas: validation, physical names, compatibility, differences, and the schema of statistics."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidemark.errors import SchemaError

#: Fixed keys of field metadata.
FIELD_ID, PHYSICAL = "delta.columnMapping.id", "delta.columnMapping.physicalName"
INVARIANTS = "delta.invariants"
FORBIDDEN = set(" ,;{}()\n\t=")


def parse(schema_json: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(schema_json))


def validate(schema: T.StructType, mapped: bool) -> None:
    """Not empty, no names twice (in any case), no forbidden characters unless names are mapped, no invariants."""
    if not schema.fields:
        raise SchemaError("a table needs columns")

    def check(s: T.StructType, at: str) -> None:
        seen = set()
        for f in s:
            if f.name.lower() in seen:
                raise SchemaError(f"column {at}{f.name} stands twice")
            seen.add(f.name.lower())
            if not f.name or (not mapped and set(f.name) & FORBIDDEN):
                raise SchemaError(f"invalid column name {at}{f.name!r}")
            if INVARIANTS in (f.metadata or {}):
                raise SchemaError(f"invariant on {at}{f.name}")
            for inner in structs(f.dataType):
                check(inner, f"{at}{f.name}.")

    check(schema, "")


def structs(kind: T.DataType) -> Iterator[T.StructType]:
    """The outermost structs within a type."""
    if isinstance(kind, T.StructType):
        yield kind
    elif isinstance(kind, T.ArrayType):
        yield from structs(kind.elementType)
    elif isinstance(kind, T.MapType):
        yield from structs(kind.keyType)
        yield from structs(kind.valueType)


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.StructField]]:
    """Fields that are no structs, by path."""
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, (*path, f.name))
        else:
            yield (*path, f.name), f


def _mapped(kind: T.DataType, change) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([change(T.StructField(f.name, _mapped(f.dataType, change), f.nullable, dict(f.metadata or {}))) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_mapped(kind.elementType, change), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_mapped(kind.keyType, change), _mapped(kind.valueType, change), kind.valueContainsNull)
    return kind


def physical(schema: T.StructType, mode: str) -> T.StructType:
    """The schema of the data files; all fields may be null there, and ids are set for matching by id."""

    def change(f: T.StructField) -> T.StructField:
        meta = {}
        if mode == "id":
            meta["parquet.field.id"] = f.metadata[FIELD_ID]
        return T.StructField(f.metadata.get(PHYSICAL, f.name) if mode != "none" else f.name, f.dataType, True, meta)

    return _mapped(nullable(schema), change)


def nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def assign_mapping(schema: T.StructType, last: int = 0) -> tuple[T.StructType, int]:
    """Ids above ``last`` and random physical names for the fields without one; the greatest id."""
    most = [max([last, *(f.metadata[FIELD_ID] for f in every(schema) if FIELD_ID in (f.metadata or {}))])]

    def change(f: T.StructField) -> T.StructField:
        meta = dict(f.metadata or {})
        if FIELD_ID not in meta:
            most[0] += 1
            meta |= {FIELD_ID: most[0], PHYSICAL: meta.get(PHYSICAL, f"col-{uuid.uuid4()}")}
        return T.StructField(f.name, f.dataType, f.nullable, meta)

    return _mapped(schema, change), most[0]


def every(schema: T.StructType) -> Iterator[T.StructField]:
    for f in schema:
        yield f
        for s in structs(f.dataType):
            yield from every(s)


def physical_path(schema: T.StructType, path: tuple[str, ...], mode: str) -> tuple[str, ...]:
    out, kind = [], schema
    for name in path:
        f = find(kind, name)
        out.append(f.metadata.get(PHYSICAL, f.name) if mode != "none" else f.name)
        kind = f.dataType
    return tuple(out)


def find(schema: T.DataType, name: str) -> T.StructField:
    """A field by its name, whatever the case."""
    if isinstance(schema, T.StructType):
        for f in schema:
            if f.name == name:
                return f
        for f in schema:
            if f.name.lower() == name.lower():
                return f
    raise SchemaError(f"unknown column {name}")


def resolve(schema: T.StructType, path: tuple[str, ...]) -> tuple[tuple[str, ...], T.StructField]:
    """A path in the schema's own spelling, and its field."""
    out, kind, f = [], schema, None
    for name in path:
        f = find(kind, name)
        out.append(f.name)
        kind = f.dataType
    return tuple(out), f


#: To what a type may widen on reading.
WIDER = {"byte": ("short", "integer", "long", "double"), "short": ("integer", "long", "double"), "integer": ("long", "double"), "float": ("double",), "date": ("timestamp_ntz",), "timestamp": ("timestamp_ntz",), "timestamp_ntz": ("timestamp",)}
WHOLE = {"byte": 3, "short": 5, "integer": 10, "long": 20}


def widens(old: T.DataType, new: T.DataType) -> bool:
    if old == new:
        return True
    a, b = old.typeName(), new.typeName()
    if isinstance(new, T.DecimalType):
        if isinstance(old, T.DecimalType):
            return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
        return a in WHOLE and new.precision - new.scale >= min(WHOLE[a], 10 if a != "long" else 20)
    return b in WIDER.get(a, ())


def can_read_as(old: T.DataType, new: T.DataType, old_null: bool = True, new_null: bool = True) -> bool:
    """Whether data of the old type can be read as the new one: nulls and types only widen, new fields are nullable."""
    if old_null and not new_null:
        return False
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        have = {f.name: f for f in old}
        lower = {f.name.lower() for f in old}
        for f in new:
            if f.name in have:
                if not can_read_as(have[f.name].dataType, f.dataType, have[f.name].nullable, f.nullable):
                    return False
            elif f.name.lower() in lower or not f.nullable:
                return False
        return True
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return can_read_as(old.elementType, new.elementType, old.containsNull, new.containsNull)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return can_read_as(old.keyType, new.keyType, False, False) and can_read_as(old.valueType, new.valueType, old.valueContainsNull, new.valueContainsNull)
    return widens(old, new)


@dataclass
class SchemaDiff:
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)
    retyped: list[str] = field(default_factory=list)
    nullability: list[str] = field(default_factory=list)


def diff(old: T.StructType, new: T.StructType) -> SchemaDiff:
    """Field changes; fields are the same if their ids are, or their names where there are none."""
    out = SchemaDiff()

    def walk(a: T.StructType, b: T.StructType, at: str) -> None:
        key = lambda f: (f.metadata or {}).get(FIELD_ID, f.name.lower())
        x, y = {key(f): f for f in a}, {key(f): f for f in b}
        out.removed += [at + f.name for k, f in x.items() if k not in y]
        out.added += [at + f.name for k, f in y.items() if k not in x]
        for k in x.keys() & y.keys():
            f, g = x[k], y[k]
            if f.name != g.name:
                out.renamed.append((at + f.name, at + g.name))
            if f.nullable != g.nullable:
                out.nullability.append(at + g.name)
            if isinstance(f.dataType, T.StructType) and isinstance(g.dataType, T.StructType):
                walk(f.dataType, g.dataType, at + g.name + ".")
            elif f.dataType != g.dataType:
                out.retyped.append(at + g.name)

    walk(old, new, "")
    return out


def stats_schema(phys: T.StructType, partition: set[str], limit: int | None = 32, only: set[tuple[str, ...]] | None = None, forced: set[tuple[str, ...]] = frozenset()) -> T.StructType:
    """numRecords, nullCount, minValues, maxValues and tightBounds for the first ``limit`` leaf columns, or for ``only``."""
    count = [0]

    def walk(s: T.StructType, path: tuple[str, ...], ranged: bool) -> T.StructType | None:
        out = []
        for f in s:
            p = (*path, f.name)
            if len(p) == 1 and f.name in partition:
                continue
            if isinstance(f.dataType, T.StructType):
                inner = walk(f.dataType, p, ranged)
                if inner is not None:
                    out.append(T.StructField(f.name, inner))
                continue
            count[0] += 1
            wanted = (p in only) if only is not None else (p in forced or limit is None or count[0] <= limit)
            if not wanted:
                continue
            if not ranged:
                out.append(T.StructField(f.name, T.LongType()))
            elif has_range(f.dataType):
                out.append(T.StructField(f.name, f.dataType))
        return T.StructType(out) if out else None

    nulls = walk(phys, (), False)
    count[0] = 0
    ranges = walk(phys, (), True)
    out = [T.StructField("numRecords", T.LongType())]
    if nulls:
        out.append(T.StructField("nullCount", nulls))
    if ranges:
        out += [T.StructField("minValues", ranges), T.StructField("maxValues", copy.deepcopy(ranges))]
    return T.StructType([*out, T.StructField("tightBounds", T.BooleanType())])


def has_range(kind: T.DataType) -> bool:
    """Whether min and max of the type are kept."""
    return not isinstance(kind, (T.BooleanType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType))
