"""Statistics of data files, gathered in one pass over what was just written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col_of

#: Length to which text bounds are cut, and what makes a cut upper bound an upper bound again.
CUT, TIE_ASCII, TIE = 32, "\x7f", "\U0010ffff"


def text_max(c: Column) -> Column:
    """An upper bound of at most CUT characters and a tie breaker."""
    tie = F.when(F.substring(c, CUT + 1, 1) < F.lit(TIE_ASCII), F.lit(TIE_ASCII)).otherwise(F.lit(TIE))
    return F.when(F.length(c) <= CUT, c).otherwise(F.concat(F.substring(c, 1, CUT), tie))


def file_stats(data: DataFrame, kind: T.StructType) -> DataFrame:
    """(file, stats): statistics of each file that ``data`` scans, in the shape of ``kind``, as JSON."""
    aggs = [F.count("*").alias("n")]
    take: dict[tuple[str, tuple[str, ...]], str] = {}

    def plan(top: str, s: T.StructType, path: tuple[str, ...]) -> None:
        for f in s:
            p = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                plan(top, f.dataType, p)
                continue
            c, name = col_of(p), f"a{len(take)}"
            if top == "nullCount":
                a = F.sum(F.when(c.isNull(), 1).otherwise(0))
            elif top == "minValues":
                a = F.min(c)
                a = F.substring(a, 1, CUT) if isinstance(f.dataType, T.StringType) else a
            else:
                a = F.max(c)
                a = text_max(a) if isinstance(f.dataType, T.StringType) else a
            aggs.append(a.alias(name))
            take[top, p] = name

    tops = {f.name: f.dataType for f in kind if isinstance(f.dataType, T.StructType)}
    for top, s in tops.items():
        plan(top, s, ())

    def build(top: str, s: T.StructType, path: tuple[str, ...]) -> Column:
        parts = []
        for f in s:
            p = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                parts.append(build(top, f.dataType, p).alias(f.name))
            else:
                c = F.col(take[top, p])
                if isinstance(f.dataType, T.TimestampType) and top != "nullCount":
                    c = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
                elif isinstance(f.dataType, T.TimestampNTZType) and top != "nullCount":
                    c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
                parts.append(c.alias(f.name))
        return F.struct(*parts)

    per_file = data.groupBy(F.col("_metadata.file_path").alias("file")).agg(*aggs)
    shape = F.struct(F.col("n").alias("numRecords"), *(build(top, s, ()).alias(top) for top, s in tops.items()), F.lit(True).alias("tightBounds"))
    return per_file.select("file", F.col("n").alias("rows"), F.to_json(shape).alias("stats"))


def size_histogram(files: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """(bin, files, bytes) of a file list by the bins of version checksums, or by those with other lower bounds."""
    from tidemark.plans.checksum import boundaries

    lower = F.array(*(F.lit(b) for b in bounds or boundaries()))
    at = F.size(F.filter(lower, lambda b: b <= F.col("size"))) - 1
    return files.groupBy(at.alias("bin")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
