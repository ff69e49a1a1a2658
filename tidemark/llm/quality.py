"""Quality classifier by compression.

One zstandard dictionary is built from pieces of text labelled good and one from text labelled bad. A text is compressed
whole with either; the difference of the sizes, divided by the length of the text, goes through a logistic curve fitted
on labelled rows that the dictionaries have not seen, weighted to the shares of the labels.

Defined results: null and empty texts get the share of good labels as their score; texts of any length are compressed
whole; repeated rows get equal scores; a row labelled both ways is left out of fitting; an empty table gives no rows;
without labels of both kinds every score is the share of good labels, or 0.5 where there are no labels. Columns other than
those named are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, bounded_sample, buffers, pieces, table
from tidemark.llm.language import held_out

PIECE, PIECES, DICTIONARY, LEVEL = 1000, 6000, 262_144, 3


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, texts)) // 4), texts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-size:]


class QualityModel:
    """Two dictionaries, and a curve from the difference of sizes to a probability."""

    def __init__(self, good: bytes, bad: bytes, prior: float):
        self.good, self.bad, self.prior = good, bad, prior
        self.slope, self.at = 0.0, math.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(content, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve by Newton's method; classes weighted to the prior, a light ridge against separable samples."""
        if not len(x) or y.min() == y.max():
            return
        share = y.mean()
        weight = np.where(y > 0, self.prior / share, (1 - self.prior) / (1 - share))
        scale = x.std() or 1.0
        a = np.stack([x / scale, np.ones_like(x)], axis=1)
        w = np.array([0.0, self.at])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
            step = np.linalg.solve(h, a.T @ (weight * (y - p)) - np.array([1e-2, 1e-6]) * w)
            w += np.clip(step, -4, 4)
            if abs(step).max() < 1e-9:
                break
        self.slope, self.at = max(0.0, w[0] / scale), w[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.at, -30, 30)))


def differences(column: pa.Array, tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the bad dictionary needs more than the good one, per byte of text; 0 for an empty text."""
    data, offsets = buffers(column)
    view, out = memoryview(np.ascontiguousarray(data)), np.zeros(len(offsets) - 1)
    good, bad = tools
    for i in np.flatnonzero(np.diff(offsets)):
        text = view[offsets[i] : offsets[i + 1]]
        out[i] = (len(bad.compress(text)) - len(good.compress(text))) / len(text)
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = 3000) -> QualityModel:
    """Fits on about ``rows`` labelled rows of each kind, half for the dictionaries and half for the curve.

    The dictionaries see at most PIECES pieces of PIECE bytes of each kind, chosen by hash from whole texts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(key, label).where(f"`{key}` is not null and `{label}` is not null").groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select(key, "y")
    counts = {bool(r["y"]): r["n"] for r in known.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    prior = counts.get(True, 0) / n if n else 0.5
    model = QualityModel(b"", b"", prior)
    if len(counts) < 2:
        return model
    chosen = bounded_sample(known.where("y > 0"), rows, key).unionAll(bounded_sample(known.where("y <= 0"), rows, key))
    chosen = chosen.withColumn("fits", F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)) == 0)
    sample = docs.select(key, text).join(F.broadcast(chosen), key).select(text, F.col("y").cast("long"), "fits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(0)):
                ys, parts, labels = batch.column(1).slice(a, b - a).to_pylist(), [], []
                for i, y in enumerate(ys):
                    whole = data[offsets[i] : offsets[i + 1]].tobytes()
                    parts += (own := [whole[j : j + PIECE] for j in range(0, len(whole), PIECE)])
                    labels += [y] * len(own)
                yield pa.record_batch([pa.array(parts, pa.binary()), pa.array(labels, pa.int64())], names=["part", "y"])

    parts = sample.where("fits").drop("fits").mapInArrow(cut, "part binary, y long").withColumn("h", F.xxhash64("part"))
    get = lambda of: [bytes(r["part"]) for r in parts.where(of).orderBy("h", "part").limit(PIECES).collect()]
    model.good, model.bad = dictionary(get("y > 0")), dictionary(get("y <= 0"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = shared.value.compressors()
        for batch in batches:
            yield pa.record_batch([pa.array(differences(batch.column(0), tools)), batch.column(1)], names=["x", "y"])

    got = sample.where(~F.col("fits")).drop("fits").mapInArrow(measure, "x double, y long").toArrow()
    x, y = got["x"].to_numpy(), (got["y"].to_numpy() > 0).astype(float)
    order = np.lexsort((y, x))
    model.calibrate(x[order], y[order])
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the key, the probability of label 1, and whether it is at least a half."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tools = shared.value, None
        for batch in batches:
            tools = tools or model.compressors()
            column = batch.column(1)
            empty = pa.compute.fill_null(pa.compute.equal(pa.compute.binary_length(column), 0), True).to_numpy(zero_copy_only=False)
            p = np.where(empty, model.prior, model.probability(differences(column, tools)))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(score, f"`{key}` {kind}, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    found = score_quality(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
