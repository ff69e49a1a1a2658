"""Language ID with error-correcting output codes.

Each language has a codeword; a binary classifier on hashed byte n-grams predicts each bit. A text's language is the one
whose codeword has the least logistic loss against the predicted margins, so that wrong bits are outvoted. A text
whose two best codewords are close in loss is flagged as ambiguous.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0 and ambiguous; texts of any
length are read whole; repeated rows get equal results; an empty table gives no rows; where no language was learned
every text is ``und``. Ties between codewords go to the language that sorts first. Other columns, whatever their names, are
not looked at; ``identified`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, bounded_batches, bounded_sample, pieces, table

#: Cells of the features, and rows whose features are held at a time.
DIM, ROWS = 4096, 512
LOWER = ascii_lower()
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte 2-grams and 3-grams of each row, of length 1."""
    n = len(offsets) - 1
    text = LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.zeros(n * DIM)
    for size in (2, 3):
        if len(text) < size:
            continue
        gram = np.full(len(text) - size + 1, size, np.uint32)
        for i in range(size):
            gram = gram * np.uint32(257) + text[i : len(text) - size + 1 + i]
        gram *= np.uint32(2654435761)
        same = row[: len(gram)] == row[size - 1 :]
        cell = (row[: len(gram)] * DIM + (gram >> np.uint32(20)))[same]
        counts += np.bincount(cell, minlength=n * DIM)
    x = np.sqrt(counts.reshape(n, DIM), dtype=np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, far apart: every split of the languages in two if they are few, else a random choice."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 7:
        bits = [[1 if (mask >> (n - 1 - i)) & 1 else -1 for i in range(n)] for mask in range(1, 1 << n) if mask & 1 == 0]
        return np.array(bits, np.float32).T.reshape(n, -1)
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.float32), (n, int(12 * np.ceil(np.log2(n)))))
        far = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if best is None or far > best[0]:
            best = (far, m)
    return best[1]


class CodeModel:
    """Codewords of the languages and the weights of the classifiers of the bits."""

    def __init__(self, x: np.ndarray, names: list[str], steps: int = 300, rate: float = 4.0, decay: float = 1e-5):
        self.names = sorted(set(names))
        self.codes = codewords(len(self.names))
        bits = self.codes.shape[1]
        self.w, self.b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
        if not bits:
            return
        place = {k: i for i, k in enumerate(self.names)}
        label = np.array([place[k] for k in names])
        target = self.codes[label]
        share = np.bincount(label, minlength=len(self.names))
        weight = (len(label) / (len(self.names) * share))[label][:, None].astype(np.float32)
        speed, speed_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps):
            slope = -target * weight / (1 + np.exp(np.clip(target * (x @ self.w + self.b), -30, 30))) / len(x)
            speed = 0.9 * speed - rate * (x.T @ slope + decay * self.w)
            speed_b = 0.9 * speed_b - rate * slope.sum(axis=0)
            self.w += speed
            self.b += speed_b

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language in names, its score in 0..1, and the gap in loss to the next."""
        margin = x @ self.w + self.b
        loss = np.stack([np.logaddexp(0, -margin * code).sum(axis=1) for code in self.codes], axis=1)
        if loss.shape[1] == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.full(len(x), np.inf)
        best = loss.argmin(axis=1)
        low = np.sort(loss, axis=1)
        score = 1 / np.exp(low[:, :1] - loss).sum(axis=1)
        return best, score, low[:, 1] - low[:, 0]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~found & (wide[offsets[1:]] > wide[offsets[:-1]])):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into the fold; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = 3000) -> CodeModel:
    """Fits on about ``rows`` rows with a language; their features are made by the executors, so length doesn't matter."""
    bounded_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(0), 1 << 20, ROWS):
                x = (features(data, offsets) * 65535).astype("<u2")
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a)], names=["x", "lang"])

    known = docs.select(key, F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    got = bounded_sample(known, rows, key).select("text", "lang").mapInArrow(make, "x binary, lang string").toArrow()
    if not got.num_rows:
        return CodeModel(np.zeros((0, DIM), np.float32), [])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), "<u2").reshape(-1, DIM).astype(np.float32) / 65535
    names = got["lang"].to_pylist()
    order = np.lexsort((x[:, 1], x[:, 0], np.array(names)))
    return CodeModel(x[order], [names[i] for i in order])


def identify(docs: DataFrame, model: CodeModel, text: str = "text", key: str = "doc_id", least_gap: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: the key, the language, its score, and whether the next codeword is as near as ``least_gap``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, "und"], object)
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1), 1 << 20, ROWS):
                known = has_letter(data, offsets) & bool(model.names)
                best, score, gap = np.full(b - a, len(model.names)), np.zeros(b - a), np.zeros(b - a)
                if known.any():
                    best, score, gap = model.decode(features(data, offsets))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0).astype(float)), pa.array(~known | (gap < least_gap))],
                    names=[key, "lang_pred", "score", "ambiguous"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: CodeModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a recognisable language; a missing ``lang`` is filled in, all else stays."""
    bounded_batches(docs.sparkSession)
    shared, at, to = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), docs.columns.index(lang)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(at), 1 << 20, ROWS):
                known = has_letter(data, offsets)
                rows = batch.slice(a, b - a)
                if model.names:
                    best, score, _ = model.decode(features(data, offsets))
                    known &= score >= 1.2 / max(2, len(model.names))
                    names = pa.array([model.names[i] for i in best], pa.string())
                    filled = pa.compute.coalesce(rows.column(to), names.cast(rows.column(to).type))
                    rows = pa.RecordBatch.from_arrays([filled if i == to else c for i, c in enumerate(rows.columns)], schema=rows.schema)
                yield rows.filter(pa.array(known))

    return docs.mapInArrow(keep, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    flags = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    found = identify(flags, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
