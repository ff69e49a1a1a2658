import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D


def words(t):
    t = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, n=13):
    wins = {}
    for k, t in items:
        w = words(t)
        if k is not None and w:
            for i in range(max(1, len(w) - n + 1)):
                wins.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[g]
        out.append((k, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def cases(prose):
    r = random.Random(3)
    items = [(i, prose(1000 + i, r.choice([1, 3, 12, 13, 14, 40]))) for i in range(12)] + [(12, prose(1003, 40)), (3, "Zwölf Boxkämpfer jagen"), (None, "ignored words"), (20, None), (21, "...")]
    docs = [(i, prose(i, 150)) for i in range(20)]
    for i in range(20, 40):
        k, t = items[i % 12]
        docs.append((i, prose(i, 30) + "! " + t.upper() + " ?? " + (t if i % 2 else "") + " " + prose(i + 50, 20)))
    docs += [(50, None), (51, ""), (52, "--"), (53, items[5][1] * 200), (53, items[5][1] * 200), (54, "zwölf boxkämpfer jagen"), (None, items[4][1])]
    return docs, items


def test_equals_brute_force(spark, docs, prose):
    d, items = cases(prose)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(d, items)
    for most in (1 << 20, 300):  # one block, and many
        got = D.find_contamination(docs(d), table, most=most).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=str) == want
        for r in got:
            assert sum(x["e"] - x["s"] for x in r["spans"]) == r["n_hit"]


def test_stage_drops_by_the_rule(spark, docs, prose):
    d, items = cases(prose)
    table = spark.createDataFrame(items, "item_id long, text string")
    keep = sorted((k for k, n, hit, _ in brute(d, items) if not (hit and 20 * hit >= n)), key=str)
    for most in (1 << 20, 300):
        got = D.decontaminated(docs(d), table, most=most)
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == keep
        assert set(got.columns) == set(docs(d).columns)


def test_index_against_plain_search():
    rng = np.random.default_rng(5)
    for n, symbols in ((1, 1), (50, 2), (400, 3), (400, 60)):
        text = rng.integers(0, symbols + 1, n)
        index = D.FMIndex(text, symbols)
        patterns = [text[i : i + k] for i in range(0, n, 7) for k in (1, 2, 5) if (text[i : i + k] > 0).all()] + [rng.integers(1, symbols + 1, 4) for _ in range(10)]
        if not patterns:
            continue
        matrix = np.zeros((len(patterns), 5), np.int64)
        for i, p in enumerate(patterns):
            matrix[i, : len(p)] = p
        first, last = index.search(matrix, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, first, last, strict=True):
            want = [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.judged(D.find_contamination(docs([(1, "some words here")]), none)).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (3, 0, False)
    assert D.find_contamination(docs([]), none).count() == 0
    assert D.decontaminated(docs([(1, "a")]), none).count() == 1


def test_words_that_share_a_hash_are_told_apart(spark, docs, monkeypatch):
    """Words that collide under polynomial hashes, and, in one shard, words that share one hash altogether."""
    a, b = ("".join(x[i.bit_count() & 1] for i in range(1024)) for x in ("ab", "ba"))
    table = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in D.find_contamination(docs([(1, a), (2, b), (3, f"x {a}")]), table).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
    monkeypatch.setattr("tidemark.llm.common.hash_spans", lambda data, start, end, at=None: (end - start).astype(np.uint64))
    items = [(1, "aa bb cc"), (2, "dd"), (3, "cc aa")]
    rows = [(0, "aa bb cc dd"), (1, "bb bb cc"), (2, "ee aa bb"), (3, "ee cc aa ee"), (4, "dddd dd")]
    _, _, data, offsets = next(D.pieces(pa.array([t for _, t in rows])))
    for most in (items, items[:1]):
        words, spans, _, names = D.shard_results(data, offsets, [D.Phrases([(str(k), t) for k, t in most])])
        got = [(k, int(n), sum(e - s for s, e in x), tuple(y)) for (k, _), n, x, y in zip(rows, words, spans, names, strict=True)]
        assert sorted(got, key=str) == brute(rows, most)


def test_columns_of_any_name_stay(spark, docs, prose):
    item = prose(70, 30)
    table = docs([(1, prose(1, 50)), (2, item)]).withColumn("__k", F.lit(5)).withColumn("h", F.lit(6))
    for most in (1 << 20, 10):
        got = D.decontaminated(table, spark.createDataFrame([(1, item), (2, prose(71, 20))], "item_id long, text string"), most=most).collect()
        assert [(r["doc_id"], r["__k"], r["h"]) for r in got] == [(1, 5, 6)]
