import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def split(budget, kids):
    """Water-filling by exact fractions; kids are (name, weight, room)."""
    kids = [k for k in kids if k[1] > 0 and k[2] > 0]
    left, full, act = min(budget, sum(k[2] for k in kids)), {}, list(kids)
    while act:
        weights = sum(k[1] for k in act)
        over = [k for k in act if Fraction(left * k[1], weights) > k[2]]
        if not over:
            break
        k = min(over, key=lambda k: (k[2] / k[1], k[0]))
        full[k[0]] = k[2]
        left -= k[2]
        act.remove(k)
    weights = sum(k[1] for k in act)
    low = {k[0]: left * k[1] // weights for k in act}
    part = {k[0]: left * k[1] % weights for k in act}
    for n in sorted(part, key=lambda n: (-part[n], n))[: left - sum(low.values())]:
        low[n] += 1
    return full | low


def tokens(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(rows, weights, total, epochs, domain):
    leaves = {}
    for r in rows:
        n = tokens(r[1])
        if n:
            leaves.setdefault((domain(r[3] or ""), r[2] or "", r[3] or ""), []).append((r[0], r[1], n))
    room = {k: epochs * sum(n for *_, n in v) for k, v in leaves.items()}
    total = sum(room.values()) // epochs if total is None else total
    out = []

    def down(prefix, budget):
        if len(prefix) == 3:
            docs = leaves[prefix]
            t = sum(n for *_, n in docs)
            e, rest = budget // t, budget % t
            out.extend((k, i, n) for k, _, n in docs for i in range(e))
            for _, _, k, n in sorted((hashlib.md5(f"mix:{e}:{'' if k is None else k}".encode()).hexdigest(), k or 0, k, n) for k, _, n in docs):
                if rest > 0:
                    out.append((k, e, min(n, rest)))
                rest -= n
            return
        level, kids = M.LEVELS[len(prefix)], {}
        for k, v in room.items():
            if k[: len(prefix)] == prefix:
                kids[k[len(prefix)]] = kids.get(k[len(prefix)], 0) + v
        for name, share in split(budget, [(k, weights[level].get(k, 0), v) for k, v in kids.items()]).items():
            down((*prefix, name), share)

    down((), total)
    return sorted(((k, e, n) for k, e, n in out if n), key=str)


@pytest.mark.parametrize("total, epochs", [(None, 4), (37, 1), (10**6, 2), (0, 3)])
def test_equals_brute_force(spark, docs, prose, total, epochs):
    rows = [(i, prose(i, i % 13), ["en", "de", None, "fr"][i % 4 if i % 3 else 0], ["a", "b", None, "zero"][i % 7 % 4]) for i in range(80)] + [(100, None, "en", "a"), (101, "", "en", "a"), (None, "two words", "en", "b")]
    weights = {"domain": {"d0": 3, "d1": 1, "d2": 2, "d3": 5}, "language": {"en": 2, "de": 1, "": 1}, "source": {"a": 1, "b": 7, "": 2, "zero": 0}}
    tables = {k: spark.createDataFrame(list(v.items()), "name string, weight long") for k, v in weights.items()}
    got = M.mix(docs(rows), tables, M.domain_of(), total, epochs)
    assert set(docs(rows).columns) < set(got.columns)
    want = brute(rows, weights, total, epochs, lambda s: f"d{int(hashlib.md5(s.encode()).hexdigest()[0], 16) % M.DOMAINS}")
    assert sorted(((r["doc_id"], r["mix_epoch"], r["mix_tokens"]) for r in got.collect()), key=str) == want


def test_shortages_stay_in_the_family(spark, docs):
    """A source that runs out is made up by its own language before another language gets anything."""
    text = lambda n: " ".join(["w"] * n)
    d = docs([(1, text(10), "en", "a"), (2, text(1000), "en", "b"), (3, text(1000), "de", "a")])
    tables = {"domain": spark.createDataFrame([("d", 1)], "name string, weight long"), "language": spark.createDataFrame([("en", 1), ("de", 1)], "name string, weight long"), "source": spark.createDataFrame([("a", 1), ("b", 1)], "name string, weight long")}
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["mix_tokens"] for r in M.mix(d, tables, F.lit("d"), 800, 1).collect()}
    assert got == {1: 10, 2: 390, 3: 400}


def test_plan_is_native_and_empty_table(spark, docs):
    d = docs([])
    got = M.mix(d, M.rule_weights(d), M.domain_of())
    assert got.count() == 0
    d = docs([(1, "some text", "en", "s")])
    plan = M.mix(d, M.rule_weights(d), M.domain_of())._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_columns_of_any_name_stay(spark, docs):
    """Names of helpers and of added columns: nothing crashes and the caller's values stay."""
    names = ["mix_domain", "mix_epoch", "mix_tokens", "mix_tokens_in", "__tokens", "__order", "row", "domain", "language", "tokens", "key", "order", "bucket", "last", "weight", "budget"]
    d = docs([(i, "some text here", "en", "s") for i in range(5)])
    for n in names:
        d = d.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    got = M.mix(d, M.rule_weights(d), M.domain_of(), 8, 1)
    assert len(set(got.columns)) == len(got.columns) == len(d.columns) + 3
    rows = got.collect()
    assert sum(r["mix_tokens"] for r in rows) == 8
    for r in rows:
        for n in names:
            kept = {"mix_domain": "mix_domain_in", "mix_epoch": "mix_epoch_in", "mix_tokens": "mix_tokens_in_in"}.get(n, n)
            assert r[kept] == f"{n}{r['doc_id']}"
