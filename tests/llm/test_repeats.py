import hashlib
import random

import numpy as np

from tidemark.llm import repeats as R


def brute(rows):
    seen, out = {}, {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            if seen.setdefault(b[s : s + 100], (k, s)) != (k, s):
                edge[s] += 1
                edge[s + 100] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus(prose):
    r = random.Random(4)
    passage, line = prose(500, 60), prose(501, 14)[:99]
    rows = [(i, prose(i, r.choice([5, 30, 100]))) for i in range(25)]
    for i in range(25, 60):
        rows.append((i, f"{prose(i, 10)} {passage if i % 2 else passage[20:180]} {prose(i + 70, 8)} {line} {prose(i + 140, 9)}"))
    rows += [(60, rows[3][1]), (61, rows[30][1]), (62, rows[30][1].replace("the", "The", 1)), (63, "ab" * 300), (64, "x" * 250), (65, "x" * 99), (66, "y" * 100), (67, "y" * 100)]
    return rows + [(70, None), (71, ""), (72, "é" * 120), (73, "z" + "é" * 120), (-5, passage), (80, prose(3, 4000) + passage), (None, rows[40][1][:150])]


def check(got, want):
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_equals_brute_force(spark, docs, prose):
    rows = corpus(prose)
    check(R.without_repeats(docs(rows)).collect(), brute(rows))


def test_crowded_classes_give_the_same_spans(spark, docs, prose):
    rows = corpus(prose)

    def merged(d):
        out = {}
        for r in d.collect():
            covered = set()
            for x in r["spans"]:
                covered |= set(range(x["s"], x["e"]))
            out[r["doc"]] = covered
        return out

    d = docs(rows)
    assert merged(R.repeated_spans(d)) == merged(R.repeated_spans(d, crowd=2))


def test_cover_holds_every_distance():
    assert {(a - b) % R.PERIOD for a in R.COVER for b in R.COVER} == set(range(R.PERIOD))


def test_cover_ranks_follow_the_suffixes():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 300), np.full(150, 97), rng.integers(97, 99, 100), np.zeros(400, int)]).astype(np.uint8)
    rank = R.cover_ranks(text)
    at = [i for i in range(550) if i % R.PERIOD in R.COVER]
    raw = text.tobytes()
    order = sorted(at, key=lambda i: (rank[i], i))
    assert all(raw[a : a + 130] <= raw[b : b + 130] for a, b in zip(order, order[1:]))
    assert all((rank[a] == rank[b]) <= (raw[a : a + 130] == raw[b : b + 130]) for a, b in zip(order, order[1:]))


def test_repeated_rows_and_empty_table(spark, docs, prose):
    t = prose(9, 80)
    got = R.without_repeats(docs([(1, t), (1, t), (2, t)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, len(t.encode()))]
    assert R.without_repeats(docs([])).count() == 0


def test_pieces_may_differ_between_plans(spark, docs, prose, monkeypatch):
    rows = [(i, f"{prose(i, 10)} {prose(500, 60)}") for i in range(6)]
    size, whole = "spark.sql.execution.arrow.maxRecordsPerBatch", R.cut

    def smaller(session, df):
        out = whole(session, df)
        session.conf.set(size, "1")
        return out

    monkeypatch.setattr(R, "cut", smaller)
    try:
        check(R.without_repeats(docs(rows).coalesce(1)).collect(), brute(rows))
    finally:
        spark.conf.unset(size)
