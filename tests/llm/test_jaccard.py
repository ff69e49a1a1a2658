import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import jaccard as J
from tidemark.llm.components import components, joined
from tidemark.llm.common import hash_spans, numbered, pieces
from tidemark.llm.prefilter import key_filter, passes


def sets_of(rows):
    out = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out[k] = frozenset(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute(rows):
    s = sets_of(rows)
    par = {k: k for k in s}

    def find(k):
        while par[k] != k:
            k = par[k]
        return k

    ks = sorted(s)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {k: (len(s[k]), find(k)) for k in ks}


def corpus(prose):
    r, rows = random.Random(1), []
    for k in range(60):
        w = prose(k, r.choice([3, 5, 6, 8, 12, 20, 60, 200])).split()
        for _ in range(r.choice([1, 2, 4])):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                v[r.randrange(len(v))] = r.choice(["x", "y", "z"])
            rows.append((len(rows), " ".join(v)))
    line = prose(777, 40)
    rows += [(len(rows) + i, f"{line} {prose(900 + i, 12 + i)}") for i in range(30)]
    base = prose(888, 120).split()
    for i in range(40):  # a family of near copies, larger than SMALL
        v = list(base)
        v[3 * i % 120] = f"q{i}"
        rows.append((len(rows), " ".join(v)))
    return rows + [(1000, None), (1001, ""), (1002, " \t "), (1003, None), (1004, "One"), (1005, "one"), (1006, "w " * 20_000)]


def test_components_equal_brute_force(spark, docs, prose):
    rows = corpus(prose)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs(rows)).collect()}
    assert got == brute(rows)


def test_blocks_of_groups_lose_no_link(spark, docs, prose):
    rows = corpus(prose)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs(rows), block=4, hubs=1).collect()}
    assert got == brute(rows)


def test_components_and_links_that_come_later(spark):
    r = random.Random(6)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1030)]

    def whole(pairs):
        par = {}
        find = lambda k: k if par.setdefault(k, k) == k else find(par[k])
        for a, b in pairs:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
        return {k: find(k) for k in par}

    df = lambda pairs: spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    links = [p for p in links if p[0] != p[1]]
    found = components(df(links[:200]))
    assert {x["node"]: x["component"] for x in found.collect()} == whole(links[:200])
    assert {x["node"]: x["component"] for x in joined(found, df(links[200:])).collect()} == whole(links)


def test_few_jobs_for_small_links_and_filters_over_many_partitions(spark):
    """Small tables dealt over many partitions take few jobs: steps and blocks of bits are no jobs of their own."""
    ctx = spark.sparkContext
    keys = [7 * i - 300 for i in range(400)]
    links = [(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 4000 + i) for i in range(50)]

    def jobs(work):
        name = f"jobs-{work.__name__}"
        ctx.setJobGroup(name, name)
        try:
            out = work()
        finally:
            ctx.setLocalProperty("spark.jobGroup.id", None)
        return out, len(ctx.statusTracker().getJobIdsForGroup(name))

    def filtered():
        return key_filter(spark.createDataFrame([(k,) for k in keys], "t long").repartition(30)).value

    def found():
        return components(spark.createDataFrame(links, "a long, b long").repartition(30)).collect()

    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bits, many = jobs(filtered)
        assert passes(bits, np.array(keys)).all() and passes(bits, np.arange(1 << 40, (1 << 40) + 1000)).sum() < 5 and many < 10
        got, many = jobs(found)
        want = {i: i - i % 2 for i in range(300)} | {i: 1000 for i in range(1000, 1041)} | {i: 4000 for i in [5000, *range(4000, 4050)]}
        assert {x["node"]: x["component"] for x in got} == want and many < 12
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_components_are_the_same_in_a_task_and_by_joins(spark):
    r = random.Random(8)
    links = [(b"%03d" % x, b"%03d" % y) for x, y in ((r.randrange(300), r.randrange(300)) for _ in range(200)) if x != y]
    whole, some = (spark.createDataFrame(x, "a binary, b binary").repartition(4) for x in (links, links[:120]))
    of = lambda df: {bytes(x["node"]): bytes(x["component"]) for x in df.collect()}
    want = of(components(whole))
    more = spark.createDataFrame(links[120:], "a binary, b binary")
    assert of(components(whole, held=0)) == want and of(joined(components(some), more, whole)) == want
    assert of(joined(components(some), more, whole, held=0)) == want
    assert components(whole.limit(0)).count() == 0


def groups_by_hand(rows):
    by = {}
    for k, m in rows:
        by.setdefault(k, set()).add(m)
    return {frozenset(v) for v in by.values() if len(v) > 1}


def test_groups_of_any_size_are_whole(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(1 << 40)) for k in range(300) for _ in range(r.choice([1, 1, 2, 3, 9]))]
    rows += [(1000 + j, m) for m in range(7) for j in range(5)] + [(5000, m) for m in range(3000)] + [(5000, 7)] * 10
    got = {}
    for x in J.groups_of(spark.createDataFrame(rows, "key long, m long").repartition(5), block=8, hubs=2).collect():
        g = got.setdefault((x["g1"], x["g2"]), {"m": [], "hub": {}})
        g["hub"].setdefault(x["block"], set()).add(x["m"]) if x["hub"] else g["m"].append((x["m"], x["block"]))
    assert sorted(sorted(m for m, _ in g["m"]) for g in got.values()) == sorted(sorted(g) for g in groups_by_hand(rows))
    for g in got.values():
        sizes = {}
        for _, b in g["m"]:
            sizes[b] = sizes.get(b, 0) + 1
        assert max(sizes.values()) <= 8 and sorted(sizes) == list(range(len(sizes)))
        assert g["hub"].keys() == set(sizes) - {0} and len(set(map(frozenset, g["hub"].values()))) <= 1


def near_family(prose, many):
    """Near copies of one text that are all linked with one another, of one size."""
    base = prose(888, 400).split()
    return [(k, " ".join([*base[: 3 * k % 390], f"q{k}", *base[3 * k % 390 + 1 :]])) for k in range(many)]


def test_links_of_a_family_do_not_grow_with_its_square(spark, docs, prose):
    rows = near_family(prose, 260)
    for block, hubs in ((1024, 16), (32, 2)):
        _, found, links = J.links_and_members(docs(rows), block=block, hubs=hubs)
        assert found.count() == 260 and found.select("component").distinct().count() == 1
        assert links.count() < 2 * 260


def test_forests_span_components_with_few_pairs(spark):
    r = random.Random(3)
    n = 60
    units = [(1, 2, 0, 0, 0, b"%03d" % i, 900, [r.getrandbits(62) & r.getrandbits(62) & r.getrandbits(62) & 255] * 16, b"%03d" % (i // 2)) for i in range(n)]
    kind = "g1 long, g2 long, i int, j int, block int, d binary, n long, sketch array<long>, component binary"
    got = [(bytes(x["a"]), bytes(x["b"])) for x in J.near_pairs(spark.createDataFrame(units, kind), "forest").collect()]
    par = {}
    find = lambda k: k if par.setdefault(k, k) == k else find(par[k])
    for a, b in got:
        par[find(int(a) // 2)] = find(int(b) // 2)
    assert len({find(i) for i in range(n // 2)}) == 1 and len(got) < 2 * (n // 2)
    c1, c2, far = np.array([0, 1, 0, 2, 3]), np.array([1, 2, 2, 3, 0]), np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert sorted(J.forests(c1, c2, far, 1).tolist()) == [0, 1, 3] and sorted(J.forests(c1, c2, far, 2).tolist()) == [0, 1, 2, 3, 4]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_words_that_collide_under_polynomial_hashes_differ(spark, docs):
    for n in (64, 1024, 2048):
        a, b = thue_morse(n)
        got = {r["doc_id"]: r["component_id"] for r in J.jaccard_join(docs([(1, a), (2, b), (3, f"{a} x"), (4, a.upper())])).collect()}
        assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_numbers_of_spans_are_told_by_bytes():
    words = [b"one", b"two", b"one", b"three", b"two!", b"", b""]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for hashes in (np.zeros(7, np.uint64), np.array([1, 2, 1, 2, 2, 1, 1], np.uint64), hash_spans(data, start, end)):
        got = numbered(data, start, end, hashes).tolist()
        assert [[x == y for y in got] for x in got] == [[x == y for y in words] for x in words]


def test_exact_shingles_equal_brute_force():
    rows = [(i, t) for i, t in enumerate(["a b c d e f a b c d e f", "a b", "a b c d e f", "", "A  B", "b a", "x " * 30, "a b c d e"])]
    _, _, data, offsets = next(pieces(pa.array([t for _, t in rows])))
    number, row = J.exact_shingles(J.words_in(data, offsets), len(rows))
    want = sets_of(rows)
    own = [set(number[row == i].tolist()) for i in range(len(rows))]
    assert [[len(x & y) for y in own] for x in own] == [[len(want[i] & want[j]) for j in want] for i in want]


def test_every_similar_pair_shares_a_key():
    """The pigeonhole for random sets at the edge of similarity, of all sizes."""
    rng, missed, pairs = np.random.default_rng(2), 0, 0
    for size in [*range(1, 40), 55, 70, 100, 139, 140, 141, 300]:
        for _ in range(6):
            h = rng.integers(1, 1 << 62, 2 * size, dtype=np.int64).astype(np.uint64)
            shared = -(-8 * size // 10) if size > 4 else size
            a = np.sort(h[:size])
            for extra in {0, int(shared / 0.8) - size, (int(shared / 0.8) - size) // 2}:
                b = np.sort(np.concatenate([h[: size if extra >= 0 else shared], h[size : size + max(extra, 0)]])) if extra >= 0 else np.sort(h[:shared])
                n = len(np.intersect1d(a, b))
                if 100 * n < 80 * (len(a) + len(b) - n):
                    continue
                pairs += 1
                ka, kb = (set(J.keys_of(x, np.zeros(len(x), np.int64), 1)[0].tolist()) for x in (a, b))
                missed += not ka & kb
    assert pairs > 300 and not missed


def test_sketches_never_exceed_the_difference(prose):
    col = pa.array([prose(i % 7, 900 + 17 * i) for i in range(40)])
    _, _, data, offsets = next(pieces(col))
    h, row = J.shingles(J.words_in(data, offsets), 40)
    flat, first = J.sketches(h, row, 40)
    assert len(set(np.diff(first))) > 1
    bits = J.folded(flat, first[:-1], first[1:])
    own = [set(h[row == i].tolist()) for i in range(40)]
    for i in range(40):
        for j in range(i):
            assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= len(own[i] ^ own[j])


def test_repeated_and_missing_keys(spark, docs, prose):
    t = prose(5, 50)
    rows = [(2, t), (2, t), (None, t), (3, t + " end"), (4, "other words are here for it")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in J.jaccard_join(docs(rows)).collect()), key=str)
    assert got == sorted([(2, 2), (2, 2), (None, 2), (3, 2), (4, 4)], key=str)
    kept = J.without_near_copies(docs(rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 4, None], key=str)
    assert J.jaccard_join(docs([])).count() == 0


def test_rows_stay_whole_beside_columns_of_any_name(spark, docs, prose):
    rows = [(1, prose(1, 40)), (2, prose(1, 40)), (3, prose(3, 40)), (3, prose(4, 40)), (3, prose(3, 40)), (None, prose(1, 40)), (4, None)]
    names = ["id", "row", "h", "other", "least", "said", "n", "d", "key", "component_id", "__kept"]
    table = docs(rows)
    for n in names:
        table = table.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    got = J.without_near_copies(table)
    assert got.columns == table.columns
    found = got.collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "3", "3", "4", "None"]
    assert {r["text"] for r in found if r["doc_id"] == 3} == {prose(3, 40), prose(4, 40)}
    assert all(r[n] == f"{n}{r['doc_id']}" for r in found if r["doc_id"] for n in names)
