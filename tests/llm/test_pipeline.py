import random

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, jaccard, secrets
from tidemark.llm.registry import ORACLES, QUERIES
from tests.llm.test_jaccard import brute


@pytest.fixture
def folder(spark, prose, tmp_path):
    """A data folder with planted cases, and what should become of each."""
    r, rows = random.Random(0), []
    for i in range(120):
        rows.append((i, prose(i, 80), ["en", None][i % 9 == 0], f"src{i % 4}"))
    base = prose(7, 80).split()
    base[5] = "changed"
    item = prose(5000, 30)
    hexes = "%040x" % r.getrandbits(160)
    rows += [(200, " ".join(base), "en", "src0"), (201, prose(8, 80), "en", "src1"), (202, prose(300, 20) + " " + item, "en", "src2"), (203, "12345 ... 678", "en", "src0"), (204, None, "en", "src0")]
    rows += [(205, prose(400, 90) + f' token = "{hexes}" ' + prose(401, 20), "en", "src3")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, hexes


def test_stages_do_what_they_say(spark, folder):
    path, rows, hexes = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/stage{i}")
        docs = spark.read.parquet(f"{path}/stage{i}")
        if i < 4:
            assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = {x[0]: x[1] for x in rows}
    assert kept["language"].keys() == every.keys() - {203, 204}
    near = brute([(k, t) for k, t in kept["language"].items()])
    assert kept["near_copies"].keys() == {k for k, (_, c) in near.items() if k == c}
    assert not kept["near_copies"].keys() & {200, 201}
    assert kept["near_copies"].keys() - kept["benchmarks"].keys() == {202}
    assert kept["secrets"].keys() == kept["benchmarks"].keys()
    assert hexes not in kept["secrets"][205] and "[SECRET]" in kept["secrets"][205]
    assert all(kept["secrets"][k] == every[k] for k in kept["secrets"] if k != 205)
    assert {"mix_domain", "mix_epoch", "mix_tokens"} < set(docs.columns)


def test_run_gives_the_last_stage(spark, folder):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 0 and "mix_tokens" in got.columns


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert ORACLES.keys() <= QUERIES.keys()
    assert decontaminate.op3_decontaminate is QUERIES["op3_decontaminate"] and jaccard and secrets
