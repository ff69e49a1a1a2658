import pytest

from tidemark.llm import quality as Q


@pytest.fixture
def labelled(spark, docs, prose):
    d = docs([(i, prose(i, 60) if i % 3 else (prose(i, 4) + " ### ") * 10) for i in range(240)])
    return d, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")


def test_separates_and_calibrates(spark, docs, prose, labelled):
    d, labels = labelled
    model = Q.fit(d, labels.where("doc_id % 2 = 0 or doc_id is null"))
    got = {r["doc_id"]: r for r in Q.score_quality(d, model).collect()}
    odd = [i for i in range(240) if i % 2]
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in odd) >= 0.95 * len(odd)
    assert all(0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5) for i in odd)


def test_odd_texts(spark, docs, labelled):
    model = Q.fit(*labelled)
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (4, "a"), (4, "a"), (None, "b")]
    got = Q.score_quality(docs(rows), model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == pytest.approx(model.prior)
    assert all(0 <= s <= 1 for s in by.values())


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs([(1, "a")]), none)
    assert Q.score_quality(docs([(1, "text")]), model).first()["score"] == 0.5
    assert Q.score_quality(docs([]), model).count() == 0
