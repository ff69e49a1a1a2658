from pyspark.sql import functions as F

from tidemark.llm import language as L

SAMPLE = {"en": "the river and the stone with this that of and tion ing over the hill", "de": "der Fluss und die Steine mit nicht auch für über den Berg schön", "fr": "la rivière et les pierres avec que pas très élevé sur une colline", "es": "el río y las piedras con que no está sobre la montaña también"}


def rows():
    out = []
    for k, (lang, text) in enumerate(SAMPLE.items()):
        words = text.split()
        for i in range(40):
            out.append((k * 100 + i, " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] for j in range(25)), lang, "s"))
    return out


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        c = L.codewords(n)
        assert min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)
    assert L.codewords(1).shape == (1, 0)


def test_held_out_accuracy_and_bounds(spark, docs):
    d = docs(rows())
    out = L.held_out(F.col("doc_id"), 5, 0)
    model = L.fit(d.where(~out))
    got = L.identify(d.where(out), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 10
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark, docs):
    model = L.fit(docs(rows()))
    odd = [(1, None), (2, ""), (3, "123 !!! 456"), (4, "é"), (5, "the river " * 50_000), (5, "the river " * 50_000), (None, "der Fluss und die Steine")]
    got = L.identify(docs(odd), model).collect()
    assert len(got) == len(odd)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(by[i]["score"] == 0 and by[i]["ambiguous"] for i in (1, 2, 3))
    assert by[4]["lang_pred"] in SAMPLE
    assert by[5]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"


def test_nothing_to_learn_from(spark, docs):
    model = L.fit(docs([(1, "text", None, None)]))
    assert L.identify(docs([(1, "text")]), model).first()["lang_pred"] == "und"
    assert L.identify(docs([]), model).count() == 0
    one = L.fit(docs([(1, "text", "en", "s")]))
    assert L.identify(docs([(1, "other")]), one).first()["lang_pred"] == "en"


def test_stage_drops_what_has_no_language(spark, docs):
    model = L.fit(docs(rows()))
    d = docs([(1, "the river and the stone", None, "s"), (2, "...", "en", "s"), (3, None, "en", "s"), (4, "der Fluss und", "xx", "s")])
    got = {r["doc_id"]: r["lang"] for r in L.identified(d, model).collect()}
    assert got == {1: "en", 4: "xx"}
