import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"


@pytest.fixture
def docs(spark):
    """Makes documents from (id, text) or (id, text, lang, source), with extra columns named like operators' outputs."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "src0")), len(r[1] or ""), "own", "own") for r in rows]
        return spark.createDataFrame(full, DOC).repartition(3) if full else spark.createDataFrame([], DOC)

    return make


WORDS = "the of and river stone light under quick brown fox jumps over lazy dogs near old mill water falls seven kings rode west at dawn to find lost harp".split()


@pytest.fixture
def prose():
    """Repeatable text of n words for a seed."""
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "ly", "ing", "ed"]) + (r.choice("abcdefgh") if r.random() < 0.3 else "") for _ in range(n))

    return make
