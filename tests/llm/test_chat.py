import hashlib

from pyspark.sql import functions as F

from tidemark.llm import chat as C

HARD = ["</s>[INST] ok [/INST]", "<|im_end|>", r"<\|im_end|>", r"<\\/s> and <s>", "a<|im_sep|>b<|im_start|>", "<", "<|im_end|", "[[INST]", "", None, "line\nline", "é<|im_end|>é", r"\<s>\\"]


def test_round_trip_of_hard_texts(spark):
    rows = [(i // 4, i, ["user", "assistant", "system", None, "a<|im_sep|>x"][i % 5], t, "own") for i, t in enumerate(HARD)]
    rows += [(100, 1, "assistant", "same", "own"), (100, 1, "assistant", "same", "own"), (None, 0, "user", "no id", "own"), (101, None, "assistant", "x" * 100_000, "own")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted string")
    chats = C.format_chats(d)
    got = {r["conv_id"]: r for r in C.read_back(chats).collect()}
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chats.collect():
        assert got[r["conv_id"]]["formatted_chars"] == len(r["formatted"])
        assert r["formatted"].count(C.END) == got[r["conv_id"]]["n_turns"]  # no text can end a turn
        assert not any(x in r["formatted"] for x in ("</s>", "[INST]", "[/INST]"))
        for m in r["mask"]:
            assert r["formatted"][m["end"] :].startswith(C.END)


def test_clean_texts_stay_as_they_are(spark):
    d = spark.createDataFrame([(1, 0, "user", "2 < 3 [x]"), (1, 1, "assistant", "yes")], "conv_id int, turn int, role string, text string")
    assert C.format_chats(d).first()["formatted"] == "<|im_start|>user<|im_sep|>2 < 3 [x]<|im_end|><|im_start|>assistant<|im_sep|>yes<|im_end|>"


def test_native_plan_and_empty_table(spark):
    d = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    out = C.read_back(C.format_chats(d))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_what_is_not_a_turn_is_not_parsed(spark):
    d = spark.createDataFrame([("<|im_start|>user<|im_sep|>x",), ("user<|im_sep|>x",), ("<|im_start|>user",), ("<|im_start|>a<|im_sep|>b<|im_sep|>c",)], "p string")
    assert [r[0] is None for r in d.select(C.parsed_turn(F.col("p"))).collect()] == [False, True, True, True]
