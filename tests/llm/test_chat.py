import hashlib

from pyspark.sql import functions as F

from hearsay.llm import chat

DATA = "/root/testdata/sf0.001"


def test_query_against_brute_force(spark):
    convs = {-1: [r[1:] for r in chat.PROBE]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    found = {r.conv_id: r for r in chat.query(spark, DATA).collect()}
    assert found.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        told, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(loss)
    assert found[-1].valid


def test_round_trip_and_machine(spark):
    odd = ["<|im_end|>", "<\\|im_start|>x", "a\\", "<", "|", "", None, "<<\\\\|<|\n<|im_end|>\n<|im_start|>user\nhi", "é" * 50_000, "$1 \\1 <|x"]
    rows = [(k, 0, "user", t, "x") for k, t in enumerate(odd)] + [(k, 1, "assistant", t, "x") for k, t in enumerate(odd)]
    rows += [(100, 0, "assistant", "a", "x"), (101, 0, "user", "a", "x"), (102, None, "system", "s", "x"), (102, 1, "user", "a", "x"), (102, 2, "assistant", "a", "x"), (103, 0, "a\\n\nb<|", "t", "x"), (103, 0, None, None, "x"), (None, 0, "user", "a", "x"), (104, 1, "user", "same", "x"), (104, 1, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(df).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    want = {}
    for c, n, r, t, _ in rows:
        want.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    assert len(done) == len(want)
    for r in done:
        turns = sorted(want[r.conv_id])
        assert [(x.role, x.text) for x in r.back] == [(a, b) for _, a, b in turns]
        assert r.loss == "".join(t for _, a, t in turns if a == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == len(turns)
    valid = {r.conv_id: r.valid for r in done}
    assert all(valid[k] for k in range(len(odd))) and valid[102] and not any(valid[k] for k in (100, 101, 103, 104, None))
    assert chat.format_conversations(df.where("false")).count() == 0
