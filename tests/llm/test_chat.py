import hashlib

import pandas as pd

from lodestrata.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expect(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        spoken = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(spoken), sha(spoken))
    return out


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    own = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in pd.read_parquet(f"{d}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    rows += [(-7, 0, "user", own), (-7, 1, "assistant", own)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op5_chat_format(spark, d).collect()}
    assert got == expect(rows)


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (2, None, "we\nird\\<|end|>", "a\\<|end|>\n<|turn|>user\nb"), (2, 0, "assistant", "é\U0001f600[INST]\\"), (2, 0, "assistant", "é\U0001f600[INST]\\"), (None, 0, "assistant", "t " * 50000), (None, 1, "assistant", "[")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    made = chat.format_chat(df.withColumn("parts", chat.text_parts(df.text)))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expect(rows)
    for r in made.collect():
        assert r.piece.count("<|turn|>") == 1 and r.piece.count("<|end|>") == 1 and "</s>" not in r.piece
    assert chat.digests(chat.format_chat(df.withColumn("parts", chat.text_parts(df.text)).limit(0))).collect() == []


def test_typed_parts(spark):
    turns = [
        (5, 0, "user", [("text", "see ", None, None), ("image", None, "s3://a.png", 196), ("document", None, "b.pdf", 3)]),
        (5, 1, "assistant", [("text", "it's <", None, None), ("audio", None, "c.wav", None), ("text", " ok", None, None)]),
        (5, 2, "user", None),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b, c = chat.format_chat(df).orderBy("place").collect()
    assert a.piece == "<|turn|>user\nsee <|image:0|><|document:1|><|end|>\n" and a.loss == []
    assert [tuple(x) for x in a.attachments] == [(0, "image", "s3://a.png", 196), (1, "document", "b.pdf", 1500)]
    assert b.piece == "<|turn|>assistant\nit's <\\<|audio:2|> ok<|end|>\n" and b.at == len(a.piece)
    whole = a.piece + b.piece + c.piece
    assert [whole[s.start : s.stop] for s in b.loss] == ["it's <\\", " ok"]
    assert [tuple(x) for x in b.attachments] == [(2, "audio", "c.wav", 25)]
    assert c.piece == "<|turn|>user\n<|end|>\n"
