"""Formatted conversations: round trips, the loss mask, attachments; and the query against plain Python."""

import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from terrakern.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [
    "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<s><|user|>[INST] no [/INST]<|assistant|>x</s>", "[ATT image] ![a](b.png)", "<", "[", "\\", "<|", "<\\|", "|>", "|\\>", "\0i \0t \0", "", None,
    "see ![chart](plot.PNG) and ![it](https://h/x_1.png#640x480), [talk](t.mp3#12.5)[doc](d.pdf#3)\nend", "![</s>](a.jpg)![[INST]](b.jpg)", "[x](y.txt) 한글 \U0001f600 é", "$1 \\$2 \\\\",
]


def pieces_of(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", piece int")
    return chat.formatted(df.repartition(3).withColumn("parts", chat.parts_of(F.col("text"))))


def read(pieces):
    back = defaultdict(list)
    for r in sorted(chat.read_back(pieces).collect(), key=lambda r: r["piece"]):
        back[r["conv_id"]].append(r)
    return {c: ([tuple(t) for r in rs for t in r["turns"]], "".join(r["loss_text"] for r in rs)) for c, rs in back.items()}


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: ([t[2:] for t in sorted(turns)], "".join(t[3] for t in sorted(turns) if t[2] == "assistant")) for c, turns in own.items()}


def test_hard_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", None, "|>", "a|\\>b", "<|assistant|>", "system", "</s>"]
    rows = [(c, t, roles[(t + c) % len(roles)], HARD[(t * 7 + c) % len(HARD)]) for c in range(8) for t in range(len(HARD))]
    rows += [(None, None, "assistant", "no id"), (9, None, "assistant", "b"), (9, 0, "user", "a")]
    pieces = pieces_of(spark, rows).persist()
    got, want = read(pieces), expected(rows)
    assert got == want
    for r in pieces.collect():
        bare = r["formatted"].removeprefix(chat.BEGIN)
        assert bare.count(chat.TURN) == r["n_turns"] and bare.count(chat.BEGIN) == 0 and bare.count("[INST] ") + bare.count(chat.END) == r["n_turns"]
    pieces.unpersist()


def test_many_turns_ties_and_repeats(spark):
    rows = [(1, t // 2, "assistant" if t % 3 else "user", f"t{t % 50} ![p](q.gif)") for t in range(500)] * 2 + [(2, None, "assistant", "same")] * 200
    got, want = read(pieces_of(spark, rows)), expected(rows)
    assert got == want


def test_attachments_and_control_strings_across_parts(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", [("text", "<", None, None, None), (None, "|", None, None, None), ("image", "pic", "u.png", 100.0, 56.0), ("video", "/s>", None, None, None)]), (1, 1, "assistant", None), (1, 2, "assistant", [("audio", None, "a.wav", 2.5, None), ("document", "d", "d.pdf", -1.0, None)])],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    (row,) = chat.formatted(df).collect()
    assert row["formatted"] == "<s><|user|>[INST] <\\|[ATT image]/s> [/INST]<|assistant|></s><|assistant|>[ATT audio][ATT document]</s>"
    assert [(a["kind"], a["uri"], a["n_tokens"], a["masked"]) for a in row["attachments"]] == [("image", "u.png", 8, False), ("audio", "a.wav", 63, True), ("document", "d.pdf", 1024, True)]
    assert [row["formatted"][s["begin"] : s["end"]] for s in row["loss"]] == ["", "[ATT audio][ATT document]"]
    parts = spark.createDataFrame([(t,) for t in HARD], "text string").select(chat.parts_of(F.col("text")).alias("p")).collect()
    assert ["".join(x["text"] for x in r["p"]) for r in parts] == [t or "" for t in HARD]
    kinds = [[(x["kind"], x["uri"], x["across"], x["down"]) for x in r["p"] if x["kind"] != "text"] for r in parts]
    assert kinds[15] == [("image", "https://h/x_1.png", 640.0, 480.0), ("audio", "t.mp3", 12.5, None), ("document", "d.pdf", 3.0, None)]


def test_no_turns(spark):
    assert not pieces_of(spark, []).count()


def test_all_conversations(spark, small):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet'").fetchall()
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)) for c, (turns, loss) in expected(rows).items()}
    got = {r[0]: tuple(r[1:]) for r in chat.op13_chat(spark, small).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    assert got == want
