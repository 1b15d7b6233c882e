import hashlib
import random

from tidewindow.llm import chat as C


def test_round_trip_and_mask(spark):
    random.seed(6)
    pieces = ["\\", "#", "###", "</turn>", " </turn>\n", "\n", ": ", "<|", "|>", "h", "b", "\\b", "\\h", "é", "ok", "### user: ", "\\n", "\\c"]
    make = lambda: "".join(random.choices(pieces, k=random.randrange(8)))
    roles = ["user", "assistant", "system", None, "", "as:sis\ntant", "###"]
    rows = [(c, t, random.choice(roles), random.choice([make(), make(), make(), None])) for c in range(60) for t in range(random.randrange(1, 6))]
    rows += [(100, 0, "user", "x"), (100, 0, "user", "x"), (100, 0, "assistant", "y"), (None, None, "assistant", "z"), (101, 0, "assistant", "long " * 100_000)]
    rows += [(102, i, "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.select("conv_id", "turn", "role", C.text_part(df.text).alias("parts"), C.F.lit(1).alias("formatted"))
    out = C.read_back(C.format_chats(turns)).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    assert len(out) == len(by)
    for r in out:
        want = [(a, b) for _, _, a, b in sorted(by[r.conv_id], key=lambda x: (x[0], x[1] or 0, x[2], x[3].encode()))]
        if r.conv_id == 100:
            want = [("assistant", "y"), ("user", "x"), ("user", "x")]
        assert [(t.role, t.text) for t in r.turns] == want and r.n_turns == len(want) and len(r.formatted) == r.formatted_chars
        assert r.loss_text == "".join(x for a, x in want if a == "assistant") and r.attachments == []
        if r.conv_id in (100, 101, 102):
            assert r.loss_text == "".join(x for a, x in want if a == "assistant")
        assert r.formatted.count("</turn>") == r.n_turns


def test_attachments(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", None), None, ("audio", None, "b.wav", 40), ("text", None, None, None), ("video", None, "c", None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [("document", None, "d.pdf", 7)])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    r = C.read_back(C.format_chats(df)).collect()[0]
    assert r.formatted == "### user: see \\pimage|> <|image:1|><|audio:2|><|video:3|>end </turn>\n### assistant:  </turn>\n### user: <|document:1|> </turn>\n"
    assert [tuple(a) for a in r.attachments] == [(1, 0, 1, "image", "a.png", 576), (2, 0, 2, "audio", "b.wav", 40), (3, 0, 3, "video", "c", 0), (4, 2, 1, "document", "d.pdf", 7)]
    assert [tuple(p) for p in r.turns[0].parts] == [("text", "see <|image|> ", None), ("image", None, 1), ("audio", None, 2), ("video", None, 3), ("text", "end", None)]
    assert r.expanded_tokens == 623 and r.loss_text == "" and C.format_chats(df.limit(0)).collect() == []


def test_round_trip_of_mixed_parts(spark):
    """Hostile texts and types between attachments; the loss has the assistant's texts alone."""
    rng = random.Random(12)
    texts = ["", "<|image:1|>", "<|", "|>", ":", "\\p", "\\", "a|>b", "</turn>", " </turn>\n### user: ", "é", None]
    kinds = ["image", "audio", "a|b", "<|x|>", "we:ird\n", "|>", "\\v", "###"]
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 4)):
            parts = [("text", rng.choice(texts) , None, None) if rng.random() < 0.6 else (rng.choice(kinds), None, f"r{rng.random()}", 3) for _ in range(rng.randrange(6))]
            rows.append((c, t, rng.choice(["user", "assistant"]), parts))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    for r in C.read_back(C.format_chats(df)).collect():
        mine, loss, refs = [x for x in rows if x[0] == r.conv_id], "", []
        for (_, t, role, parts), got in zip(mine, r.turns, strict=True):
            want, n = [], 0
            for kind, text, ref, _ in parts:
                if kind != "text":
                    n += 1
                    want.append((kind, None, n))
                    refs.append((t, n, kind, ref))
                elif text and want and want[-1][0] == "text":
                    want[-1] = ("text", want[-1][1] + text, None)
                elif text:
                    want.append(("text", text, None))
            assert got.role == role and [tuple(p) for p in got.parts] == want
            said = "".join(x for k, x, _ in want if k == "text")
            assert got.text == said
            loss += said * (role == "assistant")
        assert r.loss_text == loss and [(a.turn, a.number, a.type, a.ref) for a in r.attachments] == refs and r.expanded_tokens == 3 * len(refs)
    assert C.read_back(C.format_chats(df.limit(0))).collect() == []


def test_query_is_native(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "ä\\###")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = C.op5_chat_formatting(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    got = {r.conv_id: r for r in df.collect()}
    text = "\\### Assistant: </turn> ok"
    assert got[-7].loss_chars == len(text) and got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\nq\nassistant\nä\\###\n".encode()).hexdigest() and got[1].loss_chars == 5
