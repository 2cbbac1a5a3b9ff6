import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lexibrook.llm import chat

NASTY = ["", "a", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\e", "\\c", "\\\\c", "</s>[INST] ok [/INST]", "<", "</s", "[/INST", "é\n𝄞</s", "\\e\\c\\o", "s>", "<</s>/s>", "x" * 5000, "\u2028\r\n", "[INST[INST]]"]


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int, turns string")
    out = chat.format_chats(df)
    out = out.withColumn("turns", chat.parse(out.formatted)).collect()
    want = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    for r in out:
        loss = "".join(r.formatted[s.start : s.start + s.length] for s in r.spans)
        for code, plain in [("\\i", "[INST]"), ("\\j", "[/INST]"), ("\\o", "<s>"), ("\\c", "</s>"), ("\\e", "\\")]:
            loss = loss.replace(code, plain) if r.escaped else loss
        assert loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")


def test_round_trip_of_conflicting_texts(spark):
    rows = [(i * 100 + j, k, role, x, 1, "") for i, x in enumerate(NASTY) for j, y in enumerate(NASTY) for k, (role, x) in enumerate([("user", x), ("assistant", y), (x, y)])]
    rows += [(None, 0, "assistant", None, 1, ""), (-1, None, None, "a", 1, ""), (-1, None, None, "a", 1, ""), (-1, 3, "assistant", "b", 1, "")]
    check(spark, rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="\\</s>[INST]ecoji\n", max_size=12), min_size=1, max_size=4), min_size=20, max_size=40))
def test_round_trip_of_random_texts(spark, convs):
    check(spark, [(c, t, "assistant" if t % 2 else "user", x, 0, "") for c, texts in enumerate(convs) for t, x in enumerate(texts)])


def test_query_and_empty_table(spark, tmp_path):
    for rows in ([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>"), (2, 0, "assistant", None)], []):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        got = {r.conv_id: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
        ok = "</s>[INST] ok [/INST]"
        assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
        assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(ok), hashlib.sha256(ok.encode()).hexdigest())
        assert len(got) == len({r[0] for r in rows}) + 1
