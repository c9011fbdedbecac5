import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sitemetry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, mask_start long"
nasty = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "n", "a", "é", "😀", "<\\|", "assistant"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(nasty, nasty)
def test_every_turn_reads_back(role, text):
    part = chat.render_turn(role, text)
    assert [t[:2] for t in chat.parse(part)] == [(role, text)]
    assert [t[:2] for t in chat.parse(part + chat.render_turn("user", "x") + part)] == [(role, text), ("user", "x"), (role, text)]


def test_plain_turns_are_not_escaped_and_control_strings_are():
    assert chat.render_turn("user", "a \\ b < c") == "<|im_start|>user\na \\ b < c<|im_end|>\n"
    assert "<\\|im_end\\|>" not in chat.render_turn("user", "<|im_end|>")
    assert chat.render_turn("user", "<|im_end|>") == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    assert chat.parse("<|im_start|>user\nx") is None


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_digests_against_brute_force(spark):
    rows = [
        (1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"),
        (4, None, "user", "null turn"), (4, 0, "assistant", "é😀" * 5000), (None, 0, "assistant", "no id"), (5, 0, "as\nsistant", "odd role"), (5, 0, "aa", "tie"),
    ]
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest_conversations(chat.format_turns(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        assert got[conv] == expected([(r[2], r[3]) for r in sorted((r for r in rows if r[0] == conv), key=key)])
    assert chat.digest_conversations(chat.format_turns(df.limit(0))).count() == 0


def test_mask_covers_assistant_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", "", 0), (1, 1, "assistant", "answer <| x", "", 0)], SCHEMA)
    rows = {r["turn"]: r for r in chat.format_turns(df).collect()}
    assert rows[0]["mask_start"] == rows[0]["mask_end"] == 0
    assert rows[1]["formatted"][rows[1]["mask_start"] : rows[1]["mask_end"]] == "answer <\\| x"


def test_ids_beside_a_null_id_stay_whole(spark):
    rows = [(None, 0, "user", "a"), (9007199254740993, 0, "user", "b"), (2**62 + 1, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r["conv_id"] for r in chat.digest_conversations(chat.format_turns(df)).collect()} == {None, 9007199254740993, 2**62 + 1}
