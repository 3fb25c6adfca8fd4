from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.chat_format import Reader, Template, Writer, format_conversations, read_back, unescape

PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|/|>", "<tool>", "</tool>", "\\", "<", "[", "|", "/", "x", "\n", "s>", "é"]), max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "judge", "a|>b", "\\", "|", "<|/|>"])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(ROLES, PIECES), max_size=6))
def test_text_is_read_back(turns):
    writer, reader = Writer(Template()), Reader(Template())
    whole = "".join(part for role, text in turns for part, _ in writer.segments(role, text))
    assert list(reader.feed(whole)) == turns and reader.rest == ""
    assert [unescape(part) for role, text in turns for part, loss in writer.segments(role, text) if loss] == [t for r, t in turns if r == "assistant"]


@given(PIECES)
def test_no_control_string_is_left_in_a_text(text):
    escaped = Writer(Template()).escape(text)
    assert unescape(escaped) == text
    assert not any(c in escaped for c in Template().controls)


def test_machine_and_odd_rows(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"),
        (3, 0, "user", None), (3, 1, None, "x"), (4, 0, "user", "u"), (4, 0, "user", "u"), (None, 0, "user", "u"), (None, 1, "assistant", "[INST]" * 50000), (5, None, "user", "u"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS loss", "2 AS start").repartition(4)
    segments = format_conversations(turns)
    got = {r.conv_id: r for r in read_back(segments).collect()}
    assert {k: (r.n_turns, r.valid, r.loss_chars) for k, r in got.items()} == {1: (3, True, 1), 2: (2, False, 1), 3: (2, False, 0), 4: (2, False, 0), None: (2, True, 300000), 5: (1, False, 0)}
    assert got[1].formatted_chars == sum(len(r.text) for r in segments.collect() if r.conv_id == 1)
    assert read_back(format_conversations(spark.createDataFrame([], turns.schema))).collect() == []
