import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "a", "\n", "|", "s>", "é"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(x in shown for x in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), pieces), min_size=1, max_size=6))
def test_examples_hold_all_turns_and_mask_each_reply_once(turns):
    made = list(chat.examples(turns))
    assert list(chat.read_turns(made[-1][1])) == turns
    replies = [chat.unescape(text[start : start + n]) for k, text, start, n in made if turns[k - 1][0] == "assistant"]
    assert replies == [t for r, t in turns if r == "assistant"]
    assert all(n == 0 for k, _, _, n in made if turns[k - 1][0] != "assistant")
    assert [k for k, *_ in made] == [k for k, (r, _) in enumerate(turns, 1) if r == "assistant" or k == len(turns)]


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 0, "user", ""), (None, 0, "assistant", "n"),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    got = {r.conv_id: r for r in chat.digests(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi\nassistant\n\n\nx\n") and got[1].n_examples == 2
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == sha("") and got[2].n_examples == 1
    assert got[None].loss_chars == 1 and got[3].n_turns == 2 and got[3].loss_sha256 == sha("samesame")


def test_empty_table(spark):
    assert chat.digests(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", [chat.PROBE, "\\</s>", "<\\/s>"])
def test_probe(text):
    assert chat.unescape(chat.escape(text)) == text
