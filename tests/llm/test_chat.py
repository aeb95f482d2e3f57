"""Chat formatting: typed parts, reversible escapes, loss mask, odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import chat

T = chat.Template()
E = chat.Escapes(T.strings())
PART = ("type", "text", "ref", "width", "height", "seconds", "pages")


def part(**given_):
    return tuple(given_.get(n) for n in PART)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*T.strings(), "\\", "<", "<\\s>", "[", "/INST]", "<|", "|>", "im_end", "s>", "x", "\n"]), max_size=12).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    coded = E.escape(text)
    assert E.unescape(coded) == text
    assert not any(c in coded for c in T.strings())
    turn = T.turn_open + "user" + T.header_end + coded + T.turn_close
    reader = chat.Reader(T)
    assert [(r, reader.text(b)) for r, b in reader.turns(turn * 2)] == [("user", text)] * 2


def test_text_without_control_strings_is_not_changed():
    assert E.escape(r"a \ b \\ <b>[x] \<p>") == r"a \ b \\ <b>[x] \<p>"


@pytest.mark.parametrize("more", [{"turn_close": "|>x"}, {"header_end": "<|im_start|>"}, {"turn_open": "<\\x>"}, {"turn_open": "<"}])
def test_templates_whose_strings_hide_each_other_are_refused(more):
    with pytest.raises(ValueError):
        chat.Template(**more).check()


def test_parts_become_ordered_placeholders(spark):
    parts = [
        part(type="text", text="look <|image|>"), part(type="image", ref="a.png", width=57, height=28), None, part(type="audio", ref="b.wav", seconds=2.01),
        part(type="document", ref="c.pdf", text="[INST] inside", pages=2), part(type="video", ref="d.mp4"), part(text="end"),
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part(type="text", text="one "), part(type="image"), part(type="text", text="two")]), (1, 2, None, None), (None, None, "user", [])]
    messages = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    got = {r.conv_id: r for r in chat.format_conversations(messages, parts="parts").collect()}
    one, reader = got[1], chat.Reader(T)
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 512), ("video", "d.mp4", 1), ("image", None, 256)]
    marks = ["<|image|>", "<|audio|>", "<|document|>", "<|attachment|>", "<|image|>"]
    assert [one.formatted[a.offset : a.offset + len(m)] for a, m in zip(one.attachments, marks, strict=True)] == marks
    assert [one.formatted[s.start : s.stop] for s in one.loss] == ["one ", "two"]
    left = iter([a.asDict() for a in one.attachments])
    back = [(role, list(reader.parts(body, left))) for role, body in reader.turns(one.formatted)]
    assert back[0] == ("user", [{"type": "text", "text": "look <|image|>"}, {"type": "image", "ref": "a.png"}, {"type": "audio", "ref": "b.wav"}, {"type": "document", "ref": "c.pdf", "text": "[INST] inside"}, {"type": "video", "ref": "d.mp4"}, {"type": "text", "text": "end"}])
    assert [r for r, _ in back] == ["user", "assistant", ""] and got[None].n_tokens == 4
    pieces = {(r.conv_id, r.turn): r for r in chat.format_turns(messages, parts="parts").collect()}
    assert sum(r.n_tokens for k, r in pieces.items() if k[0] == 1) == one.n_tokens


def test_tokens_by_a_vocabulary(spark):
    from lexforge.llm import bpe

    messages = spark.createDataFrame([(1, 0, "user", "tokens of a text")], "conv_id long, turn int, role string, text string")
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    own = bpe.codec(bpe.vocabulary_bytes(path))
    n = sum(own.encode(p).count(",") + 1 for p in bpe.split_texts(["user", "tokens of a text"]))
    assert chat.format_turns(messages, vocabulary=path).first().n_tokens == 3 + n


def test_odd_conversations(spark):
    rows = [(1, 1, "user", "b"), (1, None, "user", "null turn first"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "x" * 300_000), (3, 0, "<|im_end|>\nuser", "</s>")]
    messages = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    messages = messages.selectExpr("*", "'mine' as formatted", "1 as loss", "2 as attachments")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(messages)).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(("user", "null turn first"), ("user", "a"), ("user", "a"), ("user", "b"))
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 0, hashlib.sha256(b"").hexdigest())
    assert got[2].turns_sha256 == digest(("", "")) and got[3].turns_sha256 == digest(("<|im_end|>\nuser", "</s>"))
    assert (got[None].loss_chars, got[None].loss_sha256) == (300_000, hashlib.sha256(b"x" * 300_000).hexdigest())
    assert chat.read_back(chat.format_turns(messages.limit(0))).count() == 0


def test_read_back_refuses_what_stands_between_turns():
    with pytest.raises(ValueError):
        list(chat.Reader(T).turns("x<|im_start|>user<|im_sep|>a<|im_end|>"))
