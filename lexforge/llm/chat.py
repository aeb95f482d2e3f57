"""Chat formatting of typed content parts: texts, images, audio and documents become one string of marked turns.

A visitor flattens the parts of a message: texts are escaped, attachments become ordered placeholders, and each
one's reference, place and expanded token count are recorded. Texts of trained roles lie under a loss mask.

Control strings inside texts are escaped by a backslash behind their first character; where backslashes are there
already, one more is added. Unescaping takes one away again, so any text comes back as it was, and texts without control strings
are not changed. Template.check() makes sure that no control string overlaps another, so that no match hides another one.

Formatting is done row by row, without a shuffle: a conversation is its rows' pieces in the order of their turns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexforge.llm import bpe

#: Pixels of a patch's side, patches of an image of unknown size; tokens a second of audio, of audio of unknown length; tokens of a document's page.
PATCH, IMAGE_TOKENS, AUDIO_RATE, AUDIO_TOKENS, PAGE_TOKENS = 28, 256, 25, 750, 256
#: Bytes that a token of text stands for where no vocabulary is given.
TOKEN_BYTES = 4
BATCH = 256

#: What a message's column of parts may hold; every field but type may be missing or null.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Template:
    """The control strings of a format. guarded are those of other formats, which texts may not carry in either."""

    turn_open: str = "<|im_start|>"
    header_end: str = "<|im_sep|>"
    turn_close: str = "<|im_end|>"
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    document_close: str = "<|/document|>"
    other: str = "<|attachment|>"
    guarded: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def strings(self) -> list[str]:
        return [self.turn_open, self.header_end, self.turn_close, *self.placeholders.values(), self.document_close, self.other, *self.guarded]

    def check(self) -> Template:
        """Raise ValueError where control strings could hide each other or have a backslash."""
        every = self.strings()
        for a in every:
            if len(a) < 2 or "\\" in a or every.count(a) > 1:
                raise ValueError(f"control string {a!r} is too short, repeated or has a backslash")
            for b in every:
                if (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        return self


class Escapes:
    """Escaping and unescaping of a template's control strings."""

    def __init__(self, strings: list[str]):
        longest = sorted(strings, key=len, reverse=True)
        self.plain = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in longest))
        self.escaped = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in longest))

    def escape(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)


def estimated_tokens(text: str) -> int:
    return -(-len(text.encode()) // TOKEN_BYTES)


class Flatten:
    """Visitor of one message's parts: the body of its turn, attachments, loss spans and tokens."""

    def __init__(self, template: Template, escapes: Escapes, count: Callable[[str], int], begin: int, trained: bool):
        self.template, self.escapes, self.count, self.trained = template, escapes, count, trained
        self.out, self.at, self.tokens = [], begin, 0
        self.attachments: list[dict] = []
        self.loss: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def _add(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def _attach(self, part: dict, mark: str, tokens: int) -> None:
        self.attachments.append({"kind": part["type"], "ref": part.get("ref"), "offset": self.at, "tokens": tokens})
        self.tokens += tokens
        self._add(mark)

    def visit_text(self, part: dict) -> None:
        text = self.escapes.escape(part.get("text") or "")
        if text:
            if self.trained:
                self.loss.append({"start": self.at, "stop": self.at + len(text)})
            self.tokens += self.count(text)
            self._add(text)

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width"), part.get("height")
        self._attach(part, self.template.placeholders["image"], math.ceil(w / PATCH) * math.ceil(h / PATCH) if w and h else IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self._attach(part, self.template.placeholders["audio"], AUDIO_TOKENS if seconds is None else math.ceil(seconds * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        """A document's own text stands between its marks, outside the loss mask; pages are counted on top."""
        self._attach(part, self.template.placeholders["document"], (part.get("pages") or 0) * PAGE_TOKENS)
        text = self.escapes.escape(part.get("text") or "")
        self.tokens += self.count(text) if text else 0
        self._add(text)
        self._add(self.template.document_close)

    def visit_other(self, part: dict) -> None:
        """A type that is not known is kept as an attachment of one token."""
        self._attach(part, self.template.other, 1)


class Reader:
    """Turns and parts of formatted text."""

    def __init__(self, template: Template):
        self.template, self.escapes = template, Escapes(template.strings())
        t = [re.escape(s) for s in (template.turn_open, template.header_end, template.turn_close)]
        self.turn = re.compile(f"{t[0]}(.*?){t[1]}(.*?){t[2]}", re.S)
        marks = [*template.placeholders.values(), template.other]
        self.mark = re.compile("(" + "|".join(map(re.escape, marks)) + ")|" + re.escape(template.document_close))

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, body) of each turn; ValueError where something stands outside of turns."""
        at = 0
        for m in self.turn.finditer(formatted):
            if m.start() != at:
                raise ValueError(f"no turn at {at}")
            at = m.end()
            yield self.escapes.unescape(m[1]), m[2]
        if at != len(formatted):
            raise ValueError(f"no turn at {at}")

    def parts(self, body: str, attachments: Iterator[dict]) -> Iterator[dict]:
        """The parts of a body, texts side by side as one; attachments are those of formatted text, in order."""
        at, inside = 0, None
        for m in [*self.mark.finditer(body), None]:
            text = self.escapes.unescape(body[at : len(body) if m is None else m.start()])
            if inside is not None:
                inside["text"] = text or None
                yield inside
                inside = None
            elif text:
                yield {"type": "text", "text": text}
            if m is None:
                return
            at = m.end()
            if m[1]:
                a = next(attachments)
                part = {"type": a["kind"], "ref": a["ref"]}
                if m[1] == self.template.placeholders["document"]:
                    inside = part
                else:
                    yield part

    def text(self, body: str) -> str:
        """The text parts of a body."""
        return "".join(p["text"] for p in self.parts(body, iter(lambda: {"kind": "", "ref": None}, None)) if p["type"] == "text")


ATTACHMENTS = "array<struct<kind:string,ref:string,offset:bigint,tokens:bigint>>"
LOSS = "array<struct<start:bigint,stop:bigint>>"
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())]))
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def format_turns(messages: DataFrame, template: Template | None = None, parts: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, turn, formatted, attachments, loss, n_tokens) of every row of messages (conv_id, turn, role, and text or a column of parts).

    attachments and loss count code points from the piece's start; tokens are an attachment's expanded ones. n_tokens has the piece's:
    those of its texts (by the ranks of a vocabulary file, else one for TOKEN_BYTES bytes), its attachments', and one for each control string of the turn.
    Nulls: a null text, role, list of parts or part is empty; a null type is text; null conv_id and turn stay. Unknown types are
    kept as attachments. Repeated rows are turns of their own. Texts may be of any length. Other columns are not read. An empty table gives an empty result.
    """
    template = (template or Template()).check()
    shared = None if vocabulary is None else messages.sparkSession.sparkContext.broadcast(bpe.vocabulary_bytes(vocabulary))

    def count(text: str) -> int:
        if shared is None:
            return estimated_tokens(text)
        ids = bpe.codec(shared.value).encode(next(iter(bpe.split_texts([text]))))
        return ids.count(",") + 1 if ids else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes = Escapes(template.strings())
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                out = []
                for role, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    header = template.turn_open + escapes.escape(role or "") + template.header_end
                    flat = Flatten(template, escapes, count, len(header), role in template.trained)
                    for part in [{"type": "text", "text": content}] if parts is None else content or []:
                        flat.visit(part)
                    tokens = 3 + (count(role) if role else 0) + flat.tokens
                    out.append((header + "".join(flat.out) + template.turn_close, flat.attachments, flat.loss, tokens))
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), _ATTACHMENTS, _LOSS, pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["conv_id", "turn", "formatted", "attachments", "loss", "n_tokens"])

    kinds = dict(messages.dtypes)
    rows = messages.select("conv_id", "turn", "role", parts or "text")
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, attachments {ATTACHMENTS}, loss {LOSS}, n_tokens long")


def _in_order(pieces: DataFrame) -> DataFrame:
    """Pieces of a conversation one behind the other, sorted by Spark: by turn, nulls first, and what is formatted."""
    order = ["conv_id", F.asc_nulls_first("turn"), "formatted"]
    return pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "attachments", "loss", "n_tokens")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, pieces) one conversation after the other; its pieces are read as they are asked for."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, BATCH) for row in zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def own(conv: object = conv) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1:]
                ahead = next(rows, None)

        pieces = own()
        yield conv, pieces
        for _ in pieces:  # what was not asked for
            pass


def format_conversations(messages: DataFrame, template: Template | None = None, parts: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, formatted, attachments, loss, n_tokens): one string per conversation, its turns in order, with places counted from its start.

    For conversations that a row can hold; longer ones are read as the pieces of format_turns(). Nulls and ties as there: null turns come
    first, rows of one turn by role and text.
    """
    pieces = format_turns(messages, template, parts, vocabulary)
    kind = to_arrow_type(pieces.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in _conversations(batches):
            text, at, attachments, loss, tokens = [], 0, [], [], 0
            for piece, attached, spans, n in own:
                attachments += [a | {"offset": a["offset"] + at} for a in attached]
                loss += [{"start": s["start"] + at, "stop": s["stop"] + at} for s in spans]
                text.append(piece)
                at, tokens = at + len(piece), tokens + n
            cols = [pa.array([v], k) for v, k in ((conv, kind), ("".join(text), pa.string()), (attachments, _ATTACHMENTS), (loss, _LOSS), (tokens, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "formatted", "attachments", "loss", "n_tokens"])

    return _in_order(pieces).mapInArrow(run, f"conv_id {dict(pieces.dtypes)['conv_id']}, formatted string, attachments {ATTACHMENTS}, loss {LOSS}, n_tokens long")


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """What format_turns() has written, by conversation: n_turns, turns_sha256 (role, line break, text, line break of each turn), loss_chars and loss_sha256
    (text under the loss mask, unescaped), formatted_chars, n_attachments, n_tokens.

    A conversation streams through its task piece by piece, in order, and leaves running digests only. Texts are those of text parts.
    """
    template = (template or Template()).check()
    kind = to_arrow_type(pieces.schema["conv_id"].dataType)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"]

    def told(reader: Reader, own: Iterator[tuple]) -> tuple:
        turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0] * 5
        for piece, attached, spans, tokens in own:
            n = 0
            for role, body in reader.turns(piece):
                n += 1
                turns.update(f"{role}\n{reader.text(body)}\n".encode())
            learnt = [reader.escapes.unescape(piece[s["start"] : s["stop"]]) for s in spans]
            loss.update("".join(learnt).encode())
            sums = [a + b for a, b in zip(sums, (n, sum(map(len, learnt)), len(piece), len(attached), tokens), strict=True)]
        return sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), *sums[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(template), []

        def batch() -> pa.RecordBatch:
            kinds = [kind, *[pa.string() if n.endswith("sha256") else pa.int64() for n in names]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["conv_id", *names])

        for conv, own in _conversations(batches):
            held.append((conv, *told(reader, own)))
            if len(held) >= 4096:
                yield batch()
                held = []
        if held:
            yield batch()

    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return _in_order(pieces).mapInArrow(run, f"conv_id {dict(pieces.dtypes)['conv_id']}, {schema}")


#: A conversation whose texts hold control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_turns(rows.union(spark.createDataFrame(PROBE, rows.schema))))


#: The same by patterns; the backslash is chr(92).
OP11_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (SELECT *,
    regexp_replace(regexp_replace(text, '(<)(\\*(?:\|(?:im_start|im_sep|im_end|image|audio|document|/document|attachment|endoftext)\|>|/?s>|</?SYS>>))', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS t,
    regexp_replace(regexp_replace(role, '(<)(\\*(?:\|(?:im_start|im_sep|im_end|image|audio|document|/document|attachment|endoftext)\|>|/?s>|</?SYS>>))', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS r FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(r) + 10 + length(t) + 10)::BIGINT AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments,
  sum(3 + (strlen(role) + 3) // 4 + (strlen(t) + 3) // 4)::BIGINT AS n_tokens
FROM escaped GROUP BY conv_id
"""
