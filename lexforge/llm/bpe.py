"""Byte-level BPE: pre-tokenisation by a transition-function scan, cached pair merging, decoding.

Each codepoint is mapped to a class, each class to a function on the states of a small automaton.
Functions compose associatively, so the state before every codepoint comes from a blocked prefix scan
in numpy, and one table says where a pre-token starts. No regular expression runs. The slices are
merged by rank, each distinct slice once per worker while the cache lasts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Slices whose tokens a worker remembers; the cache is emptied when it is full.
CACHE_SLICES = 400_000
#: Codepoints that are scanned at once (a longer text is scanned by itself) and rows handed on at once.
SCAN_CHARS, BATCH = 1 << 18, 512

# ---------------------------------------------------------------- classes and automaton

L, N, SP, WS, O, C2, C3, END = range(8)
#: The contractions of the pattern, after the apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: States: START (a new pre-token follows), in letters, in digits, in other signs, after a space, after other white space, one or two letters left of a contraction.
START, IN_L, IN_N, IN_O, AFTER_SP, AFTER_WS, LEFT1, LEFT2 = range(8)


def step(state: int, kind: int) -> int:
    """The state after a codepoint of a class."""
    if kind == END:
        return START
    if state == LEFT2:
        return LEFT1
    if state == LEFT1:
        return START
    if kind in (C2, C3):
        return IN_O if state in (IN_O, AFTER_SP) else LEFT1 if kind == C2 else LEFT2
    return {L: IN_L, N: IN_N, SP: AFTER_SP, WS: AFTER_WS, O: IN_O}[kind]


def begins(state: int, kind: int) -> bool:
    """Whether a codepoint of a class starts a pre-token; white space at the end of its run is handled apart."""
    if state in (LEFT1, LEFT2):
        return False
    if kind in (SP, WS):
        return state not in (AFTER_SP, AFTER_WS)
    if state == AFTER_SP:
        return False
    return state != {L: IN_L, N: IN_N}.get(kind, IN_O)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Functions of the classes (first eight) and all their compositions: table [function, state], product [f then g], starts [class, state], identity."""
    functions = [tuple(step(s, k) for s in range(8)) for k in range(8)] + [tuple(range(8))]
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    at = 0
    while at < len(functions):
        for g in functions[:8]:
            f = tuple(g[s] for s in functions[at])
            if f not in known:
                known[f] = len(functions)
                functions.append(f)
        at += 1
    product = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return np.array(functions, np.uint8), product, np.array([[begins(s, k) for s in range(8)] for k in range(8)]), 8


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kinds[c] = L
        elif first == "N":
            kinds[c] = N
    kinds[WHITE_SPACE] = WS
    kinds[0x20] = SP
    return kinds


def states_before(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each element, from START: an exclusive scan of composed functions in blocks."""
    table, product, _, same = monoid()
    n = len(functions)
    rows = -(-n // width)
    block = np.full(rows * width, same, np.uint16)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    for j in range(1, width):
        block[j] = product[block[j - 1], block[j]]
    total = block[-1]
    if rows > width:
        first = states_before(total, width)
    else:
        first, s = np.empty(rows, np.uint8), START
        for i, f in enumerate(total.tolist()):
            first[i] = s
            s = table[f, s]
    after = table[block, first[None, :]]
    out = np.empty((rows, width), np.uint8)
    out[:, 0] = first
    out[:, 1:] = after[:-1].T
    return out.ravel()[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: points holds the codepoints of texts, each followed by one filler at ends."""
    kind = classes()[points]
    kind[ends] = END
    quote = np.flatnonzero(points == 0x27)
    quote = quote[kind[quote] != END]
    if len(quote):
        wide = np.append(points, [0, 0, 0])
        a, b = wide[quote + 1], wide[quote + 2]
        inside = np.append(kind, [END, END, END])
        one = np.isin(a, [ord(c) for c in ONE_LETTER]) & (inside[quote + 1] != END)
        two = np.zeros(len(quote), bool)
        for x, y in TWO_LETTERS:
            two |= (a == ord(x)) & (b == ord(y))
        two &= (inside[quote + 1] != END) & (inside[quote + 2] != END)
        kind[quote[one]] = C2
        kind[quote[two]] = C3
    before = states_before(kind)
    start = monoid()[2][kind, before]
    white = (kind == SP) | (kind == WS)
    ink = ~white & (kind != END)
    start[:-1] |= white[:-1] & ink[1:]
    start[ends] = True
    return start


def split_texts(texts: list[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text, in order."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) <= SCAN_CHARS):
            group.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        whole = "\0".join(group) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in group]) - 1
        cuts = np.flatnonzero(boundaries(points, ends))
        first, marks = 0, np.searchsorted(cuts, ends).tolist()
        cuts = cuts.tolist()
        for m in marks:
            own = cuts[first : m + 1]
            yield [whole[a:b] for a, b in zip(own, own[1:], strict=False)]
            first = m + 1


# ---------------------------------------------------------------- merging


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank is joined first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 24:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[p] for p in parts]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        r = ranks.get(piece[i : end[j]]) if j < n else None
        return None if r is None else (r, i, end[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue
        alive[j] = False
        end[i] = to
        if to < n:
            before[to] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Tokens(dict):
    """slice -> its ids as decimal text with commas."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> str:
        ids = sys.intern(",".join(map(str, merge(piece.encode(), self.ranks))))
        if len(self) >= CACHE_SLICES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Ranks of a vocabulary both ways; one per worker."""

    def __init__(self, data: bytes):
        ranks = read_ranks(data)
        self.tokens = Tokens(ranks)
        self.bytes_of = {str(r): b for b, r in ranks.items()}

    def encode(self, pieces: list[str]) -> str:
        return ",".join(map(self.tokens.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_CODECS: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def vocabulary_bytes(path: str | None = None) -> bytes:
    """A rank file; by default the public one. It is read on the driver and broadcast (under 1 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


# ---------------------------------------------------------------- Spark


def encode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, offsets array<int>): tokens of whole texts; offsets are the tokens' first bytes in the UTF-8 text.

    Nulls: a null text is an empty one, which has no tokens; a null key stays. Repeated rows stay.
    Columns other than key and text are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for keys, texts in row_groups(batches):
            ids, offsets = [], []
            for pieces in split_texts(texts):
                names = own.encode(pieces).split(",") if pieces else []
                ids.append(np.array(names, np.int32))
                offsets.append(np.cumsum([0] + [len(own.bytes_of[i]) for i in names[:-1]], dtype=np.int32)[: len(names)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], [key, "ids", "offsets"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, content binary) of the ids of encode(); null ids give null."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            out = [None if ids is None else b"".join(own.bytes_of[str(i)] for i in ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "content"])

    return tokens.select(key, "ids").mapInArrow(run, f"{key} {dict(tokens.dtypes)[key]}, content binary")


def row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def token_digests(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per text: n_tokens, SHA-256 of its ids (decimal, with commas) and of the bytes that those ids decode to.

    The ids stay in the task. Columns named in keep stay beside doc_id. Nulls and repeats as in encode(); an empty text has the digest of no bytes twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for keys, texts in row_groups(batches):
            counts, coded, back = [], [], []
            for pieces in split_texts(texts):
                ids = own.encode(pieces)
                counts.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *keep).alias("key"), "text")
    found = keyed.mapInArrow(run, f"key {keyed.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.select("key.*", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
