"""Hidden Markov language model: Baum-Welch counts from all partitions, exact scoring by scaled forward recursion.

Every token has a symbol: the SYMBOLS most frequent words have one of their own, any other word shares
one of a fixed number of spelling classes. A hidden state emits symbols, and a class emits a word by its
training count (add-SMOOTH, with room for one unseen word), so

    P(text) = sum over state paths of prod A[s', s] * B[s, symbol]   *   prod P(word | class).

The first factor needs only the bounded model, which is broadcast. The second is a sum over tokens:
counts of the LOOKUP most frequent words are broadcast too, all rarer words go through a join with the
whole vocabulary. No word is hot in that join, as the frequent ones never reach it.

Texts are cut into words twice: for the vocabulary, and to write each text's symbols as a table. Every pass of
Baum-Welch reads the symbols of all training texts, starting from the corpus' shares with seeded noise.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import materialize

#: Bounds of what is broadcast: words with a symbol of their own, words whose counts a task looks up.
SYMBOLS, LOOKUP = 1 << 14, 1 << 18
STATES, ITERATIONS, SEED = 8, 8, 17
LENGTHS, ENDINGS = 8, 8
CLASSES = LENGTHS * ENDINGS
SMOOTH = 0.1
#: Tokens by which a state's emissions are drawn to the corpus' shares.
LEAN = 100.0
#: Training counts texts in windows of CORE tokens side by side (scoring doesn't). Each window runs over LEAD tokens more on both sides, whose own counts belong to its neighbours, so the chain and every transition go on over its ends.
CORE, LEAD = 128, 8
#: Windows are padded to one of these lengths. Tokens of a block in training and in scoring (where long texts run beside many others); words a task counts before it hands them on.
PADDED, BLOCK, SCORE_BLOCK, FLUSH = (16, 32, 64, CORE + 2 * LEAD), 1 << 18, 1 << 20, 200_000
BATCH = 512
END = ""  # no word is empty


def words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) runs of anything but U+0020 and U+0009..U+000D, then the end."""
    return [w.decode() for w in raw_words(text.encode() if text else None)] + [END]


def raw_words(data: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, without the end: bytes know no other letters and white space than these."""
    return data.lower().split() if data else []


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0 if doc_id is not None else False


def spelling(word: str) -> int:
    """Class of a word without a symbol: its length and its last two characters."""
    return (min(len(word), LENGTHS) - 1) * ENDINGS + zlib.crc32(word[-2:].encode()) % ENDINGS


# ---------------------------------------------------------------- vocabulary


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c): counts of all training tokens; a task adds up what it can hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "c"])
            seen.clear()
            return rows

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not is_held_out(k):
                    seen.update(raw_words(t.as_py()))
                    seen[b""] += 1
                    if len(seen) >= FLUSH:
                        yield out()
        yield out()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The bounded part of the vocabulary: words in order of count, symbols, class totals."""

    def __init__(self, vocab: DataFrame):
        top = vocab.orderBy(F.desc("c"), "word").limit(LOOKUP).toArrow()
        self.words, self.counts = top.column(0).to_pylist(), top.column(1).to_pylist()
        own = self.words[:SYMBOLS]
        if END not in own:
            own = [*own, END]
        self.own = own
        totals = vocab.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        self.types, self.tokens = totals
        # class totals of all words without a symbol, in the JVM: crc32 and lengths as in spelling()
        other = vocab.join(F.broadcast(vocab.sparkSession.createDataFrame([(w,) for w in own], "word string")), "word", "left_anti")
        n = F.char_length("word")
        tail = F.expr("substring(word, greatest(char_length(word) - 1, 1), 2)")
        kind = (F.least(n, F.lit(LENGTHS)) - 1) * ENDINGS + F.crc32(tail.cast("binary")) % ENDINGS
        sums = {int(r[0]): (r[1], r[2]) for r in other.groupBy(kind.alias("k")).agg(F.sum("c"), F.count("*")).collect()}
        self.class_tokens = np.array([sums.get(k, (0, 0))[0] for k in range(CLASSES)], float)
        self.class_types = np.array([sums.get(k, (0, 0))[1] for k in range(CLASSES)], float)

    def symbol_counts(self) -> np.ndarray:
        """Training tokens of each symbol."""
        known = dict(zip(self.words[: len(self.own)], self.counts[: len(self.own)], strict=True))
        return np.concatenate([[known.get(w, 0) for w in self.own], self.class_tokens]).astype(float)

    def base_log(self, c):
        return np.log10((np.asarray(c, float) + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def tables(self) -> dict:
        """What tasks need: word -> (symbol, count), with the logs of both models."""
        own = {w: i for i, w in enumerate(self.own)}
        names, counts = list(self.words), list(self.counts)
        if END not in self.words:
            names, counts = [*names, END], [*counts, 0]
        below = np.log10(self.class_tokens + SMOOTH * (self.class_types + 1))
        symbols = np.array([own[w] if w in own else len(own) + spelling(w) for w in names], np.int32)
        inner = np.log10(np.array(counts, float) + SMOOTH) - below[np.maximum(symbols - len(own), 0)]
        inner[symbols < len(own)] = 0.0
        return {"place": {w.encode(): i for i, w in enumerate(names)}, "symbol": symbols, "base": self.base_log(counts), "inner": inner, "known": np.array(counts) > 0, "own": len(own)}


# ---------------------------------------------------------------- the chain


def start_model(counts: np.ndarray, states: int = STATES, seed: int = SEED) -> dict:
    """The corpus' shares of the symbols in every state, with seeded noise so that states part; states rather stay."""
    rng = np.random.default_rng(seed)
    a = rng.dirichlet(np.full(states, 50.0), states) + 9 * np.eye(states)
    b = (counts + 1.0) * (rng.gamma(1.0, size=(states, len(counts))) + 0.05)
    return {"pi": np.full(states, 1 / states), "a": a / a.sum(1, keepdims=True), "b": b / b.sum(1, keepdims=True)}


def updated(pi: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> dict:
    """The model of expected counts. Each state leans on the corpus' own shares, so no symbol is impossible."""
    share = (emitted.sum(0) + 1.0) / (emitted.sum() + emitted.shape[1])
    pi, a, b = pi + 1.0, moves + 1.0, emitted + LEAN * share
    return {"pi": pi / pi.sum(), "a": a / a.sum(1, keepdims=True), "b": b / b.sum(1, keepdims=True)}


def counts_of(model: dict, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions of whole texts, window by window, all windows of one padded length together."""
    lengths = np.array([len(t) for t in texts])
    flat, begin = np.concatenate(texts).astype(np.int64), np.cumsum(lengths) - lengths
    many = -(-lengths // CORE)
    text = np.repeat(np.arange(len(texts)), many)
    core = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * CORE
    low, high = np.maximum(core - LEAD, 0), np.minimum(core + CORE + LEAD, lengths[text])
    own = np.minimum(CORE, lengths[text] - core)
    s = len(model["a"])
    pi, moves, emitted = np.zeros(s), np.zeros((s, s)), np.zeros((s, model["b"].shape[1]))
    size = np.searchsorted(PADDED, high - low)
    for k in np.unique(size):
        w = np.flatnonzero(size == k)
        add_counts(model, flat, begin[text[w]] + low[w], (high - low)[w], (core - low)[w], own[w], PADDED[k], core[w] == 0, pi, moves, emitted)
    return pi, moves, emitted


def add_counts(model: dict, flat, at, span, lead, own, width: int, first, pi, moves, emitted) -> None:
    """Add to pi, moves and emitted what windows of span tokens from `at` count in their own tokens, which follow lead others."""
    a, bt = model["a"].astype(np.float32), np.ascontiguousarray(model["b"].T, np.float32)
    t = np.arange(width)[:, None]
    sym = flat[np.minimum(at + t, len(flat) - 1)]
    emit = bt[sym]
    emit[t >= span] = 1.0  # beyond a window's end nothing is seen, which changes nothing before it
    inside = (t >= lead) & (t < lead + own)
    alpha, scale = np.empty_like(emit), np.empty(sym.shape, np.float32)
    for i in range(width):
        now = (np.where(first[:, None], model["pi"], a.mean(0)).astype(np.float32) if i == 0 else alpha[i - 1] @ a) * emit[i]
        scale[i] = now.sum(1)
        alpha[i] = now / scale[i][:, None]
    beta, total = np.ones(emit.shape[1:], np.float32), np.zeros(a.shape)
    for i in range(width - 1, -1, -1):
        after = emit[i] * beta / scale[i][:, None]
        if i:
            total += alpha[i - 1].T @ (after * inside[i][:, None])
        alpha[i] *= beta
        beta = after @ a.T
    moves += a * total
    seen, post = sym[inside], alpha[inside]
    for k in range(len(a)):
        emitted[k] += np.bincount(seen, post[:, k], emitted.shape[1])
    pi += alpha[0][first].sum(0, dtype=float)


def forward(model: dict, texts: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole symbol sequence, by the scaled forward recursion, texts side by side."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    a, bt = model["a"], np.ascontiguousarray(model["b"].T)
    out, now = np.zeros(len(texts)), None
    cut = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([texts[i] for i in order])
    for t in range(int(lengths[0]) if len(lengths) else 0):
        m = int(np.searchsorted(-lengths, -t, "left"))
        e = bt[flat[cut[:m] + t]]
        now = model["pi"] * e if now is None else (now[:m] @ a) * e
        z = now.sum(1)
        now /= z[:, None]
        out[:m] += np.log10(z)
    back = np.empty(len(texts))
    back[order] = out
    return back


def train(rows: DataFrame, lexicon: Lexicon, iterations: int = ITERATIONS, states: int = STATES) -> dict:
    """Baum-Welch over the symbols of all training texts: each pass adds up every task's expected counts, by symbol."""
    spark = rows.sparkSession
    symbols = len(lexicon.own) + CLASSES
    model = start_model(lexicon.symbol_counts(), states)
    names = [f"s{i}" for i in range(states)]
    texts = rows.where(~F.col("held_out")).select("symbols")
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            sums = [np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))]
            held, size = [], 0

            def settle() -> None:
                for total, part in zip(sums, counts_of(now, held), strict=True):
                    total += part
                held.clear()

            for batch in batches:
                for t in batch.column(0):
                    held.append(np.frombuffer(t.as_py(), "<u2"))
                    size += len(held[-1])
                    if size >= BLOCK:
                        settle()
                        size = 0
            if held:
                settle()
            pi, moves, emitted = sums
            seen = np.flatnonzero(emitted.any(0))
            kinds = np.concatenate([np.full(1, -1), -2 - np.arange(states), seen])
            values = np.concatenate([pi[None, :], moves, emitted[:, seen].T])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), *[pa.array(values[:, i]) for i in range(states)]], ["symbol", *names])

        sums = texts.mapInArrow(run, "symbol long, " + ", ".join(f"{n} double" for n in names))
        found = sums.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # as many rows as symbols
        counts = np.zeros((symbols + 1 + states, states))
        if found.num_rows:
            counts[found.column(0).to_numpy()] = np.stack([found.column(i + 1).to_numpy() for i in range(states)], 1)
        model = updated(counts[-1], counts[-2 : -2 - states : -1], counts[:symbols].T)
        shared.unpersist()
    return model


_LOADED: dict[int, dict] = {}


def loaded(shared) -> dict:
    """A broadcast table, unpickled once in a worker."""
    key = zlib.crc32(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = pickle.loads(shared.value)
    return _LOADED[key]


class Places(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row per text: row, doc_id, held_out, n_tokens, symbols (two bytes each), and sums over its words that the broadcast table knows; the others in rare, times."""
    tables = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon.tables()))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary, rare array<string>, times array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(tables)
        place = Places(table["place"]).__getitem__

        def one(data: bytes | None) -> tuple:
            tokens = raw_words(data)
            tokens.append(b"")
            at = np.fromiter(map(place, tokens), np.int64, len(tokens))
            symbols, missing = table["symbol"][at], np.flatnonzero(at < 0)
            rare: Counter = Counter()
            if len(missing):
                strange = [tokens[i].decode() for i in missing.tolist()]
                symbols[missing] = [table["own"] + spelling(w) for w in strange]
                rare.update(strange)
                at = at[at >= 0]
            return len(tokens), int(table["known"][at].sum()), float(table["base"][at].sum()), float(table["inner"][at].sum()), symbols.astype("<u2").tobytes(), list(rare.keys()), list(rare.values())

        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                keys = part.column(1).to_pylist()
                cols = list(zip(*[one(t.as_py()) for t in part.column(2)], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array([is_held_out(k) for k in keys]), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)


def score(rows: DataFrame, vocab: DataFrame, lexicon: Lexicon, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text, from its encoded row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            at, column = 0, batch.schema.get_field_index("symbols")
            while at < batch.num_rows:
                first, size, ids = at, 0, []
                while at < batch.num_rows and (size < SCORE_BLOCK or at == first):
                    ids.append(np.frombuffer(batch.column(column)[at].as_py(), "<u2"))
                    size += len(ids[-1])
                    at += 1
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:column], pa.array(forward(now, ids))], [*part.schema.names[:column], "chain"])

    tail = F.expr("substring(word, greatest(char_length(word) - 1, 1), 2)")
    kind = (F.least(F.char_length("word"), F.lit(LENGTHS)) - 1) * ENDINGS + F.crc32(tail.cast("binary")) % ENDINGS
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    below = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(lexicon.class_tokens + SMOOTH * (lexicon.class_types + 1))]), (kind + 1).cast("int"))
    floor = float(np.log10(lexicon.tokens + 0.1 * (lexicon.types + 1)))
    # rare words, those the broadcast table lacks; a hint keeps both sides shuffled, as either grows with the corpus
    joined = rare.hint("merge").join(vocab, "word", "left").select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("k"), (F.col("n") * (F.log10(c + 0.1) - floor)).alias("b"), (F.col("n") * (F.log10(c + SMOOTH) - below)).alias("q"))
    sums = joined.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("q").alias("q"))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, chain double"
    chained = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols").mapInArrow(run, schema)
    out = chained.join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(lexicon.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("chain") + F.col("inner") + F.coalesce("q", zero)).alias("score"),
    )


def score_corpus(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Learn from all texts that aren't held out, score all of them.

    Nulls: a null text is an empty one (only the end); a null doc_id is never held out and stays null.
    Repeated rows count and are scored as often as they occur. An empty table gives an empty result.
    Only doc_id and text are read.
    """
    vocab = materialize(vocabulary(docs), "hmm-vocabulary")
    lexicon = Lexicon(vocab)
    rows = materialize(encoded(docs, lexicon), "hmm-symbols")
    model = train(rows, lexicon, iterations)
    return score(rows, vocab, lexicon, model)


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
