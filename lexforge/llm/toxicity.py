"""Toxicity: a lexicon learned from labels, misspellings by Levenshtein automata over its trie, context windows.

The lexicon holds words and stems (beginnings of words) whose documents are labelled toxic far beyond
chance. A text's words are run against the trie with an automaton that allows one edit, so id1ot or
idoit is caught; variants that occur in clean training texts are vetoed. Each hit is weighed by what
stands around it: hits in quotation marks or next to a verb of saying count less, those next to a
direct address more. A logistic model of the weighed hits gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import neardup
from lexforge.llm.common import materialize

#: Labelled training rows the classifier is fitted on at most (in order of md5(doc_id), which is no input of a score).
SAMPLE_ROWS = 20_000
#: Pairs of minimum hashes by which copies and texts with long common passages are found in the sample, and minimum hashes of a signature of which so many agree (a third).
FAMILIES, ALIKE = 12, 8
#: Stems are so many characters long; a term needs so many toxic documents, and a rate among them so many times that of clean ones.
STEM_LENGTHS, LEAST_DOCS, LEAST_RATIO = (4, 5, 6, 7), 4, 5.0
#: A term's log-likelihood ratio must pass 2 ln(terms tested) and this.
MARGIN = 10.0
#: Words of so many letters may have one edit. Stems have none: they admit any ending as it is.
FUZZY_WORD = 5
#: Terms a task counts before it hands them on.
FLUSH = 200_000
#: Words on each side of a hit that make its context, and what a context multiplies a hit by.
WINDOW, QUOTED, REPORTED, ADDRESSED = 6, 0.4, 0.6, 1.25
#: Words a worker remembers.
CACHE_WORDS = 300_000
THRESHOLD = 0.7
BATCH = 512

#: Verbs of saying, second persons and quotation marks.
SAYING = frozenset("said says say called calls wrote writes quoted quote dit écrit sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your youre u tu toi vous du dich dein ihr usted tú te".split())
OPENING, CLOSING = "\"“«„‹「", "\"”»“›」"
WORD = re.compile(r"\w+")


# ---------------------------------------------------------------- trie and automaton


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: str | None = None  # a term that ends here


class Trie:
    """Words that may have one edit; find() intersects the automaton of a word with the trie."""

    def __init__(self, terms: list[str], fuzzy_word: int = FUZZY_WORD):
        self.root, self.terms = Node(), set(terms)
        #: by length of a word: (letters at its head, heads), (letters at its tail, tails)
        self.heads: dict[int, dict[int, set[str]]] = {}
        self.tails: dict[int, dict[int, set[str]]] = {}
        for t in terms:
            if len(t) < fuzzy_word:
                continue
            node = self.root
            for c in t:
                node = node.next.setdefault(c, Node())
            node.word = t
            half = (len(t) - 1) // 2  # one edit, or one swap, can't touch both head and tail: a letter lies between them
            for n in range(len(t) - 1, len(t) + 2):
                self.heads.setdefault(n, {}).setdefault(half, set()).add(t[:half])
                self.tails.setdefault(n, {}).setdefault(half, set()).add(t[-half:])

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits (0 or 1; ties: the smaller term)."""
        if word in self.terms:
            return word, 0
        n = len(word)
        if n not in self.heads or not (any(word[:h] in x for h, x in self.heads[n].items()) or any(word[-h:] in x for h, x in self.tails[n].items())):
            return None
        found: list[str] = []
        # A state of the automaton is a row of edit distances between what the trie has spelt and every beginning of the word.
        todo = [(self.root, list(range(n + 1)), None, "")]
        while todo:
            node, row, before, letter = todo.pop()
            if node.word is not None and row[n] <= 1:
                found.append(node.word)
            for c, child in node.next.items():
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    d = row[i - 1] if word[i - 1] == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    if before is not None and i > 1 and word[i - 1] == letter and word[i - 2] == c:
                        d = min(d, before[i - 2] + 1)  # swapped letters are one edit
                    new.append(d)
                if min(new) <= 1 or min(row) == 0:
                    todo.append((child, new, row, c))
        return (min(found), 1) if found else None


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    veto: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0, 0.0)


class Matcher(dict):
    """word -> (term, edits, weight) or None; remembers a bounded number of words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.trie = lexicon, Trie(list(lexicon.words))

    def __missing__(self, word: str):
        lex, out = self.lexicon, None
        for n in STEM_LENGTHS:
            if (stem := word[:n]) in lex.stems and len(word) >= n:
                out = (stem + "*", 0, lex.stems[stem])
        # a stem's own words are in the trie too, for their misspellings
        if out is None and (m := self.trie.find(word)) is not None and not (m[1] and word in lex.veto):
            out = (m[0], m[1], lex.words[m[0]] * (0.8 if m[1] else 1.0))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


def hits(text: str, matcher: Matcher) -> tuple[int, list[tuple]]:
    """Number of words, and (term, word, offset, edits, context, weight) of each hit."""
    low = text.lower()
    tokens = WORD.findall(low)
    if not any(map(matcher.__getitem__, tokens)):
        return len(tokens), []
    spans, out = [(m.start(), m.end()) for m in WORD.finditer(low)], []
    for i, w in enumerate(tokens):
        m = matcher[w]
        if m is None:
            continue
        a, b = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
        left, right = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
        opened = max((left.rfind(q) for q in OPENING), default=-1)
        closed = max((left.rfind(q) for q in CLOSING if q != '"'), default=-1)
        around = tokens[a:i] + tokens[i + 1 : b]
        context = 1.0
        if opened > closed and any(q in right for q in CLOSING):
            context *= QUOTED
        if any(x in SAYING for x in around):
            context *= REPORTED
        elif any(x in ADDRESS for x in around):
            context *= ADDRESSED
        out.append((m[0], w, spans[i][0], m[1], context, m[2]))
    return len(tokens), out


FEATURES = ("strongest", "together", "density", "spread")


def features(n_words: int, found: list[tuple]) -> tuple[float, float, float, float]:
    """Strongest hit, all hits together (log), and these against the text's length, each weighed by context; zeros without hits."""
    weighed = [h[4] * h[5] for h in found]
    total = sum(weighed)
    return max(weighed, default=0.0), math.log1p(total), total / math.sqrt(n_words + 1), math.log1p(n_words) * bool(found)


# ---------------------------------------------------------------- learning


def is_held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, weight) of the sample: its ids come from labels alone and are few enough to be broadcast."""
    known = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return weighed(sample)


def weighed(sample: DataFrame) -> DataFrame:
    """sample with weight: every text of a family of copies counts one over the family's size, so ten copies are not ten documents' evidence.

    A text is held against the first (by MD5) of those that share two minimum hashes of their shingles with it, under FAMILIES pairs
    of hashes, and belongs to the first of those firsts with which it shares ALIKE of the 24 minimum hashes of a signature. No row is
    left out. Texts themselves are not shuffled: digests, signatures and weights of the bounded sample are small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = neardup.WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [neardup.shingle_set(t.as_py(), hashes) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                sig = iter(neardup.signatures_of(full) if full else ())
                none = [-1] * neardup.SYMBOLS  # texts without words are copies of each other
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([next(sig) if len(s) else none for s in sets], pa.list_(pa.int32()))], ["own", "sig"])

    own = F.md5(F.col("text").cast("binary"))
    rows = sample.select(own.alias("own"), "text").mapInArrow(run, "own string, sig array<int>")
    rows = materialize(rows.groupBy("own").agg(F.first("sig").alias("sig"), F.count("*").alias("copies")), "toxic-signatures")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.element_at("sig", 2 * i + 1).alias("x"), F.element_at("sig", 2 * i + 2).alias("y")) for i in range(FAMILIES)]))
    keyed = rows.select("own", "sig", pairs.alias("k")).select("own", "sig", "k.*")
    first = keyed.groupBy("i", "x", "y").agg(F.min_by(F.struct("own", "sig"), "own").alias("first"))
    agree = F.aggregate(F.zip_with("sig", "first.sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    alike = keyed.join(first, ["i", "x", "y"]).where(agree >= ALIKE).groupBy("own").agg(F.min("first.own").alias("family"))
    rows = rows.select("own", "copies").join(alike, "own")  # a text without an earlier one is the first of its own family
    sizes = rows.groupBy("family").agg(F.sum("copies").alias("size"))
    weights = rows.join(sizes, "family").select("own", (1 / F.col("size")).alias("weight"))
    # as many rows as the sample has texts, which is bounded
    return sample.withColumn("own", own).join(F.broadcast(weights), "own").select("text", "toxic", "weight")


def ratio(a: float, b: float, p: float) -> float:
    """Log-likelihood ratio of a toxic and b clean documents against a share p of toxic ones; negative where they are fewer."""
    n = a + b
    g = 2 * sum(x * math.log(x / (n * q)) for x, q in ((a, p), (b, 1 - p)) if x)
    return g if a > n * p else -g


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Terms, vetoes and coefficients from the labelled sample. Without both labels in it (empty tables too) no text scores high.

    Labels that are null or have no doc_id are left out; of repeated labels of a document the highest counts; null texts are empty ones.
    Other columns of docs and labels are not read.
    """
    sample = training_rows(docs, labels, rows).cache()
    try:
        sizes = {int(r[0]): r[1] for r in sample.groupBy("toxic").agg(F.sum("weight")).collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not bad or not good:
            return Lexicon({}, {}, frozenset(), (-4.0, 0.0, 0.0, 0.0, 0.0))
        counts = term_counts(sample)
        often = counts.where(F.col("a") >= LEAST_DOCS)
        tested, p = often.count(), bad / (bad + good)
        least = 2 * math.log(max(tested, 1)) + MARGIN
        # terms far more frequent in toxic texts: few, as the sample is bounded
        rate = F.col("a") / bad >= LEAST_RATIO * (F.col("b") + 0.5) / (good + 1)
        found = {r.term: (r.a, r.b) for r in often.where(rate).collect() if ratio(r.a, r.b, p) >= least}
        weight = {t: math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1)) for t, (a, b) in found.items()}
        most: dict[str, int] = {}
        for t, (a, _) in found.items():
            if not t.endswith("*"):
                for n in STEM_LENGTHS:
                    most[t[:n]] = max(most.get(t[:n], 0), a)
        # a stem stands for its words if it has clearly more documents than any one of them; of nested stems the most telling stays
        stem_weights: dict[str, float] = {}
        for t in sorted((t for t in weight if t.endswith("*")), key=lambda t: (-ratio(*found[t], p), -len(t), t)):
            stem = t[:-1]
            if found[t][0] >= 1.5 * most.get(stem, 0) and not any(stem.startswith(x) or x.startswith(stem) for x in stem_weights):
                stem_weights[stem] = weight[t]
        own = {t: w for t, w in weight.items() if not t.endswith("*")}
        lexicon = Lexicon(own, stem_weights)
        clean = counts.where((F.col("b") > 0) & ~F.col("term").endswith("*")).select("term")
        lexicon.veto = frozenset(r[0] for r in fuzzy(clean, lexicon).collect())
        marked = sample.select(F.lit(0).cast("long").alias("doc_id"), "text", F.struct("toxic", "weight").alias("marks"))
        x = scan(marked, lexicon, keep="marks").select(*FEATURES, "marks.*").toPandas()
        lexicon.coefficients = fit(x[list(FEATURES)].to_numpy(float), x["toxic"].to_numpy(float), x["weight"].to_numpy(float))
        return lexicon
    finally:
        sample.unpersist()


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, a, b): weight of the toxic and of the clean texts with each word of four letters or more, and with each stem (written with *)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[float]] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([x[0] for x in seen.values()], pa.float64()), pa.array([x[1] for x in seen.values()], pa.float64())], ["term", "a", "b"])
            seen.clear()
            return rows

        for batch in batches:
            for text, toxic, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {w for w in WORD.findall(text.as_py().lower()) if len(w) >= 4}
                own |= {w[:n] + "*" for w in own for n in STEM_LENGTHS if len(w) > n}
                for t in own:
                    seen.setdefault(t, [0.0, 0.0])[toxic != 1] += weight
                if len(seen) >= FLUSH:
                    yield out()
        yield out()

    counts = sample.select("text", "toxic", "weight").mapInArrow(run, "term string, a double, b double")
    return counts.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def fuzzy(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Those words that only match a term with an edit."""
    trie = Trie(list(lexicon.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [w for w in batch.column(0).to_pylist() if (m := trie.find(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["term"])

    return words.mapInArrow(run, "term string")


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression of weighed rows by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


# ---------------------------------------------------------------- scoring


def scan(docs: DataFrame, lexicon: Lexicon, keep: str | None = None) -> DataFrame:
    """doc_id, the features and hits (term, word, offset, edits, context, weight) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    hit = "array<struct<term:string,word:string,at:int,edits:int,context:double,weight:double>>"
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("at", pa.int32()), ("edits", pa.int32()), ("context", pa.float64()), ("weight", pa.float64())]))
    names = ["doc_id", *FEATURES, "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows, found = [], []
                for text in part.column(1):
                    n, h = hits(text.as_py() or "", matcher)
                    rows.append(features(n, h))
                    found.append([dict(zip(("term", "word", "at", "edits", "context", "weight"), x, strict=True)) for x in h])
                cols = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
                more = [part.column(2)] if keep else []
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.array(found, kind), *more], [*names, *([keep] if keep else [])])

    cols = ["doc_id", "text", *([keep] if keep else [])]
    more = f", {keep} {dict(docs.dtypes)[keep]}" if keep else ""
    return docs.select(*cols).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} double" for c in FEATURES) + f", hits {hit}{more}")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, hits of every text.

    Nulls: a null text is an empty one, scored like any text without hits; a null doc_id stays.
    Repeated rows are scored alike. Other columns are not read.
    """
    w = lexicon.coefficients
    z = F.lit(w[0])
    for c, name in zip(w[1:], FEATURES, strict=True):
        z = z + c * F.col(name)
    s = scan(docs, lexicon).withColumn("score", 1 / (1 + F.exp(-z)))
    return s.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")


def reject_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the texts that score THRESHOLD or more, judged in one pass over all columns' rows."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        matcher, w = Matcher(lex), lex.coefficients
        for batch in batches:
            keep = []
            for text in batch.column(place):
                f = features(*hits(text.as_py() or "", matcher))
                z = w[0] + sum(c * v for c, v in zip(w[1:], f, strict=True))
                keep.append(1 / (1 + math.exp(-max(-700.0, z))) < THRESHOLD)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, lexicon)
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("hits").alias("n_hits"))
