"""Training-data operators: edge cases for each, and brute force where SQL can't say the result."""

import base64
import collections
import gzip
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import bpe, common, hmm, hnsw, media, mixing, neardup, suffixes, toxicity, urls, warc

#: Odd rows: null and empty texts, white space, ties, repeated rows, null ids, extra columns named like results.
ODD = [(None, "a b c d e f", "x", "n"), (1, None, None, "n"), (2, "", "x", "n"), (3, " \n\t ", "y", "n"), (4, "a b", "x", "n"), (4, "a b", "x", "n"), (5, "one two three four five six seven", "y", "n"), (6, "one two three four five six seven", "y", "n"), (7, "long " * 5000, "x", "n")]
SCHEMA = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("n_removed", F.lit("mine")).withColumn("component", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


# ------------------------------------------------------------ op1


def test_hmm_on_odd_rows(spark, odd, none):
    got = hmm.score_corpus(odd, 1).collect()
    assert len(got) == len(ODD)
    train = [t for k, t, *_ in ODD if not hmm.is_held_out(k)]
    counts = collections.Counter(w for t in train for w in hmm.words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in hmm.words(t)), 6) for _, t, *_ in ODD)
    assert sorted(round(r.base_score, 6) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score_corpus(none, 1).count() == 0


def test_forward_is_the_sum_over_all_paths():
    m = hmm.start_model(np.ones(4), 3)
    seq = np.array([0, 3, 1, 1, 2])
    total = 0.0
    for path in np.ndindex(*(3,) * len(seq)):
        p = m["pi"][path[0]] * m["b"][path[0], seq[0]]
        for t in range(1, len(seq)):
            p *= m["a"][path[t - 1], path[t]] * m["b"][path[t], seq[t]]
        total += p
    assert abs(hmm.forward(m, [seq[:2], seq])[1] - math.log10(total)) < 1e-12


def path_sums(model, seq):
    """Expected counts of one sequence by the plain forward and backward recursions."""
    a, b = model["a"], model["b"]
    n, s = len(seq), len(a)
    fwd, bwd = np.zeros((n, s)), np.ones((n, s))
    fwd[0] = model["pi"] * b[:, seq[0]]
    for t in range(1, n):
        fwd[t] = (fwd[t - 1] @ a) * b[:, seq[t]]
        fwd[t] /= fwd[t].sum()
    for t in range(n - 2, -1, -1):
        bwd[t] = a @ (b[:, seq[t + 1]] * bwd[t + 1])
        bwd[t] /= bwd[t].sum()
    gamma = fwd * bwd
    gamma /= gamma.sum(1, keepdims=True)
    moves = np.zeros((s, s))
    for t in range(1, n):
        x = fwd[t - 1][:, None] * a * (b[:, seq[t]] * bwd[t])[None, :]
        moves += x / x.sum()
    emitted = np.zeros_like(b)
    np.add.at(emitted.T, seq, gamma)
    return gamma[0], moves, emitted


def test_window_counts_are_those_of_whole_texts():
    r = np.random.default_rng(5)
    m = hmm.start_model(np.ones(30), 3)
    texts = [r.integers(0, 30, n) for n in (1, 2, 15, 16, 17, 63, 127, 128, 129, 136, 137, 300, 1000)]
    got = hmm.counts_of(m, texts)
    want = [sum(x) for x in zip(*[path_sums(m, t) for t in texts], strict=True)]
    # every start, every transition over a window's end and every token is counted once
    assert abs(got[1].sum() - sum(len(t) - 1 for t in texts)) < 0.01 and abs(got[2].sum() - sum(map(len, texts))) < 0.01
    for x, y in zip(got, want, strict=True):
        assert np.abs(x - y).max() < 0.02 * max(1.0, np.abs(y).max())


def test_scores_with_spelling_classes_and_rare_words(spark, monkeypatch):
    """A vocabulary beyond the words with symbols and beyond the broadcast counts, against a plain computation."""
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    monkeypatch.setattr(hmm, "LOOKUP", 40)
    vocabulary = words(120, 8)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(vocabulary[: 10 + i]) for _ in range(30)) + f" only{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = hmm.vocabulary(docs).cache()
    lexicon = hmm.Lexicon(vocab)
    encoded = hmm.encoded(docs, lexicon).cache()
    model = hmm.train(encoded, lexicon, 2)
    got = {x.doc_id: x for x in hmm.score(encoded, vocab, lexicon, model).collect()}
    counts = collections.Counter(w for i, t in rows if not hmm.is_held_out(i) for w in hmm.words(t))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    own = order[:20] if "" in order[:20] else [*order[:20], ""]
    others = collections.defaultdict(list)
    for w in order:
        if w not in own:
            others[hmm.spelling(w)].append(counts[w])
    assert any(x.n_known < x.n_tokens for x in got.values()) and len(counts) > 40
    for i, t in rows:
        seq, rest = [], 0.0
        for w in hmm.words(t):
            if w in own:
                seq.append(own.index(w))
            else:
                k = hmm.spelling(w)
                seq.append(len(own) + k)
                rest += math.log10((counts.get(w, 0) + 0.1) / (sum(others[k]) + 0.1 * (len(others[k]) + 1)))
        assert abs(got[i].score - (hmm.forward(model, [np.array(seq)])[0] + rest)) < 1e-6
        n, v = sum(counts.values()), len(counts)
        assert abs(got[i].base_score - sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in hmm.words(t))) < 1e-6
        assert got[i].n_known == sum(counts.get(w, 0) > 0 for w in hmm.words(t))


# ------------------------------------------------------------ op2


def test_mixing_stays_within_a_block(spark):
    rows = [(i, "abcd"[min(3, i % 10 // 2)]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, {"a": 5, "b": 3, "c": 1, "d": 1}, period=20, block_rows=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    slots = {(r.source, r.mix_block): (r.mix_slot, r.mix_release, r.mix_deadline) for r in got}
    assert len({s for s, _, _ in slots.values()}) == len(slots)
    assert all(a <= s < b for s, a, b in slots.values())
    shares = {r.source_key[1:]: r.share / 20 for r in mixing.shares(docs, {"a": 5, "b": 3, "c": 1, "d": 1}, 20).collect()}
    order = sorted((s, k[0]) for k, (s, _, _) in slots.items())
    last = min(max(s for (k, _), (s, _, _) in slots.items() if k == x) for x in shares)
    seen = collections.Counter()
    for s, x in order:
        if s > last:
            break
        seen[x] += 1
        assert all(abs(seen[y] - (s + 1) * shares[y]) < 1 for y in shares)


def test_mixing_odd_rows(odd, none):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mixed_files(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("source", [None, "web"])
def test_mixing_one_source_and_ties(spark, source):
    """A table of null sources or of one source, with repeated and null ids: every row once, every place once."""
    ids = [*range(40), 7, 7, 7, None, None]
    docs = spark.createDataFrame([(i, source) for i in ids], "doc_id long, source string")
    got = mixing.mix(docs, period=10, block_rows=4).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(ids)
    assert sorted({r.mix_slot for r in got}) == list(range(-(-len(ids) // 4)))


# ------------------------------------------------------------ op3


def test_nearest_on_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = hnsw.search_all(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 100), (0, 3, 5), (100, 1, 0), (100, 2, 1), (100, 3, 5)]
    assert hnsw.search_all(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hnsw.search_all(df, lambda i: i % 50 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(g["vec_id"]))
    assert hits / (5 * 60) >= 0.9


def test_shards_are_merged(spark, monkeypatch):
    """Eight shards: recall and exact scores of the merged lists, and ties over shards by the smaller id."""
    monkeypatch.setattr(hnsw.index, "__defaults__", (250,))
    x = np.random.default_rng(4).normal(size=(2000, 12))
    x[1500] = 2 * x[3]
    x[1501] = 3 * x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert hnsw.index(hnsw.distinct_vectors(hnsw.usable(df, "vec_id", "embedding"), 6)).count() == 8
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, rows = 0, hnsw.search_all(df, lambda i: (i % 50 == 0) | (i == 3)).collect()
    for r in rows:
        assert abs(r.score - float(u[r.query_id] @ u[r.vec_id])) < 1e-12
        s = u @ u[r.query_id]
        s[r.query_id] = -9
        hits += r.vec_id in np.argsort(-s)[:5]
    assert len(rows) == 41 * 5 and hits / len(rows) >= 0.9
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 3][:2] == [1500, 1501]


# ------------------------------------------------------------ op4


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_runs", [3, 20_000])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, group_runs):
    monkeypatch.setattr(suffixes.compare, "__defaults__", (suffixes.Bytes, group_runs, suffixes.STEPS))
    w = words(400, 1)
    shared, tail = " ".join(w[:120]), " ".join(w[200:300])
    texts = [shared + " x " + " ".join(words(150, 2)), "é" + " ".join(words(90, 3)) + " " + shared[7:], "ab" * 500, "zz" + "ab" * 230, tail + shared[:430] + tail, shared[:410] + "q" + tail, shared[:410] + "r" + tail[1:], "", None, "short", "dup " * 120, "dup " * 120]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(df, texts=False).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400)


def test_passages_of_more_than_50_words_are_told(spark):
    short, fifty = " ".join(words(51, 1)), " ".join(words(50, 2))
    own = [" ".join(words(80, 10 + i)) for i in range(7)]
    texts = [f"{own[0]} 1 {short} 2 {own[1]}", f"{own[2]} 3 {short}", f"{own[3]} | {fifty} | {own[4]}", f"{own[5]} < {fifty} > {own[6]}", " ".join(words(300, 30)), None, short + " . " + short]
    assert suffixes.PASSAGE_BYTES < len(short.encode()) < 400
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_passages", F.lit("mine"))
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_bytes) for r in suffixes.repeats(df, texts=False, passages=(suffixes.PASSAGE_BYTES, 50)).collect()}
    n = len(short.encode())
    assert [got[i][:2] for i in range(7)] == [(0, 1), (0, 1), (0, 0), (0, 0), (0, 0), (0, 0), (0, 2)]
    assert all(n <= got[i][2] <= n + 2 for i in (0, 1)) and 2 * n <= got[6][2] <= 2 * n + 2


def test_runs_of_one_kind_are_combined():
    k, own = np.array([5, 5, 5, 6, 7, 7]), np.array([1, 1, 2, 1, 1, 1])
    got = suffixes.combined(k, own, np.arange(6), np.full(6, 9)).to_pylist()
    assert sorted((r["k"], r["own"], r["key"], r["weight"]) for r in got if r["weight"]) == [(5, 1, 0, 2), (5, 2, 2, 1), (6, 1, 3, 1), (7, 1, 4, 2)]
    assert sorted(r["key"] for r in got if not r["weight"]) == [1, 5] and len({r["k"] for r in got if not r["weight"]}) == 2


def test_repeats_odd_rows(odd, none):
    got = suffixes.repeats(odd)
    assert got.count() == len(ODD)
    assert dict(got.dtypes)["n_removed"] == "bigint"
    assert got.where("doc_id = 7").first().n_removed == 25000
    assert suffixes.repeats(none).count() == 0


# ------------------------------------------------------------ op5


def test_bpe_like_tiktoken(spark, odd, none):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(bpe.vocabulary_bytes())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    bits = ["a", "b", "'s", "'re", "'ll", "'", "  ", " ", "\n", "\t", "12", "!", "..", "é", "中", "　", "\r\n", "😀", "́", "٣", "²", "\x1c", "\x85", "\0", "ſ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["a" * 2000, "'" * 40, " ", "x's's"]
    codec = bpe.codec(bpe.vocabulary_bytes())
    for t, pieces in zip(texts, bpe.split_texts(texts), strict=True):
        assert codec.encode(pieces) == ",".join(map(str, enc.encode_ordinary(t)))
        assert codec.decode(codec.encode(pieces)) == t.encode()
    rows = bpe.token_digests(odd).collect()
    assert len(rows) == len(ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in rows if x.doc_id in (1, 2)] == [(0, empty, empty)] * 2
    tokens = bpe.encode(odd)
    back = {x.doc_id: bytes(x.content) for x in bpe.decode(tokens).collect()}
    assert back[5] == ODD[6][1].encode()
    assert tokens.where("doc_id = 5").first().offsets[0] == 0
    assert bpe.token_digests(none).count() == 0


# ------------------------------------------------------------ op6


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "http://a/\r\nb", "same"), (1, None, "same"), (2, "http://c", None), (5, "http://d", ""), (6, "http://e", "é" * 9000), (6, "http://e", "é" * 9000), (None, "u", "z")], "page_id long, url string, html string").withColumn("digest", F.lit(0))
    rows = sorted((r for r in warc.archive_pages(pages).collect()), key=repr)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows}
    assert got == {(1, "response", None, 4), (3, "revisit", 1, 4), (2, "response", None, 0), (5, "revisit", 2, 0), (6, "response", None, 18000), (None, "response", None, 1)}
    assert len(rows) == 7
    assert all(r.intact in (True, None) for r in rows)
    sha = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert {r.payload_digest for r in rows if r.page_id in (1, 3)} == {sha}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_makes_members_and_reports_damage(spark):
    one = warc.record(1, "http://a", b"x" * 100_000, "D", None) + warc.record(2, None, b"", "E", 1)
    whole = gzip.compress(one)
    df = spark.createDataFrame([(bytearray(whole),), (bytearray(whole[:-20]),), (bytearray(b"no"),), (None,)], "content binary")
    rows = warc.normalise(df).collect()
    assert sorted(bool(r.error) for r in rows) == [False, False, True, True]
    good = next(r for r in rows if len(r["index"]) == 2 and not r.error)
    assert [zlib.decompress(bytes(good.content)[e.offset : e.offset + e.length], 31)[:8] for e in good["index"]] == [b"WARC/1.1"] * 2


# ------------------------------------------------------------ op7


def test_toxic_terms_and_misspellings(spark, odd, none):
    r = random.Random(0)
    clean = words(300, 4)
    rows = []
    for i in range(400):
        t = [r.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            t[r.randrange(40)] = "numbskull"
            t[r.randrange(40)] = "vexq" + r.choice(clean)
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    lex = toxicity.learn(docs, labels)
    assert "numbskull" in lex.words and any(s.startswith("vexq") for s in lex.stems)
    probe = spark.createDataFrame([(1, "you numbskul " + rows[1][1]), (2, rows[1][1]), (3, None), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(probe, lex).collect()}
    assert got[1].score > got[2].score and got[1].hits[0].edits == 1
    assert got[2].predicted == got[3].predicted == got[4].predicted == 0
    assert toxicity.score(odd, lex).count() == len(ODD) and toxicity.score(none, lex).count() == 0
    assert toxicity.learn(none, labels).words == {}


def test_misspelt_heads_of_stemmed_terms(spark):
    r, clean = random.Random(1), words(300, 4)
    rows = []
    for i in range(400):
        t = [r.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            t[r.randrange(40)] = ("moronvk", "moronvks")[i // 4 % 2]
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    lex = toxicity.learn(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"))
    (stem,) = lex.stems
    assert "moronvk".startswith(stem) and {"moronvk", "moronvks"} <= set(lex.words)
    m = toxicity.Matcher(lex)
    assert m["moronvk"] == m["moronvkly"] == (stem + "*", 0, lex.stems[stem])
    assert [(m[w] or (None, None))[:2] for w in ("m0ronvk", "mroonvk", "noronvks")] == [("moronvk", 1), ("moronvk", 1), ("moronvks", 1)]


def edits(a, b):
    """Levenshtein distance in which two swapped neighbours are one edit."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automata_find_what_brute_force_finds():
    r = random.Random(12)
    terms = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    probes = ["".join(r.choice("abcd") for _ in range(r.randint(2, 10))) for _ in range(800)]
    for t in terms:
        i = r.randrange(len(t))
        probes += [t, t[:i] + t[i + 1 :], t[:i] + "x" + t[i:], t[:i] + "x" + t[i + 1 :], t[:i] + t[i + 1 : i + 2] + t[i : i + 1] + t[i + 2 :]]
    hits = 0
    for w in probes:
        near = [t for t in terms if len(t) >= toxicity.FUZZY_WORD and edits(w, t) <= 1]
        want = (w, 0) if w in terms else (min(near), 1) if near else None
        assert trie.find(w) == want, w
        hits += want is not None
    assert hits > 200


def test_copies_weigh_one_together_and_no_row_goes(spark):
    base, other = words(80, 31), words(80, 32)
    near = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in (1, 78)]
    alike = " ".join(base[:25] + words(55, 33))  # shares shingles with the first, but is no copy
    rows = [(" ".join(base), 1), (" ".join(base), 0), *[(t, 1) for t in near], (" ".join(other), 0), (alike, 1), ("", 0), (" ", 0)]
    got = toxicity.weighed(spark.createDataFrame(rows, "text string, toxic int")).collect()
    assert len(got) == len(rows)
    weight = {}
    for x in got:
        weight.setdefault(x.text, set()).add(round(x.weight, 6))
    assert weight[" ".join(other)] == weight[alike] == {1.0}
    assert weight[""] == weight[" "] == {0.5}
    assert sum(x.weight for x in got if x.text in (" ".join(base), *near)) < 1.6  # one family; a copy whose signature happens to differ may stand alone


def test_scores_are_those_of_the_model(spark):
    """Null and repeated labels, null texts, and each score against its formula."""
    rows = [(i, ("you clodpate " if i % 3 == 0 else "") + " ".join(words(20, 400 + i)), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([*[x[:2] for x in rows], (500, None), (None, "clodpate")], "doc_id long, text string")
    marks = [*[(x[0], x[2]) for x in rows], (0, 0), (1, None), (None, 1), (500, 0), (777, 1)]
    lex = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert list(lex.words) == ["clodpate"]
    m, w = toxicity.Matcher(lex), lex.coefficients
    for x in toxicity.score(docs, lex).collect():
        text = next((t for k, t, *_ in rows if k == x.doc_id), "clodpate" if x.doc_id is None else "")
        n, found = toxicity.hits(text, m)
        total = [h[4] * h[5] for h in found]
        f = (max(total, default=0.0), math.log1p(sum(total)), sum(total) / math.sqrt(n + 1), math.log1p(n) * bool(found))
        assert abs(x.score - 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(w[1:], f, strict=True)))))) < 1e-9
        assert x.predicted == int(x.score >= 0.7) == int("clodpate" in text)


def test_quotation_counts_less():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 5.0}, {}))
    said, meant = toxicity.hits('he said "idiot" once', m)[1][0][4], toxicity.hits("you idiot", m)[1][0][4]
    assert said < 1 < meant
    assert [m[w] is not None for w in ("idiot", "id1ot", "idoit", "idiots", "idiom", "patriot")] == [True, True, True, True, True, False]


# ------------------------------------------------------------ op8


def test_near_duplicates_like_brute_force(spark):
    r = random.Random(3)
    base = words(80, 6)
    texts = [" ".join(words(60, s)) for s in range(10)]
    for k in range(40):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(80)] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base), "", None, "a b", "a b", "A B c", " ".join(base).upper()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("kept", F.lit("x"))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                part = [min(x, y) if p in (x, y) else p for p in part]
    assert got == {i: (len(sets[i]), part[i], part[i] == i) for i in range(len(texts))}


def test_candidates_are_confirmed_by_their_sets_alone(spark):
    r = np.random.default_rng(1)
    a = np.unique(neardup.mixed(r.integers(1, 1 << 62, 100, dtype=np.uint64)))
    b, c = np.unique(np.append(a[:90], neardup.mixed(np.arange(5, dtype=np.uint64) + np.uint64(1)))), a[:60]
    sets = {1: a, 2: b, 3: c}
    # signatures that differ in 16 symbols, as those of two similar sets may
    nodes = spark.createDataFrame([(k, len(s), [k] * 16 + [0] * 8, neardup.bitmap(s).tolist()) for k, s in sets.items()], "node long, n_shingles long, sig array<int>, bits array<long>")
    full = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in sets.items()], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    assert [tuple(x) for x in neardup.similar(neardup.plausible(pairs, nodes), full).collect()] == [(2, 1)]


def test_slices_and_partners_lose_no_link(spark, monkeypatch):
    """A family that drifts from its first text, and boilerplate texts that are not alike, in slices of a few rows with one partner at a time."""
    monkeypatch.setattr(neardup, "SLICE", 8)
    monkeypatch.setattr(neardup, "PARTNERS", 1)
    monkeypatch.setattr(neardup, "MEETING", 40)
    r, rows, line = random.Random(3), [], words(60, 50)
    now = words(60, 51)
    for i in range(40):
        now = list(now)
        now[(i * 7) % 60] = f"w{i}"
        rows.append((i, " ".join(now)))
    for i in range(40, 100):
        rows.append((i, " ".join(line + words(r.randint(15, 30), 200 + i))))
    hashes = neardup.WordHashes()
    sets = {i: set(neardup.shingle_set(t, hashes).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for i in sorted(sets):  # smallest id first: a link's lower end is settled before its upper one is read
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_cells_cover_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 4)
    index = spark.createDataFrame([(7, i, 100) for i in range(30)], "bucket long, node long, n long")
    parts = spark.createDataFrame([(i, 0) for i in range(20)], "id long, component long")
    bits = spark.createDataFrame([(i, [0]) for i in range(30)], "node long, bits array<long>")
    cells = {}
    for c in neardup.meetings(index, parts, bits).collect():
        cells.setdefault((c.y, c.x), []).append((c.node, c.role))
    met = {frozenset((a, b)) for x in cells.values() for a, p in x for b, q in x if a != b and {p, q} != {1} and {p, q} != {0}}
    assert {frozenset((a, b)) for a in range(20, 30) for b in range(30) if a != b} <= met


def test_near_duplicates_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {r.doc_id for r in rows if not r.kept} == {6}
    assert neardup.keep_one(odd).columns == odd.columns
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (150, 200), (None, 3)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 150, 200: 150}


# ------------------------------------------------------------ op9


def test_media_is_lossless(odd, none):
    rows = media.text_media(odd).collect()
    assert len(rows) == len(ODD)
    for r, t in ((x, dict((k, t) for k, t, *_ in ODD)[x.doc_id]) for x in rows):
        p = media.padded((t or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.text_media(none).count() == 0


def test_general_decoder_agrees_with_the_lookup(monkeypatch):
    frame = media.read_avi(media.write_avi(os.urandom(64 * 3)))[0][0]
    fast = media.decode_frame(frame)
    monkeypatch.setattr(media, "DC_LENGTHS", {})
    slow = media.decode_frame(frame)
    assert slow.shape == (24, 512) and (slow[::8, ::8] == fast).all() and (slow[3::8, 5::8] == fast).all()


def test_shots_and_clip_rows(spark):
    scenes = np.concatenate([np.full((10, 64, 64), 20), np.full((7, 64, 64), 200)]).astype(np.uint8)
    avi = media.write_avi(scenes.tobytes())
    df = spark.createDataFrame([(1, bytearray(avi)), (2, bytearray(b"RIFF")), (3, None)], "doc_id long, media binary")
    got = sorted(tuple(r)[:6] for r in media.clips(df).collect() if r.error is None)
    assert got == [(1, 0, 0, 10, 0.0, 400.0), (1, 1, 10, 7, 400.0, 680.0)]
    assert media.clips(df).where("error is not null").count() == 1


# ------------------------------------------------------------ op10


def test_aliases_carry_blocks(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "https://x.bad.net/a", None),
        (2, "https://good.com/1", '<LINK rel="canonical" href="https://x.bad.net/a">'),
        (3, "https://good.com/2#f", f"<p>{link.format('/1')}"),
        (4, "https://good.com/3", '<meta http-equiv=refresh content="0; url=https://www.example.net/en/ok">'),
        (5, "https://www.example.net/en/ok", link.format("https://x.bad.net/zzz")),
        (6, None, None),
        (7, "no scheme", ""),
        (8, "HTTP://NET?q", ""),
    ]
    pages = spark.createDataFrame([r for r in rows if r[2] is None or "<link" not in r[2]] + [(i, u, h and h.replace('href="https', 'rel=canonical href="https').replace('" rel="canonical"', '"') if h and h.startswith("<link") else h) for i, u, h in rows if h and "<link" in h], "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got[1] == ("x.bad.net", "/a", "net/", "block")
    assert got[2][2:] == (None, "block") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("example.net/en/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("net", "", None, "allow")
    many = [urls.Rule("block", f"h{i}.org/") for i in range(urls.INLINE_RULES)] + urls.RULES
    again = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, many).collect()}
    assert again == got
    assert urls.filter_urls(pages.limit(0)).count() == 0
