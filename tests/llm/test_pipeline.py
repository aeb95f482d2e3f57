"""Stages of the corpus pipeline against planted cases and brute force."""

import collections
import hashlib
import math
import random
import re

import corpus_pipeline
from lexforge.llm import bpe, suffixes


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)]


def brute_cut(texts, words_of=corpus_pipeline.REPEAT_WORDS + 1):
    """texts without the words that a repeated string of so many words covers, word by word."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    strings = [[tuple(m[0] for m in f[i : i + words_of]) for i in range(len(f) - words_of + 1)] for f in found]
    seen, out = collections.Counter(x for s in strings for x in s), []
    for t, f, s in zip(texts, found, strings, strict=True):
        gone = sorted({j for i, x in enumerate(s) if seen[x] > 1 for j in range(i, i + words_of)})
        spans, t = [], t or ""
        for j in gone:
            if spans and spans[-1][1] == j - 1:
                spans[-1][1] = j
            else:
                spans.append([j, j])
        for a, b in reversed(spans):
            t = t[: f[a].start()] + t[f[b].end() :]
        out.append(t)
    return out


def cut(spark, texts):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, kept string, n_bytes int")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got[0].asDict().keys() == {"doc_id", "text", "n_chars", "kept", "n_bytes"} and {(r.kept, r.n_bytes) for r in got.values()} == {("x", 7)}
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text)
    return [got[i].text for i in range(len(texts))]


def test_passages_over_50_words_are_cut(spark):
    short, long, letters = " ".join(words(51, 1)), " ".join(words(50, 2)), " ".join("abcdefg"[i % 7] for i in range(70))
    two = [" ".join(words(40, 3)), " ".join(words(40, 4))]
    own = [" ".join(words(80, 10 + i)) for i in range(12)]
    texts = [
        f"{own[0]} 1 {short} 2 {own[1]}", f"{own[2]} 3\n{short.replace(' ', '  ')}", f"{own[3]} | {long} | {own[4]}", f"{own[5]} < {long} > {own[6]}", " ".join(words(300, 30)), None, "",
        f"{own[7]} {two[0]} {two[1]}", f"{own[8]} {two[0]} x", f"{own[9]} {two[1]} y", f"{letters} {own[10]}", f"{own[11]} {letters}",
    ]
    got = cut(spark, texts)
    assert got == brute_cut(texts)
    # the passage of 51 words is gone, whatever white space is in it, and so are 70 words of one letter
    assert [got[0], got[1]] == [f"{own[0]} 1  2 {own[1]}", f"{own[2]} 3\n"] and [got[10], got[11]] == [f" {own[10]}", f"{own[11]} "]
    # 50 words stay, two passages of 40 words side by side too, and clean texts
    assert got[2:5] == texts[2:5] and got[7:10] == texts[7:10]


def test_random_texts_are_cut_like_brute_force(spark):
    r, vocabulary = random.Random(5), [*"abcd", "ü", "wörter", "some", "z" * 300]
    pool = [[r.choice(vocabulary) for _ in range(r.choice([30, 51, 52, 120, 400]))] for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [r.choice(pool)[r.randint(0, 9) :] if r.random() < 0.4 else words(r.randint(1, 60), r.random()) for _ in range(r.randint(1, 5))]
        texts.append(r.choice(["", " ", "\n\n"]) + r.choice([" ", "\t", " \r\n"]).join(w for p in parts for w in p) + r.choice(["", " "]))
    texts += [texts[0], " ".join("ab" * 3000)]
    got = cut(spark, texts)
    assert got == brute_cut(texts) and sum(map(len, got)) < sum(map(len, texts))


def test_near_duplicates_are_told_apart_by_text(spark):
    a, b, c = (" ".join(words(40, k)) for k in (60, 61, 62))
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (9, f"{b} more", 4), (None, a, 5), (11, None, 6), (11, "", 7), (12, c, 8), (12, c, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.text_key for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_mix(ids, period=1000, block=8):
    """(slot, place) of each doc_id by earliest deadline first, slot by slot."""
    by = {}
    for i, source in ids:
        by.setdefault("n" if source is None else "s" + source, []).append(i)
    names = sorted(by)
    w = {k: math.floor(1000 * math.sqrt(len(by[k]))) for k in names}
    free, total = period - len(names), sum(w.values())
    share = {k: 1 + free * w[k] // total for k in names}
    for k in sorted(names, key=lambda k: (-(free * w[k] % total), k))[: period - sum(share.values())]:
        share[k] += 1
    turn, slots = dict.fromkeys(names, 1), {k: [] for k in names}
    for t in range(period):
        ready = [k for k in names if turn[k] <= share[k] and (turn[k] - 1) * period // share[k] <= t]
        k = min(ready, key=lambda k: (-(-turn[k] * period // share[k]), k))
        turn[k] += 1
        slots[k].append(t)
    out = {}
    for k in names:
        for n, i in enumerate(sorted(by[k], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))):
            whole, at = divmod(n // block, share[k])
            out[i] = (whole * period + slots[k][at], n % block)
    return out


def test_run_like_brute_force(spark, tmp_path):
    r, vocabulary = random.Random(7), words(300, 4)
    passage = " ".join(words(55, 5))
    rows = []
    for i in range(240):
        t = [r.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            t[r.randrange(60)] = "numbskull"
        if i % 10 == 1:
            t.insert(30, passage)
        rows.append((i, " ".join(t), [None, "web", "web", "books", "web"][i % 5]))
    rows += [(500 + i, rows[2 + 4 * i][1] + " more", "web") for i in range(5)]
    path = str(tmp_path)
    spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(x[0], int("numbskull" in x[1])) for x in rows], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    kept = [x for x in rows if "numbskull" not in x[1] and x[0] < 500]
    texts, places = dict(zip([x[0] for x in kept], brute_cut([x[1] for x in kept]), strict=True)), brute_mix([(x[0], x[2]) for x in kept])
    assert sum(len(t) for t in texts.values()) < sum(len(x[1]) for x in kept)
    codec = bpe.codec(bpe.vocabulary_bytes())
    want = {}
    for (k, t), pieces in zip(texts.items(), bpe.split_texts(list(texts.values())), strict=True):
        ids = codec.encode(pieces)
        want[k] = (*places[k], ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "mix_slot", "mix_place", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want


def test_large_groups_are_cut_in_pieces(spark, monkeypatch):
    r, vocabulary = random.Random(9), list("abcdefgh")
    passage = [r.choice(vocabulary) for _ in range(140)]
    texts = [" ".join([*words(8, i), *passage[r.randint(0, 60) : r.randint(80, 140)], *words(8, 500 + i)]) for i in range(80)]
    monkeypatch.setattr(suffixes.compare, "__defaults__", (suffixes.Bytes, 2, (4, 1)))
    assert cut(spark, texts) == brute_cut(texts)
    monkeypatch.setattr(suffixes.compare, "__defaults__", (suffixes.Bytes, 2, (16, 4, 1)))
    assert cut(spark, texts) == brute_cut(texts)
