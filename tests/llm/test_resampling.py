"""Importance resampling: brute force over documents, the merge, and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

from lexforge.llm import resampling as rs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute(docs, target, longest=1, least=20, percent=10, buckets=rs.BUCKETS):
    def found(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in found(x)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found(text))
        rows.append([i, len(found(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], rs.NO_ID if r[0] is None else r[0], r[1]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé7") for _ in range(r.randint(1, 6))) for _ in range(200)]
    some = lambda k: " ".join(r.choice(vocabulary) + r.choice([",", "", "\n"]) for _ in range(k))
    return [(i, some(r.randint(0, 60))) for i in range(n)], [some(30) for _ in range(5)]


def test_draws_like_brute_force_with_many_ranges_and_blocks(spark):
    docs, target = corpus(400, 1)
    copy = docs[7][1] + " and a few words more so that there are twenty of them " * 3
    docs += [(None, copy)] * 40 + [(7, copy)] * 30 + [(900, None), (901, ""), (902, "A" * 200_000), (903, "ä Ö " * 40_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' as score", "0 as rank", "1 as weight")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    for how in ({}, {"percent": 60, "range_rows": 20, "block_rows": 3}, {"percent": 100, "longest": 3, "block_rows": 1}, {"percent": 0}, {"percent": 35, "range_rows": 5, "block_rows": 2, "least_words": 0}):
        got = sorted(map(tuple, rs.resample(d, t, **how).collect()), key=repr)
        assert got == brute(docs, target, how.get("longest", 1), how.get("least_words", 20), how.get("percent", 10)), how


def test_documents_drawn_keep_their_columns(spark):
    docs, target = corpus(200, 2)
    docs += [docs[5], docs[5], (None, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' as score", "5 as resample_rank")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = rs.drawn_documents(d, t, percent=50)
    assert got.columns == ["doc_id", "text", "score", "resample_weight", "resample_score", "resample_rank"]
    want = [r for r in brute(docs, target, percent=50) if r[4]]
    rows = got.collect()
    assert sorted((r.doc_id, r.resample_weight, r.resample_score, r.resample_rank) for r in rows if r.doc_id is not None) == sorted((r[0], r[2], r[3], r[4]) for r in want if r[0] is not None)
    assert len(rows) == len(want) and all((r.doc_id, r.text) in docs for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert rs.resample(none, one).count() == 0
    r = rs.resample(one, none, percent=100).first()
    assert (r.n_features, r["rank"]) == (30, 1) and tuple(r) == brute([(1, "word " * 30)], [], percent=100)[0]


def test_tournament_takes_runs_as_they_come():
    r = random.Random(4)
    tree, waiting, out = rs.Tournament(), [sorted((r.randint(0, 99), k) for _ in range(r.randint(1, 9))) for k in range(37)], []
    everything = sorted(x for run in waiting for x in run)
    waiting.sort()
    for run in waiting:
        while tree and tree.least() < run[0]:
            out.append(tree.pop()[:2])
        tree.add(iter(run))
    while tree:
        out.append(tree.pop())
    assert out == everything
