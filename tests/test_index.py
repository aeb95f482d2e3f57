"""Embedding of misses, the chunk index, and gated ingest: reuse, replacement, reruns and crashes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash
from lexforge.operators import documents as D
from lexforge.operators import embedding as E
from lexforge.sources.chunk_index import ChunkIndex
from lexforge.streaming import gates

STORED = "content_hash string, embedding array<float>"


class Refusing(E.SeededModel):
    """A model that fails where it is asked anything."""

    def load(self):
        raise RuntimeError("asked for a vector")


class Shapeless(E.SeededModel):
    def load(self):
        return lambda texts: np.ones((len(texts), 3))


def hashes(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(content_hash(F.col("t"))).collect()]


def test_unchanged_chunks_keep_their_vectors_and_never_reach_the_model(spark):
    chunks = spark.createDataFrame([("existing body",), ("Existing  BODY",)], "chunk_text string")
    stored = spark.createDataFrame([(*hashes(spark, "existing body"), [0.5] * 768), (None, [1.0] * 768)], STORED)
    rows = E.embed_incremental(chunks, stored, Refusing(name="refusing")).collect()
    assert [r.embedding for r in rows] == [[0.5] * 768] * 2 and all(r.reused for r in rows)


def test_new_texts_are_embedded_once_and_counted(spark):
    chunks = spark.createDataFrame([("existing body", 1), ("brand new body", 2), ("brand new  body", 3), (None, 4)], "chunk_text string, reused int")
    stored = spark.createDataFrame([(*hashes(spark, "existing body"), [0.5] * 8), (*hashes(spark, "brand new body"), [0.5] * 7)], STORED)
    got = E.embed_incremental(chunks, stored, E.SeededModel(8))
    assert tuple(E.embed_stats(got).first()) == (4, 3, 1, 2)
    vectors = {r.chunk_text: r.embedding for r in got.collect()}
    assert vectors["brand new body"] == vectors["brand new  body"] and abs(np.linalg.norm(vectors[None]) - 1) < 1e-6
    assert E.embed_incremental(chunks.limit(0), stored, E.SeededModel(8)).count() == 0


def test_models_of_one_name_are_told_apart():
    ab, cd = E.loaded(E.LetterModel("ab")), E.loaded(E.LetterModel("cd"))
    assert [f(["abbc"]).tolist() for f in (ab, cd)] == [[[1, 2]], [[1, 0]]] and E.loaded(E.LetterModel("cd")) is cd
    E.loaded(E.LetterModel("e"))
    assert len(E._LOADED) == E.MOST_LOADED


def test_a_seeded_vector_is_the_same_everywhere():
    a, b = E.SeededModel(16).load()(["abc", "abd"])
    seed = int.from_bytes(__import__("hashlib").sha256(b"abc").digest(), "big") % (2**32 - 1)
    v = np.random.default_rng(seed).normal(0.0, 1.0, 16)
    assert np.allclose(a, v / np.linalg.norm(v)) and not np.allclose(a, b)


def test_a_missing_vector_and_a_wrong_dimension_fail_the_write(spark, tmp_path):
    chunks = spark.createDataFrame([("h1", "a"), ("h2", "b")], "content_hash string, chunk_text string")
    vectors = spark.createDataFrame([("h1", [1.0], True)], "content_hash string, embedding array<float>, reused boolean")
    with pytest.raises(Exception, match="no vector for content hash h2"):
        E.with_vectors(chunks, vectors).write.parquet(f"{tmp_path}/gap")
    with pytest.raises(Exception, match="gave .* for 2 texts of dimension 8"):
        E.embed_incremental(chunks, spark.createDataFrame([], STORED), Shapeless(8, "shapeless")).write.parquet(f"{tmp_path}/shape")


def test_rechunking_embeds_changes_only_and_skips_what_cannot_be_read(spark):
    docs = spark.createDataFrame([(1, "x" * 1500), (2, "y" * 100), (3, None)], "doc_id long, text string")
    model = E.LetterModel("xy")
    rows, report = E.rechunk_all(docs, D.flat_chunks, spark.createDataFrame([], STORED), model)
    assert sorted(map(tuple, report.collect())) == [(1, "success", None, 2, 2, 0), (2, "success", None, 1, 1, 0), (3, "skipped", "no text", 0, 0, 0)]
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 2, "y" * 99).otherwise(F.col("text")))
    report = E.rechunk_all(changed, D.flat_chunks, rows, model)[1]
    assert sorted(map(tuple, report.select("doc_id", "embedded_new", "reused").collect())) == [(1, 0, 2), (2, 1, 0), (3, 0, 0)]


CHUNKS = "document_id long, chunk_index int, parent_index int, chunk_text string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_document_is_replaced_in_its_bucket_only(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index", 8)
    index.replace(spark.createDataFrame([(i, j, 0 if j else None, f"{i}-{j}") for i in range(30) for j in range(3)] + [(None, 0, None, "lost"), (5, 0, None, "5-0")], CHUNKS))
    before, rows = files(index.path), {r.chunk_id: r for r in index.read().collect()}
    assert len(rows) == 90 and all(r.parent_id is None if r.chunk_index == 0 else rows[r.parent_id].chunk_text == f"{r.document_id}-0" for r in rows.values())
    index.replace(spark.createDataFrame([(3, 0, None, "revised A"), (3, 1, 7, "revised B")], CHUNKS))
    after = files(index.path)
    assert {os.path.dirname(f) for f in before.keys() ^ after.keys()} == {next(os.path.dirname(f) for f in after.keys() - before.keys())}
    assert len(after.keys() & before.keys()) == len(before) - 1 and all(after[f] == before[f] for f in after.keys() & before.keys())
    got = index.read().where("document_id = 3").orderBy("chunk_index").collect()
    assert [(r.chunk_text, r.parent_id) for r in got] == [("revised A", None), ("revised B", None)] and index.read().count() == 89


def test_a_few_documents_are_read_from_their_buckets(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index", 16)
    index.replace(spark.createDataFrame([(i, 0, None, f"text {i}") for i in range(64)], CHUNKS))
    found = index.chunks_of([5, 7, 999])
    assert sorted(r.chunk_text for r in found.collect()) == ["text 5", "text 7"]
    assert "bucket" in found._jdf.queryExecution().toString().split("PartitionFilters")[1].split("]")[0]


def test_deletes_can_be_repeated_and_may_empty_a_bucket(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index", 4)
    one = spark.createDataFrame([(1,), (1,), (99,)], "document_id long")
    assert index.delete(one) == 0
    index.replace(spark.createDataFrame([(1, 0, None, "x")], CHUNKS))
    assert [index.delete(one), index.delete(one), index.read().count()] == [1, 0, 0]
    index.replace(spark.createDataFrame([(1, 0, None, "again"), (2, 0, None, "y")], CHUNKS))
    assert sorted(r.chunk_text for r in index.read().collect()) == ["again", "y"]


def test_replaced_documents_may_have_other_columns(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index", 1)
    index.replace(spark.createDataFrame([(1, 0, None, "x")], CHUNKS))
    index.replace(spark.createDataFrame([(2, 0, None, "y", 4)], CHUNKS + ", page int"))
    assert sorted((r.document_id, r.page) for r in spark.read.option("mergeSchema", True).parquet(index.path).collect()) == [(1, None), (2, 4)]


# ---------------------------------------------------------------- gates

GOOD = "UN REGULATION No. 94. " + "Requirement text. " * 60


def item(i, url=None, text=GOOD, n=5000, pages=5, code="R94", head="%PDF-1.7"):
    return (i, url or f"https://unece.org/{i}.pdf", text, n, pages, code, head)


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, gates.ITEM).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path, name, **how):
    domains = spark.createDataFrame([("unece.org",)], "domain string")
    gates.ingest(spark, f"{tmp_path}/in/*", gates.ITEM, f"{tmp_path}/sink", f"{tmp_path}/check-{name}", name, domains, **how)


def rows_of(spark, tmp_path, table, *cols):
    return sorted((tuple(r) for r in gates.table(spark, f"{tmp_path}/sink", table).select(*cols).collect()), key=repr)


def test_every_gate_refuses_with_its_reason(spark):
    rows = [
        item(1, text="<html>UN Regulation No. 94</html>", head="<html><body>"), item(2, head="%PDF-1.4\nplaceholder", n=20), item(3, n=100), item(4, n=81 << 20), item(5, pages=0), item(6, text="a b"),
        item(7, text=GOOD[:120]), item(8, text=GOOD.replace("94", "940")), item(9, text=None), item(10, url="https://evil.example/unece.org"), item(11, url="http://unece.org/x"), item(12), item(13, code=None), item(14, code="Euro NCAP"), item(15, text=GOOD + " euroNCAP", code="Euro NCAP"), item(16, head=None),
    ]
    frame = spark.createDataFrame(rows, gates.ITEM)
    got = {r.item_id: (r.stage, r.outcome, r.reason) for r in gates.gated(frame, spark.createDataFrame([("unece.org",)], "domain string"), spark.createDataFrame([], "source_url string, _hash string")).collect()}
    refused = {1: "not %PDF-", 2: "placeholder", 3: "too small", 4: "too large", 5: "no pages", 6: "no text", 8: "regulation not named", 9: "unreadable", 14: "regulation not named", 16: "not %PDF-"}
    assert {k: v for k, v in got.items() if v[:2] == ("validate", "rejected")} == {k: ("validate", "rejected", v) for k, v in refused.items()}
    assert got[7] == ("validate", "needs_ocr", "thin text") and {got[k][0] for k in (10, 11)} == {"allowlist"}
    assert {got[k] for k in (12, 13, 15)} == {("tracker", "new", None)}


def test_duplicates_are_known_across_batches_and_runs(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", [item(1), item(2, url="https://unece.org/1.pdf"), item(3, text="x")])
    run(spark, tmp_path, "run1")
    put(spark, f"{tmp_path}/in", "b", [item(4, url="https://unece.org/1.pdf", text=GOOD + "changed"), item(5, url="https://unece.org/1.pdf", text=GOOD)])
    run(spark, tmp_path, "run1", files_a_batch=1)
    run(spark, tmp_path, "run1")  # nothing has come since
    assert rows_of(spark, tmp_path, "accepted", "item_id", "outcome", "batch") == [(1, "new", 0), (4, "changed", 1), (5, "changed", 1)]
    run(spark, tmp_path, "run2")
    assert [r for r in rows_of(spark, tmp_path, "accepted", "item_id", "outcome", "run") if r[2] == "run2"] == [(4, "changed", "run2"), (5, "changed", "run2")]
    assert rows_of(spark, tmp_path, "rejects", "item_id", "reason", "run") == [(3, "no text", "run1"), (3, "no text", "run2")]


def test_a_crash_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    put(spark, f"{tmp_path}/in", "a", [item(1), item(2, text="x"), item(3, head="no")])
    write, calls = gates._write, []

    def dying(rows, folder):
        calls.append(folder)
        if len(calls) == 3:  # landed and accepted are there, rejects are not
            raise RuntimeError("lost the driver")
        write(rows, folder)

    monkeypatch.setattr(gates, "_write", dying)
    with pytest.raises(Exception, match="lost the driver"):
        run(spark, tmp_path, "run1")
    assert rows_of(spark, tmp_path, "accepted", "item_id") == [(1,)]
    for _ in range(2):
        run(spark, tmp_path, "run1")
        assert rows_of(spark, tmp_path, "accepted", "item_id", "outcome") == [(1, "new")]
        assert rows_of(spark, tmp_path, "rejects", "item_id", "reason") == [(2, "no text"), (3, "not %PDF-")]
        assert rows_of(spark, tmp_path, "log", "stage", "outcome", "reason", "items") == sorted([
            ("allowlist", "passed", None, 3), ("tracker", "new", None, 1), ("validate", "passed", None, 1), ("validate", "rejected", "no text", 1), ("validate", "rejected", "not %PDF-", 1)], key=repr)
    log = gates.table(spark, f"{tmp_path}/sink", "log").collect()
    assert all(r.duration_ms > 0 and r.ended is not None for r in log)


def test_regulations_are_named_as_words(spark):
    texts = [("see R94.", "R94", True), ("UN R 94", "UN_R94", True), ("regulation no 94", "R94", True), ("No. 94", "R94", False), ("R945", "R94", False), ("FMVSS 208", "FMVSS 208", True), ("FMVSS208", "FMVSS 208", True), ("(a+b)", "a+b", True), ("xa+b", "a+b", False), (None, "", True)]
    got = spark.createDataFrame(texts, "t string, c string, want boolean").withColumn("named", D.names_regulation(F.col("t"), F.col("c")))
    assert [(r.t, r.c) for r in got.collect() if r.named is not r.want] == []


def test_the_column_function_gives_the_seeded_models_vectors(spark):
    from lexforge.operators import structure

    texts = spark.createDataFrame([("abc",), ("",)], "t string")
    got = {r.t: r.v for r in texts.select("t", structure.mock_embedding(F.col("t"), 16).alias("v")).collect()}
    want = E.SeededModel(16).load()(list(got))
    assert np.allclose(list(got.values()), want, atol=1e-6)
