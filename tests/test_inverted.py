"""Inverted index and codes in texts: stems, all-terms search, pruned reads, unique codes."""

import pytest
from pyspark.sql import functions as F

from lexforge.operators import inverted as I

DOCS = [(1, "The limits of head injuries are tested, testing every limit"), (2, "head injury limit"), (3, "Head restraint"), (4, None), (5, "the and of"), (None, "head injury limit"), (6, "Prüfung des Kopfes"), (2, "twice")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = I.InvertedIndex(spark, str(tmp_path_factory.mktemp("inverted")), 8)
    found.build(spark.createDataFrame(DOCS, "doc_id long, text string"))
    return found


def test_stems(spark):
    want = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "fee", "agreed": "agree", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflate", "troubling": "trouble", "hopping": "hop", "falling": "fall", "filing": "fil", "happy": "happi", "sky": "sky", "gas": "ga", "s": "s"}
    got = I.stemmed(spark.createDataFrame([(w,) for w in want], "w string").withColumn("s", F.col("w")), "s")
    assert {r.w: r.s for r in got.collect()} == want


def search(spark, index, *questions, k=5):
    return sorted((r.query_id, r["rank"], r.doc_id) for r in index.search(spark.createDataFrame(list(enumerate(questions)), "query_id int, query string"), k).collect())


def test_documents_have_all_terms_in_any_form(spark, index):
    assert search(spark, index, "Limit of head injuries", "restraints", "head airbag", "the of", None, "test limits", "twice head", "Kopfes Prüfung") == [(0, 1, 2), (0, 2, 1), (1, 1, 3), (5, 1, 1), (6, 1, 2), (7, 1, 6)]
    assert search(spark, index, "head", k=2) == [(0, 1, 3), (0, 2, 2)]


def test_only_the_terms_folders_and_row_groups_are_read(spark, index):
    asked = spark.createDataFrame([("restraint",)], "term string")
    plan = index.of_terms(asked)._jdf.queryExecution().toString()
    bucket = spark.createDataFrame([("restraint",)], "term string").select(I._bucket(8)).first()[0]
    assert f"bucket#" in plan and f"= {bucket})" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,restraint)" in plan
    rows = index.of_terms(asked).collect()
    assert [(r.term, r.docs, r.counts, r.lengths) for r in rows] == [("restraint", [3], [1], [2])]


def test_blocks_are_bounded(spark, tmp_path):
    index = I.InvertedIndex(spark, str(tmp_path), 2)
    index.build(spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("common word").alias("text")))
    sizes = index.postings().where("term = 'common'").select(F.size("docs")).collect()
    assert sorted(r[0] for r in sizes) == [452, 1024, 1024]
    empty = I.InvertedIndex(spark, f"{tmp_path}/none", 2)
    empty.build(spark.createDataFrame([], "doc_id long, text string"))
    assert search(spark, empty, "common") == []


def test_no_pair_of_question_and_document_is_shuffled(spark, tmp_path):
    n = 3000
    index = I.InvertedIndex(spark, str(tmp_path), 2)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word w"), (F.col("id") % 7).cast("string"), F.lit(" w"), (F.col("id") % 11 + 20).cast("string")).alias("text"))
    index.build(docs)
    assert not {p for p in (tmp_path).iterdir()} - {tmp_path / x for x in ("postings", "terms", "size")}
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("common word w"), (F.col("id") % 7).cast("string"), F.lit(" w"), (F.col("id") % 11 + 20).cast("string")).alias("query"))
    out = index.search(asked, 5)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    assert got == {q: {i + 1: d for i, d in enumerate([d for d in range(n) if d % 7 == q % 7 and d % 11 == q % 11][:5])} for q in range(300)}
    # the only rows that leave a task are the best of each block for each of the 77 sets of terms
    sizes = [r.n for r in index._best(asked.select(F.array_sort(F.split("query", " ")).alias("terms")).distinct(), 5, 1.2, 0.75, n, 4.0).groupBy("terms").agg(F.count("*").alias("n")).collect()]
    assert sizes == [5] * 77


def test_questions_beyond_one_batch_are_all_answered(spark, index, monkeypatch):
    monkeypatch.setattr(I, "ASKED", 2)
    monkeypatch.setattr(I, "SLICE", 1)
    assert search(spark, index, "Limit of head injuries", "restraints", "head airbag", "the of", None, "test limits", "twice head", "Kopfes Prüfung") == [(0, 1, 2), (0, 2, 1), (1, 1, 3), (5, 1, 1), (6, 1, 2), (7, 1, 6)]


CODES = [("R16",), ("R94",), ("R095",), ("FMVSS 208",), ("Euro NCAP AOP",), ("UN_R94",), (None,)]


def resolved(spark, *files):
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "file_id int, file_code string, text string")
    return [(r.code, r.how) for r in I.resolve_files(rows, spark.createDataFrame(CODES, "code string")).orderBy("file_id").collect()]


def test_names_decide_first_then_a_text_that_names_one_code(spark):
    got = resolved(
        spark, ("UN_R016", "UN REGULATION No. 94"), ("UNKNOWN", "UN REGULATION No. 16\nSafety-belts"), (None, "see UN R94 and R 16"), (None, "Some random document without regulation id."), (None, None),
        (None, "R160, R940 and XR94"), ("fmvss_208", ""), (None, "by FMVSS-208, FMVSS 208 and fmvss208"), (None, "the Euro NCAP (AOP)"), (None, "R095 or Regulation No 95"), (None, "UN_R94, R94, Regulation No. 094"),
    )
    assert got == [("R16", "filename"), ("R16", "text"), (None, "ambiguous"), (None, "none"), (None, "none"), (None, "none"), ("FMVSS 208", "filename"), ("FMVSS 208", "text"), ("Euro NCAP AOP", "text"), ("R095", "text"), ("R94", "text")]
