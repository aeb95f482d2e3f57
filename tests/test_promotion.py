"""Question-driven promotion, reranking of candidates, and edges from cited paragraphs."""

from pyspark.sql import functions as F

from lexforge.operators import retrieval as R

RANKED = "query_id int, rank int, doc_id long, section string, chunk_type string, text string, score double"


def ranked(spark, *sections, query=1):
    return spark.createDataFrame([(query, i + 1, 10 + i, s, k, t, 1.0 / (i + 1)) for i, (s, k, t) in enumerate(sections)], RANKED)


def asked(spark, *questions):
    return spark.createDataFrame([(i + 1, q) for i, q in enumerate(questions)], "query_id int, query string")


def order(found):
    return [r.doc_id for r in found.orderBy("rank").collect()]


def test_a_named_annex_is_promoted_tables_first(spark):
    rows = ranked(spark, ("5.1", "clause", ""), ("5.2", "clause", ""), ("5.3", "clause", ""), ("UN_Annex_6", "clause", "prose"), ("Annex_6.1", "table", ""), ("Annex_61", "table", ""), (None, None, None))
    assert order(R.promote_annex(rows, asked(spark, "what does Annex 6 say"), 3)) == [10, 11, 14]
    assert order(R.promote_annex(rows, asked(spark, "annex 61?"), 3)) == [10, 11, 15]
    assert order(R.promote_annex(rows, asked(spark, "annexes in general"), 3)) == order(R.promote_annex(rows, asked(spark, None), 3)) == [10, 11, 12]
    words = ranked(spark, ("1", "clause", ""), ("Annex_2", "clause", ""), ("Annex_2", "clause", "Vehicle category M1"))
    assert order(R.promote_annex(words, asked(spark, "ANNEX2 limits"), 1)) == [12]


def test_cited_sections_are_promoted_the_deepest_first(spark):
    rows = ranked(spark, ("4", "clause", ""), ("9", "clause", ""), ("5", "clause", ""), ("5.2.1", "clause", ""), ("5.2.1.4", "clause", ""), ("5.20", "clause", ""), ("", "clause", ""))
    assert order(R.promote_cited(rows, asked(spark, "see §5.2.1"), 2)) == [10, 14]
    assert order(R.promote_cited(rows, asked(spark, "paragraph 5.2 please"), 2)) == [10, 14]
    assert order(R.promote_cited(rows, asked(spark, "5.2.1.9 alone"), 2)) == [10, 14] and order(R.promote_cited(rows, asked(spark, "in 5.2"), 2)) == [10, 11]
    assert order(R.promote_cited(rows, asked(spark, "paragraph 9"), 2)) == [10, 11]


def test_only_candidates_are_reranked_by_any_score(spark):
    passages = spark.createDataFrame([(1, "head injury limit"), (2, "head"), (3, "head injury limit of all"), (4, None)], "doc_id long, text string")
    candidates = spark.createDataFrame([(1, 2), (1, 1), (1, 4), (2, 3)], "query_id int, doc_id long")
    questions = asked(spark, "Head injury, limit?", "all")
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in R.rerank(questions, candidates, passages, 2).collect()) == [(1, 1, 1, 3), (1, 2, 2, 1), (2, 1, 3, 1)]
    longest = R.rerank(questions, candidates, passages, 1, lambda query, text: F.coalesce(F.char_length(text), F.lit(0)))
    assert sorted((r.query_id, r.doc_id) for r in longest.collect()) == [(1, 1), (2, 3)]


def test_edges_come_from_cited_text(spark):
    chunks = spark.createDataFrame([(1, "R94", "see paragraphs 5.2.1.4 and para. 9."), (2, "R94", "Paragraph 5.2"), (3, "R95", "paragraph 5.2.1"), (4, "R94", None)], "doc_id long, code string, text string")
    sections = spark.createDataFrame([("R94", "5.2", 20), ("R94", "5.2.1", 21), ("R95", "5", 30)], "code string, section string, doc_id long")
    edges = R.longest_prefix(R.citations(chunks), sections)
    assert sorted(map(tuple, edges.collect())) == [(1, 0, "5.2.1.4", 21), (2, 0, "5.2", 20), (3, 0, "5.2.1", 30)]


def test_the_whole_way_of_a_question(spark):
    corpus = spark.createDataFrame(
        [(1, "head limit one", [1.0, 0.0], "1", "clause", None), (2, "head limit two two", [0.9, 0.1], "5.2.1", "clause", 9), (3, "head", [0.5, 0.5], "Annex_3", "table", None), (4, "head limit", [0.8, 0.2], "5.3", "clause", 9), (5, "limit", None, "Annex_3", "clause", None), (9, "parent text", None, "5", "section", None), (10, None, None, None, None, None)],
        "doc_id long, text string, embedding array<double>, section string, chunk_type string, parent_id long",
    )
    ask = lambda q: spark.createDataFrame([(1, q, [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    got = lambda q, k, **how: [(r.doc_id, r.is_parent) for r in R.search(ask(q), corpus, k, **how).orderBy("rank").collect()]
    # the scope chunk goes behind, the parent follows its first chunk, and the list is cut after that
    assert got("head limit", 4) == [(2, 0), (9, 1), (4, 0), (3, 0)] and got("head limit", 4, parents=0) == [(2, 0), (4, 0), (3, 0), (5, 0)]
    # a named annex is promoted, its table first; a cited paragraph takes the last place after it
    assert got("head limit annex 3", 2, parents=0) == [(2, 0), (3, 0)] and got("head limit annex 3, paragraph 5.3", 2, parents=0) == [(2, 0), (4, 0)]
    # any score reranks the candidates, scope still goes behind
    assert got("head limit", 3, parents=0, score=lambda q, t: -F.char_length(t)) == [(3, 0), (5, 0), (4, 0)]
    assert R.search(ask("head").limit(0), corpus, 3).count() == 0
