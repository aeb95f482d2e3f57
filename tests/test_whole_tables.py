"""Queries over whole tables: rows beyond the first few documents count, and the SQL says the same."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexforge.operators import records
from lexforge.plans import catalog
from tests.test_queries import plain

DOCS = 1200


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents whose longest are beyond the first 400, orders of every remainder."""
    d = tmp_path_factory.mktemp("whole")
    langs, words = ["de", "en", "es", "fr"], "the of and der die les une for plain word".split()
    texts = [" ".join(words[(i * 7 + j) % len(words)] for j in range(1 + i % 30)) + f" n{i}" for i in range(DOCS)]
    texts[805], texts[1001], texts[804] = "an idiot " * 400, "a moron", "long " + " ".join(f"w{i}" for i in range(900))
    documents = {"doc_id": range(DOCS), "text": texts, "lang": [langs[i % 4] for i in range(DOCS)], "source": ["web"] * DOCS, "n_chars": [len(t) if i in (804, 805) else 100 + i for i, t in enumerate(texts)]}
    orders = {"o_orderkey": range(1, 41), "o_totalprice": [1000.0 * (i * 13 % 90) for i in range(1, 41)]}
    lines = [(o, n, float((o * n) % 50 + 1)) for o in range(1, 41) for n in range(1, 4)]
    pq.write_table(pa.table({k: pa.array(v) for k, v in documents.items()}), d / "documents.parquet")
    pq.write_table(pa.table({k: pa.array(v) for k, v in orders.items()}), d / "orders.parquet")
    pq.write_table(pa.table({k: pa.array(v) for k, v in zip(("l_orderkey", "l_linenumber", "l_quantity"), zip(*lines, strict=True), strict=True)}), d / "lineitem.parquet")
    return str(d)


def same_as_whole(spark, folder, name):
    sql = catalog.ORACLE_SQL[name]
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, folder)
    rows = got.collect()
    assert plain([tuple(r) for r in rows], got.columns) == plain(want.fetchall(), names)
    return rows


@pytest.mark.parametrize("name", ["scope_demotion", "annex_promotion", "cited_promotion", "parent_expansion", "crossref_expansion"])
def test_sections_come_from_all_documents(spark, folder, name):
    rows = same_as_whole(spark, folder, name)
    if name != "crossref_expansion":  # which gives cited documents only
        assert max(r.doc_id for r in rows) >= 400


@pytest.mark.parametrize("name", ["retrieval_diff", "timing_summary", "case_eval"])
def test_records_of_the_whole_table(spark, folder, name):
    rows = same_as_whole(spark, folder, name)
    if name == "case_eval":  # document 805 alone has the first case's word, 1001 the second's
        clean = {r.case_id: r.clean for r in rows}
        assert clean[1] is False and clean[2] is False and clean[3] is True
    else:
        assert len(rows) == {"retrieval_diff": DOCS - 1, "timing_summary": 40}[name]


CASE = "case_id int, must_contain array<string>, together array<string>, must_not array<string>, codes array<string>, needs_table boolean, min_pipes int"
HIT = "case_id int, code string, chunk_type string, text string"


def checked(spark, cases, hits):
    return {r.case_id: tuple(r)[1:] for r in records.check_cases(spark.createDataFrame(cases, CASE), spark.createDataFrame(hits, HIT)).collect()}


def test_cases_without_hits_stay(spark):
    got = checked(spark, [(1, ["a"], ["a"], ["b"], None, None, None), (2, ["a"], ["a"], ["b"], [], False, None), (3, None, None, None, None, None, None)], [(1, None, None, "A"), (1, "x", "y", None), (9, "x", "y", "b")])
    # found, codes_ok, together, clean, table_ok, retrieved, passed
    assert got == {1: (True, True, True, True, True, 2, True), 2: (False, False, False, True, True, 0, False), 3: (True, False, True, True, True, 0, False)}


def test_cases_ask_for_words_codes_and_whole_tables(spark):
    rows = "| M1 | 3 |\n| --- | --- |\n" * 4
    cases = [
        (1, ["annex 6", "vehicle"], ["Vehicle category", "N2 & N3"], ["hic", " une"], ["UN_R14"], True, 20), (2, ["thcc"], [], ["head injury criterion", " hic"], ["UN_R94", "UN_R95"], False, None),
        (3, [], ["a"], ["(x)"], [], True, 3), (4, [], [], ["hi"], ["UN_R1"], True, None),
    ]
    hits = [
        (1, "UN_R14", "clause", "Annex 6 " + rows), (1, "UN_R16", "clause", f"Vehicle category N2 & N3 {rows}"), (1, "UN_R16", "table", "which chic tunes"), (2, "UN_R94", None, "ThCC"), (2, None, None, "hic"),
        (3, "c", "table", "|||"), (3, "c", "clause", "|||| a"), (4, "UN_R1", "table", "|" * 20 + " this"),
    ]
    got = checked(spark, cases, hits)
    assert got[1] == (True, True, True, True, True, 3, True) and got[2] == (True, False, True, False, True, 2, False)
    assert got[3] == (True, True, True, True, False, 2, False) and got[4] == (True, True, True, True, True, 1, True)


def test_more_cases_than_a_batch_may_have_are_refused(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_CASES", 1)
    with pytest.raises(ValueError, match="more than 1 cases"):
        checked(spark, [(1, None, None, None, None, None, None), (2, None, None, None, None, None, None)], [(1, "", "", "")])
