"""Rules on questions, sections and versions by their own examples."""

import datetime as dt

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import documents as D
from lexforge.operators import questions as Q
from lexforge.operators import registry as G
from lexforge.operators import retrieval as R


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")


def test_filters(spark):
    rows = asked(
        spark, "What is the chest deflection limit under UN R94?", "the locking mechanism is deceleration-actuated only — check this against §7.6.2", "What is the difference between UN R44 and UN R129 for child restraints?", "limit in R94", "R95 and R94",
        "paragraph 7.6.2", "7.6.2 how does it lock", "7.6.2", "Euro NCAP 2026 side", "NCAP and its bodies", "FMVSS 208 and UN-R94, 05 series of amendments", "R94 or r94", None, "for 94", "NCAP 2024, 03 series", "FMVSS 20",
    )
    got = [(r.codes, r.amendment, r.source_type) for r in Q.filters(rows).orderBy("query_id").collect()]
    assert got == [
        (["UN_R94"], None, None), (["UN_R16"], None, None), (["UN_R129", "UN_R44"], None, "UNECE"), (["UN_R94"], None, None), (["UN_R94", "UN_R95"], None, "UNECE"),
        (["UN_R16"], None, None), (["UN_R16"], None, None), ([], None, None), ([], "Protocol Year 2026", "Euro NCAP"), ([], None, None), (["FMVSS 208", "UN_R94"], "05 Series", "FMVSS"), (["UN_R94"], None, "UNECE"), ([], None, None), ([], None, None), ([], "Protocol Year 2024", "Euro NCAP"), ([], None, None),
    ]


def test_expansion(spark):
    got = [r.expanded for r in Q.expand(asked(spark, "What is the chest deflection limit under UN R94?", "R44 and R129", "isofix in R 14", "R14 and R17 anchorage", "§7.6.2 lock", "nothing", None, "frontal chest R94, R95")).orderBy("query_id").collect()]
    assert got[0].endswith("UN R94? ThCC thorax compression criterion 42 mm 5.2.1.4") and got[1].startswith("R44 and R129 child restraint i-Size") and "Annex 6 anchorage table" in got[2]
    assert "child restraint" in got[3] and "Annex 6" in got[3] and got[4].startswith("§7.6.2 lock 7.6.2 emergency locking") and got[5:7] == ["nothing", None]
    assert "42 mm" in got[7] and "8 kN" in got[7] and "child restraint" in got[7]


def test_margins(spark):
    rows = asked(spark, "38.4mm thorax vs 42mm UN R94 limit, what's the margin?", "38.4mm vs 42mm limit, is that margin tight, what else is close to its limit?", "how far is it", "how close is 38.4 mm to the limit", "HIC 50 mm and 42 mm", "hic 50 mm and 42 mm headroom in r95", None)
    got = [tuple(r)[2:] for r in Q.margins(rows).orderBy("query_id").collect()]
    assert got[0] == (True, 38.4, 42.0, "ThCC", "UN_R94", 3.6, "PASS") and got[1] == (True, 38.4, 42.0, "ThCC", None, 3.6, "PASS")
    assert got[2] == got[3] == got[6] == (False, None, None, None, None, None, None)
    assert got[4] == (False, 50.0, 42.0, "HIC", None, -8.0, "FAIL") and got[5] == (True, 50.0, 42.0, "HIC", "UN_R95", -8.0, "FAIL")


def test_counting_questions_are_about_the_corpus_only_where_they_ask_for_it(spark):
    rows = asked(spark, "Which number of documents must the manufacturer submit?", "number of documents in the system", "how many pdfs are there", "list your sources", "what documents do you use", "coverage report", "how many documents in section 5")
    got = [r.i for r in rows.withColumn("i", R.intent(F.col("query"))).orderBy("query_id").collect()]
    assert got == ["regulatory", "corpus_meta", "corpus_meta", "corpus_meta", "corpus_meta", "corpus_meta", "regulatory"]


def test_scope_chunks(spark):
    rows = [("2.10", "x", True), ("5.2", "[h] 12 June 2024 amendment", True), ("5.2", "[h] 12.06.2024", False), ("6", "As defined in the Consolidated Resolution", True), ("5.2", "3 may 1999", False), ("General", "", True), ("5", "text", False)]
    got = spark.createDataFrame(rows, "section string, body string, want boolean").withColumn("s", R.is_scope(F.col("section"), F.col("body")))
    assert [(r.section, r.body) for r in got.collect() if r.s is not r.want] == []


MARKDOWN = """
lead
# 1. Scope
This is the scope section content.

# 5.2.1. Dynamic Performance
This is the dynamic test performance requirements.
It should be consolidated.

## Annex 3 Barrier Specifications
Details about AE-MDB barrier specifications.
# Foreword
words
# 1
more scope

### Appendix B - Forms
#not a heading
# 7. Empty
"""


def test_markdown_sections(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(MARKDOWN.split("\n"))] + [(2, 0, None), (3, 0, "# 4"), (3, 1, "four")], "doc_id int, line_no int, line string")
    got = {(r.doc_id, r.section): (r.title, r.text) for r in D.markdown_sections(lines).collect()}
    assert got == {
        (1, "General"): ("General Context", "lead\n\nwords"), (1, "1"): ("Scope", "This is the scope section content.\n\nmore scope"), (1, "5.2.1"): ("Dynamic Performance", "This is the dynamic test performance requirements.\nIt should be consolidated."),
        (1, "Annex 3"): ("Barrier Specifications", "Details about AE-MDB barrier specifications."), (1, "Appendix B"): ("Forms", "#not a heading"), (3, "4"): ("Section 4", "four"),
    }


def test_dates(spark):
    want = {"2025-01-01": dt.date(2025, 1, 1), "23 June 2011": dt.date(2011, 6, 23), "March 15, 2023": dt.date(2023, 3, 15), "2026": dt.date(2026, 1, 1), "invalid-date": None, "edition 2017": None, "15.03.2024": dt.date(2024, 3, 15), "on 15.03.2024": None, "31 June 2011": None, "2025-01-01 and on": dt.date(2025, 1, 1), None: None}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.any_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in got.collect()} == want


def test_several_active_versions_of_a_key_take_one_change(spark):
    cols = "version_id long, code string, amendment string, file_hash string"
    registry = spark.createDataFrame([(1, "R94", "05", "a", "ACTIVE"), (2, "R94", "05", "b", "ACTIVE"), (3, "R14", "07", "c", "ACTIVE"), (4, "R14", "07", "d", "ACTIVE"), (5, "R9", None, None, "ACTIVE")], cols + ", status string")
    incoming = spark.createDataFrame([(10, "R94", "05", "new"), (11, "R14", "07", "d"), (12, "R9", None, None)], cols)
    got = sorted((r.version_id, r.status, r.closed_by) for r in G.apply_versions(registry, incoming, ["code", "amendment"]).collect())
    assert got == [(1, "SUPERSEDED", 10), (2, "SUPERSEDED", 10), (3, "ACTIVE", None), (4, "ACTIVE", None), (5, "ACTIVE", None), (10, "ACTIVE", None)]


def test_results_nearest_to_their_clauses_limits(spark):
    from lexforge.operators import records as H

    results = spark.createDataFrame(
        [(1, 1, "ThCC", 41.0, "R94#5.1"), (1, 2, "HIC36", 10.0, "R94#5.2"), (2, 1, None, 41.5, "R94#9.9"), (3, 1, "ThCC", 41.9, "R94#5.1"), (4, 1, "ThCC", None, "R94#5.1"), (5, 1, "Force", 9.0, "no link"), (6, 1, "ThCC", 45.0, "R94#5.1"), (7, 1, "ThCC", 1.0, None)],
        "record_id int, position int, criterion string, value double, link string",
    )
    tests = spark.createDataFrame([(3, True, "other"), (6, True, "me"), (1, False, None)], "record_id int, confidential boolean, owner string")
    versions = spark.createDataFrame([(1, "R94", dt.date(2000, 1, 1)), (2, "R94", dt.date(2020, 1, 1)), (3, "R94", None)], "version_id int, code string, effective date")
    clauses = spark.createDataFrame([(1, 1, "5.1", "ThCC shall not exceed 50 mm"), (2, 2, "5.1", "ThCC shall not exceed 42 mm"), (3, 2, "5.2", "HIC36 less than 80 g")], "clause_id int, version_id int, section string, text string")
    got = [(r.place, r.record_id, r.position, r.limit_value, r.headroom, r.verdict) for r in H.close_to_limits(results, tests, versions, clauses, "me", 42.0, 4).orderBy("place").collect()]
    assert got == [(1, 6, 1, 42.0, -3.0, "FAIL"), (2, 2, 1, 42.0, 0.5, "PASS"), (3, 1, 1, 42.0, 1.0, "PASS"), (4, 5, 1, 42.0, 33.0, "PASS")]
    assert H.close_to_limits(results.limit(0), tests, versions, clauses, None, 42.0).count() == 0
