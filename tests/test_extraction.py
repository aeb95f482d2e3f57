"""Metadata of first pages, records of test reports, and prompts within a budget, on inline rows."""

import datetime as dt

from pyspark.sql import functions as F

from lexforge.operators import extraction as X
from lexforge.operators import records as H

PAGES = [
    ("r95_05_amendment.pdf", "AGREEMENT CONCERNING THE ADOPTION OF UNIFORM TECHNICAL PRESCRIPTIONS\nRegulation No. 95\nUniform provisions concerning the approval of vehicles with regard to the protection\nof the occupants in the event of a lateral collision.\nIncorporating: 05 series of amendments - Date of entry into force: 2025-01-01\n"),
    ("euro_ncap_aop_2026.pdf", "EUROPEAN NEW CAR ASSESSMENT PROGRAMME (Euro NCAP)\nEURO NCAP Adult Occupant Protection (AOP) Assessment Protocol\nVersion 9.5 - Implementation Year 2026\nPublished November 2025\n"),
    ("fmvss_214.pdf", "DEPARTMENT OF TRANSPORTATION\nStandard No. 214 - Side Impact Protection\nThis standard FMVSS 214 establishes performance requirements for side crashworthiness.\n"),
    ("nhtsa_recall_23v123.pdf", "NHTSA Recall Campaign Number 23V-123\nSubject: Frontal airbag module defect.\nDate issued: March 15, 2023\n"),
    ("iihs_side_test.pdf", "INSURANCE INSTITUTE FOR HIGHWAY SAFETY\nIIHS Side Impact Collision Test Procedure (Version II)\nPublished June 2021\n"),
    ("UNECE_notes-draft.pdf", "Supplement 3 to the 7 series of amendments, Corrigendum 2, UN R14"),
    ("misc.pdf", "the modified scope of 2019, consider the front"),
    (None, None),
    ("odi.pdf", "ODI investigation PE23-004 opened: 12.06.2023"),
    ("x.pdf", "EuroNCAP, scope of the protocol"),
    ("x.pdf", "49 CFR § 571.208"),
    ("x.pdf", "IIHS, upsides considered"),
]


def test_metadata_by_authority(spark):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(PAGES)], "i int, file_name string, text string")
    got = [r for r in X.metadata(frame).orderBy("i").collect()]
    fields = [(r.source_type, r.code, r.amendment, r.effective_date, r.market) for r in got]
    assert fields[:5] == [
        ("UNECE", "R95", "05 Series", dt.date(2025, 1, 1), "GLOBAL"), ("Euro NCAP", "Euro NCAP 2026 - Adult Occupant Protection", "Protocol Year 2026", dt.date(2026, 1, 1), "EU"), ("FMVSS", "FMVSS 214", None, dt.date(2024, 1, 1), "US"),
        ("NHTSA", "NHTSA Recall 23V-123", None, dt.date(2023, 3, 15), "US"), ("IIHS", "IIHS Side Impact", None, dt.date(2021, 6, 1), "US"),
    ]
    assert "lateral collision" in got[0].title and "Side Impact Protection" in got[2].title and got[0].publication_date == dt.date(2025, 1, 1) and got[1].publication_date == dt.date(2025, 11, 1)
    assert (got[5].source_type, got[5].code, got[5].amendment, got[5].supplement, got[5].corrigendum, got[5].title) == ("UNECE", "R14", "07 Series", "Supplement 3", "Corrigendum 2", "UNECE notes draft")
    # "ODI" is not in "modified", "COP" not in "scope", "SIDE" not in "consider"
    assert fields[6] == ("INTERNAL", "INTERNAL", None, dt.date(2019, 1, 1), "GLOBAL") and got[7].title == X.NO_TITLE and fields[7][:2] == ("INTERNAL", "INTERNAL")
    assert fields[8][:2] == ("NHTSA", "NHTSA ODI PE") and fields[8][3] == dt.date(2023, 6, 12) and got[8].title == "NHTSA Investigation: PE23-004"
    assert fields[9][1] == "Euro NCAP 2026 - General" and fields[10][1] == "FMVSS 208" and fields[11][1] == "IIHS Protocol"


REPORT = "Lab report\nProgram:  Sedan X \nTest test-2026-01-007 of 2026-03-04\nImpact mode: side_mdb\nDummy: THOR 50M\nThCC: 38.4 mm\nHIC | 612\nHIC36 700.5\nTCFC 3 kN\nThCC 1 mm"


def test_reports_become_records_with_all_results_or_all_errors(spark):
    rows = [(1, REPORT), (2, "TEST-2026-001-002 on 2026-02-30, ThCC 5"), (3, "nothing here"), (4, " \n"), (5, None), (6, "TEST-2026-01-001 2026-01-02 hic 1"), (7, "2026-01-02 ThCC none")]
    read = X.read_reports(spark.createDataFrame(rows, "report_id int, text string").withColumn("linked_clause", F.lit("UN_R94#5.2.1")))
    got = {r.report_id: r for r in read.collect()}
    one = got[1].record
    assert (one.test_id, one.program, one.date, one.impact_mode, one.dummy, one.confidential) == ("TEST-2026-01-007", "Sedan X", "2026-03-04", "SIDE_MDB", "THOR 50M", True)
    assert [(r.position, r.criterion, r.value) for r in one.results] == [(1, "ThCC", 38.4), (2, "HIC36", 612.0), (3, "HIC36", 700.5), (4, "TCFC", 3.0), (5, "ThCC", 1.0)]
    assert {k: r.errors for k, r in got.items() if k > 1} == {2: ["invalid date: 2026-02-30"], 3: [X.NO_ID, X.NO_DATE, X.NO_RESULT], 4: [X.NO_TEXT], 5: [X.NO_TEXT], 6: [], 7: [X.NO_ID, X.NO_RESULT]}
    assert (got[6].record.program, got[6].record.impact_mode, got[6].record.dummy) == ("UPLOADED", "FRONTAL_OFFSET", None) and all(got[k].record is None for k in (2, 3, 4, 5, 7))
    versions = spark.createDataFrame([(1, "UN_R94", dt.date(2020, 1, 1))], "version_id long, code string, effective date")
    clauses = spark.createDataFrame([(1, 1, "5.2.1", "ThCC shall not exceed 42 mm")], "clause_id long, version_id long, section string, text string")
    linked = {(r.record_id, r.position): (r.verdict, r.headroom) for r in H.link_results(X.report_results(read), versions, clauses).collect()}
    assert linked[1, 1] == ("PASS", 3.6) and linked[1, 5] == ("PASS", 41.0) and len(linked) == 6


def plain_tokens(text):
    return max(1, int(len(text.split()) * 1.33))


def plain_cut(text, most):
    return text if plain_tokens(text) <= most else " ".join(text.split()[: max(1, int(most / 1.33))]) + X.CUT_MARK


def plain(passages, limit):
    """The rule, level by level, on whole texts."""
    for level in range(X.LEVELS + 1):
        p = passages[: X.MOST_PASSAGES]
        p = p[: max(1, len(p) - min(level, len(p) - 1))]
        if level >= 2:
            p = [plain_cut(x, int(len(x) * max(0.35, 1 - 0.25 * (level - 1)))) for x in p]
        body = plain_cut("\n\n".join(p), 3500 if level == 0 else max(300, 3500 // (level + 1)))
        if plain_tokens(body) <= limit or level == X.LEVELS:
            return level, plain_tokens(body), len(p), body, plain_tokens(body) <= limit


def test_the_least_level_that_fits(spark):
    sets = {1: ["a b c"] * 3, 2: ["word " * 900] * 8, 3: ["x " * 3000], 4: [""], 5: ["i " * 50, "one two", "j " * 400], 6: ["w " * 200] * 6}
    limits = {1: 100, 2: 1500, 3: 200, 4: 1, 5: 90, 6: 700}
    passages = spark.createDataFrame([(q, i + 1, t) for q, ts in sets.items() for i, t in enumerate(ts)] + [(1, 9, "beyond")], "query_id int, rank int, text string")
    got = {r.query_id: tuple(r)[1:] for r in X.compress_prompts(passages, spark.createDataFrame(list(limits.items()), "query_id int, limit int")).collect()}
    assert got == {q: plain(ts, limits[q]) for q, ts in sets.items()}
    assert got[3][4] is False and got[2][0] > 0
