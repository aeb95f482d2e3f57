"""Registry operators on inline rows: closings, gates and batches, and their edge cases."""

from pyspark.sql import functions as F

from lexforge.operators import registry as G


def test_a_new_hash_closes_the_active_version(spark):
    cols = "version_id long, code string, amendment string, file_hash string"
    registry = spark.createDataFrame([(1, "R94", None, "a", "ACTIVE"), (2, "R94", "05", "b", "ACTIVE"), (3, "R14", "07", "c", "SUPERSEDED"), (4, "R14", "07", "d", "ACTIVE")], cols + ", status string")
    incoming = spark.createDataFrame([(10, "R94", None, "new"), (11, "R94", "05", "b"), (12, "R16", None, "e")], cols)
    got = {r.version_id: (r.status, r.closed_by) for r in G.apply_versions(registry, incoming, ["code", "amendment"]).collect()}
    assert got == {1: ("SUPERSEDED", 10), 2: ("ACTIVE", None), 3: ("SUPERSEDED", None), 4: ("ACTIVE", None), 10: ("ACTIVE", None), 12: ("ACTIVE", None)}


def test_gates_settle_at_the_first_stage_that_refuses(spark):
    rows = [(1, False, "REJECTED: too small", "NEW"), (2, True, "NEEDS_OCR: thin text", "NEW"), (3, True, "REJECTED: unreadable", "NEW"), (4, True, "ACCEPTED", "DUPLICATE"), (5, True, "ACCEPTED", "CHANGED")]
    gated = G.gate(spark.createDataFrame(rows, "item int, allowed boolean, checked string, change string"))
    assert [(r.stage, r.outcome, r.reason) for r in gated.orderBy("item").collect()] == [("allowlist", "rejected", "domain not allowed"), ("validate", "needs_ocr", "thin text"), ("validate", "rejected", "unreadable"), ("tracker", "duplicate", None), ("tracker", "changed", None)]
    log = {(r.stage, r.outcome): r["items"] for r in G.gate_log(gated).collect()}
    assert log == {("allowlist", "rejected"): 1, ("allowlist", "passed"): 4, ("validate", "needs_ocr"): 1, ("validate", "rejected"): 1, ("validate", "passed"): 2, ("tracker", "duplicate"): 1, ("tracker", "changed"): 1}


def test_batches_count_each_file_once(spark):
    files = [(1, "R14", "h1", "t1", "ACCEPTED"), (2, "R14", "h1", "t9", "ACCEPTED"), (3, "R99", "h1", "t1", "ACCEPTED"), (4, "R14", "h4", "t1", "ACCEPTED"), (5, "R14", "h5", None, "REJECTED: too small"), (6, "R14", "h6", None, "ACCEPTED"), (7, None, "h7", None, "ACCEPTED"), (8, "R14", None, None, "ACCEPTED")]
    rows = spark.createDataFrame(files, "file_id int, code string, file_hash string, text_hash string, checked string")
    expected, stored = spark.createDataFrame([("R14",), ("R14",)], "code string"), spark.createDataFrame([("h6", None), (None, "t5")], "file_hash string, text_hash string")
    got = {r.file_id: r.status for r in G.offline_batch(rows, expected, stored).collect()}
    assert got == {1: "ACCEPTED", 2: "DUPLICATE", 3: "UNMAPPED", 4: "DUPLICATE", 5: "REJECTED", 6: "DUPLICATE", 7: "UNMAPPED", 8: "ACCEPTED"}


def test_removal_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "vec_id int")
    gone = spark.createDataFrame([(2,), (2,), (None,)], "doc_id int")
    assert sorted(G.without(rows, gone, "vec_id").collect(), key=str) == [(1,), (None,)]


def test_audits_and_refusals(spark):
    rows = spark.createDataFrame([("05 Series", "UN_R94_05Series.pdf"), ("4 series of amendments", "UN_R94_05Series.pdf"), (None, "UN_R94_05Series.pdf"), ("05", "UN_R94.pdf")], "amendment string, file_name string")
    assert [r.mismatch for r in G.amendment_audit(rows).collect()] == [False, True, False, False]
    cases = [
        (True, "limit of R999", "R999 is nonexistent", "I could not find it", False, True),
        (True, "limit of R999", "R999 is nonexistent", "The limit is 42 mm, as everybody knows", False, False),
        (True, "limit of R999", "R999 is nonexistent", "See UN R94 for such a limit instead", False, False),
        (True, "x", "not in corpus", "R 999 it is, more or less as expected", False, True),
        (True, "x", "y", "", True, True),
        (True, "x", "y", None, False, True),
        (True, "x", "y", "a long answer that says all sorts of things", False, False),
        (False, "x", "y", "sorry", False, None),
    ]
    got = spark.createDataFrame(cases, "e boolean, q string, t string, a string, o boolean, want boolean").select("want", G.refusal_is_correct(*[F.col(c) for c in "eqtao"]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_comparison_of_runs(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "case_id int, passed boolean")
    b = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "case_id int, passed boolean")
    assert {r.case_id: r.outcome for r in G.compare_runs(a, b).collect()} == {1: "tie", 2: "structure_wins", 3: "flat_wins", 4: "both_fail"}
    assert tuple(G.run_comparison(a, b).first()) == (4, 2, 2, 0.5, 0.5, 1, 1, 1, False)
    none = a.where("false")
    assert tuple(G.run_comparison(none, none).first())[:5] == (0, 0, 0, 0.0, 0.0)


def test_runs_differ_by_fingerprints(spark):
    head = "[Source: UNECE | Reg: UN_R94 | Amendment: {} | Doc: a.pdf | Page: {} | Section: 5.2.1 | Type: clause]\n\n{}"
    before = [(1, head.format("04", 3, "ThCC")), (1, head.format("04", 3, "ThCC")), (1, head.format("04", 4, "HIC")), (1, "no header"), (2, head.format("x", 1, "same")), (3, None)]
    after = [(1, head.format("05", 3, " ThCC ")), (1, head.format("04", 5, "HIC")), (1, "no header"), (2, head.format("y", 1, "same")), (4, "new")]
    frames = [spark.createDataFrame(x, "case_id int, context string") for x in (before, after)]
    diffs = G.diff_runs(*frames)
    assert sorted(map(tuple, diffs.collect())) == [(1, 3, 3, 2, 0.5), (2, 1, 1, 1, 1.0), (3, 1, 0, 0, 0.0), (4, 0, 1, 0, 0.0)]
    assert tuple(G.diff_summary(diffs).first()) == (4, 1, 0.375, 2, 2)
