"""File sources on temporary files: records, manifests, scans, coverage lists, canonical paths, codes."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.sources import tables as S


def test_records_one_or_many_to_a_file_flat_or_nested(spark, tmp_path):
    flat = {"test_id": "T1", "program": "P", "date": "2026-01-02", "confidential_tier": True, "channel": "C", "injury_criterion": "ThCC", "value": 38.4, "unit": "mm", "linked_regulation_clause": "UN_R94#5.2.1"}
    many = {"test_id": "T2", "results": [{"injury_criterion": "HIC36", "value": 612}, {"injury_criterion": "ThCC", "value": 1, "peak_value": 2.5}], "extra": "kept out"}
    (tmp_path / "one.json").write_text(json.dumps(flat))
    (tmp_path / "two.json").write_text(json.dumps([many, {"test_id": "T3", "results": []}], indent=2))
    rows = {r.test_id: r for r in S.test_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"T1", "T2", "T3"} and rows["T3"].results == []
    assert [(x.injury_criterion, x.value, x.channel) for x in rows["T1"].results] == [("ThCC", 38.4, "C")] and rows["T1"].confidential_tier
    assert [(x.injury_criterion, x.value, x.peak_value) for x in rows["T2"].results] == [("HIC36", 612.0, None), ("ThCC", 1.0, 2.5)]


def test_manifests_of_every_form(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"files": [{"filename": "dir/Messy.PDF", "regulation_code": "R16", "amendment": "Base"}, {"file": "b\\C.pdf", "reg_code": "R94"}, {"regulation": "no name"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"mappings": [{"filename": "m.pdf", "regulation": "R14", "series": "07"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"filename": "bare.pdf", "regulation_code": "R17"}]))
    got = sorted(map(tuple, S.staged_files(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("messy.pdf", "R16", "Base"), ("c.pdf", "R94", None), ("m.pdf", "R14", "07"), ("bare.pdf", "R17", None)], key=repr)


def test_scans_find_files_at_any_depth_with_hash_and_authority(spark, tmp_path):
    for name, data in {"unece/x/r94.pdf": b"%PDF-1", "NHTSA/r.pdf": b"r", "NHTSA/empty.pdf": b"", "other/deep/er/z.pdf": b"zz", "euroncap/a.pdf": b"a", "notes.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in S.scanned_files(spark, str(tmp_path)).collect()}
    assert {k: r.authority for k, r in got.items()} == {"r94.pdf": "UNECE", "r.pdf": "NHTSA", "z.pdf": "OTHER", "a.pdf": "NCAP"}
    assert got["r94.pdf"].length == 6 and got["r94.pdf"].file_hash == hashlib.sha256(b"%PDF-1").hexdigest()


def test_expected_coverage(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("authorities:\n  UNECE:\n    regulations:\n      - {id: R94, title: Frontal, area: crash, priority: high}\n      - {id: R16}\n  IIHS:\n    regulations: []\n")
    assert sorted(map(tuple, S.expected_coverage(spark, str(tmp_path / "c.yaml")).collect()), key=repr) == sorted([("UNECE", "R94", "Frontal", "crash", "high"), ("UNECE", "R16", None, None, None)], key=repr)


def test_paths_keep_versions_apart_and_codes_have_one_form(spark):
    row = spark.range(1).select(*[S.canonical_path(F.lit("UNECE"), F.lit("UN R94"), F.lit("05 Series/b"), F.lit(h)) for h in ("abcdef0123", "abcdef0999")]).first()
    assert list(row) == ["UNECE_UN_R94_05_Series_b-abcdef01.pdf", "UNECE_UN_R94_05_Series_b-abcdef09.pdf"]
    codes = ["r94", "UN R 94", "UN_R094", "un-r94", "ECE R94", "FMVSS 208", " euro ncap aop ", None]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(T.regulation_code(F.col("c")), T.regulation_code(F.col("c"), keep_zeros=False)).collect()
    assert [r[0] for r in got] == ["UN_R94", "UN_R94", "UN_R094", "UN_R94", "UN_R94", "FMVSS_208", "EURO_NCAP_AOP", None] and got[2][1] == "UN_R94"


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    S.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    S.replace_partitions(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_parts_of_paths_cannot_lead_out(spark):
    parts = ["user_1", "a-b", "..", "a/b", "", None, "x" * 128, "x" * 129, "tail\n", "ü"]
    got = spark.createDataFrame([(p,) for p in parts], "p string").select(S.safe_segment(F.col("p")).alias("ok"), S.stored_path("/store/", F.lit("u"), F.col("p")).alias("path")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False, True, False, False, False]
    assert got[1].path == "/store/u/a-b" and got[2].path is None and got[5].path is None
