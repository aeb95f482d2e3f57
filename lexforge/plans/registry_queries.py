"""Registry, gate, batch, audit and comparison queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import documents as D
from lexforge.operators import registry as G
from lexforge.plans import document_queries as documents
from lexforge.plans.retrieval_queries import chosen_clause
from lexforge.sources.tables import table


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.expr("o_custkey % 300").alias("code"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("amendment"), F.col("o_orderstatus").alias("file_hash"))


def version_scd2(spark: SparkSession, d: str) -> DataFrame:
    """Even orders are the registry, of each code and amendment the last one active; the last odd one of each comes in."""
    rows = _versions(spark, d)
    even = rows.where("version_id % 2 = 0")
    last = even.groupBy("code", "amendment").agg(F.max("version_id").alias("version_id")).select("version_id", F.lit("ACTIVE").alias("now"))
    registry = even.join(last, "version_id", "left").select("version_id", "code", "amendment", "file_hash", F.coalesce("now", F.lit("SUPERSEDED")).alias("status"))
    incoming = rows.where("version_id % 2 = 1").groupBy("code", "amendment").agg(F.max("version_id").alias("version_id"), F.max_by("file_hash", "version_id").alias("file_hash"))
    return G.apply_versions(registry, incoming, ["code", "amendment"])


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("source_url"), F.md5(F.col("html").cast("binary")).alias("text_hash"))
    old = p.where("page_id % 3 != 0").groupBy("source_url").agg(F.min(F.expr("CASE WHEN page_id % 5 = 0 THEN 'old' ELSE text_hash END")).alias("text_hash"), F.min("page_id").alias("first_seen"))
    new = p.where("page_id % 4 != 0").groupBy("source_url").agg(F.max_by("text_hash", "page_id").alias("text_hash"), F.max("page_id").alias("seen"))
    return G.upsert_manifest(old, new)


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left by table and source once every seventh document is removed with its vectors and labels."""
    docs = table(spark, d, "documents").select("doc_id")
    gone = docs.where("doc_id % 7 = 0")
    parts = [("documents", docs, "doc_id"), ("embeddings", table(spark, d, "embeddings").select("vec_id"), "vec_id"), ("labels", table(spark, d, "labels").select("doc_id"), "doc_id")]
    counts = [G.without(rows, gone, key).agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left") for name, rows, key in parts]
    return counts[0].union(counts[1]).union(counts[2])


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.allowlist(spark, d).select("page_id", "allowed")
    rows = rows.join(documents.validation_gate(spark, d).select("page_id", F.col("outcome").alias("checked")), "page_id")
    return G.gate(rows.join(documents.change_classify(spark, d), "page_id"))


def gate_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("page_id", "stage", "outcome", "reason")


def gate_log(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_log(_gated(spark, d))


_CHECKED = "CASE WHEN o_custkey % 11 = 0 THEN 'NEEDS_OCR: thin text' WHEN o_custkey % 13 = 0 THEN 'REJECTED: too small' ELSE 'ACCEPTED' END"


def offline_batch(spark: SparkSession, d: str) -> DataFrame:
    """Order files by name against 45 expected regulations and two families; hashes of some are stored, texts of others."""
    o = table(spark, d, "orders")
    files = o.select(F.col("o_orderkey").alias("file_id"), D.parse_filename(F.expr(documents._NAME))["code"].alias("code"), F.expr("o_custkey * 10 + o_orderkey % 7").alias("file_hash"), F.expr("CASE WHEN o_orderkey % 9 > 0 THEN o_custkey * 10 + o_orderkey % 4 END").alias("text_hash"), F.expr(_CHECKED).alias("checked"))
    expected = spark.range(10, 55).select(F.concat(F.lit("UN_R"), F.col("id")).alias("code")).union(spark.createDataFrame([("Euro NCAP AOP",), ("IIHS Small Overlap",)], "code string"))
    stored = files.where("file_id % 29 = 0").select("file_hash", F.when(F.col("file_id") % 2 == 0, F.col("text_hash")).alias("text_hash"))
    return G.offline_batch(files, expected, stored)


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return offline_batch(spark, d).groupBy("status").agg(F.count("*").alias("files"), F.countDistinct("code").alias("codes"))


def amendment_audit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Base' ELSE (o_custkey % 8 + 1) || ' series of amendments' END").alias("amendment"), F.expr(documents._NAME).alias("file_name"))
    return G.amendment_audit(o).select("o_orderkey", "amendment", "from_filename", "mismatch")


QUESTIONS = [(1, "Show frontal tests with ThCC"), (2, "side impact HIC results"), (3, "what happened in test-1996-03-007?"), (4, "pole HIC of TEST-1997-05-011")]


def tests_with_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tests, their lines as results; parts as clauses."""
    o, li, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    mode = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'FRONTAL_OFFSET' WHEN 1 THEN 'SIDE_MDB' WHEN 2 THEN 'POLE_SIDE' ELSE 'REAR' END")
    test_id = F.expr("concat('TEST-', date_format(o_orderdate, 'yyyy-MM'), '-', lpad(cast(o_orderkey % 20 AS string), 3, '0'))")
    tests = o.select(F.col("o_orderkey").alias("k"), test_id.alias("test_id"), mode.alias("impact_mode"), (F.col("o_custkey") % 3 == 0).alias("confidential"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN cast(o_custkey % 10 AS string) END").alias("owner"))
    results = li.join(tests.select(F.col("k").alias("l_orderkey"), F.col("test_id")), "l_orderkey").select("test_id", F.expr("l_orderkey * 10 + l_linenumber").alias("position"), F.expr(chosen_clause(1, "1")).alias("criterion"), F.col("l_quantity").alias("value"), F.expr("CASE WHEN l_partkey % 9 = 0 THEN 'UN_R1#9' ELSE 'UN_R' || (l_partkey % 40) || '#5.' || (l_linenumber % 3) END").alias("link"))
    clauses = p.select(F.col("p_partkey").alias("clause_id"), F.expr("'UN_R' || (p_partkey % 40)").alias("code"), F.expr("'5.' || (p_size % 3)").alias("section"), F.col("p_name").alias("text"))
    once = tests.groupBy("test_id").agg(F.min_by(F.struct("impact_mode", "confidential", "owner"), "k").alias("t")).select("test_id", "t.*")
    return G.tests_with_clauses(spark.createDataFrame(QUESTIONS, "query_id int, query string"), once, results, clauses, "4")


REFUSAL_CASES = [(0, False, "limit of R94", "42 mm"), (1, True, "limit of R999", "R999 is nonexistent"), (2, True, "limit of R94 on mars", "not in corpus"), (3, True, "what of UN R999", "")]
_ANSWER = "CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN 'The limit is 42 mm' WHEN 3 THEN 'See UN_R94 as well' ELSE 'R999 is not in the ingested corpus' END"


def refusal_check(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as answers to four cases."""
    cases = spark.createDataFrame(REFUSAL_CASES, "case_id int, expected boolean, question string, truth string")
    answers = table(spark, d, "conversations").select((F.col("conv_id") % 4).cast("int").alias("case_id"), F.expr(_ANSWER).alias("answer"), (F.col("conv_id") % 3 == 0).alias("only"))
    rows = answers.join(F.broadcast(cases), "case_id").select("case_id", G.refusal_is_correct(*[F.col(c) for c in ("expected", "question", "truth", "answer", "only")]).alias("correct"))
    return rows.groupBy("case_id", "correct").agg(F.count("*").alias("answers"))


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ninety cases of one language and source each; a run passes where a document of its half has the word."""
    docs = table(spark, d, "documents").select("doc_id", F.expr("doc_id % 90").alias("case_id"), F.lower("text").alias("t"))

    def run(half: int, word: str) -> DataFrame:
        return docs.groupBy("case_id").agg(F.bool_or((F.col("doc_id") % 2 == half) & F.contains("t", F.lit(word))).alias("passed"))

    return run(0, " the "), run(1, "de")


def eval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return G.compare_runs(*_runs(spark, d))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.run_comparison(*_runs(spark, d))


_BEFORE = "'[Source: s | Reg: UN_R' || (doc_id % 9) || ' | Amendment: a | Doc: d' || (doc_id % 300) || ' | Page: ' || (doc_id % 4) || ' | Section: 5 | Type: clause]' || text"
_AFTER = "CASE WHEN doc_id % 13 = 0 THEN text WHEN doc_id % 3 = 0 THEN '[Source: s | Reg: UN_R' || (doc_id % 9) || ' | Amendment: b | Doc: d' || (doc_id % 300) || ' | Page: 9 | Section: 5 | Type: clause]' || text ELSE " + _BEFORE + " END"


def _run_diff(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contexts of cases: a third on another page, some without a header, some only in one run."""
    docs = table(spark, d, "documents")
    case = F.col("doc_id") % 120
    return G.diff_runs(docs.where("doc_id % 120 != 7").select(case.alias("case_id"), F.expr(_BEFORE).alias("context")), docs.where("doc_id % 5 != 2").select(case.alias("case_id"), F.expr(_AFTER).alias("context")))


def run_diff(spark: SparkSession, d: str) -> DataFrame:
    return _run_diff(spark, d)


def run_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.diff_summary(_run_diff(spark, d))


QUERIES = {f.__name__: f for f in (run_diff, run_diff_summary, version_scd2, manifest_upsert, delete_cascade, gate_pipeline, gate_log, offline_batch, batch_summary, amendment_audit, tests_with_clauses, refusal_check, eval_outcomes, eval_summary)}

_GATED = f"""SELECT page_id, CASE WHEN NOT allowed THEN 'allowlist' WHEN v.outcome <> 'ACCEPTED' THEN 'validate' ELSE 'tracker' END AS stage,
  CASE WHEN NOT allowed THEN 'rejected' WHEN starts_with(v.outcome, 'NEEDS') THEN 'needs_ocr' WHEN v.outcome <> 'ACCEPTED' THEN 'rejected' ELSE lower(change) END AS outcome,
  CASE WHEN NOT allowed THEN 'domain not allowed' WHEN v.outcome <> 'ACCEPTED' THEN split_part(v.outcome, ': ', 2) END AS reason
FROM ({documents.SQL["allowlist"]}) JOIN ({documents.SQL["validation_gate"]}) v USING (page_id) JOIN ({documents.SQL["change_classify"]}) USING (page_id)"""
_BATCH = f"""WITH f AS (SELECT o.o_orderkey AS file_id, n.code, o_custkey * 10 + o.o_orderkey % 7 AS fh, CASE WHEN o.o_orderkey % 9 > 0 THEN o_custkey * 10 + o.o_orderkey % 4 END AS th, {_CHECKED} AS checked FROM orders o JOIN ({documents.SQL["filename_parse"]}) n ON n.o_orderkey = o.o_orderkey),
m AS (SELECT *, code IN (SELECT 'UN_R' || i FROM range(10, 55) r(i)) OR code IN ('Euro NCAP AOP', 'IIHS Small Overlap') AS mapped, fh IN (SELECT fh FROM f WHERE file_id % 29 = 0) AS there, coalesce(th IN (SELECT th FROM f WHERE file_id % 58 = 0 AND th IS NOT NULL), false) AS text_there FROM f),
r AS (SELECT *, min(CASE WHEN mapped THEN file_id END) OVER (PARTITION BY fh) < file_id AS again, th IS NOT NULL AND min(CASE WHEN mapped AND checked = 'ACCEPTED' AND NOT there THEN file_id END) OVER (PARTITION BY th) < file_id AS text_again FROM m),
s AS (SELECT file_id, code, CASE WHEN NOT mapped THEN 'UNMAPPED' WHEN there OR again THEN 'DUPLICATE' WHEN checked <> 'ACCEPTED' THEN 'REJECTED' WHEN text_there OR text_again THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status FROM r)
"""
_RUNS = """WITH c AS (SELECT doc_id % 90 AS case_id, bool_or(doc_id % 2 = 0 AND contains(lower(text), ' the ')) AS a, bool_or(doc_id % 2 = 1 AND contains(lower(text), 'de')) AS b FROM documents GROUP BY 1),
o AS (SELECT *, CASE WHEN b AND NOT a THEN 'structure_wins' WHEN a AND NOT b THEN 'flat_wins' WHEN a AND b THEN 'tie' ELSE 'both_fail' END AS outcome FROM c)
"""
_SAYS = "(" + " OR ".join("contains(t, '" + p.replace("'", "''") + "')" for p in G.REFUSALS) + ")"

_MARK = r"CASE WHEN starts_with(x, '[Source') THEN concat_ws('|', regexp_extract(x, 'Reg: (\S+)', 1), regexp_extract(x, 'Doc: (\S+)', 1), '5', 'clause', 'p' || regexp_extract(x, 'Page: (\d+)', 1), substr(md5(substr(regexp_replace(regexp_replace(x, '^[^\]]*\]', ''), '^\s+|\s+$', '', 'g'), 1, 400)), 1, 10)) ELSE substr(md5(substr(x, 1, 200)), 1, 12) END"
_DIFF = f"""WITH c AS (SELECT doc_id % 120 AS case_id, {_BEFORE} AS x, 0 AS side FROM documents WHERE doc_id % 120 <> 7 UNION ALL SELECT doc_id % 120, {_AFTER}, 1 FROM documents WHERE doc_id % 5 <> 2),
m AS (SELECT case_id, {_MARK} AS mark, bool_or(side = 0) AS old, bool_or(side = 1) AS new FROM c GROUP BY ALL),
d AS (SELECT case_id, count(*) FILTER (old) AS before, count(*) FILTER (new) AS after, count(*) FILTER (old AND new) AS same, round(count(*) FILTER (old AND new) / count(*), 6) AS jaccard FROM m GROUP BY case_id)
"""

SQL = {
    "run_diff": _DIFF + "SELECT * FROM d",
    "run_diff_summary": _DIFF + "SELECT count(*) AS cases, count(*) FILTER (jaccard = 1) AS identical, round(avg(jaccard), 4) AS mean_jaccard, sum(after - same)::BIGINT AS added, sum(before - same)::BIGINT AS removed FROM d",
    "version_scd2": """
WITH v AS (SELECT o_orderkey AS id, o_custkey % 300 AS code, nullif(o_orderpriority, '5-LOW') AS am, o_orderstatus AS h FROM orders),
r AS (SELECT *, id = max(id) OVER (PARTITION BY code, am) AS active FROM v WHERE id % 2 = 0), i AS (SELECT code, am, max(id) AS id, arg_max(h, id) AS h FROM v WHERE id % 2 = 1 GROUP BY code, am),
n AS (SELECT i.*, r.id AS old FROM i LEFT JOIN r ON r.active AND r.code = i.code AND r.am IS NOT DISTINCT FROM i.am WHERE r.id IS NULL OR r.h <> i.h)
SELECT r.id AS version_id, r.code, r.am AS amendment, r.h AS file_hash, CASE WHEN r.active AND n.id IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, n.id AS closed_by FROM r LEFT JOIN n ON n.old = r.id
UNION ALL SELECT id, code, am, h, 'ACTIVE', NULL FROM n""",
    "manifest_upsert": """
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, md5(html) AS h FROM pages),
o AS (SELECT u, min(CASE WHEN page_id % 5 = 0 THEN 'old' ELSE h END) AS h, min(page_id) AS seen FROM p WHERE page_id % 3 <> 0 GROUP BY u), i AS (SELECT u, arg_max(h, page_id) AS h, max(page_id) AS seen FROM p WHERE page_id % 4 <> 0 GROUP BY u)
SELECT coalesce(o.u, i.u) AS source_url, coalesce(i.h, o.h) AS text_hash, coalesce(o.seen, i.seen) AS first_seen, CASE WHEN i.u IS NULL THEN 'KEPT' WHEN o.u IS NULL THEN 'NEW' WHEN o.h = i.h THEN 'DUPLICATE' ELSE 'CHANGED' END AS change FROM o FULL JOIN i ON i.u = o.u""",
    "delete_cascade": """
WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)
SELECT 'documents' AS table_name, count(*) AS rows_left FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM g)""",
    "gate_pipeline": _GATED,
    "gate_log": f"""
WITH g AS ({_GATED}), l AS (SELECT 'allowlist' AS stage, CASE WHEN stage = 'allowlist' THEN outcome ELSE 'passed' END AS outcome FROM g UNION ALL SELECT 'validate', CASE WHEN stage = 'validate' THEN outcome ELSE 'passed' END FROM g WHERE stage <> 'allowlist' UNION ALL SELECT 'tracker', outcome FROM g WHERE stage = 'tracker')
SELECT stage, outcome, count(*) AS items FROM l GROUP BY ALL""",
    "offline_batch": _BATCH + "SELECT * FROM s",
    "batch_summary": _BATCH + "SELECT status, count(*) AS files, count(DISTINCT code) AS codes FROM s GROUP BY status",
    "amendment_audit": f"""
WITH a AS (SELECT o.o_orderkey, CASE o.o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Base' ELSE (o_custkey % 8 + 1) || ' series of amendments' END AS amendment, lpad(CAST(n.series AS VARCHAR), 2, '0') AS s FROM orders o JOIN ({documents.SQL["filename_parse"]}) n ON n.o_orderkey = o.o_orderkey)
SELECT o_orderkey, amendment, s || ' Series' AS from_filename, coalesce(CASE WHEN amendment = 'Base' THEN 'Base' ELSE lpad(regexp_extract(amendment, '([0-9]+)', 1), 2, '0') END <> s, false) AS mismatch FROM a""",
    "tests_with_clauses": f"""
WITH o AS (SELECT o_orderkey AS k, 'TEST-' || strftime(o_orderdate, '%Y-%m') || '-' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 3, '0') AS test_id, CASE o_orderkey % 4 WHEN 0 THEN 'FRONTAL_OFFSET' WHEN 1 THEN 'SIDE_MDB' WHEN 2 THEN 'POLE_SIDE' ELSE 'REAR' END AS mode, o_custkey FROM orders),
t AS (SELECT test_id, arg_min(mode, k) AS mode, arg_min(o_custkey, k) AS c FROM o GROUP BY test_id),
s AS (SELECT * FROM t WHERE c % 3 <> 0 OR (c % 2 = 0 AND c % 10 = 4)),
r AS (SELECT o.test_id, l_orderkey * 10 + l_linenumber AS position, {chosen_clause(1, "1")} AS criterion, l_quantity AS value, CASE WHEN l_partkey % 9 = 0 THEN 'UN_R1#9' ELSE 'UN_R' || (l_partkey % 40) || '#5.' || (l_linenumber % 3) END AS link FROM lineitem JOIN o ON o.k = l_orderkey),
c AS (SELECT 'UN_R' || (p_partkey % 40) || '#5.' || (p_size % 3) AS link, min(p_partkey) AS id FROM part GROUP BY 1),
x AS (SELECT s.mode, r.* FROM s JOIN r ON r.test_id = s.test_id),
q AS (SELECT 1 AS query_id, * FROM x WHERE mode = 'FRONTAL_OFFSET' AND criterion = 'ThCC' UNION ALL SELECT 2, * FROM x WHERE mode IN ('SIDE_MDB', 'POLE_SIDE') AND criterion = 'HIC36' UNION ALL SELECT 3, * FROM x WHERE test_id = 'TEST-1996-03-007' UNION ALL SELECT 4, * FROM x WHERE criterion = 'HIC36' AND test_id = 'TEST-1997-05-011')
SELECT q.query_id, q.test_id, q.position, q.criterion, q.value, q.link, CASE WHEN c.id IS NOT NULL THEN split_part(q.link, '#', 2) END AS section, p_name AS text FROM q LEFT JOIN c ON c.link = q.link LEFT JOIN part ON p_partkey = c.id""",
    "refusal_check": rf"""
WITH c(case_id, expected, question, truth) AS (VALUES (0, false, 'limit of R94', '42 mm'), (1, true, 'limit of R999', 'R999 is nonexistent'), (2, true, 'limit of R94 on mars', 'not in corpus'), (3, true, 'what of UN R999', '')),
a AS (SELECT CAST(conv_id % 4 AS INT) AS case_id, {_ANSWER} AS answer, conv_id % 3 = 0 AS only_evidence FROM conversations), j AS (SELECT *, coalesce(answer, '') AS r, lower(trim(coalesce(answer, ''))) AS t FROM a JOIN c USING (case_id)),
v AS (SELECT case_id, CASE WHEN NOT expected THEN NULL WHEN t = '' AND only_evidence THEN true WHEN {_SAYS} THEN true WHEN regexp_matches(truth, '{G.ABSENT}') AND regexp_matches(r, '{G.ABSENT}') THEN true
  WHEN contains(question, '999') AND (regexp_matches(r, '(?i)\b\d+\s*mm\b') OR (regexp_matches(r, '(?i)\bUN[\s_-]?R?\d+') AND NOT contains(r, '999'))) THEN false ELSE length(t) < 20 OR contains(t, 'sorry') END AS correct FROM j)
SELECT case_id, correct, count(*) AS answers FROM v GROUP BY ALL""",
    "eval_outcomes": _RUNS + "SELECT case_id, outcome FROM o",
    "eval_summary": _RUNS + """SELECT count(*) AS total, count(*) FILTER (WHERE a) AS flat_passed, count(*) FILTER (WHERE b) AS structured_passed, round(count(*) FILTER (WHERE a) / count(*), 3) AS flat_recall, round(count(*) FILTER (WHERE b) / count(*), 3) AS structured_recall,
  count(*) FILTER (WHERE outcome = 'structure_wins') AS structure_wins, count(*) FILTER (WHERE outcome = 'flat_wins') AS flat_wins, count(*) FILTER (WHERE outcome = 'tie') AS ties, count(*) FILTER (WHERE outcome = 'flat_wins') = 0 AND count(*) FILTER (WHERE b) = count(*) AS approval_ready FROM o""",
}
