"""Test-record, audit and evaluation queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import records as H
from lexforge.plans.retrieval_queries import _ASKED_SQL, _any, asked, chosen_clause
from lexforge.sources.tables import table

def _clauses(spark: SparkSession, d: str) -> DataFrame:
    q = "cast(cast(l_quantity AS int) AS string)"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(chosen_clause(0, q)).alias("text"), F.expr(chosen_clause(1, q)).alias("criterion"), F.expr("l_partkey % 60").cast("double").alias("value"))


def limit_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = H.with_limits(_clauses(spark, d), "text", {"lim": F.col("criterion")})
    v, x, how = F.col("value"), F.col("lim.value"), F.col("lim.direction")
    percent = H.headroom_percent(v, x)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", x.alias("limit_value"), how.alias("direction"), F.col("lim.unit").alias("unit"), H.verdict(v, x, how).alias("verdict"), H.headroom(v, x, how).alias("headroom"), F.round(percent, 1).alias("percent"), H.tightness(percent).alias("band"))


def asof_limit(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it."""
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), F.col("value").alias("limit_value"))
    bought = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return H.as_of(bought, views, "user_id", "ts", "seen", "event_id", "view_id").select("event_id", "view_id", F.round("limit_value", 6).alias("limit_value"))


def latest_limit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("effective"), "o_orderkey")
    return H.latest(o, "o_custkey", "effective", "o_orderkey").select("o_custkey", "o_orderkey", F.col("effective").cast("string").alias("effective"))


#: Clauses of a version by section, their criterion and unit.
LINKED = [("5.1", "The Thorax Compression Criterion (ThCC) shall not exceed {q} mm;", "ThCC", "mm"), ("5.2", "The Head Injury Criterion (HIC36) must be less than {q} g;", "HIC36", "g"), ("5.3", "The seatbelt anchorage force must stay above {q} kN for safety;", "Force", "kN")]


def _linked_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order lines as results, parts as versions of 60 regulations with three clauses each; some of all are at fault."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    effective = F.expr("CASE WHEN p_partkey % 420 != 7 THEN date_add(DATE '1994-06-01', cast(p_partkey * 37 % 1500 AS int)) END")
    versions = part.select(F.col("p_partkey").alias("version_id"), F.expr("'UN_R' || (p_partkey % 60)").alias("code"), effective.alias("effective"))
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(sec).alias("section"), F.replace(F.lit(text), F.lit("{q}"), F.col("p_size").cast("string")).alias("text")) for i, (sec, text, _, _) in enumerate(LINKED)]))
    clauses = part.select(F.col("p_partkey").alias("version_id"), made.alias("c")).select((F.col("version_id") * 10 + F.col("c.i")).alias("clause_id"), "version_id", "c.section", "c.text")
    kind = "CASE l_linenumber % 4 WHEN 1 THEN '{}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' ELSE '{}' END"
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    results = lines.select(
        F.expr("l_orderkey").alias("record_id"),
        F.col("l_linenumber").alias("position"),
        F.expr("CASE WHEN l_orderkey % 53 = 0 THEN '5 May 1996' ELSE cast(to_date(o_orderdate) AS string) END").alias("test_date"),
        F.expr("CASE WHEN cast(l_quantity AS int) % 23 = 0 THEN NULL WHEN cast(l_quantity AS int) % 17 = 0 THEN 'NIC' ELSE " + kind.format(*[x[2] for x in LINKED], "ThCC") + " END").alias("criterion"),
        F.expr("cast(l_suppkey % 50 AS double)").alias("value"),
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 'lbf' ELSE " + kind.format(*[x[3] for x in LINKED], "mm") + " END").alias("unit"),
        F.expr("CASE WHEN l_partkey % 47 = 0 THEN 'UN_R1' ELSE 'UN_R' || (l_partkey % 61) || '#' || CASE WHEN l_suppkey % 31 = 0 THEN '9.9' ELSE " + kind.format(*[x[0] for x in LINKED], "5.1") + " END END").alias("link"),
    )
    return results, versions, clauses


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return H.link_results(*_linked_tables(spark, d))


def linked_results(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)


def harness_ingest(spark: SparkSession, d: str) -> DataFrame:
    """One failing result refuses its whole record."""
    return H.settle_records(_linked(spark, d))


def close_to_limit(spark: SparkSession, d: str) -> DataFrame:
    """Per criterion, the five visible results with the least headroom to 100 mm."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    seen = e.where(H.visible("7", F.col("event_id") % 2 == 1, F.col("user_id").cast("string"))).where("value is not null")
    rows = seen.select("event_type", "event_id", H.headroom(F.col("value"), F.lit(100.0), F.lit("ceiling")).alias("headroom"))
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("headroom", "event_id"))
    return rows.withColumn("place", n).where("place <= 5").select("event_type", "place", "event_id", F.round("headroom", 4).alias("headroom"))


def close_to_clause_limits(spark: SparkSession, d: str) -> DataFrame:
    """The hundred visible results nearest to the limits of their clauses, or to 42 mm; half of all records are confidential."""
    results, versions, clauses = _linked_tables(spark, d)
    tests = table(spark, d, "orders").where("o_orderkey % 7 != 3").select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 2 == 0).alias("confidential"), (F.col("o_custkey") % 9).cast("string").alias("owner"))
    return H.close_to_limits(results.drop("test_date", "unit"), tests, versions, clauses, "4", 42.0, 100)


def access_audit(spark: SparkSession, d: str) -> DataFrame:
    """One audit row per event: the owner check first, the model gate last."""
    e = table(spark, d, "events")
    model = F.expr("CASE event_id % 4 WHEN 0 THEN 'gemini-free' WHEN 1 THEN 'ollama/7b' WHEN 2 THEN 'Groq-70b' ELSE 'other' END")
    confidential, owner = F.col("event_id") % 2 == 0, F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string"))
    outcome = F.when(~H.visible("7", confidential, owner), "denied: owner").when(confidential & ~H.model_allowed(model), "denied: model").otherwise("allowed")
    return e.select(outcome.alias("outcome"), F.to_date("ts").cast("string").alias("day")).groupBy("outcome", "day").agg(F.count("*").alias("n"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.upper("lang") == "EN").alias("english"), F.max("n_chars").alias("longest"))


def version_history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    item = F.struct((-F.unix_date(F.to_date("o_orderdate"))).alias("d"), "o_orderstatus", "o_orderkey")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",")
    return o.groupBy("o_custkey").agg(text.alias("versions"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Outcome counts per day, the kinds of event playing the outcomes; every outcome is counted."""
    e = table(spark, d, "events").withColumn("run", F.to_date("ts").cast("string"))
    names = {"signup": "new", "click": "changed", "view": "duplicate", "error": "rejected", "purchase": "needs_ocr"}
    return e.groupBy("run").agg(F.count("*").alias("items"), *[F.count_if(F.col("event_type") == k).alias(v) for k, v in names.items()], F.count_if(F.col("event_type").isin("signup", "click")).alias("accepted"))


def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per order: total of the steps, overhead against the order's price, slowest step (ties: the first)."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    steps = li.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("steps"), F.max_by("l_linenumber", F.struct(F.col("l_quantity"), (-F.col("l_linenumber")).alias("n"))).alias("slowest"))
    rows = o.join(steps, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "steps", F.greatest(F.lit(0), F.floor(F.col("o_totalprice") / 1000).cast("long") - F.col("steps")).alias("overhead"), "slowest")


def token_spend(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.length("props").cast("long")).alias("tokens"), F.countDistinct("user_id").alias("users"))


def retrieval_diff(spark: SparkSession, d: str) -> DataFrame:
    """Word sets of neighbouring documents: what was added, removed, and their Jaccard similarity."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    pair = docs.alias("a").join(docs.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return pair.select(F.col("a.doc_id").alias("doc_id"), F.size(F.array_except("b.w", "a.w")).alias("added"), F.size(F.array_except("a.w", "b.w")).alias("removed"), F.round(H.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


#: case_id, must_contain, together, must_not, codes, needs_table, min_pipes.
CASES = [
    (1, ["the", "and"], ["the", "of"], ["idiot"], ["UN_R0", "UN_R4"], False, None), (2, ["der"], ["der", "die"], ["moron"], ["UN_R7"], True, 20), (3, ["zebra"], ["zebra"], ["xylophone"], None, False, None),
    (4, ["les"], None, ["for", " une"], [], True, 30), (5, ["x"], [], [], ["UN_R1"], False, None), (6, None, None, ["sch", "+"], None, False, None),
]
_HIT = "text || CASE WHEN doc_id % 50 = 3 THEN ' | --- |' || repeat(' | cell', 25) WHEN doc_id % 50 = 4 THEN repeat('|', 21) ELSE '' END"


def case_eval(spark: SparkSession, d: str) -> DataFrame:
    """Six cases with all documents as hits, dealt to them by id; the fifth has none."""
    cases = spark.createDataFrame(CASES, "case_id int, must_contain array<string>, together array<string>, must_not array<string>, codes array<string>, needs_table boolean, min_pipes int")
    i = F.col("doc_id") % 5
    hits = table(spark, d, "documents").select(F.when(i == 4, 6).otherwise(i + 1).cast("int").alias("case_id"), F.concat(F.lit("UN_R"), (F.col("doc_id") % 9).cast("string")).alias("code"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("clause").alias("chunk_type"), F.expr(_HIT).alias("text"))
    return H.check_cases(cases, hits)


def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("bad", F.col("event_type").isin("error", "click"))
    return H.streaks(e, "user_id", "event_id", "bad", 3)


QUERIES = {f.__name__: f for f in (limit_extract, asof_limit, latest_limit, linked_results, harness_ingest, close_to_limit, close_to_clause_limits, access_audit, inventory, version_history, run_summary, timing_summary, token_spend, retrieval_diff, case_eval, error_streaks)}

_LIMITS = rf"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 60 AS v, lower({chosen_clause(0, "CAST(l_quantity AS INT)")}) AS t, lower({chosen_clause(1, "1")}) AS n FROM lineitem),
h AS (SELECT *, regexp_extract(t, '{H.LIMIT}', 0) AS hit, CAST(nullif(regexp_extract(t, '{H.LIMIT}', 1), '') AS DOUBLE) AS number, regexp_extract(t, '{H.LIMIT}', 2) AS u,
  CASE WHEN n = 'thcc' THEN {_any(H.THORAX_WORDS, 't')} WHEN n IN ('hic', 'hic36') THEN {_any(H.HEAD_WORDS, 't')} ELSE contains(t, n) END AS fits FROM c),
w AS (SELECT *, right(substr(t, 1, instr(t, hit) - 1), 60) || ' ' || substr(t, instr(t, hit) + length(hit), 60) AS near FROM h),
d AS (SELECT *, {_any(H.FLOOR_WORDS, 'near')} AS f, {_any(H.CEILING_WORDS, 'near')} AS c FROM w),
r AS (SELECT *, CASE WHEN f AND NOT c THEN 'floor' WHEN c AND NOT f THEN 'ceiling' WHEN n IN ('hic', 'hic36', 'thcc') THEN 'ceiling' END AS way FROM d),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, v,
  CASE WHEN NOT fits THEN NULL WHEN hit <> '' THEN CASE WHEN way IS NOT NULL THEN number END WHEN n = 'thcc' AND contains(t, '94') THEN 42 WHEN n IN ('hic', 'hic36') THEN 1000 END AS x,
  CASE WHEN NOT fits THEN NULL WHEN hit <> '' THEN way WHEN (n = 'thcc' AND contains(t, '94')) OR n IN ('hic', 'hic36') THEN 'ceiling' END AS how,
  CASE WHEN NOT fits THEN NULL WHEN hit <> '' THEN CASE WHEN way IS NOT NULL THEN u END WHEN n = 'thcc' AND contains(t, '94') THEN 'mm' WHEN n IN ('hic', 'hic36') THEN 'none' END AS unit FROM r),
p AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE abs(x - v) / x * 100 END AS pc FROM l)
"""

_KIND = "CASE l_linenumber % 4 WHEN 1 THEN '{}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' ELSE '{}' END"
#: Results with what they are linked to and the first reason to refuse them: the version by an as-of join, the limit read from the clause's text.
_LINKED_SQL = f"""WITH v AS (SELECT p_partkey AS version_id, 'UN_R' || (p_partkey % 60) AS code, CASE WHEN p_partkey % 420 <> 7 THEN DATE '1994-06-01' + CAST(p_partkey * 37 % 1500 AS INT) END AS effective, p_size FROM part),
k AS (SELECT code, min(effective) AS earliest, bool_or(effective IS NULL) AS undated FROM v GROUP BY code),
c AS (SELECT version_id, sec, replace(tx, '{{q}}', CAST(p_size AS VARCHAR)) AS text FROM v, (VALUES {", ".join(f"('{x[0]}', '{x[1]}')" for x in LINKED)}) AS t(sec, tx)),
r AS (SELECT l_orderkey AS record_id, l_linenumber AS position, CASE WHEN l_orderkey % 53 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN CAST(l_quantity AS INT) % 23 = 0 THEN NULL WHEN CAST(l_quantity AS INT) % 17 = 0 THEN 'NIC' ELSE {_KIND.format(*[x[2] for x in LINKED], "ThCC")} END AS criterion, CAST(l_suppkey % 50 AS DOUBLE) AS value,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 'lbf' ELSE {_KIND.format(*[x[3] for x in LINKED], "mm")} END AS unit,
  CASE WHEN l_partkey % 47 = 0 THEN 'UN_R1' ELSE 'UN_R' || (l_partkey % 61) || '#' || CASE WHEN l_suppkey % 31 = 0 THEN '9.9' ELSE {_KIND.format(*[x[0] for x in LINKED], "5.1")} END END AS link FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
q AS (SELECT *, CASE WHEN contains(link, '#') THEN split_part(link, '#', 1) END AS code, split_part(link, '#', 2) AS section FROM r),
u AS (SELECT code, effective, max(version_id) AS version_id FROM v WHERE effective IS NOT NULL GROUP BY ALL),
a AS (SELECT q.*, u.version_id FROM q ASOF LEFT JOIN u ON q.code = u.code AND q.day >= u.effective),
b AS (SELECT a.*, k.earliest, k.undated, lower(c.text) AS t, lower(criterion) AS n FROM a LEFT JOIN k ON k.code = a.code LEFT JOIN c ON c.version_id = a.version_id AND c.sec = a.section),
y AS (SELECT *, CASE WHEN (n = 'thcc' AND {_any(H.THORAX_WORDS, "t")}) OR (n = 'hic36' AND {_any(H.HEAD_WORDS, "t")}) OR (n NOT IN ('thcc', 'hic36') AND contains(t, n)) THEN CAST(regexp_extract(t, '{H.LIMIT}', 1) AS DOUBLE) END AS x, regexp_extract(t, '{H.LIMIT}', 2) AS u, CASE WHEN contains(t, 'above') THEN 'floor' ELSE 'ceiling' END AS way FROM b),
z AS (SELECT record_id, position, version_id, criterion, value, x AS limit_value, CASE WHEN x IS NOT NULL THEN way END AS direction,
  CASE WHEN criterion IS NULL THEN 'schema: incomplete result' WHEN day IS NULL THEN 'date: not YYYY-MM-DD' WHEN NOT contains(link, '#') THEN 'link is not CODE#SECTION' WHEN undated IS NULL THEN 'regulation not found' WHEN undated THEN 'a version has no date'
    WHEN day < earliest THEN 'test is before the first version' WHEN t IS NULL THEN 'clause not found' WHEN x IS NULL THEN 'limit not readable' WHEN lower(unit) <> u THEN 'unit mismatch' END AS reason FROM y)
"""

SQL = {
    "limit_extract": _LIMITS + """SELECT l_orderkey, l_linenumber, l_partkey, x AS limit_value, how AS direction, unit,
  CASE WHEN x IS NULL THEN NULL WHEN CASE WHEN how = 'floor' THEN v >= x ELSE v <= x END THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN how = 'floor' THEN v - x ELSE x - v END AS headroom, round(round(pc, 2), 1) AS percent,
  CASE WHEN x IS NULL THEN 'clear' WHEN pc <= 0 THEN 'over' WHEN round(pc, 2) < 10 THEN 'tight' WHEN round(pc, 2) < 20 THEN 'close' ELSE 'clear' END AS band FROM p""",
    "asof_limit": """
WITH b AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT b.event_id, arg_max(v.event_id, (epoch_us(v.ts), v.event_id)) AS view_id, round(arg_max(v.value, (epoch_us(v.ts), v.event_id)), 6) AS limit_value
FROM b LEFT JOIN v ON v.user_id = b.user_id AND v.ts <= b.ts GROUP BY b.event_id""",
    "latest_limit": """
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS e FROM orders)
SELECT o_custkey, o_orderkey, CAST(e AS VARCHAR) AS effective FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC NULLS LAST, o_orderkey) = 1""",
    "linked_results": _LINKED_SQL + """
SELECT record_id, position, version_id, criterion, value, limit_value, direction, CASE WHEN reason IS NULL THEN CASE WHEN margin >= 0 THEN 'PASS' ELSE 'FAIL' END END AS verdict, CASE WHEN reason IS NULL THEN margin END AS headroom, reason
FROM (SELECT *, CASE direction WHEN 'floor' THEN value - limit_value ELSE limit_value - value END AS margin FROM z)""",
    "harness_ingest": _LINKED_SQL + """,
s AS (SELECT record_id, arg_min(reason, (position, reason)) FILTER (WHERE reason IS NOT NULL) AS reason, count(*) AS n_results FROM z GROUP BY record_id)
SELECT *, CASE WHEN reason IS NULL THEN 'ACCEPTED' WHEN regexp_matches(reason, '^(schema|date)') THEN 'FAILED' ELSE 'REFUSED' END AS outcome FROM s""",
    "close_to_limit": """
WITH h AS (SELECT event_type, event_id, round(100.0 - value, 4) AS headroom FROM events WHERE (event_id % 2 <> 1 OR user_id = 7) AND value IS NOT NULL)
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY headroom, event_id) AS place, event_id, headroom FROM h QUALIFY place <= 5""",
    "close_to_clause_limits": _LINKED_SQL.split("q AS (SELECT")[0] + f"""w AS (SELECT code, version_id FROM v QUALIFY row_number() OVER (PARTITION BY code ORDER BY effective DESC NULLS LAST, version_id) = 1),
s AS (SELECT r.record_id, position, coalesce(criterion, 'ThCC') AS criterion, value, link FROM r LEFT JOIN orders o ON o.o_orderkey = r.record_id AND o_orderkey % 7 <> 3 WHERE o_orderkey IS NULL OR o_orderkey % 2 <> 0 OR o_custkey % 9 = 4),
j AS (SELECT s.*, lower(c.text) AS t, lower(criterion) AS n FROM s LEFT JOIN w ON w.code = split_part(link, '#', 1) AND contains(link, '#') LEFT JOIN c ON c.version_id = w.version_id AND c.sec = split_part(link, '#', 2)),
y AS (SELECT *, CASE WHEN (n = 'thcc' AND {_any(H.THORAX_WORDS, "t")}) OR (n = 'hic36' AND {_any(H.HEAD_WORDS, "t")}) OR (n NOT IN ('thcc', 'hic36') AND contains(t, n)) THEN CAST(regexp_extract(t, '{H.LIMIT}', 1) AS DOUBLE) END AS x, regexp_extract(t, '{H.LIMIT}', 2) AS u FROM j),
e AS (SELECT *, coalesce(x, 42.0) AS limit_value FROM y WHERE x IS NULL OR u = 'mm'), f AS (SELECT *, round(limit_value - value, 4) AS headroom FROM e)
SELECT row_number() OVER (ORDER BY headroom, record_id, position) AS place, record_id, position, criterion, value, limit_value, headroom, round(abs(limit_value - value) / limit_value * 100, 2) AS percent, CASE WHEN value <= limit_value THEN 'PASS' ELSE 'FAIL' END AS verdict, link FROM f QUALIFY place <= 100""",
    "access_audit": """
WITH e AS (SELECT *, event_id % 2 = 0 AS conf, event_id % 4 IN (1, 2) AS ok FROM events)
SELECT CASE WHEN conf AND user_id <> 7 THEN 'denied: owner' WHEN conf AND NOT ok THEN 'denied: model' ELSE 'allowed' END AS outcome, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM e GROUP BY ALL""",
    "inventory": "SELECT source, count(*) AS total, count(*) FILTER (WHERE upper(lang) = 'EN') AS english, max(n_chars) AS longest FROM documents GROUP BY source",
    "version_history": "SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderstatus, o_orderkey) AS versions FROM orders GROUP BY o_custkey",
    "run_summary": """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, count(*) AS items, count(*) FILTER (WHERE event_type = 'signup') AS new, count(*) FILTER (WHERE event_type = 'click') AS changed, count(*) FILTER (WHERE event_type = 'view') AS duplicate,
  count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type = 'purchase') AS needs_ocr, count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS accepted FROM events GROUP BY 1""",
    "timing_summary": """
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS steps, arg_max(l_linenumber, l_quantity * 100 - l_linenumber) AS slowest FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, steps, greatest(0, CAST(floor(o_totalprice / 1000) AS BIGINT) - steps) AS overhead, slowest FROM orders JOIN s ON l_orderkey = o_orderkey""",
    "token_spend": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(length(props)) AS BIGINT) AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "retrieval_diff": r"""
WITH d AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '\s+')) AS w FROM documents),
p AS (SELECT a.doc_id, len(a.w) AS na, len(b.w) AS nb, len(list_intersect(a.w, b.w)) AS k FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, nb - k AS added, na - k AS removed, round(k::DOUBLE / (na + nb - k), 6) AS jaccard FROM p""",
    "case_eval": f"""
WITH c(case_id, must_contain, tog, must_not, codes, needs, pipes) AS (VALUES {", ".join(f"({i}, {a or []}::VARCHAR[], {t or []}::VARCHAR[], {n or []}::VARCHAR[], {k or []}::VARCHAR[], {str(q).lower()}, {p or 20})" for i, a, t, n, k, q, p in CASES)}),
h AS (SELECT CAST(CASE WHEN doc_id % 5 = 4 THEN 6 ELSE doc_id % 5 + 1 END AS INT) AS case_id, 'UN_R' || (doc_id % 9) AS code, doc_id % 3 = 0 AS tab, {_HIT} AS x, lower({_HIT}) AS t FROM documents),
j AS (SELECT c.*, h.code, h.t IS NOT NULL AS hit, coalesce(h.t, '') AS t, coalesce(len(list_filter(tog, lambda w: NOT contains(h.t, lower(w)))) = 0, false) AS every, coalesce(length(x) - length(replace(x, '|', '')) >= pipes AND (tab OR contains(x, '| --- |')), false) AS grid FROM c LEFT JOIN h USING (case_id)),
r AS (SELECT case_id, any_value(tog) AS tog, any_value(needs) AS needs, any_value(codes) AS codes, list(DISTINCT code) FILTER (code IS NOT NULL) AS named, count(*) FILTER (hit) AS retrieved, bool_or(every) AS every, bool_or(every AND grid) AS whole,
  bool_or(len(list_filter(must_not, lambda w: CASE WHEN starts_with(w, ' ') OR ends_with(w, ' ') THEN contains(' ' || t || ' ', w) ELSE regexp_matches(t, '\\b\\Q' || w || '\\E\\b') END)) > 0) AS bad FROM j GROUP BY case_id),
w AS (SELECT c.case_id, bool_and(EXISTS (SELECT 1 FROM h WHERE h.case_id = c.case_id AND contains(h.t, x.w))) AS found FROM c, LATERAL (SELECT unnest(must_contain) AS w) x GROUP BY c.case_id),
o AS (SELECT case_id, coalesce(found, true) AS found, CASE WHEN len(codes) > 0 THEN list_has_all(coalesce(named, []), codes) ELSE retrieved > 0 END AS codes_ok, len(tog) = 0 OR every AS together, NOT bad AS clean, NOT needs OR whole AS table_ok, retrieved FROM r LEFT JOIN w USING (case_id))
SELECT *, found AND codes_ok AND together AND clean AND table_ok AS passed FROM o""",
    "error_streaks": """
WITH e AS (SELECT user_id, event_id, event_type IN ('error', 'click') AS bad, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM events)
SELECT user_id, min(event_id) AS first_order, count(*) AS length FROM e WHERE bad GROUP BY user_id, i HAVING count(*) >= 3""",
}
