"""Queries of metadata, test reports, prompts within a budget and the circuit breaker, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import extraction as X
from lexforge.sources.shared import shared_folder
from lexforge.sources.tables import table
from lexforge.streaming import circuit

#: First lines of pages, by the page's id: what the rules of each authority look for.
_OPENINGS = [
    "'E/ECE Regulation No. ' || (page_id % 160) || chr(10) || 'Uniform provisions concerning the approval of vehicles with regard to  seats' || (page_id % 5) || chr(10) || 'Agreement. ' || (page_id % 9 + 1) || ' series of amendments - Date of entry into force: ' || (2000 + page_id % 25) || '-0' || (page_id % 9 + 1) || '-15'",
    "'UN R' || (page_id % 160) || ' Supplement ' || (page_id % 7) || ' to the 03 series, Corrigendum ' || (page_id % 3) || '. Date of entry into force: ' || (page_id % 28 + 1) || ' June 2011'",
    "'EURO NCAP ' || CASE page_id % 3 WHEN 0 THEN 'Adult Occupant' WHEN 1 THEN 'Child Occupant' ELSE 'scope of' END || ' Assessment, ' || (2010 + page_id % 20)",
    "'Standard No. ' || (page_id % 300) || ' - Side Impact ' || (page_id % 4) || chr(10) || 'This is FMVSS ' || (page_id % 300)",
    "CASE WHEN page_id % 2 = 0 THEN 'NHTSA opened: March ' || (page_id % 28 + 1) || ', 2023. PE' || (10 + page_id % 90) || '-004' ELSE 'Recall ' || (10 + page_id % 90) || 'V-123' END",
    "'IIHS ' || CASE page_id % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'frontal' ELSE '' END || ' test, June ' || (2010 + page_id % 12)",
    "'modified scope'",
    "''",
]
_OPENING = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(_OPENINGS)) + " END"
_NAME = "CASE page_id % 5 WHEN 0 THEN 'R' || (page_id % 100) || '_base-text.pdf' WHEN 1 THEN 'iihs_notes.v2.pdf' WHEN 2 THEN 'page_' || page_id ELSE NULL END"


def first_page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of every page, which begins as a document of one of the authorities may."""
    rows = table(spark, d, "pages").select("page_id", F.expr(_NAME).alias("file_name"), F.concat(F.expr(_OPENING), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("text"))
    return X.metadata(rows).select("page_id", "source_type", "code", F.md5(F.col("title").cast("binary")).alias("title_md5"), "amendment", "supplement", "corrigendum", F.col("effective_date").cast("string").alias("effective_date"), F.col("publication_date").cast("string").alias("publication_date"), "market")


_REPORT = """concat_ws(chr(10), 'Program: ' || o_orderpriority || '  ', CASE WHEN o_orderkey % 7 > 0 THEN 'test-20' || (10 + o_custkey % 80) || '-0' || (o_orderkey % 9 + 1) || '-' || (100 + o_orderkey % 900) END,
    CASE WHEN o_orderkey % 11 > 0 THEN 'on 20' || (10 + o_custkey % 80) || '-0' || (o_orderkey % 9 + 1) || '-' || (10 + o_orderkey % 22) END, CASE WHEN o_orderkey % 3 = 0 THEN 'Impact mode: side_mdb' END, CASE WHEN o_orderkey % 4 = 0 THEN 'Dummy: THOR ' || (o_orderkey % 60) END,
    CASE WHEN o_orderkey % 5 > 0 THEN 'ThCC: ' || (o_custkey % 60) || '.5 mm' END, CASE WHEN o_orderkey % 2 = 0 THEN 'hic36 | ' || (o_custkey % 900) END, CASE WHEN o_orderkey % 13 = 0 THEN 'TCFC ' || (o_custkey % 9) || ' kN' END)"""
_TEXT = f"CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE {_REPORT} END"


def report_records(spark: SparkSession, d: str) -> DataFrame:
    """A test report for every order: its record's fields, how many results it has with their sum, or its errors."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.expr(_TEXT.replace("chr(10)", "char(10)")).alias("text"), F.lit("UN_R94#5.2.1").alias("linked_clause"))
    total = F.aggregate("record.results", F.lit(0.0), lambda a, r: a + r["position"] * r["value"])
    kinds = F.array_join(F.transform("record.results", lambda r: r["criterion"]), ",")
    return X.read_reports(rows).select("report_id", "record.test_id", "record.program", "record.date", "record.impact_mode", "record.dummy", kinds.alias("criteria"), total.alias("weighted"), F.array_join("errors", "; ").alias("errors"))


def prompt_levels(spark: SparkSession, d: str) -> DataFrame:
    """The turns of every conversation, five times over, as passages; limits differ by conversation."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    passages = rows.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat_ws(" ", *["text"] * 5).alias("text"))
    limits = rows.select(F.col("conv_id").alias("query_id")).distinct().withColumn("limit", (F.col("query_id") % 23 * 60).cast("int"))
    return X.compress_prompts(passages, limits).select("query_id", "level", "tokens", "passages", F.md5(F.col("context").cast("binary")).alias("context_md5"), "fits")


def _calls(events: DataFrame) -> DataFrame:
    """Events as calls of three providers: errors are failed connections, one signup in 500 a rate limit, other signups say nothing."""
    kind = F.when(F.col("event_type") == "error", circuit.CONNECTION).when((F.col("event_type") == "signup") & (F.col("event_id") % 500 == 7), "rate_limit").when(F.col("event_type") == "signup", "other").otherwise(circuit.SUCCESS)
    return events.select((F.col("user_id") % 3).alias("key"), F.col("event_id").alias("call_id"), F.col("ts").alias("at"), kind.alias("kind"))


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return circuit.run_table(_calls(table(spark, d, "events")))


def circuit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream over the table's files, which are one batch."""
    folder = shared_folder(spark, "circuit")
    # a pattern, since a stream takes a table of one file by no other name
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{d}/event[s].parquet")
    out = circuit.run_stream(_calls(stream)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(circuit.OUT).parquet(f"{folder}/out")


QUERIES = {f.__name__: f for f in (first_page_metadata, report_records, prompt_levels, circuit_breaker, circuit_stream)}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _field(name: str) -> str:
    return f"nullif(regexp_extract(t, {_quoted(X.FIELDS[name])}, 1), '')"


def _case(column: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_quoted(p)}) THEN '{v}'" for p, v in rules) + f" ELSE {other} END"


def _date(expression: str) -> str:
    """Days as the openings write them."""
    forms = ["%Y-%m-%d", "%d.%m.%Y", "%d %B %Y", "%B %d, %Y"]
    found = [(r"(\d{4}-\d{2}-\d{2})", 0), (r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), (r"(?i)(\d{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december) \d{4})", 2), (r"(?i)((?:january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2}, \d{4})", 3)]
    return "coalesce(" + ", ".join(f"try_strptime(nullif(regexp_extract({expression}, '{p}', 1), ''), '{forms[i]}')::DATE" for p, i in found) + ")"


_FOLD = f"""list_reduce(list_prepend({{'tm': 0::BIGINT, 'id': -1::BIGINT, 'kind': '', 'streak': 0, 'until': 0::BIGINT, 'log': ''}}, calls), lambda s, c: CASE
    WHEN s.until > 0 AND c.tm < s.until THEN {{'tm': c.tm, 'id': c.id, 'kind': '', 'streak': s.streak, 'until': s.until, 'log': s.log || c.id || ':skipped:' || s.streak || ' '}}
    WHEN c.kind = 'rate_limit' THEN {{'tm': c.tm, 'id': c.id, 'kind': '', 'streak': CASE WHEN s.until > 0 THEN 0 ELSE s.streak END, 'until': {circuit.FOREVER}, 'log': s.log || c.id || ':opened:' || CASE WHEN s.until > 0 THEN 0 ELSE s.streak END || ' '}}
    WHEN c.kind = 'connection' AND CASE WHEN s.until > 0 THEN 0 ELSE s.streak END + 1 >= 2 THEN {{'tm': c.tm, 'id': c.id, 'kind': '', 'streak': s.streak + 1, 'until': c.tm + 300000000, 'log': s.log || c.id || ':opened:' || (s.streak + 1) || ' '}}
    WHEN c.kind = 'connection' THEN {{'tm': c.tm, 'id': c.id, 'kind': '', 'streak': 1, 'until': 0, 'log': s.log || c.id || ':failed:1 '}}
    WHEN c.kind = 'success' THEN {{'tm': c.tm, 'id': c.id, 'kind': '', 'streak': 0, 'until': 0, 'log': s.log || c.id || ':passed:0 '}}
    ELSE {{'tm': c.tm, 'id': c.id, 'kind': '', 'streak': CASE WHEN s.until > 0 THEN 0 ELSE s.streak END, 'until': 0, 'log': s.log || c.id || ':passed:' || CASE WHEN s.until > 0 THEN 0 ELSE s.streak END || ' '}} END).log"""
_CIRCUIT = f"""
WITH c AS (SELECT CAST(user_id % 3 AS VARCHAR) AS key, event_id, epoch_us(ts) AS tm, CASE WHEN event_type = 'error' THEN 'connection' WHEN event_type = 'signup' AND event_id % 500 = 7 THEN 'rate_limit' WHEN event_type = 'signup' THEN 'other' ELSE 'success' END AS kind FROM events),
l AS (SELECT key, list({{'tm': tm, 'id': event_id, 'kind': kind, 'streak': 0, 'until': 0::BIGINT, 'log': ''}} ORDER BY tm, event_id) AS calls FROM c GROUP BY key),
o AS (SELECT key, unnest(string_split(trim({_FOLD}), ' ')) AS x FROM l)
SELECT key, CAST(split_part(x, ':', 1) AS BIGINT) AS call_id, split_part(x, ':', 2) AS outcome, CAST(split_part(x, ':', 3) AS INT) AS streak FROM o"""

_CUT_N = "CASE WHEN greatest(1, floor({n} * 1.33)) <= {most} THEN {n} ELSE least({n}, greatest(1, floor({most} / 1.33))) + 4 END"
_BUDGET = "CASE WHEN level = 0 THEN 3500 ELSE greatest(300, 3500 // (level + 1)) END"
_MOST = "CASE WHEN level >= 2 THEN floor(chars * greatest(0.35::DOUBLE, 1 - 0.25::DOUBLE * (level - 1))) ELSE 1e9 END"
_CUT_T = "CASE WHEN greatest(1, floor(len({w}) * 1.33)) <= {most} THEN {t} ELSE array_to_string({w}[1:greatest(1, floor({most} / 1.33))::BIGINT], ' ') || chr(10) || '…[truncated for token budget]' END"


def _ws(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"


SQL = {
    "first_page_metadata": f"""
WITH p AS (SELECT page_id, coalesce({_NAME}, '') AS n, {_OPENING} || chr(10) || coalesce(html, '') AS t FROM pages),
s AS (SELECT *, upper(t) AS u, CASE WHEN regexp_matches(upper(t), {_quoted(X.SOURCES[0][1])}) OR (contains(upper(t), 'ADDENDUM') AND contains(upper(t), 'REGULATION NO.')) THEN 'UNECE'
  ELSE {_case("upper(t)", [(p, s) for s, p, _ in X.SOURCES[1:]], _case("upper(n)", [(p, s) for s, _, p in X.SOURCES], "'INTERNAL'"))} END AS source_type FROM p),
f AS (SELECT *, {", ".join(f"{_field(k)} AS {k}" for k in X.FIELDS)}, {_case("u", X.CATEGORIES, "'General'")} AS category, nullif(regexp_extract(n, {_quoted(X.FIELDS["year"])}, 1), '') AS file_year FROM s),
g AS (SELECT *, coalesce(year, file_year, '2026') AS y, CASE source_type WHEN 'UNECE' THEN coalesce('R' || coalesce(un_code, un_code_short), 'UNKNOWN') WHEN 'Euro NCAP' THEN 'Euro NCAP ' || coalesce(year, file_year, '2026') || ' - ' || category
  WHEN 'FMVSS' THEN coalesce('FMVSS ' || coalesce(fmvss, cfr), 'UNKNOWN') WHEN 'NHTSA' THEN coalesce('NHTSA ODI ' || odi[1:2], 'NHTSA Recall ' || recall, 'NHTSA Standard') WHEN 'IIHS' THEN {_case("u", X.IIHS_TESTS, "'IIHS Protocol'")} ELSE 'INTERNAL' END AS code FROM f),
h AS (SELECT *, CASE source_type WHEN 'UNECE' THEN 'UN Regulation concerning: ' || nullif(substr(trim(regexp_replace(un_title, '\\s+', ' ', 'g')), 1, 200), '')
  WHEN 'Euro NCAP' THEN coalesce('Euro NCAP Protocol: ' || regexp_replace(ncap_title, '^\\s+|\\s+$', '', 'g'), 'Euro NCAP ' || category || ' Assessment Protocol')
  WHEN 'FMVSS' THEN coalesce('FMVSS: ' || nullif(regexp_replace(fmvss_title, '^\\s+|\\s+$', '', 'g'), ''), 'Federal Motor Vehicle Safety Standard: ' || code)
  WHEN 'NHTSA' THEN coalesce('NHTSA Investigation: ' || odi, 'NHTSA Recall Campaign: ' || recall) WHEN 'IIHS' THEN CASE WHEN code <> 'IIHS Protocol' THEN code || ' Test Procedure' END END AS title,
  CASE source_type WHEN 'UNECE' THEN {_date("in_force")} WHEN 'Euro NCAP' THEN CAST(y || '-01-01' AS DATE) WHEN 'FMVSS' THEN DATE '2024-01-01' WHEN 'NHTSA' THEN {_date("issued")} WHEN 'IIHS' THEN try_strptime('1 ' || regexp_replace(month_year, '\\s+', ' ', 'g'), '%d %B %Y')::DATE
  ELSE CAST(year || '-01-01' AS DATE) END AS eff FROM g)
SELECT page_id, source_type, code, md5(coalesce(title, nullif(translate(regexp_replace(n, '\\.[^.]*$', ''), '_-', '  '), ''), '{X.NO_TITLE}')) AS title_md5,
  CASE source_type WHEN 'UNECE' THEN coalesce(CASE WHEN len(series) < 2 THEN '0' ELSE '' END || CAST(CAST(series AS BIGINT) AS VARCHAR) || ' Series', series_short || ' Series') WHEN 'Euro NCAP' THEN 'Protocol Year ' || y END AS amendment,
  CASE WHEN source_type = 'UNECE' THEN 'Supplement ' || supplement END AS supplement, CASE WHEN source_type = 'UNECE' THEN 'Corrigendum ' || corrigendum END AS corrigendum, CAST(eff AS VARCHAR) AS effective_date,
  CAST(CASE source_type WHEN 'UNECE' THEN eff WHEN 'Euro NCAP' THEN CAST((CAST(y AS INT) - 1) || '-11-01' AS DATE) END AS VARCHAR) AS publication_date, CASE WHEN source_type = 'Euro NCAP' THEN 'EU' WHEN source_type IN ('FMVSS', 'NHTSA', 'IIHS') THEN 'US' ELSE 'GLOBAL' END AS market FROM h""",
    "report_records": f"""
WITH o AS (SELECT o_orderkey AS report_id, coalesce({_TEXT}, '') AS t FROM orders),
f AS (SELECT report_id, t, {", ".join(f"nullif(regexp_extract(t, {_quoted(p)}, 1), '') AS {k}" for k, p in X.REPORT.items())}, list_transform(regexp_extract_all(t, {_quoted(X.RESULT)}, 1), lambda c: CASE WHEN starts_with(upper(c), 'HIC') THEN 'HIC36' WHEN upper(c) = 'THCC' THEN 'ThCC' ELSE upper(c) END) AS cs,
  list_transform(regexp_extract_all(t, {_quoted(X.RESULT)}, 2), lambda v: CAST(v AS DOUBLE)) AS vs FROM o),
e AS (SELECT *, CASE WHEN NOT regexp_matches(t, '\\S') THEN '{X.NO_TEXT}' WHEN test_id IS NULL OR date IS NULL OR len(cs) = 0 THEN concat_ws('; ', CASE WHEN test_id IS NULL THEN '{X.NO_ID}' END, CASE WHEN date IS NULL THEN '{X.NO_DATE}' END, CASE WHEN len(cs) = 0 THEN '{X.NO_RESULT}' END)
  WHEN try_strptime(date, '%Y-%m-%d') IS NULL THEN '{X.BAD_DATE}: ' || date ELSE '' END AS errors FROM f)
SELECT report_id, CASE WHEN errors = '' THEN upper(test_id) END AS test_id, CASE WHEN errors = '' THEN coalesce(trim(program), 'UPLOADED') END AS program, CASE WHEN errors = '' THEN date END AS date, CASE WHEN errors = '' THEN coalesce(upper(impact_mode), 'FRONTAL_OFFSET') END AS impact_mode,
  CASE WHEN errors = '' THEN trim(dummy) END AS dummy, CASE WHEN errors = '' THEN array_to_string(cs, ',') END AS criteria, CASE WHEN errors = '' THEN list_sum(list_transform(vs, lambda v, i: v * i)) END AS weighted, errors FROM e""",
    "prompt_levels": f"""
WITH m AS (SELECT conv_id AS q, turn + 1 AS rank, min(text) AS x FROM conversations GROUP BY ALL), r AS (SELECT q, rank, concat_ws(' ', x, x, x, x, x) AS t FROM m), p AS (SELECT *, len({_ws("t")}) AS n, length(t) AS chars, row_number() OVER (PARTITION BY q ORDER BY rank) AS i, count(*) OVER (PARTITION BY q) AS k FROM r WHERE rank <= 6),
l AS (SELECT unnest(range(0, {X.LEVELS + 1})) AS level), kept AS (SELECT *, {_MOST} AS most FROM p, l WHERE i <= greatest(1, k - level)),
s AS (SELECT q, level, count(*) AS passages, sum({_CUT_N.format(n="n", most="most")}) AS n FROM kept GROUP BY ALL), z AS (SELECT *, greatest(1, floor(({_CUT_N.format(n="n", most=_BUDGET)}) * 1.33))::INT AS tokens FROM s),
c AS (SELECT q, level, tokens, passages, tokens <= q % 23 * 60 AS fits FROM z QUALIFY row_number() OVER (PARTITION BY q ORDER BY CASE WHEN tokens <= q % 23 * 60 THEN level ELSE 100 - level END) = 1),
b AS (SELECT q, level, string_agg({_CUT_T.format(w=_ws("t"), t="t", most="most")}, chr(10) || chr(10) ORDER BY rank) AS body FROM kept JOIN c USING (q, level) GROUP BY ALL)
SELECT q AS query_id, level::INT AS level, tokens, passages, md5({_CUT_T.format(w=_ws("body"), t="body", most=_BUDGET)}) AS context_md5, fits FROM c JOIN b USING (q, level)""",
    "circuit_breaker": _CIRCUIT,
    "circuit_stream": _CIRCUIT,
}
