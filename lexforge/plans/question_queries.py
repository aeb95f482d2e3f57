"""Queries of what questions ask for, over conversations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import questions as Q
from lexforge.sources.tables import table

#: How turns of conversations begin, by their ids: questions with and without codes, years, series and measurements.
_ASKED = [
    "'What is the chest deflection limit under UN R' || (conv_id % 130) || '?'",
    "'the locking mechanism is deceleration-actuated only - check this against §7.6.2'",
    "'What is the difference between UN R' || (conv_id % 90 + 10) || ' and R' || (conv_id % 140 + 10) || ' for child restraints?'",
    "'Euro NCAP ' || (2015 + conv_id % 15) || ' side score, 05 series'",
    "'FMVSS ' || (200 + conv_id % 30) || ' head injury, 0' || (conv_id % 9) || ' Series of amendments of R94'",
    "(conv_id % 60) || '.4mm thorax vs ' || (conv_id % 70 + 20) || 'mm UN R94 limit, what is the margin?'",
    "(conv_id % 60) || '.4 mm vs 42 mm limit, is that margin tight, what else is close to its limit?'",
    "'ISOFIX anchorage points, annex 6 of R 14'",
    "'paragraph 7.6.2: how does the retractor lock'",
    "'how far is it from r44, or R129'",
    "'hic: 612 mm, then ' || (conv_id % 900) || '.5mm headroom in un-r14, anchorage'",
    "'frontal impact criteria of R94 and R94'",
]
_CASE = f"CASE (conv_id * 5 + turn) % {len(_ASKED)} " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(_ASKED)) + " END || ' ' || coalesce(text, '')"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_CASE).alias("query"))


def query_filters(spark: SparkSession, d: str) -> DataFrame:
    return Q.filters(_questions(spark, d)).select("conv_id", "turn", F.array_join("codes", ",").alias("codes"), "amendment", "source_type")


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return Q.expand(_questions(spark, d)).select("conv_id", "turn", F.md5(F.col("expanded").cast("binary")).alias("expanded_md5"))


def margin_parse(spark: SparkSession, d: str) -> DataFrame:
    return Q.margins(_questions(spark, d)).drop("query")


QUERIES = {f.__name__: f for f in (query_filters, query_expansion, margin_parse)}


def _p(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _words(words: tuple[str, ...]) -> str:
    return "(" + (" OR ".join(f"contains(low, '{w}')" for w in words) or "false") + ")"


def _rule(pattern: str | None, code: str | None, words: tuple[str, ...], terms: str) -> str:
    if code is None:
        holds = "len(un) >= 2 OR (contains(low, 'r44') AND contains(low, 'r129'))"
    else:
        alone = "" if code == "UN_R94" else "len(un) = 1 AND "
        holds = f"(({alone}list_contains(un, '{code}')) OR regexp_matches(query, {_p(pattern)})) AND {_words(words)}"
    return f"CASE WHEN {holds} THEN ' {terms}' ELSE '' END"


_FILTERS = f"""
WITH a AS (SELECT conv_id, turn, {_CASE} AS query FROM conversations), u AS (SELECT *, upper(query) AS q, lower(query) AS low FROM a),
x AS (SELECT *, regexp_extract_all(q, {_p(Q.UN_CODE)}, 1) AS found, nullif(regexp_extract(q, {_p(Q.FMVSS)}, 1), '') AS fm, nullif(regexp_extract(q, {_p(Q.NCAP_YEAR)}, 1), '') AS y, nullif(regexp_extract(q, {_p(Q.SERIES)}, 1), '') AS s FROM u),
f AS (SELECT *, CASE WHEN len(found) = 0 AND fm IS NULL AND regexp_matches(query, {_p(Q.LOCKING)}) THEN ['UN_R16'] ELSE list_transform(list_distinct(found), lambda c: 'UN_' || c) END AS un FROM x)
"""

SQL = {
    "query_filters": _FILTERS + """SELECT conv_id, turn, array_to_string(list_sort(list_concat(un, CASE WHEN fm IS NOT NULL THEN ['FMVSS ' || fm] ELSE [] END)), ',') AS codes, coalesce('Protocol Year ' || y, s || ' Series') AS amendment,
  CASE WHEN fm IS NOT NULL THEN 'FMVSS' WHEN y IS NOT NULL THEN 'Euro NCAP' WHEN len(found) > 1 THEN 'UNECE' END AS source_type FROM f""",
    "query_expansion": _FILTERS + f"SELECT conv_id, turn, md5(query || {' || '.join(_rule(*r) for r in Q.EXPANSIONS)}) AS expanded_md5 FROM f",
    "margin_parse": f"""
WITH a AS (SELECT conv_id, turn, {_CASE} AS query FROM conversations), n AS (SELECT *, regexp_extract_all(query, {_p(Q.MM)}, 1) AS ns FROM a),
m AS (SELECT *, len(ns) >= 2 AS two, lower(nullif(regexp_extract(query, {_p(Q.CRITERION)}, 1), '')) AS word, CASE WHEN len(ns) >= 2 THEN CAST(coalesce(nullif(regexp_extract(query, {_p(Q.MM_PAIR)}, 1), ''), ns[1]) AS DOUBLE) END AS measured,
  CASE WHEN len(ns) >= 2 THEN CAST(coalesce(nullif(regexp_extract(query, {_p(Q.MM_PAIR)}, 2), ''), ns[2]) AS DOUBLE) END AS limit_mm FROM n)
SELECT conv_id, turn, two AND (regexp_matches(query, {_p(Q.MARGIN)}) OR regexp_matches(query, {_p(Q.CLOSE)})) AS is_margin, measured, limit_mm, CASE WHEN two THEN CASE WHEN word IS NULL OR word IN ('thorax', 'thcc', 'chest') THEN 'ThCC' ELSE upper(word) END END AS criterion,
  CASE WHEN two THEN 'UN_' || upper(nullif(regexp_extract(query, {_p("(?i)" + Q.UN_CODE)}, 1), '')) END AS code, round(limit_mm - measured, 4) AS margin, CASE WHEN two THEN CASE WHEN measured <= limit_mm THEN 'PASS' ELSE 'FAIL' END END AS verdict FROM m""",
}
