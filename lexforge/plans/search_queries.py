"""Queries of the inverted index and of codes in texts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import inverted as I
from lexforge.sources.shared import shared_folder
from lexforge.sources.tables import table


def inverted_search(spark: SparkSession, d: str) -> DataFrame:
    """The opening words of every fiftieth document, searched in all of them: the five best that have all terms."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = I.InvertedIndex(spark, shared_folder(spark, "inverted"))
    index.build(docs)
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 24).alias("query"))
    return index.search(asked, 5)


def code_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: the last part of a URL may say a code, the text one, two or none; codes are the parts of a register of 190 numbers and three others."""
    codes = table(spark, d, "part").select(F.expr("CASE p_partkey % 200 WHEN 190 THEN 'FMVSS 208' WHEN 191 THEN 'Euro NCAP AOP' WHEN 192 THEN 'IIHS Side Barrier' ELSE 'R' || (p_partkey % 190) END").alias("code")).distinct()
    i = F.col("page_id")
    name = F.when(i % 7 == 0, F.format_string("UN_R%03d", (i % 210).cast("int"))).when(i % 7 == 1, F.lit("fmvss-208"))
    said = F.expr("""CASE page_id % 6 WHEN 0 THEN 'UN Regulation No. ' || (page_id % 195) || ' applies' WHEN 1 THEN 'see UN R' || (page_id % 195) || ', and R' || (page_id % 97) WHEN 2 THEN 'the Euro-NCAP (AOP) protocol'
        WHEN 3 THEN 'r0' || (page_id % 195) || '. IIHS side' WHEN 4 THEN 'R' || (page_id % 195) || 'x is none' ELSE '' END""")
    files = table(spark, d, "pages").select(i.alias("file_id"), name.alias("file_code"), F.concat(F.coalesce("html", F.lit("")), F.lit(" "), said).alias("text"))
    return I.resolve_files(files, codes).select("file_id", "code", "how")


QUERIES = {f.__name__: f for f in (inverted_search, code_in_text)}

_STOPS = ", ".join(f"'{w}'" for w in I.STOP_WORDS)
_WORDS = r"list_filter(string_split_regex(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND x NOT IN (" + _STOPS + "))"

SQL = {
    "inverted_search": f"""
WITH raw AS (SELECT doc_id, unnest({_WORDS.format(t="text")}) AS w FROM documents), asked AS (SELECT doc_id AS query_id, unnest({_WORDS.format(t="substr(text, 1, 24)")}) AS w FROM documents WHERE doc_id % 50 = 0),
words AS (SELECT DISTINCT w FROM raw UNION SELECT DISTINCT w FROM asked), stems AS (SELECT w, {I.stem_sql("w")} AS term FROM words),
h AS (SELECT doc_id, term, count(*) AS tf FROM raw JOIN stems USING (w) GROUP BY ALL), l AS (SELECT doc_id, coalesce(sum(tf), 0) AS length FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id),
z AS (SELECT count(*) AS docs, avg(length) AS mean FROM l), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
q AS (SELECT DISTINCT query_id, term FROM asked JOIN stems USING (w)), n AS (SELECT query_id, count(*) AS asked FROM q GROUP BY query_id),
s AS (SELECT query_id, doc_id, count(*) AS met, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN f USING (term) JOIN h USING (term) JOIN l USING (doc_id), z GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN n USING (query_id) WHERE met = asked QUALIFY rank <= 5""",
    "code_in_text": r"""
WITH c AS (SELECT DISTINCT CASE p_partkey % 200 WHEN 190 THEN 'FMVSS 208' WHEN 191 THEN 'Euro NCAP AOP' WHEN 192 THEN 'IIHS Side Barrier' ELSE 'R' || (p_partkey % 190) END AS code FROM part),
k AS (SELECT code, CASE WHEN regexp_matches(code, '^R\d+$') THEN '(?:un[^a-z0-9]*)?r[^a-z0-9]*0*' || substr(code, 2) || '|regulation[^a-z0-9]+no[^a-z0-9]+0*' || substr(code, 2) ELSE regexp_replace(lower(code), ' ', '[^a-z0-9]*', 'g') END AS p FROM c),
f AS (SELECT page_id AS i, CASE page_id % 7 WHEN 0 THEN 'r' || (page_id % 210) WHEN 1 THEN 'fmvss208' END AS name,
  lower(coalesce(html, '') || ' ' || CASE page_id % 6 WHEN 0 THEN 'UN Regulation No. ' || (page_id % 195) || ' applies' WHEN 1 THEN 'see UN R' || (page_id % 195) || ', and R' || (page_id % 97) WHEN 2 THEN 'the Euro-NCAP (AOP) protocol'
        WHEN 3 THEN 'r0' || (page_id % 195) || '. IIHS side' WHEN 4 THEN 'R' || (page_id % 195) || 'x is none' ELSE '' END) AS t FROM pages),
n AS (SELECT i, t, code AS named FROM f LEFT JOIN c ON lower(replace(code, ' ', '')) = name),
h AS (SELECT i, count(*) AS n, min(code) AS hit FROM n JOIN k ON named IS NULL AND regexp_matches(t, '(?:^|[^a-z0-9])(?:' || p || ')(?:$|[^a-z0-9])') GROUP BY i)
SELECT i AS file_id, CASE WHEN named IS NOT NULL THEN named WHEN h.n = 1 THEN hit END AS code, CASE WHEN named IS NOT NULL THEN 'filename' WHEN h.n = 1 THEN 'text' WHEN h.n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM n LEFT JOIN h USING (i)""",
}
