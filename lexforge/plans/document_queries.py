"""Chunking, version, gate and coverage queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import documents as D
from lexforge.operators import structure
from lexforge.plans import structure_sql
from lexforge.sources.tables import table


def flat_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.flat_chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    return D.flat_chunks(table(spark, d, "documents"), 1800, 200, True).select("doc_id", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per order and line number, which lineitem doesn't promise."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))


def _clause_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines made from lineitem: every third is a clause line."""
    line = F.expr("CASE l_linenumber % 3 WHEN 1 THEN '5.' || (l_orderkey % 9) || '.' || l_linenumber || ' limit ' || cast(l_quantity AS int) || ' mm' ELSE 'text ' || l_returnflag END")
    return _lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), line.alias("line"))


def clause_split(spark: SparkSession, d: str) -> DataFrame:
    return D.clause_blocks(_clause_lines(spark, d))


def md_sections(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    line = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '## ' || CASE o_orderkey % 4 WHEN 0 THEN 'Annex ' || (o_orderkey % 5) || ' Tests' WHEN 1 THEN (o_orderkey % 4) || '.' || (o_orderkey % 3) || '. Scope' ELSE 'Foreword' END ELSE 'line ' || o_orderpriority END")
    lines = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return D.markdown_sections(lines).select("doc_id", "section", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def table_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    line = F.expr("CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 OR l_quantity > 40 THEN 'prose' ELSE '| ' || l_returnflag || ' | ' || l_linestatus || ' | ' || cast(l_quantity AS int) || ' | x | y |' END")
    return D.table_islands(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), line.alias("line")))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    hashed = content_hash(spark, d)
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored for even documents only: which sources can use how many again."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("chunk_text"))
    stored = docs.where("doc_id % 2 = 0").select(T.content_hash(F.col("chunk_text")).alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    return D.incremental_plan(docs, stored).groupBy("source").agg(F.count("*").alias("total"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("new"))


def header_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Headers with a type, read back into fingerprints; every ninth document has none."""
    docs = table(spark, d, "documents")
    number = F.col("doc_id").cast("string")
    made = T.header(F.col("source"), F.concat(F.lit("UN_R"), (F.col("doc_id") % 150).cast("string")), F.lit("05 Series"), F.concat(F.lit("doc"), number), F.col("doc_id") % 12, F.lit("5.2.1"), F.when(F.col("doc_id") % 2 == 0, "clause").otherwise("table"))
    chunk = F.when(F.col("doc_id") % 9 == 0, F.col("text")).otherwise(F.concat(made, F.lit("\n\n"), F.col("text")))
    return docs.select("doc_id", T.fingerprint(chunk).alias("fingerprint"))


def version_register(spark: SparkSession, d: str) -> DataFrame:
    """Odd orders come in against the registry of even ones; priorities play the amendment, some are null."""
    o = table(spark, d, "orders")
    cols = [F.expr("o_custkey % 300").alias("code"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("amendment"), F.col("o_orderstatus").alias("file_hash"), "o_orderkey"]
    active = o.where("o_orderkey % 2 = 0").select(*cols).groupBy("code", "amendment").agg(F.max_by("file_hash", "o_orderkey").alias("file_hash"))
    found = D.register_versions(o.where("o_orderkey % 2 = 1").select(*cols), active, ["code", "amendment"])
    return found.select("o_orderkey", "code", "amendment", "outcome")


def change_classify(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("source_url"), F.md5(F.col("html").cast("binary")).alias("text_hash"))
    old = p.where("page_id % 3 != 0").select("source_url", F.expr("CASE WHEN page_id % 5 = 0 THEN 'old' ELSE text_hash END").alias("text_hash")).groupBy("source_url").agg(F.max("text_hash").alias("text_hash"))
    return D.classify_changes(p, old).select("page_id", "change")


def validation_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    text = F.when(F.col("page_id") % 11 != 0, F.concat(F.when(F.col("page_id") % 4 == 1, F.lit("R94 ")).otherwise(F.lit("")), F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", r"(?s)<[^>]*>|[a-z]", "")).otherwise(F.col("html"))))
    return p.select("page_id", D.validate(text, F.octet_length("html"), (F.col("page_id") % 8).cast("int"), F.lit("UN_R94")).alias("outcome"))


def allowlist(spark: SparkSession, d: str) -> DataFrame:
    domains = spark.createDataFrame([("example.org",), ("example.net",)], "domain string")
    return D.allowed_url(table(spark, d, "pages").select("page_id", "url"), domains).select("page_id", "host", "allowed")


def remote_changed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")

    def side(k: int) -> dict:
        return {
            "etag": F.when(F.col("event_id") % 3 != k, F.concat(F.lit('"' * k), (F.col("user_id") % 2 * k).cast("string"), F.lit('"' * k))),
            "last_modified": F.when(F.col("event_id") % 4 > 0, F.to_date("ts").cast("string")),
            "content_length": F.when(F.col("event_id") % 5 > k, (F.col("user_id") % (2 + k)).cast("long")),
        }

    return e.select("event_id", D.remote_changed(side(0), side(1)).alias("changed"))


#: File names of all kinds; the numbers of an order stand for the braces.
NAMES = ["UN_R{a}_{b}Series.pdf", "UN_R{a}_{b}Series_Amend{c}.pdf", "UN_R{a}_TB_{c}.pdf", "R0{a}r{c}am{b}e.pdf", "UN_R{a}_{b}Series_Supp{c}.PDF", "UN_R{a}_Rev{b}_Corr{c}.pdf", "FMVSS_{a}_2024.pdf", "EuroNCAP_AOP_20{a}.pdf", "EuroNCAP_FarSide_2026.pdf", "EU_2019_2144_v{c}.pdf", "iihs_SmallOverlap.pdf", "NHTSA_NCAP_Pole_{c}.pdf", "notes.v{c}.txt", "UN_R14_Amend{c}_Corr{b}.pdf", "EuroNCAP_TB_THOR_{c}.pdf", "CNCAP_{a}.pdf"]
_NAME = "CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN '" + n.replace("{a}", "' || (o_custkey % 90 + 10) || '").replace("{b}", "' || (o_orderkey % 8 + 1) || '").replace("{c}", "' || (o_custkey % 5 + 1) || '") + "'" for i, n in enumerate(NAMES)) + " END"


def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_NAME).alias("name"))
    return rows.select("o_orderkey", *[c.alias(k) for k, c in D.parse_filename(F.col("name")).items()])


_DATED = """CASE o_orderkey % 9 WHEN 0 THEN cast(cast(o_orderdate AS date) AS string) WHEN 1 THEN 'entered on ' || (o_orderkey % 28 + 1) || '.' || (o_custkey % 12 + 1) || '.' || (1990 + o_custkey % 40) WHEN 2 THEN (o_orderkey % 31 + 1) || ' June ' || (1990 + o_custkey % 40)
    WHEN 3 THEN 'Geneva, July ' || (o_orderkey % 28 + 1) || ', 2019' WHEN 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'edition ' ELSE ' ' END || (1990 + o_custkey % 40) WHEN 5 THEN (o_orderkey % 28 + 1) || ' Frobuary 2020' WHEN 6 THEN 'no date' WHEN 7 THEN '2023-' || (10 + o_custkey % 9) || '-' || (10 + o_orderkey % 25) ELSE CASE WHEN o_custkey % 3 > 0 THEN (o_orderkey % 28 + 1) || '.' || (o_custkey % 12 + 1) || '.2021, at noon' END END"""


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Dates as documents write them, made from orders: days that don't exist, months that no one knows and no dates at all among them."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_DATED).alias("raw"))
    return rows.select("o_orderkey", T.any_date(F.col("raw")).cast("string").alias("parsed"))


def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as sections of a regulation per part."""
    role = F.expr("CASE l_linenumber % 4 WHEN 1 THEN 'base' WHEN 2 THEN 'amendment' WHEN 3 THEN 'supplement' ELSE 'bulletin' END")
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_suppkey", "l_returnflag", "l_extendedprice")])
    rows = lines.select(F.col("l_partkey").alias("code"), F.expr("concat(lpad(cast(l_orderkey AS string), 8, '0'), '-', l_linenumber)").alias("document"), role.alias("role"), F.expr("l_suppkey % 7 * 1000 + l_linenumber").alias("version"), (F.col("l_orderkey") % 3).cast("string").alias("section"), F.col("l_returnflag").alias("title"), F.col("l_extendedprice").cast("int").cast("string").alias("text"))
    return D.consolidate(rows)


def supersedes_chain(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").cast("string").alias("series"), F.col("o_orderkey").alias("document"))
    return D.supersedes(o).where("supersedes is not null").select("document", "supersedes")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every nation is expected once per market segment; customers are what is present."""
    nations, regions, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    segments = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), ("SPACESHIPS",)], "segment string")
    code = F.concat_ws("-", "n_name", "segment")
    expected = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(segments)).select(F.col("r_name").alias("authority"), code.alias("code"))
    present = c.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("-", "n_name", "c_mktsegment").alias("code"), F.when(F.col("c_acctbal") > 5000, "ACTIVE").otherwise("SUPERSEDED").alias("status"))
    return D.coverage(expected, present)


def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(F.array(F.lit("key"), F.lit("na|me")), F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit("extra")), F.array(F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", D.pipe_table(cells).alias("markdown"))


def block_structure(spark: SparkSession, d: str) -> DataFrame:
    return structure.blocks(structure.synthetic_pages(_lines(spark, d)), table(spark, d, "lineitem").count())


def struct_chunks(spark: SparkSession, d: str) -> DataFrame:
    return structure.structured_chunks(structure.synthetic_pages(_lines(spark, d)), table(spark, d, "lineitem").count())


def mock_embed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", structure.mock_embedding(F.col("text")).alias("embedding"))


QUERIES = {f.__name__: f for f in (flat_chunks, oversize_split, clause_split, md_sections, table_islands, content_hash, dup_groups, incremental_plan, header_roundtrip, version_register, change_classify, validation_gate, allowlist, remote_changed, filename_parse, date_parse, consolidate, supersedes_chain, coverage, pipe_tables, block_structure, struct_chunks, mock_embed)}

_HASH = r"sha256(trim(regexp_replace(lower(nfc_normalize({t})), '\s+', ' ', 'g')))"
_VALUES = "(VALUES {})"



def _filename_sql() -> str:
    def has(mark: str) -> str:
        return f"regexp_matches(s, '{mark}')"

    def number(patterns: list[str]) -> str:
        return "coalesce(" + ", ".join(f"nullif(regexp_extract(s, '{p}', 1), '')" for p in patterns) + ")"

    role = "CASE " + " ".join(f"WHEN {has(m)} THEN '{r}'" for r, m in D.ROLE_MARKS) + " ELSE 'base' END"
    members = [(m, "CASE " + " ".join(f"WHEN {has(x)} THEN '{n}'" for x, n in inner) + f" ELSE '{own}' END" if inner else f"'{own}'") for m, inner, own in D.FILE_FAMILIES]
    code = f"CASE WHEN {number(D.UN_NUMBER)} IS NOT NULL THEN 'UN_R' || {number(D.UN_NUMBER)} WHEN {has('fmvss_[0-9]')} THEN 'FMVSS ' || regexp_extract(s, 'fmvss_([0-9]+)', 1) WHEN {has('fmvss')} THEN 'FMVSS' "
    code += " ".join(f"WHEN {has(m)} THEN {n}" for m, n in members) + " ELSE 'UNKNOWN' END"
    numbers = ", ".join(f"CAST({number(v)} AS INT) AS {k}" for k, v in D.FILE_NUMBERS.items())
    return f"WITH n AS (SELECT o_orderkey, regexp_replace(lower({_NAME}), '\\.[^.]*$', '') AS s FROM orders) SELECT o_orderkey, {role} AS role, {role} = 'base' AS complete, {code} AS code, {numbers} FROM n"


SQL = {
    "block_structure": structure_sql.BLOCKS,
    "struct_chunks": structure_sql.CHUNKS,
    "flat_chunks": "SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(substr(text, CAST(i * 800 + 1 AS BIGINT), 1000)) AS chunk_md5 FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i) WHERE length(text) > 0",
    "oversize_split": "SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(substr(text, CAST(i * 1600 + 1 AS BIGINT), 1800)) AS chunk_md5 FROM documents, LATERAL (SELECT unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 1800) / 1600.0) AS BIGINT)))) AS i) WHERE length(text) > 0",
    "clause_split": """
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_linenumber % 3 = 1 AS opens, '5.' || (l_orderkey % 9) || '.' || l_linenumber AS number,
  CASE l_linenumber % 3 WHEN 1 THEN 'limit ' || CAST(l_quantity AS INT) || ' mm' ELSE 'text ' || l_returnflag END AS part FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)),
b AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT doc_id, block, max(CASE WHEN opens THEN number END) AS clause, count(*) AS n_lines, string_agg(part, ' ' ORDER BY line_no) AS body FROM b GROUP BY doc_id, block""",
    "md_sections": """
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, o_orderkey % 3 = 0 AS opens,
  CASE o_orderkey % 4 WHEN 0 THEN 'Annex ' || (o_orderkey % 5) WHEN 1 THEN (o_orderkey % 4) || '.' || (o_orderkey % 3) ELSE 'General' END AS number,
  CASE o_orderkey % 4 WHEN 0 THEN 'Tests' WHEN 1 THEN 'Scope' ELSE 'Foreword' END AS title, 'line ' || o_orderpriority AS line FROM orders),
n AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS nth FROM l),
p AS (SELECT doc_id, nth, CASE WHEN nth = 0 THEN 'General' ELSE max(number) FILTER (opens) END AS section, CASE WHEN nth = 0 THEN 'General Context' ELSE max(title) FILTER (opens) END AS title,
  string_agg(CASE WHEN NOT opens THEN line END, chr(10) ORDER BY line_no) AS text FROM n GROUP BY doc_id, nth)
SELECT doc_id, section, arg_min(title, nth) AS title, md5(string_agg(text, chr(10) || chr(10) ORDER BY nth)) AS text_md5 FROM p WHERE text IS NOT NULL GROUP BY doc_id, section""",
    "table_islands": """
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, NOT ((l_orderkey + l_linenumber) % 4 = 0 OR l_quantity > 40) AS pipe,
  l_returnflag || ', ' || l_linestatus || ', ' || CAST(l_quantity AS INT) || ', x' AS summary FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)),
i AS (SELECT *, line_no - sum(CAST(pipe AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM l),
t AS (SELECT doc_id, island, min(line_no) AS first_line, count(*) AS n_rows, arg_min(summary, line_no) AS summary FROM i WHERE pipe GROUP BY doc_id, island HAVING count(*) >= 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS table_no, first_line, n_rows, summary FROM t""",
    "content_hash": f"SELECT doc_id, {_HASH.format(t='text')} AS content_hash FROM documents",
    "dup_groups": f"SELECT {_HASH.format(t='text')} AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "incremental_plan": f"""
WITH h AS (SELECT doc_id, source, {_HASH.format(t='text')} AS h FROM documents), s AS (SELECT DISTINCT h FROM h WHERE doc_id % 2 = 0)
SELECT source, count(*) AS total, count(s.h) AS reused, count(*) - count(s.h) AS new FROM h LEFT JOIN s ON s.h = h.h GROUP BY source""",
    "header_roundtrip": r"""
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN substr(md5(substr(text, 1, 200)), 1, 12) ELSE 'UN_R' || (doc_id % 150) || '|doc' || doc_id || '|5.2.1|' || CASE WHEN doc_id % 2 = 0 THEN 'clause' ELSE 'table' END || '|p' || (doc_id % 12) || '|'
  || substr(md5(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 400)), 1, 10) END AS fingerprint FROM documents""",
    "version_register": """
WITH o AS (SELECT o_orderkey, o_custkey % 300 AS code, nullif(o_orderpriority, '5-LOW') AS amendment, o_orderstatus AS h FROM orders),
a AS (SELECT code, amendment, arg_max(h, o_orderkey) AS h FROM o WHERE o_orderkey % 2 = 0 GROUP BY code, amendment)
SELECT o.o_orderkey, o.code, o.amendment, CASE WHEN a.h IS NULL THEN 'NEW' WHEN a.h = o.h THEN 'NO_CHANGE' ELSE 'SUPERSEDED_UPDATED' END AS outcome
FROM o LEFT JOIN a ON a.code = o.code AND a.amendment IS NOT DISTINCT FROM o.amendment WHERE o_orderkey % 2 = 1""",
    "change_classify": """
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, md5(html) AS h FROM pages),
m AS (SELECT u, max(CASE WHEN page_id % 5 = 0 THEN 'old' ELSE h END) AS h FROM p WHERE page_id % 3 <> 0 GROUP BY u)
SELECT page_id, CASE WHEN m.h IS NULL THEN 'NEW' WHEN m.h = p.h THEN 'DUPLICATE' ELSE 'CHANGED' END AS change FROM p LEFT JOIN m ON m.u = p.u""",
    "validation_gate": r"""
WITH p AS (SELECT page_id, strlen(html) AS n, page_id % 8 AS pages, CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 4 = 1 THEN 'R94 ' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<[^>]*>|[a-z]', '', 'gs') ELSE html END END AS t FROM pages),
q AS (SELECT *, length(regexp_replace(t, '\s', '', 'g')) AS ink FROM p)
SELECT page_id, CASE WHEN t IS NULL THEN 'REJECTED: unreadable' WHEN n < 2048 THEN 'REJECTED: too small' WHEN n > 83886080 THEN 'REJECTED: too large' WHEN pages < 1 THEN 'REJECTED: no pages'
  WHEN ink < 50 THEN 'REJECTED: no text' WHEN ink::DOUBLE / pages < 80 THEN 'NEEDS_OCR: thin text'
  WHEN NOT regexp_matches(upper(t), '\b(?:UN[ _]?)?R[ _]?0*94\b|\bREGULATION NO\.? ?0*94\b') THEN 'REJECTED: regulation not named' ELSE 'ACCEPTED' END AS outcome FROM q""",
    "allowlist": """
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, host, starts_with(url, 'https:') AND (host IN ('example.org', 'example.net') OR ends_with(host, '.example.org') OR ends_with(host, '.example.net')) AS allowed FROM p""",
    "remote_changed": """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 <> user_id % 2
  WHEN event_id % 4 > 0 THEN false WHEN event_id % 5 > 1 THEN user_id % 2 <> user_id % 3 ELSE true END AS changed FROM events""",
    "filename_parse": _filename_sql(),
    "date_parse": """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN printf('%d-06-%02d', 1990 + o_custkey % 40, o_orderkey % 31 + 1) WHEN 3 THEN printf('2019-07-%02d', o_orderkey % 28 + 1)
  WHEN 4 THEN CASE WHEN o_custkey % 2 = 1 THEN (1990 + o_custkey % 40) || '-01-01' END WHEN 5 THEN printf('2020-01-%02d', o_orderkey % 28 + 1) WHEN 7 THEN '2023-' || (10 + o_custkey % 9) || '-' || (10 + o_orderkey % 25)
  WHEN 8 THEN CASE WHEN o_custkey % 3 > 0 THEN printf('2021-%02d-%02d', o_custkey % 12 + 1, o_orderkey % 28 + 1) END END AS iso FROM orders)
SELECT o_orderkey, CAST(TRY_CAST(iso AS DATE) AS VARCHAR) AS parsed FROM r""",
    "consolidate": """
WITH s AS (SELECT l_partkey AS code, lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '-' || l_linenumber AS document, CASE l_linenumber % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 4 END AS p,
  l_suppkey % 7 * 1000 + l_linenumber AS v, CAST(l_orderkey % 3 AS VARCHAR) AS section, l_returnflag AS title, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) AS text FROM (SELECT l_partkey, l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)),
o AS (SELECT *, row_number() OVER (PARTITION BY code, section ORDER BY p, v, document) AS n FROM s),
b AS (SELECT *, max(CASE WHEN p = 0 THEN n END) OVER (PARTITION BY code, section) AS last_base FROM o)
SELECT code, section, arg_min(title, n) AS title, arg_max(text, n) AS text, string_agg(document, ' > ' ORDER BY n) AS provenance FROM b WHERE last_base IS NULL OR n >= last_base GROUP BY code, section""",
    "supersedes_chain": "SELECT * FROM (SELECT o_orderkey AS document, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS supersedes FROM orders) WHERE supersedes IS NOT NULL",
    "coverage": """
WITH e AS (SELECT r_name AS authority, n_name || '-' || seg AS code FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('AUTOMOBILE'), ('BUILDING'), ('SPACESHIPS')) AS s(seg)),
h AS (SELECT n_name || '-' || c_mktsegment AS code, max(CAST(c_acctbal > 5000 AS INT)) AS active FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT authority, count(*) AS expected, count(active) AS found, CAST(coalesce(sum(active), 0) AS BIGINT) AS active, round(count(active)::DOUBLE / count(*), 3) AS coverage,
  round(coalesce(sum(active), 0)::DOUBLE / count(*), 3) AS active_rate, coalesce(string_agg(CASE WHEN active IS NULL THEN code END, ',' ORDER BY code), '') AS missing
FROM (SELECT e.*, h.active FROM e LEFT JOIN h USING (code)) GROUP BY authority""",
    "pipe_tables": r"SELECT n_nationkey, '| key | na\|me |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) || '| ' || n_regionkey || ' |  |' AS markdown FROM nation",
}
