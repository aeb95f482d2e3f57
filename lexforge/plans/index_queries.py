"""Queries of the index: embedding of misses, rechunking, replaced documents and gated ingest, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import documents as D
from lexforge.operators import embedding as E
from lexforge.plans import document_queries
from lexforge.sources.chunk_index import BUCKETS, ChunkIndex
from lexforge.sources.shared import shared_folder
from lexforge.sources.tables import table
from lexforge.streaming import gates

MODEL = E.LetterModel()
#: Documents of a bucket of the chunk index, about.
BUCKET_DOCS = 8192


def embed_misses(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored for even documents: by source, how many texts use one again, how many are new, and a mark of all vectors."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("chunk_text"))
    none = spark.createDataFrame([], "content_hash string, embedding array<float>")
    stored = E.embed_incremental(docs.where("doc_id % 2 = 0"), none, MODEL)
    out = E.embed_incremental(docs, stored, MODEL).withColumn("mark", E.vector_mark(F.col("embedding")))
    return E.embed_stats(out, "source").join(out.groupBy("source").agg(F.sum("mark").alias("mark")), "source")


def force_rechunk(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut anew; the index has the chunks of those that 3 divides. Every seventh can't be read."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    first = D.flat_chunks(docs.where("doc_id % 3 = 0 AND text IS NOT NULL"))
    index = first.select(T.content_hash(F.col("chunk_text")).alias("content_hash"), F.array_repeat(F.lit(1.0), MODEL.dimension).alias("embedding"))
    return E.rechunk_all(docs, D.flat_chunks, index, MODEL)[1]


def _replaced(spark: SparkSession, d: str) -> ChunkIndex:
    """An index of all documents' flat chunks, then shorter chunks for every fifth document, then every eleventh removed."""
    docs = table(spark, d, "documents")
    # a bucket is a task of every write, so there are more of them for more documents
    index = ChunkIndex(spark, shared_folder(spark, "chunk-index"), max(BUCKETS, docs.count() // BUCKET_DOCS))

    def chunks(rows: DataFrame, size: int) -> DataFrame:
        c = D.flat_chunks(rows, size, 100)
        parent = F.when(F.col("chunk_index") > 0, F.col("chunk_index") - 1)
        return c.select(F.col("doc_id").alias("document_id"), "chunk_index", parent.alias("parent_index"), "chunk_text")

    index.replace(chunks(docs, 1000))
    index.replace(chunks(docs.where("doc_id % 5 = 0"), 700))
    index.delete(docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("document_id")))
    return index


def replace_documents(spark: SparkSession, d: str) -> DataFrame:
    """What each document of the index has after all that."""
    rows = _replaced(spark, d).read()
    return rows.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.count("parent_id").alias("with_parent"), F.sum(F.char_length("chunk_text")).alias("n_chars"))


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each regulation in the index, with and without a parent; documents play forty regulations."""
    code = F.concat(F.lit("UN_R"), (F.col("document_id") % 40).cast("string"))
    return _replaced(spark, d).read().groupBy(code.alias("code")).agg(F.count("*").alias("chunks"), F.count("parent_id").alias("with_parent"), F.count_if(F.col("parent_id").isNull()).alias("without_parent"))


_PAGES = "page_id long, url string, html string"


def _items(pages: DataFrame) -> DataFrame:
    """Pages as files of a crawl: seven in eight begin as they should, every eleventh can't be read."""
    i = F.col("page_id")
    named = F.concat(F.when(i % 4 == 1, F.lit("UN R94 ")).when(i % 4 == 2, F.lit("Regulation No. 94 ")).otherwise(F.lit("")), F.coalesce("html", F.lit("")))
    text = F.when(i % 11 != 0, F.when(i % 13 == 0, F.substring(named, 1, 40)).otherwise(named))
    head = F.when(i % 8 == 0, F.lit("<html>")).when(i % 9 == 0, F.lit("%PDF-1.7 placeholder")).otherwise(F.lit("%PDF-1.7"))
    url = F.regexp_replace("url", r"[?#].*$", "")
    return pages.select(i.alias("item_id"), url.alias("source_url"), text.alias("text"), F.octet_length("html").cast("long").alias("n_bytes"), (i % 30).cast("int").alias("pages"), F.lit("R94").alias("code"), head.alias("head"))


def _ingested(spark: SparkSession, d: str) -> str:
    """Two runs of the stream over all pages into one sink; where the second finds what the first took, it is a duplicate."""
    sink, domains = shared_folder(spark, "ingest"), spark.createDataFrame([("example.org",), ("example.net",)], "domain string")
    for run in ("run1", "run2"):
        # a pattern, since a stream takes a table of one file by no other name
        gates.ingest(spark, f"{d}/page[s].parquet", _PAGES, f"{sink}/tables", f"{sink}/checkpoint-{run}", run, domains, _items)
    return f"{sink}/tables"


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """What the log of both runs says of every stage, beside what the tables of accepted and refused items hold."""
    sink = _ingested(spark, d)
    log = gates.table(spark, sink, "log").groupBy("run", "stage", "outcome", "reason").agg(F.sum("items").alias("items"))
    kept = [gates.table(spark, sink, name).groupBy("run").agg(F.count("*").alias("items")).select("run", F.lit(name).alias("stage"), F.lit("rows").alias("outcome"), F.lit(None).cast("string").alias("reason"), "items") for name in ("accepted", "rejects")]
    return log.union(kept[0]).union(kept[1])


QUERIES = {f.__name__: f for f in (embed_misses, force_rechunk, replace_documents, index_counts, ingest_stream)}

_HASH = document_queries._HASH
_LETTERS = " + ".join(f"{i + 1} * (length(lower(text)) - length(replace(lower(text), '{c}', '')))" for i, c in enumerate(MODEL.letters))


def _flat(rows: str, size: int, overlap: int) -> str:
    """Flat windows of rows (doc_id, text): they begin every size - overlap characters."""
    return f"SELECT doc_id, i AS chunk_index, substr(text, i * {size - overlap} + 1, {size}) AS chunk_text FROM ({rows}), LATERAL (SELECT unnest(range((length(text) + {size - overlap - 1}) // {size - overlap})) AS i)"


SQL = {
    "embed_misses": f"""
WITH h AS (SELECT doc_id, source, {_HASH.format(t="text")} AS h, {_LETTERS} AS mark FROM documents), s AS (SELECT DISTINCT h FROM h WHERE doc_id % 2 = 0)
SELECT source, count(*) AS chunks_total, count(*) - count(s.h) AS embedded_new, count(s.h) AS reused, count(DISTINCT CASE WHEN s.h IS NULL THEN h.h END) AS model_calls, sum(mark)::BIGINT AS mark
FROM h LEFT JOIN s ON s.h = h.h GROUP BY source""",
    "force_rechunk": f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text FROM documents),
c AS (SELECT doc_id, {_HASH.format(t="chunk_text")} AS h FROM ({_flat("SELECT * FROM d WHERE text IS NOT NULL", 1000, 200)})),
s AS (SELECT DISTINCT h FROM c WHERE doc_id % 3 = 0), n AS (SELECT doc_id, count(*) AS n, count(s.h) AS old FROM c LEFT JOIN s USING (h) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 'skipped' ELSE 'success' END AS status, CASE WHEN text IS NULL THEN 'no text' END AS reason, coalesce(n, 0) AS chunks_total, coalesce(n - old, 0) AS embedded_new, coalesce(old, 0) AS reused
FROM d LEFT JOIN n USING (doc_id)""",
    "replace_documents": f"""
WITH c AS ({_flat("SELECT * FROM documents WHERE doc_id % 5 <> 0", 1000, 100)} UNION ALL {_flat("SELECT * FROM documents WHERE doc_id % 5 = 0", 700, 100)})
SELECT doc_id, count(*) AS chunks, count(*) FILTER (chunk_index > 0) AS with_parent, sum(length(chunk_text))::BIGINT AS n_chars FROM c WHERE doc_id % 11 <> 0 GROUP BY doc_id""",
    "index_counts": f"""
WITH c AS ({_flat("SELECT * FROM documents WHERE doc_id % 5 <> 0", 1000, 100)} UNION ALL {_flat("SELECT * FROM documents WHERE doc_id % 5 = 0", 700, 100)})
SELECT 'UN_R' || (doc_id % 40) AS code, count(*) AS chunks, count(*) FILTER (chunk_index > 0) AS with_parent, count(*) FILTER (chunk_index = 0) AS without_parent FROM c WHERE doc_id % 11 <> 0 GROUP BY ALL""",
    "ingest_stream": r"""
WITH p AS (SELECT page_id AS i, regexp_replace(url, '[?#].*$', '') AS u, coalesce(strlen(html), 0) AS n, html IS NULL AS nothing, page_id % 30 AS pages,
    CASE page_id % 4 WHEN 1 THEN 'UN R94 ' WHEN 2 THEN 'Regulation No. 94 ' ELSE '' END || coalesce(html, '') AS named FROM pages),
q AS (SELECT *, CASE WHEN i % 11 <> 0 THEN CASE WHEN i % 13 = 0 THEN substr(named, 1, 40) ELSE named END END AS t, lower(regexp_extract(u, '://([^/?#]*)', 1)) AS host FROM p),
g AS (SELECT *, length(regexp_replace(t, '\s', '', 'g')) AS ink, starts_with(lower(u), 'https:') AND (host IN ('example.org', 'example.net') OR ends_with(host, '.example.org') OR ends_with(host, '.example.net')) AS allowed FROM q),
v AS (SELECT *, CASE WHEN NOT coalesce(allowed, false) THEN 'domain not allowed' WHEN i % 8 = 0 THEN 'not %PDF-' WHEN i % 9 = 0 THEN 'placeholder' WHEN n < 2048 THEN 'too small' WHEN n > 83886080 THEN 'too large' WHEN t IS NULL THEN 'unreadable'
    WHEN pages < 1 THEN 'no pages' WHEN ink < 50 THEN 'no text' WHEN ink::DOUBLE / pages < 80 THEN 'thin text' WHEN NOT regexp_matches(upper(t), '\b(?:UN[ _]?)?R[ _]?0*94\b|\bREGULATION NO\.? ?0*94\b') THEN 'regulation not named' END AS reason,
    sha256(trim(regexp_replace(lower(nfc_normalize(t)), '\s+', ' ', 'g'))) AS h FROM g),
a AS (SELECT u, i, h, lag(h) OVER (PARTITION BY u ORDER BY i) AS old, last_value(h) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM v WHERE reason IS NULL),
b AS (SELECT 'run1' AS run, h, old FROM a UNION ALL SELECT 'run2', h, coalesce(old, final) FROM a),
t AS (SELECT run, CASE WHEN old IS NULL THEN 'new' WHEN old = h THEN 'duplicate' ELSE 'changed' END AS outcome FROM b),
r AS (SELECT unnest(['run1', 'run2']) AS run), refused AS (SELECT run, reason FROM v, r)
SELECT run, 'allowlist' AS stage, CASE WHEN reason = 'domain not allowed' THEN 'rejected' ELSE 'passed' END AS outcome, CASE WHEN reason = 'domain not allowed' THEN reason END AS reason, count(*) AS items FROM refused GROUP BY ALL
UNION ALL SELECT run, 'validate', CASE WHEN reason IS NULL THEN 'passed' WHEN reason = 'thin text' THEN 'needs_ocr' ELSE 'rejected' END, reason, count(*) FROM refused WHERE reason IS DISTINCT FROM 'domain not allowed' GROUP BY ALL
UNION ALL SELECT run, 'tracker', outcome, NULL, count(*) FROM t GROUP BY ALL
UNION ALL SELECT run, 'accepted', 'rows', NULL, count(*) FROM t WHERE outcome <> 'duplicate' GROUP BY ALL
UNION ALL SELECT run, 'rejects', 'rows', NULL, count(*) FROM refused WHERE reason IS NOT NULL GROUP BY ALL""",
}
