"""Named queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from lexforge.plans import document_queries, extraction_queries, index_queries, question_queries, record_queries, registry_queries, retrieval_queries, search_queries

QUERIES = {**retrieval_queries.QUERIES, **document_queries.QUERIES, **record_queries.QUERIES, **registry_queries.QUERIES, **index_queries.QUERIES, **search_queries.QUERIES, **extraction_queries.QUERIES, **question_queries.QUERIES}
ORACLE_SQL = {**retrieval_queries.SQL, **document_queries.SQL, **record_queries.SQL, **registry_queries.SQL, **index_queries.SQL, **search_queries.SQL, **extraction_queries.SQL, **question_queries.SQL}
