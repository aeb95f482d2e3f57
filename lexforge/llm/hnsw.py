"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Distinct vectors are dealt to shards of bounded size by hash. A shard's graph is a row of a table: its
vectors and, for every level, a flat array of neighbour places (-1: none). As a shard is small, the
neighbours of a level come from blocked matrix products, are thinned to diverse ones (a candidate that
is nearer to a kept neighbour than to the node is put last), and get reverse links. Queries come in
blocks; every block visits every shard, descends the levels with a beam, and the best of all shards win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import materialize

#: Vectors of a shard on average, queries of a block.
SHARD_ROWS, QUERY_ROWS = 8192, 2048
#: Neighbours of a node (twice as many on the ground level), candidates they are chosen from, beams while descending and on the ground.
LINKS, CANDIDATES, BEAM_ABOVE, BEAM = 16, 48, 24, 96
SEED = 11
NEAREST = 5
EXPAND = 4


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def link_level(u: np.ndarray, links: int) -> np.ndarray:
    """int32 [n, 2 * links]: diverse near neighbours of each row of u, then reverse links, -1 beyond."""
    n, c = len(u), min(CANDIDATES, len(u) - 1)
    out = np.full((n, 2 * links), -1, np.int32)
    if c < 1:
        return out
    sims = np.empty((n, min(links, c)), np.float32)
    for a in range(0, n, 256):
        s = u[a : a + 256] @ u.T
        rows = np.arange(len(s))
        s[rows, a + rows] = -np.inf
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        own = np.take_along_axis(s, near, 1)
        between = u[near] @ u[near].transpose(0, 2, 1)
        kept = np.zeros(near.shape, bool)
        for j in range(c):
            kept[:, j] = ~((between[:, :j, j] > own[:, j, None]) & kept[:, :j]).any(1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : min(links, c)]
        out[a : a + 256, : order.shape[1]] = np.take_along_axis(near, order, 1)
        sims[a : a + 256] = np.take_along_axis(own, order, 1)
    # reverse links, the nearest first, fill what is free
    m = sims.shape[1]
    src, dst, sim = np.repeat(np.arange(n), m), out[:, :m].ravel(), sims.ravel()
    order = np.lexsort((src, -sim, dst))
    src, dst = src[order], dst[order]
    nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
    free = nth < 2 * links - m
    out[dst[free], m + nth[free]] = src[free]
    return out


def build(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the ground up: (places of the level's vectors, neighbours as places within the level)."""
    u, rng = unit(vectors), np.random.default_rng(SEED)
    height = np.floor(-np.log(1 - rng.random(len(u))) / math.log(LINKS)).astype(int)
    levels, level = [], 0
    while True:
        members = np.flatnonzero(height >= level).astype(np.int32)
        if level and len(members) < 2:
            break
        levels.append((members, link_level(u[members], LINKS * (2 if level == 0 else 1))))
        level += 1
    return levels


def beam(u: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Places [len(q), width] of the best found from start [len(q), k], -1 where fewer; all queries move together."""
    n, m = len(u), len(q)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    start = np.where(start < 0, n, start)
    seen[rows, start] = True
    best = np.full((m, width), n, np.int64)
    sim = np.full((m, width), -np.inf, np.float32)
    k = min(width, start.shape[1])
    s = np.where(start == n, -np.inf, np.einsum("mkd,md->mk", u[np.minimum(start, n - 1)], q))
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    best[:, :k], sim[:, :k] = np.take_along_axis(start, order, 1), np.take_along_axis(s, order, 1)
    done = best == n
    while not done.all():
        pick = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]  # the best that are still closed
        chosen = np.take_along_axis(best, pick, 1)
        chosen[np.take_along_axis(done, pick, 1)] = n
        np.put_along_axis(done, pick, True, 1)
        next_ = np.where(chosen[:, :, None] == n, -1, links[np.minimum(chosen, n - 1)]).reshape(m, -1)
        next_[next_ < 0] = n
        next_[seen[rows, next_]] = n
        next_.sort(axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n  # reached twice at once
        seen[rows, next_] = True
        s = np.where(next_ == n, -np.inf, np.einsum("mkd,md->mk", u[np.minimum(next_, n - 1)], q)).astype(np.float32)
        places, sims, closed = np.hstack([best, next_]), np.hstack([sim, s]), np.hstack([done, next_ == n])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        best, sim, done = (np.take_along_axis(x, order, 1) for x in (places, sims, closed))
        done |= best == n
    return np.where(best == n, -1, best)


def search(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places [len(queries), k] and their exact cosines in double precision, best first; -1 and nan beyond."""
    u, q = unit(vectors), unit(queries)
    top = levels[-1][0]
    at = np.tile(top[: min(len(top), BEAM_ABOVE)], (len(q), 1)).astype(np.int64)
    for level in range(len(levels) - 1, -1, -1):
        members, links = levels[level]
        inside = np.full(len(u) + 1, -1, np.int64)
        inside[members] = np.arange(len(members))
        found = beam(u[members], links, q, inside[at], BEAM if level == 0 else BEAM_ABOVE)
        at = np.where(found < 0, -1, members[found])
    v, w = vectors[np.maximum(at, 0)], queries / 1.0
    score = np.einsum("mkd,md->mk", v, w) / (np.sqrt(np.einsum("mkd,mkd->mk", v, v)) * np.sqrt(np.einsum("md,md->m", w, w))[:, None])
    score[at < 0] = -np.inf
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
    return np.where(np.isneginf(score), -1, at), np.where(np.isneginf(score), np.nan, score)


# ---------------------------------------------------------------- Spark


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>, dim): rows with an id and a finite vector that isn't zero."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("dim", F.size("v")).dropDuplicates(["id", "v"])


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, dim, node, ids): one row per distinct vector with its keep smallest ids; more can't be among the results.

    The row number is bounded, so Spark keeps the first few of a vector before the shuffle.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    return few.groupBy("v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("node", F.element_at("ids", 1))


def index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, nodes, vectors, members, links): a graph per shard as flat little-endian arrays, levels from the ground up."""
    sizes = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    many = F.lit(1)
    for dim, n in sizes.items():
        many = F.when(F.col("dim") == dim, F.lit(max(1, math.ceil(n / shard_rows)))).otherwise(many)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), many).cast("int")).select("dim", "shard", "node", "v")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = np.array(table.column("v").to_pylist(), np.float64)
        levels = build(x)
        return pa.table(
            {
                "dim": [key[0].as_py()],
                "shard": [key[1].as_py()],
                "nodes": [table.column("node").to_numpy().astype("<i8").tobytes()],
                "vectors": [x.tobytes()],
                "members": [[m.tobytes() for m, _ in levels]],
                "links": [[link.tobytes() for _, link in levels]],
            },
            schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("nodes", pa.binary()), ("vectors", pa.binary()), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]),
        )

    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, nodes binary, vectors binary, members array<binary>, links array<binary>")


def query_blocks(queries: DataFrame) -> DataFrame:
    """(dim, ids binary, queries binary): blocks of queries of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, list[int]] = {}
            for i, d in enumerate(batch.column(2).to_pylist()):
                rows.setdefault(d, []).append(i)
            for dim, own in rows.items():
                for a in range(0, len(own), QUERY_ROWS):
                    part = batch.take(pa.array(own[a : a + QUERY_ROWS]))
                    x = np.array(part.column(1).to_pylist(), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "ids", "queries"])

    return queries.select("id", "v", "dim").mapInArrow(run, "dim int, ids binary, queries binary")


def nearest(blocks: DataFrame, graphs: DataFrame, k: int) -> DataFrame:
    """(query_id, node, score) of the k + 1 best vectors of every shard (one of them may be the query's own): each block meets each shard of its dimension."""
    pairs = blocks.join(graphs.select("dim", "shard"), "dim").join(graphs, ["dim", "shard"]).select("dim", "ids", "queries", "nodes", "vectors", "members", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, q, own, x, members, links = (c[row].as_py() for c in batch.columns)
                ids, own = np.frombuffer(ids, "<i8"), np.frombuffer(own, "<i8")
                x, q = np.frombuffer(x).reshape(-1, dim), np.frombuffer(q).reshape(-1, dim)
                levels = [(np.frombuffer(m, np.int32), np.frombuffer(n, np.int32).reshape(len(m) // 4, -1)) for m, n in zip(members, links, strict=True)]
                for a in range(0, len(q), 256):
                    at, score = search(x, levels, q[a : a + 256], k + 1)
                    there = at >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + 256], there.sum(1))), pa.array(own[at[there]]), pa.array(score[there])], ["query_id", "node", "score"])

    return pairs.mapInArrow(run, "query_id long, node long, score double")


def search_all(rows: DataFrame, is_query, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, all other rows being candidates.

    Equal vectors are one node of the graph, so thousands of copies don't crowd out other neighbours.
    Ties go to the smaller id. Nulls: a row without an id, and a vector that is null, zero, empty or
    holds null, NaN or infinite components, takes no part. Vectors are held only against those of their
    own length. Rows that repeat id and vector count once. Other columns are not read; an empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    fine = usable(rows, key, vector)
    nodes = materialize(distinct_vectors(fine, k + 1), "hnsw-nodes")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    graphs = materialize(index(nodes), "hnsw-graphs")
    queries = fine.where(is_query(F.col("id")))
    blocks = materialize(query_blocks(queries), "hnsw-queries")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a row holds a graph of some megabytes
    try:
        found = materialize(nearest(blocks, graphs, k), "hnsw-found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = found.join(nodes.select("node", F.explode("ids").alias("vec_id")), "node").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_all(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
