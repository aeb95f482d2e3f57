"""Embedding of chunks with a model of one's own: only texts without a stored vector reach the model, each distinct text once.

A model says its name and dimension and how to load itself; a worker loads it once and embeds batch after batch.
Vectors are stored by content hash, so unchanged texts of any document or version use theirs again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash

#: Texts a model gets at once.
BATCH = 64

Embed = Callable[[list[str]], np.ndarray]


class Model(Protocol):
    """What embed() needs. Models travel to the workers, so they hold parameters only; weights are read in load().

    They are hashable: a worker loads equal models once.
    """

    @property
    def name(self) -> str: ...

    @property
    def dimension(self) -> int: ...

    def load(self) -> Embed:
        """Set the model up, once a worker: a function from texts to [texts, dimension] finite numbers."""


@dataclass(frozen=True)
class SeededModel:
    """Deterministic unit vectors: SHA-256 of the text, modulo 2^32 - 1, seeds a normal generator. It knows no meaning."""

    dimension: int = 768
    name: str = "seeded"

    def load(self) -> Embed:
        def one(text: str) -> np.ndarray:
            seed = int.from_bytes(hashlib.sha256(text.encode()).digest(), "big") % (2**32 - 1)
            v = np.random.default_rng(seed).normal(0.0, 1.0, self.dimension)
            return v / np.linalg.norm(v)

        return lambda texts: np.stack([one(t) for t in texts])


@dataclass(frozen=True)
class LetterModel:
    """How often each of some letters occurs, in any case: a model that plain SQL can follow."""

    letters: str = "abcdefgh"
    name: str = "letters"

    @property
    def dimension(self) -> int:
        return len(self.letters)

    def load(self) -> Embed:
        return lambda texts: np.array([[t.lower().count(c) for c in self.letters] for t in texts], float)


_LOADED: dict[Model, Embed] = {}
#: Models that a worker keeps loaded.
MOST_LOADED = 2


def loaded(model: Model) -> Embed:
    if model not in _LOADED:
        while len(_LOADED) >= MOST_LOADED:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[model] = model.load()
    return _LOADED[model]


def embed(texts: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, embedding) of every row. A model that gives another shape, or what isn't a number, fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            own = loaded(model)  # where there is nothing to embed, nothing is loaded
            for at in range(0, big.num_rows, BATCH):
                part = big.slice(at, BATCH)
                vectors = np.asarray(own([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if vectors.shape != (part.num_rows, model.dimension) or not np.isfinite(vectors).all():
                    raise ValueError(f"model {model.name} gave {vectors.shape} for {part.num_rows} texts of dimension {model.dimension}, or values that are not finite")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>")


def reusable(stored: DataFrame, dimension: int) -> DataFrame:
    """(content_hash, embedding): one vector for each hash that has one of the right dimension; others are as good as none."""
    good = stored.where(F.col("content_hash").isNotNull() & (F.size("embedding") == dimension))
    return good.groupBy("content_hash").agg(F.min(F.col("embedding").cast("array<float>")).alias("embedding"))


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the embedding of their content_hash; a chunk without one fails the job, so no write leaves a gap."""
    have = vectors.select(F.col("content_hash").alias("_hash"), F.col("embedding").alias("_embedding"), F.col("reused").alias("_reused"))
    met = chunks.drop("embedding", "reused").join(have, F.col("content_hash") == F.col("_hash"), "left")
    gap = F.raise_error(F.concat(F.lit("no vector for content hash "), F.coalesce("content_hash", F.lit("null")))).cast("array<float>")
    return met.withColumn("embedding", F.coalesce(F.col("_embedding"), gap)).withColumn("reused", F.col("_reused")).drop("_hash", "_embedding", "_reused")


def embed_incremental(chunks: DataFrame, stored: DataFrame, model: Model, text: str = "chunk_text") -> DataFrame:
    """chunks with content_hash, embedding and reused: stored (content_hash, embedding) vectors are used again, only the others are embedded.

    Chunks with equal hashes go to the model once. The model runs on the misses of an anti-join, nothing else.
    Nulls: a null text is an empty one. Columns named like the results are replaced.
    """
    hashed = chunks.drop("content_hash", "embedding", "reused").withColumn("content_hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    known = reusable(stored, model.dimension)
    misses = hashed.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    fresh = embed(misses, model, "content_hash", "_text").withColumn("reused", F.lit(False))
    return with_vectors(hashed, known.withColumn("reused", F.lit(True)).unionByName(fresh))


def embed_stats(embedded: DataFrame, *by: str) -> DataFrame:
    """(chunks_total, embedded_new, reused, model_calls), by some columns or in all; model_calls counts distinct texts."""
    new = ~F.col("reused")
    return embedded.groupBy(*by).agg(F.count("*").alias("chunks_total"), F.count_if(new).alias("embedded_new"), F.count_if("reused").alias("reused"), F.count_distinct(F.when(new, F.col("content_hash"))).alias("model_calls"))


def rechunk_all(documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], index: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Cut every document anew, whatever its checksum says, and embed what changed: (new index rows, report).

    documents: doc_id, text; a null text is a file that can't be read: its document is skipped and keeps its index rows.
    chunker gives doc_id, chunk_index, chunk_text. The report has doc_id, status (success or skipped), reason, chunks_total, embedded_new, reused.
    """
    readable = documents.where("text is not null")
    chunks = embed_incremental(chunker(readable), index.select("content_hash", "embedding"), model)
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("reused")).alias("new"), F.count_if("reused").alias("old"))
    skipped = F.col("text").isNull()
    report = documents.select("doc_id", "text").join(counts, "doc_id", "left").select(
        "doc_id", F.when(skipped, "skipped").otherwise("success").alias("status"), F.when(skipped, "no text").alias("reason"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name) for c, name in (("n", "chunks_total"), ("new", "embedded_new"), ("old", "reused"))],
    )
    return chunks, report


def vector_mark(embedding: Column) -> Column:
    """A number that tells vectors of small whole numbers apart: each value times its place."""
    return F.aggregate(F.transform(embedding, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
