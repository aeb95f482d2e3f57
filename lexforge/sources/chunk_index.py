"""The chunk index as a table in hash buckets of documents: a document's chunks are replaced by writing its bucket anew.

A write reads only the buckets that its documents fall into, drops those documents' rows, adds the new ones and puts new folders
in these buckets' places; files of other buckets are not touched. The new buckets are written beside the table first, so a job that dies
half way leaves the table as it was, and one that dies while buckets are put in place can be run again with the same result. Every step
of a write is dealt by bucket, so texts are shuffled and written once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.sources.shared import exists, move, remove, shared_folder

#: Buckets of a new table. A bucket is what one replaced document costs, so large tables want thousands.
BUCKETS = 64


def chunk_id(document: Column, index: Column) -> Column:
    """The same id for the same place in a document, whoever writes it."""
    return F.xxhash64(document.cast("string"), index.cast("long"))


@dataclass
class ChunkIndex:
    """A table of chunks (document_id, chunk_index, parent_index and any others), with chunk_id and parent_id."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def chunks_of(self, documents: list) -> DataFrame:
        """The chunks of a few documents: only the folders of their buckets are read."""
        asked = self.spark.createDataFrame([(str(i),) for i in documents], "document_id string")
        some = sorted({r[0] for r in asked.select(self._bucket()).collect()})
        return self.read().where(F.col("bucket").isin(some) & F.col("document_id").cast("string").isin([str(i) for i in documents]))

    def replace(self, chunks: DataFrame) -> None:
        """Chunks of documents take the place of all that these documents had.

        parent_id is the chunk_id of the chunk that parent_index names in the same document, null where there is none.
        Of rows with one document_id and chunk_index one is kept, that with the smallest values. Rows without a document_id or index are left out.
        """
        rows = chunks.drop("bucket", "chunk_id", "parent_id").where("document_id is not null and chunk_index is not null").withColumn("bucket", self._bucket())
        key = ["bucket", "document_id", "chunk_index"]
        others = [c for c in rows.columns if c not in key]
        there = rows.select(F.col("bucket").alias("_bucket"), F.col("document_id").alias("_document"), F.col("chunk_index").alias("_index")).distinct().repartition("_bucket")
        rows = rows.repartition("bucket").groupBy(*key).agg(F.min(F.struct(*others)).alias("r")).select(*key, "r.*")
        met = rows.join(there, (F.col("bucket") == F.col("_bucket")) & (F.col("document_id") == F.col("_document")) & (F.col("parent_index") == F.col("_index")), "left")
        rows = met.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index"))).withColumn("parent_id", F.when(F.col("_index").isNotNull(), chunk_id(F.col("document_id"), F.col("_index"))))
        rows = rows.drop("_bucket", "_document", "_index")
        if not self.exists():
            self._store(rows, None)
            return
        incoming = shared_folder(self.spark, "index-incoming")  # whatever makes the chunks runs once
        rows.write.option("compression", "zstd").parquet(incoming)
        rows = self.spark.read.schema(rows.schema).parquet(incoming)
        self._put(rows, rows.select("document_id").distinct())
        remove(self.spark, incoming)

    def delete(self, documents: DataFrame) -> int:
        """Chunks of these documents go; how many there were. A second time there are none."""
        gone = documents.select("document_id").distinct()
        if not self.exists():
            return 0
        n = self._touched(gone).join(gone, "document_id", "left_semi").count()
        if n:
            self._put(None, gone)
        return n

    def _touched(self, documents: DataFrame) -> DataFrame:
        """Rows of the buckets that documents fall into; their number is at most that of the buckets."""
        some = [r[0] for r in documents.select(self._bucket()).distinct().collect()]
        return self.read().where(F.col("bucket").isin(some))

    def _put(self, rows: DataFrame | None, documents: DataFrame) -> None:
        left = self._touched(documents).withColumn("_new", F.lit(False))
        every = left if rows is None else left.unionByName(rows.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        gone = documents.select(self._bucket().alias("bucket"), "document_id", F.lit(True).alias("_gone")).repartition("bucket")
        kept = every.repartition("bucket").join(gone, ["bucket", "document_id"], "left").where("_new OR _gone IS NULL").drop("_new", "_gone")
        self._store(kept, {r[0] for r in documents.select(self._bucket()).distinct().collect()})

    def _store(self, rows: DataFrame, touched: set[int] | None) -> None:
        """rows, dealt by bucket, take the place of the touched buckets; None: of a table that is not there yet."""
        staged = f"{self.path.rstrip('/')}-staged-{uuid.uuid4().hex}"  # beside the table, in the same file system, so that folders can be renamed
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(staged)
        new = self.spark.read.schema(rows.schema).parquet(staged)
        filled = {r[0] for r in new.select("bucket").distinct().collect()}
        every = filled | (touched or set(range(not filled)))
        for b in sorted(every - filled):  # a bucket without rows gets an empty file, and so does a new table without any
            new.drop("bucket").limit(0).coalesce(1).write.parquet(f"{staged}/bucket={b}")
        if touched is None:
            move(self.spark, staged, self.path)
            return
        for b in sorted(every):
            place = f"{self.path}/bucket={b}"
            if exists(self.spark, place):
                move(self.spark, place, f"{staged}/old-{b}")
            move(self.spark, f"{staged}/bucket={b}", place)
        remove(self.spark, staged)
