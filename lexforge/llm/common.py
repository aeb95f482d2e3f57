"""Shared helpers of the training-data operators: shared storage, hashing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests, a laptop) a folder of our own is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lexforge-ck-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


_WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends here.

    A lost executor loses nothing of it. The tables are removed when the driver ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that materialize() has written and nothing reads any more; all of them if none is named."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [t._written for t in tables] if tables else list(_WRITTEN):
        _WRITTEN.remove(path)
        path = jvm.org.apache.hadoop.fs.Path(path)
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session may be gone at exit; the folder is the cluster's scratch space
            return


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id that each id of an edge reaches, itself included.

    Alternating large-star and small-star steps: every step is one aggregation with map-side
    combine and one equi-join, and rows never exceed twice the edges. Steps are logarithmic in
    the diameter. They end when a step changes nothing, told by the number of edges and two independent
    64-bit digests of them. Self loops and repeated edges are allowed; null ends are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    e = materialize(e.distinct(), "cc-edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    now, seen, old = e.where("u != v"), None, None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: edges now point from a larger to a smaller id
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u != v")
            .distinct()
        )
        now = materialize(small, "cc-edges")
        if old is not None:
            release(spark, old)
        old = now
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())
        if mark == seen:
            break
        seen = mark
    low = now.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(low, nodes["id"] == low["u"], "left").select("id", F.coalesce("m", "id").alias("component"))


#: CTE of DuckDB: the 256 steps of CRC-32 as a list, by its polynomial.
CRC32_SQL = """crc_steps AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, [CAST(b AS BIGINT) FOR b IN range(8)]), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(h: str) -> str:
    """DuckDB: the CRC-32 of bytes given as hex digits, beside a table crc_steps."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len({h}) // 2)]),
    lambda c, b: xor(tab[xor(c, b) % 256 + 1], c // 256)))"""
