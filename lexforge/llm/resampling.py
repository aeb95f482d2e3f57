"""Importance resampling towards a target distribution: draw the documents whose features look most like the target's.

A document's weight is the sum of its features' log ratios (target against corpus) over hashed buckets, its
score the weight with Gumbel noise of its doc_id, so the highest scores are a draw without replacement
in proportion to exp(weight / GRAIN).

1. Buckets are counted with one array a task; ratios are an array of BUCKETS numbers, the only thing
   broadcast, and score whole batches of texts at once.
2. Every partition sorts its eligible documents: a sorted run. It is cut where ranges of scores end
   and into blocks of BLOCK rows, and written to the shared folder.
3. Ranges are told apart by a sample, counted exactly, and only those that hold drawn rows are merged,
   each by a tournament tree over its runs. Blocks come in the order of their first rows, so a block is in
   memory only while its rows take part. The tree stops at the exact number of rows.

A range's first rank is the number of rows in the ranges before it, so no task sees more than its range.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lexforge.llm.common import CRC32_SQL, crc32_sql, materialize

BUCKETS, GRAIN, SEED = 10_000, 1000, 2024
#: A document with fewer words is not drawn; how many of a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 10
#: Rows of a run that are one row of the table of runs; rows that a range holds about; ranges at most, and rows sampled a range to tell them apart.
BLOCK, RANGE_ROWS, MOST_RANGES, SAMPLED = 1024, 500_000, 10_000, 64
#: Texts scored at once; words whose bucket a worker remembers.
BATCH, CACHE_WORDS = 256, 1 << 18

#: Every byte of a character beyond ASCII belongs to a word, so bytes can be matched.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A null doc_id is behind all others of its score.
NO_ID = (1 << 63) - 1


class Buckets(dict):
    """Bucket of a feature; those of frequent words are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(feature) <= 64:
            self[feature] = bucket
        return bucket


def features(words: list[bytes], longest: int) -> list[bytes]:
    """Runs of 1 to longest consecutive words, joined by a space."""
    return words if longest == 1 else [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def hashed(texts: list[bytes | None], longest: int, seen: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, one text behind the other; features and words of each text."""
    each = [WORD.findall((t or b"").lower()) for t in texts]
    found = [features(w, longest) for w in each]
    sizes = np.array([len(f) for f in found], np.int64)
    ids = np.fromiter((b for f in found for b in map(seen.__getitem__, f)), np.int64, int(sizes.sum()))
    return ids, sizes, np.array([len(w) for w in each], np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task adds its own up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Buckets(buckets)
        for part in slices(batches):
            total += np.bincount(hashed(part.column(0).to_pylist(), longest, seen)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the log of its smoothed share in target against that in docs, in 1/GRAIN, rounded down."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, texts in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(texts, longest, buckets).collect():  # one row a bucket
            counts[bucket] = n
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(GRAIN * math.log(float(b + 1) * float(all_s) / (float(a + 1) * float(all_t)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in 1/GRAIN; a null doc_id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-GRAIN * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, longest: int = 1, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of every row of docs."""
    buckets = len(gains)
    gain = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(buckets)
        for part in slices(batches):
            ids, sizes, words = hashed(part.column(1).to_pylist(), longest, seen)
            sums = np.append(0, np.cumsum(gain.value[ids]))
            ends = np.cumsum(sizes)
            weight = sums[ends] - sums[ends - sizes]
            score = weight + np.array([noise(k, seed) for k in part.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(weight), pa.array(score), pa.array(words >= least_words)], ["doc_id", "n_features", "weight", "score", "eligible"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean")


# ---------------------------------------------------------------- runs and their merge

#: A row's place in the order of a draw: higher scores, smaller ids, fewer features; salt tells equal rows apart.
ORDER = ["neg", "id", "n_features", "salt"]
_ROW = "neg long, id long, n_features long, salt long, weight long"
_NAMES = ["neg", "id", "n_features", "salt", "weight"]
_RUN = f"range int, run int, size int, {_ROW.replace('weight long', 'weights array<long>')}, negs array<long>, ids array<long>, features array<long>, salts array<long>"


def sorted_runs(rows: DataFrame, bounds: list[tuple], block_rows: int = BLOCK) -> DataFrame:
    """Blocks of the sorted runs of every partition: (range, run, size, first row's place, arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, held, here = TaskContext.get().partitionId(), [], -1

        def block() -> pa.RecordBatch:
            cols = [np.array(c, np.int64) for c in zip(*held, strict=True)]
            first = [pa.array([int(c[0])]) for c in cols[:4]]
            lists = [pa.array([cols[i]], pa.list_(pa.int64())) for i in (4, 0, 1, 2, 3)]
            head = [pa.array([v], pa.int32()) for v in (here, me, len(held))]
            return pa.RecordBatch.from_arrays([*head, *first, *lists], ["range", "run", "size", *ORDER, "weights", "negs", "ids", "features", "salts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = bisect_right(bounds, row[:4])
                if held and (at != here or len(held) >= block_rows):
                    yield block()
                    held = []
                here = at
                held.append(row)
        if held:
            yield block()

    return rows.select(*_NAMES).sortWithinPartitions(*ORDER).mapInArrow(run, _RUN)


class Tournament:
    """A winner tree over sorted runs: the least row of all of them after log2(runs) comparisons.

    Runs join with add() and leave when they are at their end; a leaf that is free is used again.
    """

    def __init__(self):
        self.width, self.rows, self.free = 1, [None], [0]
        self.tree = [-1, -1]  # the winning leaf below each node; the leaves' own nodes come last

    def __bool__(self) -> bool:
        return self.tree[1] >= 0

    def add(self, run: Iterator[tuple]) -> None:
        if not self.free:
            self.free = list(range(2 * self.width - 1, self.width - 1, -1))
            self.rows += [None] * self.width
            self.width *= 2
            self.tree = [-1] * (2 * self.width)
            for leaf in range(self.width):
                self.tree[self.width + leaf] = leaf if self.rows[leaf] else -1
            for node in range(self.width - 1, 0, -1):
                self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
        leaf = self.free.pop()
        self._put(leaf, run)

    def least(self) -> tuple:
        return self.rows[self.tree[1]][0]

    def pop(self) -> tuple:
        leaf = self.tree[1]
        row, run = self.rows[leaf]
        self._put(leaf, run)
        return row

    def _put(self, leaf: int, run: Iterator[tuple]) -> None:
        row = next(run, None)
        self.rows[leaf] = None if row is None else (row, run)
        if row is None:
            self.free.append(leaf)
        node = self.width + leaf
        self.tree[node] = -1 if row is None else leaf
        while node > 1:
            node //= 2
            self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])

    def _better(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        return a if self.rows[a][0] <= self.rows[b][0] else b


_OUT = "doc_id long, n_features long, weight long, score long, rank long"


def merged(runs: DataFrame, before: dict[int, int], draw: int) -> DataFrame:
    """Rows of whole ranges in order, with their ranks up to draw; rows behind have none. before: rows in the ranges before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, rank, tree = [], None, 0, Tournament()

        def told() -> pa.RecordBatch:
            neg, ids, n, _, weight, ranks = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(n), pa.array(weight), pa.array([-x for x in neg]), pa.array(ranks, pa.int64())], ["doc_id", "n_features", "weight", "score", "rank"])

        def take(until: tuple | None) -> Iterator[pa.RecordBatch]:
            """Rows before the place until, or all; those behind the last one drawn are not compared any more."""
            nonlocal rank
            while tree and rank < draw and (until is None or tree.least() < until):
                rank += 1
                out.append((*tree.pop(), rank))
                if len(out) >= 8192:
                    yield told()
                    out.clear()
            if tree and rank >= draw:
                for left in tree.rows:
                    if left is not None:
                        out.extend((*row, None) for row in (left[0], *left[1]))
                tree.__init__()
                yield told()
                out.clear()

        for batch in batches:
            for block in batch.to_pylist():
                if block["range"] != here:
                    yield from take(None)
                    here, rank = block["range"], before[block["range"]]
                yield from take(tuple(block[c] for c in ORDER))
                tree.add(zip(block["negs"], block["ids"], block["features"], block["salts"], block["weights"], strict=True))
        yield from take(None)
        if out:
            yield told()

    n = max(len(before), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartition(n, "range").sortWithinPartitions("range", *ORDER).mapInArrow(run, _OUT)


def bounds_of(rows: DataFrame, n: int, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK) -> list[tuple]:
    """Places that cut n rows into ranges of about equal size: at least as many as there are shuffle partitions (if there are rows), at most MOST_RANGES.

    They come from a sample of SAMPLED rows a range, told by a hash, so they are the same in every run; they only
    set how even ranges are, not which rows are drawn.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MOST_RANGES, max(n // range_rows, min(parts, n // block_rows))))
    if ranges == 1:
        return []
    share = min(1.0, SAMPLED * ranges / n)
    told = F.xxhash64(*ORDER).bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))
    sample = sorted(tuple(r) for r in rows.where(told).select(*ORDER).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = 1, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; ranks 1, 2, 3... of the floor(percent*N/100) rows drawn of the N with least_words words.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features runs of 1 to longest words.
    Nulls: a null text has no words; a null doc_id has the noise of an empty one, stands behind all ids of its score, and stays
    null. Ties go to the smaller doc_id, then to fewer features; rows alike in all of it are drawn in any order, each once.
    Repeated rows are rows. Texts may be of any length that a row can hold. An empty table gives an empty result; an empty target counts as no features.
    Other columns of docs and target are not read, whatever they are called.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    table = materialize(scored(docs, gains, longest, least_words, seed).withColumn("salt", F.monotonically_increasing_id()), "resample-scored")
    rows = table.where("eligible").select((-F.col("score")).alias("neg"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "n_features", "salt", "weight")
    n = rows.count()
    draw = percent * n // 100
    runs = materialize(sorted_runs(rows, bounds_of(rows, n, range_rows, block_rows), block_rows), "resample-runs")
    before, total = {}, 0
    for r in runs.groupBy("range").agg(F.sum("size").alias("n")).orderBy("range").collect():  # MOST_RANGES rows at most
        if total < draw:
            before[r["range"]] = total
        total += r["n"]
    last = max(before, default=-1)
    drawn = merged(runs.where(F.col("range") <= last), before, draw)
    block = F.explode(F.arrays_zip("negs", "ids", "features", "weights")).alias("r")
    beyond = runs.where(F.col("range") > last).select(block).select(F.nullif(F.col("r.ids"), F.lit(NO_ID)).alias("doc_id"), F.col("r.features").alias("n_features"), F.col("r.weights").alias("weight"), (-F.col("r.negs")).alias("score"))
    few = table.where("not eligible").select("doc_id", "n_features", "weight", "score")
    return drawn.union(beyond.union(few).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents drawn by resample(), all their columns, with resample_weight, resample_score and resample_rank.

    Rows that share a doc_id are told apart by their score and number of features, and numbered where these agree too. Columns of docs of
    these three names are replaced; names starting with _ are reserved. Nulls and ties as in resample(), which takes the same arguments.
    """
    docs = docs.drop("resample_weight", "resample_score", "resample_rank")
    ranks = resample(docs, target, **how).where("rank is not null")
    longest = how.get("longest", 1)
    rows = _with_weights(docs, bucket_gains(docs, target, longest, how.get("buckets", BUCKETS)), longest)
    nth = "row_number() over (partition by {0} order by {1})"
    left = rows.withColumn("_nth", F.expr(nth.format("doc_id, _n, _w", "_w")))
    right = ranks.toDF("_id", "_m", "_weight", "_score", "_rank").withColumn("_of", F.expr(nth.format("_id, _m, _weight", "_rank")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_m")) & (F.col("_w") == F.col("_weight")) & (F.col("_nth") == F.col("_of"))
    return left.join(right, same).select(*docs.columns, *[F.col(f"_{c}").alias(f"resample_{c}") for c in ("weight", "score", "rank")])


def _with_weights(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """docs with _n and _w: features and weight of each row."""
    gain, at = docs.sparkSession.sparkContext.broadcast(gains), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(len(gain.value))
        for part in slices(batches):
            texts = [None if t is None else t.encode() for t in part.column(at).to_pylist()]
            ids, sizes, _ = hashed(texts, longest, seen)
            sums, ends = np.append(0, np.cumsum(gain.value[ids])), np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], [*part.schema.names, "_n", "_w"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_n", LongType()).add("_w", LongType()))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


#: Every bucket's gain and every document's score; crc_steps gives CRC-32.
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
{CRC32_SQL},
words AS (SELECT t, r, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS w
  FROM (SELECT 's' AS t, r, text FROM d UNION ALL SELECT 't', 0, text FROM benchmark)),
terms AS (SELECT DISTINCT w FROM words),
bucket AS (SELECT w, {crc32_sql('h')} % 10000 AS b FROM (SELECT w, hex(encode(w)) AS h FROM terms), crc_steps),
n AS (SELECT b, count(*) FILTER (t = 's') AS s, count(*) FILTER (t = 't') AS t FROM words JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM n),
weights AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN bucket USING (w) JOIN gain USING (b) WHERE t = 's' GROUP BY r),
docs AS (SELECT doc_id, r, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS nth, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * n // 100 THEN nth END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
