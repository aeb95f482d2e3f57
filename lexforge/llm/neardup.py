"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A signature has SYMBOLS b-bit symbols, cut into CHUNKS. Two signatures that differ in at most
DISTANCE symbols differ in at most ERRORS = DISTANCE // CHUNKS symbols of some chunk (pigeonhole), so
every chunk is indexed once for each way to leave ERRORS of its symbols out: all pairs under the
distance share a bucket. Buckets are never expanded into pairs. A text is first held against the
most central of its buckets' texts, which joins groups of copies. Where a bucket still holds several
components, its texts of all but the largest one meet all its texts, slice by slice, so a task holds two
slices of bounded size; only pairs of different components come out whose bitmaps, an exact upper bound of
similarity, allow a link. A text gives so many of its likeliest partners at once; where it has more, its bucket
meets again with eight times as many, until none is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import connected_components, materialize, release

SHINGLE, SIMILAR = 5, 75
#: Signature: at a similarity of 0.75 a chunk of three matches but for one symbol with 0.84, so all eight miss with 4e-7.
SYMBOLS, BITS, CHUNKS, DISTANCE = 24, 16, 8, 15
WIDTH, ERRORS = SYMBOLS // CHUNKS, DISTANCE // CHUNKS
#: Rows of a bucket's slice on average, of which a task holds two at least; rows a task compares at once; partners a text gives of a meeting in the first round.
SLICE, MEETING, PARTNERS = 1024, 1 << 15, 8
#: 64-bit words of a set's bitmap, a bit for the shingles with the same leading bits.
MAP_WORDS = 32
CACHE_WORDS, BATCH = 300_000, 256

_MULTIPLY = np.random.default_rng(20).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles; of the whole sequence where there are fewer words."""
    words = text.encode().lower().split() if text else []  # bytes know no other letters and white space than A-Z, U+0020 and U+0009..U+000D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : len(words) - n + 1 + i]
    return np.unique(mixed(out))


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, SYMBOLS] minima of each set, none of them empty, under multiply-shift hashes, cut to BITS bits."""
    flat, at = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = np.stack([np.minimum.reduceat(mixed(flat * m), at) for m in _MULTIPLY], 1)
    return (mixed(low) >> np.uint64(64 - BITS)).astype(np.int32)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MAP_WORDS, bool)
    bits[(shingles >> np.uint64(64 - (64 * MAP_WORDS - 1).bit_length())).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def may_be_similar(n_a: str, map_a: str, n_b: str, map_b: str) -> Column:
    """Whether two sets can be similar enough: each bit that one bitmap has beyond the other is a shingle the other set lacks. Never false for a similar pair."""

    def beyond(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))), F.lit(0), lambda t, v: t + v)

    # with at most u common shingles: 100 u >= 75 (n_a + n_b - u), that is 7 u >= 3 (n_a + n_b)
    least = 3 * (F.col(n_a) + F.col(n_b))
    return (7 * (F.col(n_a) - beyond(map_a, map_b)) >= least) & (7 * (F.col(n_b) - beyond(map_b, map_a)) >= least)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set, null if empty), sig array<int>, bits array<long>, text_key (64 bits of the text), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [shingle_set(t.as_py(), hashes) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                sig = iter(signatures_of(full) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                        pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int32())),
                        pa.array([bitmap(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        part.column(2),
                    ],
                    ["doc_id", "n_shingles", "set_key", "sig", "bits", "text_key"],
                )

    return docs.select("doc_id", "text", text_key()).mapInArrow(run, "doc_id long, n_shingles long, set_key string, sig array<int>, bits array<long>, text_key long")


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text").alias("text_key")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles array<long>) for wanted (node, set_key): node is a doc_id whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [shingle_set(t.as_py(), hashes) for t in part.column(1)]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == k for s, k in zip(sets, part.column(2).to_pylist(), strict=True)]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
                yield rows.filter(pa.array(same, pa.bool_()))

    found = docs.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id"), "set_key"), "doc_id")
    return found.select("doc_id", "text", "set_key").mapInArrow(run, "node long, shingles array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, central) of the multi-index, only buckets with two nodes or more.

    n is the size of the node's set. central adds up the sizes of a node's buckets: the text that others
    were copied from shares more buckets with them than they do among each other.
    """
    keys = []
    for c in range(CHUNKS):
        for kept in combinations(range(WIDTH), WIDTH - ERRORS):
            keys.append(F.xxhash64(F.lit(c * 100 + sum(1 << k for k in kept)), *[F.element_at("sig", c * WIDTH + k + 1) for k in kept]))
    rows = nodes.select("node", F.col("n_shingles").alias("n"), F.explode(F.array(*keys)).alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialize(rows.join(several, "bucket").select("bucket", "node", "n", "size"), "near-rows")
    central = rows.groupBy("node").agg(F.sum("size").alias("central"))
    return rows.drop("size").join(central, "node").select("bucket", "node", "n", "central")


def sizes_fit(a: str, b: str):
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that can be similar by size and bitmap."""
    thin = nodes.select("node", "n_shingles", "bits")
    p = pairs.join(thin.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ma")), "a")
    p = p.join(thin.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("mb")), "b")
    return p.where(sizes_fit("na", "nb") & may_be_similar("na", "ma", "nb", "mb")).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar."""
    p = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    return p.where(100 * both >= SIMILAR * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def meetings(index: DataFrame, parts: DataFrame, bits: DataFrame) -> DataFrame:
    """(bucket, y, x, role, node, n, part, bits): the rows of buckets with several components, dealt to cells.

    Texts outside the bucket's largest component are rows (role 0) of the cells (their slice, any), all its texts are
    columns (role 1) of the cells (any, their slice); in a bucket of one cell a row is its own column (role 2).
    """
    named = index.join(parts, index["node"] == parts["id"], "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("part"))
    sized = named.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    several = sized.groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("total")).where("parts > 1")
    rows = named.join(several, "bucket").join(bits, "node")
    other = F.col("part") != F.col("most.part")
    wide, tall = (F.ceil(c / SLICE).cast("int") for c in (F.col("total"), F.col("total") - F.col("most.size")))
    y, x = F.pmod(F.xxhash64("node"), F.col("tall")).cast("int"), F.pmod(F.xxhash64("node"), F.col("wide")).cast("int")

    def cell(at_y, at_x, role: int) -> Column:
        return F.struct(at_y.alias("y"), at_x.alias("x"), F.lit(role).alias("role"))

    as_row = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda i: cell(y, i, 0))).otherwise(F.array())
    as_column = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda i: cell(i, x, 1))
    single = F.array(F.when(F.col("other"), cell(F.lit(0), F.lit(0), 2)).otherwise(cell(F.lit(0), F.lit(0), 1)))
    cells = F.when(F.col("wide") == 1, single).otherwise(F.concat(as_row, as_column))
    rows = rows.withColumn("other", other).withColumn("wide", wide).withColumn("tall", tall)
    return rows.select("bucket", F.explode(cells).alias("c"), "node", "n", "part", "bits").select("bucket", "c.y", "c.x", "c.role", "node", "n", "part", "bits")


def meet(key: np.ndarray, role: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, bits: np.ndarray, partners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of rows of one key that may be linked, at most so many for each i, the likeliest first, and places whose pairs were cut.

    Rows are sorted by key, then n. The k-th row after each row is compared at once for all rows.
    """
    ends = np.searchsorted(key, key, "right")
    size = np.bitwise_count(bits).sum(1, dtype=np.int64)
    live, step, found = np.arange(len(key)), 0, []
    while True:
        step += 1
        live = live[live + step < ends[live]]
        live = live[100 * n[live] >= SIMILAR * n[live + step]]
        if not len(live):
            break
        i, j = live, live + step
        ok = (part[i] != part[j]) & (role[i] + role[j] > 0) & ~((role[i] == 1) & (role[j] == 1))
        i, j = i[ok], j[ok]
        both = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        common = np.minimum(n[i] - size[i], n[j] - size[j]) + both  # at most so many shingles are in both sets
        ok = 7 * common >= 3 * (n[i] + n[j])
        if ok.any():
            found.append((i[ok], j[ok], common[ok] / (n[i] + n[j] - common)[ok]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    i, j, likely = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-likely, i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < partners], j[nth < partners], i[nth == partners]


def candidates(cells: DataFrame, partners: int) -> DataFrame:
    """(a, b, cut): pairs that may be linked, and the buckets (a and b null) in which a text has more than so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            role, node, n, part = (rows.column(c).to_numpy().astype(np.int64) for c in ("role", "node", "n", "part"))
            bits = rows.column("bits").combine_chunks()
            bits = (bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits).flatten().to_numpy().view(np.uint64).reshape(len(node), MAP_WORDS)
            bucket, y, x = (rows.column(c).to_numpy() for c in ("bucket", "y", "x"))
            key = np.cumsum(np.append(False, (bucket[1:] != bucket[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])))
            i, j, cut = meet(key, role, node, n, part, bits, partners)
            a, b, cut = np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), np.unique(bucket[cut])
            pad = pa.nulls(len(cut), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), pad]), pa.concat_arrays([pa.array(b), pad]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(cut, pa.int64())])], ["a", "b", "cut"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < MEETING:
                continue
            rows = pa.concat_tables(held)
            # whole cells only: the last one may go on in the next batch
            last = [rows.column(c)[-1].as_py() for c in ("bucket", "y", "x")]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("bucket", "y", "x"), last, strict=True)])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [rows.slice(end)]
            if end:
                yield settle(rows.slice(0, end))
        if held:
            yield settle(pa.concat_tables(held))

    ordered = cells.repartition("bucket", "y", "x").sortWithinPartitions("bucket", "y", "x", "n", "node")
    return ordered.mapInArrow(run, "a long, b long, cut long")


def link(nodes: DataFrame, sets_of) -> DataFrame:
    """(id, component) of the linked nodes. nodes: node, n_shingles, set_key, sig, bits; sets_of gives full sets for some."""
    spark = nodes.sparkSession
    index = materialize(buckets(nodes), "near-buckets")
    # every text is held against the most central of its buckets' most central texts
    order = F.struct("central", (-F.col("node")).alias("turned"))
    best = index.groupBy("bucket").agg(F.max(order).alias("best"))
    first = index.join(best, "bucket").groupBy("node").agg(F.max("best").alias("best")).select(F.col("node").alias("a"), (-F.col("best.turned")).alias("b")).where("a != b")
    wanted = index.select("node").distinct().join(nodes.select("node", "set_key"), "node")
    sets = materialize(sets_of(wanted), "near-sets")
    links = materialize(similar(plausible(first, nodes), sets), "near-links")
    parts = materialize(connected_components(links, "a", "b"), "near-parts")
    partners, bits, rows = PARTNERS, nodes.select("node", "bits"), index.drop("central")
    while True:
        found = materialize(candidates(meetings(rows, parts, bits), partners), "near-found")
        fresh = materialize(similar(found.where("a is not null").select("a", "b").distinct(), sets), "near-links")
        cut = found.where("cut is not null").select(F.col("cut").alias("bucket")).distinct()
        done = cut.isEmpty()
        if not fresh.isEmpty():
            known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
            parts = materialize(connected_components(known.union(fresh), "a", "b"), "near-parts")
        if done:
            release(spark, sets)
            return parts
        rows = index.drop("central").join(cut, "bucket", "left_semi")
        partners *= 8


def near_duplicates(docs: DataFrame, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, and with keys text_key.

    Texts with equal sets are one node, so exact copies never make pairs. component_id is the smallest
    doc_id reachable over links of similarity 0.75 or more, each confirmed on the full sets.
    Nulls: null and empty texts, and texts of white space, have no shingles and are linked with nothing;
    a null doc_id is linked with nothing, has a null component and is kept. Rows that repeat a doc_id
    belong to one node if their sets are equal; such rows are all kept or all not. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = materialize(signatures(docs), "near-signatures")
    usable = rows.where("set_key is not null and doc_id is not null")
    # one node for each set; the signature is the same for all its rows
    groups = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = usable.join(groups.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"]).dropDuplicates(["set_key"]).select(F.col("doc_id").alias("node"), "n_shingles", "set_key", "sig", "bits")
    nodes = materialize(nodes, "near-nodes")
    parts = link(nodes, lambda wanted: full_sets(docs, wanted))
    where = nodes.join(parts, nodes["node"] == parts["id"], "left").select("set_key", F.coalesce("component", "node").alias("part"))
    out = rows.join(where, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("part", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), *(["text_key"] if keys else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest doc_id.

    A document is a doc_id and a text, so of rows that share a doc_id only those go whose own text has a smaller double. Rows that
    repeat both are one document, and all stay or all go. Null doc_ids stay, and so do texts without words; null texts are of that kind.
    Columns and rows are otherwise as they were, whatever the columns are called. An empty table gives an empty result.
    """
    gone = near_duplicates(docs, keys=True).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
