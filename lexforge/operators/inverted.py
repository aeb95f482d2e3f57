"""An inverted index: postings of stemmed terms in partitioned tables, and searches that read only what a question's terms need.

    postings   bucket, term, block, docs, counts, lengths: up to BLOCK documents of a term a row, sorted by document
    terms      bucket, term, df
    size       docs, mean: how many documents there are and their mean length

A term's postings are blocks of bounded size, so a term in every document is many rows, in as many tasks as needed. A
search names the buckets of its terms, which prunes folders, and the terms, which prunes row groups. Texts are dealt by
block, so all of a block's counts are made in one task; a search deals the postings of its terms by block too, and hands on
the best documents of each block only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.retrieval import top

#: English words that are not indexed.
STOP_WORDS = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
#: Folders of an index, documents of a row of postings, and terms of a search at most.
BUCKETS, BLOCK, MOST_TERMS = 64, 1024, 100_000
#: Documents of a task and of a file in each folder, about; questions of a search that go to the tasks at once, and of these to a block at once.
TASK_DOCS, FILE_DOCS, ASKED, SLICE = BLOCK, 1 << 18, 50_000, 512
TABLES = {"postings": "term string, block long, docs array<long>, counts array<int>, lengths array<int>, bucket int", "terms": "term string, df long, bucket int"}


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column of words cut to their stems by the first step of Porter's algorithm: plurals, -ed, -ing and a last y. Words of other languages mostly stay as they are.

    Each rule is a column of its own, so that none is worked out more than once. Names that start with _stem are reserved.
    """

    def less(c: str, n: int, more: str = "") -> Column:
        return F.concat(F.left(F.col(c), F.char_length(c) - n), F.lit(more))

    def ends(c: str, *suffixes: str) -> Column:
        return reduce(lambda a, b: a | b, [F.endswith(F.col(c), F.lit(x)) for x in suffixes])

    r = rows.withColumn("_stem1", F.when(ends(column, "sses"), less(column, 2)).otherwise(F.col(column)))
    plural = F.when(ends("_stem1", "ies"), less("_stem1", 2)).when(ends("_stem1", "s") & ~ends("_stem1", "ss") & (F.char_length("_stem1") > 1), less("_stem1", 1)).otherwise(F.col("_stem1"))
    r = r.withColumn("_stem2", plural)
    cut = F.when(ends("_stem2", "ed"), less("_stem2", 2)).when(ends("_stem2", "ing"), less("_stem2", 3))
    r = r.withColumn("_stem3", cut).withColumn("_stem4", F.when(F.col("_stem3").rlike("[aeiouy]"), F.col("_stem3")))
    r = r.withColumn("_stem5", F.right("_stem4", F.lit(1)))
    double = (F.left(F.right("_stem4", F.lit(2)), F.lit(1)) == F.col("_stem5")) & F.col("_stem5").isin(*"bdfgmnprt") & (F.char_length("_stem4") > 1)
    mended = F.when(ends("_stem4", "at", "bl", "iz"), F.concat("_stem4", F.lit("e"))).when(double, less("_stem4", 1)).otherwise(F.col("_stem4"))
    r = r.withColumn("_stem6", F.when(ends("_stem2", "eed"), less("_stem2", 1)).when(F.col("_stem4").isNotNull(), mended).otherwise(F.col("_stem2")))
    out = F.when(ends("_stem6", "y") & F.col("_stem6").rlike("[aeiou].*y$"), less("_stem6", 1, "i")).otherwise(F.col("_stem6"))
    # a generator of one row: filters on the stems stay above it, and are not pushed down with all of this inside them
    return r.select(*[c for c in rows.columns if c != column], F.explode(F.array(out)).alias(column))


def words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): every word of a text that is indexed, lower-cased, and a null for each stop word or gap, so that no key is lost. A null text is empty."""
    each = F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"))
    word = F.when((F.col("word") != "") & ~F.col("word").isin(STOP_WORDS), F.col("word"))
    return rows.select(key, each.alias("word")).select(key, word.alias("word"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass
class InvertedIndex:
    """The index of a table (doc_id, text) in a folder."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _dealt(self, rows: DataFrame, docs: int) -> DataFrame:
        """rows by block, as many tasks as so many documents need."""
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, docs // TASK_DOCS), "block")

    def build(self, docs: DataFrame) -> None:
        """Index all documents anew. Rows without a doc_id are left out; rows of one doc_id count as one document of all their texts."""
        given = docs.where("doc_id is not null").select("doc_id", "text")
        n = given.select("doc_id").distinct().count()
        # the texts are shuffled once, by block; documents, their words, stems and blocks are all made in the tasks where they land
        whole = self._dealt(given.withColumn("block", F.expr(f"doc_id div {BLOCK}")), n).groupBy("block", "doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
        own = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
        # a generator of one row: the words are split once, and not again for their number
        held = whole.select("block", "doc_id", F.explode(F.array(own)).alias("words")).withColumn("length", F.size("words"))
        raw = held.select("block", "doc_id", "length", F.explode("words").alias("word")).groupBy("block", "doc_id", "length", "word").agg(F.count("*").alias("n"))
        counted = stemmed(raw, "word").groupBy("block", "doc_id", "length", F.col("word").alias("term")).agg(F.sum("n").cast("int").alias("n"))
        entry = F.array_sort(F.collect_list(F.struct("doc_id", "n", "length")))
        # three numbers a document in one array: much less to shuffle than three arrays
        packed = F.flatten(F.transform(entry, lambda e: F.array((e["doc_id"] - F.col("block") * BLOCK).cast("int"), e["n"], e["length"])))
        files = 1 + n // FILE_DOCS
        blocks = counted.groupBy("block", "term").agg(packed.alias("e")).repartition(self.buckets * files, _bucket(self.buckets), F.pmod("block", F.lit(files)))
        blocks = blocks.withColumn("at", F.sequence(F.lit(0), F.size("e") - 1, F.lit(3))).withColumn("bucket", _bucket(self.buckets))
        every = {"docs": lambda i: F.get("e", i) + F.col("block") * BLOCK, "counts": lambda i: F.get("e", i + 1), "lengths": lambda i: F.get("e", i + 2)}
        blocks = blocks.sortWithinPartitions("bucket", "term", "block").select("term", "block", *[F.transform("at", f).alias(c) for c, f in every.items()], "bucket")
        blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")
        words_here = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        size = self.postings().agg(F.lit(n).cast("long").alias("docs"), (F.coalesce(F.sum(words_here), F.lit(0)) / F.lit(max(n, 1))).alias("mean"))
        size.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/size")
        df = self.postings().groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df"))
        df = df.repartition(self.buckets * files, "bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(files)))
        df.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def of_terms(self, asked: DataFrame, table: str = "postings") -> DataFrame:
        """Rows of a table for the terms of asked (term): folders and row groups of other terms are not read."""
        some = [r[0] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        if len(some) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms in a batch: split it")
        known = self.spark.createDataFrame([(t,) for t in some], "term string").withColumn("bucket", _bucket(self.buckets))
        folders = sorted({r.bucket for r in known.collect()})
        rows = self._read(table).where(F.col("bucket").isin(folders))
        return rows.where(F.col("term").isin(some)) if len(some) <= 1000 else rows.join(F.broadcast(known), ["bucket", "term"], "left_semi")

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, rank, doc_id, score): documents that have every term of a question, by BM25; ties go to the smaller doc_id.

        A question without terms finds nothing, and so does one with a term that no document has. Questions of the same terms are searched
        once, ASKED sets of terms at a time.
        """
        named = stemmed(words(queries, "query_id", "query").where("word is not null"), "word").select("query_id", F.col("word").alias("term"))
        asked = named.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        sets = asked.select("terms").distinct()
        docs, mean = self.spark.read.parquet(f"{self.path}/size").select("docs", "mean").first()
        parts = 1 + sets.count() // ASKED
        found = [self._best(sets.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == i), k, k1, b, docs, mean) for i in range(parts)]
        return asked.join(reduce(DataFrame.union, found), "terms").select("query_id", "rank", "doc_id", "score")

    def _best(self, sets: DataFrame, k: int, k1: float, b: float, docs: int, mean: float) -> DataFrame:
        """(terms, rank, doc_id, score): the k best for each set of terms, out of the k best of each block."""
        asked = sets.select(F.explode("terms").alias("term"))
        df = {r.term: r.df for r in self.of_terms(asked, "terms").select("term", "df").collect()}
        # the rarest term first: its documents are few, the others only have to be met there
        each = [sorted(r.terms, key=lambda t: (df[t], t)) for r in sets.collect() if all(t in df for t in r.terms)]
        sent = self.spark.sparkContext.broadcast((each, df))

        def of_block(rows: pa.Table) -> pa.Table:
            return in_block(rows, *sent.value, k, k1, b, docs, mean)

        dealt = self._dealt(self.of_terms(asked).select("block", "term", "docs", "counts", "lengths"), docs)
        best = top(dealt.groupBy("block").applyInArrow(of_block, "query_id long, doc_id long, score double"), k, F.desc("score"), F.col("doc_id"))
        numbered = self.spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(each)], "query_id long, terms array<string>")
        return numbered.join(best, "query_id").select("terms", "rank", "doc_id", "score")


def in_block(rows: pa.Table, each: list[list[str]], df: dict[str, int], k: int, k1: float, b: float, docs: int, mean: float) -> pa.Table:
    """(number of a set, doc_id, score): the k best documents of a block for every set of terms, whose rarest term stands first. SLICE sets are met at a time, so memory is bounded by the block."""
    place = {t: i for i, t in enumerate(rows["term"].to_pylist())}
    lists = rows["docs"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    doc, tf, length = (rows[c].combine_chunks().flatten().to_numpy() for c in ("docs", "counts", "lengths"))
    base, span = int(doc.min()), int(doc.max() - doc.min()) + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    key = np.repeat(np.arange(len(sizes)), sizes) * span + doc - base
    order = np.argsort(key, kind="stable")
    key, weight = key[order], (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))[order]
    # questions whose terms are all in the block, in slices
    here = [(i, p) for i, s in enumerate(each) if (p := [place.get(t, -1) for t in s]) and min(p) >= 0]
    idf = np.array([np.log((docs - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in place])
    out = []
    for at in range(0, len(here), SLICE):
        part = here[at : at + SLICE]
        terms = np.full((len(part), max(len(p) for _, p in part)), -1)
        for i, (_, p) in enumerate(part):
            terms[i, : len(p)] = p
        n = sizes[terms[:, 0]]
        who = np.repeat(np.arange(len(part)), n)
        hit = np.arange(len(who)) + np.repeat(first[terms[:, 0]] - np.cumsum(n) + n, n)
        local, score = key[hit] % span, idf[terms[who, 0]] * weight[hit]
        for t in terms.T[1:]:
            want = t[who]
            hit = np.minimum(np.searchsorted(key, want * span + local), len(key) - 1)
            met = key[hit] == want * span + local
            kept = met | (want < 0)
            who, local, score = who[kept], local[kept], (score + np.where(met, idf[want] * weight[hit], 0.0))[kept]
        score = np.round(score, 6)
        best = np.lexsort((local, -score, who))
        who, local, score = who[best], local[best], score[best]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        out.append((np.array([i for i, _ in part])[who[nth < k]], local[nth < k] + base, score[nth < k]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0)] * 3
    return pa.table({c: pa.array(v).cast(t) for c, v, t in zip(("query_id", "doc_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def stem_sql(t: str) -> str:
    """stemmed() in DuckDB."""
    one = f"regexp_replace({t}, 'sses$', 'ss')"
    two = f"CASE WHEN regexp_matches(x, 'ies$') THEN regexp_replace(x, 'ies$', 'i') WHEN regexp_matches(x, '[^s]s$') THEN regexp_replace(x, 's$', '') ELSE x END"
    three = """CASE WHEN regexp_matches(y, 'eed$') THEN regexp_replace(y, 'eed$', 'ee') WHEN cut = '' THEN y WHEN regexp_matches(cut, '(?:at|bl|iz)$') THEN cut || 'e'
      WHEN right(cut, 1) = left(right(cut, 2), 1) AND regexp_matches(right(cut, 1), '[bdfgmnprt]') THEN left(cut, length(cut) - 1) ELSE cut END"""
    return f"(SELECT regexp_replace(z, '^(.*[aeiou].*)y$', '\\1i') FROM (SELECT {three} AS z FROM (SELECT y, regexp_extract(y, '^(.*[aeiouy].*?)(?:ed|ing)$', 1) AS cut FROM (SELECT {two} AS y FROM (SELECT {one} AS x)))))"


# ---------------------------------------------------------------- codes in texts

#: Words of a code at most.
CODE_WORDS = 5


def code_keys(codes: DataFrame) -> DataFrame:
    """(key, code): what a code is written like once spaces and punctuation are gone; a UN number also as Regulation No. n and UN Rn."""
    clean = F.lower(F.regexp_replace("code", r"[^A-Za-z0-9]+", ""))
    number = F.regexp_extract(clean, r"^(?:un)?r0*(\d+)$", 1)
    keys = F.when(number != "", F.array(F.concat(F.lit("r"), number), F.concat(F.lit("unr"), number), F.concat(F.lit("regulationno"), number))).otherwise(F.array(clean))
    return codes.where("code is not null").select(F.explode(keys).alias("key"), "code").where("key != ''").distinct()


def codes_in_text(texts: DataFrame, codes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code): the codes that each text names, as whole words.

    Stretches of 1 to CODE_WORDS words, joined, meet the codes' keys in an equi-join, so no text is held against every code. Where the keys are
    few Spark broadcasts them and nothing is shuffled but hits; leading zeros of numbers don't count.
    """
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^(r?)0+(\d)", "$1$2"))
    rows = texts.select(key, words.alias("w")).where(F.size("w") > 0)
    stretch = F.flatten(F.transform(F.col("w"), lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(CODE_WORDS), F.size("w") - i)), lambda n: F.array_join(F.slice("w", i + 1, n), ""))))
    return rows.select(key, F.explode(stretch).alias("key_")).join(code_keys(codes).withColumnRenamed("key", "key_"), "key_").select(key, "code").distinct()


def resolve_files(files: DataFrame, codes: DataFrame) -> DataFrame:
    """files (file_id, file_code: what its name says, text: of its first pages) with code and how: filename, text, ambiguous or none.

    A name's code counts if it is one of codes, however it is written. Otherwise the text decides if it names exactly one code. The smallest
    spelling stands for codes that are written alike.
    """
    def clean(c: str) -> Column:
        bare = F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", ""))
        return F.regexp_replace(bare, r"^(?:un)?r0*(\d+)$", "r$1")

    known = codes.where("code is not null").groupBy(clean("code").alias("_clean")).agg(F.min("code").alias("_named"))
    named = files.withColumn("_clean", clean("file_code")).join(known, "_clean", "left").drop("_clean")
    hits = codes_in_text(named.where("_named is null"), known.select(F.col("_named").alias("code")), "file_id", "text")
    found = hits.groupBy("file_id").agg(F.count("*").alias("_n"), F.min("code").alias("_hit"))
    n = F.coalesce("_n", F.lit(0))
    how = F.when(F.col("_named").isNotNull(), "filename").when(n == 1, "text").when(n > 1, "ambiguous").otherwise("none")
    code = F.when(F.col("_named").isNotNull(), F.col("_named")).when(n == 1, F.col("_hit"))
    return named.join(found, "file_id", "left").withColumn("code", code).withColumn("how", how).drop("_named", "_n", "_hit")
