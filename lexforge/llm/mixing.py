"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Weights become whole shares of a period of slots, one block per slot. The k-th block of a source
with share q of a period D may run from slot floor((k-1)*D/q) (its release) and must have run
before slot ceil(k*D/q) (its deadline). Earliest deadline first over the released blocks meets all
deadlines, so after any number of slots each source is less than one block away from its share.
The schedule of a period repeats, so only D slots are simulated, whatever the size of the corpus.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slots of a period: the grain of a weight is 1/PERIOD. With more than PERIOD/4 sources it is 4 slots a source.
PERIOD = 1000
#: Documents of a block.
BLOCK_ROWS = 8
#: Leading hex digits of md5(doc_id) that cut each source into slices, which are numbered side by side.
SLICE_DIGITS = 2


def shares(docs: DataFrame, weights: dict[str, int] | None = None, period: int = PERIOD) -> DataFrame:
    """(source_key, place, share, period): one row per source, shares adding up to the period.

    weights: whole-number target weights by source; a source that is not named has weight 1. Without
    weights a source weighs floor(1000*sqrt(its rows)), which lifts small sources. Each source gets
    one slot, the rest goes by weight, with the largest remainders rounded up (ties: smaller source).
    """
    counts = docs.groupBy(source_key().alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.floor(1000 * F.sqrt(F.col("n").cast("double"))).cast("bigint")
    else:
        weight = F.lit(1).cast("bigint")
        for name, w in weights.items():
            weight = F.when(F.col("source_key") == "s" + name, F.lit(max(1, int(w))).cast("bigint")).otherwise(weight)
    all_rows = Window.partitionBy(F.lit(0))
    w = counts.withColumn("w", weight).withColumn("total", F.sum("w").over(all_rows)).withColumn("sources", F.count("*").over(all_rows))
    w = w.withColumn("period", F.greatest(F.lit(period).cast("bigint"), 4 * F.col("sources"))).withColumn("free", F.col("period") - F.col("sources"))
    w = w.withColumn("base", F.expr("free * w div total")).withColumn("rest", F.expr("free * w % total"))
    w = w.withColumn("left", F.col("free") - F.sum("base").over(all_rows))
    w = w.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "source_key")))
    w = w.withColumn("share", 1 + F.col("base") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0))
    return w.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_key"))).select("source_key", "place", "share", "period")


def source_key():
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def period_schedule(share: DataFrame) -> DataFrame:
    """(source_key, share, period, turn, run): the slot of a period in which a source's turn-th block runs, by earliest deadline first.

    A fold over the slots of one period; the state is the next turn of every source.
    """
    one = share.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "share"))).alias("q"), F.max("period").alias("d"))
    step = """
      aggregate(sequence(0L, d - 1),
        named_struct('next', transform(q, x -> 1L), 'ran', cast(array() as array<int>)),
        (acc, t) -> element_at(transform(
          array(array_min(filter(
            transform(q, (x, i) -> named_struct('deadline', (acc.next[i] * d + x.share - 1) div x.share, 'i', i, 'release', (acc.next[i] - 1) * d div x.share)),
            j -> j.release <= t and acc.next[j.i] <= q[j.i].share)).i),
          best -> named_struct('next', transform(acc.next, (n, i) -> if(i = best, n + 1, n)), 'ran', array_append(acc.ran, best + 1))), 1),
        acc -> acc.ran)
    """
    ran = one.where("d is not null").select(F.posexplode(F.expr(step)).alias("run", "place"))
    turn = F.row_number().over(Window.partitionBy("place").orderBy("run"))
    return ran.withColumn("turn", turn.cast("bigint")).join(F.broadcast(share), "place").select("source_key", "share", "period", "turn", F.col("run").cast("bigint").alias("run"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS, slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_slot (all from 0) and mix_place (row in the block, from 0).

    Reading by (mix_slot, mix_place) mixes the sources to their weights: every prefix of slots that no
    source's end has reached deviates by less than one block. When a source has no blocks left its slots
    stay empty and the others keep their order, so every row is kept once. Rows of a source run in the
    order of md5(doc_id), which shuffles them.

    Nulls: rows without a source are a source of their own; a null doc_id counts as an empty text.
    Repeated rows are rows. Texts are not looked at. Empty tables give an empty result. Columns of docs
    that start with mix_ are replaced; others may have any name.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    cols = docs.columns
    keyed = docs.withColumn("mix_source", source_key()).withColumn("mix_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("mix_slice", F.substring("mix_order", 1, slice_digits))
    sizes = docs.select("doc_id", "source")
    sizes = sizes.select(source_key().alias("mix_source"), F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, slice_digits).alias("mix_slice"))
    sizes = sizes.groupBy("mix_source", "mix_slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_source", "mix_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    nth = F.row_number().over(Window.partitionBy("mix_source", "mix_slice").orderBy("mix_order", "doc_id"))
    rows = keyed.withColumn("mix_nth", nth).join(offsets, ["mix_source", "mix_slice"])
    rows = rows.withColumn("mix_seq", F.col("mix_before") + F.col("mix_nth") - 1)
    rows = rows.withColumn("mix_block", F.expr(f"mix_seq div {block_rows}")).withColumn("mix_place", F.expr(f"mix_seq % {block_rows}"))
    share = shares(docs, weights, period)
    plan = period_schedule(share).select(F.col("source_key").alias("mix_source"), F.col("share").alias("mix_share"), F.col("period").alias("mix_period"), F.col("turn").alias("mix_turn"), F.col("run").alias("mix_run"))
    rows = rows.join(F.broadcast(share.select(F.col("source_key").alias("mix_source"), F.col("share").alias("mix_q"))), "mix_source")
    rows = rows.withColumn("mix_turn", F.expr("mix_block % mix_q + 1"))
    # a period's schedule has as many rows as slots: bounded by PERIOD, or by 4 slots a source
    rows = rows.join(F.broadcast(plan), ["mix_source", "mix_turn"])
    whole = "mix_block div mix_q * mix_period"
    return rows.select(
        *cols,
        "mix_block",
        F.expr(f"{whole} + (mix_turn - 1) * mix_period div mix_q").alias("mix_release"),
        F.expr(f"{whole} + (mix_turn * mix_period + mix_q - 1) div mix_q").alias("mix_deadline"),
        F.expr(f"{whole} + mix_run").alias("mix_slot"),
        "mix_place",
    )


def mixed_files(docs: DataFrame, weights: dict[str, int] | None = None, places: bool = False) -> DataFrame:
    """docs, the same columns and rows, laid out in mixed order: partitions are ranges of slots, sorted inside.

    Readers of files may take them in any order; with places, mix_slot and mix_place stay as columns and say it.
    """
    mixed = mix(docs, weights)
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*docs.columns, *(["mix_slot", "mix_place"] if places else []))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "place")])


OP2_SQL = """
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counts AS (SELECT k, count(*) AS n, CAST(floor(1000 * sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS w FROM keyed GROUP BY k),
a AS (SELECT k, w, CAST(sum(w) OVER () AS BIGINT) AS total, count(*) OVER () AS m, greatest(1000, 4 * count(*) OVER ()) AS d FROM counts),
b AS (SELECT k, d, m, (d - m) * w // total AS base, (d - m) * w % total AS rest FROM a),
c AS (SELECT *, d - m - CAST(sum(base) OVER () AS BIGINT) AS left_over, row_number() OVER (ORDER BY rest DESC, k) AS nth FROM b),
share AS (SELECT k, d, 1 + base + CASE WHEN nth <= left_over THEN 1 ELSE 0 END AS q FROM c),
jobs AS (SELECT k, q, d, t.turn, (t.turn - 1) * d // q AS release, (t.turn * d + q - 1) // q AS deadline
         FROM share, LATERAL (SELECT unnest(range(1, q + 1)) AS turn) t),
-- one row per slot: what has run so far, as a list of turns by source
start AS (SELECT list(q ORDER BY k) AS qs, list(k ORDER BY k) AS ks, any_value(d) AS d FROM share),
run(t, best, next) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(qs, lambda x: CAST(1 AS BIGINT)) FROM start
  UNION ALL
  SELECT t + 1, best2, list_transform(next, lambda n, i: CASE WHEN i = best2 THEN n + 1 ELSE n END)
  FROM (SELECT run.t, run.next, (
          SELECT arg_min(i, ((run.next[i] * s.d + s.qs[i] - 1) // s.qs[i]) * 100000 + i)
          FROM (SELECT unnest(range(1, len(s.qs) + 1)) AS i)
          WHERE (run.next[i] - 1) * s.d // s.qs[i] <= run.t + 1 AND run.next[i] <= s.qs[i]) AS best2
        FROM run, start s WHERE run.t + 1 < s.d)),
plan AS (SELECT start.ks[best] AS k, t AS slot, row_number() OVER (PARTITION BY best ORDER BY t) AS turn FROM run, start WHERE t >= 0),
seqs AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS seq FROM keyed),
placed AS (SELECT s.doc_id, s.source, s.k, s.seq // 8 AS block, s.seq % 8 AS place, q, d FROM seqs s JOIN share USING (k))
SELECT p.doc_id, p.source, p.block, p.block // p.q * p.d + j.release AS release, p.block // p.q * p.d + j.deadline AS deadline,
       p.block // p.q * p.d + plan.slot AS slot, p.place
FROM placed p JOIN jobs j ON j.k = p.k AND j.turn = p.block % p.q + 1 JOIN plan ON plan.k = p.k AND plan.turn = p.block % p.q + 1
"""
