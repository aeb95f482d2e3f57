"""Conversation structure repair: the cheapest edits that give every conversation the turns `(system? (user assistant)+)?`.

A* on the edit lattice of (rows read, last role). Edits are Keep (0), Rerole to user or assistant (2), Delete
(3, required for blank and repeated rows) and Insert an empty user or assistant turn (2); a truncated row that is not
deleted is charged 1. The heuristic is the suffix sum of the deletions that must come and of 1 for each
truncated row to come (kept or deleted, it costs that much), so it never overstates and never falls faster than
an edit costs. The queue is keyed (cost plus heuristic, audit), audit being the edits' initials, so of all cheapest
repairs the ASCII-least audit is the first to arrive.

Conversations of up to LONG rows are searched whole, in the task that their rows are sorted in. Longer ones are cut into
segments over ordered ranges of their rows; each segment is searched from every role to every role, and the segments'
results are joined in order, so no task holds such a conversation.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexforge.llm.common import CRC32_SQL, crc32_sql, materialize

RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A conversation of more rows is searched in segments of SEGMENT rows.
LONG, SEGMENT = 512, 256
BATCH_BYTES = 4 << 20

_SPACES = " \t\n\x0b\x0c\r"
_INK = re.compile(r"[^\x20\x09-\x0D]")
#: States: nothing yet, after system, after user, after assistant. The turn that each one wants next, and where a turn leads to.
START, DONE = 0, (0, 3)
WANTS = ("user", "user", "assistant", "user")
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_LEGAL = {"su", "ua", "au"}
#: Faults of a row.
BLANK, DUPLICATE, CUT = 1, 2, 3


def fault(text: str, seen_before: bool) -> int:
    """The first fault that a row has: blank, seen before, or ending without a stop."""
    if not _INK.search(text):
        return BLANK
    if seen_before:
        return DUPLICATE
    return 0 if text.rstrip(_SPACES)[-1] in ".!?" else CUT


def search(rows: list[tuple[str, int]], begin: int = START, ends: Iterable[int] = DONE, all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """{state at the end: (cost, audit)} of rows (role's initial, fault): of the cheapest end of ends, or with all_ends of each that can be reached."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] in (BLANK, DUPLICATE) else TRUNCATED if rows[i][1] == CUT else 0)
    queue, closed, found = [(ahead[0], "", 0, begin)], set(), {}
    while queue:
        f, audit, i, q = heapq.heappop(queue)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        if i == n and q in ends:
            found[q] = (f, audit)
            if not all_ends or len(found) == len(tuple(ends)):
                return found
        cost = f - ahead[i]
        steps = [(cost + INSERT, "I", i, _AFTER[q, WANTS[q][0]])]
        if i < n:
            initial, wrong = rows[i]
            steps.append((cost + DELETE, "D", i + 1, q))
            if wrong not in (BLANK, DUPLICATE):
                charge = cost + (TRUNCATED if wrong == CUT else 0)
                steps.append((charge + RETAG, "R", i + 1, _AFTER[q, WANTS[q][0]]))
                if (q, initial) in _AFTER:
                    steps.append((charge, "K", i + 1, _AFTER[q, initial]))
        for g, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (g + ahead[j], audit + edit, j, to))
    return found


def applied(audit: Iterable[str], rows: Iterator[tuple]) -> Iterator[tuple[str, str, str, tuple | None]]:
    """(edit, role, text, row it was made from) of every repaired turn; rows are (role, text, ...)."""
    q = START
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = row[0] if edit == "K" else WANTS[q]
        q = _AFTER[q, role[:1]]
        yield edit, role, "" if row is None else row[1], row


class Digest:
    """SHA-256 of `role:text` lines."""

    def __init__(self):
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True

    def hex(self) -> str:
        return self.sha.hexdigest()


REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
TURNS = [("place", "long"), ("edit", "string"), ("turn", "long"), ("role", "string"), ("text", "string")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _mapped(rows: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], columns: list[tuple[str, str]]) -> DataFrame:
    """run over the rows of each partition, one by one; what it yields is the conversation's id and columns, in batches of bounded size."""
    names = ["conv_id", *[n for n, _ in columns]]
    kinds = [to_arrow_type(rows.schema["conv_id"].dataType), *[_ARROW[t] for _, t in columns]]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in run(_streamed(batches)):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, str))
            if size > BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return rows.mapInArrow(arrow, ", ".join(f"{n} {t}" for n, t in [("conv_id", dict(rows.dtypes)["conv_id"]), *columns]))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def _counts(faults: list[int], initials: list[str]) -> tuple[int, int, int, int]:
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal


def _gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _whole(base: DataFrame, turns: bool) -> DataFrame:
    """Conversations of bounded size: all rows of one at a time."""
    columns = TURNS if turns else REPORT

    def conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, here = [], None
        for conv, row, turn, role, text in rows:
            if here is not None and here[0] != conv:
                yield here[0], held
                held = []
            here = (conv,)
            if row:
                held.append((role, text, turn))
        if here is not None:
            yield here[0], held

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, rows in conversations(stream):
            seen, faults = set(), []
            for role, text, _ in rows:
                faults.append(fault(text, (role, text) in seen))
                seen.add((role, text))
            initials = [r[0][:1] for r in rows]
            ((cost, audit),) = search(list(zip(initials, faults, strict=True))).values()
            repaired = applied(audit, iter(rows))
            if turns:
                for place, (edit, role, text, row) in enumerate(repaired):
                    yield conv, place, edit, row[2] if row else None, role, text
                continue
            digest = Digest()
            for _, role, text, _ in repaired:
                digest.add(role, text)
            yield conv, _gaps({t for *_, t in rows if t is not None}), *_counts(faults, initials), cost, audit, digest.hex()

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return _mapped(base.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "is_row", "turn", "role", "text"), run, columns)


_SEGMENT = [("piece", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("first", "string"), ("last", "string"), *[(f"c{q}{p}", "long") for q in range(4) for p in range(4)], *[(f"a{q}{p}", "string") for q in range(4) for p in range(4)]]


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Rows in order, cut into segments of one conversation each: their faults, and the cheapest edits from every state to every state."""

    def told(conv: object, piece: int, held: list[tuple[str, int]]) -> tuple:
        ways = [search(held, q, range(4), True) for q in range(4)]
        cells = [w.get(p, (None, None)) for w in ways for p in range(4)]
        return conv, piece, *_counts([f for _, f in held], [i for i, _ in held]), held[0][0], held[-1][0], *[c for c, _ in cells], *[a for _, a in cells]

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        piece, held, here = TaskContext.get().partitionId() << 33, [], None
        for conv, role, text, nth in stream:
            if held and (conv != here or len(held) >= segment_rows):
                yield told(here, piece, held)
                piece, held = piece + 1, []
            here = conv
            held.append((role[:1], fault(text, nth > 1)))
        if held:
            yield told(here, piece, held)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "nth"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "nth")
    return _mapped(ordered, run, _SEGMENT)


class Joined:
    """Segments of a conversation one behind the other: for each state, the cheapest edits so far.

    The beginning that all of them share is put aside, so what is compared stays about as long as a segment.
    """

    def __init__(self):
        self.shared, self.best, self.counts, self.last = [], {START: (0, "")}, [0, 0, 0, 0], None

    def add(self, segment: tuple) -> None:
        counts, first, last, costs, audits = segment[:4], segment[4], segment[5], segment[6:22], segment[22:38]
        for k in range(4):
            self.counts[k] += counts[k]
        self.counts[3] += self.last is not None and self.last + first not in _LEGAL
        self.last, best = last, {}
        for q, (cost, audit) in self.best.items():
            for p in range(4):
                if costs[4 * q + p] is not None:
                    way = (cost + costs[4 * q + p], audit + audits[4 * q + p])
                    best[p] = min(best.get(p, way), way)
        prefix = os.path.commonprefix([a for _, a in best.values()])
        self.shared.append(prefix)
        self.best = {p: (c, a[len(prefix) :]) for p, (c, a) in best.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(self.best[p] for p in DONE if p in self.best)
        return cost, "".join(self.shared) + audit


_FOLDED = [("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]


def _folded(segments: DataFrame) -> DataFrame:
    """One row per conversation: its counts, and the cost and audit of the cheapest edits over all segments."""

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        here, joined = None, None
        for conv, _, *segment in stream:
            if here is None or here[0] != conv:
                if here is not None:
                    yield here[0], *joined.counts, *joined.end()
                here, joined = (conv,), Joined()
            joined.add(tuple(segment))
        if here is not None:
            yield here[0], *joined.counts, *joined.end()

    return _mapped(segments.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), run, _FOLDED)


def _long(base: DataFrame, turns: bool, segment_rows: int) -> DataFrame:
    """Conversations of any size: rows are judged by keys of their own, searched in segments, and passed over once more with the audit in front of them."""
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    rows = materialize(base.where("is_row").withColumn("nth", F.row_number().over(same)).select("conv_id", "turn", "role", "text", "nth"), "repair-long")
    folded = materialize(_folded(_segments(rows, segment_rows)), "repair-folded")
    digests = TURNS if turns else [("repaired_sha256", "string")]

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        head = next(stream, None)
        while head is not None:  # the row with the audit comes before the conversation's own
            conv, *_, audit = head
            head, digest = None, Digest()

            def own() -> Iterator[tuple]:
                nonlocal head
                for row in stream:
                    if not row[1]:
                        head = row
                        return
                    yield row[3], row[4], row[2]

            rows_left = own()
            for place, (edit, role, text, row) in enumerate(applied(audit, rows_left)):
                if turns:
                    yield conv, place, edit, row[2] if row else None, role, text
                else:
                    digest.add(role, text)
            next(rows_left, None)  # on to the next conversation
            if not turns:
                yield conv, digest.hex()

    heads = folded.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("nth"))
    both = heads.union(rows.select("conv_id", F.lit(True), "turn", "role", "text", "nth"))
    order = ["conv_id", "is_row", F.asc_nulls_first("turn"), "role", "text", "nth"]
    told = _mapped(both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "is_row", "turn", "role", "text"), run, digests)
    if turns:
        return told
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    out = folded.alias("f").join(told.alias("t"), F.expr("f.conv_id <=> t.conv_id")).join(gaps.alias("g"), F.expr("f.conv_id <=> g.conv_id"))
    return out.select("f.conv_id", *[f"{dict(gaps='g', repaired_sha256='t').get(n, 'f')}.{n}" for n, _ in REPORT])


def _repair(rows: DataFrame, also: DataFrame | None, long_rows: int, segment_rows: int, turns: bool) -> DataFrame:
    blank = F.lit(" ")
    base = rows.select("conv_id", F.lit(True).alias("is_row"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), blank).alias("role"), F.coalesce(F.col("text"), blank).alias("text"))
    long = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long_rows).select(F.col("conv_id").alias("long_id")), "repair-ids")
    if also is not None:
        base = base.union(also.select("conv_id").distinct().select("conv_id", F.lit(False), F.lit(None).cast("long"), F.lit(""), F.lit("")))
    if long.isEmpty():
        return _whole(base, turns)
    is_long = base["conv_id"].eqNullSafe(long["long_id"])
    return _whole(base.join(long, is_long, "left_anti"), turns).union(_long(base.join(long, is_long, "left_semi"), turns, segment_rows))


def repair(rows: DataFrame, also: DataFrame | None = None, long_rows: int = LONG, segment_rows: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows (conv_id, turn, role, text), and of also's conv_ids.

    Rows go by turn, nulls first, then by role and text. gaps are turns missing between the first and the last; faults are counted by a
    row's first one; illegal are neighbours that may not follow each other. audit has an initial for each edit: Keep, Rerole, Delete, Insert.
    Nulls: a null role or text is one space; a null turn takes no part in gaps; null conv_ids are one conversation.
    A conversation of also without rows has zeros, an empty audit and the digest of nothing. Repeated rows are duplicates, deleted but
    for the first. Other columns are not read. Empty tables give an empty result. Conversations of more than long_rows rows go by segments of segment_rows, with the same result.
    """
    return _repair(rows, also, long_rows, segment_rows, False)


def repaired_turns(rows: DataFrame, long_rows: int = LONG, segment_rows: int = SEGMENT) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns that repair() leaves; turn is the row's own, null for inserted ones. Nulls, ties and repeats as there."""
    return _repair(rows, None, long_rows, segment_rows, True)


# ---------------------------------------------------------------- query


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations damaged by a hash of their place: dropped, emptied, without stops, repeated or given to the user. Nulls become one space."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(place.cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("damage != 0").select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(conversations), also=conversations)


#: The same by dynamic programming over (rows read, state), up to two inserted turns before each row and at the end.
OP12_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, {crc32_sql('h')} % 20 AS damage FROM keyed, crc_steps),
hurt AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE damage <> 0),
numbered AS (SELECT coalesce('=' || conv_id, '') AS k, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
judged AS (SELECT k, turn, role, text, i, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM numbered),
told AS (SELECT *, lag(r) OVER (PARTITION BY k ORDER BY i) || r AS pair FROM judged),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY k),
inserted(q, t, edits, paid) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 3, 'I', 2), (3, 2, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4)),
moves(q, r, t, edit, paid) AS (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0), (0, '*', 2, 'R', 2), (1, '*', 2, 'R', 2), (2, '*', 3, 'R', 2),
    (3, '*', 2, 'R', 2), (0, '*', 0, 'D', 3), (1, '*', 1, 'D', 3), (2, '*', 2, 'D', 3), (3, '*', 3, 'D', 3)),
run(k, i, q, way) AS (
  SELECT k, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} FROM counts
  UNION ALL
  SELECT run.k, run.i + 1, moves.t, min({{'cost': way.cost + inserted.paid + moves.paid + CASE WHEN fault = 3 AND edit <> 'D' THEN 1 ELSE 0 END, 'audit': way.audit || edits || edit}})
  FROM run JOIN judged ON judged.k = run.k AND judged.i = run.i + 1 JOIN inserted ON inserted.q = run.q
    JOIN moves ON moves.q = inserted.t AND moves.r IN (judged.r, '*') AND (moves.edit = 'D' OR fault NOT IN (1, 2)) GROUP BY ALL),
best AS (SELECT k, min({{'cost': way.cost + paid, 'audit': way.audit || edits}}) AS way FROM run JOIN counts USING (k) JOIN inserted USING (q) WHERE i = n AND t IN (0, 3) GROUP BY k),
-- the repaired turns: letter by letter, the state after each one follows from the rows kept
letters AS (SELECT k, j, substr(way.audit, j, 1) AS edit FROM (SELECT k, way, unnest(range(1, len(way.audit) + 1)) AS j FROM best)),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY k ORDER BY j) AS i FROM letters),
matched AS (SELECT p.k, p.j, p.edit, CASE WHEN edit <> 'I' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY p.k ORDER BY p.j) AS place,
    max(CASE WHEN edit = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.k) AS led FROM placed p LEFT JOIN judged d ON d.k = p.k AND d.i = p.i WHERE edit <> 'D'),
lines AS (SELECT k, place, CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line FROM matched),
hashes AS (SELECT k, sha256(string_agg(line, chr(10) ORDER BY place)) AS h FROM lines GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS k FROM conversations) LEFT JOIN counts USING (k) LEFT JOIN best USING (k) LEFT JOIN hashes USING (k)
"""
