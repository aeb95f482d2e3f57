"""Suffix-array dedup by prefix-free parsing: remove every byte that a LENGTH-byte string repeated anywhere covers.

Texts are parsed at rolling-hash triggers. The trigger of a string start is the smallest rolling hash in
the REACH bytes that follow, so it depends on content alone and phrases have a bounded length. All string
starts with one trigger form a run, the unit of the parse. Names (hashes) stand for ranks, since only
equality to a depth of LENGTH is asked for, not order:

1. the parse: runs are grouped by the name of what follows their trigger to the depth every string of
   theirs shares; a run alone in its group repeats nowhere,
2. runs whose whole extent (all their strings) occurs twice are repeated as a whole,
3. the dictionary: the runs left over, and one of each repeated kind beside them, are compared string by
   string within their group, in corpus order by name. Groups too large for a task are compared by a
   distributed count instead.

Names of a group and of its member make 128 bits together.

The same parse runs over words in place of bytes (word_repeats): a word's value is the name of its bytes, strings are so many words.

Beside the strings of LENGTH bytes, passages can be looked for in the same parse: strings of a shorter length, of whose
cover only spans of more than so many words count. Its runs share the triggers and differ in names and a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.llm.common import materialize

LENGTH = 400
#: A trigger is looked for in so many string starts at most; bytes of the rolling hash, and bytes after a trigger that name a group at least.
REACH, GRAM, DEPTH = 224, 8, 33
#: Bytes of a text that are parsed at once; a run cut there is only compared later, in step 3.
PIECE = 1 << 20
#: Runs a task combines before it hands them on, so that a kind of run comes once from so many; runs of a group that a task compares in memory.
COMBINED, GROUP_RUNS = 1 << 17, 8_000
#: Strings of a piece that larger groups are cut by, round by round.
STEPS = (16, 1)
BATCH = 128
#: A repeated passage has more words than this, and its strings are so long: 51 words take more bytes in 98 of 100 cases.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 256
#: A packed run: first start from bit FIRST, the mark of the passages' strings, eight bits to the trigger and eight to the last start.
FIRST, SHORT = 17, 1 << 16

#: The same of words: they reach less far, since a string has fewer of them.
WORD_REACH, WORD_GRAM, WORD_DEPTH = 40, 2, 12

_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_GAP = re.compile(rb"[\x09-\x0D\x20]")
_TABLE = np.random.default_rng(4).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Names of any slice of some bytes, by prefix sums of a polynomial hash modulo 2^64."""

    _up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        """values: one odd number for each sign."""
        n = len(values)
        if len(Rolling._up) <= n:
            Rolling._up, Rolling._down = _powers(_BASE, 2 * n + 2), _powers(pow(_BASE, -1, 1 << 64), 2 * n + 2)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Rolling._up[:n], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * Rolling._down[a]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


class Bytes:
    """Texts as strings of bytes."""

    reach, gram, depth = REACH, GRAM, DEPTH

    def __init__(self, data: bytes):
        self.data, self.values = data, _TABLE[np.frombuffer(data, np.uint8)]

    def part(self, a: int, b: int) -> bytes:
        return self.data[a:b]

    def spans(self, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return found


class Words:
    """Texts as strings of words, which white space parts; a span of words goes from its first byte to its last."""

    reach, gram, depth = WORD_REACH, WORD_GRAM, WORD_DEPTH

    def __init__(self, data: bytes):
        self.data, parts, at = data, [], 0
        while at < len(data):  # so long a piece that it ends between words
            end = len(data)
            if at + PIECE < end and (gap := _GAP.search(data, at + PIECE)):
                end = gap.start()
            parts.append((at, *self._cut(np.frombuffer(data, np.uint8, end - at, at))))
            at = end
        some = lambda k, kind: np.concatenate([p[k] if k == 3 else p[k] + p[0] for p in parts]) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.values = some(1, np.int64), some(2, np.int64), some(3, np.uint64)

    @staticmethod
    def _cut(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.diff(np.concatenate([[0], _INK[piece].view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        return starts, ends, Rolling(_TABLE[piece])(starts, ends) | np.uint64(1)

    def part(self, a: int, b: int) -> bytes:
        return self.data[int(self.starts[a]) : int(self.ends[b - 1])]

    def spans(self, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(int(self.starts[a]), int(self.ends[b - 1])) for a, b in found]


def parse(text: Bytes | Words, *lengths: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of a text for strings of each length, piece by piece: (place of the length, group name, own name, first start, trigger, last start)."""
    whole, longest, reach, gram = text.values, max(lengths), min(text.reach, min(lengths) - text.depth + 1), text.gram
    for begin in range(0, len(whole) - min(lengths) + 1, PIECE):
        part = whole[begin : begin + PIECE + longest - 1]
        name = Rolling(part)
        at = np.arange(len(part) - gram + 1)
        low = (name(at, at + gram) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        width = 1
        while width < reach:
            step = min(width, reach - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        for which, length in enumerate(lengths):
            starts = min(len(part) - length + 1, PIECE)
            if starts < 1:
                continue
            trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[:starts]
            first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
            last, t = np.append(first[1:], len(trigger)) - 1, trigger[first]
            group = name(t, t + length - reach + 1) + np.uint64(which) * np.uint64(0xA0761D6478BD642F)
            own = name(first, last + length) + (t - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            yield which, group.view(np.int64), own.view(np.int64), first + begin, t + begin, last + begin


def combined(k: np.ndarray, own: np.ndarray, key: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Runs of a task, those that are alike as one with their number.

    The others of a kind are known to be repeated, so they need no group: they get a weight of 0 and a k of their own.
    """
    order = np.lexsort((run, key, own, k))
    k, own, key, run = k[order], own[order], key[order], run[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (own[1:] != own[:-1])))
    weight = np.zeros(len(k), np.int32)
    weight[first] = np.diff(np.append(first, len(k)))
    apart = key.view(np.uint64) * np.uint64(_BASE) + run.view(np.uint64) * np.uint64(0x94D049BB133111EB)
    k = np.where(weight > 0, k, (apart ^ (apart >> np.uint64(29))).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (k, own, key, run, weight)], ["k", "own", "key", "run", "weight"])


def runs(docs: DataFrame, *lengths: int, units: type = Bytes) -> DataFrame:
    """(k, own, key, run, weight) of all texts; key names the row (doc_id and text), run packs first start, the mark of a second length, trigger and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own_text = units((text.as_py() or "").encode())
                if len(own_text.values) < min(lengths):
                    continue
                for which, g, own, a, t, b in parse(own_text, *lengths):
                    found.append((g, own, np.full(len(g), key, np.int64), (a << FIRST) | (which * SHORT) | ((t - a) << 8) | (b - a)))
                    size += len(g)
                if size >= COMBINED:
                    yield combined(*[np.concatenate(c) for c in zip(*found, strict=True)])
                    found, size = [], 0
        if found:
            yield combined(*[np.concatenate(c) for c in zip(*found, strict=True)])

    return docs.select("_key", "text").mapInArrow(run, "k long, own long, key long, run long, weight int")


def covered(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint [from, to) of ranges [n, 2], joined where they touch or overlap."""
    if not len(ranges):
        return []
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(r[:, 1])
    new = np.flatnonzero(np.append(True, r[1:, 0] > ends[:-1]))
    return list(zip(r[new, 0].tolist(), ends[np.append(new[1:] - 1, len(r) - 1)].tolist(), strict=True))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans narrowed so that no UTF-8 character is cut."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


PASSAGES = [("n_passages", pa.int64()), ("n_passage_bytes", pa.int64())]
DIGEST = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def digest(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    return len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()


def spans_of(runs_: list[int], length: int, short: bool = False) -> list[tuple[int, int]]:
    """What the strings of packed runs cover: of the first length, or of the second."""
    r = np.array(runs_, np.int64)
    r = r[(r & SHORT != 0) == short] if len(r) else r
    return covered(np.stack([r >> FIRST, (r >> FIRST) + (r & 255) + length], 1) if len(r) else np.zeros((0, 2), np.int64))


def over(data: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Those spans that have more than so many words; a word cut by an end counts."""
    return [(a, b) for a, b in spans if len(data[a:b].split()) > words] if words else spans


def compare(open_rows: DataFrame, lengths: tuple[int, ...], units: type = Bytes, group_runs: int = GROUP_RUNS, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(key, run): string starts of open runs that are repeated, packed as runs, by comparing the strings of a group.

    A group too large for a task is cut into smaller ones: its runs into pieces of steps[0] strings that lie alike about the trigger,
    named by what all strings of a piece share. Pieces whose name is their own alone end there, the others are compared again; with a step of 1 a name
    is a string.
    """
    longer, shorter, step = lengths[0], lengths[-1], steps[0]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, sent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = units(text.encode())
                for s in sent:
                    a, n, mark = s["run"] >> FIRST, s["run"] & 255, s["run"] & (SHORT | 255 << 8)
                    out.append((s["k"], key, (a << FIRST) | mark, n, s["alone"], own.part(a, a + n + (shorter if mark & SHORT else longer))))
            for a in range(0, len(out), 4096):
                cols = list(zip(*out[a : a + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["k", "key", "first", "n", "alone", "bytes"])

    def names(rows: list[tuple], step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Name, row, offset and size of every piece: the strings of a run whose distances to the trigger are alike but for the last step.

        What all strings of such distances share lies in each of them, so a piece at a run's end has the same name as a whole one.
        """
        values = [units(r[5]).values for r in rows]
        at = np.cumsum([0] + [len(v) for v in values])[:-1]
        last, trigger = np.array([r[3] for r in rows]), np.array([(r[2] >> 8) & 255 for r in rows])
        length = np.array([len(v) for v in values]) - last
        row = np.repeat(np.arange(len(rows)), last + 1)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
        start = at[row] + offset
        if step > 1:
            distance = trigger[row] - offset
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (distance[1:] // step != distance[:-1] // step)))
            size = np.diff(np.append(first, len(row)))
            row, offset = row[first], offset[first]
            start = at[row] + trigger[row] - distance[first] // step * step
        else:
            size = np.ones(len(row), np.int64)
        return Rolling(np.concatenate(values))(start, start + length[row] - step + 1), row, offset, size

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of one or more whole groups."""
        group = np.array([r[0] for r in rows], np.int64)
        name, row, offset, _ = names(rows)
        order = np.lexsort((name, group[row]))
        g, h = group[row][order], name[order]
        same = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(h), bool)
        hit[order] = twice
        hit &= np.array([r[4] for r in rows])[row]
        if hit.any():
            r, s = row[hit], offset[hit]
            begin = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)))
            end = np.append(begin[1:] - 1, len(r) - 1)
            first = np.array([x[2] for x in rows])[r[begin]] & ~(255 << 8)
            keys = np.array([x[1] for x in rows])[r[begin]]
            none = pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(first + (s[begin] << FIRST) + s[end] - s[begin]), none, none, pa.nulls(len(begin), pa.bool_())], out_names)

    out_names = ["key", "run", "k", "name", "alone"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group. A group that outgrows the buffer is handed on in pieces."""
        held: list[tuple] = []
        wide = None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wide is not None and r[0] != wide:
                    yield from spread(held)
                    wide, held = None, []
                if wide is None and len(held) >= group_runs and r[0] != held[-1][0]:
                    yield from settle(held)
                    held = []
                held.append(r)
                if wide is not None and len(held) >= 4096:
                    yield from spread(held)
                    held = []
                elif wide is None and len(held) >= 2 * group_runs:  # one large group, perhaps behind others
                    wide = r[0]
                    rest = [x for x in held if x[0] != wide]
                    if rest:
                        yield from settle(rest)
                    yield from spread([x for x in held if x[0] == wide])
                    held = []
        if held:
            yield from (spread(held) if wide is not None else settle(held))

    def spread(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            name, row, offset, size = names(part, step)
            run = np.array([x[2] for x in part])[row] + (offset << FIRST) - (offset << 8) + size - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x[1] for x in part])[row]), pa.array(run), pa.array(np.array([x[0] for x in part], np.int64)[row]), pa.array(name.view(np.int64)), pa.array(np.array([x[4] for x in part])[row])], out_names)

    sent = open_rows.select("_key", "text", "_sent").mapInArrow(contexts, "k long, key long, first long, n int, alone boolean, bytes binary")
    n = int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sent.repartition(n, "k").sortWithinPartitions("k").mapInArrow(within, "key long, run long, k long, name long, alone boolean")
    found = materialize(found, "suffix-found")
    done, wide = found.where("k is null").select("key", "run"), found.where("k is not null")
    twice = wide.groupBy("k", "name").agg(F.count("*").alias("n")).where("n > 1").select("k", "name")
    wide = wide.join(twice, ["k", "name"], "left_semi")
    if step == 1:
        return done.union(wide.where("alone").select("key", "run"))
    sent = wide.groupBy("key").agg(F.collect_list(F.struct(F.xxhash64("k", "name").alias("k"), "run", "alone")).alias("_sent"))
    sent = materialize(open_rows.select("_key", "text").join(sent.withColumnRenamed("key", "_key"), "_key"), "suffix-wide")
    return done if sent.isEmpty() else done.union(compare(sent, lengths, units, group_runs, steps[1:]))


def repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True, passages: tuple[int, int] | None = None, units: type = Bytes) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, and kept (what is left, as bytes) unless texts is False.

    A byte goes if a string of length bytes covers it that also starts anywhere else: in another text, or
    elsewhere in the same one; overlaps count. Strings are judged on the input, and never cross texts.
    With units=Words, length counts words, and what goes are whole words and the white space between them.
    With passages (bytes, words), n_passages and n_passage_bytes tell of the repeated passages of more words than that,
    found as strings of so many bytes; they remove nothing.
    Nulls: a null text is an empty one; a null doc_id is a value like any other. Rows that repeat doc_id
    and text repeat each other and lose everything if they have length bytes. Texts shorter than length
    lose nothing. Columns of docs named like the results are replaced; names starting with _ are reserved.
    An empty table gives an empty result.
    """
    more = PASSAGES if passages else []
    lengths = (length, passages[0]) if passages else (length,)
    names = [*[n for n, _ in DIGEST + more], "kept"]
    docs = docs.drop(*[c for c in names if c in docs.columns])
    cols = docs.columns
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    group, kind = Window.partitionBy("k"), Window.partitionBy("k", "own")
    r = runs(keyed, *lengths, units=units)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = r.repartition(n, "k").withColumn("in_group", F.sum("weight").over(group)).where("in_group > 1 or weight = 0")
    r = r.withColumn("alike", F.sum("weight").over(kind)).withColumn("nth", F.row_number().over(kind.orderBy("key", "run")))
    r = r.withColumn("any_alone", (F.min(F.when(F.col("weight") > 0, F.col("alike"))).over(group) == 1) & (F.col("weight") > 0)).withColumn("alone", F.col("alike") == 1)
    by_key = r.groupBy("key").agg(
        F.collect_list(F.when(~F.col("alone"), F.col("run"))).alias("_whole"),
        F.collect_list(F.when(F.col("any_alone") & (F.col("nth") == 1), F.struct("k", "run", "alone"))).alias("_sent"),
    )
    # a text's own runs: as many as its length allows
    joined = keyed.join(by_key.withColumnRenamed("key", "_key"), "_key", "left")
    text_at = 1 + cols.index("text")
    schema = keyed.select("_key", *cols).schema
    kinds = "array<struct<k:bigint,run:bigint,alone:boolean>>"
    finish = {"schema": schema, "cols": cols, "text_at": text_at, "length": length, "texts": texts, "passages": passages, "units": units}
    first_pass = materialize(_finish(joined.select("_key", *cols, "_whole", "_sent"), more=f", _sent {kinds}, _whole array<bigint>", **finish), "suffix-pass")
    open_rows = first_pass.where(F.size("_sent") > 0)
    found = compare(open_rows, lengths, units).groupBy("key").agg(F.collect_list("run").alias("_more"))
    again = open_rows.join(found.withColumnRenamed("key", "_key"), "_key", "left").withColumn("_whole", F.concat(F.coalesce("_whole", F.array()), F.coalesce("_more", F.array())))
    second = _finish(again.select("_key", *cols, "_whole", F.lit(None).cast(kinds).alias("_sent")), more="", **finish)
    out = [*[c for c in cols if c != "text" or texts], *[x for x, _ in DIGEST + more], *(["kept"] if texts else [])]
    return first_pass.where(F.size("_sent") == 0).select(*out).union(second.select(*out))


def _finish(rows: DataFrame, schema, cols: list[str], text_at: int, length: int, texts: bool, passages: tuple[int, int] | None, units: type, more: str) -> DataFrame:
    """Apply the runs known so far. With more, rows that have runs to compare keep text and runs for the next pass."""
    results = DIGEST + (PASSAGES if passages else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                out, kept, sent, whole, text = [], [], [], [], []
                for t, w, s in zip(batch.column(text_at).to_pylist(), batch.column(len(cols) + 1).to_pylist(), batch.column(len(cols) + 2).to_pylist(), strict=True):
                    data, later = t.encode(), bool(more and s)
                    spans = [] if later or not w else units(data).spans(spans_of(w, length))
                    told = ()
                    if passages and not later:
                        long = over(data, spans_of(w, passages[0], True), passages[1]) if w else []
                        told = len(long), sum(b - a for a, b in long)
                    out.append((None,) * len(results) if later else digest(data, spans) + told)
                    kept.append(None if later or not texts else without(data, whole_characters(data, spans)))
                    sent.append(s if later else [])
                    whole.append(w if later else [])
                    text.append(t if later or texts else "")
                arrays = [batch.column(i) for i in range(1 + len(cols))]
                arrays[text_at] = pa.array(text, batch.schema.field(text_at).type)
                arrays += [pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), results, strict=True)]
                arrays.append(pa.array(kept, pa.binary()))
                if more:
                    arrays += [pa.array(sent, batch.schema.field(len(cols) + 2).type), pa.array(whole, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    told = ", n_passages long, n_passage_bytes long" if passages else ""
    extra = f"n_bytes long, n_removed long, n_spans long, kept_sha256 string{told}, kept binary" + more
    names = ["_key", *cols, *[x for x, _ in results], "kept", *(["_sent", "_whole"] if more else [])]
    return rows.mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL(extra).fields]))


def word_repeats(docs: DataFrame, words: int = PASSAGE_WORDS + 1) -> DataFrame:
    """docs without their repeated passages: every word that a string of so many words covers which also starts anywhere else, in any document, is cut.

    Words are what white space parts, compared as they are written; white space between words may differ. What is cut goes from the first
    byte of a passage to its last. All rows and columns stay, whatever the columns are called; n_chars, where there is one, is the new
    length. Nulls, repeated rows, short texts and empty tables as in repeats(): a null text becomes an empty one; any other that loses nothing stays as it is.
    """
    apart = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = repeats(docs.withColumnsRenamed(apart), words, units=Words)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    kinds, back = dict(docs.dtypes), []
    for c in docs.columns:
        if c == "text":
            back.append(text.alias("text"))
        elif c == "n_chars":
            back.append(F.when(F.col("n_removed") > 0, F.char_length(text).cast(kinds[c])).otherwise(F.col(apart[c])).alias(c))
        else:
            back.append(F.col(apart.get(c, c)).alias(c))
    return cut.select(*back)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs, texts=False, passages=(PASSAGE_BYTES, PASSAGE_WORDS))
