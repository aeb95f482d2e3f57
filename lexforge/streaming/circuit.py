"""Circuit breaker of providers: connection failures in a row open it for a while; rate limits and retired models close a provider for good.

The state of a key is its streak of failures and until when it is closed. It is the same fold over a key's calls in the order of
their times, whether they come from a table or from a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Failures in a row that open the circuit, and for how many seconds.
THRESHOLD, COOL_DOWN = 2, 300
#: Kinds of calls: what ends a streak, what adds to it, and what closes a provider for good.
SUCCESS, CONNECTION, FATAL = "success", "connection", ("rate_limit", "decommissioned")
FOREVER = 1 << 62
#: Kinds by number, 0 for all others; rows that the stream hands on at once.
KINDS = (None, SUCCESS, CONNECTION, *FATAL)
CODES, PIECE = {k: i for i, k in enumerate(KINDS) if k}, 10_000
OUT = "key string, call_id long, outcome string, streak int"
STATE = "streak int, closed_until long"


def step(streak: int, until: int, at: int, kind: str | None, threshold: int = THRESHOLD, cool_down: int = COOL_DOWN) -> tuple[str, int, int]:
    """(outcome, streak, closed until) after a call at a time in microseconds.

    skipped: the provider is closed, so the call is not made and counts for nothing. opened: this call closes it. A closing that has run out
    also ends the streak. Kinds that are not known leave the streak as it is.
    """
    if until:
        if at < until:
            return "skipped", streak, until
        streak = 0
    if kind in FATAL:
        return "opened", streak, FOREVER
    if kind == CONNECTION:
        streak += 1
        return ("opened", streak, at + cool_down * 1_000_000) if streak >= threshold else ("failed", streak, 0)
    return "passed", 0 if kind == SUCCESS else streak, 0


def calls_of(rows: DataFrame) -> DataFrame:
    """rows (key, call_id, at, kind) with at in microseconds; calls without a key or time are left out."""
    return rows.where("key IS NOT NULL AND at IS NOT NULL").select(F.col("key").cast("string"), F.col("call_id").cast("long"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("kind").cast("string"))


def run_table(rows: DataFrame, threshold: int = THRESHOLD, cool_down: int = COOL_DOWN) -> DataFrame:
    """(key, call_id, outcome, streak) of every call of a table, by time, then call_id. A key's calls stream through its task; only its state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, streak, until = None, 0, 0
        for batch in batches:
            out = []
            for key, call, at, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != here:
                    here, streak, until = key, 0, 0
                outcome, streak, until = step(streak, until, at, kind, threshold, cool_down)
                out.append((outcome, streak))
            if out:
                outcomes, streaks = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(outcomes), pa.array(streaks, pa.int32())], ["key", "call_id", "outcome", "streak"])

    return calls_of(rows).repartition("key").sortWithinPartitions("key", "at", "call_id").mapInArrow(run, OUT)


def run_stream(rows: DataFrame, threshold: int = THRESHOLD, cool_down: int = COOL_DOWN) -> DataFrame:
    """The same of a stream: each micro-batch's calls go on from the state that a key had. Calls of one batch are put in order; a batch that comes later is later.

    A key's calls of one batch are held in its task, as three arrays of numbers; files of a batch are limited by the source (maxFilesPerTrigger).
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, 0)
        # a call waits for its turn as 17 bytes: only the kinds that change anything are told apart
        parts = [(f["at"].to_numpy(), f["call_id"].to_numpy(), f["kind"].map(CODES).fillna(0).to_numpy(np.int8)) for f in frames]
        at, call, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((call, at))
        for begin in range(0, len(order), PIECE):
            piece, out = order[begin : begin + PIECE], []
            for t, c, k in zip(at[piece].tolist(), call[piece].tolist(), kind[piece].tolist(), strict=True):
                outcome, streak, until = step(streak, until, t, KINDS[k], threshold, cool_down)
                out.append((key[0], c, outcome, streak))
            if begin + PIECE >= len(order):
                state.update((streak, until))
            yield pd.DataFrame(out, columns=["key", "call_id", "outcome", "streak"])

    return calls_of(rows).groupBy("key").applyInPandasWithState(fold, StructType.fromDDL(OUT), StructType.fromDDL(STATE), "append", GroupStateTimeout.NoTimeout)
