"""The circuit breaker's rules, and the stream's rows against the table's."""

import datetime as dt

from pyspark.sql import functions as F

from lexforge.streaming import circuit

ROWS = "key string, call_id long, at timestamp, kind string"


def fold(*calls, **how):
    streak, until, out = 0, 0, []
    for second, kind in calls:
        outcome, streak, until = circuit.step(streak, until, second * 1_000_000, kind, **how)
        out.append((outcome, streak))
    return out


def test_two_failures_in_a_row_open_for_300_seconds():
    c, s = "connection", "success"
    assert fold((0, c), (1, s), (2, c), (3, c), (302, s), (303, c), (304, s)) == [("failed", 1), ("passed", 0), ("failed", 1), ("opened", 2), ("skipped", 2), ("failed", 1), ("passed", 0)]
    assert fold((0, c), (9999, c), (10000, c)) == [("failed", 1), ("opened", 2), ("skipped", 2)]
    assert fold((0, c), (1, "other"), (2, None), (3, c)) == [("failed", 1), ("passed", 1), ("passed", 1), ("opened", 2)]
    assert fold((0, c), (1, c), (2, s), (400, "other"), (401, c), threshold=2, cool_down=10)[2:] == [("skipped", 2), ("passed", 0), ("failed", 1)]


def test_rate_limits_close_for_good():
    assert fold((0, "rate_limit"), (10**9, "success")) == [("opened", 0), ("skipped", 0)] and fold((0, "decommissioned"))[0][0] == "opened"


def calls(n):
    start = dt.datetime(2024, 1, 1)
    kinds = ["connection", "connection", "success", "other", None, "connection"]
    return [(None if i % 29 == 0 else f"k{i * i % 5}", i, None if i % 31 == 0 else start + dt.timedelta(seconds=i * 37 % 9000), "rate_limit" if i == 333 else kinds[i * 7 % 11 % 6]) for i in range(n)]


def test_stream_and_table_give_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame(calls(600), ROWS)
    want = sorted(map(tuple, circuit.run_table(rows).collect()))
    assert len(want) == sum(k is not None and t is not None for k, _, t, _ in calls(600)) and {r[2] for r in want} == {"failed", "opened", "skipped", "passed"}
    # three batches, one after the other in time
    for i, part in enumerate(("at < '2024-01-01 00:50:00'", "at >= '2024-01-01 00:50:00' AND at < '2024-01-01 01:40:00'", "at >= '2024-01-01 01:40:00'")):
        rows.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/*")
        circuit.run_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_a_large_batch_is_handed_on_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(circuit, "PIECE", 7)
    rows = spark.createDataFrame(calls(300), ROWS)
    rows.repartition(3).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/*")
    circuit.run_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, circuit.run_table(rows).collect()))


def test_no_calls(spark):
    assert circuit.run_table(spark.createDataFrame([], ROWS)).count() == 0
    assert circuit.calls_of(spark.createDataFrame([("a", 1, None, "x")], ROWS)).where(F.lit(True)).count() == 0
