"""Streams against the batch result, in few and in many batches; counters of busy keys against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import operations
from paperloom.streaming import streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def replayed(spark, tmp_path):
    """replayed(df, time, cuts, transform, mode): what a stream gives of df's rows in so many files, one file a batch, with a row far ahead at the end."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(df, time, cuts, transform, mode):
        at = tmp_path / f"in{cuts}"
        values = sorted(df.collect(), key=lambda r: r[time])
        size = -(-len(values) // cuts)
        for i in range(0, len(values), size):
            spark.createDataFrame(values[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(str(at))
        spark.createDataFrame([df.first().asDict() | {time: T0 + dt.timedelta(days=400), "job": -1, "event": "other"}], df.schema).coalesce(1).write.mode("append").parquet(str(at))
        name = f"out{cuts}"
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(at))
        transform(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp{cuts}")).start().awaitTermination(120)
        return spark.table(name).collect()

    yield run
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def jobs(rows, n=60, seed=1):
    r = random.Random(seed)
    at, out = T0, []
    for _ in range(n):
        at += dt.timedelta(seconds=r.choice([1, 4, 15, 30]))
        out.append((r.randrange(4), at, r.choice(["fail", "fail", "succeed", "start"])))
    return rows("job long, ts timestamp, event string", *out)


def test_retries_come_in_event_time_whatever_the_batches(rows, replayed):
    df = jobs(rows)
    want = {tuple(x) for x in operations.retry_times(df, "job", "ts", "event").collect()}
    assert len(want) > 8
    for cuts in (2, 7):
        got = [tuple(x) for x in replayed(df, "ts", cuts, lambda s: streams.retries(s, "job"), "append")]
        assert len(got) == len(want) and set(got) == want


def test_counters_end_by_event_time_whatever_the_batches(rows, replayed):
    df = jobs(rows)
    allowed = {}
    for k in range(4):
        since, used = None, 0
        for ts in sorted(x.ts for x in df.collect() if x.job == k):
            if since is None or (ts - since).total_seconds() >= 60:
                since, used = ts, 0
            allowed[k, ts] = used < 2
            used += used < 2
    for cuts in (1, 6):
        got = replayed(df.drop("event"), "ts", cuts, lambda s: streams.rate_limits(s, "job", "ts", limit=2, seconds=60), "append")
        assert {(x.job, x.ts): x.allowed for x in got if x.job >= 0} == allowed


def test_sliding_windows(rows):
    df = rows("ts timestamp, kind string, value double", (T0 + dt.timedelta(hours=30), "a", 1.0), (T0 + dt.timedelta(hours=1), "a", 2.0))
    got = {(x.start, x.n_events, x.total) for x in streams.windows(df, "ts", "kind", "2 days", "1 day").collect()}
    day = dt.timedelta(days=1)
    assert got == {(T0 - day, 1, 2.0), (T0, 2, 3.0), (T0 + day, 1, 1.0)}


def plain(values, limit, seconds):
    out = {}
    for k in {k for k, *_ in values if k is not None}:
        since, used, n, rejected, windows = None, 0, 0, 0, 0
        for t in sorted(t for x, t, _ in values if x == k):
            if since is None or (t - since).total_seconds() >= seconds:
                since, used, windows = t, 0, windows + 1
            n, rejected, used = n + 1, rejected + (used >= limit), min(limit, used + 1)
        out[k] = (n, rejected, windows)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_busy_key_is_spread_and_counted_right(spark, rows, seed):
    r = random.Random(seed)
    values = [(7 if i % 2 else r.randrange(12), T0 + dt.timedelta(milliseconds=r.choice([r.randrange(3_000_000), 0, 1_500_000])), i) for i in range(3000)] + [(None, T0, 1)]
    df = rows("k long, t timestamp, o long", *values)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for limit, seconds in ((3, 20), (1, 700), (50, 4000)):
            got = {x.k: tuple(x)[1:] for x in operations.rate_limited(df, "k", "t", "o", limit, seconds).collect()}
            assert got == plain(values, limit, seconds)
        shares = df.filter("k = 7").repartitionByRange(9, "k", "t", "o").groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_due_retries_are_in_order_of_their_time(rows):
    df = rows("id long, at timestamp", (1, T0 + dt.timedelta(hours=2)), (2, T0), (3, T0 + dt.timedelta(hours=9)), (4, T0))
    assert [x.id for x in operations.due_retries(df, "at", "id", F.lit(T0 + dt.timedelta(hours=3))).collect()] == [2, 4, 1]


def test_texts_come_once(rows, replayed):
    df = rows("job long, ts timestamp, event string", *[(i, T0 + dt.timedelta(minutes=i), f" text {i % 3}" + " " * (i % 2)) for i in range(9)], (20, T0 + dt.timedelta(minutes=30), None))
    got = replayed(df, "ts", 4, lambda s: streams.distinct_texts(s, "ts", "event"), "append")
    assert sorted(r.job for r in got if r.event and "text" in r.event) == [0, 1, 2]
