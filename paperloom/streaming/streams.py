"""Structured Streaming forms: counts by window and session, incremental ingest, rate limits and job states."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from paperloom.functions import text as T
from paperloom.operators import metadata, pipelines
from paperloom.sources import readers


def windows(events: DataFrame, time: str, key: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, key, n_events, total: counts by window, streaming or not; with a slide shorter than the width an event is in several."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(window, key).agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n_events", "total")


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windows that do not overlap."""
    return windows(events, time, key, width, late=late)


def sessions(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n_events")).select(F.col("session_window.start").alias("start"), key, "n_events")


def distinct_texts(documents: DataFrame, time: str, text: str, late: str = "1 day") -> DataFrame:
    """Documents whose text did not come before within the watermark."""
    return documents.withColumn("text_hash", T.text_hash(F.col(text))).withWatermark(time, late).dropDuplicatesWithinWatermark(["text_hash"])


def ingest(documents: DataFrame, path: str, checkpoint: str, id_column: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Append documents with texts that the table at path does not have. A batch's own repeats keep the least id; a batch that is run again adds nothing.

    The table's folders are dealt by the first three digits of the hash, of which a batch reads only those it meets.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("text_hash", T.text_hash(F.col(text))).filter(F.col("text_hash").isNotNull()).withColumn("hash_bucket", F.concat(F.lit("h"), F.substring("text_hash", 1, 3)))
        least = rows.groupBy("text_hash").agg(F.min_by(F.struct(*rows.columns), id_column).alias("x")).select("x.*").persist()
        met = [r["hash_bucket"] for r in least.select("hash_bucket").distinct().collect()]  # 4,096 at most
        try:
            known = spark.read.parquet(path).filter(F.col("hash_bucket").isin(met)).select("text_hash")
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "text_hash string")
        least.join(known, "text_hash", "left_anti").write.mode("append").partitionBy("hash_bucket").parquet(path)
        least.unpersist()

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def uploads(spark: SparkSession, path: str, papers_path: str, chunks_path: str, checkpoint: str, extract: Callable[[bytes], list[str]]) -> StreamingQuery:
    """Take in PDF files as they come to a folder: files without a problem are read by `extract`, and their texts are papers of the source local, whose id is a hash of their path. A batch that is run again replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        found = readers.full_texts(readers.extracted_pages(readers.with_problems(batch), extract))
        raw = found.select(F.xxhash64("path").alias("id"), "title", F.array_compact(F.array("authors")).alias("authors"), F.lit("local").alias("source"), F.col("path").alias("source_id"), "full_text", "n_pages")
        pipelines.ingest(metadata.normalized(raw).withColumn("id", F.xxhash64("source_id")), papers_path, chunks_path, batch=number)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").load(path)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limits(requests: DataFrame, key: str, time: str, limit: int = 30, seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """key, time, allowed of every request: the state of a key is the time of its counter's start and the count, and ends once event time has passed the counter's end.

    Only event time counts: a stream that is replayed faster or slower, or pauses, gives the same rows. late: how far
    rows may lag behind the latest one (the watermark); of a key's rows of one batch only the times are held.
    """
    width = seconds * 1_000_000

    def judge(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, used = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([batch[time].to_numpy().astype("datetime64[us]").astype(np.int64) for batch in batches]))
        allowed, i = np.zeros(len(times), bool), 0
        while i < len(times):
            if since is None or times[i] - since >= width:
                since, used = int(times[i]), 0
            j = int(np.searchsorted(times, since + width))
            allowed[i : i + max(0, limit - used)] = True
            allowed[j:] = False
            used = min(limit, used + j - i)
            i = j
        state.update((since, used))
        state.setTimeoutTimestamp(max((since + width) // 1000, state.getCurrentWatermarkMs() + 1))
        for i in range(0, len(times), 10_000):
            yield pd.DataFrame({key: name[0], time: times[i : i + 10_000].astype("datetime64[us]"), "allowed": allowed[i : i + 10_000]})

    schema = f"{key} {dict(requests.dtypes)[key]}, {time} timestamp, allowed boolean"
    return requests.select(key, time).withWatermark(time, late).groupBy(key).applyInPandasWithState(judge, schema, "since long, used long", "append", GroupStateTimeout.EventTimeTimeout)


TRANSITIONS = {"start": "running", "succeed": "succeeded", "fail": "failed", "retry": "retrying", "queue": "queued"}


def job_states(events: DataFrame, key: str, most_retries: int = 3, late: str = "0 seconds") -> DataFrame:
    """key, status, retries, delay after each batch of a job's events (event, ts): failures are tried again up to the most, after 10, 20, 40 seconds and so on, at most 300.

    A job that has succeeded, or failed for good, is forgotten when event time is a day past its last event; any other is
    kept. Of its rows of one batch the times and events are held.
    """

    def move(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, retries = state.get if state.exists else ("queued", 0)
        delay: Any = None
        held = [(batch["ts"].to_numpy(), pd.Categorical(batch["event"])) for batch in batches]
        events = np.concatenate([np.asarray(c.categories, object)[c.codes] for _, c in held])
        times = np.concatenate([t for t, _ in held])
        for event in events[np.argsort(times, kind="stable")]:
            status = TRANSITIONS.get(event, status)
            delay = None
            if status == "failed" and retries < most_retries:
                retries += 1
                status, delay = "retrying", min(5 * 2**retries, 300)
        state.update((status, retries))
        if status in ("succeeded", "failed"):
            state.setTimeoutTimestamp(max(int(times.max().astype("datetime64[ms]").astype(np.int64)) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]], "status": [status], "retries": [retries], "delay": [delay]})

    schema = f"{key} {dict(events.dtypes)[key]}, status string, retries int, delay double"
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(move, schema, "status string, retries int", "update", GroupStateTimeout.EventTimeTimeout)


class RetryTimers(StatefulProcessor):
    """A job's failures since its last success and when it is due, with a timer that tells of the retry once event time has come to it."""

    def __init__(self, job: str, most: int) -> None:
        self.job, self.most = job, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "failures int, due long")

    def _told(self, key: tuple, rows: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({self.job: [key[0]] * len(rows), "retries": [n for n, _ in rows], "due": pd.to_datetime([due for _, due in rows], unit="us")})

    def _keep(self, failures: int, due: int) -> None:
        if failures or due:
            self.state.update((failures, due))
        elif self.state.exists():
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        failures, due = self.state.get() if self.state.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")
        out, first = [], due
        for event, at in zip(batch["event"].tolist(), batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist(), strict=True):
            if due and at >= due:
                out.append((failures, due))
            due = 0  # told of, or put off by this event
            failures = 0 if event == "succeed" else failures + (event == "fail")
            if event == "fail" and failures <= self.most:
                due = at + min(5 * 2**failures, 300) * 1_000_000
        if first and first != due:
            self.handle.deleteTimer(-(-first // 1000))
        if due and first != due:
            self.handle.registerTimer(-(-due // 1000))
        self._keep(failures, due)
        yield self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, due = self.state.get() if self.state.exists() else (0, 0)
        if due and -(-due // 1000) == expiredTimerInfo.getExpiryTimeInMs():
            self._keep(failures, 0)
            yield self._told(key, [(failures, due)])

    def close(self) -> None:
        pass


def retries(events: DataFrame, job: str, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """job, retries, due of each retry of a stream of events (event, ts), as operations.retry_times gives them for a table: a row comes when event time has passed its due.

    Whatever the batches, the rows are the same, as long as none lags behind the watermark. The session's state store must
    be RocksDB (spark.sql.streaming.stateStore.providerClass), as Spark asks for with timers. A job without failures and
    retries has no state. Of a job's rows of one batch the times and events are held.
    """
    schema = f"{job} {dict(events.dtypes)[job]}, retries int, due timestamp"
    rows = events.select(job, "event", "ts").withWatermark("ts", late).groupBy(job)
    return rows.transformWithStateInPandas(RetryTimers(job, most), schema, "Append", "EventTime")
