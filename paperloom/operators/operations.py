"""Jobs, retries, rate limits, health and provider fallback over event tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import lexicons as L

# What a permanent error's message holds. Any other error is tried again.
PERMANENT = ["validation", "corrupted", "not_found", "permission", "unauthorized"]


def _window_map(times: np.ndarray, width: int, limit: int, fresh: bool) -> dict[str, np.ndarray]:
    """What becomes of a counter over a sorted stretch of one key's times, for every place where its first own start can be.

    A counter that comes in began before the stretch, so its successor starts at one of the times within `width` of the
    first, or the one after; a stretch that nothing comes into (fresh) starts at its first. Of each such place: its time,
    how many rows are before it, and from there on the starts, the rejected rows, the last start and its use. Each time's
    successor is known by a search; the chain of all of them is followed by doubling.
    """
    n = len(times)
    after = np.searchsorted(times, times + width)
    rejected = np.maximum(0, after - np.arange(n) - limit)
    starts, jump = np.ones(n, np.int64), np.append(after, n)
    starts, rejected = np.append(starts, 0), np.append(rejected, 0)
    last = np.append(np.where(after < n, after, np.arange(n)), n)
    while (jump[:n] < n).any():
        starts, rejected, jump = starts + starts[jump], rejected + rejected[jump], jump[jump]
        last = last[last]
    at = np.arange(1 if fresh else min(n, int(np.searchsorted(times, times[0] + width)) + 1))
    return {"time": times[at], "before": at, "starts": starts[at], "rejected": rejected[at], "since": times[last[at]], "used": np.minimum(limit, n - last[at])}


def rate_limited(requests: DataFrame, key: str, time: str, order: str, limit: int = 30, seconds: float = 60) -> DataFrame:
    """key, n_requests, n_rejected, n_windows: a counter per key that starts anew at the first request `seconds` or more after its last start.

    Rows are dealt by ranges of (key, time, order), so a key of any size is spread over tasks. What a counter does in a
    range depends on the start that it comes in with: a task sends on its range's map from incoming to outgoing start and
    counts, which has as many rows as lie within `seconds` of its begin, and one row for every other key. A key's maps
    are then applied in order. Of one key's rows in a range the times are held. Rows without a key are left out.
    """
    width = round(seconds * 1_000_000)
    kind = dict(requests.dtypes)[key]
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(name, part, held, first) -> pd.DataFrame:
            times = np.concatenate(held)
            return pd.DataFrame({"k": name, "part": part, "n": len(times), **_window_map(times, width, limit, not first)})

        now, held, first = None, [], True
        for batch in batches:
            for name, own in batch.groupby("k", sort=False):
                if held and name != now:
                    yield told(now, part, held, first)
                    held, first = [], False
                now, part = name, own["part"].iloc[0]
                held.append(own["t"].to_numpy())
        if held:
            yield told(now, part, held, first)

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "n_requests", "n_rejected", "n_windows"]
        now, place, since, used, counts, rest = None, -1, None, 0, [0, 0, 0], 0  # rest: rows of the range that are not told of yet

        def closed() -> None:  # a range without an own start
            nonlocal used
            allowed = min(rest, limit - used)
            counts[1] += rest - allowed
            used += allowed

        for batch in batches:
            done = []
            for name, part, n, time_, before, starts, rejected, last, use in batch[["k", "part", "n", "time", "before", "starts", "rejected", "since", "used"]].itertuples(index=False, name=None):
                if name != now or part != place:
                    closed()
                    if name != now:
                        done += [(now, *counts)] if counts[0] else []
                        now, since, used, counts = name, None, 0, [0, 0, 0]
                    place, rest = part, n
                    counts[0] += n
                if rest and (since is None or time_ - since >= width):
                    rest = before
                    closed()
                    counts[1], counts[2], since, used, rest = counts[1] + rejected, counts[2] + starts, last, use, 0
            yield pd.DataFrame(done, columns=names)
        closed()
        yield pd.DataFrame([(now, *counts)] if counts[0] else [], columns=names)

    rows = requests.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    ranged = rows.repartitionByRange(parts, "k", "t", "o").sortWithinPartitions("k", "t", "o").select("k", "t", F.spark_partition_id().alias("part"))
    maps = ranged.mapInPandas(mapped, f"k {kind}, part int, n long, time long, before long, starts long, rejected long, since long, used long")
    return maps.repartition("k").sortWithinPartitions("k", "part", "before").mapInPandas(applied, f"{key} {kind}, n_requests long, n_rejected long, n_windows long")


def due_retries(jobs: DataFrame, time: str, order: str, now: Column) -> DataFrame:
    """The jobs whose next try's time has come, in the order in which they are taken up; ties by `order`."""
    return jobs.filter(F.col(time) <= now).orderBy(time, order)


def retry_times(events: DataFrame, job: str, time: str, event: str, most: int = 3) -> DataFrame:
    """job, retries, due of every retry whose time comes before the job's next event: a failure is tried again 10, 20, 40 seconds later and so on (see backoff), up to the most failures since the last success.

    events: fail, succeed or others, which only put a retry off. One window for each job, whose rows are its own history.
    """
    by_job = Window.partitionBy(job).orderBy(time, event)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withColumn("epoch", F.sum((F.col(event) == "succeed").cast("int")).over(by_job.rowsBetween(Window.unboundedPreceding, -1)))
    failures = F.sum((F.col(event) == "fail").cast("int")).over(Window.partitionBy(job, F.coalesce("epoch", F.lit(0))).orderBy(time, event).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("retries", failures.cast("int")).withColumn("next", F.lead(time).over(by_job))
    due = F.timestamp_micros(F.unix_micros(time) + (backoff(F.col("retries")) * 1_000_000).cast("long"))
    rows = rows.filter((F.col(event) == "fail") & (F.col("retries") <= most)).withColumn("due", due)
    return rows.filter(F.col("next").isNull() | (F.col("next") >= F.col("due"))).select(job, "retries", "due")


def stale_checks(requests: DataFrame, key: str, time: str, order: str, seconds: float = 30) -> DataFrame:
    """key, n_asked, n_checks: how often a service is looked at anew, if a request does so once the last look is more than `seconds` ago."""
    counted = rate_limited(requests, key, time, order, limit=1, seconds=seconds + 1e-6)
    return counted.select(key, F.col("n_requests").alias("n_asked"), F.col("n_windows").alias("n_checks"))


def request_kind(path: Column, exempt: Sequence[str] = tuple(L.EXEMPT_PATHS), strict: Sequence[str] = tuple(L.STRICT_PATHS)) -> Column:
    """exempt, strict (counted by the limit) or open, by a request's path."""
    own = F.rtrim(path, F.lit("/"))
    return F.when(own.isin(*exempt), "exempt").when(reduce(lambda a, b: a | b, [own.startswith(s) for s in strict]), "strict").otherwise("open")


def client_of(forwarded: Column, host: Column) -> Column:
    """The first address of X-Forwarded-For, else the host."""
    return F.coalesce(F.nullif(F.btrim(F.element_at(F.split(forwarded, ","), 1)), F.lit("")), host)


def latest_state(events: DataFrame, key: str, time: str, order: str, *columns: str) -> DataFrame:
    """The columns of each key's last row by (time, order): map-side combined, no sort."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, order)).alias("x"), F.count("*").alias("n_events"))
    return last.select(key, "n_events", "x.*")


def progress(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def retryable(error: Column, attempts: Column, most: Column | int = 3) -> Column:
    """Whether a failed job is tried again: not for permanent errors, which outweigh others, nor beyond the most retries; unknown errors are."""
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.coalesce(error, F.lit(""))), w))
    return (attempts < most) & ~has(PERMANENT)


def backoff(attempts: Column) -> Column:
    """Seconds to the next try, after the count went up: 5 * 2 ** n, at most 300."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), attempts) * 5)


def first_success(tries: DataFrame, request: str, priority: str, text: str, provider: str) -> DataFrame:
    """request, provider, text of the first provider by priority whose text is not blank; null if all fail."""
    good = F.when(F.btrim(F.coalesce(F.col(text), F.lit(""))) != "", F.struct(priority, provider, text))
    return tries.groupBy(request).agg(F.min(good).alias("x"), F.count("*").alias("n_providers")).select(request, "n_providers", f"x.{provider}", f"x.{text}")


def health(reachable: Column, total: Column) -> Column:
    return F.when(reachable == total, "online").when(reachable == 0, "offline").otherwise("degraded")


def error_kind(status: Column, strict: Column | bool = False, ready: Column | bool = True) -> Column:
    """The kind of a provider's error by HTTP status (null: no reply): config if it is not ready to be asked, auth, unavailable, or null for success. strict: a provider that answers 400 to a wrong key."""
    of = lambda x: F.lit(x) if isinstance(x, bool) else x
    return F.when(~of(ready), "config").when(status.between(200, 299), None).when(status.isin(401, 403) | (of(strict) & (status == 400)), "auth").otherwise("unavailable")


def error_text(c: Column, most: int = 2000) -> Column:
    """An error as a job keeps it."""
    return F.substring(c, 1, most)
