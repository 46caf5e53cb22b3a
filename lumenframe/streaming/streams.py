"""Streams: incremental scans, admission by rate limits, and event-time windows."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.functions.media import WINDOWS
from lumenframe.operators.scans import Ordered
from lumenframe.sources.shared import written

ADMITTED = "provider string, request_id long, ts_us long, granted boolean, wait_s double, limit_name string"
WAITS = "provider string, at_us long, waiting boolean, until_us long, limit_name string"
SECOND = 1_000_000


class Windows:
    """One provider's sliding windows: for each capped one, the times at which its last grants leave it.

    A window of capacity c is full exactly while the c-th last grant is still inside, so a queue of c times is all there
    is to know of it, and a request costs a look at each queue's head. Queues hold a time for every grant, equal ones too.
    """

    def __init__(self, limits: dict[str, int], leaves: dict[str, Iterable[int]] | None = None):
        self.queues = {name: deque((leaves or {}).get(name) or (), maxlen=limits[name]) for name in WINDOWS if limits.get(name)}

    def grant(self, t: int) -> None:
        for name, leaves in self.queues.items():
            leaves.append(t + WINDOWS[name] * SECOND)

    def opening(self, now: int) -> tuple[int, str | None]:
        """When all windows have room again and which is the last to, or (now, None) if they have it already."""
        full = [(q[0], name) for name, q in self.queues.items() if len(q) == q.maxlen and q[0] > now]
        return max(full, key=lambda x: x[0]) if full else (now, None)

    def leaves(self, now: int | None = None) -> dict[str, list[int]]:
        """The queues, without what has left by `now`."""
        return {name: [t for t in q if now is None or t > now] for name, q in self.queues.items()}


def _decisions(pdf: pd.DataFrame, windows: Windows) -> pd.DataFrame:
    """Requests in time order through a provider's windows; refused ones take no room."""
    pdf = pdf.sort_values(["ts_us", "request_id"], ignore_index=True)
    found = []
    for now in pdf["ts_us"].tolist():
        at, limit = windows.opening(now)
        if limit is None:
            windows.grant(now)
        found.append(((at - now) / 1e6, limit))
    waits, names = zip(*found, strict=True) if found else ((), ())
    return pdf[["provider", "request_id", "ts_us"]].assign(granted=[n is None for n in names], wait_s=list(waits), limit_name=list(names))


def episodes(requests: DataFrame, limits: dict[str, dict[str, int]]) -> DataFrame:
    """requests of capped providers with `episode`: 1 more wherever the provider was idle for as long as its widest capped window.
    No grant before reaches across such a gap. Both the request before and the count are prefix scans over time ranges."""
    widest = {p: max(WINDOWS[w] for w in WINDOWS if own.get(w)) * SECOND for p, own in limits.items() if any(own.get(w) for w in WINDOWS)}
    rows = requests.where(F.col("provider").isin(*widest)).select("provider", "request_id", "ts_us")
    gap = reduce(lambda c, p: c.when(F.col("provider") == p, widest[p]), widest, F)
    log = Ordered(rows, ["provider"], ["ts_us", "request_id"]).add(before={"__before": F.col("ts_us")})
    idle = F.coalesce(F.col("ts_us") - F.col("__before") >= gap, F.lit(True)).cast("long")
    return log.add(sums={"episode": idle}).rows().drop("__before")


def admit(requests: DataFrame, limits: dict[str, dict[str, int]]) -> DataFrame:
    """Batch admission of requests(provider, request_id, ts_us): a fold in time order for each episode of a provider.

    Providers without a cap need no fold: their requests are granted where they lie. Episodes are independent, so a busy
    provider's log is many tasks wherever it has idle gaps, and passes through in sorted Arrow batches: a task holds one batch and the
    windows, not the log. What has no gap is one fold, for there each decision depends on the one before.
    """
    capped = [p for p, own in limits.items() if any(own.get(name) for name in WINDOWS)]
    free = requests.where(F.col("provider").isNull() | ~F.col("provider").isin(capped)) if capped else requests
    free = free.select("provider", "request_id", "ts_us", F.lit(True).alias("granted"), F.lit(0.0).alias("wait_s"), F.lit(None).cast("string").alias("limit_name"))
    if not capped:
        return free

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, own = None, None
        for pdf in batches:
            for key, part in pdf.groupby(["provider", "episode"], sort=False):
                if key != own:
                    windows, own = Windows(limits[key[0]]), key
                yield _decisions(part, windows)

    rows = episodes(requests, limits)
    return rows.repartition("provider", "episode").sortWithinPartitions("provider", "episode", "ts_us", "request_id").mapInPandas(fold, ADMITTED).unionByName(free)


class Admission(StatefulProcessor):
    """A provider's windows as keyed state. A timer at the time at which the last grant leaves its last window forgets the provider;
    for the waiting view a timer at the end of a wait says that it is over."""

    def __init__(self, limits: dict[str, dict[str, int]], view: bool):
        self.limits, self.view = limits, view

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", ", ".join(f"{name} array<long>" for name in WINDOWS))
        self.wait = handle.getValueState("wait", "until long, name string")

    def _windows(self, provider) -> Windows:
        kept = self.state.get() if self.state.exists() else None
        return Windows(self.limits.get(provider) or {}, dict(zip(WINDOWS, kept, strict=True)) if kept else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows = self._windows(key[0])
        decisions = _decisions(pd.concat(list(rows)), windows)
        leaves = windows.leaves()
        if any(leaves.values()):
            self.state.update(tuple(leaves.get(name, []) for name in WINDOWS))
            self.handle.registerTimer(-(-max(max(q) for q in leaves.values() if q) // 1000))
        if not self.view:
            yield decisions
            return
        yield self._view(key[0], decisions)

    def _view(self, provider, decisions: pd.DataFrame) -> pd.DataFrame:
        """Where a wait begins or moves, and where a grant ends it."""
        until, name = self.wait.get() if self.wait.exists() else (None, None)
        found = []
        for r in decisions.itertuples():
            end = None if r.granted else r.ts_us + round(r.wait_s * SECOND)
            if end != until:
                until, name = end, r.limit_name
                found.append((provider, r.ts_us, end is not None, end, name))
        if until is None:
            self.wait.clear()
        else:
            self.wait.update((until, name))
            self.handle.registerTimer(-(-until // 1000))
        return pd.DataFrame(found, columns=[c.split()[0] for c in WAITS.split(", ")]).astype({"until_us": "Int64", "waiting": bool, "at_us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.view and self.wait.exists() and self.wait.get()[0] <= now:
            until, _ = self.wait.get()
            self.wait.clear()
            yield pd.DataFrame([(key[0], until, False, None, None)], columns=[c.split()[0] for c in WAITS.split(", ")]).astype({"until_us": "Int64"})
        if self.state.exists() and not any(self._windows(key[0]).leaves(now).values()):
            self.state.clear()

    def close(self) -> None:
        pass


def _keyed(requests: DataFrame, limits: dict[str, dict[str, int]], late: str, view: bool) -> DataFrame:
    rows = requests.select("provider", "request_id", "ts_us", F.timestamp_micros("ts_us").alias("at")).withWatermark("at", late)
    return rows.groupBy("provider").transformWithStateInPandas(Admission(limits, view), WAITS if view else ADMITTED, "append", "eventTime")


def admit_stream(requests: DataFrame, limits: dict[str, dict[str, int]], late: str = "1 minute") -> DataFrame:
    """The same on a stream whose batches follow each other in time; needs the RocksDB state store. Requests that come later than `late` behind
    the newest are dropped, and so is what isn't after the epoch, where watermarks begin."""
    return _keyed(requests, limits, late, False)


def waiting_stream(requests: DataFrame, limits: dict[str, dict[str, int]], late: str = "1 minute") -> DataFrame:
    """WAITS: when a provider begins to wait and until when, and when that is over, by the next grant or by the time itself."""
    return _keyed(requests, limits, late, True)


def waiting(decisions: DataFrame, now_us: int) -> DataFrame:
    """(provider, seconds, limit) of the providers whose last decision still makes them wait."""
    last = decisions.groupBy("provider").agg(F.max_by(F.struct("ts_us", "granted", "wait_s", "limit_name"), F.struct("ts_us", "request_id")).alias("d"))
    left = (F.col("d.ts_us") - now_us) / 1e6 + F.col("d.wait_s")
    return last.where(~F.col("d.granted") & (left > 0)).select("provider", F.round(left, 1).alias("seconds"), F.col("d.limit_name").alias("limit"))


def tumbling_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by, n) of fixed windows. A timestamp without a time zone is cast: watermarks need one."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__ts", late)
    return rows.groupBy(F.window("__ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n) of runs of events no farther apart than the gap."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__ts", late)
    out = rows.groupBy(by, F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each content once, and none that seen(sha1) has."""
    out = files.dropDuplicates(["sha1"])
    return out if seen is None else out.join(seen.select("sha1"), "sha1", "left_anti")


class FirstSeen(StatefulProcessor):
    """A content's key as state: its first row passes, no later one does."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "met boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:
                pass
            return
        first = next(rows).head(1)
        for _ in rows:
            pass
        self.seen.update((True,))
        yield first[self.columns]

    def close(self) -> None:
        pass


def first_seen_stream(files: DataFrame, seen_path: str, apply, checkpoint: str):
    """apply(new rows, batch id) over a stream of files(sha1, ...), each content once in all runs.

    The contents met are keyed state, so a batch looks up its own keys and reads no others. They are also a table at `seen_path`, which a new
    checkpoint starts from; a batch's keys are stored under the stream's name and its id after it was applied, so a batch that runs again replaces its own.
    """
    spark = files.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(seen_path)
    known = spark.createDataFrame([], "sha1 string")
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        known = spark.read.schema("sha1 string").parquet(seen_path).distinct()
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    new = files.groupBy("sha1").transformWithStateInPandas(FirstSeen(files.columns), files.schema, "append", "none", initialState=known.groupBy("sha1"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch, "first-seen")
        apply(batch, batch_id)
        batch.select("sha1").write.mode("overwrite").parquet(f"{seen_path}/stream={name}/batch={batch_id}")

    query = new.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def scan_stream(listings: DataFrame, apply, checkpoint: str, files_per_batch: int | None = None):
    """Run apply(batch DataFrame, batch id) over a stream of listings until all is read; idempotent applies make restarts safe."""
    query = listings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
