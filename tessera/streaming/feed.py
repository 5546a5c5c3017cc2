"""The live feed of requests, liveness by the clock, and sessions scanned for what changed."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pages import changed_since
from .mailbox import ENDED, STALE_SECONDS, _exists

#: Signals of a feed in their order where times are equal, and what a feed is made of.
SIGNALS = ("answer", "status", "watcher")
FEED = "session string, n long, event string, data string, at timestamp"


# The feed: signals(session, at, signal, data, state) in, events out

def feed_of(signals: DataFrame) -> DataFrame:
    """``session, n, event, data, at``: the events that a page is sent, numbered from 1 in each session.

    ``signals(session, at, signal, data, state)``: a status (with its state), a
    sign of the watcher, or the answer's text.  Signals stand in order of time,
    then answer, status and watcher, then data and state, null first.  A status
    is sent when its data differ from those of the status before.  The first
    one that is done sends the answer too, the last text up to then or an empty
    one; it, or one in error, sends done, after which nothing follows.  Signals
    without a session, time or known name are dropped.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col("signal"))
    order = ["at", "rank", F.col("data").asc_nulls_first(), F.col("state").asc_nulls_first()]
    w = Window.partitionBy("session").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("session").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    is_status, ends = F.col("signal") == "status", F.coalesce(F.col("state").isin(*ENDED), F.lit(False))
    status = F.when(is_status, F.struct(F.col("data").alias("data")))  # in a struct, a null is a value
    rows = signals.where(F.col("session").isNotNull() & F.col("at").isNotNull() & F.col("signal").isin(*SIGNALS)).withColumn("rank", rank)
    rows = rows.withColumn("ended", F.coalesce(F.max(is_status & ends).over(before), F.lit(False))).withColumn("seen", F.last(status, ignorenulls=True).over(before)).withColumn("answer", F.last(F.when(F.col("signal") == "answer", F.coalesce("data", F.lit(""))), ignorenulls=True).over(w))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    new = F.col("seen").isNull() | ~F.col("seen.data").eqNullSafe(F.col("data"))
    sent = F.filter(F.array(
        F.when(is_status & new, event("status", F.col("data"))), F.when(is_status & (F.col("state") == "done"), event("answer", F.coalesce("answer", F.lit("")))),
        F.when(is_status & ends, event("done", F.lit("{}"))), F.when(F.col("signal") == "watcher", event("watcher", F.col("data"))),
    ), lambda e: e.isNotNull())
    many = F.sum(F.size(sent)).over(before)
    rows = rows.where("not ended").withColumn("sent", sent)
    rows = rows.withColumn("first", F.coalesce(many, F.lit(0))).select("session", "at", "first", F.posexplode("sent").alias("pos", "e"))
    return rows.select("session", (F.col("first") + F.col("pos") + 1).cast("long").alias("n"), "e.event", "e.data", "at")


class Fold:
    """One session's feed, signal by signal in their order: the same as ``feed_of`` of all of them."""

    def __init__(self, held: str = "{}"):
        self.held = {"n": 0, "seen": False, "last": None, "answer": "", "ended": False, "wait": []} | json.loads(held)

    def step(self, at: int, signal: str, data: str | None, state: str | None) -> list[tuple]:
        h, out = self.held, []
        if h["ended"]:
            return []
        if signal == "answer":
            h["answer"] = data or ""
        elif signal == "watcher":
            out.append(("watcher", data))
        else:
            if not h["seen"] or h["last"] != data:
                out.append(("status", data))
            h |= {"seen": True, "last": data, "ended": state in ENDED}
            if state == "done":
                out.append(("answer", h["answer"]))
            if h["ended"]:
                out.append(("done", "{}"))
        h["n"] += len(out)
        return [(h["n"] - len(out) + k + 1, event, data, at) for k, (event, data) in enumerate(out)]


def feed_stream(signals: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``feed_of`` on a stream: many sessions, each in order, numbered on from batch to batch.

    A signal waits in its session's state until the watermark has passed its
    time, so signals that come out of order by less than ``late`` are put in
    order first.  The state of a session is what has not been sent yet, the
    last status and answer, and a number; an ended session holds its end only.
    """
    rank = {s: k for k, s in enumerate(SIGNALS)}

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(state.get[0]) if state.exists else Fold()
        wait = fold.held["wait"]
        if not state.hasTimedOut:
            for frame in frames:
                rows = frame[["us", "signal", "data", "state"]].astype(object).where(frame[["us", "signal", "data", "state"]].notna(), None)
                wait += [[int(us), *rest] for us, *rest in rows.itertuples(index=False)]
        passed = state.getCurrentWatermarkMs() * 1000
        due = sorted((w for w in wait if w[0] < passed), key=lambda w: (w[0], rank[w[1]], w[2] is not None, w[2] or "", w[3] is not None, w[3] or ""))
        out = [event for w in due for event in fold.step(*w)]
        fold.held["wait"] = [] if fold.held["ended"] else [w for w in wait if w[0] >= passed]
        state.update((json.dumps(fold.held),))
        if fold.held["wait"]:
            state.setTimeoutTimestamp(max(min(w[0] for w in fold.held["wait"]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": [key[0]] * len(out), "n": [e[0] for e in out], "event": [e[1] for e in out], "data": pd.Series([e[2] for e in out], dtype=object), "at": pd.to_datetime([e[3] for e in out], unit="us")})

    known = signals.where(F.col("session").isNotNull() & F.col("at").isNotNull() & F.col("signal").isin(*SIGNALS)).withWatermark("at", late)
    rows = known.select("session", "at", F.unix_micros("at").alias("us"), "signal", "data", "state")
    return rows.groupBy("session").applyInPandasWithState(run, FEED, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def write_feed(feed: DataFrame, folder: str, checkpoint: str, **trigger):
    """The feed as Parquet, each event once: the file sink and the checkpoint together make a batch that runs again write nothing twice."""
    return feed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


# Liveness by the clock

#: State with timers needs this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watchers(StatefulProcessor):
    """A row when a watcher comes alive and one when it falls silent, by a timer that each sign of life puts off."""

    def __init__(self, seconds: int):
        self.most = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(f["ms"].max()) for f in rows)
        known = self.last.get()[0] if self.last.exists() else None
        if newest + self.most <= timerValues.getCurrentProcessingTimeInMs() or known is not None and newest <= known:
            return  # no sign of life that still counts
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.most)
        if known is None:
            yield pd.DataFrame({"watcher": [key[0]], "alive": [True], "at": [pd.Timestamp(newest, unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"watcher": [key[0]], "alive": [False], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def watcher_stream(beats: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    """``watcher, alive, at``: who comes alive and who falls silent, for ``beats(watcher, ts)``.

    A watcher is alive until ``seconds`` after its last beat.  Its end is
    reported when the clock gets there: no further beat, of it or of another,
    is needed.  A beat older than that is no sign of life.  The session must
    use the state store named by ``STATE_STORE``.
    """
    rows = beats.where("watcher is not null and ts is not null").select("watcher", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("watcher").transformWithStateInPandas(Watchers(seconds), "watcher string, alive boolean, at timestamp", "Append", "processingTime")


# Sessions

def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """``session, file, mtime, text``: state and notes of each session folder with their times of change, in milliseconds."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{state.json,notes.md}").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))
    named = rows.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("session"), "file", "mtime", "text")
    return named.where(F.col("session").rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*$"))


def scan_sessions(spark: SparkSession, folder: str, revisions: str) -> DataFrame:
    """``session, rev, updated, state, notes``: the sessions that changed since the last scan.

    A revision is the two times of change.  Those of the sessions returned are
    added to the table at ``revisions`` first, by one commit, and the rows are
    those that it got: a scan that fails before it reports all again, and none
    is left out.  A file that is missing is null.
    """
    now = int(time.time() * 1000)
    rows = read_sessions(spark, folder)
    held = spark.read.parquet(revisions) if _exists(spark, revisions) else spark.createDataFrame([], "session string, rev string, run long")
    last = held.groupBy("session").agg(F.max_by("rev", "run").alias("rev"), F.max("run").alias("run"))
    run = max(now, (last.agg(F.max("run")).first()[0] or 0) + 1)
    changed_since(rows, last).withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(revisions)
    changed = spark.read.parquet(revisions).where(F.col("run") == run).select("session", "rev")
    text = lambda name: F.max(F.when(F.col("file") == name, F.col("text")))
    whole = rows.groupBy("session").agg((F.max("mtime") / 1000).cast("timestamp").alias("updated"), text("state.json").alias("state"), text("notes.md").alias("notes"))
    return changed.join(whole, "session").select("session", "rev", "updated", "state", "notes")
