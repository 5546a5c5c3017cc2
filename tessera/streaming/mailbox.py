"""The mailbox as streams: queue of requests, liveness, status changes, sessions, progress.

Each operator has a form that runs on a stream and a batch form with the same
result; the batch forms work on whole tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import saved

REQUEST = "id string, kind string, tree string, selection string, question string, reply_to string, session string, action string, trail array<string>, progress array<string>, created timestamp"
STATUS = "id string, state string, message string, at timestamp"
#: Caps of a request, seconds until a watcher is stale, states that end a request.
MOST_TEXT, MOST_TRAIL, MOST_PROGRESS, STALE_SECONDS = 4000, 12, 200, 90
ENDED = ("done", "error")


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of request files."""
    return spark.readStream.schema(REQUEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "request.json").json(folder)


def clipped(requests: DataFrame, known: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Requests with long texts and lists cut; ids that are not ``known(id)`` are dropped, order kept.

    On a stream this is done in ``foreachBatch`` (see ``watch``).  Ids are
    looked up by a join; only the lists go through it.
    """
    cut = lambda c: F.substring(c, 1, MOST_TEXT).alias(c)
    lists = {"trail": MOST_TRAIL, "progress": MOST_PROGRESS}
    out = requests.select(*[cut(c) if c in ("selection", "question") else F.col(c) for c in requests.columns])
    if known is None:
        return out.select(*[F.slice(c, 1, lists[c]).alias(c) if c in lists else F.col(c) for c in out.columns])

    def placed(c: str):
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("list"), i.alias("pos"), x.alias("known_id")))

    each = F.concat(*[placed(c) for c in lists])
    rows = requests.select(F.col(key).alias("_key"), F.explode(each).alias("x")).select("_key", "x.*").join(known.select(F.col("id").alias("known_id")).distinct(), "known_id", "left_semi")
    kept = rows.groupBy("_key").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("pos", "known_id")))), lambda x: x["known_id"]).alias(f"_{c}") for c in lists])
    none = F.array().cast("array<string>")
    joined = out.join(kept, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col(c).isNotNull(), F.slice(F.coalesce(F.col(f"_{c}"), none), 1, lists[c])).alias(c) if c in lists else F.col(c) for c in out.columns])


def unhandled(requests: DataFrame, statuses: DataFrame) -> DataFrame:
    """Requests without any status."""
    return requests.join(statuses.select("id").distinct(), "id", "left_anti")


def next_request(requests: DataFrame, statuses: DataFrame, by: str = "id", per: str | None = None) -> DataFrame:
    """The first unhandled request, or that of each ``per``; none gives no row."""
    free = unhandled(requests, statuses)
    if per is None:
        return free.orderBy(by).limit(1)
    return free.groupBy(per).agg(F.min_by(F.struct(*[c for c in free.columns if c != per]), F.struct(by, "id")).alias("r")).select(per, "r.*")


def watch(spark: SparkSession, requests: DataFrame, status_folder: str, work, checkpoint: str, seconds: float = 480, every: str = "2 seconds", known: DataFrame | None = None) -> int | None:
    """Handle a stream of requests until some were handled or the time is over; returns how many (None if none came).

    A request without a status is claimed first, by a status written to
    ``status_folder``, then ``work(rows)`` gets the claimed requests, then their
    end is written: who is lost between the two leaves a claim to be seen, and
    a batch that runs again does not work on them twice.  ``work`` returns
    ``(id, state, message)``.
    """
    handled = []

    def written(rows: DataFrame) -> None:
        rows.select("id", "state", "message", F.current_timestamp().alias("at")).write.mode("append").parquet(status_folder)

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        said = session.read.schema(STATUS).parquet(status_folder) if _exists(session, status_folder) else session.createDataFrame([], STATUS)
        todo = saved(clipped(unhandled(rows, said), known))  # what is claimed below must not change it
        if n := todo.count():
            written(todo.select("id", F.lit("claimed").alias("state"), F.lit(None).cast("string").alias("message")))
            written(work(todo))
            handled.append(n)

    query = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        left = seconds
        while left > 0 and not handled and not query.awaitTermination(min(left, 0.5)):
            left -= 0.5
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return sum(handled) or None


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def liveness(beats: DataFrame, now, key: str = "user_id", ts: str = "ts", seconds: int = STALE_SECONDS) -> DataFrame:
    """``key, last, alive``: alive where the last heartbeat is less than ``seconds`` before ``now`` (a column)."""
    last = beats.groupBy(key).agg(F.max(ts).alias("last"))
    return last.withColumn("alive", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) < seconds * 1_000_000)


def live_stream(beats: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    """``user_id, alive, at``: a row when a watcher comes alive and when it falls silent, by event time; ``beats(user_id, ts)`` with a watermark."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[0]
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "alive": [False], "at": [pd.Timestamp(at, unit="ms") + pd.Timedelta(seconds=seconds)]})
            return
        newest = max(f["ts"].max() for f in frames)
        known = state.exists
        last = max(state.get[0], int(newest.timestamp() * 1000)) if known else int(newest.timestamp() * 1000)
        state.update((last,))
        state.setTimeoutTimestamp(last + seconds * 1000)
        if not known:
            yield pd.DataFrame({"user_id": [key[0]], "alive": [True], "at": [newest]})

    return beats.groupBy("user_id").applyInPandasWithState(step, "user_id long, alive boolean, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def status_changes(statuses: DataFrame, key: str = "id", state: str = "state", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Rows whose state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return statuses.withColumn("before", before).where(~F.col(state).eqNullSafe(F.col("before")))


def status_stream(statuses: DataFrame) -> DataFrame:
    """``id, state, ended``: a row when a request's state changes; what follows an end is dropped."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for s in rows["state"]:
            if s != last and last not in ENDED:
                out.append((key[0], s, s in ENDED))
                last = s
        held.update((last,))
        yield pd.DataFrame(out, columns=["id", "state", "ended"])

    return statuses.groupBy("id").applyInPandasWithState(step, "id string, state string, ended boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def session_log(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question, answer, reply``: each user turn with the assistant turn before and the next one after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("question", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("reply", F.first(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return rows.where("role = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"), "reply")


def session_stream(events: DataFrame, questions: int = 3) -> DataFrame:
    """``slug, status, turn``: tutor sessions by actions start, answer, pause and resume; done after ``questions`` answers.  ``events(slug, action, at)``."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, turn = held.get if held.exists else (None, 0)
        out = []
        for action in pd.concat(list(frames)).sort_values("at", kind="stable")["action"]:
            status, turn = advance(status, turn, action, questions)
            out.append((key[0], status, turn))
        held.update((status, turn))
        yield pd.DataFrame(out, columns=["slug", "status", "turn"])

    return events.groupBy("slug").applyInPandasWithState(step, "slug string, status string, turn int", "status string, turn int", "append", GroupStateTimeout.NoTimeout)


def session_states(events: DataFrame, questions: int = 3, key: str = "slug") -> DataFrame:
    """``key, status, turn``: where each session stands after all its actions, ``events(key, action, at)``; a session is a few actions."""
    actions = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "action"))), lambda x: x["action"]).alias("actions"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("turn"))

    def step(s, a):
        to = lambda status, turn: F.struct(F.lit(status).cast("string").alias("status"), turn.alias("turn"))
        return (
            F.when((a == "start") & s["status"].isNull(), to("active", F.lit(1)))
            .when((a == "answer") & (s["status"] == "active"), F.when(s["turn"] >= questions, to("done", s["turn"])).otherwise(to("active", s["turn"] + 1)))
            .when((a == "pause") & (s["status"] == "active"), to("paused", s["turn"]))
            .when(a.isin("start", "resume") & (s["status"] == "paused"), to("active", s["turn"]))
            .otherwise(s)
        )

    return actions.select(key, F.aggregate("actions", start, step).alias("s")).select(key, "s.status", "s.turn")


def advance(status: str | None, turn: int, action: str, questions: int = 3) -> tuple[str | None, int]:
    """A session's state after an action; actions that don't fit leave it."""
    if action == "start" and status is None:
        return "active", 1
    if action == "answer" and status == "active":
        return ("done", turn) if turn >= questions else ("active", turn + 1)
    if action == "pause" and status == "active":
        return "paused", turn
    if action in ("start", "resume") and status == "paused":
        return "active", turn
    return status, turn


def progress_marks(marks: DataFrame) -> DataFrame:
    """``user_id, id``: what each user has mastered after the last reset; ``marks(user_id, id, action, at)`` with action mark, unmark or reset."""
    resets = marks.where("action = 'reset'").groupBy("user_id").agg(F.max("at").alias("reset"))
    rest = marks.where("action != 'reset'").join(resets, "user_id", "left").where("reset is null or at > reset")
    last = rest.groupBy("user_id", "id").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    return last.where("action = 'mark'").select("user_id", "id")


def windowed_requests(requests: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """``start, n``: requests in tumbling windows; with ``late`` the stream has a watermark."""
    rows = requests.withWatermark("ts", late) if late else requests
    return rows.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
