"""The feed as a stream with a restart, liveness by the clock, sessions scanned again."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import feed

SIGNALS = "session string, at timestamp, signal string, data string, state string"


def signals(n=400, seed=3):
    rng, out = random.Random(seed), []
    for i in range(n):
        session, kind = f"s{rng.randrange(12)}", rng.choice(["status", "status", "watcher", "answer", "other"])
        state = rng.choice(["claimed", "working", "working", "done", "error"]) if rng.random() < 0.1 else "working"
        data = rng.choice([None, "a", "b"]) if kind != "answer" else rng.choice([None, "", f"text {i}"])
        out.append((rng.choice([session, session, session, None]) if i % 50 == 0 else session, f"2024-01-01 00:{i // 60:02d}:{rng.choice([i % 60, i % 60, i // 2 % 60]):02d}.5", kind, data, state if kind == "status" else None))
    return out


def brute(rows):
    """Signal by signal."""
    sessions = {}
    for session, at, kind, data, state in rows:
        if session is not None and kind in feed.SIGNALS:
            sessions.setdefault(session, []).append((at, feed.SIGNALS.index(kind), data is not None, data or "", state is not None, state or ""))
    out = []
    for session, own in sessions.items():
        last, answer, sent = (), "", []
        for at, k, some, data, _, state in sorted(own):
            if k == 0:
                answer = data
            elif k == 2:
                sent.append(("watcher", data if some else None, at))
            else:
                if last != (some, data):
                    sent.append(("status", data if some else None, at))
                last = (some, data)
                if state == "done":
                    sent.append(("answer", answer, at))
                if state in ("done", "error"):
                    sent.append(("done", "{}", at))
                    break
        out += [(session, n, *e) for n, e in enumerate(sent, 1)]
    return out


def rows_of(df):
    return sorted(((r.session, r.n, r.event, r.data, f"{r.at:%Y-%m-%d %H:%M:%S}.5") for r in df.collect()), key=lambda r: r[:2])


def test_feed_batch(spark):
    rows = signals()
    df = spark.createDataFrame(rows, "session string, at string, signal string, data string, state string").withColumn("at", F.to_timestamp("at")).repartition(5)
    assert rows_of(feed.feed_of(df)) == sorted(brute(rows), key=lambda r: r[:2])
    assert feed.feed_of(df.limit(0)).count() == 0


def test_feed_stream_with_a_restart(spark, tmp_path):
    """Files in three lots, a query stopped between them, signals out of order: the same events as over all at once, each once."""
    rows = signals()
    folder, names = tmp_path / "in", ["session", "at", "signal", "data", "state"]
    folder.mkdir()
    lots = [rows[:120], rows[120:260], [*rows[260:], ("end", "2024-01-02 00:00:00", "watcher", "x", None), ("end", "2024-01-01 23:00:00", "watcher", "x", None)]]
    for k, lot in enumerate(lots):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in lot))
        stream = spark.readStream.schema(SIGNALS).json(str(folder))
        query = feed.write_feed(feed.feed_stream(stream, "70 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.processAllAvailable() if query.isActive else None
        query.awaitTermination(120)
        assert query.exception() is None
    got = [r for r in rows_of(spark.read.parquet(str(tmp_path / "out"))) if r[0] != "end"]
    assert got == sorted(brute(rows), key=lambda r: r[:2])


def test_silent_watchers_are_reported(spark, tmp_path):
    """No further beat comes, of anyone: the clock alone ends a watcher."""
    name, provider = feed.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    (tmp_path / "in").mkdir()

    def beat(file, *rows):
        text = "\n".join(json.dumps({"watcher": w, "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(at)) + f".{int(at % 1 * 1000):03d}Z"}) for w, at in rows)
        (tmp_path / f"{file}.tmp").write_text(text)
        os.rename(tmp_path / f"{file}.tmp", tmp_path / "in" / f"{file}.json")

    try:
        beats = spark.readStream.schema("watcher string, ts timestamp").json(str(tmp_path / "in"))
        query = feed.watcher_stream(beats, seconds=8).writeStream.format("memory").queryName("alive").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
        began = time.time()
        beat("1", ("a", began), ("b", began), ("old", began - 100), ("a", began - 3))
        until = time.time() + 40
        while time.time() < until and spark.table("alive").count() < 2:
            time.sleep(0.3)
        again = time.time()
        beat("2", ("b", again))
        while time.time() < until and spark.table("alive").count() < 4:
            time.sleep(0.3)
        assert query.exception() is None
        got = [(r.watcher, r.alive, r.at.timestamp()) for r in spark.table("alive").collect()]
        assert sorted(g[:2] for g in got) == [("a", False), ("a", True), ("b", False), ("b", True)]
        ends = {w: at for w, alive, at in got if not alive}
        assert abs(ends["a"] - began - 8) < 0.01 and abs(ends["b"] - again - 8) < 0.01
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_sessions_scanned_again(spark, tmp_path):
    folder, held = tmp_path / "sessions", str(tmp_path / "revisions")
    for name in ("one", "two", "three", "bad name"):
        (folder / name).mkdir(parents=True)
        (folder / name / "state.json").write_text(f'{{"status": "{name}"}}')
        (folder / name / "other.txt").write_text("x")
    (folder / "two" / "notes.md").write_text("## n\n")
    scan = lambda: {r.session: (r.state, r.notes) for r in feed.scan_sessions(spark, str(folder), held).collect()}
    assert scan() == {n: (f'{{"status": "{n}"}}', "## n\n" if n == "two" else None) for n in ("one", "two", "three")}
    assert scan() == {}
    (folder / "two" / "notes.md").write_text("## new\n")
    os.utime(folder / "two" / "notes.md", (1_700_000_000, 1_700_000_000))
    (folder / "four").mkdir()
    (folder / "four" / "notes.md").write_text("only notes")
    os.remove(folder / "three" / "state.json")
    (folder / "three" / "notes.md").write_text("3")
    assert scan() == {"two": ('{"status": "two"}', "## new\n"), "four": (None, "only notes"), "three": (None, "3")}
    assert scan() == {}


@pytest.fixture(autouse=True)
def _no_stream_left(spark):
    yield
    assert not spark.streams.active
