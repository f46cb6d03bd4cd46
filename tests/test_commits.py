"""Commits, hook events and hand-backs: together or not at all, once and no more."""

import json
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import commits, holds, ledger
from claimloom.streaming import events, watch


def test_a_version_has_one_writer(spark, tmp_path, monkeypatch):
    log = commits.CommitLog(spark, f"file://{tmp_path}/log")
    assert log.entries() == [] and log.put({"version": 1, "a": "é"}) and not log.put({"version": 1, "a": 2})
    monkeypatch.setattr(log, "_link", lambda own, name: log._rename(own, log._path(name)))  # as on other file systems
    assert log.put({"version": 2}) and not log.put({"version": 2})
    monkeypatch.setattr(commits, "EVERY", 4)
    for v in range(3, 11):
        assert log.put({"version": v})
    assert [e["version"] for e in log.entries()] == list(range(1, 11)) and log.entries()[0]["a"] == "é"
    opened = []
    monkeypatch.setattr(log, "_read", lambda name, read=log._read: opened.append(name) or read(name))
    assert len(log.entries()) == 10 and len(opened) == 3
    assert not [p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".tmp"]


def test_two_writers_share_no_id(spark, tmp_path):
    book, failed = ledger.Ledger(spark, str(tmp_path / "book")), []
    rows = spark.range(40).select(F.format_string("2024-01-01T00:00:%02dZ", "id").alias("ts"), F.lit(1).alias("total"))

    def write():
        try:
            for _ in range(3):
                book.append_runs(rows, ["ts"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert sorted(r["id"] for r in book.read("runs").select("id").collect()) == list(range(1, 241))
    assert ledger.chain_errors(book.read("runs")).count() == 0


def test_a_write_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    runs = spark.createDataFrame([("k1", "2024-01-01T00:00:00Z", 2), ("k2", "2024-01-02T00:00:00Z", 1)], "k string, ts string, total int")
    claims = spark.createDataFrame([("k2", 0, "tagged", "c"), ("k1", 1, "supported", "b"), ("k1", 0, "unsupported", "a")], "k string, pos int, status string, claim_text string")
    book.log_runs(runs, claims, "k", ["ts"])
    stage = ledger.Ledger._stage

    def dies(self, name, rows):
        if name == "claims":
            raise RuntimeError("killed")
        return stage(self, name, rows)

    monkeypatch.setattr(ledger.Ledger, "_stage", dies)
    with pytest.raises(RuntimeError):
        book.log_runs(runs, claims, "k", ["ts"])
    assert (book.read("runs").count(), book.read("claims").count()) == (2, 3)
    monkeypatch.setattr(ledger.Ledger, "_stage", stage)
    monkeypatch.setattr(commits.CommitLog, "put", lambda self, entry: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        book.log_runs(runs, claims, "k", ["ts"])
    monkeypatch.undo()
    assert (book.read("runs").count(), book.read("claims").count()) == (2, 3)
    book.log_runs(runs, claims, "k", ["ts"])
    got = [tuple(r) for r in book.read("claims").orderBy("id").select("id", "run_id", "claim_text", "ts").collect()]
    one, two = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"
    assert got == [(1, 1, "a", one), (2, 1, "b", one), (3, 2, "c", two), (4, 3, "a", one), (5, 3, "b", one), (6, 4, "c", two)]
    assert ledger.chain_errors(book.read("runs")).count() == 0 and set(book.tables()) == set(ledger.SCHEMAS)


LINES = [
    {"type": "user", "message": {"content": "x"}}, {"type": "assistant", "message": {"content": "In 2019 it rose 12%. "}},
    {"type": "assistant", "message": {"content": [{"type": "text", "text": "It must be 2020."}, {"type": "tool_use"}, 3, {"type": "text", "text": "Source: https://x.y"}]}},
    {"type": "assistant", "message": {"content": [{"type": "tool_use"}]}}, {"type": "tool"},
]


def said(text, **more):
    return json.dumps({"hook_event_name": "PostToolUse", "session_id": "s", "tool_input": {"file_path": "/f", "content": text}, **more})


EVENTS = [
    said("Revenue rose 12% in 2019. Nothing else."), said("Nothing."), "", "  ", "{broken", "[1]", "5",
    json.dumps({"hook_event_name": "Stop", "session_id": "s", "transcript_path": "/t"}), json.dumps({"hook_event_name": "Stop", "stop_hook_active": True, "transcript_path": "/t"}),
    json.dumps({"transcript_path": "/none"}), json.dumps({"hook_event_name": "PostToolUse", "tool_input": {"edits": [{"new_string": "In 1999 it fell."}, {"new_string": "Up 5% [cite needed]."}]}}),
]


def test_last_assistant_message(spark):
    lines = [("/t", i, json.dumps(x)) for i, x in enumerate(LINES)] + [("/t", 9, "no json"), ("/u", 0, json.dumps({"type": "assistant", "content": "[1, 2]"})), ("/v", 0, json.dumps({"type": "assistant"})), ("/w", 0, "{}")]
    got = {r["path"]: r["text"] for r in events.said_last(spark.createDataFrame(lines, "path string, line long, value string")).collect()}
    assert got == {"/t": "It must be 2020.\nSource: https://x.y", "/u": "[1, 2]", "/v": ""}


def test_events_once(spark, tmp_path):
    lines = spark.createDataFrame([("/t", i, json.dumps(x)) for i, x in enumerate(LINES)], "path string, line long, value string")
    plain = ledger.Ledger(spark, str(tmp_path / "plain"))
    frame = spark.createDataFrame([(x,) for x in EVENTS], "value string").repartition(3)
    now = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    events.log_events(plain, frame, lines, now=now)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(EVENTS[:6]))
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    stream = lambda n: events.follow(book, spark.readStream.text(str(folder)), str(tmp_path / f"c{n}"), transcripts=lines, now=now).awaitTermination()
    stream(0)
    (folder / "b.txt").write_text("\n".join(EVENTS[6:]))
    stream(0)
    before = [book.read(t).count() for t in ("runs", "claims")]
    assert events.log_events(book, frame, lines, stream=("events", 1)) is None  # a replay of a batch
    stream(1)  # a lost checkpoint: batch 0 again
    assert [book.read(t).count() for t in ("runs", "claims")] == before
    runs = lambda b: sorted(tuple(r) for r in b.read("runs").select("session_id", "source_event", F.coalesce("file_path", F.lit("")), "total", "supported", "tagged", "unsupported", "ts").collect())
    assert runs(book) == runs(plain) == [("", "PostToolUse", "", 2, 0, 1, 1, "2024-05-01T10:00:00Z"), ("s", "PostToolUse", "/f", 1, 0, 0, 1, "2024-05-01T10:00:00Z"), ("s", "Stop", "", 1, 1, 0, 0, "2024-05-01T10:00:00Z")]
    said_by = lambda b: sorted(tuple(r) for r in b.read("claims").select("status", "trigger", "claim_text", "session_id").collect())
    assert said_by(book) == said_by(plain)
    notes = [r["notes"] for r in book.batches().orderBy("version").collect()]
    assert sum(n["events"] for n in notes) == 9 and sum(n["malformed"] for n in notes) == 3


def replay(rows, forget):
    last, out = {}, []
    for run, count, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if count > 0:
            if run not in last or last[run][0] != count or at - last[run][1] > forget:
                out.append((run, count, at))
            last[run] = (count, at)
    return sorted(out)


def test_hand_backs(spark, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(f"r{rng.randint(0, 5)}", rng.randint(0, 2), start + timedelta(hours=6 * i)) for i in range(160)]
    schema = "run_id string, hold_count long, at timestamp"
    want = replay(rows, timedelta(days=2))
    got = holds.handed_back(spark.createDataFrame(rows, schema), "2 days")
    assert sorted(tuple(r) for r in got.select("run_id", "hold_count", "at").collect()) == want
    assert len(replay(rows, timedelta(days=99))) < len(want)
    folder = tmp_path / "holds"
    ask = lambda: watch.handbacks(spark.readStream.schema(schema).parquet(str(folder)), "2 days", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    sizes = []
    for i in range(0, 160, 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = ask().trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == want
    late = [("only", 1, start + timedelta(days=400 + 9 * i)) for i in range(2)]
    for row in late:  # all others have been quiet: their state goes
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = ask().trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    assert max(sizes) == 6 and q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    known = spark.createDataFrame(rows[:50], schema)
    left = {(r["run_id"], r["hold_count"]) for r in holds.unanswered(spark.createDataFrame(rows, schema), known).collect()}
    assert left == {r[:2] for r in rows if r[1]} - {r[:2] for r in rows[:50]}


def test_hold_message(spark):
    claims = spark.createDataFrame([(1, 1, "B is 5%.", 0.756, None, True), (1, 0, "A is.", None, "", True), (1, 2, "C", 0.9, "http://x", True), (1, 3, "D", 0.1, None, False), (2, 0, "E", 0.9, None, True)], "doc_id long, pos int, sentence string, salience double, citation string, load_bearing boolean")
    verdicts = spark.createDataFrame([(1, "HOLD"), (2, "PASS"), (3, "HOLD")], "doc_id long, verdict string")
    (row,) = holds.hold_messages(holds.hold_claims(claims, verdicts)).collect()
    assert (row["doc_id"], row["hold_count"]) == (1, 2)
    assert row["message"].split("\n") == [
        "CLAIMLOOM: 2 unverified load-bearing claim(s) in run 1.", "", "Please verify each claim below. For each one, either:", "  (a) Add a citation to the draft (URL or APA-style reference), OR",
        "  (b) Provide a short verification rationale based on your own knowledge,", "      explicitly flagging if you cannot verify it.", "", "Unverified load-bearing claims:",
        "  1. [salience=0.00] A is.", "  2. [salience=0.76] B is 5%.", "", "After verifying, re-run `claimloom check` over the updated draft to confirm the HOLD has cleared.",
    ]
