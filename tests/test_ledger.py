"""Ledger, retention, integrity, review, monitoring, evaluation, readers and streams on small tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.operators import evaluate, integrity, ledger, monitor, review
from claimloom.plans import conformance
from claimloom.sources import readers, sinks
from claimloom.streaming import watch


def test_append_only_ledger_and_debt(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    assert book.read("claims").count() == 0
    book.append("runs", spark.createDataFrame([("2024-01-01T00:00:00Z", 3, 1), ("2024-01-02T00:00:00Z", 4, 2)], "ts string, total int, unsupported int"), ["ts"])
    book.append("runs", spark.createDataFrame([("2024-01-03T00:00:00Z", 5, 3)], "ts string, total int, unsupported int"), ["ts"])
    assert [r["id"] for r in book.read("runs").orderBy("id").collect()] == [1, 2, 3]
    book.append("claims", spark.createDataFrame([(1, "unsupported", "It must be."), (1, "supported", "x"), (2, "unsupported", "x"), (2, "tagged", None)], "run_id long, status string, claim_text string"), ["run_id", "status"])
    row = ledger.debt_totals(book.read("runs"), book.read("claims")).first()
    assert (row["runs"], row["claims"], row["supported"], row["tagged"], row["unsupported"], row["load_bearing_unsupported"], row["debt_per_1000"]) == (3, 4, 1, 1, 2, 1, 250.0)
    assert ledger.debt_trend(book.read("runs")).first()["direction"] == "up"
    assert ledger.debt_trend(book.read("tombstones").select("id", F.lit(1).alias("total"), F.lit(0).alias("unsupported"))).first()["direction"] == "flat"
    said = "ts string, run_id string, reviewer string, gate_id string, failure_class string, risk_accepted string, compensating_control string, escalation_path_taken string, single_actor boolean"
    good, bad = ("t", "r1", "ann", "g", "f", "risk", "ctl", "odd", True), ("t", "r1", " ", "g", "f", "risk", "ctl", None, False)
    with pytest.raises(Exception, match="reviewer is empty"):
        book.append_overrides(spark.createDataFrame([good, bad], said))
    assert book.read("overrides").count() == 0
    book.append_overrides(spark.createDataFrame([good], said))
    assert [r["escalation_path_taken"] for r in book.read("overrides").collect()] == ["custom:odd"]
    footer = ledger.override_footer(book.read("overrides")).first()["footer"]
    assert footer.startswith("\n## Overrides applied\n\nThe following") and footer.endswith("  - Recorded: t\n\n")
    assert "\n\n- **Override ovr_1** on gate **g** (failure: f) (single-actor; artefact role downgraded)\n  - Risk accepted: risk\n  - Compensating control: ctl\n  - Escalation: custom:odd\n  - Reviewer: ann\n" in footer


def test_retention(spark):
    runs = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", 10), (2, "2024-01-01 00:00:00", 10), (3, "2024-01-01", None), (4, "bad", 1), (5, "2024-01-01T00:00:00+02:00", 10)], "id long, ts string, retention_window_days int")
    windows = spark.createDataFrame([(1, 2, 5), (2, 2, None), (3, 3, 1)], "id long, run_id long, retention_window_days int")
    stones = spark.createDataFrame([(5,)], "run_id long")
    got = {r["id"]: r["expired_after"] for r in ledger.expired_runs(runs, windows, stones, F.to_timestamp(F.lit("2024-02-01"))).collect()}
    assert got == {1: "2024-01-11T00:00:00Z", 3: "2024-01-02T00:00:00Z"}


def test_windows_and_tombstones_of_a_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "kept"))
    book.append_runs(spark.createDataFrame([("2024-01-01T00:00:00Z", 10), ("2024-01-02T00:00:00Z", 10), ("2024-01-03T00:00:00Z", None), ("bad", 1)], "ts string, retention_window_days int"), ["ts"])
    book.append_windows(spark.createDataFrame([("t1", 1, 3), ("t2", 1, 5), ("t1", 2, None)], "ts string, run_id long, retention_window_days int"))
    now = F.to_timestamp(F.lit("2024-03-01"))
    expired = lambda: [r["id"] for r in ledger.expired_runs(*[book.read(t) for t in ("runs", "retention_windows", "tombstones")], now).collect()]
    assert expired() == [1]
    book.append_tombstones(spark.createDataFrame([("t3", 1, None, None), ("t3", 2, " asked for ", None), ("t3", 3, "x", 2), ("t3", 4, "x", None), ("t3", 9, "x", None), ("t4", 1, "again", None)], "ts string, run_id long, reason string, retention_window_days int"))
    got = [(r["id"], r["run_id"], r["reason"], r["retention_window_days"], r["expired_after"]) for r in book.read("tombstones").orderBy("id").collect()]
    assert got == [
        (1, 1, "retention_window_elapsed", 5, "2024-01-06T00:00:00Z"), (2, 2, "asked for", None, None), (3, 3, "x", 2, "2024-01-05T00:00:00Z"),
        (4, 4, "x", 1, None), (5, 9, "x", None, None), (6, 1, "again", 5, "2024-01-06T00:00:00Z"),
    ]
    assert expired() == []
    with pytest.raises(Exception, match="negative"):
        book.append_windows(spark.createDataFrame([("t", 1, -1)], "ts string, run_id long, retention_window_days int"))
    with pytest.raises(Exception, match="no reason"):
        book.append_tombstones(spark.createDataFrame([("t", 1, " ")], "ts string, run_id long, reason string"))
    assert book.read("retention_windows").count() == 3 and book.read("tombstones").count() == 6


def test_hash_chain(spark):
    base = spark.createDataFrame([(i, "f", "m", "s", "e", i, 0, i, "t", 0) for i in range(1, 5)], "id long, file_path string, mode string, session_id string, source_event string, supported int, tagged int, total int, ts string, unsupported int")
    rows = base.withColumn("run_content_hash", ledger.content_hash()).withColumn("prev_run_hash", F.lag("run_content_hash").over(Window.orderBy("id")))
    record = {"ts": "t", "session_id": "s", "source_event": "e", "file_path": "f", "mode": "m", "total": 1, "supported": 1, "tagged": 0, "unsupported": 0}
    assert rows.where("id = 1").first()["run_content_hash"] == "sha256:" + hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert ledger.chain_errors(rows).count() == 0
    bad = rows.withColumn("total", F.when(F.col("id") == 3, 9).otherwise(F.col("total"))).withColumn("prev_run_hash", F.when(F.col("id") == 1, "x").otherwise(F.col("prev_run_hash")))
    assert {(r["id"], r["kind"]) for r in ledger.chain_errors(bad).collect()} == {(3, "content_changed"), (1, "first_has_predecessor")}


def test_chained_append(spark, tmp_path):
    """Runs appended in batches form one chain, whose links and hashes plain Python agrees with."""
    book = ledger.Ledger(spark, str(tmp_path / "chain"))
    batch = lambda n, day: spark.createDataFrame([(f"2024-01-{day:02d}T00:00:{i:02d}Z", f"né{i}", i) for i in range(n)], "ts string, file_path string, total int").repartition(3)
    for n, day in ((7, 1), (1, 2), (5, 3)):
        book.append_runs(batch(n, day), ["ts"])
    rows = book.read("runs").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 14)) and [r["ts"] for r in rows] == sorted(r["ts"] for r in rows)
    before = None
    for r in rows:
        record = {k: r[k] for k in ("ts", "session_id", "source_event", "file_path", "mode", "total", "supported", "tagged", "unsupported")}
        own = "sha256:" + hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert (r["run_content_hash"], r["prev_run_hash"], r["mode"], r["supported"]) == (own, before, "default", 0)
        before = own
    assert ledger.chain_errors(book.read("runs")).count() == 0
    cut = book.read("runs").where("id <> 8")
    assert [(r["id"], r["kind"]) for r in ledger.chain_errors(cut).collect()] == [(9, "broken_link")]


def test_previous_across_spans(spark):
    rows = spark.createDataFrame([(i * i, f"v{i}") for i in range(40)], "place long, v string")
    got = {r["place"]: (r["_before"], r["_first"]) for r in ledger.previous(rows, "place", "v", span=50).collect()}
    assert got == {i * i: (None if not i else f"v{i - 1}", i == 0) for i in range(40)}


def py_root(leaves):
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def test_merkle(spark):
    trees = {n: [f"{n}/{i}".encode() for i in range(n)] for n in (1, 2, 3, 5, 8, 13)}
    rows = spark.createDataFrame([(n, i, bytearray(x)) for n, t in trees.items() for i, x in enumerate(t)], "key int, idx long, data binary")
    roots = {r["key"]: r["root"] for r in integrity.roots(rows, "key", 13).collect()}
    assert roots == {n: py_root(t) for n, t in trees.items()}
    proven = integrity.proofs(rows, "key", 13).join(rows, ["key", "idx"]).join(integrity.checkpoints(rows, "key", 13), "key")
    cols = {c: F.col(c) for c in ("data", "idx", "size", "steps", "root")}
    holds = lambda **other: integrity.proof_holds(**{**cols, **other})
    assert proven.where(~holds()).count() == 0 and proven.count() == 32
    assert proven.where(holds(data=F.encode(F.lit("x"), "UTF-8"))).count() == 0
    # at every other place, in trees cut or grown so that the path changes, with a step too many or too few, or without one
    places = proven.join(spark.range(16).withColumnRenamed("id", "other"))
    assert places.where("other <> idx").where(holds(idx=F.col("other"))).count() == 0
    assert proven.where(holds(idx=F.lit(-1))).count() == 0 and proven.where(holds(size=F.lit(0))).count() == 0
    assert proven.where(holds(size=F.col("size") * 2)).count() == 0
    step = F.array(F.struct(F.lit("right").alias("side"), F.unhex(F.lit("00")).alias("hash")))
    assert proven.where(holds(steps=F.concat("steps", step))).count() == 0
    assert proven.where("key > 1").where(holds(steps=F.slice("steps", 2, 9))).count() == 0
    assert proven.where(holds(steps=F.lit(None).cast("array<struct<side:string,hash:binary>>"))).count() == 0


def py_sides(idx, size):
    out = []
    while size > 1:
        if idx % 2:
            out.append("left")
        elif idx + 1 < size:
            out.append("right")
        idx, size = idx // 2, (size + 1) // 2
    return out


def test_sides_of_proofs(spark):
    rows = [(i, n) for n in (*range(1, 40), 2**40 + 3) for i in {0, n // 3, n // 2, n - 1}]
    got = spark.createDataFrame(rows, "idx long, size long").select("idx", "size", integrity.sides(F.col("idx"), F.col("size")).alias("s")).collect()
    assert [r["s"] for r in got] == [py_sides(r["idx"], r["size"]) for r in got] and len(got) == len(rows)


def test_merkle_of_any_size(spark):
    trees = {n: [f"{n}/{i}".encode() for i in range(n)] for n in (1, 7, 32, 33, 1000)}
    rows = spark.createDataFrame([(n, i, bytearray(x)) for n, t in trees.items() for i, x in enumerate(t)], "key int, idx long, data binary")
    assert sorted((r["key"], r["root"]) for r in integrity.roots(rows, "key").collect()) == [(n, py_root(t)) for n, t in trees.items()]
    assert sorted((r["key"], r["size"]) for r in integrity.checkpoints(rows, "key").collect()) == [(n, n) for n in trees]
    proven = integrity.proofs(rows, "key").join(rows, ["key", "idx"]).join(integrity.checkpoints(rows, "key"), "key")
    holds = [r["holds"] for r in proven.select(integrity.proof_holds(*[F.col(c) for c in ("data", "idx", "size", "steps", "root")]).alias("holds")).collect()]
    assert len(holds) == 1073 and all(holds)
    with pytest.raises(Exception, match="more than 32 entries"):
        integrity.roots(rows, "key", 32).collect()
    assert integrity.roots(rows.where("false"), "key").count() == 0


def test_bundles_with_a_bill(spark):
    seal = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    rows = [(i, "p", seal("p"), "r", None, *bill) for i, bill in enumerate((("b", seal("b")), ("x", seal("b")), (None, seal("b")), ("b", None), (None, None)))]
    bundles = spark.createDataFrame(rows, "key int, prose string, prose_sha256 string, root string, signature string, cbom string, cbom_sha256 string")
    points = spark.createDataFrame([(i, "r") for i in range(5)], "key int, root string")
    got = {r["key"]: (r["cbom_ok"], r["status"]) for r in integrity.bundle_status(bundles, points).collect()}
    assert got == {0: (True, "UNSIGNED"), 1: (False, "INVALID"), 2: (False, "INVALID"), 3: (False, "INVALID"), 4: (True, "UNSIGNED")}


def test_self_checks(spark):
    rows = conformance.run(spark).collect()
    assert sorted(r["name"] for r in rows) == sorted(conformance.CHECKS)
    assert {r["name"] for r in rows if r["status"] != "ENFORCED"} == set(conformance.NOT_BUILT)


def test_review(spark):
    rows = [(1, "a", "t1", "d1", "P2", "l1", "k", False), (2, "b", "t2", "d2", "P0", "l2", "k", False), (3, "c", "t3", "d3", "odd", "l1", "", False), (4, "d", "t4", "d4", "P1", "l1", "k", True)]
    found = review.consolidate(spark.createDataFrame(rows, "seq long, finding_id string, title string, detail string, severity string, location string, issue_key string, deferred boolean"))
    assert {(r["issue_key"], r["kind"], r["title"], r["severity"], r["locations"], r["finding_ids"]) for r in found.collect()} == {("k", "convergent", "t1", "P0", "l1,l2", "a,b"), ("c", "distinct", "t3", "odd", "l1", "c"), ("k", "deferred", "t4", "P1", "l1", "d")}


def test_monitoring(spark):
    lines = ['{"ts":"2024-01-0%d","shadow_status":"observed","verdict":"PASS","claims_detected":10,"claims_supported":%d}' % (i, 9 - i) for i in range(1, 7)] + ["", "nonsense", "[1]", '{"shadow_status":null}', '{"shadow_status":"observed","claims_detected":1,"claims_supported":5}']
    log = readers.shadow_log(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("seq", F.monotonically_increasing_id())
    row = monitor.shadow_metrics(log).first()
    assert (row["total_lines"], row["malformed_lines"], row["observed"], row["non_observed"], row["detected"], row["supported"]) == (10, 2, 7, 1, 60, 33)
    assert row["unsupported_rate"] == round(27 / 60, 4)
    trend = monitor.shadow_trend(log).first()
    assert (trend["rows"], trend["earlier"], trend["later"], trend["trend"]) == (6, 0.3, 0.6, "worsening")
    assert {r["status"]: r["n"] for r in monitor.status_distribution(log).collect()} == {"unknown": 1}
    cal = monitor.calibration(spark.createDataFrame([("verified", 0.8), ("contradicted", 0.4), ("skipped", 0.1), ("verified", None)], "verdict string, confidence double")).first()
    assert (cal["total"], cal["typed"], cal["with_confidence"], cal["coverage"]) == (4, 3, 2, 0.5) and abs(cal["brier"] - (0.04 + 0.16) / 2) < 1e-12


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None)], "gold string, pred string")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"], r["support"]) for r in evaluate.per_class(rows, ("a", "b", "c")).collect()}
    assert got == {"a": (1, 0, 1, 2), "b": (1, 1, 1, 2), "c": (0, 0, 0, 0)}
    assert {(r["gold"], r["pred"]): r["n"] for r in evaluate.confusion(rows).collect()} == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1, ("b", "(none)"): 1}
    gold = spark.createDataFrame([("i", "The  Cat", "x"), ("i", "dog", "y")], "item_id string, claim string, gold string")
    pred = spark.createDataFrame([("i", 2, "the cat sat", "late"), ("i", 1, "cat", "first")], "item_id string, pos int, snippet string, status string")
    assert {r["claim"]: r["pred"] for r in evaluate.align(gold, pred).collect()} == {"The  Cat": "first", "dog": None}


def test_readers_and_sinks(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.md").write_text("Revenue rose 12%.")
    (root / "b.txt").write_bytes(b"bad \xff byte")
    (root / "c.py").write_text("x")
    (root / "node_modules" / "d.md").write_text("x")
    docs = readers.documents(spark, str(root))
    assert sorted(r["path"].rsplit("/")[-1] for r in docs.collect()) == ["a.md", "b.txt"]
    assert readers.latest_document(docs).count() == 1
    shown = lambda *folders: sorted(r[0] for r in docs.select(readers.display_path(F.col("path"), *folders)).collect())
    assert shown(str(tmp_path / "doc"), str(root)) == ["a.md", "b.txt"]
    assert shown(f"file://{tmp_path}/", str(root)) == ["docs/a.md", "docs/b.txt"]
    assert shown() == shown(str(root / "a.md" / "x")) == [f"{root}/a.md", f"{root}/b.txt"]
    (tmp_path / "items.json").write_text('[{"id":"x","text":"t"},{"text":"u","source_agent":"w"}]')
    assert [(r["context_id"], r["text"]) for r in readers.context_items(spark, str(tmp_path / "items.json")).collect()] == [("x", "t"), ("context_002", "u")]
    (tmp_path / "items.txt").write_text("one\n\n two \n")
    assert [r["text"] for r in readers.context_items(spark, str(tmp_path / "items.txt")).collect()] == ["one", "two"]
    items = lambda text: (tmp_path / "more.json").write_text(text) and [(r["context_id"], r["text"], r["source_agent"]) for r in readers.context_items(spark, str(tmp_path / "more.json")).collect()]
    assert items(' [5, {"context_id": "a", "raw_text": "r", "source_agent": "w"}, "s", null, true, {"id": "", "text": ""}, {"id": 7}, [1]]\n') == [
        ("context_001", "5", None), ("a", "r", "w"), ("context_003", "s", None), ("context_004", "None", None), ("context_005", "True", None), ("context_006", "", None), ("7", "", None), ("context_008", "[1]", None),
    ]
    assert items('{"items": [{"id": "i", "text": "x"}]}') == [("i", "x", None)] and items('{"other": 1}') == [] and items("[]") == []
    for bad in ('{"items": 5}', "[1, "):
        with pytest.raises(Exception):
            items(bad)
    matrix = spark.createDataFrame([(2, "tagged", None, "0.50", None, None, "a|b"), (1, "supported", "year", "0.10", "supported", "u", "c")], "id long, status string, trigger string, salience string, verdict string, citation string, claim_text string")
    table = lambda m: [r["line"] for r in sinks.matrix_markdown(m).orderBy("part", "id").collect()]
    head = ["| claim_id | status | trigger | salience | verdict | citation | claim_text |", "| --- | --- | --- | --- | --- | --- | --- |"]
    assert table(matrix) == [*head, "| 1 | supported | year | 0.10 | supported | u | c |", "| 2 | tagged |  | 0.50 |  |  | a\\|b |"]
    assert table(matrix.where("false")) == [*head, "| no claims recorded |  |  |  |  |  |  |"]
    badge = lambda n, s: spark.range(1).select(sinks.badge_url("tells", "clean", F.lit(s), F.lit(n))).first()[0]
    assert (badge(0, 0.0), badge(2, 4.04)) == ("https://img.shields.io/badge/tells-clean-brightgreen", "https://img.shields.io/badge/tells-4.0%2F10-red")
    metrics = spark.createDataFrame([(1, None)], "b int, a string")
    assert json.loads(sinks.metrics_json(metrics).first()["json"]) == {"a": None, "b": 1}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Revenue rose {i}%. Source: https://e.org/{i}.") for i in range(6)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = watch.watch_drafts(spark, str(tmp_path / "in"))
    query = watch.append_claims(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in watch.claim_stream(rows).collect()} and len(got) == 6


def test_one_tree_over_a_large_ledger(spark):
    n = 70_001
    entries = spark.range(n).select(F.lit("all").alias("key"), F.col("id").alias("idx"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data")).repartition(8)
    want = py_root([str(i).encode() for i in range(n)])
    assert [tuple(r) for r in integrity.checkpoints(entries, "key").collect()] == [("all", want, n)]
    plan = integrity.roots(entries, "key", n)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4  # the input's, one for each ten levels, whatever the number of entries
    some = F.col("idx").isin(0, 1, 1023, 1024, 65_535, 69_632, 70_000)
    proven = integrity.proofs(entries, "key", n).where(some).join(entries, ["key", "idx"])
    held = integrity.proof_holds(F.col("data"), F.col("idx"), F.lit(n), F.col("steps"), F.lit(want))
    assert proven.count() == 7 and proven.where(held).count() == 7
    keys = spark.createDataFrame([("all",), ("none",)], "key string")
    got = {r["key"]: (r["size"], r["root"]) for r in integrity.checkpoints(entries.where("idx < 3"), "key", keys=keys).collect()}
    assert got == {"all": (3, py_root([b"0", b"1", b"2"])), "none": (0, hashlib.sha256(b"").hexdigest())}
    body = lambda **kw: json.loads(spark.range(1).select(integrity.checkpoint_body(F.lit("ab"), F.lit(3), F.lit("r|é"), F.lit("t"), **kw)).first()[0])
    whole = {"version": "claimloom-checkpoint-v2", "root_hash": "sha256:ab", "entry_count": 3, "run_id": "r|é", "timestamp": "t", "algorithm": "sha256-merkle-rfc6962-domainsep"}
    assert body() == whole and body(prose_sha256=F.lit("p"), cbom_sha256=F.lit(None).cast("string")) == {**whole, "prose_sha256": "p"}


def test_the_middle_row_is_found_in_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["", "2024", "2024-01-01", f"2024-02-{rng.randint(1, 28):02d}"]), rng.randint(0, 60)) for _ in range(900)] + [("same", 5)] * 400
    frame = spark.createDataFrame(rows, "ts string, seq long").repartition(5)
    for place in (0, 1, 449, 650, 900, 1299):
        assert monitor.place_of(frame, ["ts", "seq"], place, ways=4, few=5) == sorted(rows)[place]
    assert monitor.place_of(frame, ["ts", "seq"], 1300) is None
    log = [(ts, seq, "observed", False, 10, seq % 11) for ts, seq in rows]
    given = spark.createDataFrame(log, "ts string, seq long, shadow_status string, malformed boolean, claims_detected int, claims_supported int")
    ordered = sorted((r[0], r[1], r[4], r[5]) for r in log)
    rate = lambda part: round((sum(r[2] for r in part) - sum(r[3] for r in part)) / sum(r[2] for r in part), 4)
    got = monitor.shadow_trend(given).first()
    assert (got["rows"], got["earlier"], got["later"]) == (1300, rate(ordered[:650]), rate(ordered[650:]))
    assert monitor.shadow_trend(given.where("false")).first()["trend"] == "insufficient_data"
