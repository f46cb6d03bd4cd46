"""Labelled corpora and the chain of graders."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.operators import claims, evaluate
from claimloom.sources import corpora

CITED = {"id": "a", "claim": "Costs rose 5%.", "gold": "verified"}
ITEM = {"id": 1, "text": "t", "gold": [{"claim": "c", "axis1": "tagged", "axis2": "na"}]}


def without(d, *names, **changes):
    return {k: v for k, v in (d | changes).items() if k not in names}


def reasons(spark, values, *tables):
    rows = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values, 1)], "line int, value string").withColumn("extra", F.lit(1))
    return corpora.checked(rows, *tables)


def test_each_rule_of_a_graders_corpus(spark):
    values = [
        CITED, "", None, "  ", "{", "[1]", "7", without(CITED, "id"), without(CITED, "claim"), without(CITED, "gold"), without(CITED, gold="error", id=2), without(CITED, gold=["verified"], id=3), without(CITED, gold=None, id=4),
        CITED, without(CITED, id="b", citation=5), without(CITED, id="c", source={"x": 1}), without(CITED, id="d", source=None, citation=""), without(CITED, id="b"), without(CITED, id=None), without(CITED, id=None),
    ]
    found = reasons(spark, values, corpora.GRADES, corpora.LATE)
    assert {r["line"]: r["reason"] for r in corpora.rejects(found).collect()} == {
        5: "not JSON", 6: "not an object", 7: "not an object", 8: "missing field id", 9: "missing field claim", 10: "missing field gold", 11: "gold label", 12: "gold label", 13: "gold label",
        14: "duplicate id", 15: "citation is no string", 16: "source is no string", 18: "duplicate id", 20: "duplicate id",
    }
    assert sorted(r["line"] for r in corpora.grade_items(found).collect()) == [1, 17, 19]
    with pytest.raises(ValueError, match="line 5: not JSON"):
        corpora.required(found)
    with pytest.raises(ValueError, match="empty"):
        corpora.required(reasons(spark, [" "], corpora.GRADES))
    assert corpora.required(reasons(spark, [CITED], corpora.GRADES)).count() == 1


def test_each_rule_of_a_claims_corpus(spark):
    label = lambda **k: [{"claim": "c", "axis1": "tagged", "axis2": "na"}, {"claim": "d", "axis1": "tagged", "axis2": "na"} | k]
    values = [ITEM, without(ITEM, "text", id=2), without(ITEM, id=3, gold={}), without(ITEM, id=4, gold=label(axis1="odd")), without(ITEM, id=5, gold=label(axis2=None)), without(ITEM, id=6, gold=label()), without(ITEM, id=7, gold=[]), without(ITEM, id=8, gold=[5])]
    found = reasons(spark, values, corpora.CLAIMS)
    assert {r["line"]: r["reason"] for r in corpora.rejects(found).collect()} == {2: "missing field text", 3: "gold is not a list", 4: "axis1 label", 5: "axis2 label", 8: "axis1 label"}
    assert {r["id"]: len(r["gold"]) for r in corpora.claim_items(found).collect()} == {"1": 1, "6": 2, "7": 0}


def test_lines_of_files_are_numbered(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(CITED) + "\r\n\n" + json.dumps(CITED) + "\n")
    rows = corpora.numbered_lines(spark, str(tmp_path / "a.jsonl"))
    assert {r["line"]: r["reason"] for r in corpora.rejects(corpora.checked(rows)).collect()} == {3: "duplicate id"}


def claim_frame(spark):
    rows = [(i % 40, i, f"Costs rose {i}% in 2019.", f"Costs rose {i}% in 2019." if i % 3 else None, "https://e.org/x" if i % 4 else None) for i in range(300)]
    return spark.createDataFrame(rows + rows[:5], "doc_id long, pos long, sentence string, source_text string, citation string").repartition(3)


def test_a_failing_grader_loses_no_claim(spark):
    def third_fails(frame):
        if frame["pos"].iloc[0] % 3 == 0:
            raise RuntimeError("down")
        said = frame[["_row"]].assign(verdict="verified", confidence=3.0, rationale="x" * 300)
        said.loc[frame["pos"] % 5 == 0, "verdict"] = None
        said.loc[frame["pos"] % 7 == 1, "verdict"] = "whatever"
        stray = pd.DataFrame({"_row": [10**6], "verdict": ["verified"], "confidence": [1.0], "rationale": [""]})
        return pd.concat([said[frame["pos"] % 11 != 0], said, stray]) if len(said) % 2 else said[frame["pos"] % 11 != 0]

    def wrong_form(frame):
        return frame[["pos"]]

    rows = claim_frame(spark)
    got = claims.graded_in_turn(rows, [("first", third_fails), ("second", wrong_form)]).cache()
    assert got.count() == 305 and got.select("doc_id", "pos").exceptAll(rows.select("doc_id", "pos")).count() == 0
    heuristic = {r["pos"]: r["v"] for r in rows.select("pos", C.heuristic_grade(F.col("sentence"), F.col("source_text"), F.col("citation")).alias("v")).collect()}
    for r in got.collect():
        if r["grader"] == "heuristic":
            assert r["verdict"] == heuristic[r["pos"]] and r["confidence"] is None
        else:
            assert r["grader"] == "first" and (r["pos"] % 5 or r["pos"] % 7 == 1) and r["confidence"] == 1.0 and len(r["rationale"]) == 200
            assert r["verdict"] == ("error" if r["pos"] % 7 == 1 else "verified")
    assert {r["grader"] for r in got.collect()} == {"first", "heuristic"}
    assert claims.graded_in_turn(rows.limit(0), [("first", third_fails)]).count() == 0
    with pytest.raises(ValueError, match="grader"):
        claims.graded_in_turn(rows.withColumn("grader", F.lit("")), [])


def test_which_grader_begins():
    choice = claims.grader_choice
    assert choice() == "heuristic" and choice(has_cli=True) == "claude-cli" and choice(api_key="k", has_cli=True) == "llm" and choice(local_answers=True, api_key="k") == "local" and choice(local_url="u", api_key="k") == "local"
    assert choice(" Codex ", local_url="u") == "codex" and choice("HEURISTIC", api_key="k") == "heuristic" and choice("nobody", api_key="k") == "llm" and choice("anthropic") == "llm"


def test_a_graded_corpus_is_evaluated(spark):
    values = [without(CITED, id=i, source="Costs rose 5%." if i % 2 else None, citation="https://e.org", gold="verified" if i % 2 else "unverifiable") for i in range(20)]
    items = corpora.grade_items(corpora.required(reasons(spark, values, corpora.GRADES, corpora.LATE)))
    plain, chained = corpora.graded_corpus(items), corpora.graded_corpus(items, [("none", lambda frame: 1 / 0)])
    assert plain.count() == 20 and plain.exceptAll(chained).count() == 0 and chained.exceptAll(plain).count() == 0
    assert sum(r["n"] for r in evaluate.confusion(plain).collect()) == 20


def test_lines_without_an_id_go_to_no_single_task(spark):
    """Left joins send all null keys to one task; most lines of a bad corpus have none."""
    rows = spark.range(4000).select(F.col("id").alias("line"), F.when(F.col("id") % 8 == 0, F.concat(F.lit('{"id": '), "id", F.lit(', "claim": "c", "gold": "verified"}'))).otherwise("no JSON").alias("value"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = corpora.checked(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in found) == 4000 and sum(r["bad"] for r in found) == 3500
    assert max(r["n"] for r in found) < 2000
