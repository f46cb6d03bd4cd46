"""Merkle proofs with the size and root of their tree, and what they shuffle."""

from pyspark.sql import functions as F

from claimloom.operators import integrity


def _entries(spark, *sizes):
    rows = [(k, i, f"{k}/{i}".encode()) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "key long, idx long, data binary")


def test_proven_entries_hold(spark):
    """Trees of one span and of several; data, size and root come with the steps."""
    for sizes in ((1, 2, 5, 31), (3, integrity.DEPTH ** 2 * 25)):
        rows = _entries(spark, *sizes)
        found = integrity.proven(rows, "key")
        tops = {r["key"]: (r["root"], r["size"]) for r in integrity.checkpoints(rows, "key").collect()}
        holds = integrity.proof_holds(F.col("data"), F.col("idx"), F.col("size"), F.col("steps"), F.col("root"))
        done = found.select("key", "idx", "data", "size", "root", holds.alias("holds")).collect()
        assert sorted((r["key"], r["idx"]) for r in done) == [(k, i) for k, n in enumerate(sizes) for i in range(n)]
        for r in done:
            assert r["holds"] and (r["root"], r["size"]) == tops[r["key"]] and bytes(r["data"]) == f"{r['key']}/{r['idx']}".encode()


def test_small_trees_are_grouped_once(spark):
    plan = integrity.proven(_entries(spark, 3, 4), "key", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
