"""Hand-backs: claims that hold a run up are handed back to the writer, once for each run and number of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The program that a message speaks for.
PROGRAM = "claimloom"


def hold_claims(claims: DataFrame, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """the load-bearing claims without citation of what is on hold (claims: key, pos, sentence, salience, citation, load_bearing)."""
    held = verdicts.where(F.col("verdict") == "HOLD").select(key).distinct()
    cited = F.coalesce("citation", F.lit("")) != ""
    return claims.where(F.col("load_bearing") & ~cited).join(held, key, "left_semi")


def message(run_id: Column, holds: Column, program: str = PROGRAM) -> Column:
    """What the writer reads; ``holds`` is an array of (salience, sentence)."""
    head = F.concat(F.lit(f"{program.upper()}: "), F.size(holds).cast("string"), F.lit(" unverified load-bearing claim(s) in run "), run_id, F.lit("."))
    asked = (
        "", "Please verify each claim below. For each one, either:", "  (a) Add a citation to the draft (URL or APA-style reference), OR",
        "  (b) Provide a short verification rationale based on your own knowledge,", "      explicitly flagging if you cannot verify it.", "", "Unverified load-bearing claims:",
    )  # fixed values: the message's wording
    line = lambda h, i: F.format_string("  %d. [salience=%.2f] %s", i + 1, F.coalesce(h["salience"], F.lit(0.0)), F.coalesce(h["sentence"], F.lit("")))
    last = ("", f"After verifying, re-run `{program} check` over the updated draft to confirm the HOLD has cleared.")
    return F.concat_ws("\n", head, *map(F.lit, asked), F.array_join(F.transform(holds, line), "\n"), *map(F.lit, last))


def hold_messages(holds: DataFrame, key: str = "doc_id", program: str = PROGRAM) -> DataFrame:
    """Per run on hold the number of its claims (``hold_count``) and the message, claims in order of place."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "salience", "sentence"))), lambda h: F.struct(h["salience"].alias("salience"), h["sentence"].alias("sentence")))
    rows = holds.groupBy(key).agg(listed.alias("_holds"))
    return rows.select(key, F.size("_holds").alias("hold_count"), message(F.col(key).cast("string"), F.col("_holds"), program).alias("message"))


def handed_back(holds: DataFrame, forget: str | None = None, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The holds (run_id, hold_count, at) that are handed back: not those of the same run and count as the one before.

    Holds of no claims don't count at all. A run that is quiet for longer than ``forget`` (an interval) is handed back again.
    """
    turn = Window.partitionBy("run_id").orderBy(*order)
    seen = holds.where("hold_count > 0").withColumns({"_before": F.lag("hold_count").over(turn), "_when": F.lag("at").over(turn)})
    fresh = F.col("_before").isNull() | (F.col("_before") != F.col("hold_count"))
    if forget is not None:
        fresh = fresh | (F.col("at") > F.col("_when") + F.expr(f"interval {forget}"))
    return seen.where(fresh).drop("_before", "_when")


def unanswered(holds: DataFrame, recorded: DataFrame) -> DataFrame:
    """K15 as a table: holds of claims whose run and count aren't among the recorded hand-backs."""
    return holds.where("hold_count > 0").join(recorded.select("run_id", "hold_count").distinct(), ["run_id", "hold_count"], "left_anti")
