"""The check of drafts: boundary and claims of each reduced to a row where its text is read, actors joined, and one verdict made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.functions import rules as R
from claimloom.functions.tables import join_left
from claimloom.functions.text import rounded
from claimloom.operators import claims, scan


def threshold(profile: Column) -> Column:
    """The largest unsupported share that a profile lets pass; 1 of profiles without one."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in R.UNSUPPORTED_THRESHOLDS.items() for x in (k, v)])[profile], F.lit(1.0))


def listed(when: Column, place: list, said: Column) -> Column:
    """What is said of rows, in the order of their places; a list per document."""
    rows = F.collect_list(F.when(when, F.struct(*place, said.alias("_said"))))
    return F.transform(F.array_sort(rows), lambda x: x["_said"])


def text_summary(drafts: DataFrame, rules: Sequence[R.Rule], key: str = "doc_id") -> DataFrame:
    """Violations, claims, those without citation, those of them that are load-bearing, and what to say of each.

    Lines and sentences are scanned where they are, equal ones once a batch; what is grouped are counts and sayings.
    """
    s, none = F.col("sentence"), F.lit(None).cast("string")
    violation = F.format_string(R.REASONS["violation"], "rule", "tag", "line", F.substring("match", 1, 60))
    unsupported = F.format_string(R.REASONS["unsupported"], F.format_number(C.salience(s), 2), F.substring(s, 1, 80))
    broken = scan.findings(drafts, rules, key).select(key, F.col("line").alias("place"), "seq", violation.alias("broken"), none.alias("heavy"), F.lit(0).alias("claim"), F.lit(0).alias("bare"))
    uncited = F.col("citation").isNull()
    found = claims.pipeline_claims(drafts, key, said=unsupported)
    found = found.select(key, F.col("pos").alias("place"), F.lit(0).alias("seq"), none.alias("broken"), F.when(uncited & F.col("load_bearing"), F.col("said")).alias("heavy"), F.lit(1).alias("claim"), uncited.cast("int").alias("bare"))
    said = lambda name, *place: listed(F.col(name).isNotNull(), list(place), F.col(name))
    return broken.unionByName(found).groupBy(key).agg(
        F.count("broken").alias("violations"), F.sum("claim").alias("claims"), F.sum("bare").alias("unsupported"), F.count("heavy").alias("load_bearing_unsupported"),
        said("broken", "place", "seq").alias("said_violations"), said("heavy", "place").alias("said_unsupported"),
    )


def verifier_summary(graded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Contradicted claims, load-bearing unverifiable ones, and what to say of them, per document."""
    contradicted, unverifiable = F.col("verdict") == "contradicted", (F.col("verdict") == "unverifiable") & F.col("load_bearing")
    said = lambda name: F.format_string(R.REASONS[name], F.substring("sentence", 1, 80))
    return graded.groupBy(key).agg(
        F.count_if(contradicted).alias("contradicted"), F.count_if(unverifiable).alias("unverifiable"),
        listed(contradicted, ["pos"], said("contradicted")).alias("said_contradicted"), listed(unverifiable, ["pos"], said("unverifiable")).alias("said_unverifiable"),
    )


#: Columns of a summary: counts, and lists of what to say of each one counted.
COUNTS = ("violations", "claims", "unsupported", "load_bearing_unsupported", "contradicted", "unverifiable")
SAID = ("said_violations", "said_unsupported", "said_contradicted", "said_unverifiable")


def consolidate(summary: DataFrame) -> DataFrame:
    """Verdict, reasons and the rule that fired of each row.

    Columns: profile, those of ``COUNTS`` and ``SAID``, single_actor, has_identity. The first stage with a reason decides:
    BLOCK, HOLD, NOT_ASSESSABLE, PASS. A rule fires where a document on hold has more unsupported claims than its profile
    lets pass.
    """
    p = F.lower(F.trim("profile"))
    share = F.col("unsupported") / F.when(F.col("claims") > 0, F.col("claims"))
    over = F.coalesce(share > threshold(p), F.lit(False))
    percent = lambda x: F.format_number(x * 100, 0)
    one = lambda when, said: F.when(F.coalesce(when, F.lit(False)), F.array(said)).otherwise(F.array().cast("array<string>"))
    fraction = F.format_string(R.REASONS["fraction"], "unsupported", "claims", percent(share), p, percent(threshold(p)))
    stages = (
        ("BLOCK", (F.col("said_contradicted"), F.col("said_violations"), one(F.col("single_actor") & p.isin(list(R.STRICT_ARTEFACTS)), F.format_string(R.REASONS["single_actor_block"], p)))),
        ("HOLD", (F.col("said_unsupported"), F.col("said_unverifiable"), one(over, fraction), one(F.col("single_actor") & p.isin(list(R.FINAL_ARTEFACTS)), F.lit(R.REASONS["single_actor_hold"])))),
        ("NOT_ASSESSABLE", (one((p == "final-prose") & ~F.col("has_identity"), F.lit(R.REASONS["no_identity"])),)),
    )
    verdict, reasons = F.lit("PASS"), F.array().cast("array<string>")
    for stage, parts in reversed(stages):
        said = F.concat(*parts)
        verdict = F.when(F.size(said) > 0, stage).otherwise(verdict)
        reasons = F.when(F.size(said) > 0, said).otherwise(reasons)
    rule = F.struct(
        F.lit("profile_unsupported_fraction").alias("rule"), p.alias("profile"), F.col("unsupported").alias("unsupported"), F.col("claims").alias("total"),
        rounded(share, 4).alias("unsupported_fraction"), threshold(p).alias("threshold"),
    )
    done = summary.withColumns({"verdict": verdict, "reasons": reasons})
    return done.withColumn("fired_rule", F.when((F.col("verdict") == "HOLD") & over, rule))


def check(drafts: DataFrame, profile: str = "final-prose", sources: DataFrame | None = None, actors: DataFrame | None = None) -> DataFrame:
    """The verdict of each draft (doc_id, text); drafts that share a doc_id, or have none, are judged together.

    ``sources`` (url, source_text) turns verification on; ``actors`` (doc_id, single_actor, has_identity) tells who wrote and
    reviewed.
    """
    parts = [text_summary(drafts, scan.boundary_rules(profile))]
    if sources is not None:
        parts.append(verifier_summary(claims.graded(claims.pipeline_claims(drafts), sources)))
    summary = drafts.select("doc_id")
    for part in parts:
        summary = join_left(summary, part, "doc_id")
    for column in COUNTS:
        summary = summary.withColumn(column, F.coalesce(column, F.lit(0)) if column in summary.columns else F.lit(0))
    nothing = F.array().cast("array<string>")
    for column in SAID:
        summary = summary.withColumn(column, F.coalesce(column, nothing) if column in summary.columns else nothing)
    if actors is not None:
        summary = join_left(summary, actors.select("doc_id", "single_actor", "has_identity"), "doc_id").fillna(False, ["single_actor", "has_identity"])
    else:
        summary = summary.withColumns({"single_actor": F.lit(False), "has_identity": F.lit(False)})
    return consolidate(summary.withColumn("profile", F.lit(profile))).drop(*SAID)
