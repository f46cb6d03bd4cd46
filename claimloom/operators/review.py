"""Consolidation of review findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules as R


def consolidate(findings: DataFrame) -> DataFrame:
    """A row per group of findings (seq, finding_id, title, detail, severity, location, issue_key, deferred).

    Findings of one issue are convergent if there are several; single and keyless ones are distinct; each deferred one stands
    alone. A group has its first finding's title and detail, the highest severity (unknown ones last), the distinct locations
    and the ids in order, and the place of its first finding.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, v in R.SEVERITY_RANKS.items() for x in (k, v)])[F.col("severity")], F.lit(99))
    keyed = F.coalesce(F.nullif("issue_key", F.lit("")), F.col("finding_id"))
    alone = F.col("deferred") | F.coalesce(F.col("issue_key") == "", F.lit(True))
    rows = findings.select(
        keyed.alias("group_key"), F.when(alone, F.col("finding_id")).alias("own"), "deferred", "seq", "finding_id", "title", "detail", "severity", "location", rank.alias("rank")
    )
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c])
    groups = rows.groupBy("group_key", "own", "deferred").agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n_findings"),
        F.min_by("title", "seq").alias("title"),
        F.min_by("detail", "seq").alias("detail"),
        F.min_by("severity", F.struct("rank", "seq")).alias("severity"),
        F.array_join(F.array_distinct(ordered("location")), ",").alias("locations"),
        F.array_join(ordered("finding_id"), ",").alias("finding_ids"),
    )
    kind = F.when(F.col("deferred"), "deferred").when(F.col("n_findings") > 1, "convergent").otherwise("distinct")
    return groups.select(F.col("group_key").alias("issue_key"), kind.alias("kind"), "first_seq", "n_findings", "title", "detail", "severity", "locations", "finding_ids")
