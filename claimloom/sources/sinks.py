"""Writers: run artefacts, reports, badges; one row of text each, or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_artefacts(runs: DataFrame, path: str) -> None:
    """One JSON object per run, appended; ``sources.files`` writes a folder per run."""
    runs.write.mode("append").json(path)


#: fixed values: the columns of an evidence matrix, and the row of one without claims
MATRIX = ("claim_id", "status", "trigger", "salience", "verdict", "citation", "claim_text")
NO_CLAIMS = "no claims recorded"


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """K9: the evidence matrix (id, status, ...) with the published columns as text, null as empty; a row that says so where there are no claims."""
    cells = matrix.withColumn("claim_id", F.col("id")).select("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MATRIX])
    none = matrix.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(None).cast("long").alias("id"), F.lit(NO_CLAIMS).alias("claim_id"), *[F.lit("").alias(c) for c in MATRIX[1:]])
    return cells.union(none)


def matrix_csv(matrix: DataFrame, path: str) -> None:
    """K9: the evidence matrix as CSV, in the order of claims."""
    matrix_rows(matrix).orderBy("id").drop("id").write.mode("overwrite").option("header", "true").csv(path)


def matrix_markdown(matrix: DataFrame) -> DataFrame:
    """K9: the evidence matrix as lines of a Markdown table in the order of (part, id): header, rule, claims; ``|`` escaped."""
    head = matrix.sparkSession.createDataFrame([(0, None, "| " + " | ".join(MATRIX) + " |"), (1, None, "|" + " --- |" * len(MATRIX))], "part int, id long, line string")
    cell = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
    return head.union(matrix_rows(matrix).select(F.lit(2), "id", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in MATRIX]), F.lit(" |"))))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One row of metrics as JSON with sorted keys."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def badge_url(label: str, clean: str, score: Column, findings: Column) -> Column:
    """A badge's URL: green and the word ``clean`` without findings, else red with the score."""
    base = f"https://img.shields.io/badge/{label}-"
    return F.when(findings == 0, F.lit(f"{base}{clean}-brightgreen")).otherwise(F.concat(F.lit(base), F.format_number(score, 1), F.lit("%2F10-red")))


def bundle_json(bundles: DataFrame) -> DataFrame:
    """Each bundle as a JSON document."""
    return bundles.select("key", F.to_json(F.struct(*sorted(c for c in bundles.columns if c != "key")), {"ignoreNullFields": "false"}).alias("bundle"))
