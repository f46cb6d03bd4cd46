"""Labelled corpora in JSON lines: a table of constraints, compiled into one pass that tells good lines from rejects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import claims as C
from claimloom.functions import rules as R
from claimloom.functions.text import lines, strip
from claimloom.operators.claims import graded_in_turn

# fixed values: the labels of the two axes
AXIS1 = ("supported", "tagged", "unsupported")
AXIS2 = ("na", "skipped", "unverifiable", "verified")
#: Labels of a grader's corpus: all grades but an error.
GOLD = tuple(g for g in R.GRADES if g != "error")


class Constraint(NamedTuple):
    """What a line must not be, and what to say of one that is; the first of a table that holds decides."""

    reason: str
    broken: Callable[[Column], Column]


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def string(v: Column, name: str) -> Column:
    """A field that is a string; null for any other value."""
    return F.when(kind(field(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def elements(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def outside(value: Column, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(value.isin(list(allowed)), F.lit(False))


def missing(name: str) -> Constraint:
    return Constraint(f"missing field {name}", lambda v: field(v, name).isNull())


SHAPE = (Constraint("not JSON", lambda v: v.isNull()), Constraint("not an object", lambda v: ~F.startswith(kind(v), F.lit("OBJECT"))))
#: Items with the claims that a reader found in them: id, text, gold [{claim, axis1, axis2}].
CLAIMS = (
    *SHAPE, *map(missing, ("id", "text", "gold")),
    Constraint("gold is not a list", lambda v: ~F.startswith(kind(field(v, "gold")), F.lit("ARRAY"))),
    Constraint("axis1 label", lambda v: F.exists(elements(v, "gold"), lambda g: outside(string(g, "axis1"), AXIS1))),
    Constraint("axis2 label", lambda v: F.exists(elements(v, "gold"), lambda g: outside(string(g, "axis2"), AXIS2))),
)
#: Claims with the grade that is right for them: id, claim, gold, and if given citation and source.
GRADES = (*SHAPE, *map(missing, ("id", "claim", "gold")), Constraint("gold label", lambda v: outside(string(v, "gold"), GOLD)))
LATE = tuple(Constraint(f"{n} is no string", lambda v, n=n: ~kind(field(v, n)).isin("MISSING", "VOID", "STRING")) for n in ("citation", "source"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and value of each line of the files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(lines(F.col("value"))).alias("_i", "value"))
    return whole.select("path", (F.col("_i") + 1).alias("line"), "value")


def reason(v: Column, table: Sequence[Constraint]) -> Column:
    return F.coalesce(*[F.when(c.broken(v), F.lit(c.reason)) for c in table])


def checked(rows: DataFrame, table: Sequence[Constraint] = GRADES, late: Sequence[Constraint] = ()) -> DataFrame:
    """Lines (line, value) that aren't blank, as line, v (a variant), id and error; null errors are of good lines.

    Of lines that fulfil ``table`` and share an id, all but the first are duplicates, and so are repeated rows of one line but
    for one. ``late`` is asked for after that. An id is told by its JSON form. Further columns are dropped.
    """
    parsed = rows.where(strip(F.coalesce("value", F.lit(""))) != "").select("line", F.try_parse_json("value").alias("v"))
    judged = parsed.select("line", "v", F.to_json(field(F.col("v"), "id")).alias("id"), reason(F.col("v"), table).alias("error"))
    first = judged.where("error is null").groupBy(F.col("id").alias("_of")).agg(F.min("line").alias("_first"))
    # lines without an id, which may be most of them, match none; they are dealt by line instead of all to the task of nulls
    of = F.coalesce("id", F.concat(F.lit("\0"), F.col("line").cast("string")))
    joined = judged.join(first, of == F.col("_of"), "left")
    error = F.coalesce("error", F.when(F.col("line") != F.col("_first"), F.lit("duplicate id")), reason(F.col("v"), late) if late else F.lit(None))
    return joined.select("line", "v", "id", error.alias("error"))


def rejects(found: DataFrame) -> DataFrame:
    """Lines and why they were refused."""
    return found.where("error is not null").select("line", "id", F.col("error").alias("reason"))


def claim_items(found: DataFrame) -> DataFrame:
    """Id, text and gold claims of the good lines of a corpus of items."""
    v = F.col("v")
    gold = F.transform(elements(v, "gold"), lambda g: F.struct(string(g, "claim").alias("claim"), string(g, "axis1").alias("axis1"), string(g, "axis2").alias("axis2")))
    return found.where("error is null").select("line", "id", F.try_variant_get(v, "$.text", "string").alias("text"), gold.alias("gold"))


def grade_items(found: DataFrame) -> DataFrame:
    """Id, claim, citation, source and gold of the good lines of a grader's corpus."""
    v = F.col("v")
    return found.where("error is null").select("line", "id", F.try_variant_get(v, "$.claim", "string").alias("claim"), string(v, "citation").alias("citation"), string(v, "source").alias("source"), string(v, "gold").alias("gold"))


def required(found: DataFrame) -> DataFrame:
    """``found`` if no line was refused and there is one; else the first refusal is raised."""
    bad = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error"))).alias("e")).first()
    if bad["n"] == 0:
        raise ValueError("the corpus is empty")
    if bad["e"] is not None:
        raise ValueError(f"corpus line {bad['e']['line']}: {bad['e']['error']}")
    return found


def graded_corpus(items: DataFrame, graders: Sequence = ()) -> DataFrame:
    """Id, gold and predicted grade of the items of a grader's corpus, for ``evaluate.per_class`` and the like."""
    rows = items.select("id", "gold", F.col("claim").alias("sentence"), "citation", F.col("source").alias("source_text"))
    if not graders:
        return rows.select("id", "gold", C.heuristic_grade(F.col("sentence"), F.col("source_text"), F.col("citation")).alias("pred"))
    return graded_in_turn(rows, graders).select("id", "gold", F.col("verdict").alias("pred"))
