"""Evaluation against gold labels: alignment, precision, recall, F1, confusion, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import rules as R
from claimloom.functions.text import squash


def align(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each gold claim (item_id, claim, gold) with the status of the first predicted row (item_id, pos, snippet, status)
    that contains it or is contained in it; null without one."""
    g = gold.withColumn("_g", squash(F.col("claim")))
    p = predicted.select(F.col("item_id").alias("_item"), "pos", "status", squash(F.col("snippet")).alias("_p"))
    near = (F.col("item_id") == F.col("_item")) & (F.contains(F.col("_p"), F.col("_g")) | F.contains(F.col("_g"), F.col("_p")))
    return g.join(p, near, "left").groupBy("item_id", "claim", "gold").agg(F.min_by("status", "pos").alias("pred"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def positive_class(rows: DataFrame, positive: str) -> DataFrame:
    """One row of counts and scores of one class over rows (gold, pred)."""
    g, p = F.col("gold") == positive, F.coalesce(F.col("pred") == positive, F.lit(False))
    counts = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def per_class(rows: DataFrame, classes: tuple[str, ...] = R.GRADES) -> DataFrame:
    """A row per class, each against the rest; all counts in one aggregate."""
    spark: SparkSession = rows.sparkSession
    pairs = rows.groupBy("gold", F.coalesce("pred", F.lit("(none)")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(c,) for c in classes], "class string")
    g, p = F.col("gold") == F.col("class"), F.col("pred") == F.col("class")
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    counts = dim.join(pairs, g | p, "left").groupBy("class").agg(total(g & p, "tp"), total(~g & p, "fp"), total(g & ~p, "fn"), total(g, "support"))
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(classes: DataFrame) -> DataFrame:
    """Unweighted means over the classes."""
    return classes.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def confusion(rows: DataFrame) -> DataFrame:
    """Rows by gold and predicted class, a missing prediction as ``(none)``."""
    return rows.groupBy("gold", F.coalesce("pred", F.lit("(none)")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame) -> DataFrame:
    """Per gold class the rows, the right ones, and their share."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    return rows.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right")).withColumn("accuracy", F.col("right") / F.col("n"))


def duplicate_ids(items: DataFrame) -> DataFrame:
    """Ids that a corpus has more than once."""
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
