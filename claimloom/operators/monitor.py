"""Monitoring of shadow observations and calibration of graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.text import rounded

# fixed values: fewest rows for a trend, and the change of the rate that makes one
LEAST_ROWS, CHANGE = 4, 0.05


def unsupported_rate(detected: Column, supported: Column) -> Column:
    """Share of detected claims without support, four digits, null without claims."""
    return F.when(detected > 0, rounded((detected - supported) / detected, 4))


def valid_counts() -> Column:
    """claim counts that are there, not negative, and supported no more than detected."""
    return F.col("claims_detected").isNotNull() & F.col("claims_supported").isNotNull() & (F.col("claims_supported") >= 0) & (F.col("claims_detected") >= F.col("claims_supported"))


def shadow_metrics(log: DataFrame) -> DataFrame:
    """One row of counters over a shadow log (ts, shadow_status, verdict, claims_detected, claims_supported, malformed)."""
    seen = ~F.col("malformed") & (F.col("shadow_status") == "observed")
    counted = seen & valid_counts()
    sums = log.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if("malformed").alias("malformed_lines"),
        F.count_if(seen).alias("observed"),
        F.count_if(~F.col("malformed") & ~F.coalesce(seen, F.lit(False))).alias("non_observed"),
        F.min(F.when(seen, F.col("ts"))).alias("window_start"),
        F.max(F.when(seen, F.col("ts"))).alias("window_end"),
        F.coalesce(F.sum(F.when(counted, F.col("claims_detected"))), F.lit(0)).alias("detected"),
        F.coalesce(F.sum(F.when(counted, F.col("claims_supported"))), F.lit(0)).alias("supported"),
    )
    return sums.withColumn("unsupported_rate", unsupported_rate(F.col("detected"), F.col("supported")))


def verdict_distribution(log: DataFrame) -> DataFrame:
    """Observed rows by verdict, a missing verdict aside."""
    return log.where(~F.col("malformed") & (F.col("shadow_status") == "observed") & F.col("verdict").isNotNull()).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def status_distribution(log: DataFrame) -> DataFrame:
    """Rows that aren't observed by status, a missing one as unknown."""
    status = F.coalesce("shadow_status", F.lit("unknown"))
    return log.where(~F.col("malformed")).select(status.alias("status")).where("status <> 'observed'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def place_of(rows: DataFrame, order: list[str], place: int, ways: int = 32, few: int = 10_000) -> tuple | None:
    """The values of ``order`` in the row at ``place`` (from 0) in that order; None if there are fewer rows.

    A sample gives bounds of ranges, rows are counted by range, and the search goes on in the range that holds the place until that is
    one value or has few different ones. The driver sees bounds and counts alone, and no task orders all rows.
    """
    key = F.struct(*order)
    left = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    for attempt in range(200):
        size = left.agg(F.count(F.lit(1)).alias("values"), F.sum("_n").alias("rows")).first()
        if place >= (size["rows"] or 0):
            return None
        if size["values"] <= few:
            upto = Window.orderBy(*order)  # few values
            at = left.withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") > place)
            return tuple(at.orderBy(*order).select(*order).first())
        hashed = F.pmod(F.xxhash64(*order, F.lit(attempt)), F.lit(max(1, size["values"] // (8 * ways))))
        some = sorted(tuple(r) for r in left.where(hashed == 0).select(*order).limit(64 * ways).collect())
        bounds = sorted({some[len(some) * i // ways] for i in range(1, ways)}) if some else []
        if not bounds:
            continue
        kinds = [f.dataType for f in left.select(*order).schema]
        literal = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(b, kinds, order)]) for b in bounds]
        within = F.size(F.filter(F.array(*literal), lambda b: b <= key))
        counts = {r["_b"]: r["n"] for r in left.groupBy(within.alias("_b")).agg(F.sum("_n").alias("n")).collect()}
        for bucket in sorted(counts):
            if place < counts[bucket]:
                break
            place -= counts[bucket]
        low = literal[bucket - 1] <= key if bucket else F.lit(True)
        high = key < literal[bucket] if bucket < len(literal) else F.lit(True)
        left = left.where(low & high)
    raise RuntimeError("the ranges don't get smaller")


def shadow_trend(log: DataFrame) -> DataFrame:
    """One row: rates of the earlier and the later half of the claim-bearing rows, and the trend between them.

    Rows are ordered by timestamp, those without one first, then by seq, and by their counts where both are the same. Only the
    row in the middle is looked for; rows before it, and as many of its equals as belong there, are the earlier half.
    """
    order = ["ts", "seq", "claims_detected", "claims_supported"]
    rows = log.where(~F.col("malformed") & (F.col("shadow_status") == "observed") & valid_counts()).select(F.coalesce("ts", F.lit("")).alias("ts"), "seq", "claims_detected", "claims_supported")
    half = rows.count() // 2
    middle = place_of(rows, order, half)
    kinds = [f.dataType for f in rows.schema]
    key, mid = F.struct(*order), F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(middle or [None] * 4, kinds, order)])
    early, same = key < mid, key == mid
    total = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(early).alias("_before"), *[total(c, t).alias(f"_{n}_{c}") for c in order[2:] for n, t in (("early", early), ("all", F.lit(True)))])
    ties = F.lit(half) - F.col("_before")
    own = dict(zip(order, middle or [None] * 4))
    first = {c: F.col(f"_early_{c}") + ties * F.lit(own[c] or 0) for c in order[2:]}
    last = {c: F.col(f"_all_{c}") - first[c] for c in order[2:]}
    sums = sums.select("rows", *[unsupported_rate(*[half_[c] for c in order[2:]]).alias(n) for n, half_ in (("_earlier", first), ("_later", last))])
    enough = F.col("rows") >= LEAST_ROWS
    change = F.col("_later") - F.col("_earlier")
    trend = F.when(~enough | change.isNull(), "insufficient_data").when(change > CHANGE, "worsening").when(change < -CHANGE, "improving").otherwise("stable")
    return sums.select("rows", F.when(enough, F.col("_earlier")).alias("earlier"), F.when(enough, F.col("_later")).alias("later"), trend.alias("trend"))


def calibration(verdicts: DataFrame) -> DataFrame:
    """A10: one row: verdicts, typed ones, those with a confidence, coverage, and the Brier score over them."""
    typed = F.col("verdict").isin("verified", "contradicted")
    scored = typed & F.col("confidence").isNotNull()
    label = F.when(F.col("verdict") == "verified", 1.0).otherwise(0.0)
    sums = verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if(typed).alias("typed"), F.count_if(scored).alias("with_confidence"), F.avg(F.when(scored, F.pow(F.col("confidence") - label, F.lit(2.0)))).alias("brier"))
    return sums.withColumn("coverage", F.when(F.col("total") > 0, F.col("with_confidence") / F.col("total")).otherwise(F.lit(0.0)))
