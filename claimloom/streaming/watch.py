"""Structured Streaming over drafts and shadow logs. Batches go through the same operators as tables do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from claimloom.functions.text import parse_timestamp
from claimloom.operators import claims
from claimloom.sources import readers


def watch_drafts(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    """A stream of drafts from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def claim_stream(drafts: DataFrame) -> DataFrame:
    """Claims of a stream of drafts; stateless, as the next sentence is one of the same document."""
    return claims.claim_rows(drafts)


def append_claims(drafts: DataFrame, out: str, checkpoint: str):
    """Append each batch's claims to a Parquet table; runs over what there is, then ends."""
    return claim_stream(drafts).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def shadow_rates(spark: SparkSession, folder: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Detected and supported claims per window of a stream of shadow logs; rows later than ``late`` are left out."""
    rows = readers.shadow_log(spark.readStream.text(folder)).where("not malformed and shadow_status = 'observed'")
    timed = rows.withColumn("at", parse_timestamp(F.col("ts"))).withWatermark("at", late)
    sums = timed.groupBy(F.window("at", width).alias("span")).agg(F.sum("claims_detected").alias("detected"), F.sum("claims_supported").alias("supported"))
    return sums.select(F.col("span.start").alias("start"), "detected", "supported")


def new_holds(holds: DataFrame, late: str = "1 day") -> DataFrame:
    """Hand-backs (run_id, hold_count, at) not seen before within the watermark."""
    return holds.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "hold_count"])


def handbacks(holds: DataFrame, forget: str = "7 days", late: str = "1 day") -> DataFrame:
    """Of a stream of holds (run_id, hold_count, at) those to hand back, as ``operators.holds.handed_back`` has them of a table.

    The state of a run is the count and time of its last hold. A timer drops it when the watermark has passed ``forget`` beyond
    that time; a hold that comes later than that is handed back whether or not the timer has run. Within a batch holds
    are taken in order of time; those older than the watermark are left out, and those older than the run's last are taken as they come.
    """
    span = pd.Timedelta(forget)

    def each(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        count, when = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("at", kind="stable")
        out = []
        for at, held in zip(rows["at"], rows["hold_count"]):
            now = at.value // 1000
            if held > 0:
                if held != count or now - when > span.value // 1000:
                    out.append((key[0], int(held), at))
                count, when = int(held), now
        if count is not None:
            state.update((count, when))
            ends = (when + span.value // 1000) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "hold_count", "at"])

    rows = holds.where("hold_count > 0").withWatermark("at", late).select(F.col("run_id").cast("string").alias("run_id"), F.col("hold_count").cast("long").alias("hold_count"), "at")
    return rows.groupBy("run_id").applyInPandasWithState(each, "run_id string, hold_count long, at timestamp", "hold_count long, at long", "append", GroupStateTimeout.EventTimeTimeout)
