"""Hook events into the ledger: each event that shows a text with claims becomes a run and its claims.

A batch of a stream is one commit under the stream's name and the batch's number, so a batch that is tried again adds nothing.
Events that are no JSON object are counted in the commit and pass without an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import claims as claim_rows
from claimloom.operators.ledger import Ledger
from claimloom.sources.readers import written_text

#: fixed values: the event that a tool sends, and what any other counts as
TOOL, STOP = "PostToolUse", "Stop"


def said_last(lines: DataFrame) -> DataFrame:
    """Path and text of the last assistant message of each transcript (path, line, value).

    The text is the content, or the text blocks of one that is a list; a list without any passes the turn to the message before.
    Lines that are no JSON object are passed over.
    """
    v = F.try_parse_json("value")
    message = F.coalesce(F.try_variant_get(v, "$.message", "variant"), v)
    content = F.try_variant_get(message, "$.content", "variant")
    kind = F.schema_of_variant(content)
    blocks = F.try_variant_get(content, "$", "array<variant>")
    has = lambda b, name: F.try_variant_get(b, f"$.{name}", "string")
    texts = F.transform(F.filter(blocks, lambda b: has(b, "type") == "text"), lambda b: F.coalesce(has(b, "text"), F.lit("")))
    listed = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    text = F.when(content.isNull(), "").when(kind == "STRING", content.cast("string")).when(F.startswith(kind, F.lit("ARRAY")), listed)
    rows = lines.where(F.try_variant_get(v, "$.type", "string") == "assistant").select("path", "line", text.alias("text")).where("text is not null")
    return rows.groupBy("path").agg(F.max_by("text", "line").alias("text"))


def read_events(events: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """A row per line that isn't blank (value): session_id, source_event, file_path, text and malformed.

    A tool's event shows what the tool has written, any other the last assistant message of its transcript. There is no text
    for a malformed event, nor for a stop that follows on a stop.
    """
    at = lambda path: F.get_json_object("value", f"$.{path}")
    rows = events.where(F.trim("value") != "")
    malformed = ~F.startswith(F.ltrim("value"), F.lit("{")) | F.get_json_object("value", "$").isNull()
    name = F.coalesce(at("hook_event_name"), F.lit(""))
    tool = name == TOOL
    again = (name == STOP) & (F.coalesce(at("stop_hook_active"), F.lit("false")) == "true")
    parsed = rows.select(
        *[c for c in rows.columns if c != "value"],
        F.coalesce(at("session_id"), F.lit("")).alias("session_id"), F.when(name == "", STOP).otherwise(name).alias("source_event"), F.when(tool, at("tool_input.file_path")).alias("file_path"),
        F.when(tool & ~malformed, written_text(F.col("value"))).alias("_written"), F.when(~tool & ~again & ~malformed, at("transcript_path")).alias("_path"), malformed.alias("malformed"),
    )
    if transcripts is None:
        return parsed.withColumnRenamed("_written", "text").drop("_path")
    last = said_last(transcripts).select(F.col("path").alias("_path"), F.col("text").alias("_said"))
    return parsed.join(last, "_path", "left").withColumn("text", F.coalesce("_written", "_said")).drop("_path", "_written", "_said")


def log_events(book: Ledger, events: DataFrame, transcripts: DataFrame | None = None, mode: str = "report", now: Column | None = None, stream: tuple[str, int] | None = None) -> int | None:
    """The events' runs and claims in one commit: its version, or None if the stream's batch is there already."""
    if book.has_batch(stream):
        return None
    spark = book.spark
    path = f"{book.folder}/_staged/{uuid.uuid4().hex}"  # read events once: their keys mustn't change
    read_events(events, transcripts).withColumn("_key", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    found = claim_rows.claim_rows(rows.where(F.trim("text") != "").select("_key", "text"), "_key")
    totals = claim_rows.status_totals(found, "_key")
    when = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    runs = rows.select("_key", "session_id", "source_event", "file_path").join(totals, "_key").withColumns({"ts": when, "mode": F.lit(mode)})
    counts = rows.agg(F.count(F.lit(1)).alias("events"), F.count_if("malformed").alias("malformed")).first()
    claims = found.select("_key", "pos", "status", "trigger", F.col("snippet").alias("claim_text"))
    done = book.log_runs(runs, claims, "_key", ["_key"], stream, {"events": counts["events"], "malformed": counts["malformed"]})
    book.drop_staged(path)
    return done


def follow(book: Ledger, events: DataFrame, checkpoint: str, name: str = "events", **options):
    """A stream of event lines into the ledger, over what there is; returns the running query."""
    def each(batch: DataFrame, number: int) -> None:
        log_events(book, batch, stream=(name, number), **options)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
