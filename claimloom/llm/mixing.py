"""Mixing sources by temperature: exponentiated token shares, realised as budgeted block permutations.

Tokens are those of a vocabulary, counted over every whole text by the encoder that packing uses, without the end id. Where
a caller names no vocabulary, words stand for them.

A source with a share p of all tokens gets a weight in proportion to p ** a. The exponent a is bisected, many points at a
time, each round being one aggregate over the table of sources: the largest a in [0, 1] whose weights reach a target entropy
(a share of the largest possible), but no smaller than the least a at which no source is repeated more than a limit allows.

A weight becomes a token budget, and a budget a number of whole passes over the source and a part of another. In each pass
the source's documents are dealt to blocks by hash, and blocks and the documents in them are put in a pseudo-random order of
that pass. The part takes whole blocks in that order and, of the block in which the budget ends, documents in order as long
as they fit. So one row per source says which documents the part has, documents need no ordering among all of their source,
and a source of any size is spread over all tasks.

Without a budget the mix is as large as it must be for every source to be used at least once; then no document is lost.

Defined results: a null source is a source of its own; null and empty texts have no tokens (nor have, where words stand for
them, texts without words) and, like sources of no tokens at all, are used once per whole pass (at least once); repeated rows are mixed one by one, those of one doc_id
alike; an empty table gives an empty result; columns of the input stay, and new ones get names distinct from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.encoding import WORDS, encoder
from claimloom.llm.shared import WHITE_CLASS, fresh, materialize, slices, text_column

#: Documents of a block, about.
BLOCK_DOCS = 4096


@dataclass(frozen=True)
class Mix:
    """Production parameters."""

    entropy: float = 0.97  # of the largest possible
    repeats: float = 1.5  # passes over any source against the least used one
    tokens: float | None = None  # of the whole mix
    seed: int = 11


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, WHITE_CLASS + "+"), "")).cast("long")


def token_counts(docs: DataFrame, vocabulary: str | None, words: int = WORDS) -> DataFrame:
    """doc_id, key of the source and tokens of each document."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"), text_column().alias("text"))
    if vocabulary is None:
        return keyed.select("doc_id", "key", word_count(F.col("text")).alias("tokens"))

    def count(batches):
        coder = encoder(vocabulary, limit=words)
        for batch in slices(batches, most=3 << 20):
            n = pa.array(coder.counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), n], names=["doc_id", "key", "tokens"])

    return keyed.mapInArrow(count, "doc_id long, key string, tokens long")


def source_key(source: Column) -> Column:
    """Tells a null source from any name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _largest(sources: DataFrame, good, low: float = 0.0, high: float = 1.0, rounds: int = 6, points: int = 16) -> float:
    """The largest exponent in [low, high] that is ``good``, which must hold up to some exponent and not beyond; else low."""
    for _ in range(rounds):
        grid = [low + (high - low) * i / points for i in range(points + 1)]
        row = sources.agg(*[good(F.lit(a)).alias(f"g{i}") for i, a in enumerate(grid)]).first()
        held = [i for i in range(points + 1) if row[i]]
        if not held:
            return low
        if held[-1] == points:
            return high
        low, high = grid[held[-1]], grid[held[-1] + 1]
    return low


def _least(sources: DataFrame, good, **options) -> float:
    """The least exponent in [0, 1] that is ``good``, which must hold from some exponent on; else 1."""
    return 1.0 - _largest(sources, lambda x: good(F.lit(1.0) - x), **options)


def exponent(sources: DataFrame, mix: Mix) -> float:
    """Of sources with tokens (column p, their shares)."""

    def even(a: Column) -> Column:
        power = F.pow("p", a)
        z = F.sum(power)
        entropy = F.log(z) - a * F.sum(power * F.log("p")) / z
        return F.coalesce(entropy >= mix.entropy * F.log(F.count(F.lit(1)).cast("double")) - 1e-12, F.lit(False))

    def seldom(a: Column) -> Column:
        passes = F.pow("p", a - 1)
        return F.coalesce(F.max(passes) <= mix.repeats * F.min(passes) * (1 + 1e-12), F.lit(False))

    return max(_largest(sources, even), _least(sources, seldom))


def plan(docs: DataFrame, mix: Mix, vocabulary: str | None = None, words: int = WORDS) -> DataFrame:
    """A row per source: key, tokens, weight, whole passes, and the last block and document hash of the part (null: none)."""
    counted = materialize(token_counts(docs, vocabulary, words), "mixing-counts")
    totals = materialize(counted.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-sources")
    every = totals.agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).first()
    tokens, bits = every["tokens"] or 0, max(0, (int(every["docs"] or 0) // BLOCK_DOCS).bit_length())
    shared = totals.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(tokens or 1)))
    a = exponent(shared, mix)
    row = shared.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("least")).first()
    weight = F.pow("p", F.lit(a)) / F.lit(row["z"] or 1.0)
    if mix.tokens is None:
        passes = F.pow("p", F.lit(a - 1)) / F.lit(row["least"] or 1.0)
    else:
        passes = weight * F.lit(float(mix.tokens)) / F.col("tokens")
    budgets = shared.select("key", "tokens", weight.alias("weight"), passes.alias("passes"))
    budgets = budgets.withColumn("whole", F.floor("passes").cast("int"))
    budgets = materialize(budgets.withColumn("rest", F.floor((F.col("passes") - F.col("whole")) * F.col("tokens")).cast("long")), "mixing-budgets")

    parts = counted.join(budgets.where("rest > 0").select("key", "whole", "rest"), "key")
    parts = parts.withColumn("block", block(bits, mix, F.col("whole"), F.col("key"), F.col("doc_id")))
    in_source = Window.partitionBy("key").orderBy("block")
    blocks = parts.groupBy("key", "whole", "rest", "block").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(in_source))
    last = blocks.where("upto > rest and upto - n <= rest").select("key", "block", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    in_block = Window.partitionBy("key").orderBy("order")
    edge = parts.join(last, ["key", "block"]).withColumn("order", order(mix, F.col("whole"), F.col("doc_id")))
    edge = edge.withColumn("upto", F.sum("tokens").over(in_block)).where("upto <= room").groupBy("key").agg(F.max("order").alias("last_order"))
    ends = last.select("key", F.col("block").alias("last_block")).join(edge, "key", "left")
    found = totals.select("key").join(budgets, "key", "left").join(ends, "key", "left")
    whole = F.when(F.col("tokens").isNull(), F.lit(1)).otherwise(F.col("whole"))
    return materialize(found.select("key", F.col("weight"), whole.alias("whole"), "last_block", "last_order", F.lit(bits).alias("bits")), "mixing-plan")


def block(bits: int | Column, mix: Mix, turn: Column, key: Column, doc_id: Column) -> Column:
    """The place of a document's block in the order of a pass over its source."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    lot = F.pmod(F.xxhash64(F.lit(mix.seed), doc_id), F.call_function("shiftleft", F.lit(1).cast("long"), bits))
    return F.xxhash64(F.lit(mix.seed + 1), turn, key, lot)


def order(mix: Mix, turn: Column, doc_id: Column) -> Column:
    """The place of a document within its block in a pass."""
    return F.xxhash64(F.lit(mix.seed + 2), turn, doc_id)


def mix_sources(docs: DataFrame, mix: Mix = Mix(), vocabulary: str | None = None, words: int = WORDS) -> tuple[DataFrame, list[str]]:
    """A row per use of a document, with its columns and four more: pass, block place, place in the block, source weight.

    ``words`` is how many words a worker's encoder remembers; it takes memory and saves time, and changes no result.

    The second value has the new columns' names. Sorting by the first three gives a source's order in the mix.
    """
    found = plan(docs, mix, vocabulary, words)
    names = docs.columns
    key, turn, place, within, weight = (fresh(names, n) for n in ("_key", "_pass", "_block", "_order", "_weight"))
    whole, last, end, bits, uses = (fresh(names, n) for n in ("_p_whole", "_p_block", "_p_order", "_p_bits", "_p_uses"))
    planned = found.select(
        F.col("key").alias(key), F.col("weight").alias(weight), F.col("whole").alias(whole), F.col("last_block").alias(last), F.col("last_order").alias(end), F.col("bits").alias(bits)
    )
    keyed = docs.withColumn(key, source_key(F.col("source"))).join(planned, key)
    doc_id = F.col("doc_id").cast("long")
    at, inside = block(F.col(bits), mix, F.col(whole), F.col(key), doc_id), order(mix, F.col(whole), doc_id)
    in_part = F.coalesce((at < F.col(last)) | ((at == F.col(last)) & (inside <= F.col(end))), F.lit(False))
    used = keyed.withColumn(uses, F.col(whole) + in_part.cast("int")).where(F.col(uses) > 0).withColumn(turn, F.explode(F.sequence(F.lit(0), F.col(uses) - 1)))
    out = used.withColumn(place, block(F.col(bits), mix, F.col(turn), F.col(key), doc_id)).withColumn(within, order(mix, F.col(turn), doc_id))
    return out.select(*names, turn, place, within, weight), [turn, place, within, weight]
