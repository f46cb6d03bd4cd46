"""Packing by shortest-pack-first over the length histogram.

Documents become token pieces of at most ``most`` ids. Only the histogram of piece lengths (at most ``most`` rows, so its
size is bounded) goes to the driver, which places lengths longest first, each into the open pattern with the least content.
The patterns are joined back to the pieces by length and rank: of each length, its intervals of ranks are sorted, and a piece
finds its own by binary search. Of these intervals there are at most 63 a pattern, and of patterns at most three a length.

Defined results: a null text is an empty one (a piece of the end id only); repeated documents are packed once each; a null
identifier packs like any other; an empty input gives no pieces; further input columns play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from claimloom.llm.encoding import WORDS, encoder
from claimloom.llm.shared import materialize, slices, text_column

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, most: int = 2048, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Cut each document's ids, and the end id, into pieces of ``most`` ids and a rest."""

    def cut(batches):
        coder = encoder(vocabulary, limit=words)
        for batch in slices(batches, most=3 << 20):
            rows, held = [], []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                wide = np.append(ids.astype("<u4"), np.uint32(end_id))
                for start in range(0, len(wide), most):
                    part = wide[start : start + most]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(wide)))
                    if with_ids:
                        held.append(part)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def patterns(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used.

    Lengths are taken longest first. Those of a length go to the open patterns with the least content as long as they fit,
    and what is left of a pattern's count stays open as it was; lengths that fit nowhere open patterns of their own.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by the room that is left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = most - 1
        while left and room >= length:
            if not open_.get(room):
                room -= 1
                continue
            pattern, count = open_[room].pop()
            used = min(count, left)
            if used < count:
                open_[room].append((pattern, count - used))
            open_[room - length].append((pattern + (length,), used))
            left -= used
        while left:
            # with nothing open, those that are left share new patterns of as many as fit
            fit = most // length
            each, rest = divmod(left, fit)
            used = each or 1
            n = fit if each else rest
            open_[most - n * length].append(((length,) * n, used))
            left -= used * n
    return [x for room in sorted(open_) for x in open_[room]]


def places(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length in it: length, first rank, first sequence, sequences, first offset, places of that length.

    The lengths of a pattern fall, and at most 63 different ones fit into 2048, so this is small however often one occurs.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in found:
        offset = at = 0
        while at < len(pattern):
            length = pattern[at]
            times = pattern.count(length)
            rows.append((length, taken[length], sequence, count, offset, times))
            taken[length] += count * times
            offset += length * times
            at += times
        sequence += count
    return rows


class Slots:
    """Finds the sequence and offset of pieces by length and rank."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int]]):
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 6)
        lengths = self.rows[:, 0]
        self.begins = {int(k): (int(np.searchsorted(lengths, k)), int(np.searchsorted(lengths, k, "right"))) for k in np.unique(lengths)}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search among the first ranks of each length's slots."""
        at = np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            a, b = self.begins[k]
            here = length == k
            at[here] = a + np.searchsorted(self.rows[a:b, 1], rank[here], "right") - 1
        _, first, sequence, count, offset, _ = self.rows[at].T
        return sequence + (rank - first) % count, offset + length * ((rank - first) // count)


def pack(parts: DataFrame, most: int = 2048, lane_rows: int = 1 << 10) -> DataFrame:
    """Give each piece (columns length, doc_id, start and any more) its sequence_id and offset.

    ``parts`` must be a written table, as it is read several times. Ranks within a length are made of a lane's offset and the
    rank within the lane. A length has a lane for every ``lane_rows`` pieces, so that a common one is ordered by many tasks.
    """
    spark = parts.sparkSession
    rows = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``most`` rows
    histogram = {r["length"]: r["n"] for r in rows}
    lanes = spark.createDataFrame([(k, -(-n // lane_rows)) for k, n in histogram.items()], "length long, _lanes long")
    dealt = parts.join(F.broadcast(lanes), "length").withColumn("_lane", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "_lanes")).drop("_lanes")
    counts = materialize(dealt.groupBy("length", "_lane").agg(F.count(F.lit(1)).alias("_n")), "packing-lanes")
    before = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("length", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "packing-offsets")
    within = Window.partitionBy("length", "_lane").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_in_lane", F.row_number().over(within) - 1).join(offsets, ["length", "_lane"])
    ranked = ranked.select(*parts.columns, (F.col("_in_lane") + F.col("_before")).alias("_rank"))
    slots = spark.sparkContext.broadcast(Slots(places(patterns(histogram, most))))

    def place(batches):
        for batch in batches:
            sequence, offset = slots.value.find(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            kept = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, most: int = 2048, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Tokenize, cut and pack whole documents: a row per piece. ``words`` is how many of them a worker's encoder remembers."""
    return pack(materialize(pieces(docs, vocabulary, end_id, most, with_ids, words), "packing-pieces"), most)
