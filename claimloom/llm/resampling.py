"""Resampling documents towards a target distribution: hashed word-run features, array scores, an exact score histogram.

1. A text's features are all runs of one to three words; a feature's bucket is its CRC-32 modulo ``BUCKETS``. One pass counts
   the buckets of all documents, a second those of the target. A bucket's gain is the scaled logarithm of the ratio of its
   smoothed shares; the gains are an array of ``BUCKETS`` numbers, whatever the input.
2. A second pass over the documents adds up the gains of each one's features, its weight. The score is the weight and a
   Gumbel number drawn from the doc_id's hash, so that the highest scores are a draw without replacement.
3. The scores of all documents that take part are counted by value. Sums from the highest down, range by range, say how many
   documents are above each score; the scores with fewer than wanted above them survive. Within a score documents are
   numbered by doc_id, in ranges, too, so that no task holds all documents of one score.

CRCs of runs are put together from the CRCs of their words: ``crc(a + b)`` is ``crc(a)`` moved on by the bytes of ``b``, XOR
``crc(b)``, and moving on is linear, so tables do it for many words at once.

Defined results: a null text, or one without words, has no features and the weight 0; documents of fewer than ``least``
words are scored and never drawn; a null doc_id counts as an empty string in the hash and comes last among equal scores;
rows are documents, so that rows which share a doc_id, a text or both each have a row and a rank of their own; an empty target
counts nothing; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.shared import fresh, materialize, slices, text_column

BUCKETS, SCALE, SEED = 10_000, 1000, "42"
#: Bytes of a text that are looked at together.
PIECE = 1 << 20

_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: CRC-32's remainders of single bytes.
_CRC = np.array([zlib.crc32(bytes([c]), 0xFFFFFFFF) ^ 0xFFFFFFFF for c in range(256)], np.uint32)


def _advance_tables(most: int) -> tuple[np.ndarray, np.ndarray]:
    """What each byte of a CRC becomes after 0 to ``most`` zero bytes, and after 1, 2, 4, ... zero bytes."""
    step = lambda v: _CRC[v & np.uint32(255)] ^ (v >> np.uint32(8))
    every = [np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))]
    for _ in range(most):
        every.append(step(every[-1]))
    doubled = [every[1]]
    for _ in range(31):
        doubled.append(_looked_up(doubled[-1], doubled[-1]))
    return np.stack(every), np.stack(doubled)


def _looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return table[0][crc & low] ^ table[1][(crc >> np.uint32(8)) & low] ^ table[2][(crc >> np.uint32(16)) & low] ^ table[3][crc >> np.uint32(24)]


_EVERY, _DOUBLED = _advance_tables(64)


def advance(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many zero bytes each."""
    near, low = np.minimum(by, 64), np.uint32(255)
    out = _EVERY[near, 0, crc & low] ^ _EVERY[near, 1, (crc >> np.uint32(8)) & low] ^ _EVERY[near, 2, (crc >> np.uint32(16)) & low] ^ _EVERY[near, 3, crc >> np.uint32(24)]
    for i in np.flatnonzero(by > 64):  # long words are few
        rest, v = int(by[i]) - 64, out[i : i + 1]
        for k in range(rest.bit_length()):
            if rest >> k & 1:
                v = _looked_up(_DOUBLED[k], v)
        out[i] = v[0]
    return out


def features(data: np.ndarray, bounds: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts put together: each feature's text, its CRC, and the words of each text. Runs that end in the first ``skip`` words aren't counted."""
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], word[:-1]])[: len(word)]
    after = np.concatenate([word[1:], [False]])[: len(word)]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    size = stop - start
    places = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(low[word])]).dictionary_encode()
    alone = [zlib.crc32(x) for x in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy(zero_copy_only=False)
    one = np.array(alone, np.uint32)[at]
    spaced = np.array([zlib.crc32(b" ", x) for x in alone], np.uint32)[at]
    text = np.searchsorted(bounds, start, "right") - 1
    owners, crcs = [text[skip:]], [one[skip:]]
    two = advance(spaced[:-1], size[1:])
    same = text[1:] == text[:-1]
    same[: max(0, skip - 1)] = False
    owners.append(text[1:][same])
    crcs.append((two ^ one[1:])[same])
    if len(start) > 2:
        pair = advance(spaced[:-2], size[1:-1] + 1) ^ spaced[1:-1]
        same = text[2:] == text[:-2]
        same[: max(0, skip - 2)] = False
        owners.append(text[2:][same])
        crcs.append((advance(pair[same], size[2:][same])) ^ one[2:][same])
    return np.concatenate(owners), np.concatenate(crcs), np.bincount(text[skip:], minlength=len(bounds) - 1)


def _parts(batch: pa.RecordBatch):
    """The texts of a slice: rows, bytes, bounds and words to skip; a long text comes in pieces that begin with the two words before."""
    texts = pa.concat_arrays([batch.column("text").cast(pa.large_binary())])
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if len(data) <= 2 * PIECE:
        yield np.arange(batch.num_rows), data, bounds, 0
        return
    row = np.argmax(np.diff(bounds), keepdims=True)  # the others of its slice are empty
    at, kept = 0, []
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and _IS_WORD[data[stop - 1]] and _IS_WORD[data[stop]]:
            ends = np.flatnonzero(~_IS_WORD[data[stop : stop + PIECE]])
            stop += int(ends[0]) if len(ends) else PIECE
        piece = data[at:stop]
        lead = np.frombuffer(b"".join(x + b" " for x in kept), np.uint8)
        joined = np.concatenate([lead, piece])
        yield row, joined, np.array([0, len(joined)]), len(kept)
        at, kept = stop, _last_words(joined)


def _last_words(data: np.ndarray) -> list[bytes]:
    """The last two words."""
    word = np.concatenate([[False], _IS_WORD[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return [data[a:b].tobytes() for a, b in edges.reshape(-1, 2)[-2:]]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket has."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices([batch], most=PIECE):
                for _, data, bounds, skip in _parts(part):
                    total += np.bincount(features(data, bounds, skip)[1] % np.uint32(BUCKETS), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(text_column().alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)  # as many rows as there are buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's scaled logarithm of target share to corpus share, with one added to each count."""
    every, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log(float(t + 1) * every / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""

    def weigh(batches):
        for batch in slices(batches, most=PIECE):
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, data, bounds, skip in _parts(batch):
                owner, crc, count = features(data, bounds, skip)
                k = len(rows)
                n[rows] += np.bincount(owner, minlength=k)
                words[rows] += count
                weight[rows] += np.bincount(owner, gain[crc % np.uint32(BUCKETS)], k).astype(np.int64)  # whole numbers far below 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document, written, with a number of the row."""
    rows = weighed(docs, gains(bucket_counts(docs), bucket_counts(target)))
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-float(SCALE) * F.ln(-F.ln(share)))
    return materialize(rows.withColumn("score", score.cast("long")).withColumn("row", F.monotonically_increasing_id()), "resample-scores")


def above(rows: DataFrame) -> DataFrame:
    """Each score's documents (n) and those of higher scores (above), written."""
    counted = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counted.repartitionByRange(F.col("score").desc()).withColumn("part", F.spark_partition_id()), "resample-histogram")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each range
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    within = ranged.withColumn("higher", before(Window.partitionBy("part").orderBy(F.col("score").desc())))
    return materialize(within.join(parts, "part").select("score", "n", (F.col("higher") + F.col("base")).alias("above")), "resample-above")


def draw(rows: DataFrame, percent: int = 5, least: int = 20) -> DataFrame:
    """The scored rows with their rank, null where not drawn: ``percent`` of those with ``least`` words, rounded down."""
    fit = rows.where(F.col("n_words") >= least)
    want = percent * fit.count() // 100
    unranked = F.lit(None).cast("long").alias("rank")
    names = [k for k in rows.columns if k != "row"]
    if not want:
        return rows.select(*names, unranked)
    levels = above(fit).where(F.col("above") < want)
    cutoff = levels.agg(F.min("score")).first()[0]
    order = ["score", F.col("doc_id").asc_nulls_last(), "row"]
    ahead = fit.where(F.col("score") >= cutoff).repartitionByRange(*order).withColumn("span", F.spark_partition_id())
    ahead = materialize(ahead, "resample-drawn")
    spans = ahead.groupBy("score", "span").agg(F.count(F.lit(1)).alias("m"))  # of a score, a row for each range
    before = F.coalesce(F.sum("m").over(Window.partitionBy("score").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = materialize(spans.withColumn("before", before).join(levels.select("score", "above"), "score").select("score", "span", (F.col("before") + F.col("above")).alias("base")), "resample-spans")
    place = F.row_number().over(Window.partitionBy("score", "span").orderBy(F.col("doc_id").asc_nulls_last(), "row"))
    rank = (F.col("base") + F.col("place")).cast("long")
    drawn = ahead.withColumn("place", place).join(spans, ["score", "span"]).select(*names, F.when(rank <= want, rank).alias("rank"))
    rest = rows.where((F.col("n_words") < least) | (F.col("score") < cutoff))
    return drawn.unionByName(rest.select(*names, unranked))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20) -> tuple[DataFrame, str]:
    """The drawn documents, with their columns and a rank, and that column's name; rows that share a doc_id come along with the best of them."""
    rank, own = fresh(docs.columns, "rank"), fresh(docs.columns, "_drawn")
    best = draw(scored(docs, target), percent, least).where("rank is not null").groupBy("doc_id").agg(F.min("rank").alias(rank))
    best = materialize(best.withColumnRenamed("doc_id", own), "resample-best")
    return docs.join(best, F.col("doc_id").eqNullSafe(F.col(own))).drop(own), rank
