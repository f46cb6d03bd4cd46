"""Removal of repeated passages by longest-previous-factor arrays over a sparse suffix order.

Every text is its UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
that comes before, or earlier in the same one. The first of all such strings stays. Matches never cross documents.

1. Each window of ``length`` bytes has an anchor: its leftmost gram of least hash. Equal windows have their anchors at the same
   place, so that a gram's occurrences as an anchor hold every repeat. Windows that share an anchor form a run, about 30 windows.
2. Runs are sorted by gram, bytes (as a hash) and position, in ranges over all tasks. Of equal runs the first stays and the others
   are repeats as a whole. A run whose gram has other bytes around it elsewhere is kept for step 3; all other runs are done.
3. The bytes of these runs are read from their texts. Runs of one gram meet in one group: its suffix order is built by
   prefix doubling, the previous and next smaller positions in that order and their common prefixes give each window's longest
   previous factor, and those of at least ``length`` bytes are removed. The runs of a gram with more than ``LIMIT`` different ones
   are cut by the distance of their windows from the gram. Windows of near distances have more than the gram in common, so the
   pieces go through steps 2 and 3 with a longer gram each; at the last, a gram is a whole window.
4. A document's removed spans are put together, and what is left is hashed.

A run of bytes in a gram's group is told from another by 64 bits of hash besides those of its gram.

Defined results: a null text is empty and loses nothing; a text shorter than ``length`` stays as it is; a null doc_id comes after
all others; rows that share a doc_id but not a text are documents of their own, in the order of their texts' hashes; rows that
share both are one document (a result row each, with the same values); an empty table gives an empty result; further columns
play no part.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.shared import materialize, slices, text_column

#: Bytes of a gram, at most.
GRAM = 32
#: Different runs of one gram that are compared in one group.
LIMIT = 256
#: Bytes of a text that are searched for anchors at once.
PIECE = 1 << 20
#: Pieces that a run of a frequent gram is cut into.
WAYS = 4
#: What a row is: a repeat, a run for step 3, a task's first row, its last row.
REPEAT, OPEN, FIRST, LAST = range(4)

_LOW = np.uint64((1 << 21) - 1)  # places within a piece
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # fixed values of known 64-bit mixers
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2)  # the hash is a fixed part of the method
_NO_DOC = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_bytes(length: int) -> int:
    """The largest power of two up to ``GRAM`` and ``length``."""
    return 1 << (min(GRAM, length).bit_length() - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2 ** 64."""
    factor = 0x9E3779B97F4A7C15
    back = pow(factor, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (factor, back))


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each place on, by doubling."""
    x, size = _BYTES[data], 1
    while size < gram:
        x = _mixed(x[:-size] * _STEP + x[size:])
        size *= 2
    return x


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in neighbouring texts: text, first window's place, windows, gram hash, hash of the bytes."""
    gram, n = gram_bytes(length), len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    x = gram_hashes(data, gram)
    least = window_least((x & ~_LOW) | np.arange(len(x), dtype=np.uint64), length - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    window = np.flatnonzero(text[:n] == text[length - 1 :])
    if not len(window):
        return (np.zeros(0, np.int64),) * 5
    anchor = (least[window] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(window) != 1)]))
    start, windows = window[first], np.diff(np.append(first, len(window)))
    power, back = _powers(2 * PIECE + length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(x) * power[: len(x)])])
    whole = _mixed((sums[start + windows + length - gram] - sums[start]) * back[start])
    return text[start], start - bounds[text[start]], windows, x[anchor[first]].view(np.int64), whole.view(np.int64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and the bounds of each."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held else np.zeros(0, np.uint8), bounds - bounds[0]


ANCHORED = "h long, r long, doc long, tie long, start int, n int"


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """Every run of every text, by document and place."""

    def find(batches):
        for batch in slices(batches, most=PIECE):
            data, bounds = _bytes_of(batch.column("text"))
            doc, tie = (batch.column(k).to_numpy() for k in ("doc", "tie"))
            step = max(1, len(data))
            if len(data) > 2 * PIECE:  # a long text, with none but empty ones in its slice, is cut between windows
                longest = np.argmax(np.diff(bounds), keepdims=True)
                doc, tie, step = doc[longest], tie[longest], PIECE
            for at in range(0, len(data), step):
                part = data[at : at + step + length - 1]
                text, start, n, h, r = runs_of(part, bounds if step >= len(data) else np.array([0, len(part)]), length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, r, doc[text], tie[text], (start + at).astype(np.int32), n.astype(np.int32))], names=["h", "r", "doc", "tie", "start", "n"])

    return rows.mapInArrow(find, ANCHORED)


def _unlike(column: pa.Array) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    return np.concatenate([[True], pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)])


def sifted(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (h, r, doc, tie, start), written, with what each is (``kind``) and its task's number (``part``).

    A row that equals the row before in h and r is a repeat. One that doesn't is left out, unless it shares h with a neighbour.
    What a task can't know of its first and last rows is left to ``_edges``.
    """
    order = ["h", "r", "doc", "tie", "start"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def sift(batches):
        part, last, open_ = TaskContext.get().partitionId(), None, None

        def told(rows, kind):
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.full(rows.num_rows, part, np.int32)), *rows.columns], names=["kind", "part", *rows.schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([last] if last is not None else []), batch]).combine_chunks()
            skip = int(last is not None)
            gram, run = (_unlike(table.column(k).chunk(0))[skip:] for k in ("h", "r"))
            at = np.flatnonzero(gram | run)
            kind = np.where(gram | run, -1, REPEAT).astype(np.int32)
            if len(at):
                apart = gram[at]
                if open_ is not None and not apart[0]:
                    yield from told(open_, [OPEN])
                open_ = None
                beside = ~apart
                beside[:-1] |= ~apart[1:]
                kind[at[beside]] = OPEN
                if not beside[-1] and not (last is None and at[-1] == 0):
                    open_ = batch.slice(int(at[-1]), 1)
            if last is None:
                kind[0] = FIRST
            known = np.flatnonzero(kind >= 0)
            yield from told(batch.take(pa.array(known)), kind[known])
            last = batch.slice(batch.num_rows - 1, 1)
        if open_ is not None:
            yield from told(open_, [OPEN])
        if last is not None:
            yield from told(last, [LAST])

    schema = ", ".join(["kind int", "part int", *(f"{k} {t}" for k, t in rows.dtypes)])
    return materialize(dealt.mapInArrow(sift, schema), "repeats-sifted")


def _edges(rows: DataFrame) -> DataFrame:
    """The sifted rows, the first of each task held against the last of the task before (two rows a task); kinds REPEAT and OPEN."""
    turn = Window.orderBy("part", "kind")  # two rows for each task, however many rows there are
    again = F.lag("h").over(turn).eqNullSafe(F.col("h")) & F.lag("r").over(turn).eqNullSafe(F.col("r"))
    edges = rows.where(F.col("kind") >= FIRST).withColumn("_again", again).where(F.col("kind") == FIRST)
    edges = edges.withColumn("kind", F.when(F.col("_again"), F.lit(REPEAT)).otherwise(F.lit(OPEN))).drop("_again")
    return rows.where(F.col("kind") < FIRST).unionByName(edges)


def packed(rows: DataFrame) -> DataFrame:
    """Texts as compressed bytes (column ``blob``), for the way through a shuffle; the other columns as they are."""
    names = [k for k in rows.columns if k != "text"]

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            blobs = [squeeze(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(blobs, pa.binary())], names=[*names, "blob"])

    return rows.mapInArrow(pack, ", ".join([*(f"{k} {t}" for k, t in rows.dtypes if k != "text"), "blob binary"]))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The bounds of each list, and all elements."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


BODIES = "h long, doc long, tie long, start int, n int, many boolean, body binary"


def bodies(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs (h, doc, tie, start, n, many) with their bytes (``body``), written."""
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "start", "n", "many")).alias("runs"))
    joined = packed(texts).select("doc", "tie", "blob").join(lists, ["doc", "tie"])

    def cut(batches):
        open_blob = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bounds, runs = _lists(batch.column("runs"))
            start, n = (runs.field(k).to_numpy() for k in ("start", "n"))
            doc, tie = (batch.column(k).to_numpy() for k in ("doc", "tie"))
            for i, blob in enumerate(batch.column("blob")):
                text = open_blob(blob.as_py())
                for a in range(bounds[i], bounds[i + 1], 16384):
                    b = min(a + 16384, bounds[i + 1])
                    body = [text[p : p + m + length - 1] for p, m in zip(start[a:b].tolist(), n[a:b].tolist())]
                    h, first, windows, many = (runs.field(k).slice(a, b - a) for k in ("h", "start", "n", "many"))
                    yield pa.RecordBatch.from_arrays([h, pa.array(np.full(b - a, doc[i])), pa.array(np.full(b - a, tie[i])), first, windows, many, pa.array(body, pa.binary())], names=["h", "doc", "tie", "start", "n", "many", "body"])

    return materialize(joined.mapInArrow(cut, BODIES), "repeats-bodies")


PIECES = "h long, r long, doc long, tie long, start int, n int, body binary, low int, high int"


def pieces(rows: DataFrame, length: int) -> DataFrame:
    """Runs cut by their windows' distances from the gram, which lie from ``low`` to ``high``, into ``WAYS`` equal ranges.

    All windows of a range hold the bytes from its least distance before the gram to ``length`` less its largest after it. The
    hash of these stands for the gram from now on.
    """
    gram = gram_bytes(length)

    def cut(batches):
        for batch in batches:
            data, bounds = _bytes_of(batch.column("body"))
            if not batch.num_rows:
                continue
            hashes = gram_hashes(np.concatenate([data, np.zeros(gram, np.uint8)]), gram) & ~_LOW
            before = hashes[bounds[:-1, None] + np.arange(length - gram + 1)].argmin(axis=1)  # the first window's distance
            out = []
            for doc, tie, start, n, low, high, body, far in zip(*(batch.column(k).to_pylist() for k in ("doc", "tie", "start", "n", "low", "high", "body")), before.tolist()):
                step = -(-(high - low + 1) // WAYS)
                for least in range(low, high + 1, step):
                    most = min(high, least + step - 1)
                    a, b = max(0, far - most), min(n - 1, far - least)
                    if a <= b:
                        piece = body[a : b + length]
                        shared = piece[far - a - least : far - a + length - most]
                        out.append((xxhash.xxh3_64_intdigest(shared, least), xxhash.xxh3_64_intdigest(piece, 11), doc, tie, start + a, b - a + 1, piece, least, most))
            columns = list(zip(*out))
            hashed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in columns[:2]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*hashed, *(pa.array(x, k) for x, k in zip(columns[2:], kinds))], names=["h", "r", "doc", "tie", "start", "n", "body", "low", "high"])

    return rows.select("doc", "tie", "start", "n", "body", "low", "high").mapInArrow(cut, PIECES)


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """All places of ``data`` (values under 512, fewer than 2 ** 21) in the order of their next 2 * ``length`` values, and the ranks by the first 4, 8, ... values."""
    n = len(data)
    place, wide = np.arange(n, dtype=np.uint64), np.concatenate([data, np.zeros(4, data.dtype)]).astype(np.uint64)
    head = (wide[:n] << np.uint64(27)) | (wide[1 : n + 1] << np.uint64(18)) | (wide[2 : n + 2] << np.uint64(9)) | wide[3 : n + 3]
    levels, depth, key = [], 4, head << np.uint64(21)
    while True:
        key = np.sort(key | place)
        order, value = (key & _LOW).astype(np.int64), key >> np.uint64(21)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])).astype(np.uint64)
        levels.append((depth, rank))
        if depth == 2 * length:
            return order, levels
        ahead = min(depth, length - depth if depth < length else length)
        after = np.concatenate([rank[ahead:], np.zeros(ahead, np.uint64)])[:n]
        key, depth = (rank << np.uint64(42)) | (after << np.uint64(21)), depth + ahead


def common(i: np.ndarray, j: np.ndarray, data: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The length of the common prefix of the suffixes at ``i`` and ``j``, up to the depth of the levels."""
    n, off = len(data), np.zeros(len(i), np.int64)
    for depth, rank in reversed(levels):
        a, b = i + off, j + off
        inside = (a < n) & (b < n)
        off += np.where(inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]), depth, 0)
    for _ in range(3):
        a, b = i + off, j + off
        inside = (a < n) & (b < n)
        off += inside & (data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)])
    return off


def nearest_smaller(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the nearest one before, and after, that is smaller and of its group (a sorted column), or -1."""

    def before(value, group):
        left = np.arange(-1, len(value) - 1)
        active = np.arange(len(value))
        while len(active):
            at = left[active]
            gone = (at < 0) | (group[np.maximum(at, 0)] != group[active])
            left[active[gone]] = -1
            active, at = active[~gone], at[~gone]
            larger = value[at] > value[active]
            active = active[larger]
            left[active] = left[at[larger]]  # all between are larger than the one at ``at``
        return left

    right = before(value[::-1], group[::-1])[::-1]
    return before(value, group), np.where(right >= 0, len(value) - 1 - right, -1)


def longest_previous(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor of each text's first ``windows`` places: place in the texts put together, and length.

    Texts come in the order of their positions, as far as they have windows in common; places with a factor shorter than
    ``length`` aren't returned.
    """
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes) - 1
    data[ends] = 0  # no text goes on in the next one
    order, levels = suffix_order(data, length)
    begin = ends + 1 - sizes
    counted = np.zeros(len(data) + 1, np.int64)
    counted[begin] += 1
    counted[begin + windows] -= 1
    order = order[np.cumsum(counted)[order] > 0]
    if not len(order):
        return (np.zeros(0, np.int64),) * 2
    tied = next(rank for depth, rank in levels if depth == length)[order]
    back, on = nearest_smaller(order, tied)
    best = np.zeros(len(order), np.int64)
    rest = np.repeat(ends, sizes)[order] - order
    for other in (back, on):
        has = np.flatnonzero(other >= 0)
        found = common(order[has], order[other[has]], data, levels)
        best[has] = np.maximum(best[has], np.minimum(found, np.minimum(rest[has], rest[other[has]])))
    place = np.flatnonzero(best >= length)
    place = place[np.argsort(order[place])]
    return order[place], best[place]


def _factors(rows: DataFrame, length: int, most: int = 1 << 20) -> DataFrame:
    """Repeated spans (doc, tie, start, size) of the runs, whose rows of one gram meet in one task, in order of position."""
    ordered = rows.select("h", "doc", "tie", "start", "n", "body").repartition("h").sortWithinPartitions("h", "doc", "tie", "start")

    def spans(held):
        doc, tie, start, n = (held.column(k).to_numpy() for k in ("doc", "tie", "start", "n"))
        texts = held.column("body").to_pylist()
        place, size = longest_previous(texts, n, length)
        if not len(place):
            return
        begin = np.cumsum([0, *(len(x) + 1 for x in texts)])  # as they are put together
        row = np.searchsorted(begin, place, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(row) != 0)]))
        stop = np.maximum.reduceat(place + size, first)
        row, place = row[first], place[first]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], tie[row], (start[row] + place - begin[row]).astype(np.int32), (stop - place).astype(np.int32))], names=["doc", "tie", "start", "size"])

    def compare(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > most:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h == h[-1], True))  # the last gram's rows may go on
                yield from _groups(table.slice(0, whole), spans, most)
                held, size = table.slice(whole).combine_chunks().to_batches(), 0
        if held:
            yield from _groups(pa.Table.from_batches(held), spans, most)

    return ordered.mapInArrow(compare, "doc long, tie long, start int, size int")


def _groups(table: pa.Table, of, most: int):
    """``of`` each stretch of whole grams, whose bytes stay near ``most``."""
    if not table.num_rows:
        return
    h = table.column("h").to_numpy()
    cuts = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
    size = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("body")).to_numpy() + 1)])
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(size[cuts], size[cuts[a]] + most, "right")) - 1)
        yield from of(table.slice(cuts[a], cuts[b] - cuts[a]))
        a = b


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, doc, tie and text of each document; and, if rows share a doc_id, doc_id, doc and tie of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("doc"), text_column().alias("text"))
    again = materialize(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc"), "repeats-again")
    if again.isEmpty():
        return rows.withColumn("tie", F.lit(0).cast("long")), None
    tie = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long") + F.when(F.col("doc_id").isNull(), 1 << 60).otherwise(0)
    shared = rows.join(again, "doc", "left_semi").withColumn("tie", tie)
    alone = rows.join(again, "doc", "left_anti").withColumn("tie", F.lit(0).cast("long"))
    every = materialize(alone.unionByName(shared), "repeats-documents")
    return every.dropDuplicates(["doc", "tie"]), every.select("doc_id", "doc", "tie")


def _settled(marked: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of the runs that repeat others as a whole; and the runs to compare, with whether their gram has ``many``."""
    spans = marked.where(F.col("kind") == REPEAT).select("doc", "tie", "start", (F.col("n") + length - 1).alias("size"))
    unsure = marked.where(F.col("kind") == OPEN).drop("kind", "part", "r")
    sizes = materialize(unsure.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", (F.col("m") > LIMIT).alias("many")), "repeats-grams")
    return spans, unsure.join(sizes, "h")


def repeated(rows: DataFrame, length: int) -> DataFrame:
    """Spans of bytes (doc, tie, start, size) that repeat earlier ones; they may overlap."""
    spans, unsure = _settled(_edges(sifted(anchored(rows, length))), length)
    found = bodies(rows, unsure, length)
    spans = spans.unionByName(_factors(found.where("not many"), length))
    left = found.where("many").withColumns({"low": F.lit(0), "high": F.lit(length - gram_bytes(length))})
    while not left.isEmpty():  # the ranges of distances come to one value in a few rounds
        copies, unsure = _settled(_edges(sifted(pieces(left, length))), length)
        found = materialize(unsure, "repeats-pieces")
        spans = spans.unionByName(copies).unionByName(_factors(found.where("not many"), length))
        left = found.where("many")
    return spans


FOUND = "doc_id long, doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>, kept binary"


def find(docs: DataFrame, length: int = 100, kept: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (in bytes, maximal, in order).

    With ``kept`` also what is left, as bytes: a span may end inside a character.
    """
    if length < 8:
        raise ValueError("a repeated string has at least 8 bytes")
    rows, every = _documents(docs)
    lists = repeated(rows, length).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    joined = packed(rows.select("doc_id", "doc", "tie", "text")).join(lists, ["doc", "tie"], "left")

    def digest(batches):
        open_blob = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bounds, runs = _lists(batch.column("runs"))
            start, size = (runs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "size"))
            out, spans = [], []
            for i, blob in enumerate(batch.column("blob")):
                text, a, b = open_blob(blob.as_py()), bounds[i], bounds[i + 1]
                begin, stop = merged(start[a:b], start[a:b] + size[a:b])
                left = [text[p:q] for p, q in zip([0, *stop.tolist()], [*begin.tolist(), len(text)])]
                sha = hashlib.sha256()
                for x in left:
                    sha.update(x)
                spans.append((begin, stop))
                out.append((len(text), int((stop - begin).sum()), len(begin), sha.hexdigest(), b"".join(left) if kept else None))
            n, gone, many, sha, rest = zip(*out) if out else ((),) * 5
            ends = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in spans)]).astype(np.int32)) for k in (0, 1)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *many]).astype(np.int32)), pa.StructArray.from_arrays(ends, names=["start", "stop"]))
            columns = [pa.array(x, pa.int64()) for x in (n, gone, many)] + [pa.array(sha, pa.string()), lists, pa.array(rest, pa.binary())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "doc", "tie")), *columns], names=["doc_id", "doc", "tie", *names])

    found = joined.select("doc_id", "doc", "tie", "blob", "runs").mapInArrow(digest, FOUND)
    if every is not None:
        found = every.join(found.drop("doc_id"), ["doc", "tie"])
    return found.drop("doc", "tie") if kept else found.drop("doc", "tie", "kept")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as maximal ones."""
    if not len(start):
        return start, stop
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[first], reach[np.append(first[1:], len(reach)) - 1]

