"""Codes for vectors: product codebooks by Lloyd's rounds with bounds that spare most distances.

Components become whole numbers and a vector is cut into equal parts; each part has a codebook of its own. A round assigns
every part to its nearest entry and moves each entry to the mean of its parts. With each part go two bounds, written with
the vector from round to round: an upper one of the distance to its entry and a lower one of the distance to any other. A
round widens them by what the entries have moved. Where the upper one stays below the lower one the entry can't have changed; where
it doesn't, the upper bound is made exact; where that doesn't help either, all entries are compared in whole numbers, the
lower index first among equals. Bounds are doubles with ``SLACK`` between them, far more than they can be off by.

Each round is one pass: a task writes its vectors and, as a row of their own, its sums and counts. The sums of all tasks, as many numbers
as the codebooks have, make the next codebooks on the driver.

Defined results: vectors that are null, hold a null or a number that isn't finite, or can't be cut into parts as long as those of the
smallest vec_id are left out; rows that share a vec_id are vectors of their own; codebooks start from the smallest vec_ids, nulls
last and equal ones in the order of their components, and have fewer entries if there are fewer vectors; equal distances go to the lower
index; null labels are one label; components of 65536 and more are refused with an error, as squares wouldn't fit whole
numbers of 64 bits; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.shared import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: By how much an upper bound must stay below a lower one.
SLACK = 1e-3
#: Components from which squared distances could overflow.
REACH = 1 << 28


def _matrix(rows: np.ndarray) -> pa.ListArray:
    """A list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q (whole components) of the vectors that are kept, written."""
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("q"))

    def floor(batches):
        for batch in batches:
            column = batch.column("q")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(row[~np.isfinite(flat)], minlength=len(size)) > 0
            keep = ~bad & (size > 0) & (size % PARTS == 0)
            values = np.floor(flat[keep[row]] * SCALE)
            if len(values) and np.abs(values).max() >= REACH:
                raise ValueError(f"a component is {REACH // SCALE} or more")
            ends = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(mask) for k in ("vec_id", "label")), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))], names=["vec_id", "label", "q"])

    return materialize(named.mapInArrow(floor, f"vec_id long, label {dict(named.dtypes)['label']}, q array<int>"), "codes-vectors")


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each entry."""
    return np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, the distance to it and that to the second nearest."""
    every = squared(x, book)
    code = every.argmin(axis=1)
    best = every[np.arange(len(x)), code]
    every[np.arange(len(x)), code] = np.iinfo(np.int64).max
    second = np.sqrt(every.min(axis=1).astype(float)) if len(book) > 1 else np.full(len(x), np.inf)
    return code, np.sqrt(best.astype(float)), second


def narrowed(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, moved: np.ndarray) -> int:
    """Bring codes and bounds of one part, in place, to codebooks that moved by ``moved``; how many were compared with all entries."""
    upper += moved[code]
    farthest = int(moved.argmax())
    others = np.delete(moved, farthest)
    lower -= np.where(code == farthest, others.max() if len(others) else 0.0, moved[farthest])
    open_ = np.flatnonzero(~(upper + SLACK < lower))
    upper[open_] = np.sqrt(((x[open_] - book[code[open_]]) ** 2).sum(axis=1).astype(float))
    open_ = open_[~(upper[open_] + SLACK < lower[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], book)
    return len(open_)


def assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One round: vectors with codes and bounds, and a row of sums for each task, written. Without ``moved`` it is the first."""
    parts, entries, width = books.shape
    kind = dict(state.dtypes)["label"]

    def work(batches):
        total, compared = np.zeros((parts, entries, width + 1), np.int64), 0
        empty = None
        for batch in batches:
            n = batch.num_rows
            empty = batch.slice(0, 0)
            if not n:
                continue
            q = batch.column("q").flatten().to_numpy().astype(np.int64).reshape(n, parts, width)
            if moved is None:
                code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
            else:
                code, upper, lower = (batch.column(k).flatten().to_numpy().reshape(n, parts).copy() for k in ("code", "upper", "lower"))
                code = code.astype(np.int64)
            for p in range(parts):
                x = q[:, p]
                if moved is None:
                    code[:, p], upper[:, p], lower[:, p] = scan(x, books[p])
                    compared += n
                else:
                    c, u, l = (np.ascontiguousarray(a[:, p]) for a in (code, upper, lower))
                    compared += narrowed(x, c, u, l, books[p], moved[p])
                    code[:, p], upper[:, p], lower[:, p] = c, u, l
                total[p, :, width] += np.bincount(code[:, p], minlength=entries)
                for j in range(width):  # a batch's sums are far below 2 ** 53
                    total[p, :, j] += np.bincount(code[:, p], x[:, j], entries).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("vec_id", "label", "q")), _matrix(code.astype(np.int32)), _matrix(upper), _matrix(lower), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        if empty is not None:
            lists = [pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.float64(), pa.float64())]
            sums = pa.array([[*total.reshape(-1).tolist(), compared]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, empty.column("label").type), *lists, sums], names=names)

    names = ["vec_id", "label", "q", "code", "upper", "lower", "sums"]
    return materialize(state.mapInArrow(work, f"vec_id long, label {kind}, q array<int>, code array<int>, upper array<double>, lower array<double>, sums array<long>"), "codes-round")


def means(written: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """The codebooks after a round, unused entries as they were; and how many parts were compared with all entries."""
    flat = written.where("sums is not null").select(F.posexplode("sums").alias("place", "value"))
    rows = flat.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # as many as the codebooks have numbers
    parts, entries, width = books.shape
    values = {r["place"]: int(r["value"]) for r in rows}
    out = books.copy()
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            count = values.get(at + width, 0)
            if count:
                out[p, e] = [values[at + j] // count for j in range(width)]
    return out, values.get(parts * entries * (width + 1), 0)


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]] | None:
    """The last round's vectors with their codes, the codebooks, and how many parts each round compared in full; None without vectors."""
    kept = quantised(vectors)
    size = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select(F.size("q")).first()
    if size is None:
        return None
    state = kept.where(F.size("q") == size[0])
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    moved, full = None, []
    for step in range(rounds + 1):
        state = assigned(state, books, moved)
        if step < rounds:
            after, compared = means(state, books)
            moved, books = np.sqrt(((after - books) ** 2).sum(axis=2).astype(float)), after
        else:
            compared = means(state, books)[1]
        full.append(compared)
        state = state.where("sums is null")
    return state, books, full


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error and codebooks_sha256 of each vector that is kept."""
    kind = dict(vectors.dtypes)["label"]
    schema = f"vec_id long, label {kind}, code string, error long"
    found = train(vectors, rounds)
    if found is None:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    state, books, _ = found
    parts, _, width = books.shape

    def finish(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                q = batch.column("q").flatten().to_numpy().astype(np.int64).reshape(n, parts, width)
                code = batch.column("code").flatten().to_numpy().reshape(n, parts)
                error = ((q - books[np.arange(parts), code]) ** 2).sum(axis=(1, 2))
                digits = code.astype(np.uint8).tobytes().hex()
                text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = materialize(state.select("vec_id", "label", "q", "code").mapInArrow(finish, schema), "codes-found")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "codes-labels")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out.withColumn("codebooks_sha256", F.lit(digest))
