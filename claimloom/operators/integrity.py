"""Merkle trees over ordered entries: roots, inclusion proofs, checkpoints; bundles that carry them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import canonical_json

#: Levels of a tree that are folded at once, inside one task.
DEPTH = 10
#: fixed values: the root of a tree without entries, and how trees are made
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()
ALGORITHM = "sha256-merkle-rfc6962-domainsep"


def leaf_hash(data: Column) -> Column:
    """SHA-256 of a zero byte and the data."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), data), 256))


def node_hash(left: Column, right: Column) -> Column:
    """SHA-256 of a one byte and both children."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


def largest(entries: DataFrame) -> int:
    """The number of entries of the largest tree, from the data."""
    return (entries.agg(F.max("idx").cast("long").alias("last")).first()["last"] or 0) + 1


def leaves(entries: DataFrame, key: str, *more: str) -> DataFrame:
    """Level 0 of each key's tree, of entries (key, idx from 0, data binary)."""
    return entries.select(key, F.col("idx").cast("long").alias("idx"), leaf_hash(F.col("data")).alias("hash"), *more)


def _above(nodes: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The level above; a last child without a sibling moves up as it is."""
    out: list[tuple[int, bytes]] = []
    for at, own in nodes:
        if out and out[-1][0] == at >> 1:
            out[-1] = at >> 1, hashlib.sha256(b"\1" + out[-1][1] + own).digest()
        else:
            out.append((at >> 1, own))
    return out


def _ways(nodes: list[tuple[int, bytes]], depth: int) -> tuple[bytes, list[list[tuple[str, bytes]]]]:
    """The node ``depth`` levels above a span's nodes, and for each of these the siblings on its way up."""
    level, ways = nodes, [[] for _ in nodes]
    for up in range(depth):
        known = dict(level)
        for (first, _), way in zip(nodes, ways):
            at = first >> up
            beside = known.get(at ^ 1)
            if beside is not None:
                way.append(("left" if at & 1 else "right", beside))
        level = _above(level)
    return level[0][1], ways


def folded(level: DataFrame, key: str, ways: bool = False) -> DataFrame:
    """Spans of 2 ** ``DEPTH`` nodes (key, idx, hash) as one node each, ``DEPTH`` levels above: key, idx, hash.

    With ``ways`` also ``nodes``: each of the span's places with the siblings on its way up, and its data if the level has them.
    """
    held = ["data"] if "data" in level.columns else []
    spans = level.groupBy(key, F.shiftright("idx", DEPTH).alias("span")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash", *held))).alias("nodes"))
    step = pa.struct([("side", pa.string()), ("hash", pa.binary())])
    kind = pa.list_(pa.struct([("idx", pa.int64()), ("steps", pa.list_(step)), *[(c, pa.binary()) for c in held]]))

    def fold(batches):
        for batch in batches:
            tops, every = [], []
            for nodes in batch.column("nodes"):
                pairs = [(n["idx"].as_py(), n["hash"].as_py()) for n in nodes]
                if ways:
                    top, found = _ways(pairs, DEPTH)
                    own = [{c: n[c].as_py() for c in held} for n in nodes]
                    every.append([{"idx": at, "steps": [{"side": s, "hash": h} for s, h in way], **o} for (at, _), way, o in zip(pairs, found, own)])
                else:
                    for _ in range(DEPTH):
                        pairs = _above(pairs)
                    top = pairs[0][1]
                tops.append(top)
            more = [pa.array(every, kind)] if ways else []
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("span"), pa.array(tops, pa.binary()), *more], names=[key, "idx", "hash", *(["nodes"] if ways else [])])

    schema = f"`{key}` {dict(level.dtypes)[key]}, idx long, hash binary" + (f", nodes array<struct<idx:long,steps:array<struct<side:string,hash:binary>>{''.join(f',{c}:binary' for c in held)}>>" if ways else "")
    return spans.mapInArrow(fold, schema)


def _checked(entries: DataFrame, key: str, most: int | None, *more: str) -> tuple[DataFrame, int]:
    """The leaves, and how often spans are folded up to the root of the largest tree.

    ``most`` is the number of entries of the largest tree where that is known, else it is taken from the data; a tree that
    has more fails the job.
    """
    most = largest(entries) if most is None else most
    within = F.when(F.col("idx") < most, F.col("hash")).otherwise(F.raise_error(F.lit(f"a tree has more than {most} entries")).cast("binary"))
    return leaves(entries, key, *more).withColumn("hash", within), max(1, -(-max(0, most - 1).bit_length() // DEPTH))


def roots(entries: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Key and root (hex) of each tree: two shuffles up to a million entries, three up to a thousand million, whatever the keys."""
    level, rounds = _checked(entries, key, most)
    for _ in range(rounds):
        level = folded(level, key)
    return level.select(key, F.lower(F.hex("hash")).alias("root"))


def proofs(entries: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Per entry the siblings on its way to the root, from the leaf up: (key, idx, steps of side and hash)."""
    return proven(entries, key, most).select(key, "idx", "steps")


def proven(entries: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Per entry its data, steps, and the size and root (hex) of its tree: (key, idx, data, steps, size, root).

    Trees of one span carry all that in it, so that their entries are grouped once and joined with nothing.
    """
    level, rounds = _checked(entries, key, most, "data")
    if rounds == 1:
        spans = folded(level, key, ways=True).select(key, F.size("nodes").cast("long").alias("size"), F.lower(F.hex("hash")).alias("root"), F.explode("nodes").alias("_n"))
        return spans.select(key, "_n.idx", "_n.data", "_n.steps", "size", "root")
    walk = sizes = None
    for done in range(rounds):
        spans = folded(level, key, ways=True)
        own = spans.select(key, F.explode("nodes").alias("_n")).select(key, F.col("_n.idx").alias("_at"), F.col("_n.steps").alias("_steps"))
        if walk is None:
            walk = spans.select(key, F.explode("nodes").alias("_n")).select(key, "_n.idx", "_n.data", "_n.steps")
            sizes = spans.groupBy(key).agg(F.sum(F.size("nodes")).alias("size"))
        else:
            joined = walk.withColumn("_at", F.shiftright("idx", DEPTH * done)).join(own, [key, "_at"])
            walk = joined.select(key, "idx", "data", F.concat("steps", "_steps").alias("steps"))
        level = spans.select(key, "idx", "hash")
    tops = level.select(key, F.lower(F.hex("hash")).alias("root"))
    return walk.join(sizes, key).join(tops, key).select(key, "idx", "data", "steps", "size", "root")


def sides(idx: Column, size: Column) -> Column:
    """On which side the siblings of the entry at ``idx`` are, from the leaf up, in a tree of ``size`` entries."""

    def side(level: Column) -> Column:
        at, last = F.call_function("shiftright", idx, level), F.call_function("shiftright", size - 1, level)
        return F.when((last > 0) & (at % 2 == 1), "left").when(at < last, "right")

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(62)), side))


def proof_holds(data: Column, idx: Column, size: Column, steps: Column, root: Column) -> Column:
    """Whether the steps lead from the data to the root (hex) of a tree of ``size`` entries, from the place ``idx``.

    Which sibling is on which side follows from place and size; steps that say otherwise, or are more or fewer, don't hold,
    so a proof can't be used for another place. Without one of the values nothing holds.
    """
    idx, size = idx.cast("long"), size.cast("long")
    end = F.aggregate(steps, leaf_hash(data), lambda h, s: F.when(s["side"] == "right", node_hash(h, s["hash"])).otherwise(node_hash(s["hash"], h)))
    placed = (idx >= 0) & (idx < size) & (F.transform(steps, lambda s: s["side"]) == sides(idx, size))
    return F.coalesce(placed & (F.lower(F.hex(end)) == root), F.lit(False))


def checkpoints(entries: DataFrame, key: str, most: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Key, number of entries and root; keys (``keys``) without entries have the empty tree's."""
    found = roots(entries, key, most).join(entries.groupBy(key).agg(F.count(F.lit(1)).alias("size")), key)
    if keys is None:
        return found
    return keys.select(key).distinct().join(found, key, "left").select(key, F.coalesce("root", F.lit(EMPTY_ROOT)).alias("root"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def checkpoint_body(root: Column, size: Column, run_id: Column, timestamp: Column, prose_sha256: Column | None = None, cbom_sha256: Column | None = None, version: str = "claimloom-checkpoint-v2") -> Column:
    """The canonical body that a signature covers; the digests of prose and bill bind them to the ledger, and are left out where null."""
    fields = {"algorithm": F.lit(ALGORITHM), "cbom_sha256": cbom_sha256, "entry_count": size, "prose_sha256": prose_sha256, "root_hash": F.concat(F.lit("sha256:"), root), "run_id": run_id, "timestamp": timestamp, "version": F.lit(version)}
    parts = [F.when(c.isNotNull(), F.substring(canonical_json(F.struct(c.alias(name))), 2, 1 << 30)) for name, c in fields.items() if c is not None]
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_compact(F.array(*parts)), lambda x: F.substring(x, F.lit(1), F.length(x) - 1)), ","), F.lit("}"))


def bundle_status(bundles: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Per bundle (key, prose, prose_sha256, root, signature) against recomputed roots; VALID only if all of it holds.

    A bundle may hold a bill of materials as text, too (cbom, cbom_sha256); both or neither.
    """
    joined = bundles.join(recomputed.select(F.col("key"), F.col("root").alias("_root")), "key", "left")
    sealed = lambda c: F.coalesce(F.col(f"{c}_sha256") == F.concat(F.lit("sha256:"), F.sha2(c, 256)), F.lit(False))
    prose_ok = sealed("prose")
    billed = "cbom" in bundles.columns
    cbom_ok = sealed("cbom") | (F.col("cbom").isNull() & F.col("cbom_sha256").isNull()) if billed else F.lit(True)
    root_ok = F.coalesce(F.col("root") == F.col("_root"), F.lit(False))
    status = F.when(F.col("prose_sha256").isNull() | F.col("root").isNull(), "MALFORMED").when(~prose_ok | ~root_ok | ~cbom_ok, "INVALID").when(F.col("signature").isNull(), "UNSIGNED").otherwise("UNVERIFIED")
    return joined.select("key", prose_ok.alias("prose_ok"), root_ok.alias("root_ok"), *([cbom_ok.alias("cbom_ok")] if billed else []), status.alias("status"))
