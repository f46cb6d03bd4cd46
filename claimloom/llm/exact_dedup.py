"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

1. Every document's normalised text gets a 64-bit hash and a SHA-256; these fingerprints are written to the shared folder.
2. The directory is built from the exact number of distinct hashes per prefix: it starts with few slots, and while a bucket
   holds more than ``capacity`` hashes it splits on the next bit; when a bucket is deeper than the directory, the directory
   doubles. All of that is grouping and joining of tables of counts; nothing of it goes to the driver but the number of
   hashes and the depth. Copies share a hash, so a group of copies never overfills a bucket.
3. Texts are dealt to owner tasks, once, by contiguous ranges of hashes. An owner chains the hashes of its range, a link per text,
   and compares bytes: its grouping key holds the whole normalised text. A hash of more than a quarter of a task's share of all
   rows isn't dealt: its rows are combined where they are read, a row per text and task, before they move.
4. Each link finds its bucket through the directory and is written to the index, in ranges of buckets, ordered by bucket and hash.
5. Each fingerprint is looked up: its hash's first bits are its slot, the directory has the slot's bucket, and the bucket's
   chain has the link of its digest. Only the index knows which document stays. Where a hash and digest stand for one text, as
   they all but surely do, that decides; for the others, if there are any, the index has several links of one hash and digest,
   and whole texts are compared again.

The directory has at most ``16 * n / capacity`` slots for n hashes (and at least one). A bucket that is overfull even then,
as its hashes agree in more bits than that, isn't split any more: it keeps all of its links as an overflow chain.

Defined results: null counts as empty; texts are equal when identical after each run of white space became one space; of
equal texts the smallest doc_id stays, nulls last; repeated rows are copies of each other and all carry the same keep_id; an
empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.shared import fresh, materialize, text_column

#: Hashes of a bucket.
CAPACITY = 512
#: Levels that the directory may grow by beyond where it starts.
LEVELS = 4


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def slot_hash(text: Column) -> Column:
    return F.xxhash64(text)


def prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory over distinct hashes (column h) and its depth: a row per slot, with slot, bucket and the bucket's depth.

    A bucket is named by its first slot. A slot without hashes has a row only if its bucket has some.
    """
    n = hashes.count()
    start = max(0, (n // capacity).bit_length() - 2)  # buckets hold at least twice the capacity, on average
    deepest = start + LEVELS
    counts = materialize(hashes.groupBy(prefix(F.col("h"), deepest).alias("bits")).agg(F.count(F.lit(1)).alias("n")), "exact-counts")
    buckets, parents = None, None  # of a level, and the overfull ones of the level above
    for depth in range(start, deepest + 1):
        nodes = counts.groupBy(F.shiftrightunsigned("bits", deepest - depth).alias("bits")).agg(F.sum("n").alias("n"))
        if parents is not None:
            nodes = nodes.join(parents, F.shiftrightunsigned(nodes["bits"], 1) == parents["parent"], "left_semi")
        full = (F.col("n") > capacity) & F.lit(depth < deepest)
        settled = nodes.where(~full).select(F.lit(depth).alias("depth"), "bits", "n")
        buckets = settled if buckets is None else buckets.union(settled)
        parents = nodes.where(full).select(F.col("bits").alias("parent"))
    buckets = materialize(buckets, "exact-buckets")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    spread = F.lit(depth) - F.col("depth")
    first = F.call_function("shiftleft", F.col("bits"), spread)
    last = first + F.call_function("shiftleft", F.lit(1).cast("long"), spread) - 1
    slots = buckets.select(first.alias("bucket"), "depth", F.explode(F.sequence(first, last)).alias("slot"))
    return materialize(slots.select("slot", "bucket", "depth"), "exact-directory"), depth


def fingerprints(docs: DataFrame, hash_of=slot_hash) -> DataFrame:
    """doc_id, normalised text, hash and digest of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_column()).alias("norm"))
    return texts.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("digest"))


def placed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows with a hash and the bucket that the directory has for it."""
    return rows.withColumn("slot", prefix(F.col("h"), depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")


def hot_hashes(prints: DataFrame, tasks: int) -> DataFrame:
    """Hashes of more than a quarter of a task's share of all rows: fewer than ``4 * tasks``, so they may be broadcast."""
    most = max(1, prints.count() // (4 * tasks))
    return materialize(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h"), "exact-hot")


def chained(hashed: DataFrame, hot: DataFrame, ranges: int) -> DataFrame:
    """A link per text: h, digest, norm, keep_id, group_size, made by the owners of ``2 ** ranges`` ranges of hashes.

    Rows are partitioned by owner, which serves the grouping, too, so that texts move once.
    """
    link = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    dealt = hashed.join(F.broadcast(hot), "h", "left_anti").withColumn("owner", prefix(F.col("h"), ranges)).repartition("owner")
    owned = dealt.groupBy("owner", "h", "digest", "norm").agg(*link).drop("owner")
    return owned.unionByName(hashed.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "digest", "norm").agg(*link))


def index(chains: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The written index: a row per link, in ranges of buckets, one owner task a range, ordered by bucket and hash."""
    owners = max(1, int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owned = placed(chains, slots, depth).repartitionByRange(owners, "bucket").sortWithinPartitions("bucket", "h", "digest")
    return materialize(owned, "exact-index")


def group(docs: DataFrame, capacity: int = CAPACITY, hash_of=slot_hash) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = fingerprints(docs, hash_of)
    prints = materialize(hashed.select("doc_id", "h", "digest"), "exact-prints")
    slots, depth = directory(materialize(prints.select("h").distinct(), "exact-hashes"), capacity)

    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chains = chained(hashed, hot_hashes(prints, tasks), (16 * tasks).bit_length())  # several ranges a task
    # written before it is dealt by range, which reads it twice
    links = index(materialize(chains.drop("norm"), "exact-chains"), slots, depth)

    # no side is an aggregate, so that Spark can split the partition of a large group
    wanted = placed(prints, slots, depth)
    link = ["bucket", "h", "digest"]
    clash = links.groupBy(*link).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(*link)
    if clash.isEmpty():
        found = wanted.join(links, link)
    else:  # one hash and digest, several texts: compare the texts themselves
        clash = materialize(clash, "exact-clashes")
        found = wanted.join(links.join(clash, link, "left_anti"), link)
        unlike = hashed.join(clash, ["h", "digest"], "left_semi")
        found = found.drop("bucket").unionByName(unlike.join(chains, ["h", "digest", "norm"]).drop("norm"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the later copies, their columns as they were; of repeated rows one stays."""
    names = docs.columns
    key, own, sha = (fresh(names, n) for n in ("_digest", "_id", "_sha"))
    found = materialize(group(docs, **options), "exact-groups")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    keyed = docs.withColumn(key, F.sha2(normalised(text_column()), 256))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(sha)), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not again.isEmpty():
        left = left.dropDuplicates(["doc_id", key])
    return left.select(*names)
