"""MinHash near-deduplication with odd sketches.

1. Each text becomes its set of distinct word shingles. Words are hashed to 128 bits (a keyed xxh3), and shingles to two
   64-bit values made of the words' halves. From the first come ``BANDS x ROWS`` MinHash samples as band keys, and an odd
   sketch: each of the ``BOTTOM`` smallest hashes, a MinHash sample of the whole set if that is no larger, flips one bit of a
   bitmap, so that the XOR of two bitmaps has about a bit for each sample in which they differ.
2. Equal sets are one node, the one of their smallest doc_id. Copies are never paired.
3. In each band bucket every node is paired with the bucket's smallest node. A node's first check is with the hub it shares
   most buckets with. Links give components by repeated smallest-neighbour hooking.
4. Buckets that still hold several components are dealt to tiles of bounded size, in which sketches are compared as bitmaps,
   without making pairs into rows. Blocks follow components: a large component has blocks of its own, which never meet each
   other. What comes out is first each node's most similar one of another component; these are checked and components taken
   again. Then it is every pair across components that sizes and sketches don't rule out, each in the first bucket that it
   shares only. These are checked, too. A pair inside a component needs no check.

Checks read whole texts again, those of nodes that share a bucket, written once. The texts of a hub's partners are dealt to
groups of at most about ``FAN``; each group streams by one text of the hub, and both halves of the shingles' hashes are
compared. Two sets of similarity 0.8 share no bucket with a probability of (1 - 0.8 ** ROWS) ** BANDS, 3e-6 with the defaults
and ideal samples; the sketch's bound, at 6.5 standard deviations, adds less than 1e-9.

Defined results: a null text, or one without words, has no shingles, and is linked with nothing; one with fewer words than a
shingle has its whole word sequence as the only one; the doc_id names a document, so rows that share one are one document
(a row each in the result); a null doc_id is linked with nothing and its component is null; an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.shared import fresh, materialize, slices, text_column

BANDS, ROWS = 42, 6
SKETCH_BITS, BOTTOM = 2048, 1024
#: Nodes of a block, about; two blocks of a bucket meet in a tile.
BLOCK = 512
#: Partners of a hub that are checked in one group, about.
FAN = 64

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of a known 64-bit mixer
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER_STEP = np.uint64(0xD6E8FEB86659FD93)
_word_hash = partial(xxhash.xxh3_128_digest, seed=20)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    out = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        out = _mixed(out * step + words[k : k + len(out)])
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, A-Z lower-cased: their hashes, sorted, and a second hash of each.

    All words of all texts are found in one pass over their bytes, and each distinct word is hashed once.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # offsets from 0
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    data = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~white
    cut = np.zeros(len(data) + 1, bool)  # a text's first byte begins a word whatever precedes it
    cut[bounds] = True
    begins = word & (cut[:-1] | np.concatenate([[True], white[:-1]]))[: len(word)]
    finish = word & np.concatenate([white[1:], [True]])[: len(word)] | word & cut[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    places = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data[word])]).dictionary_encode()
    table = np.frombuffer(b"".join(map(_word_hash, coded.dictionary.to_pylist())), "<u8").reshape(-1, 2)
    words, others = table[coded.indices.to_numpy(zero_copy_only=False)].T
    grams, seconds = _rolled(words, width, _STEP), _rolled(others, width, _OTHER_STEP)
    first = np.searchsorted(start, bounds)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= width:
            found, at = np.unique(grams[a : b - width + 1], return_index=True)
            out.append((found, seconds[a:][at]))
        elif n:
            whole = np.array([[n], [n]], np.uint64)
            for k in range(a, b):
                whole = np.array([_mixed(whole[0] * _STEP + words[k : k + 1]), _mixed(whole[1] * _OTHER_STEP + others[k : k + 1])])
            out.append((whole[0], whole[1]))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets, whose elements are equal if both hashes are."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]) or 100 * len(x[0]) < percent * len(y[0]):
        return False
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    same = int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())
    return 100 * same >= percent * (len(x[0]) + len(y[0]) - same)


_rng = np.random.default_rng(20)  # the hash family is a fixed part of the method
_FACTORS = (_rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def samples(found: np.ndarray, block: int = 512) -> np.ndarray:
    """The smallest value of a set under each hash function."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), block):
        part = low[None, i : i + block] * _FACTORS
        part += _SHIFTS
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(sample: np.ndarray) -> np.ndarray:
    """A 64-bit key per row of samples and band; the band is part of the key."""
    rows = sample.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = _mixed(keys * _STEP + rows[:, :, k])
    return keys.view(np.int64)


def odd_sketch(found: np.ndarray) -> bytes:
    """The parity bitmap of a set's smallest hashes."""
    flips = np.bincount((found[:BOTTOM] % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def xor_bits(differing: np.ndarray, sure: float = 6.5) -> np.ndarray:
    """XOR bits that sketches with so many differing samples stay under: mean and ``sure`` deviations, or one for each."""
    n, d = SKETCH_BITS, differing.astype(float)
    mean = n / 2 * (1 - (1 - 2 / n) ** d)
    spread = n / 4 * (1 - (1 - 4 / n) ** d) + n * n / 4 * ((1 - 4 / n) ** d - (1 - 2 / n) ** (2 * d))
    return np.minimum(d, mean + sure * np.sqrt(np.maximum(spread, 0)))


_XOR_BITS = xor_bits(np.arange(2 * BOTTOM + 1))


def most_xor_bits(a: np.ndarray, b: np.ndarray, percent: int, sure: float = 6.5) -> np.ndarray:
    """XOR bits that sets of these sizes stay under if they are similar.

    Whole sets differ in at most (a + b) (100 - p) / (100 + p) elements. Of larger sets the samples hold what lies in both of
    the union's smallest ``BOTTOM``, a share of at least p percent.
    """
    whole = (a + b) * (100 - percent) // (100 + percent)
    share = percent / 100
    common = BOTTOM * share - sure * (BOTTOM * share * (1 - share)) ** 0.5
    sampled = np.minimum(a, BOTTOM) + np.minimum(b, BOTTOM) - 2 * int(common)
    return _XOR_BITS[np.clip(np.where((a <= BOTTOM) & (b <= BOTTOM), whole, sampled), 0, 2 * BOTTOM)]


SIGNATURE = "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, digest of the set, odd sketch and band keys of each row; the last two are null of an empty set."""

    def sign(batches):
        for batch in slices(batches, most=1 << 20):
            pairs = shingle_sets(batch.column("text"), width)
            sets = [x for x, _ in pairs]
            full = np.array([len(s) > 0 for s in sets], bool)
            sample = np.array([samples(s) for s in sets if len(s)], np.uint32).reshape(-1, BANDS * ROWS)
            keys = iter(band_keys(sample))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest() if len(x) else None for x, y in pairs], pa.binary()),
                    pa.array([odd_sketch(s) if ok else None for s, ok in zip(sets, full)], pa.binary()),
                    pa.array([next(keys) if ok else None for ok in full], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "sketch", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(sign, SIGNATURE)


def texts_of(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """node and text, written, for the wanted nodes (column node, distinct); with ``repeats``, several rows may share both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), text_column().alias("text")).join(wanted, "node", "left_semi")
    return materialize(rows.distinct() if repeats else rows, "near-texts")


def verify(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose whole sets have 100 * intersection >= percent * union.

    ``pairs`` must be a written table, as it is read several times. Partners are dealt to groups (a, part), each with a text
    of ``a`` before them.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FAN).select("a", F.ceil(F.col("n") / FAN).alias("parts"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    hubs = dealt.select(F.col("a").alias("node"), "a", "part").distinct().select("node", "a", "part", F.lit(None).cast("long").alias("b"))
    rows = dealt.select(F.col("b").alias("node"), "a", "part", "b").union(hubs).join(texts, "node").select("a", "part", "b", "text")
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def compare(batches):
        hub, held = None, []
        for batch in slices(batches, most=1 << 20):
            low, high = [], []
            for a, part, b, found in zip(*(batch.column(k).to_pylist() for k in ("a", "part", "b")), shingle_sets(batch.column("text"), width)):
                if (a, part) != hub:
                    hub, held = (a, part), []
                if b is None:
                    held.append(found)
                elif any(similar(x, found, percent) for x in held):
                    low.append(a)
                    high.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node), for nodes with a link (a, b).

    Each round turns the links into stars: every node's neighbours that are not smaller are hooked to its smallest one, then
    every node is hooked to the smallest of all that it met. Links only shrink towards their component's smallest node, and a
    hub's links are aggregated, never gathered. It ends when a round changes nothing.
    """
    stars = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-stars")
    before = None
    for _ in range(rounds):
        around = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = materialize(small, "near-stars")
        mark = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    signed = materialize(signatures(docs, width), "near-signatures")
    named = signed.where("doc_id is not null and digest is not null")
    classes = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "near-classes")
    # rows that share a doc_id but not a set are one document: their classes are linked
    again = materialize(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "near-again")
    repeats = not again.isEmpty()
    member = named.select("doc_id", "digest").join(again, "doc_id", "left_semi").join(classes, "digest")
    spread = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    split = member.join(spread, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    nodes = named.join(classes, (named["doc_id"] == classes["node"]) & (named["digest"] == classes["digest"]), "left_semi")
    nodes = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch", "bands")
    nodes = materialize(nodes.distinct() if repeats else nodes, "near-nodes")

    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "hub")
    shared = materialize(banded.join(hubs, "band"), "near-buckets")  # rows of buckets with company
    texts = texts_of(docs, materialize(shared.select("node").distinct(), "near-wanted"), repeats)
    stars = shared.where("node <> hub").groupBy(F.col("node").alias("b"), F.col("hub").alias("a")).agg(F.count(F.lit(1)).alias("bands"))
    best = stars.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("back"))).alias("top")).select((-F.col("top")["back"]).alias("a"), "b")
    best = materialize(best, "near-hubs")
    links = materialize(verify(texts, best, width, percent), "near-links")
    label = materialize(components(links), "near-labels")

    nearest = materialize(_across(shared, nodes, label, percent, every=False).distinct().join(best, ["a", "b"], "left_anti"), "near-nearest")
    links = materialize(links.union(verify(texts, nearest, width, percent)), "near-links")
    label = materialize(components(links), "near-labels")

    left = _across(shared, nodes, label, percent, every=True).join(best.union(nearest), ["a", "b"], "left_anti")
    every = links.union(verify(texts, materialize(left, "near-left"), width, percent)).union(split)
    label = materialize(components(every), "near-labels")

    known = classes.join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.drop("sketch", "bands").join(known, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def blocks(tagged: DataFrame) -> DataFrame:
    """How the components (c) of each mixed bucket (band) are laid out in blocks: a written row per bucket and component.

    A component of more than ``BLOCK`` nodes has ``own`` blocks from ``first`` on. The others share blocks from ``large`` on,
    by hash. There are ``every`` blocks in the bucket.
    """
    sizes = materialize(tagged.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m")), "near-sizes")
    mixed = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))).alias("few"), F.sum(F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / BLOCK)).otherwise(0)).alias("large"))
    mixed = mixed.where("parts > 1").select("band", "large", (F.col("large") + F.ceil(F.coalesce("few", F.lit(0)) / BLOCK)).alias("every"))
    before = Window.partitionBy("band").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.where(F.col("m") > BLOCK).select("band", "c", F.ceil(F.col("m") / BLOCK).alias("own"))
    own = own.withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0)))
    return materialize(sizes.select("band", "c").join(mixed, "band").join(own, ["band", "c"], "left"), "near-blocks")


def _across(shared: DataFrame, nodes: DataFrame, label: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a < b) of one bucket in different components that size and sketch allow: every one, or each node's best."""
    tagged = shared.join(label, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("c"))
    rows = tagged.join(blocks(tagged), ["band", "c"])
    block = F.when(F.col("own").isNotNull(), F.col("first") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.col("large") + F.pmod(F.xxhash64("c"), F.col("every") - F.col("large")))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("every") - 1), lambda x: F.col("own").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("own")))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(met))
    rows = rows.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "c")
    tiles = rows.join(nodes.select("node", "n", "sketch", "bands"), ["node", "n"]).repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def compare(batches):
        key, held = None, []
        for batch in batches:
            edges = np.stack([batch.column(k).to_numpy() for k in ("band", "low", "high")])
            cuts = [0, *(np.flatnonzero((edges[:, 1:] != edges[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if tuple(edges[:, a]) != key:
                        if held:
                            yield _tile(pa.Table.from_batches(held), percent, every)
                        key, held = tuple(edges[:, a]), []
                    held.append(batch.slice(a, b - a))
        if held:
            yield _tile(pa.Table.from_batches(held), percent, every)

    return tiles.mapInArrow(compare, "a long, b long")


def _tile(rows: pa.Table, percent: int, every: bool) -> pa.RecordBatch:
    """The pairs of one tile: of its two blocks, or within its only one."""
    block, node, n, c = (rows.column(k).to_numpy() for k in ("block", "node", "n", "c"))
    band = rows.column("band")[0].as_py()
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    crossing = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
    low, high = [], []
    for i in range(len(node)):
        fit = (c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if crossing:
            fit &= block != block[i]
        if every:
            fit[: i + 1] = False
        at = np.flatnonzero(fit)
        if not len(at):
            continue
        bits = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        allowed = bits <= most_xor_bits(n[at], n[i], percent)
        at, bits = at[allowed], bits[allowed]
        if len(at) and every:  # in the first bucket that both are in, and no other
            at = at[bands[i][(bands[at] == bands[i]).argmax(axis=1)] == band]
        elif len(at):
            at = at[[np.argmin(bits)]]
        low.append(np.minimum(node[at], node[i]))
        high.append(np.maximum(node[at], node[i]))
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (low, high)], names=["a", "b"])


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each component; their columns as they were."""
    own = fresh(docs.columns, "_gone")
    gone = group(docs, width, percent).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(materialize(gone, "near-gone"), docs["doc_id"] == F.col(own), "left_anti")
