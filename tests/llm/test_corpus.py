"""Quality rules, deduplication, mixing, WARC, HTML text and the pipeline against plain versions."""

import base64
import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import exact_dedup, html_text, mixing, near_dedup, quality, warc
from tests.llm.cases import WORD, documents, frame, near_components

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# --- quality ---


def py_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rows = documents()
    found, m, bad = quality.judge(frame(spark, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = by_id(found.select("doc_id", *[F.col(m)[n].alias(n) for n in names]), *names)
    assert got == {r[0]: py_measures(r[1]) for r in rows}
    kept = {r["doc_id"] for r in quality.keep(frame(spark, rows)).collect()}
    assert kept == {r["doc_id"] for r in found.where(F.size(bad) == 0).collect()}
    assert quality.keep(frame(spark, rows)).columns == frame(spark, rows).columns
    assert quality.keep(frame(spark, [])).count() == 0


def test_quality_rules(spark):
    prose = "The cat and the dog went to the park, and it was a fine day for all of them to be out there again. " * 2
    bad = {"short": "too few", "symbols": "#### %%% " * 30, "loops": "of the same eight words go round and round " * 9, "shout": "THE!! END!! OF!! IT!! " * 12, "bullets": "\n".join(f"- the item {i} of it" for i in range(20))}
    rows = [(0, prose[:100] + " Others came by, with bread from the shop.", "en", "s", 0)] + [(i + 1, t, "en", "s", 0) for i, t in enumerate(bad.values())]
    assert {r["doc_id"] for r in quality.keep(frame(spark, rows)).collect()} == {0}


# --- exact dedup ---


def py_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub(" ", r[1] or "")].append(r[0])
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("options", [{}, {"capacity": 4}, {"capacity": 1}, {"capacity": 2, "hash_of": lambda t: F.shiftrightunsigned(F.xxhash64(t), 40)}, {"hash_of": lambda t: (F.length(t) % 3).cast("long")}])
def test_exact_groups(spark, options):
    rows = documents()
    assert by_id(exact_dedup.group(frame(spark, rows), **options), "keep_id", "group_size", "kept", "text_sha256") == py_groups(rows)


def test_exact_colliding_digests(spark, monkeypatch):
    """With a digest of two values, only the comparison of texts tells copies."""
    rows = documents()
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    got = by_id(exact_dedup.group(frame(spark, rows), hash_of=lambda t: F.lit(1).cast("long")), "keep_id", "group_size", "kept")
    assert got == {k: v[:3] for k, v in py_groups(rows).items()}


def test_exact_drop_copies(spark):
    rows = documents()
    again = rows + [rows[0], rows[0], (None, "null id", None, None, 0), (None, "null id", None, None, 0), (None, rows[1][1], None, None, 0)]
    left = exact_dedup.drop_copies(frame(spark, again))
    assert left.columns == frame(spark, again).columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    kept = {i for i, g in py_groups(rows).items() if g[2]}
    assert got == Counter([(r[0], r[1]) for r in rows if r[0] in kept] + [(None, "null id")])
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0 and exact_dedup.group(frame(spark, [])).count() == 0


def test_exact_answers_come_from_the_index(spark, monkeypatch):
    """Documents of a bucket that the index has lost are lost, and only those."""
    rows = documents()
    build, lost = exact_dedup.index, []

    def without_one(chains, slots, depth):
        links = build(chains, slots, depth)
        lost.append(links.agg(F.min("bucket")).first()[0])
        return links.where(F.col("bucket") != lost[0])

    monkeypatch.setattr(exact_dedup, "index", without_one)
    got = {r["doc_id"] for r in exact_dedup.group(frame(spark, rows), capacity=4).collect()}
    monkeypatch.undo()
    prints = exact_dedup.fingerprints(frame(spark, rows))
    slots, depth = exact_dedup.directory(prints.select("h").distinct(), 4)
    gone = {r["doc_id"] for r in exact_dedup.placed(prints, slots, depth).where(F.col("bucket") == lost[0]).collect()}
    assert gone and got == {r[0] for r in rows} - gone


def test_exact_owners_take_ranges_and_hot_hashes_are_combined_first(spark):
    rows = [(i, f"text {i}", None, None, 0) for i in range(400)] + [(1000 + i, "hot  text", None, None, 0) for i in range(300)]
    prints = exact_dedup.fingerprints(frame(spark, rows).repartition(6))
    hot = exact_dedup.hot_hashes(prints, 4)
    assert [r["h"] for r in hot.collect()] == [prints.where("norm = 'hot text'").first()["h"]]
    links = exact_dedup.chained(prints, hot, 5)
    assert links.count() == 401 and links.where("norm = 'hot text'").first()[3:] == (1000, 300)
    owned = exact_dedup.chained(prints, hot.where("false"), 5).withColumn("p", F.spark_partition_id()).withColumn("owner", exact_dedup.prefix(F.col("h"), 5))
    assert max(r["count"] for r in owned.select("owner", "p").distinct().groupBy("owner").count().collect()) == 1
    cold = prints.withColumn("owner", exact_dedup.prefix(F.col("h"), 5)).repartition("owner").groupBy("owner", "h", "digest", "norm").count()
    plan = cold._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(owner") == 1 and plan.count("Exchange hashpartitioning") == 1  # texts move once


def hashes_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "h long")


def test_directory_splits_and_doubles(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]
    crowd = [(5 << 56) + i for i in range(500)]  # agree in so many bits that no split parts them
    slots, depth = exact_dedup.directory(hashes_of(spark, values + crowd), 100)
    rows = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
    held = Counter()
    for v in values + crowd:
        bucket, own = rows[(v & (1 << 64) - 1) >> (64 - depth)]
        assert bucket >> (depth - own) == (v & (1 << 64) - 1) >> (64 - own)
        held[bucket] += 1
    assert depth > 3 and len({own for _, own in rows.values()}) > 1  # buckets of several depths
    overfull = {b: n for b, n in held.items() if n > 100}
    assert len(overfull) == 1 and min(overfull.values()) >= 500  # the overflow chain, whose links all stay
    assert len(rows) <= 16 * 3500 / 100
    slots, depth = exact_dedup.directory(hashes_of(spark, []), 100)
    assert depth == 0 and slots.count() == 0
    slots, depth = exact_dedup.directory(hashes_of(spark, [7]), 100)
    assert [tuple(r) for r in slots.collect()] == [(0, 0, 0)]


def test_index_of_the_query_splits(spark):
    """With the query's own parameters, its table fills several buckets, none of them beyond capacity, in ranges of owners."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = exact_dedup.fingerprints(docs)
    slots, depth = exact_dedup.directory(prints.select("h").distinct())
    assert depth > 0
    links = exact_dedup.index(prints.groupBy("h", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), slots, depth)
    per = links.groupBy("bucket").agg(F.countDistinct("h").alias("n")).collect()
    assert len(per) > 1 and max(r["n"] for r in per) <= exact_dedup.CAPACITY
    owners = links.select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count().where("count > 1")
    assert owners.count() == 0


# --- near dedup ---


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(spark, width):
    rows = documents()
    got = by_id(near_dedup.group(frame(spark, rows), width), "n_shingles", "component_id", "kept")
    assert got == {i: (n, c, i == c) for i, (n, c) in near_components(rows, width).items()}


def test_near_odd_tables(spark):
    rows = [(1, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (2, "A B c d e f", None, None, 0), (3, "q r s t u v w", None, None, 0), (2, "q r s t u v w", None, None, 0), (None, "a b c d e f", None, None, 0), (9, None, None, None, 0), (8, "", None, None, 0)]
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_dedup.group(frame(spark, rows), 4).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (8, 8, True), (9, 9, True)]
    assert near_dedup.group(frame(spark, []), 4).count() == 0
    left = near_dedup.keep_one(frame(spark, rows), 4)
    assert left.columns == frame(spark, rows).columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 1, 8, 9]


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_words_that_polynomial_hashes_confuse(spark):
    """Texts of Thue-Morse words collide for every polynomial modulo 2 ** 64; they aren't copies."""
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 3), None, None, 0), (2, " ".join([other] * 3), None, None, 0), (3, f"{one} x y z", None, None, 0), (4, f"{other} x y z", None, None, 0)]
    assert by_id(near_dedup.group(frame(spark, rows), 4), "component_id") == {i: (i,) for i in range(1, 5)}


def test_similar_compares_both_hashes():
    x = np.arange(10, dtype=np.uint64)
    assert near_dedup.similar((x, x), (x, x), 80) and not near_dedup.similar((x, x), (x, x + np.uint64(1)), 80)
    assert near_dedup.similar((x, x), (x[:8], x[:8]), 80) and not near_dedup.similar((x, x), (x[:7], x[:7]), 80)
    assert not near_dedup.similar((x[:0], x[:0]), (x, x), 80)


def test_near_repeated_rows_and_hubs(spark, monkeypatch):
    """Rows repeated often, a hub of many partners, and a component of many nodes that meets a few others in its buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "FAN", 3)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]), None, None, 0) for k in range(60)]
    rows += [(1000 + k, " ".join(base[:150] + [f"y{k}.{i}" for i in range(50)]), None, None, 0) for k in range(6)]
    got = by_id(near_dedup.group(frame(spark, rows + rows[:5] * 40), 4), "component_id")
    assert got == {i: (c,) for i, (_, c) in near_components(rows, 4).items()}


def test_near_tiles_lose_no_link(spark, monkeypatch):
    """A group of near copies around the threshold, cut into blocks of a few nodes."""
    monkeypatch.setattr(near_dedup, "FAN", 8)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 7)), replace=False):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((k, " ".join(words), None, None, 0))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = by_id(near_dedup.group(frame(spark, rows, clashes=False), 4), "component_id")
    assert got == {i: (c,) for i, (_, c) in near_components(rows, 4).items()}


def test_odd_sketches_tell_similarity():
    rng = np.random.default_rng(7)
    for n in (50, 700, 3000):
        for share in (0.8, 0.85, 0.95):
            same = int(round(2 * n * share / (1 + share)))
            union = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            a, b = np.unique(union[:n]), np.unique(np.concatenate([union[:same], union[n : 2 * n - same]]))
            bits = int(np.bitwise_count(np.frombuffer(near_dedup.odd_sketch(a), np.uint8) ^ np.frombuffer(near_dedup.odd_sketch(b), np.uint8)).sum())
            assert bits <= near_dedup.most_xor_bits(np.array([len(a)]), np.array([len(b)]), 80)[0] or share == 0.8
        other = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        bits = int(np.bitwise_count(np.frombuffer(near_dedup.odd_sketch(a), np.uint8) ^ np.frombuffer(near_dedup.odd_sketch(other), np.uint8)).sum())
        assert bits > near_dedup.most_xor_bits(np.array([len(a)]), np.array([len(other)]), 80)[0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(200, 199), (199, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {k: 5 for k in range(5, 60)} | {199: 199, 200: 199}


# --- mixing ---


def sources(spark, sizes):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 5), "en", name, 0))
            i += 1
    return rows, frame(spark, rows)


def test_mixing_exponents(spark):
    sizes = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    p = np.array([0.7, 0.2, 0.1])

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum() / np.log(3)

    a = mixing.exponent(sizes, mixing.Mix(entropy=0.9, repeats=100.0))
    assert abs(entropy(a) - 0.9) < 1e-4
    b = mixing.exponent(sizes, mixing.Mix(entropy=0.9, repeats=1.2))
    assert b > a and abs((0.1 ** (b - 1)) / (0.7 ** (b - 1)) - 1.2) < 1e-4
    assert mixing.exponent(sizes, mixing.Mix(entropy=0.1)) == 1.0


@pytest.mark.parametrize("tokens", [None, 900.0])
def test_mixing_budgets(spark, tokens):
    rows, docs = sources(spark, {"big": 600, "mid": 100, "small": 20, None: 30})
    mix = mixing.Mix(entropy=0.95, repeats=3.0, tokens=tokens)
    mixed, (turn, place, within, weight) = mixing.mix_sources(docs, mix)
    got = mixed.select("doc_id", "source", "text", turn, place, within, weight).collect()
    n = {r[0]: 1 + r[0] % 5 for r in rows}
    total, used, share = Counter(), Counter(), {}
    for r in rows:
        total[r[3]] += n[r[0]]
    for r in got:
        used[r["source"]] += n[r["doc_id"]]
        share[r["source"]] = r[weight]
    assert abs(sum(share.values()) - 1) < 1e-9
    least = min(share[s] / total[s] for s in share)
    for s in share:
        passes = share[s] * tokens / total[s] if tokens else share[s] / total[s] / least
        assert passes * total[s] - 6 <= used[s] <= passes * total[s] + 1e-6
        times = Counter(r["doc_id"] for r in got if r["source"] == s)
        assert max(times.values()) - min([times.get(r[0], 0) for r in rows if r[3] == s]) <= 1
    if not tokens:
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    order = [(r[turn], r[place], r[within]) for r in got if r["source"] == "big"]
    assert len(set(order)) == len(order)


@pytest.mark.parametrize("tokens", [None, 900.0, 5000.0])
def test_mixing_takes_what_brute_force_takes(spark, monkeypatch, tokens):
    """Whole passes, then whole blocks in their order, then documents of one block in theirs, as long as they fit."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 32)
    rows, docs = sources(spark, {"big": 600, "mid": 100, "small": 20, None: 30})
    mix = mixing.Mix(entropy=0.95, repeats=3.0, tokens=tokens)
    mixed, _ = mixing.mix_sources(docs, mix)
    got = Counter(r["doc_id"] for r in mixed.collect())
    n, of = {r[0]: 1 + r[0] % 5 for r in rows}, {r[0]: r[3] for r in rows}
    total = Counter()
    for i, source in of.items():
        total[source] += n[i]
    p = {k: v / sum(total.values()) for k, v in total.items()}
    a = mixing.exponent(spark.createDataFrame([(x,) for x in p.values()], "p double"), mix)
    z, least = sum(x**a for x in p.values()), min(x ** (a - 1) for x in p.values())
    want = Counter()
    bits = {r["bits"] for r in mixing.plan(docs, mix).select("bits").collect()}.pop()
    for source, share in p.items():
        passes = share ** (a - 1) / least if tokens is None else share**a / z * tokens / total[source]
        whole = int(passes)
        rest = int((passes - whole) * total[source])
        key = mixing.source_key(F.col("source"))
        doc_id, turn = F.col("doc_id").cast("long"), F.lit(whole)
        placed = docs.where(F.col("source").eqNullSafe(F.lit(source))).select("doc_id", mixing.block(bits, mix, turn, key, doc_id).alias("b"), mixing.order(mix, turn, doc_id).alias("o")).collect()
        blocks = defaultdict(list)
        for r in placed:
            blocks[r["b"]].append((r["o"], r["doc_id"]))
            want[r["doc_id"]] += whole
        for b in sorted(blocks):
            size = sum(n[i] for _, i in blocks[b])
            if size > rest:
                for _, i in sorted(blocks[b]):
                    if n[i] > rest:
                        break
                    rest -= n[i]
                    want[i] += 1
                break
            rest -= size
            for _, i in blocks[b]:
                want[i] += 1
    assert got == +want


def test_mixing_odd_tables(spark):
    rows = documents()
    mixed, _ = mixing.mix_sources(frame(spark, rows))
    assert mixed.columns[: len(frame(spark, rows).columns)] == frame(spark, rows).columns
    assert {r["doc_id"] for r in mixed.collect()} == {r[0] for r in rows}
    assert mixing.mix_sources(frame(spark, []))[0].count() == 0
    blank = [(1, None, None, "a", 0), (2, " ", None, None, 0)]
    assert mixing.mix_sources(frame(spark, blank))[0].count() == 2


def test_mixing_counts_tokens_of_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*documents(), (2001, "数据处理" * 300, "zh", "cjk", 0), (2002, "https://e.org/" + "aZ9_" * 200, "en", "urls", 0)]
    plain = Tokenizer.from_file(path)
    want = {r[0]: len(plain.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert by_id(mixing.token_counts(frame(spark, rows), path), "tokens") == {i: (n,) for i, n in want.items()}
    total = Counter()
    for r in rows:
        total["" if r[3] is None else f"={r[3]}"] += want[r[0]]
    p = np.array([n for n in total.values() if n]) / sum(total.values())
    a = mixing.exponent(spark.createDataFrame([(float(x),) for x in p], "p double"), mixing.Mix())
    weights = {r["key"]: r["weight"] for r in mixing.plan(frame(spark, rows), mixing.Mix(), path).collect()}
    share = {k: (n / sum(total.values())) ** a / (p**a).sum() for k, n in total.items() if n}
    assert weights.keys() == total.keys() and all(abs(weights[k] - share[k]) < 1e-9 for k in share)


def test_mixing_query_weighs_by_tokens(spark, tmp_path):
    from claimloom.llm import queries

    rows = [(i, "one two three", "en", "en", 0) for i in range(40)] + [(100 + i, "数据处理" * 30, "zh", "cjk", 0) for i in range(40)]
    frame(spark, rows, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    weights = {r["source"]: r["weight"] for r in queries.op6_mixing(spark, str(tmp_path)).select("source", "weight").distinct().collect()}
    assert weights["cjk"] > weights["en"]


# --- WARC ---


def pages(spark):
    html = ["<p>one</p>", None, "", "é" * 9000, "x" * 100_000, "<p>one</p>", "0\r\n\r\n", "\r\n" * 40]
    rows = [(i, f"http://e.org/{i}" if i % 3 else None, html[i % len(html)]) for i in range(40)] + [(4, "again", html[4]), (None, "n", "no id"), (-3, "a\r\nb", "neg")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("origin", F.lit("x")).repartition(4)


@pytest.mark.parametrize("segment,file", [(16 << 10, 64 << 20), (100, 3000)])
def test_warc_round_trip(spark, tmp_path, segment, file):
    rows, table = pages(spark)
    manifest = warc.write_pages(table, f"file://{tmp_path}/w", segment, file)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_pages(manifest).collect())
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max([x for x in (keep.get(h or ""), i) if x is not None], default=None)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = Counter((i, len((h or "").encode()), digest(h or ""), "response" if keep[h or ""] == i else "revisit", None if keep[h or ""] == i else keep[h or ""]) for i, _, h in rows)
    assert got == want
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_pages(manifest).where("record_type = 'response'").collect()}
    assert all(texts[i] == h for h, i in keep.items())
    assert warc.read_pages(warc.write_pages(table.where("false"))).count() == 0


def test_warc_common_and_repeated_payloads(spark):
    """A payload of most pages, and one row repeated often: each is a record of its own, in segments of its own."""
    rows = [(i, "u", "common " * 100 if i % 3 else f"own {i}") for i in range(300)] + [(7000, "u", "x" * 3000)] * 50 + [(None, "u", "null " * 300)] * 3
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest = warc.write_pages(table, segment_bytes=500)
    origins = warc.read_records(manifest).groupBy("origin", "number").count()
    assert origins.where("count > 1").count() == 0
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_pages(manifest, payload=False).collect())
    assert got == Counter((i, len(h), "revisit" if h[:6] == "common" and i != 299 else "response", 299 if h[:6] == "common" and i != 299 else None) for i, _, h in rows)


def test_warc_checks_segments():
    block = warc.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 500, 7)
    parts = [(i + 1, "response", None, None, block[k : k + 400]) for i, k in enumerate(range(0, len(block), 400))]
    parts[-1] = (*parts[-1][:2], len(block), *parts[-1][3:])
    origin = "<urn:page:5:D>"
    assert warc.assemble(origin, parts)[:3] == (5, b"abc" * 500, 1500)
    with pytest.raises(ValueError, match="not complete"):
        warc.assemble(origin, [p for p in parts for _ in range(2)])
    with pytest.raises(ValueError, match="not complete"):
        warc.assemble(origin, parts[:1] + parts[2:])
    with pytest.raises(ValueError, match="announced"):
        warc.assemble(origin, parts[:-1])
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


# --- HTML ---


@pytest.mark.parametrize("source,text", [
    ("", ""), ("plain &amp; &lt;b&gt;", "plain & <b>"), ("a <b>b</b>c\n  d", "a bc d"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<title>t</title><body>x<script>var a='</p>';</script>y<!-- z --></body>", "xy"), ("<div hidden>a</div><p style='display: none'>b</p><i style=\"visibility:hidden\">c</i>d", "d"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"), ("<ol start=3><li>a<li>b<li value=9>c</ol>", "3. a\n4. b\n9. c"),
    ("<table><tr><td>1<td>long cell<tr><th>wide head<td>z</table>", "1          long cell\nwide head  z"), ("<table><caption>cap</caption><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "cap\nab    c\n1  2  3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<pre> k\n  l</pre>m", " k\n  l\n\nm"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<details><summary>s</summary>hidden</details>", "s"),
    ("<h1>h</h1>x", "h\n\nx"), ("<textarea>a<b></textarea>", "a<b>"), ("a < b && c", "a < b && c"), ("<p>unclosed <b>tag", "unclosed tag"), ("</p>x</div>", "x"), ("<template>t</template><noscript>n</noscript>", "n"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<div><p>x</div>y", "x\n\ny"), ("<a href='x>y'>l</a>", "l"), ("<script>never closed", ""), ("x<!-- never closed", "x"),
])
def test_html_layout(source, text):
    assert html_text.render(source) == text


def test_html_deep_and_long():
    assert html_text.render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert html_text.render("<p>" + "word " * 200_000).count("word") == 200_000


@pytest.mark.parametrize("source,text", [
    ("<p>E<math><mi>x</mi><mo>=</mo><mn>2</mn></math>!", "Ex=2!"), ("<math><semantics><mfrac><mn>1</mn><mi>n</mi></mfrac><annotation>tex</annotation></semantics></math>", "1 n"),
    ("<svg><title>t</title><desc>d</desc><style>s</style><g/><path d='M0'/><text>a<tspan>b</tspan></text><text>c</text></svg> e", "ab c e"), ("<svg><title/><text>a</text></svg>b", "a b"),
    ("<svg><g><p>out</p>", "out"), ("<svg><text><![CDATA[a > b]]></text></svg>", "a > b"), ("<svg><foreignObject><p>f</p></foreignObject></svg>", "f"),
    ("<object>fallback</object>", "fallback"), ("<object data=x>fallback</object>", ""), ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
    ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>d", "d"), ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", "b"),
    ("<i>" * 300 + "<div hidden>no</div><details><summary>s</summary>no</details>yes", "s\nyes"), ("<div hidden>" + "<b>" * 300 + "<i>x</i></b>no</div>", ""),
    ("<blockquote>" * 300 + "x", "  " * 300 + "x"), ("<table><tr><td>" * 2000 + "x", "x"), ("<b>" * 100_000 + "x" + "</i>" * 100_000, "x"),
])
def test_html_all_visible_text(source, text):
    assert html_text.render(source) == text


class PlainWords(HTMLParser):
    """The words of the pages in the driver's tables, in order, with no layout: a second reader that shares nothing with the first."""

    UNSEEN = {"head", "script", "style", "template", "title", "iframe"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "u", "small", "sub", "sup", "font", "abbr", "mark"}

    def __init__(self, source):
        super().__init__()
        self.parts, self.unseen = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self.UNSEEN:
            self.unseen.append(tag)
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.unseen and self.unseen[-1] == tag:
            self.unseen.pop()
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def test_html_words_of_all_pages():
    """No word of any page is lost, added or moved but for list marks and the cells of a row."""
    import pyarrow.parquet as pq

    mark = re.compile(r"-|\d+\.")
    for source in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        want = [w for w in "".join(PlainWords(source or "").parts).split() if not mark.fullmatch(w)]
        got = [w for w in html_text.render(source or "").split() if not mark.fullmatch(w)]
        assert Counter(got) == Counter(want)
        if "<table" not in (source or ""):
            assert got == want


@pytest.mark.parametrize("value,rows,columns", [("0", 65534, 1), ("3", 3, 3), (" +2x", 2, 2), ("70000", 65534, 1000), ("9" * 40, 65534, 1000), ("-1", 1, 1), ("", 1, 1)])
def test_spans(value, rows, columns):
    cell = html_text.Node("td", {"rowspan": value, "colspan": value})
    assert (html_text._span(cell, "rowspan"), html_text._span(cell, "colspan")) == (rows, columns)


def test_html_leaves_the_input_as_it_is(spark):
    table = spark.createDataFrame([(1, "<p>a")], "page_id long, html string")
    for _ in range(2):
        found, name = html_text.extract(table)
        assert (name, table.columns, found.first()[name]) == ("text", ["page_id", "html"], "a")


def test_html_of_a_table(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "b")]
    table = spark.createDataFrame(rows, "page_id long, html string").withColumn("Text", F.lit("other"))
    found, name = html_text.extract(table)
    assert name != "text" and sorted((r["page_id"] or -1, r[name], r["Text"]) for r in found.collect()) == [(-1, "b", "other"), (1, "", "other"), (2, "", "other"), (3, "a", "other"), (3, "a", "other")]
    assert html_text.extract(table.where("false"))[0].count() == 0


# --- pipeline ---


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    prose = lambda k: " ".join(rng.choice(["the", "of", "and", "to", *[f"w{i}" for i in range(40)]], k))
    texts = [prose(60) for _ in range(30)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + " end", "short", None, "### " * 50]
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)]
    frame(spark, rows, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert seen["quality_rules"] == [i for i in range(33)]
    assert seen["exact_dedup"] == [*range(30), 32]
    left = [r for r in rows if r[0] in seen["exact_dedup"]]
    assert seen["near_dedup"] == sorted({c for _, c in near_components(left, 5).values()})
    assert set(seen["source_mix"]) == set(seen["near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in packed.collect()}) == seen["near_dedup"]


def test_deep_indents_are_linear():
    import time

    for open_, words in (("<blockquote>x", 4000), ("<ul><li>x", 4000), ("<dl><dd>x", 4000), ("<blockquote><table><tr><td>x", 400)):
        began = time.time()
        text = html_text.render(open_ * words)
        assert text.split().count("x") == words and len(text) < words * (2 * html_text.INDENT + 40) and time.time() - began < 20, open_
    assert html_text.render("<ul><li>a<ul><li>b<li>c</ul><li><blockquote>d<p>e</blockquote></ul>") == "- a\n  - b\n  - c\n-   d\n\n    e"


def test_pipeline_stages_on_edges(spark):
    """Clashing columns come through, repeated rows and nulls have their results, an empty table stays empty."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = [(1, "one two three four five six seven", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (1, "one two three four five six seven", "en", "a", 1), (3, "one  two three four five six seven", None, None, 9)]
    left = {
        "quality_rules": [],
        "exact_dedup": [(1, "a"), (2, "a")],
        "near_dedup": [(None, None), (1, "a"), (1, "a"), (2, "a")],
    }
    for name, want in left.items():
        docs = frame(spark, rows, parts=2)
        got = stages[name](spark, docs, "")
        assert got.columns == docs.columns, name
        assert Counter((r["doc_id"], r["source"]) for r in got.collect()) == Counter(want), name
        assert stages[name](spark, docs.where("false"), "").count() == 0, name
