"""Resampling and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import codes, resampling
from tests.llm.cases import LOWER, documents, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=5, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for x in runs(text)[1]:
                counts[bucket(x)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for r in rows:
        n, found = runs(r[1])
        weight = sum(gain[bucket(x)] for x in found)
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    want = percent * len(fit) // 100
    return [(*x[:4], None) for x in out if x[4] < least] + [(*x[:4], i + 1 if i < want else None) for i, x in enumerate(fit)]


def target_frame(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_draw(spark, percent, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 4000)
    rows = documents() + [(None, "some words here again " * 9, "en", "s", 0), (3000, "W" * 9000 + " É-x" * 700, "en", "s", 0), (3001, "a_b c@d [e] {f} ~g 1 2 3 " * 5, "en", "s", 0)]
    target = [rows[3][1], rows[10][1], None, "Some words HERE"]
    got = resampling.draw(resampling.scored(frame(spark, rows), target_frame(spark, target)), percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, target, percent), key=str)


def test_repeated_rows_draw_together(spark):
    rows = [(7, "one two three four five " * 6, "en", "s", 0)] * 50 + [(i, f"w{i} " * 25, "en", "s", 0) for i in range(50)]
    got = resampling.draw(resampling.scored(frame(spark, rows), target_frame(spark, ["one two three"])), 60).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, ["one two three"], 60), key=str)


def test_empty_tables_and_documents_drawn(spark):
    rows, target = documents(), target_frame(spark, ["one two three"])
    assert resampling.draw(resampling.scored(frame(spark, rows).where("false"), target)).count() == 0
    none = resampling.draw(resampling.scored(frame(spark, rows), target.where("false"))).where("rank is not null").count()
    assert none == len([r for r in plain(rows, []) if r[4]])
    docs = frame(spark, rows).withColumn("rank", F.lit("x"))
    drawn, rank = resampling.resample(docs, target, percent=20)
    assert rank == "rank_" and {r["doc_id"] for r in drawn.collect()} >= {r[0] for r in plain(rows, ["one two three"], 20) if r[4]}


def test_crcs_of_runs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([1, 5, 63, 64, 65, 700]))) for _ in range(2))
        assert resampling.advance(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def plain_codes(rows, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 8 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // 8
    cut = [[q[p * width : (p + 1) * width] for p in range(8)] for _, q, _ in kept]
    books = [[cut[e][p] for e in range(min(16, len(cut)))] for p in range(8)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (dist(x[p], books[p][e]), e)) for p in range(8)] for x in cut]
    for _ in range(rounds):
        codes_ = nearest()
        for p in range(8):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes_) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    codes_ = nearest()
    digest = hashlib.sha256(",".join(str(x) for p in range(8) for e in books[p] for x in e).encode()).hexdigest()
    errors = [sum(dist(x[p], books[p][c[p]]) for p in range(8)) for x, c in zip(cut, codes_)]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for k in c), e, total[label], digest) for (i, _, label), c, e in zip(kept, codes_, errors)]


def vectors(n, seed=1, dims=16):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(i * 3 % 1009, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centre)], rng.choice([None, 1, 2, 3])) for i in range(n)]


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({k: F.lit("x") for k in ("q", "code", "upper", "sums", "_label", "error")})


@pytest.mark.parametrize("n", [300, 5])
def test_codes(spark, n):
    rows = vectors(n)
    got = codes.encode(vector_frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows))


def test_odd_vectors(spark):
    rows = vectors(60, 4) + [(5000, None, 1), (5001, [1.0] * 15 + [None], 1), (5002, [float("nan")] * 16, 2), (5003, [float("inf")] + [0.0] * 15, 2), (5004, [], 1), (5005, [1.0] * 8, 1), (5006, [1.0] * 15, 1)]
    rows += [(None, [0.5] * 16, None)] + [(4, [0.25] * 16, 9)] * 40 + [(6000 + i, [float(i % 2)] * 16, 1) for i in range(20)]
    got = codes.encode(vector_frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes(rows), key=str)
    assert codes.encode(vector_frame(spark, rows).where("false")).count() == 0
    with pytest.raises(Exception, match="65536 or more"):
        codes.encode(vector_frame(spark, [(1, [70000.0] * 8, 1)])).count()


def test_bounds_spare_comparisons(spark):
    rows = vectors(400, 7)
    _, _, full = codes.train(vector_frame(spark, rows))
    assert full[0] == 400 * 8 and sum(full[-3:]) < 400 * 8
