"""Removal of repeated passages against a plain search of every string."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import repeats
from tests.llm.cases import documents, frame


def plain(rows, length):
    """(doc_id, text) to n_bytes, spans and what is left; rows in any order."""
    order = sorted({(r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()[:15], r[1] or "") for r in rows})
    seen, out = set(), {}
    for missing, doc, _, text in order:
        raw, gone = text.encode(), bytearray(len(text.encode()))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        spans, i = [], 0
        while i < len(raw):
            j = i
            while j < len(raw) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out[None if missing else doc, text] = (len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def passages(seed=3):
    """Texts that share passages of all lengths, inside a text too, and over other text on both sides."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdeé 字") for _ in range(n))
    shared = [letters(rng.randint(15, 400)) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(shared)
            a = rng.randint(0, len(x) // 2)
            parts += [letters(rng.randint(0, 60)), x[a : rng.randint(a, len(x))]]
        rows.append((i * 7 % 1009, "".join(parts), "en", "s", 0))
    rows.append((2000, "ab" * 3000, "en", "s", 0))  # a run of period two
    rows.append((2001, "z" * 5000 + shared[0], "en", "s", 0))
    return rows


def check(spark, rows, length, **kw):
    known = plain(rows, length)
    want = [(r[0], n, n - len(left), len(spans), hashlib.sha256(left).hexdigest(), spans, left) for r in rows for n, spans, left in [known[r[0], r[1] or ""]]]
    found = repeats.find(frame(spark, rows, **kw), length, kept=True).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("length", [8, 33, 100])
def test_all_strings(spark, length):
    check(spark, passages(), length)


def test_groups_of_many_runs_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LIMIT", 3)
    monkeypatch.setattr(repeats, "PIECE", 700)
    check(spark, passages(9), 24, parts=7)


def test_odd_documents(spark):
    rows = documents()
    rows += [(None, rows[3][1], None, None, None), (None, "x" * 300, None, None, None), (5, rows[4][1], "en", "s", 1), (5, rows[4][1], "en", "s", 1), (5, "y" * 250, "en", "s", 1), ((1 << 63) - 1, "x" * 300, None, None, None)]
    check(spark, rows, 40)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g " * 30, "en", "s", 1)] * 40 + [(2, "a b c d e f g " * 9 + "!", "en", "s", 1)] * 3
    check(spark, rows, 30)
    assert repeats.find(frame(spark, rows).where("false")).count() == 0
    assert repeats.find(frame(spark, [(1, None, None, None, None)])).select("n_bytes", "n_removed", "n_spans").collect() == [(0, 0, 0)]


def test_longest_previous_factors():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(20)]
    windows = np.array([len(x) - 8 + 1 for x in texts])
    place, size = repeats.longest_previous(texts, windows, 8)
    whole, found = b"\0".join(texts), {}
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    for i in range(len(whole)):
        stop = int(ends[np.searchsorted(ends, i)])
        best = 0
        for j in range(i):
            other, k = int(ends[np.searchsorted(ends, j)]), 0
            while i + k < stop and j + k < other and whole[i + k] == whole[j + k]:
                k += 1
            best = max(best, k)
        if best >= 8:
            found[i] = min(best, 16)  # order and prefixes go as deep as two windows
    assert {int(p): min(int(s), 16) for p, s in zip(place, size)} == found


def test_the_query_leaves_other_texts_alone(spark):
    rows = [(i, f"{i} " + " ".join(f"w{(i * 37 + k * k) % 1013}" for k in range(60)), "en", "s", 0) for i in range(50)]
    assert repeats.find(frame(spark, rows)).agg(F.sum("n_removed")).first()[0] == sum(n - len(left) for n, _, left in plain(rows, 100).values())
