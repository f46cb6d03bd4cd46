"""Shards, counts, packing and chat formatting against the tokenizers library."""

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import chat, packing, sstable, token_counts
from claimloom.llm.encoding import ChunkEncoder
from tests.llm.cases import documents, frame

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "  ", "a  b", "a   b", "a \n b", "x  <|endoftext|> y<|endoftext|>", "foo\n bar  ", "  a", "tail \n", "it's  'll 12345 's 're\n've don't'll'x 'r", "'r", "'", "a'", "a'r", "a'v ", "a'll's", "!'s", "\n's", "\t\tx",
    "日本語 テキスト", "١٢٣ x²", "ab" * 300, " " * 200, "a\0b\0", "\0 x", "é́ ́x", "İ ΑΣ ς", "end.\nNext", "end.\n\nNext", "a b   c", "<|startoftext|> A", None,
]


@functools.cache
def plain_tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    return plain_tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunk_encoder_equals_the_library(path):
    texts = HARD + [r[1] for r in documents()]
    coder = ChunkEncoder(path, limit=50)  # so small that everything is forgotten in between
    got = [x.tolist() for part in (texts[:40], texts[40:], texts) for x in coder.encode(pa.array(part, pa.string()))]
    assert got == [ids_of(path, t) for t in texts + texts]
    assert coder.counts(pa.array(texts, pa.string())).tolist() == [len(ids_of(path, t)) for t in texts]
    assert coder.encode(pa.array([], pa.string())) == [] and coder.counts(pa.array([], pa.string())).tolist() == []


def test_transducer_equals_the_library():
    texts = [t or "" for t in HARD + [r[1] for r in documents()]]
    machine = token_counts.Transducer(BYTE, most_states=500, most_known=50)
    got = machine.counts(texts).tolist() + machine.counts(texts).tolist()
    assert got == [len(ids_of(BYTE, t)) for t in texts] * 2
    assert machine.counts([]).tolist() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Transducer(WORD)


def test_scan_composes_states_and_counts():
    rng = np.random.default_rng(6)
    maps, emitted = rng.integers(0, 5, (37, 5)).astype(np.uint8), rng.integers(0, 9, (37, 5))
    states, counts = token_counts.scan(maps, emitted)
    for entry in range(5):
        state, total = entry, 0
        for k in range(37):
            total += emitted[k, state]
            state = maps[k, state]
            assert (states[k, entry], counts[k, entry]) == (state, total)
    each = rng.integers(0, 9, 1000)
    assert token_counts.emitted_before(each).tolist() == [0, *np.cumsum(each).tolist()]
    assert token_counts.emitted_before(each[:0]).tolist() == [0]


def test_splitter_does_not_depend_on_chunks(monkeypatch):
    text = "it's  a 'test' \n\n of're  12's " * 30
    kinds = np.append(token_counts.classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.uint8(token_counts.END))
    whole = token_counts.pretoken_starts(kinds)
    for size in (1, 3, 7, 1000):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert (token_counts.pretoken_starts(kinds) == whole).all()


def test_token_counts_of_a_table(spark):
    rows = documents() + [(None, "null id", None, None, 0)]
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(frame(spark, rows), BYTE).collect()}
    want = {(r[0], len((r[1] or "").encode()), n, n > 512) for r in rows for n in [len(ids_of(BYTE, r[1]))]}
    assert got == want
    assert token_counts.count_tokens(frame(spark, []), BYTE).count() == 0


def test_shards_round_trip_and_lookup(spark, tmp_path):
    rows = documents() + [(14, "again", None, None, 0), (14, "again", None, None, 0), (None, "null id", None, None, 0), (-5, "negative", None, None, 0)]
    manifest = sstable.write_shards(frame(spark, rows), BYTE, end_id=2, folder=f"file://{tmp_path}/shards", shard_bytes=4000)
    assert manifest.count() >= 2
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_shards(manifest).orderBy("start").collect()]
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(BYTE, r[1]) + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    wanted = spark.createDataFrame([(14,), (-5,), (123456,), (rows[70][0],)], "doc_id long")
    found = sorted((r["doc_id"], r["ids"]) for r in sstable.lookup(manifest, wanted).collect())
    assert found == sorted([(14, ids_of(BYTE, r[1]) + [2]) for r in rows if r[0] == 14] + [(-5, ids_of(BYTE, "negative") + [2]), (rows[70][0], ids_of(BYTE, rows[70][1]) + [2])])
    every = spark.createDataFrame([(r[0],) for r in rows] * 2, "doc_id long").repartition(3)
    found = sorted((r["doc_id"] or -1, r["ids"]) for r in sstable.lookup(manifest, every).collect())
    assert found == sorted((r[0] or -1, ids_of(BYTE, r[1]) + [2]) for r in rows)
    assert sstable.lookup(manifest, every.where("false")).count() == 0
    nothing = sstable.write_shards(frame(spark, []), BYTE, 2)
    assert sstable.read_shards(nothing).count() == 0 and sstable.lookup(nothing, every).count() == 0


def test_shards_of_small_entries_are_cut_by_number(spark, monkeypatch):
    monkeypatch.setattr(sstable, "MOST_ENTRIES", 10)
    manifest = sstable.write_shards(frame(spark, [(i, None, None, None, 0) for i in range(95)]), BYTE, end_id=2)
    assert max(r["n_docs"] for r in manifest.collect()) <= 10
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in sstable.read_shards(manifest).orderBy("doc_id").collect()] == [(i, i, 1) for i in range(95)]
    wanted = spark.range(-5, 200).withColumnRenamed("id", "doc_id")
    assert sorted((r["doc_id"], r["ids"]) for r in sstable.lookup(manifest, wanted).collect()) == [(i, [2]) for i in range(95)]


def test_shard_search_within_a_file(tmp_path):
    path = str(tmp_path / "one.sst")
    with pa.OSFile(path, "wb") as out:
        writer = sstable.ShardWriter(out, 2, block_bytes=64)
        for k in [None, *range(-40, 400, 2), *[400] * 30]:
            writer.add(sstable.encode_key(k), np.array([k or 0, 2], "<i2").tobytes())
        writer.close()
    shard = sstable.Shard(path)
    assert len(shard.places) > 10 and shard.entries == 251
    assert [len(shard.get(k)) for k in (None, -40, -39, 7, 398, 400, 401)] == [1, 1, 0, 0, 1, 30, 0]


@pytest.mark.parametrize("most", [64, 2048])
def test_packing(spark, most):
    rows = documents() + [(14, "again", None, None, 0), (None, None, None, None, 0)]
    got = packing.pack_documents(frame(spark, rows), WORD, 1, most).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(ids_of(WORD, r[1]) + [1])
    sequences, pieces = {}, {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        pieces.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"], p["ids_crc32"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    want = sorted((r, s, len(x[s : s + most]), zlib.crc32(np.array(x[s : s + most], "<u4").tobytes()), len(x)) for r, many in ids.items() if r is not None for x in many for s in range(0, len(x), most))
    assert sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in got if p["doc_id"] is not None) == want
    total = sum(p["length"] for p in got)
    assert len(sequences) <= -(-total // most) * 1.15 + 1
    assert packing.pack_documents(frame(spark, []), WORD, 1, most).count() == 0


def test_packing_in_lanes(spark):
    """One length has most pieces, dealt to many lanes; every place of every sequence is taken once."""
    rows = [(i, 0, 30 if i % 5 else 1 + i % 37, i, 0) for i in range(4000)]
    parts = spark.createDataFrame(rows, packing.PIECES).repartition(7)
    got = packing.pack(parts, 100, lane_rows=64).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4000))
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(at) == list(range(len(at)))
    for parts in at.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 100


def test_slots_stay_few():
    """However many pieces there are and however often a length fits into a sequence."""
    histogram = {n: 10 ** (n % 9) for n in range(1, 2049)} | {1: 10**9}
    found = packing.patterns(histogram, 2048)
    rows = packing.places(found)
    assert len(found) <= 3 * 2048 and len(rows) <= 63 * len(found)
    taken = {}
    for length, _, _, count, _, times in rows:
        taken[length] = taken.get(length, 0) + count * times
    assert taken == histogram


def test_other_vocabularies_go_to_the_library_whole(tmp_path):
    import json

    spec = json.load(open(BYTE))
    for k, change in enumerate(({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}})):
        path = str(tmp_path / f"other{k}.json")
        json.dump(spec | change, open(path, "w"))
        coder = ChunkEncoder(path)
        assert coder.kind is None
        assert [x.tolist() for x in coder.encode(pa.array(HARD, pa.string()))] == [ids_of(path, t) for t in HARD]
        assert coder.counts(pa.array(HARD, pa.string())).tolist() == [len(ids_of(path, t)) for t in HARD]


def test_packing_keeps_ids(spark):
    rows = [(1, "some words here", None, None, 0), (2, None, None, None, 0)]
    got = {r["doc_id"]: r["ids"] for r in packing.pack_documents(frame(spark, rows), WORD, 1, with_ids=True).collect()}
    assert got == {1: ids_of(WORD, "some words here") + [1], 2: [1]}


def test_patterns_place_every_length_once():
    rng = np.random.default_rng(2)
    for _ in range(30):
        histogram = {int(x): int(rng.integers(1, 500)) for x in rng.integers(1, 101, 25)}
        found = packing.patterns(histogram, 100)
        assert all(sum(p) <= 100 for p, _ in found)
        placed = {}
        for pattern, count in found:
            for x in pattern:
                placed[x] = placed.get(x, 0) + count
        assert placed == histogram


ODD = ["", None, "plain", "\\### Assistant: </turn> ok", "<turn user>\nx\n</turn>\n", "a\\", "\\n <> >\n", "é   <|endoftext|>", " \n", "x" * 3000]


def test_chat(spark):
    rows = [(c, t, role, ODD[(c + t) % len(ODD)]) for c in range(12) for t, role in enumerate(["user", "assistant", "assistant", None, "sys\ntem>\n<\\", ""])]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "assistant", "no id")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(900)]
    rows += [(50, 0, "assistant", "é " * 40_000), (51, 0, "assistant", " \n\n  led by white space")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table = table.withColumns({c: F.lit("x") for c in ("ids", "part", "seq", "loss_mask", "n_turns", "Text_")})
    segments = chat.format_turns(table, BYTE, segment_chars=2000)
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.digest(segments, BYTE).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(x for _, role, x in turns if role == "assistant")
        size = sum(len(chat.render([(a, b)])[0]) for _, a, b in turns)
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
        assert got[conv] == want, conv
    parts = segments.where("conv_id = 99").orderBy("part", "seq").collect()
    assert len(parts) > 3
    whole, begins, ends = chat.render([("assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(900)])
    assert [i for p in parts for i in p["ids"]] == ids_of(BYTE, whole)
    mask = [m for p in parts for m in p["loss_mask"]]
    offsets = Tokenizer.from_file(BYTE).encode(whole, add_special_tokens=False).offsets
    assert mask == [any(b < e2 and e > b2 for b, e in zip(begins, ends)) for b2, e2 in offsets]
    assert chat.digest(chat.format_turns(table.where("false"), BYTE), BYTE).count() == 0


def test_chat_digest_comes_from_ids_and_mask(spark):
    """Whatever bit of the mask or id is changed, the loss text changes, or reading fails."""
    turns = [("user", "a question <b>?"), ("assistant", "the answer, née x"), ("user", "more"), ("assistant", "\n tail")]
    text, begins, ends = chat.render(turns)
    found = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False)
    ids, offsets = np.array(found.ids), np.array(found.offsets)
    mask, spelled = chat.token_mask(offsets, np.array(begins), np.array(ends)), chat.spellings(BYTE)
    assert chat.read_segment(ids, mask, spelled) == (text, turns, ["", turns[1][1], "", turns[3][1]])
    for k in range(len(ids)):
        flipped = mask.copy()
        flipped[k] = not mask[k]
        try:
            assert chat.read_segment(ids, flipped, spelled)[2] != ["", turns[1][1], "", turns[3][1]]
        except ValueError as e:
            assert "masked token" in str(e) and not mask[k]
    with pytest.raises(ValueError):
        chat.read_segment(ids, mask[:-1], spelled)
    table = spark.createDataFrame([(1, t, role, said) for t, (role, said) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(table, BYTE)
    k = int(np.flatnonzero(mask)[2])
    other = segments.withColumn("loss_mask", F.transform("loss_mask", lambda m, i: F.when(i == k, ~m).otherwise(m)))
    assert chat.digest(segments, BYTE).first()["loss_sha256"] != chat.digest(other, BYTE).first()["loss_sha256"]
    with pytest.raises(ValueError, match="byte by byte"):
        chat.spellings(WORD)


@pytest.mark.parametrize("role,text", [("user", t or "") for t in ODD] + [("a\nb<>\\n", "x")])
def test_chat_escapes(role, text):
    rendered, _, _ = chat.render([(role, text), ("assistant", text)])
    data = rendered.encode()
    assert [(r, chat.unescape(data[a:b].decode())) for r, a, b in chat.parse(data)] == [(role, text), ("assistant", text)]


def test_a_long_run_of_letters_keeps_memory():
    """States are dropped within a pre-token, too, and the count stays the library's."""
    import random

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    machine = token_counts.Transducer(path, most_states=5_000)
    assert machine.counts([text])[0] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert len(machine.states) <= 5_001 and not any(len(x) > token_counts.LONGEST for x in machine.known)
