"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<turn ROLE>``, the text on lines of its own, and ``</turn>``; ``\\``, ``<`` and ``>`` inside roles and
texts get a ``\\`` before them, so a control string never appears there and reading undoes it. Rendered text is encoded once,
with offsets; the sorted spans of assistant texts meet the sorted spans of tokens by binary search. What is written is token
ids and their mask.

Turns are dealt to tasks by range of (conversation, turn), so a conversation of any length is spread over tasks. A task
renders its turns in order into segments: a conversation is one segment, unless its rendered text passes ``segment_chars``
or its turns lie in the ranges of two tasks. Every turn ends in one line end after ``>`` and the next begins with ``<``,
between which the pre-tokenizer always cuts, so segments encode as the whole conversation would.

Reading back, each segment's text is made of the bytes of its ids, and its loss text of the bytes under the mask, clipped
to the texts of turns, as a token may reach over the edge of one. A masked token that holds nothing of any turn's text is an
error. The segments of a conversation stream by in order and only digests are kept. This needs a vocabulary whose ids spell
the text out byte by byte; any other is refused.

Defined results: a null text or role is empty; rows of one conversation and turn are all kept, in the order of role and text;
a null conv_id is a conversation of its own; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm.encoding import byte_alphabet
from claimloom.llm.shared import materialize, slices

_ESCAPED = re.compile(r"[\\<>]")
_MARKED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _MARKED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], scored: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The text of (role, text) turns, and where the scored role's texts begin and end in it."""
    out, begins, ends, at = [], [], [], 0
    for role, text in turns:
        head, body, tail = f"<turn {escape_role(role)}>\n", escape(text), "\n</turn>\n"
        out += [head, body, tail]
        if role == scored and body:
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(head) + len(body) + len(tail)
    return "".join(out), begins, ends


def parse(data: bytes):
    """The turns of rendered text in UTF-8: role, and where the (escaped) text begins and ends."""
    at = 0
    while at < len(data):
        end_of_head = data.index(b">\n", at)
        end = data.index(b"\n</turn>\n", end_of_head + 1)
        yield unescape_role(data[at + len(b"<turn ") : end_of_head].decode()), end_of_head + 2, end
        at = end + len(b"\n</turn>\n")


def token_mask(offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens, given their sorted (begin, end) offsets, overlap one of the sorted spans."""
    if not len(begins):
        return np.zeros(len(offsets), bool)
    first = np.searchsorted(ends, offsets[:, 0], side="right")  # the first span that ends after the token begins
    return (first < len(begins)) & (begins[np.minimum(first, len(begins) - 1)] < offsets[:, 1])


SEGMENTS = "conv_id long, part int, seq int, n_turns int, ids array<int>, loss_mask array<boolean>"
_tokenizers: dict[str, Tokenizer] = {}
_spellings: dict[str, list[bytes]] = {}


def tokenizer_of(vocabulary: str) -> Tokenizer:
    """The worker's tokenizer for a vocabulary file, kept from task to task."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = Tokenizer.from_file(vocabulary)
    return _tokenizers[vocabulary]


def spellings(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary without a normalizer; a ValueError of any other."""
    if vocabulary not in _spellings:
        spec = json.loads(tokenizer_of(vocabulary).to_str())
        if spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{vocabulary}: its ids don't spell texts out byte by byte")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        table = {i: bytes(byte_of[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        _spellings[vocabulary] = [table.get(i, b"") for i in range(max(table) + 1)]
    return _spellings[vocabulary]


def format_turns(turns: DataFrame, vocabulary: str, scored: str = "assistant", segment_chars: int = 1 << 16) -> DataFrame:
    """The formatted segments of all conversations (conv_id, turn, role, text), ordered by (part, seq) in each."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    keys = ["conv_id", "turn", "role", "text"]

    def build(batches):
        tokenizer, part, seq = tokenizer_of(vocabulary), TaskContext.get().partitionId(), 0
        spellings(vocabulary)  # an unsupported vocabulary fails before anything is written
        conv, held, size = None, [], 0

        def segment():
            text, begins, ends = render(held, scored)
            found = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
            mask = token_mask(offsets, np.array(begins, np.int64), np.array(ends, np.int64))
            return conv, part, seq, len(held), found.ids, mask

        def batch_of(rows):
            schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_turns", pa.int32()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, gathered = [], 0
        for batch in slices(batches, most=1 << 20):
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if held and (c != conv or size >= segment_chars):
                    rows.append(segment())
                    gathered += size
                    seq, held, size = seq + 1, [], 0
                    if gathered > 1 << 20:
                        yield batch_of(rows)
                        rows, gathered = [], 0
                conv = c
                held.append((role, text))
                size += len(text) + 32
        if held:
            rows.append(segment())
        if rows:
            yield batch_of(rows)

    # what the bounds of ranges are made of is short, and in the order of the whole keys
    head = F.when(F.length("role") < 32, F.substring("text", 1, 32)).otherwise("")
    ranged = clean.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), head)
    return materialize(ranged.sortWithinPartitions(*keys).mapInArrow(build, SEGMENTS), "chat-segments")


def read_segment(ids: np.ndarray, mask: np.ndarray, spelled: list[bytes]) -> tuple[str, list[tuple[str, str]], list[str]]:
    """What a segment's ids and mask say: its text, its (role, text) turns, and each turn's text under the mask."""
    if len(ids) != len(mask):
        raise ValueError("a segment's mask isn't of the length of its ids")
    words = [spelled[i] for i in ids.tolist()]
    data = b"".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    masked = np.repeat(mask, sizes)
    inside = np.zeros(len(data), bool)
    turns, loss = [], []
    for role, begin, end in parse(data):
        inside[begin:end] = True
        turns.append((role, unescape(data[begin:end].decode())))
        under = np.frombuffer(data, np.uint8)[begin:end][masked[begin:end]].tobytes()
        loss.append(unescape(under.decode(errors="replace")))
    ends = np.cumsum(sizes)
    within = np.concatenate([[0], np.cumsum(inside)])
    if (mask & (within[ends] == within[ends - sizes])).any():
        raise ValueError("a masked token holds nothing of a turn's text")
    return data.decode(), turns, loss


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(segments: DataFrame, vocabulary: str) -> DataFrame:
    """A row per conversation, from the token ids and the loss mask alone: what its turns and its masked text are."""

    def read(batches):
        spelled = spellings(vocabulary)
        state, rows = None, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row():
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows):
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask")):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text, turns, loss = read_segment(ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False), spelled)
                for role, said in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for said in loss:
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if rows:
                yield batch_of(rows)
                rows = []
        if state is not None:
            yield batch_of([row()])

    ordered = segments.select("conv_id", "part", "seq", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(read, DIGEST)
