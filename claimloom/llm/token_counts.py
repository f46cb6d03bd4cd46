"""Token counts by compiled finite-state transducers.

Two deterministic transducers count the tokens of a byte-level vocabulary without making them.

The first reads code-point classes and marks where pre-tokens begin. It has eleven states, so a chunk of text is a map from
entry state to exit state; all chunks of a batch of documents are mapped at once, the maps compose through a parallel prefix
scan, and with its entry state each chunk emits its marks.

Where a pre-token begins the second one is in its start state, whatever precedes. So the maps of chunks that are cut there
have one entry state only, and a count: the tokens that are emitted from there on. The same scan composes these, and a text's
tokens are the difference between the counts at its ends. Within a chunk each distinct pre-token is run once per worker.

The second reads the bytes of a pre-token. Its transitions carry the change of the number of tokens of what has been read:
the last token of a prefix is the one token that ends it and may follow the last token of what precedes it, so a state need
hold only, for the places in the longest suffix that begins a token, the last token there and the count against the present
one. States are made as they are met and dropped together when there are ``most_states``; so is the table of pre-tokens
already counted. Neither changes a count. Both machines are those of one kind of vocabulary, a byte-level BPE with its usual
pre-tokenizer and no normalizer; any other is refused.

Defined results: a null text is an empty one with no tokens; strings of special tokens inside a text count as that token, as
the library has it by default; repeated rows are counted each; a null doc_id is passed on; an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm.encoding import byte_alphabet, vocabulary_kind
from claimloom.llm.shared import slices, text_column

# classes of code points
SPACE, BLANK, NUMBER, OTHER, QUOTE, SHORT, R, V, L, E, LETTER, END = range(12)
# states: what the pre-token that is being read is made of; QUOTED ones may turn out a contraction
START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED, AFTER_SPACE, AFTER_BLANK = range(11)
# marks: a pre-token begins at this code point, or at the one before
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by state and class, for contractions, words, numbers, other runs and white space."""
    step, mark = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    opens = {SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, END: START}
    opens |= dict.fromkeys((SHORT, R, V, L, E, LETTER), LETTERS)
    letters = (SHORT, R, V, L, E, LETTER)
    for state in range(11):
        for c, state_of in opens.items():
            step[state, c], mark[state, c] = state_of, HERE
    for c in letters:  # runs go on
        mark[LETTERS, c] = 0
    mark[NUMBERS, NUMBER] = 0
    for state in (OTHERS, QUOTED):
        for c in (OTHER, QUOTE):
            step[state, c], mark[state, c] = OTHERS, 0
    for c, state in ((SHORT, CLOSED), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        step[QUOTED, c], mark[QUOTED, c] = state, 0
    for state, closing in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        for c in range(12):  # no contraction: the letter began a word
            mark[state, c] = BEFORE | (0 if c in letters else HERE)
        step[state, closing], mark[state, closing] = CLOSED, 0
    for state in (AFTER_SPACE, AFTER_BLANK):
        for c in (SPACE, BLANK):
            mark[state, c] = 0
        for c in (NUMBER, OTHER, QUOTE, *letters):  # the last white space of a run stands apart, a space joins what follows
            mark[state, c] = BEFORE | (HERE if state == AFTER_BLANK else 0)
    step[AFTER_SPACE, QUOTE] = OTHERS
    return step, mark


STEP, MARK = _splitter()
CHUNK = 64
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
            found = "".join(regex.findall(pattern + "+", every))
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        for characters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
            for c in characters:
                table[ord(c)] = kind
        _classes.append(table)
    return _classes[0]


def scan(maps: np.ndarray, emitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The composition of each row with all rows before it, in a logarithmic number of steps.

    A row of ``maps`` has the exit state by entry state, a row of ``emitted`` the count by entry state.
    """
    maps, shift = maps.copy(), 1
    emitted = None if emitted is None else emitted.copy()
    while shift < len(maps):
        earlier = maps[:-shift].astype(np.intp)
        if emitted is not None:
            emitted[shift:] = emitted[:-shift] + np.take_along_axis(emitted[shift:], earlier, axis=1)
        maps[shift:] = np.take_along_axis(maps[shift:], earlier, axis=1)
        shift *= 2
    return maps, emitted


def entry_states(read: np.ndarray) -> np.ndarray:
    """The state before each chunk (a row of classes), by a prefix scan over the chunks' state maps."""
    maps = np.broadcast_to(np.arange(11, dtype=np.uint8), (len(read), 11)).copy()
    for k in range(read.shape[1]):
        maps = STEP[maps, read[:, k][:, None]]
    maps, _ = scan(maps)
    return np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)


def emitted_before(each: np.ndarray) -> np.ndarray:
    """The tokens emitted before each pre-token, and after the last, by a prefix scan over chunks of pre-tokens."""
    rows = -(-len(each) // CHUNK)
    padded = np.zeros(rows * CHUNK, np.int64)
    padded[: len(each)] = each
    padded = padded.reshape(rows, CHUNK)
    _, emitted = scan(np.zeros((rows, 1), np.uint8), padded.sum(axis=1, keepdims=True))
    within = np.cumsum(padded, axis=1)
    upto = within + np.concatenate([[[0]], emitted[:-1]])
    return np.concatenate([[0], upto.ravel()[: len(each)]])


def pretoken_starts(kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token begins, for a sequence of classes whose texts each end with END."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    read = np.full(rows * CHUNK, END, np.uint8)
    read[:n] = kinds
    read = read.reshape(rows, CHUNK)
    state = entry_states(read)
    marks = np.zeros((rows, CHUNK), np.uint8)
    for k in range(CHUNK):
        c = read[:, k]
        marks[:, k] = MARK[state, c]
        state = STEP[state, c]
    flat = marks.ravel()[:n]
    starts = (flat & HERE) > 0
    starts[:-1] |= (flat[1:] & BEFORE) > 0
    return starts


#: Bytes of a pre-token whose count is remembered, at most.
LONGEST = 256


class Transducer:
    """Counts the tokens of pre-tokens (bytes) of a vocabulary file."""

    def __init__(self, path: str, most_states: int = 150_000, most_known: int = 500_000):
        if vocabulary_kind(Tokenizer.from_file(path)) != "bytes":
            raise ValueError(f"{path}: not a byte-level BPE with its usual pre-tokenizer and no normalizer")
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        name = lambda s: bytes(byte_of[c] for c in s)
        added = {t["content"] for t in spec["added_tokens"]}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {name(s) for s in spec["model"]["vocab"] if s not in added}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[name(a), name(b)] = rank
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.most_states, self.most_known = most_states, most_known
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: the longest suffix that begins a token, and (last token, count against the present) at each of its places
        self.ids = {(b"", ((b"", 0),)): 0}
        self.states = [(b"", ((b"", 0),))]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` by rank gives just these two tokens."""
        key = (a, b)
        if key not in self.follows:
            if len(self.follows) > self.most_known:
                self.follows = {}
            parts = [bytes([x]) for x in a + b]
            ranks, none = self.ranks, 1 << 60
            while len(parts) > 1:
                rank, i = min((ranks.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
                if rank == none:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.follows[key] = parts == ([a, b] if a else [b])
        return self.follows[key]

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.states[state]
        read = suffix + bytes([byte])
        for i in range(len(read)):  # the one token that ends the text here and may stand there
            token = read[i:]
            if token in self.tokens and self._may_follow(places[i][0], token):
                break
        change = places[i][1] + 1
        places = (*((t, n - change) for t, n in places), (token, 0))
        cut = 0
        while cut < len(read) and read[cut:] not in self.prefixes:
            cut += 1
        to = self._state((read[cut:], places[cut:]))
        self.next[state][byte] = to, change
        return to, change

    def _state(self, key: tuple) -> int:
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return to

    def count(self, piece: bytes) -> int:
        state = total = 0
        edges = self.next
        for byte in piece:
            edge = edges[state].get(byte)
            if edge is None:
                if len(self.states) >= self.most_states:  # go on from the present state, whatever of the piece is read
                    now = self.states[state]
                    self._clear()
                    state, edges = self._state(now), self.next
                edge = self._transition(state, byte)
            state, change = edge
            total += change
        return total

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        owner, parts, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = [text]
            for special in self.special:
                if special in text:
                    found = [x for part in found for x in part.split(special)]
                    total[i] = len(found) - 1
            owner += [i] * len(found)
            parts += found
        if not parts:
            return total
        joined = "\0".join(parts) + "\0"  # what follows each part ends it, whatever NULs the part itself has
        raw = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        kinds = classes()[points]
        kinds[ends] = END
        starts = np.flatnonzero(pretoken_starts(kinds))
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each code point begins
        offsets = np.append(at[starts], len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > self.most_known:
            self.known = {}
        known, counted = self.known, np.zeros(len(names), np.int64)
        for i, name in enumerate(names):
            if (n := known.get(name)) is None:
                n = self.count(name)
                if len(name) <= LONGEST:
                    known[name] = n
            counted[i] = n
        each = counted[coded.indices.to_numpy(zero_copy_only=False)]
        part = np.searchsorted(ends, starts)
        each[starts == ends[part]] = 0  # the ends themselves
        before = emitted_before(each)
        last = np.searchsorted(part, np.arange(len(parts)), side="right")
        np.add.at(total, np.array(owner, np.int64), np.diff(before[last], prepend=0))
        return total


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer for a vocabulary file, kept from task to task."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document's whole text."""

    def count(batches):
        machine = transducer(vocabulary)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            n = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
