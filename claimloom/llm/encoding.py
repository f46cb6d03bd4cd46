"""Token ids by the tokenizers library, with each distinct white-space chunk encoded once per worker.

A text is cut before single spaces. A cut between a non-space and a space is always a cut of the pre-tokenizer too, so a
chunk's ids don't depend on what surrounds it; where a run of white space spans chunks the cut is made at the run's start,
and a text that has a special token's string is encoded whole. A new chunk of Latin letters and closing punctuation goes
straight to the library's model as its two pre-tokens; any other new chunk goes through the library's whole pipeline.

All of that holds for the two kinds of vocabulary in ``vocabulary_kind``. Texts of any other go to the library as they are.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: White space of any kind.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = f"{_SPACE} {_SPACE}|{_SPACE} \\z"
_PIECES = re.compile(r"\s*\S+|\s+\Z")
#: A word of precomposed Latin letters (U+0130, which lower-cases to two characters, aside) and its closing punctuation.
_WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?|%*&$#]*)")


#: Words that an encoder remembers where little else takes a worker's memory.
WORDS = 500_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


# fixed values: the components of the two kinds of vocabulary whose chunks stand alone
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORDS = (
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
)
_LOWER = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})


def _plain(component: dict | None) -> dict:
    """A component without what matters to offsets only."""
    return {k: v for k, v in (component or {}).items() if k != "trim_offsets"}


def vocabulary_kind(tokenizer: Tokenizer) -> str | None:
    """``bytes`` or ``words`` of a vocabulary whose white-space chunks can be encoded one by one, else None."""
    spec = lambda part: None if part is None else json.loads(part.__getstate__())
    model, before, normal = tokenizer.model, _plain(spec(tokenizer.pre_tokenizer)), spec(tokenizer.normalizer)
    if not isinstance(model, BPE) or model.dropout or model.continuing_subword_prefix or model.byte_fallback or model.ignore_merges:
        return None
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    if before == _BYTES and normal is None and not model.end_of_word_suffix:
        return "bytes"
    if before.get("type") == "Sequence" and tuple(map(_plain, before["pretokenizers"])) == _WORDS and normal and tuple(normal.get("normalizers", ())) == _LOWER:
        return "words"
    return None


class ChunkEncoder:
    """Encodes texts to little-endian ids; ``limit`` bounds the words that it remembers, a quarter of it the chunks."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.kind = vocabulary_kind(self.tokenizer)
        self.drops_space = self.lowers = self.kind == "words"
        self.letters = dict(enumerate(byte_alphabet()))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line_end = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _token(self, piece: str) -> bytes:
        """Ids of one pre-token by the library's model."""
        if self.lowers:
            piece = piece.lower()
        if piece.isascii():
            piece = piece.replace(" ", self.letters[32])
        else:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _word(self, chunk: str) -> bytes | None:
        """Ids of a word with closing punctuation, None of anything else."""
        if not (found := _WORD.fullmatch(chunk)):
            return None
        space, word, tail = found.groups()
        if space and not self.drops_space:
            word = space + word
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = self._token(word)
        if tail:
            more = self.words.get(tail)
            if more is None:
                more = self.words[tail] = self._token(tail)
            ids += more
        return ids

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of literal chunks."""
        odd, known, words, skip = [], self.known, self.words, self.drops_space
        for chunk in chunks:
            ids = words.get(chunk[1:] if skip and chunk[:1] == " " else chunk)
            if ids is not None:  # a word met before, by itself
                known[chunk] = ids
                continue
            # a line end between two words is a pre-token of its own
            ids = [self._word(part) for part in chunk.split("\n")]
            if None in ids:
                odd.append(chunk)
            else:
                known[chunk] = self.line_end.join(ids)
        self.known.update(zip(odd, self._whole(odd)))

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if missing := [c for c in dict.fromkeys(chunks) if c not in self.known]:
            self._learn(missing)
        return list(map(self.known.__getitem__, chunks))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        texts, alone, code, bounds, ids, sizes = self._chunks(texts)
        table = np.frombuffer(b"".join(ids), self.dtype)
        starts = np.cumsum(sizes) - sizes
        n = sizes[code]
        ends = np.cumsum(n)
        flat = table[np.repeat(starts[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[bounds].tolist()
        out = [flat[a:b] for a, b in zip(edges, edges[1:])]
        for i, found in alone:
            out[i] = np.frombuffer(found, self.dtype)
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text (null: 0), without making them."""
        _, alone, code, bounds, _, sizes = self._chunks(texts)
        n = np.diff(np.concatenate([[0], np.cumsum(sizes[code])])[bounds])
        for i, found in alone:
            n[i] = len(found) // self.dtype.itemsize
        return n

    def _chunks(self, texts: pa.Array):
        """Texts cut into chunks: each chunk's code, where each text's chunks begin, and ids and their number by code.

        ``alone`` has place and ids of texts that aren't cut at single spaces.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.kind is None:
            alone = enumerate(self._whole(texts.to_pylist()))
            return texts, list(alone), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), [], np.zeros(0, np.int64)
        if len(self.known) > self.limit // 4:
            self.known = {}
        if len(self.words) > self.limit:
            self.words = {}
        held = pc.match_substring_regex(texts, "|".join(re.escape(x) for x in self.special)) if self.special else pc.is_null(texts)
        runs = pc.and_not(pc.match_substring_regex(texts, _RUNS), held)
        split = pc.split_pattern(pc.if_else(pc.or_(held, runs), "", texts), " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        first = bounds[:-1]  # the first chunk of a text has no space before it
        heads, place = np.unique(code[first], return_inverse=True)
        inner = np.ones(len(code), bool)
        inner[first] = False
        seen = np.zeros(len(names), bool)
        seen[code[inner]] = True
        bodies = np.flatnonzero(seen)
        code[inner], code[first] = (np.cumsum(seen) - 1)[code[inner]], len(bodies) + place
        ids = self._ids([" " + names[k] for k in bodies.tolist()] + [names[k] for k in heads.tolist()])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        alone = [(i, b"".join(self._ids(_PIECES.findall(texts[i].as_py())))) for i in np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist()]
        alone += [(i, self._whole([texts[i].as_py()])[0]) for i in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist()]
        return texts, alone, code, bounds, ids, sizes


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, limit: int = 1_000_000) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    _encoders[path].limit = limit
    return _encoders[path]
