"""Token ids by the tokenizers library, with words that occur again taken from a bounded cache.

In the tokenizer file that is used here, white space always ends a pre-token, and so does a place between an ASCII
letter and an ASCII sign other than the apostrophe, or between an ASCII digit and any other ASCII sign; case makes no
difference. So a text's ids are those of its lower-cased words, cut at such places, in turn. Each worker encodes a piece
once and keeps its ids while the cache has room. Texts that spell out a special token are cut at white space alone, with
their case. All this is used only for files that say these rules; with any other file whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from operator import attrgetter

import numpy as np

from vitrine.llm.words import LOWER, Words, chunks, find_words, ragged, whole_texts

#: Words in a worker's cache, and their bytes; beyond that, only words stay that were met again since the last time.
CACHE_WORDS, CACHE_BYTES = 200_000, 8 << 20
END_ID = 2
#: What a tokenizer file says whose ids go by words, as its JSON.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Pieces that normalisation and pre-tokenisation leave as they are: lower-case letters of ASCII and Latin-1, in UTF-8.
PLAIN = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++").fullmatch
ID = attrgetter("id")
#: New pieces that are encoded at once.
BATCH = 20_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _alphabet() -> list[str]:
    """The character that byte-level tokenizer files write for each byte: itself if it prints, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


ByteLevelAlphabet = _alphabet()


class WordEncoder:
    """Ids of words, and of texts through their words."""

    def __init__(self, path: str, room: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = [t for t in spec["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
        #: Whether texts may be cut into words; else each is encoded as a whole.
        self.by_words = not added and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(spec[k] == v for k, v in RULES.items())
        self.room = room if self.by_words else 0
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        # Byte-level files write each byte as one character, none of them white space.
        self.as_byte = {b: ByteLevelAlphabet[b] for b in range(256)} | {32: " "}
        self._clear()

    def _clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.again = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)

    def _shrink(self, room: int) -> None:
        """Keep the words met again, if they leave half of the room and of the bytes."""
        keep = np.flatnonzero(self.again[: len(self.row)])
        words = list(self.row)
        words = [words[k] for k in keep.tolist()]
        length = self.length[keep]
        ids = self.flat[ragged(self.start[keep], length.astype(np.int64))]
        self._clear()
        if 2 * len(words) <= room and 2 * sum(map(len, words)) <= CACHE_BYTES:
            self._put(words, ids, length)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has; no text may hold white space at its ends."""
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        at = np.fromiter((s for s, _ in got.offsets), np.int64, len(ids))
        return ids, np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(texts))

    def _add(self, missing: list[bytes]) -> None:
        if not self.by_words:
            lists = [self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in missing]
            self._put(missing, np.fromiter((x for own in lists for x in own), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))
            return
        plain = [w for w in missing if PLAIN(w)]
        if plain:
            lists = list(map(self.merge, b" ".join(plain).decode("latin-1").translate(self.as_byte).split(" ")))
            length = np.fromiter(map(len, lists), np.int64, len(lists))
            self._put(plain, np.fromiter(map(ID, chain.from_iterable(lists)), np.uint32, int(length.sum())), length)
        if len(plain) < len(missing):
            rest = [w for w in missing if not PLAIN(w)]
            self._put(rest, *self._ids([w.decode("utf-8", "replace") for w in rest]))

    def _put(self, missing: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        n = len(self.row)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(missing) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + len(missing)] = length
        self.start[n : n + len(missing)] = self.used + np.concatenate([[0], np.cumsum(length)[:-1]])
        self.used += len(ids)
        self.held += sum(map(len, missing))
        self.row.update(zip(missing, range(n, n + len(missing)), strict=True))

    def rows(self, vocab: list[bytes]) -> np.ndarray:
        """Rows of start and length for distinct words."""
        if len(self.row) + len(vocab) > max(self.room, len(vocab)) or self.held > CACHE_BYTES:
            self._shrink(max(0, self.room - len(vocab)))
        get, held = self.row.get, len(self.row)
        missing = [w for w in vocab if w not in self.row]
        for k in range(0, len(missing), BATCH):
            self._add(missing[k : k + BATCH])
        rows = np.fromiter(map(get, vocab), np.int64, len(vocab))
        self.again[rows[rows < held]] = True
        return rows

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """The pieces of each text whose ids, one after the other, are the text's ids."""
        if not self.by_words:
            return whole_texts(data, offsets)
        low = LOWER[data]
        raw = low.tobytes()
        if any(s.lower() in raw for s in self.special):
            return find_words(data, offsets)
        return find_words(low, offsets, pieces=True)

    def lengths(self, words: Words) -> np.ndarray:
        """Number of ids of each piece."""
        row = self.rows(words.vocab.to_pylist())
        return self.length[row][words.codes].astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID):
        """Yields (first row, ids, offsets of ids) for chunk after chunk of texts; end_id: put after each text."""
        extra = int(end_id is not None)
        for a, b in chunks(offsets):
            own = offsets[a : b + 1]
            words = self.pieces(data[own[0] : own[-1]], own - own[0])
            row = self.rows(words.vocab.to_pylist())[words.codes]
            length = self.length[row].astype(np.int64)
            per_doc = np.bincount(words.doc, weights=length, minlength=b - a).astype(np.int64) + extra
            bounds = np.concatenate([[0], np.cumsum(per_doc)])
            ids = np.empty(int(bounds[-1]), np.uint32)
            body = np.ones(len(ids), bool)
            if extra:
                ids[bounds[1:] - 1] = end_id
                body[bounds[1:] - 1] = False
            ids[body] = self.flat[ragged(self.start[row], length)]
            yield a, ids, bounds


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
