"""Token counts that follow edits: a segment tree of pre-token runs for each document.

A leaf is a run of pre-tokens with its bytes and its number of ids; inner nodes hold sums of both. An edit replaces
bytes begin .. end of the current text. The tree finds the leaves it touches; these, widened by the neighbouring leaf
until both their edges are places where a pre-token ends for sure, are encoded anew, and the sums above them are
updated. All other leaves keep their counts. Sure places are white space, and places between an ASCII digit and
another ASCII sign or letter, or between an ASCII letter and an ASCII sign other than the apostrophe, unless a special
token is spelt across them.

A long run of letters is one pre-token; it is cut into leaves between its tokens. A row of tokens is what merging gives for
their text if it is what merging gives for every two neighbours (the text of both comes out as these two). So within
a run, where the letters on both sides of an edge leave no doubt that it lies in one, an edge holds if the two tokens
beside it do; else the neighbouring leaf is taken in as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import WordEncoder, default_path, encoder
from vitrine.llm.words import KIND, LOWER, MEETS, SPACE, chunks, text_buffers

LEAF_WORDS = 32
#: A run of letters of more bytes than this is cut into leaves of about so many.
LEAF_BYTES = 1024
#: The sign of byte 255, which no text holds, so that no merge takes it in.
NEVER = "\u00ff"
_SPACES = b" \t\n\v\f\r"

COUNTS = "doc_id long, n_edits int, n_tokens_before long, n_tokens_after long, n_bytes_after long, reencoded_bytes long"


class Runs:
    """Tokens of text that may end within a run of letters, by a tokenizer whose ids go by words."""

    def __init__(self, own: WordEncoder):
        self.normalize, self.split = own.tokenizer.normalizer.normalize_str, own.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = own.tokenizer.model.tokenize
        self.suffix = own.tokenizer.model.end_of_word_suffix or ""

    @staticmethod
    def within(before: bytes, after: bytes) -> bool:
        """Whether an edge lies within a run of letters for sure: no contraction ends there, and nothing composes across."""
        return len(before) >= 3 and before[-3:].isalpha() and before[-3:].isascii() and after[:1].isalpha() and after[:1].isascii()

    def ends(self, body: bytes, open_end: bool) -> tuple[int, str, str]:
        """Number of tokens of a body, and its first and last; open_end: it ends within a run."""
        pieces = [p for p, _ in self.split(self.normalize(body.decode("utf-8", "replace")))]
        if not pieces:
            return 0, "", ""
        tokens = [t.value for p in pieces[:-1] for t in self.merge(p)]
        tokens += self._open(pieces[-1]) if open_end else [t.value for t in self.merge(pieces[-1])]
        return len(tokens), tokens[0], tokens[-1]

    def _open(self, piece: str) -> list[str]:
        """Tokens of a piece that goes on: a sign that nothing merges with takes its end."""
        return [t.value for t in self.merge(piece + NEVER)][:-1]

    def fit(self, one: str, two: str) -> bool:
        """Whether the text of two tokens, the first within a run, comes out as these two."""
        if self.suffix and two.endswith(self.suffix):
            return [t.value for t in self.merge(one + two.removesuffix(self.suffix))] == [one, two]
        return self._open(one + two) == [one, two]


class TokenTree:
    """Bytes and ids of a text by leaves. count: gives the number of ids of bytes that begin and end where pre-tokens do;
    special: tokens that are found in a text before anything else; runs: what tells tokens within runs of letters (None: runs
    are never cut)."""

    def __init__(self, leaves: list[bytes], tokens: list[int], count: Callable[[bytes], int], special: Sequence[bytes] = (), runs: Runs | None = None):
        self.count, self.encoded, self.runs = count, 0, runs
        self.special = [t.lower() for t in special]
        self.reach = max(3, *map(len, special)) if special else 3
        self._build(leaves, tokens)

    def _sure(self, before: bytes, after: bytes) -> bool:
        """Whether a pre-token ends for sure between these bytes: the last `reach` before, the first `reach` after."""
        one, two = LOWER[before[-1]], LOWER[after[0]]
        if SPACE[one] or SPACE[two]:
            return True
        if not MEETS[KIND[one] * KIND[two]]:
            return False
        return not any(t in (before[1 - len(t) :] + after[: len(t) - 1]).lower() for t in self.special)

    def _bytes(self, begin: int, end: int) -> bytes:
        """A few bytes of the text."""
        out, begin = [], max(begin, 0)
        while begin < min(end, self.n_bytes):
            leaf, at = self.find(begin)
            out.append(self.leaves[leaf][begin - at : end - at])
            begin += len(out[-1])
        return b"".join(out)

    def _build(self, leaves: list[bytes], tokens: list[int]) -> None:
        self.leaves = leaves or [b""]
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.bytes = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.bytes[self.size : self.size + len(self.leaves)] = map(len, self.leaves)
        self.tokens[self.size : self.size + len(self.leaves)] = tokens or [0]
        for i in range(self.size - 1, 0, -1):
            self.bytes[i] = self.bytes[2 * i] + self.bytes[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_bytes(self) -> int:
        return self.bytes[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds byte `at`, and that leaf's first byte; the last leaf for the end of the text."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.bytes[node] and self.bytes[node + 1]:
                begin += self.bytes[node]
                node += 1
        return node - self.size, begin

    def _set(self, leaf: int, body: bytes, tokens: int) -> None:
        node = leaf + self.size
        more, up = len(body) - self.bytes[node], tokens - self.tokens[node]
        self.leaves[leaf] = body
        while node:
            self.bytes[node] += more
            self.tokens[node] += up
            node //= 2

    def edit(self, begin: int, end: int, put: bytes) -> None:
        """Replace bytes begin .. end of the current text by `put`."""
        begin = min(max(begin, 0), self.n_bytes)
        end = min(max(end, begin), self.n_bytes)
        first, low = self.find(begin)
        last, at = self.find(max(begin, end - 1)) if end > begin else (first, low)
        high = at + len(self.leaves[last])
        body = self.leaves[first][: begin - low] + put + self.leaves[last][end - at :]
        # Boundary context: leaves on either side are taken in until both edges hold, and joined once.
        reach, left, right = self.reach, [], [body]
        head, tail, step = body[:reach], body[-reach:], 1
        while True:
            while low > 0 and not self._holds_left(low, head):
                first, low = self.find(low - 1)
                left.append(self.leaves[first])
                head, tail = (left[-1] + head)[:reach], (left[-1] + tail)[-reach:] if len(tail) < reach else tail
            while high < self.n_bytes and not self._holds(tail, self._bytes(high, high + reach)):
                last, at = self.find(high)
                right.append(self.leaves[last])
                high = at + len(right[-1])
                tail = (tail + right[-1])[-reach:]
            if low > 0 and not self._holds_left(low, head):
                continue
            before, after = self._bytes(low - reach, low), self._bytes(high, high + reach)
            open_left, open_right = bool(head) and self._open(before, head), bool(tail) and self._open(tail, after)
            body = b"".join([*reversed(left), *right])
            self.encoded += len(body)
            if not (open_left or open_right):
                tokens = self.count(body)
                break
            tokens, one, two = self.runs.ends(body, open_right)
            # Where tokens do not fit, twice as many leaves each time, so that little is encoded more than a few times.
            if open_left and not self.runs.fit(self._last_token(low), one):
                for _ in range(step):
                    if low > 0:
                        first, low = self.find(low - 1)
                        left.append(self.leaves[first])
                        head = (left[-1] + head)[:reach]
            elif open_right and not self.runs.fit(two, self._first_token(high)):
                for _ in range(step):
                    if high < self.n_bytes:
                        last, at = self.find(high)
                        right.append(self.leaves[last])
                        high = at + len(right[-1])
                        tail = (tail + right[-1])[-reach:]
            else:
                break
            step *= 2
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, b"", 0)
        self._set(first, body, tokens)

    def _open(self, before: bytes, after: bytes) -> bool:
        return self.runs is not None and bool(after) and self.runs.within(before, after)

    def _holds(self, before: bytes, after: bytes) -> bool:
        """Whether a leaf may begin between these bytes: a pre-token ends, or both are within a run of letters."""
        return bool(before and after) and (self._sure(before, after) or self._open(before, after))

    def _holds_left(self, low: int, head: bytes) -> bool:
        """Whether the text before `low` may stay as it is encoded: a pre-token ends there, as it did, or a run goes on, as it did."""
        if not head:
            return False
        before, was = self._bytes(low - self.reach, low), self._bytes(low, low + self.reach)
        return self._holds(before, head) and self._open(before, head) == self._open(before, was)

    def _last_token(self, at: int) -> str:
        """The last token of the leaf that ends at `at`, within a run."""
        leaf, _ = self.find(at - 1)
        self.encoded += len(self.leaves[leaf])
        return self.runs.ends(self.leaves[leaf], True)[2]

    def _first_token(self, at: int) -> str:
        leaf, begin = self.find(at)
        body = self.leaves[leaf]
        self.encoded += len(body)
        end = begin + len(body)
        return self.runs.ends(body, end < self.n_bytes and self._open(body[-self.reach :], self._bytes(end, end + self.reach)))[1]

    def text(self) -> bytes:
        return b"".join(self.leaves)


def trees(data: np.ndarray, offsets: np.ndarray, path: str) -> Iterator[tuple[int, TokenTree]]:
    """A tree for each text, with the ids of all words counted together."""
    own = encoder(path)

    def count(body: bytes) -> int:
        return len(own.tokenizer.encode(body.decode("utf-8", "replace"), add_special_tokens=False).ids) if body.strip(_SPACES) else 0

    runs = Runs(own) if own.by_words else None
    for a, b in chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        words = own.pieces(part, at)
        length = own.lengths(words)
        ids = np.concatenate([[0], np.cumsum(length)])
        bounds = words.bounds()
        raw = part.tobytes()
        long = np.flatnonzero(words.end - words.start > LEAF_BYTES) if runs else np.zeros(0, np.int64)
        for k in range(b - a):
            edge = np.append(np.arange(bounds[k], bounds[k + 1], LEAF_WORDS), bounds[k + 1])
            cut = [int(at[k]), *words.start[edge[1:-1]].tolist(), int(at[k + 1])]
            done = ids[edge].tolist()
            done = done if len(done) == len(cut) else [done[0], done[0]]
            more = [x for w in long[np.searchsorted(long, bounds[k]) : np.searchsorted(long, bounds[k + 1])] for x in _within_run(raw[words.start[w] : words.end[w]], int(words.start[w]), int(ids[w]), runs)]
            if more:
                cut, done = (list(x) for x in zip(*sorted({*zip(cut, done, strict=True), *more}), strict=True))
            yield a + k, TokenTree([raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], np.diff(done).tolist(), count, own.special, runs)


def _within_run(piece: bytes, begin: int, ids: int, runs: Runs) -> list[tuple[int, int]]:
    """Places between tokens of a long run of ASCII letters, each with the number of ids before it."""
    if not (piece.isascii() and piece.isalpha()):
        return []
    out, at, last = [], 0, 0
    for n, token in enumerate(t.value for t in runs.merge(piece.decode().lower())):
        if at - last >= LEAF_BYTES:
            out.append((begin + at, ids + n))
            last = at
        at += len(token)
    return out


def count_after_edits(edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """edits: doc_id, text, edits array<struct<begin long, end long, put string>>, in bytes of the text as the edits
    before have left it. Returns the counts before and after and how many bytes were encoded anew.

    A null text is empty, null edits are none; places beyond the text mean its end, a begin or end amid a character
    moves down to its first byte. Rows may repeat; other columns are left alone; an empty table gives an empty result.
    """
    path = tokenizer or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            todo = batch.column("edits").to_pylist()
            rows = []
            for k, tree in trees(*text_buffers(batch.column("text")), path):
                before = tree.n_tokens
                for e in todo[k] or ():
                    tree.edit(_edge(tree, e["begin"] or 0), _edge(tree, e["end"] or 0), (e["put"] or "").encode())
                rows.append((len(todo[k] or ()), before, tree.n_tokens, tree.n_bytes, tree.encoded))
            columns = [np.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns[1:])],
                names=["doc_id", "n_edits", "n_tokens_before", "n_tokens_after", "n_bytes_after", "reencoded_bytes"],
            )

    return edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits").mapInArrow(work, COUNTS)


def _edge(tree: TokenTree, at: int) -> int:
    """The first byte of the character that byte `at` is of."""
    at = min(max(at, 0), tree.n_bytes)
    while 0 < at < tree.n_bytes:
        leaf, begin = tree.find(at)
        if tree.leaves[leaf][at - begin] & 0xC0 != 0x80:
            break
        at -= 1
    return at


def revised(docs: DataFrame) -> DataFrame:
    """Three edits of every document, at places that its size gives: a word goes in, a stretch goes out, and one word
    is joined to the text at its end."""
    n = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    at = F.pmod(F.xxhash64("doc_id"), n + 1)
    edit = lambda begin, end, put: F.struct(begin.alias("begin"), end.alias("end"), F.lit(put).alias("put"))
    third = F.floor(n / 3).cast("long")
    edits = F.array(edit(at, at, " inserted words "), edit(third, third + 24, ""), edit(n * 2, n * 2, "ending"))
    return docs.select("doc_id", "text", edits.alias("edits"))
