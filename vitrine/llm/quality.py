"""Quality rules: a linear-chain conditional random field marks each line of a text as content or boilerplate.

Base rules first: a text with under 50 words, or with more than half of its words in repeated 3-word windows, fails.
For the others Viterbi decoding finds the best sequence of line labels, and the share of words in content lines
decides whether the document stays. Weights are fitted in numpy (forward-backward, Adam) on the lines of a bounded
sample of labelled documents. Lines have targets of their own: boilerplate lines that a generator plants in every
second good document are boilerplate, and the labels of all other lines are settled by turns of decoding and fitting,
in which a good document must keep at least the share of content that is asked for and a poor one must stay below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.labels import sample
from vitrine.llm.words import Words, chunks, find_words, release, text_buffers

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document stays if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
CONTENT, BOILERPLATE = 1, 0
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
#: Turns of decoding and fitting that settle the lines' labels, and steps of each fit but the first.
TURNS, TURN_STEPS = 3, 60
PLANT_SEED = 5
#: Words that speak for page furniture, in the ways they are written.
FURNITURE = (
    "home menu login logout register subscribe newsletter sitemap contact faq copyright rights reserved license licensed "
    "cookie cookies privacy terms conditions policy share tweet facebook twitter instagram linkedin rss print advertisement "
    "sponsored click download previous next archive archives"
).split()
_FURNITURE = pa.array([f"{a}{v}{z}".encode() for w in FURNITURE for v in (w, w.capitalize(), w.upper()) for a in ("", "(", "|") for z in ("", ".", ",", ":", "!", "|", ")")], pa.large_binary())

_SYMBOL, _DIGIT, _UPPER, _PIPE, _LINK, _REST = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(SYMBOLS)] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_PIPE[124] = True
_LINK[list(b"/@_=")] = True
_REST[128:192] = True  # bytes of a character after its first
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')")] = True


def repeated_words(words: Words) -> np.ndarray:
    """Which words are in a 3-word window that its text holds twice or more."""
    n, size = len(words.codes), len(words.vocab)
    hit = np.zeros(n, bool)
    if n < 3:
        return hit
    at = np.flatnonzero(words.doc[2:] == words.doc[:-2])
    pair = (words.doc[at] * size + words.codes[at]) * size + words.codes[at + 1]
    pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, place, count = np.unique(pair * size + words.codes[at + 2], return_inverse=True, return_counts=True)
    twice = at[count[place] > 1]
    for k in range(3):
        hit[twice + k] = True
    return hit


@dataclass
class Lines:
    """The lines of some texts. doc: the text of each line; n_words: words in it; dup: with a word, equal to an earlier line."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_words: np.ndarray
    dup: np.ndarray
    features: np.ndarray


def _count(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[end] - total[start]


def find_lines(words: Words, repeated: np.ndarray) -> Lines:
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = offsets[doc + 1].copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    line = np.searchsorted(start, words.start, "right") - 1
    n_words = np.bincount(line, minlength=len(doc))
    body = np.ascontiguousarray(data[data != 10])
    where = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(where), pa.py_buffer(body)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(len(doc), bool)
    first[np.unique(doc * (len(coded.dictionary) + 1) + code, return_index=True)[1]] = True
    dup = ~first & (n_words > 0)
    size = np.maximum(end - start, 1)
    share = lambda table: _count(table[data], start, end) / size
    some = n_words > 0
    last_byte = np.zeros(len(doc), np.uint8)
    first_byte = np.zeros(len(doc), np.uint8)
    if len(words.start):
        rows, at = np.unique(line, return_index=True)
        first_byte[rows] = data[words.start[at]]
        last_byte[rows] = data[words.end[np.append(at[1:], len(line)) - 1] - 1]
    per = np.maximum(n_words, 1)
    furniture = pc.is_in(words.vocab, value_set=_FURNITURE).to_numpy(zero_copy_only=False)
    columns = [
        np.ones(len(doc)),
        ~some,
        np.minimum(n_words, 40) / 40,
        some & (n_words < 4),
        np.minimum(share(_SYMBOL) * 10, 2),
        np.minimum(share(_PIPE) * 20, 2),
        np.minimum(share(_DIGIT) * 5, 2),
        np.minimum(share(_UPPER) * 5, 2),
        np.minimum(share(_LINK) * 10, 2),
        dup,
        np.bincount(line, weights=repeated, minlength=len(doc)) / per,
        _STOP[last_byte],
        _UPPER[first_byte] | (first_byte >= 128),
        np.minimum(np.bincount(line, weights=words.end - words.start, minlength=len(doc)) / per / 10, 2),
        np.minimum(np.bincount(line, weights=furniture[words.codes], minlength=len(doc)) / per * 4, 2),
    ]
    return Lines(doc, start, end, n_words, dup, np.column_stack(columns).astype(np.float64))


class Chains:
    """Lines of texts as chains: which text has a line at each step."""

    def __init__(self, doc: np.ndarray, n: int):
        count = np.bincount(doc, minlength=n)
        self.first = np.cumsum(count) - count
        self.by_length = np.argsort(-count, kind="stable")
        self.ordered = count[self.by_length]
        self.longest = int(self.ordered[0]) if n else 0

    def at(self, step: int) -> np.ndarray:
        """The texts that have a line at this step."""
        return self.by_length[: np.searchsorted(-self.ordered, -step, "left")]


class Field:
    """weights: (features, 2) for the labels; change: (2, 2) from label to label."""

    def __init__(self, weights: np.ndarray, change: np.ndarray):
        self.weights, self.change = weights, change

    def decode(self, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """The best label of every line: Viterbi, all texts side by side."""
        score = x @ self.weights
        chains = Chains(doc, n)
        back = np.zeros((len(doc), 2), np.int8)
        best = np.zeros((n, 2))
        for t in range(chains.longest):
            own = chains.at(t)
            line = chains.first[own] + t
            if t == 0:
                best[own] = score[line]
                continue
            come = best[own][:, :, None] + self.change[None]
            back[line] = come.argmax(axis=1)
            best[own] = come.max(axis=1) + score[line]
        label = np.zeros(len(doc), np.int8)
        now = best.argmax(axis=1).astype(np.int8)
        for t in range(chains.longest - 1, -1, -1):
            own = chains.at(t)
            line = chains.first[own] + t
            label[line] = now[own]
            now[own] = back[line, now[own]]
        return label

    def gradient(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed counts, for each line: forward-backward with scaled messages."""
        score = x @ self.weights
        emit = np.exp(score - score.max(axis=1, keepdims=True))
        change = np.exp(self.change)
        ahead, behind = np.empty_like(emit), np.ones_like(emit)
        for t in range(chains.longest):
            line = chains.first[chains.at(t)] + t
            a = emit[line] if t == 0 else (ahead[line - 1] @ change) * emit[line]
            ahead[line] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(chains.longest - 1, 0, -1):
            line = chains.first[chains.at(t)] + t
            tail = emit[line] * behind[line]
            both = ahead[line - 1][:, :, None] * change[None] * tail[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = tail @ change.T
            behind[line - 1] = b / b.sum(axis=1, keepdims=True)
        p = ahead * behind
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        follow = np.flatnonzero(doc[1:] == doc[:-1])
        np.subtract.at(pairs, (label[follow], label[follow + 1]), 1)
        return x.T @ p / len(doc), pairs / len(doc)


def furniture_lines(r: np.random.Generator) -> list[str]:
    """A made-up run of boilerplate lines: menus, link lists, notices of rights and cookies, rows of signs, tables of numbers."""
    pick = lambda *x: x[r.integers(len(x))]
    name = lambda: "".join(pick("an", "ber", "co", "del", "fo", "gra", "lin", "mo", "ta", "vis") for _ in range(r.integers(1, 4)))
    word = lambda: pick(*FURNITURE) if r.random() < 0.6 else name()
    shown = lambda w: pick(w, w.capitalize(), w.upper())
    kind = r.integers(7)
    if kind == 0:
        return [pick(" | ", " / ", " > ", " \u00b7 ").join(shown(word()) for _ in range(r.integers(3, 10)))]
    if kind == 1:
        return [shown(word()) + pick("", "", " " + name()) for _ in range(r.integers(3, 9))]
    if kind == 2:
        return [f"Copyright {r.integers(1995, 2031)} {name().capitalize()}. All rights reserved."] + ["Terms and conditions | Privacy policy"] * int(r.integers(2))
    if kind == 3:
        return [pick("We use cookies. Read our cookie policy.", "Subscribe to our newsletter!", "Click here to download.", "Share on Facebook Twitter LinkedIn", "Advertisement", "Sponsored")]
    if kind == 4:
        return [f"{pick('http://www.', 'https://')}{name()}.com/{name()}/{name()}_{r.integers(999)}" for _ in range(r.integers(2, 6))]
    if kind == 5:
        return [" ".join(pick("***", "###", "$$$", "%%%", "&&&", "<>", "||", name() + pick("***", "###", "%%%")) for _ in range(r.integers(4, 30))) for _ in range(r.integers(1, 4))]
    return [pick(" | ", " ", " / ").join(str(r.integers(1 << r.integers(4, 20))) for _ in range(r.integers(3, 12))) for _ in range(r.integers(2, 7))]


def planted(text: str, r: np.random.Generator) -> tuple[str, list[bool]]:
    """The text with runs of boilerplate lines at its begin, within it or at its end; which lines are planted."""
    lines = [(x, False) for x in text.split("\n")]
    words = sum(len(x.split()) for x, _ in lines)
    for _ in range(r.integers(1, 4)):
        run = [(x, True) for x in furniture_lines(r)]
        if sum(len(x.split()) for x, p in lines + run if p) > words // 3:
            continue
        at = int((0, len(lines), r.integers(len(lines) + 1))[r.integers(3)])
        lines[at:at] = run
    return "\n".join(x for x, _ in lines), [p for _, p in lines]


def _descend(field: Field, x: np.ndarray, doc: np.ndarray, label: np.ndarray, chains: Chains, steps: int, linked: bool) -> None:
    """Adam on the field's weights, in place; linked: also on what goes from line to line."""
    moments = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros((2, 2)), np.zeros((2, 2))]
    observed = np.eye(2)[label]
    for step in range(1, steps + 1):
        if linked:
            grads = field.gradient(x, doc, label, chains)
        else:
            score = x @ field.weights
            p = np.exp(score - score.max(axis=1, keepdims=True))
            grads = (x.T @ (p / p.sum(axis=1, keepdims=True) - observed) / len(doc),)
        for k, g in enumerate(grads):
            p, m1, m2 = (field.weights, field.change)[k], moments[2 * k], moments[2 * k + 1]
            g = g + RIDGE * p
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)


def _settled(label: np.ndarray, margin: np.ndarray, lines: Lines, mark: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Line labels under the documents' labels: planted lines are boilerplate; then, line by line from the least sure,
    a good document gets content lines until they hold enough of its own words, a poor one loses them until they do not."""
    out = np.where(fixed, BOILERPLATE, label).astype(np.int64)
    own = np.where(fixed, 0, lines.n_words)
    total = np.bincount(lines.doc, weights=own, minlength=len(mark))
    content = np.bincount(lines.doc, weights=own * (out == CONTENT), minlength=len(mark))
    enough = content >= CONTENT_SHARE * total
    for d in np.flatnonzero((enough != (mark == 1)) & (total > 0)):
        at = np.flatnonzero((lines.doc == d) & ~fixed & (out != mark[d]))
        at = at[np.argsort(margin[at] * (1 if mark[d] == 0 else -1), kind="stable")]
        for k in at:
            if (content[d] >= CONTENT_SHARE * total[d]) == (mark[d] == 1):
                break
            out[k] = mark[d]
            content[d] += own[k] if mark[d] == 1 else -own[k]
    # A text of blank lines alone says nothing about lines; they go with their document.
    return np.where(~fixed & (total[lines.doc] == 0), mark[lines.doc], out)


def _sample_lines(texts: list[str]) -> Lines:
    """The lines of all texts, found in chunks of them: no more than a chunk's words are held at a time."""
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    parts = []
    for a, b in chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        words = find_words(data[offsets[a] : offsets[b]], at)
        own = find_lines(words, repeated_words(words))
        parts.append((own.doc + a, own.start + offsets[a], own.end + offsets[a], own.n_words, own.dup, own.features))
    return Lines(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def fit(rows: list[tuple[int, str, int]]) -> Field:
    """Fit on (doc_id, text, label). With one class only, or no rows, every line is content."""
    marks = np.array([m for _, _, m in rows], np.int64)
    width = find_lines(find_words(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, bool)).features.shape[1]
    field = Field(np.zeros((width, 2)), np.zeros((2, 2)))
    if len(rows) < 8 or marks.min() == marks.max():
        field.weights[0, CONTENT] = 1.0
        return field
    r = np.random.default_rng(PLANT_SEED)
    texts, flags = [], []
    for k, (_, text, mark) in enumerate(rows):
        own = planted(text, r) if mark == 1 and k % 2 else (text, [False] * (text.count("\n") + 1))
        texts.append(own[0])
        flags += own[1]
    lines = _sample_lines(texts)
    fixed, x, chains = np.array(flags, bool), lines.features, Chains(lines.doc, len(rows))
    label = np.where(fixed, BOILERPLATE, marks[lines.doc])
    _descend(field, x, lines.doc, label, chains, STEPS, False)
    for turn in range(TURNS):
        margin = x @ (field.weights[:, CONTENT] - field.weights[:, BOILERPLATE])
        label = _settled(field.decode(x, lines.doc, len(rows)), margin, lines, marks, fixed)
        _descend(field, x, lines.doc, label, chains, STEPS if turn == 0 else TURN_STEPS, True)
    del lines, x
    release()
    return field


def measure(data: np.ndarray, offsets: np.ndarray, field: Field) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first row, columns) for chunks of texts."""
    for a, b in chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words = find_words(part, at)
        n = b - a
        repeated = repeated_words(words)
        lines = find_lines(words, repeated)
        points = np.concatenate([[0], np.cumsum(~_REST[part], dtype=np.int64)])
        n_words = words.per_doc
        n_repeat = np.bincount(words.doc, weights=repeated, minlength=n).astype(np.int64)
        label = field.decode(lines.features, lines.doc, n)
        content = np.bincount(lines.doc, weights=lines.n_words * (label == CONTENT), minlength=n)
        share = content / np.maximum(n_words, 1)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
        yield a, {
            "n_words": n_words,
            "word_chars": np.bincount(words.doc, weights=points[words.end] - points[words.start], minlength=n).astype(np.int64),
            "n_symbols": _count(_SYMBOL[part], at[:-1], at[1:]),
            "n_dup_lines": np.bincount(lines.doc, weights=lines.dup, minlength=n).astype(np.int64),
            "n_repeat_words": n_repeat,
            "base_failed": failed,
            "kept": ~failed & (share >= CONTENT_SHARE),
            "content_share": share,
            "n_lines": np.bincount(lines.doc, minlength=n),
        }


MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, content_share double, n_lines long"
)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures, base_failed and kept of every document, from its whole text.

    A null or empty text has no words and fails; a long one is decoded whole; rows may repeat, other columns are left
    alone, an empty table gives an empty result. Without labels of both classes every line counts as content. Equal
    scores go to boilerplate.
    """
    field = fit(sample(docs, labels, "quality")[0])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id = batch.column("doc_id")
            for a, columns in measure(*text_buffers(batch.column("text")), shared.value):
                n = len(columns["n_words"])
                yield pa.RecordBatch.from_arrays([doc_id.slice(a, n), *(pa.array(c) for c in columns.values())], names=["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, MEASURES)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; null and other values as they are."""
    field = fit(sample(docs, labels, "quality")[0])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [columns["kept"] for _, columns in measure(*text_buffers(batch.column("text")), shared.value)]
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(work, docs.schema)


def judge_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line (from 0), begin and end (bytes of the text) and content of every line of every text.

    A null or empty text has one empty line; rows may repeat; other columns are left alone; an empty table gives an empty
    result. Without labels of both classes every line is content.
    """
    field = fit(sample(docs, labels, "quality")[0])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id = batch.column("doc_id")
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                at = offsets[a : b + 1] - offsets[a]
                words = find_words(data[offsets[a] : offsets[b]], at)
                lines = find_lines(words, repeated_words(words))
                label = shared.value.decode(lines.features, lines.doc, b - a)
                number = np.arange(len(lines.doc)) - np.searchsorted(lines.doc, lines.doc)
                columns = [doc_id.take(pa.array(a + lines.doc)), number.astype(np.int32), lines.start - at[lines.doc], lines.end - at[lines.doc], label == CONTENT]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["doc_id", "line", "begin", "end", "content"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, line int, begin long, end long, content boolean")
