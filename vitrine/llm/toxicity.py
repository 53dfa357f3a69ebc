"""Toxicity by a bidirectional gated recurrent network with attention pooling over all overlapping windows.

A word enters as evidence gathered from the training rows: smoothed log ratios of how many toxic and clean documents
hold the word, its beginnings and its character 4-grams (each by a hash into a table), next to small embeddings of
word and beginning that are learned. Windows of 64 words, half overlapping, run through the network in both
directions; attention pools the states of a window, and a document's score is a logistic function of its highest and
its mean window. All of it is fitted in numpy on a bounded sample of labelled rows that are not held out; the evidence
for a training document leaves its own fold out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.labels import held_out, sample
from vitrine.llm.words import Words, chunks, find_words, mix64, ragged, release, text_buffers

WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 8, 2
BUCKETS = 1 << 18
EMBED_BUCKETS = 1 << 12
#: Vocabulary entries that are hashed at a time in fitting.
SLICE = 1 << 14
FOLDS = 4
EPOCHS, BATCH, RATE = 8, 64, 0.02
#: How firmly the weights of a document's highest and mean window are held near the network's own logit.
FINAL_RIDGE = 5.0
FEATURES = 5 + 2 * EMBED
_U = np.uint64
#: Letters and digits count, and all bytes above ASCII; what else stands at a word's ends is cut off.
_BODY = np.zeros(256, bool)
_BODY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Vocabulary:
    """Hashes of the entries of a vocabulary: the word, its beginnings of 4 and 5 bytes, its 4-grams with bounds."""

    word: np.ndarray
    begin: np.ndarray
    longer: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray


def vocabulary(vocab: pa.Array) -> Vocabulary:
    data, offsets = text_buffers(vocab)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    body = _BODY[data]
    inner = np.flatnonzero(body)
    low = np.full(n, 0, np.int64)
    high = np.full(n, 0, np.int64)
    if len(inner):  # from the first to the last byte that counts
        rows, first = np.unique(owner[inner], return_index=True)
        low[rows] = inner[first]
        high[rows] = np.append(inner[first[1:] - 1], inner[-1]) + 1
    length = high - low
    # Each word as its bytes with a mark in front and behind.
    bounds = np.concatenate([[0], np.cumsum(length + 2)])
    text = np.full(int(bounds[-1]), 1, np.uint8)
    inside = np.ones(len(text), bool)
    inside[bounds[:-1]] = False
    inside[bounds[1:] - 1] = False
    text[inside] = data[ragged(low, length)]
    wide = text.astype(_U)
    four = np.zeros(len(text), _U)
    for k in range(4):
        four[: len(text) - k] += wide[k:] << _U(8 * (3 - k))
    grams = np.maximum(length + 2 - 3, 1)
    at = ragged(bounds[:-1], grams)
    start = bounds[:-1]
    five = np.where(length + 2 >= 5, wide[np.minimum(start + 4, max(len(text) - 1, 0))] if len(text) else 0, _U(0)).astype(_U) if n else np.zeros(0, _U)
    six = np.where(length + 2 >= 6, wide[np.minimum(start + 5, max(len(text) - 1, 0))] if len(text) else 0, _U(0)).astype(_U) if n else np.zeros(0, _U)
    head = four[start] if n else np.zeros(0, _U)
    power = mix64(np.arange(len(text), dtype=_U) - np.repeat(start, length + 2).astype(_U) + _U(77)) | _U(1)
    word = np.add.reduceat(mix64(wide + _U(513)) * power, start) if n else np.zeros(0, _U)
    begin = head * _U(256) + five
    return Vocabulary(mix64(word), mix64(begin + (_U(1) << _U(60))), mix64(begin * _U(256) + six + (_U(1) << _U(61))), mix64(four[at] + (_U(1) << _U(59))), np.concatenate([[0], np.cumsum(grams)]))


def sliced_vocabulary(vocab: pa.Array, entries: int = SLICE) -> Vocabulary:
    """The same for many entries, a slice at a time."""
    parts = [vocabulary(vocab.slice(k, entries)) for k in range(0, max(len(vocab), 1), entries)]
    shift = np.cumsum([0, *(len(p.grams) for p in parts)])
    bounds = np.concatenate([[0], *(p.bounds[1:] + s for p, s in zip(parts, shift, strict=False))]).astype(np.int64)
    return Vocabulary(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("word", "begin", "longer", "grams")), bounds)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(40)).astype(np.int64) % BUCKETS


class Evidence:
    """How many toxic and clean training documents hold each hashed feature, by fold."""

    def __init__(self) -> None:
        self.count = np.zeros((FOLDS, 2, BUCKETS), np.float32)
        self.docs = np.zeros((FOLDS, 2), np.float32)

    def add(self, fold: int, mark: int, hashes: np.ndarray) -> None:
        self.count[fold, mark, np.unique(_slot(hashes))] += 1
        self.docs[fold, mark] += 1

    def ratios(self, left_out: int | None = None) -> np.ndarray:
        use = [f for f in range(FOLDS) if f != left_out]
        count, docs = self.count[use].sum(axis=0), self.docs[use].sum(axis=0) + 1
        ease = 1.0 / docs.min()
        return np.clip(np.log((count[1] / docs[1] + ease) / (count[0] / docs[0] + ease)), -4, 4).astype(np.float32)


def features(v: Vocabulary, ratio: np.ndarray) -> np.ndarray:
    """What a vocabulary entry brings along besides its embeddings."""
    out = np.zeros((len(v.word), 5), np.float32)
    if len(v.word):
        grams = ratio[_slot(v.grams)]
        n = np.diff(v.bounds)
        out[:, 0], out[:, 1], out[:, 2] = ratio[_slot(v.word)], ratio[_slot(v.begin)], ratio[_slot(v.longer)]
        out[:, 3] = np.add.reduceat(grams, v.bounds[:-1]) / n
        out[:, 4] = np.maximum.reduceat(grams, v.bounds[:-1])
    return out / 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters: w: input to the three gates, u: state to gates, b: bias, of both directions; attention and output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {f"w{d}": r.normal(0, 0.3, (FEATURES, 3 * h)) for d in "fb"}
        self.p |= {f"u{d}": r.normal(0, 0.3, (h, 3 * h)) for d in "fb"}
        self.p |= {f"b{d}": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]) for d in "fb"}
        self.p |= {"a": r.normal(0, 0.3, 2 * h), "o": r.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        self.p |= {"ew": r.normal(0, 0.05, (EMBED_BUCKETS, EMBED)), "eb": r.normal(0, 0.05, (EMBED_BUCKETS, EMBED))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.final = np.array([1.0, 0.0, 0.0])

    def inputs(self, v: Vocabulary, ratio: np.ndarray) -> np.ndarray:
        own = [features(v, ratio), self.p["ew"][(v.word >> _U(20)).astype(np.int64) % EMBED_BUCKETS], self.p["eb"][(v.begin >> _U(20)).astype(np.int64) % EMBED_BUCKETS]]
        return np.concatenate(own, axis=1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    def _run(self, gate: np.ndarray, there: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (words, windows, h) of one direction; gate: (words, windows, 3h); there: (words, windows)."""
        h = HIDDEN
        steps, n = there.shape
        state = np.zeros((n, h), np.float32)
        out = np.empty((steps, n, h), np.float32)
        u2, u1 = self.p[f"u{d}"][:, : 2 * h], self.p[f"u{d}"][:, 2 * h :]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gate[t]
            zr = state @ u2
            zr += g[:, : 2 * h]
            np.multiply(zr, -1, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :h], zr[:, h:]
            c = (r * state) @ u1
            c += g[:, 2 * h :]
            np.tanh(c, out=c)
            new = state + z * (c - state)
            new *= there[t][:, None]
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = new
            out[t] = state
        return out

    def logits(self, gf: np.ndarray, gb: np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Of windows; place: (words, windows) rows of the gate tables; there: 1.0 for words, 0.0 for padding."""
        forward = self._run(gf[place], there, "f")
        backward = self._run(gb[place], there, "b")
        h = HIDDEN
        weight = forward @ self.p["a"][:h] + backward @ self.p["a"][h:]
        value = forward @ self.p["o"][:h] + backward @ self.p["o"][h:]
        weight = np.exp(np.clip(weight, -30, 30)) * there
        return (weight * value).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-9) + self.p["c"][0]

    def gradient(self, x: np.ndarray, there: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the mean log loss, of the parameters and of the inputs x (words, windows, features)."""
        h, (steps, n) = HIDDEN, there.shape
        kept = {"f": [], "b": []}
        states = {d: self._run(x @ self.p[f"w{d}"] + self.p[f"b{d}"], there, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        weight = np.exp(np.clip(both @ self.p["a"], -30, 30)) * there
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        err = (_sigmoid(logit) - target) / n
        grad = {"o": err @ pooled, "c": np.array([err.sum()])}
        d_pooled = err[:, None] * self.p["o"]
        d_weight = (both * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["a"] = np.einsum("tn,tnh->h", d_score, both)
        d_both = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["a"]
        d_x = np.zeros_like(x)
        for d, d_states in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            u = self.p[f"u{d}"]
            d_u, d_state = np.zeros_like(u), np.zeros((n, h), np.float32)
            d_gate = np.zeros((steps, n, 3 * h), np.float32)
            for t, before, z, r, c in reversed(kept[d]):
                d_new = (d_state + d_states[t]) * there[t][:, None]
                d_c = d_new * z * (1 - c * c)
                d_z = d_new * (c - before) * z * (1 - z)
                d_rs = d_c @ u[:, 2 * h :].T
                d_r = d_rs * before * r * (1 - r)
                d_gate[t] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_u[:, : 2 * h] += before.T @ d_gate[t][:, : 2 * h]
                d_u[:, 2 * h :] += (r * before).T @ d_c
                d_state = d_new * (1 - z) + d_rs * r + d_gate[t][:, : 2 * h] @ u[:, : 2 * h].T
            grad[f"u{d}"] = d_u
            grad[f"w{d}"] = np.einsum("tnf,tng->fg", x, d_gate)
            grad[f"b{d}"] = d_gate.sum(axis=(0, 1))
            d_x += d_gate @ self.p[f"w{d}"].T
        return grad, d_x, logit


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts with these numbers of words: (text, first word within the text, words)."""
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(count)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, first, np.minimum(count[text] - first, WINDOW)


def _places(first: np.ndarray, length: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of windows, and which are there, as (words, windows)."""
    steps = np.arange(int(length.max()) if len(length) else 0)[:, None]
    return np.minimum(first[None] + steps, max(last, 0)), (steps < length[None]).astype(np.float32)


@dataclass
class Model:
    network: Network
    ratio: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of every text, from 0 to 1; an empty text's is that of no evidence."""
        out = np.empty(len(offsets) - 1)
        for a, b in chunks(offsets):
            words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
            out[a:b] = self._document_scores(words, self.network.gates(self.network.inputs(vocabulary(words.vocab), self.ratio)))
        return out

    def window_logits(self, words: Words, gates: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, first, length = windows(words.per_doc)
        begin = words.bounds()[text] + first
        logit = np.empty(len(text), np.float32)
        order = np.argsort(length, kind="stable")  # like lengths together: little padding
        gf, gb = (g.astype(np.float32, copy=False) for g in gates)
        for k in range(0, len(order), 2048):
            own = order[k : k + 2048]
            place, there = _places(begin[own], length[own], len(words.codes) - 1)
            logit[own] = self.network.logits(gf, gb, words.codes[place], there)
        return text, begin, logit

    def pooled(self, words: Words, gates) -> np.ndarray:
        """(highest, mean) window logit of each text; 0 without words."""
        text, _, logit = self.window_logits(words, gates)
        n = len(words.offsets) - 1
        out = np.zeros((n, 2))
        if len(text):
            rows, at = np.unique(text, return_index=True)
            out[rows, 0] = np.maximum.reduceat(logit, at)
            out[rows, 1] = np.add.reduceat(logit.astype(np.float64), at) / np.diff(np.append(at, len(text)))
        return out

    def _document_scores(self, words: Words, gates) -> np.ndarray:
        x, (p, q, c) = self.pooled(words, gates), self.network.final
        return _sigmoid(p * x[:, 0] + q * x[:, 1] + c)


def _combined(pooled: np.ndarray, marks: np.ndarray, ridge: float = FINAL_RIDGE) -> np.ndarray:
    """Weights of highest and mean window and a constant, held near (1, 0, 0): the network's own logit."""
    x = np.column_stack([pooled, np.ones(len(pooled))])
    own = np.array([1.0, 0.0, 0.0])
    w = own.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(3)
        w -= np.linalg.solve(hessian, x.T @ (p - marks) + ridge * (w - own))
    return w


def fit(rows: list[tuple[int, str, int]], share: float | None = None, seed: int = 7) -> Model:
    """Fit on (doc_id, text, label); share: of ones among all labels, where the rows hold another share of them.

    With one class only, or no rows, every text gets that class's share as score."""
    marks = np.array([m for _, _, m in rows], np.int64)
    network, evidence = Network(seed), Evidence()
    if len(rows) < 8 or marks.min() == marks.max():
        share = np.clip(marks.mean() if len(marks) else 0.0, 0.01, 0.99)
        network.final = np.array([0.0, 0.0, np.log(share / (1 - share))])
        return Model(network, evidence.ratios())
    fold = np.array([d * 2654435761 % 4294967296 >> 20 for d, _, _ in rows]) % FOLDS
    texts = pa.array([t for _, t, _ in rows], pa.large_string())
    words = find_words(*text_buffers(texts), lower=True)
    v = sliced_vocabulary(words.vocab)
    bounds = words.bounds()
    for k in range(len(rows)):
        own = np.unique(words.codes[bounds[k] : bounds[k + 1]])
        if len(own):
            grams = v.grams[ragged(v.bounds[own], v.bounds[own + 1] - v.bounds[own])]
            evidence.add(int(fold[k]), int(marks[k]), np.concatenate([v.word[own], v.begin[own], v.longer[own], grams]))
    # Evidence of each fold from the others; row (fold, entry) of the input table.
    per_fold = np.stack([features(v, evidence.ratios(f)) for f in range(FOLDS)])
    entry_w, entry_b = ((x >> _U(20)).astype(np.int64) % EMBED_BUCKETS for x in (v.word, v.begin))
    text, first, length = windows(words.per_doc)
    begin = bounds[text] + first
    word_fold = fold[words.doc]
    hint = per_fold[:, :, [0, 2, 4]].clip(0).sum(axis=2)[word_fold, words.codes]
    running = np.concatenate([[0], np.cumsum(hint)])
    value = running[begin + length] - running[begin]
    del hint, running, word_fold
    r = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in network.p.items()}
    model, step = Model(network, evidence.ratios()), 0
    for epoch in range(EPOCHS):
        if epoch >= 2:  # at first the window with the most evidence stands for a document, then the network's own
            value = np.empty(len(text))
            for f in range(FOLDS):
                own = np.flatnonzero(fold[text] == f)
                gates = [g.astype(np.float32, copy=False) for g in network.gates(np.concatenate([per_fold[f], network.p["ew"][entry_w], network.p["eb"][entry_b]], axis=1))]
                for k in range(0, len(own), 2048):
                    at = own[k : k + 2048]
                    place, there = _places(begin[at], length[at], len(words.codes) - 1)
                    value[at] = network.logits(gates[0], gates[1], words.codes[place], there)
        order = np.lexsort((value, text))
        best = order[np.append(text[order][1:] != text[order][:-1], True)] if len(order) else order
        r.shuffle(best)
        for k in range(0, len(best), BATCH):
            own = best[k : k + BATCH]
            place, there = _places(begin[own], length[own], len(words.codes) - 1)
            code, f = words.codes[place], fold[text[own]]
            x = np.concatenate([per_fold[f[None], code], network.p["ew"][entry_w[code]], network.p["eb"][entry_b[code]]], axis=2).astype(np.float32)
            x *= there[:, :, None]
            target = marks[text[own]] * 0.96 + 0.02
            grad, d_x, _ = network.gradient(x, there, target)
            for name, ids, at in (("ew", entry_w, 5), ("eb", entry_b, 5 + EMBED)):
                grad[name] = np.zeros_like(network.p[name])
                np.add.at(grad[name], ids[code], d_x[:, :, at : at + EMBED] * there[:, :, None])
            step += 1
            for name, p in network.p.items():
                g, (m1, m2) = grad[name], moment[name]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= (RATE * (1 - epoch / EPOCHS) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # How highest and mean window make a document's score: logistic regression on each document's own fold's evidence.
    pooled = np.zeros((len(rows), 2))
    for f in range(FOLDS):
        gates = network.gates(np.concatenate([per_fold[f], network.p["ew"][entry_w], network.p["eb"][entry_b]], axis=1))
        own = fold == f
        pooled[own] = model.pooled(words, gates)[own]
    w = _combined(pooled, marks)
    if share is not None and 0 < share < 1:  # back from the sample's share of toxic documents to that of all labels
        w[2] += np.log(share / (1 - share)) - np.log(marks.mean() / (1 - marks.mean()))
    network.final = w
    del words, v, per_fold, evidence
    release()
    return model


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Only the text is scored. A null or empty text gets the score of no evidence, a long one is scored in all its
    windows, a chunk of its own, at a cost that grows with its words; a score that ties with the threshold counts as toxic;
    rows may repeat; a null doc_id is not held out. Without labels of both classes every score is the share of
    toxic labels. Other columns are left alone; an empty table gives an empty result.
    """
    model = fit(*sample(docs, labels, "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value.scores(*text_buffers(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SCORES)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with all their columns; null and other values as they are."""
    model = fit(*sample(docs, labels, "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.scores(*text_buffers(batch.column("text"))) < threshold))

    return docs.mapInArrow(work, docs.schema)
