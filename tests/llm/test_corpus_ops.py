"""Quality, toxicity, search, extraction, mixing and the Jaccard join, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import html_main, jaccard, labels, mixing, quality, topk, toxicity, trees
from vitrine.llm.components import components
from vitrine.llm.words import find_words, text_buffers

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 6))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.05 else "") for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "x") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- Quality

ODD = [None, "", " \n ", "a", "a b c a b c", "x\nx\n\nx y\n", "#*$%&|<>", "é ñ x\x0by", "w " * 30000, "l\n" * 3000]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_measures_and_verdicts(spark):
    junk = lambda: " ".join(w + R.choice(["***", "$$$", "%%%"]) for w in prose(80).split())
    rows = [(k, prose(90) if k % 3 else junk(), "s") for k in range(90)] + [(100 + k, t, "s") for k, t in enumerate(ODD)] + [(None, prose(60), "s")]
    known = marks(spark, [(k, int(k % 3 > 0), 0) for k in range(60)] + [(61, None, None)])
    out = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows), known).collect()}
    for d, t, _ in rows:
        r = out[d]
        n = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert all(out[k].kept == (k % 3 > 0) for k in range(60, 90))
    kept = quality.good_documents(frame(spark, rows), known)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out.values() if r.kept)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    field = quality.Field(r.normal(size=(3, 2)), r.normal(size=(2, 2)))
    doc = np.repeat(np.arange(4), [1, 5, 3, 0 + 1])
    x = r.normal(size=(len(doc), 3))
    got = field.decode(x, doc, 5)
    for d in range(4):
        own = np.flatnonzero(doc == d)
        score = x[own] @ field.weights
        paths = [[(k >> i) & 1 for i in range(len(own))] for k in range(1 << len(own))]
        value = lambda p, s=score: sum(s[i, y] for i, y in enumerate(p)) + sum(field.change[a, b] for a, b in zip(p, p[1:], strict=False))
        assert math.isclose(value(got[own].tolist()), max(map(value, paths)))


def test_field_gradient():
    r = np.random.default_rng(4)
    doc, label, x = np.array([0, 0, 0, 1]), np.array([1, 0, 1, 0]), r.normal(size=(4, 2))
    w, c = r.normal(size=(2, 2)), r.normal(size=(2, 2))

    def loss(w, c):
        total = 0.0
        for own in ([0, 1, 2], [3]):
            s = x[own] @ w
            value = lambda p, s=s: sum(s[i, y] for i, y in enumerate(p)) + sum(c[a, b] for a, b in zip(p, p[1:], strict=False))
            paths = [[(k >> i) & 1 for i in range(len(own))] for k in range(1 << len(own))]
            total += math.log(sum(math.exp(value(p)) for p in paths)) - value(label[own].tolist())
        return total / 4

    gw, gc = quality.Field(w, c).gradient(x, doc, label, quality.Chains(doc, 2))
    for g, p, at in ((gw, w, 0), (gc, c, 1)):
        for i in np.ndindex(p.shape):
            q = p.copy()
            q[i] += 1e-6
            assert abs((loss(*((q, c) if at == 0 else (w, q))) - loss(w, c)) / 1e-6 - g[i]) < 1e-4


def test_lines_are_labelled(spark):
    """Good texts keep their prose and lose the boilerplate that is planted in them; both labels stand in one text."""
    r = random.Random(21)
    line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(8, 25))).capitalize() + "."
    junk = lambda: " ".join(r.choice(WORDS) + r.choice(["***", "$$$", "%%%"]) for _ in range(30))
    good = lambda: "\n".join(line() for _ in range(r.randint(5, 9)))
    poor = lambda: "\n".join([line(), *(junk() for _ in range(4)), line()])
    rows = [(k, good() if k % 3 else poor(), "s") for k in range(150)]
    menu, rights = ["Home | About | Contact | Log in | Privacy policy", "Subscribe to our newsletter!"], ["Copyright 2024 Some Site. All rights reserved.", "Terms and conditions | Cookie policy"]
    mixed = []
    for k in range(20):
        prose_lines = [line() for _ in range(8)]
        mixed.append((1000 + k, menu + prose_lines + rights))
    known = marks(spark, [(k, int(k % 3 > 0), 0) for k in range(150)])
    docs = frame(spark, rows + [(d, "\n".join(x), "s") for d, x in mixed])
    out = defaultdict(dict)
    for x in quality.judge_lines(docs, known).collect():
        out[x.doc_id][x.line] = (x.content, x.begin, x.end)
    right = wrong = 0
    for d, lines in mixed:
        assert [lines[k].encode() for k in range(len(lines))] == ["\n".join(lines).encode()[out[d][k][1] : out[d][k][2]] for k in range(len(lines))]
        for k in range(len(lines)):
            ok = out[d][k][0] == (2 <= k < 10)
            right, wrong = right + ok, wrong + (not ok)
    assert right / (right + wrong) > 0.95
    share = {x.doc_id: (x.content_share, x.kept) for x in quality.judge_documents(docs, known).collect()}
    assert all(0.5 < share[d][0] < 1 and share[d][1] for d, _ in mixed)
    poor_lines = [out[d][k][0] for d in range(0, 150, 3) for k in (1, 2, 3, 4)]
    assert np.mean(poor_lines) < 0.05
    assert quality.judge_lines(docs.limit(0), known).count() == 0
    assert [tuple(x) for x in quality.judge_lines(frame(spark, [(1, None, "s"), (None, "a", "s")]), known.limit(0)).collect()] in ([(1, 0, 0, 0, True), (None, 0, 0, 1, True)], [(None, 0, 0, 1, True), (1, 0, 0, 0, True)])


def test_quality_without_labels(spark):
    out = quality.judge_documents(frame(spark, [(1, prose(60), "s")]), marks(spark, [])).collect()
    assert [r.kept for r in out] == [True]
    assert quality.judge_documents(frame(spark, []), marks(spark, [])).count() == 0


# ---- Toxicity


def test_network_gradient():
    r = np.random.default_rng(1)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, there = r.normal(size=(5, 3, toxicity.FEATURES)), (np.arange(5)[:, None] < np.array([5, 2, 4])[None]).astype(np.float64)
    x *= there[:, :, None]
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        gf, gb = (x @ net.p[f"w{d}"] + net.p[f"b{d}"] for d in "fb")
        flat = lambda g: g.reshape(-1, g.shape[2])
        place = np.arange(15).reshape(5, 3)
        z = net.logits(flat(gf), flat(gb), place, there)
        return float(np.mean(np.log1p(np.exp(-z)) * target + np.log1p(np.exp(z)) * (1 - target)))

    grad, _, _ = net.gradient(x, there, target)
    for name in ("wf", "ub", "a", "o", "bf", "c", "uf"):
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in net.p[name].shape)
            old = net.p[name][i]
            net.p[name][i] = old + 1e-3
            up = loss()
            net.p[name][i] = old - 1e-3
            down = loss()
            net.p[name][i] = old
            assert abs((up - down) / 2e-3 - grad[name][i]) < 2e-3, name


def test_scores_equal_a_plain_network():
    """A word at a time and a window at a time, over whole texts, from the same parameters."""
    r = random.Random(3)
    texts = [prose(n, r) for n in (1, 5, 63, 64, 65, 130, 400)] + ["", None, "x" * 300, "!!! ??"]
    rows = [(k, prose(r.randint(5, 120), r) + (" vile scum" if k % 2 else ""), k % 2) for k in range(60)]
    model = toxicity.fit(rows)
    got = model.scores(*text_buffers(pa.array(texts, pa.string())))
    p, h = {k: v.astype(np.float64) for k, v in model.network.p.items()}, toxicity.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))

    def states(xs, d):
        w, u, b, s, out = p[f"w{d}"], p[f"u{d}"], p[f"b{d}"], np.zeros(h), []
        for x in xs if d == "f" else xs[::-1]:
            g = x @ w + b
            z, reset = sig(g[:h] + s @ u[:, :h]), sig(g[h : 2 * h] + s @ u[:, h : 2 * h])
            s = (1 - z) * s + z * np.tanh(g[2 * h :] + (reset * s) @ u[:, 2 * h :])
            out.append(s)
        return out if d == "f" else out[::-1]

    for text, score in zip(texts, got, strict=True):
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
        logits = []
        for a in [0] if 0 < len(words) <= 64 else range(0, len(words) - 32, 32) if words else []:
            v = toxicity.vocabulary(pa.array(words[a : a + 64], pa.large_binary()))
            xs = model.network.inputs(v, model.ratio).astype(np.float64)
            both = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs, "b"), strict=True)]
            weight = np.exp([x @ p["a"] for x in both])
            logits.append(float(sum(w * x for w, x in zip(weight, both, strict=True)) / weight.sum() @ p["o"] + p["c"][0]))
        top, mean = (max(logits), np.mean(logits)) if logits else (0.0, 0.0)
        assert abs(sig(model.network.final @ [top, mean, 1.0]) - score) < 1e-4


def test_windows_cover_all_words():
    count = np.array([0, 1, 63, 64, 65, 96, 97, 500])
    text, first, length = toxicity.windows(count)
    for d, n in enumerate(count):
        own = text == d
        seen = {w for f, k in zip(first[own], length[own], strict=True) for w in range(f, f + k)}
        assert seen == set(range(n)) and (length[own] > 0).all()


def test_toxic_documents_are_found_held_out(spark):
    bad = ["vile", "scumbag", "trashy"]
    rows = []
    for k in range(700):
        words = prose(R.choice([20, 150, 400])).split(" ")
        if k % 4 == 0:
            for _ in range(3):
                words.insert(R.randrange(len(words)), R.choice(bad))
        rows.append((k, " ".join(words), "s"))
    odd = [(1000, None, "s"), (1001, "", "s"), (1002, "w " * 20000 + "vile scumbag trashy vile", "s"), (None, "x", "s")]
    known = marks(spark, [(k, 1, int(k % 4 == 0)) for k in range(700)])
    out = {r.doc_id: r for r in toxicity.score_documents(frame(spark, rows + odd), known).collect()}
    assert len(out) == len(rows + odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [k for k in range(700) if out[k].held_out]
    assert 100 < len(held) < 180
    assert np.mean([out[k].predicted == (k % 4 == 0) for k in held]) > 0.95
    assert out[1000].score == out[1001].score and out[1002].predicted == 1 and not out[None].held_out
    clean = toxicity.clean_documents(frame(spark, rows + odd), known)
    assert clean.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, r in out.items() if not r.predicted)


def test_toxicity_without_labels(spark):
    assert {r.predicted for r in toxicity.score_documents(frame(spark, [(1, "a", "s"), (1, "a", "s")]), marks(spark, [])).collect()} == {0}
    assert toxicity.score_documents(frame(spark, []), marks(spark, [])).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    rows = [(k, "t" * (k + 1), "s") for k in range(300)]
    got, share = labels.sample(frame(spark, rows), marks(spark, [(k, 1, k % 2) for k in range(300)]), "toxic", rows=20, most=2000)
    assert all(0 < sum(len(t) for _, t, m in got if m == k) <= 2000 and sum(m == k for *_, m in got) <= 20 for k in (0, 1)) and 0.4 < share < 0.6
    assert all(zlib.crc32(str(d).encode()) % 5 for d, _, _ in got)


# ---- Exact top-k


def test_top_k_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=20) / 4]) for i in range(400)]
    rows += [(500, [0.1] * 20), (501, [0.1] * 20), (502, [0.1] * 20), (600, None), (700, [float("nan")] * 20), (800, [None] * 20), (900, [1.0, 2.0]), (1000, [1.0, 1.0]), (None, [0.0] * 20), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    got = defaultdict(list)
    for x in sorted(topk.top_k_embeddings(df).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in good if i % 100 == 0]:
        twice = [i for i, _ in rows if i == 0 and q != 0][1:]
        s = sorted((-int(good[q] @ good[i]), i) for i in (*good, *twice) if i != q and len(good[i]) == len(good[q]))[:10]
        if s:
            want[q] = [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert dict(got) == want


def test_branch_and_bound_drops_candidates():
    r = np.random.default_rng(0)
    v = (r.normal(size=(5000, 64)) * np.linspace(2, 0.1, 64) * 1024).astype(np.int64)
    c = topk.Columns(np.arange(5000), v)
    ids, score = c.top(v[7], 7, 10)
    full = v @ v[7]
    full[7] = -(10**15)
    assert score.tolist() == sorted(full.tolist(), reverse=True)[:10] and (full[ids] == score).all()
    # A bound from elsewhere drops what cannot reach it, and nothing that ties with it.
    same, own = c.top(v[7], 7, 10, int(score[-1]))
    assert same.tolist() == ids.tolist() and own.tolist() == score.tolist()
    few, own = c.top(v[7], 7, 10, int(score[3]))
    assert own[:4].tolist() == score[:4].tolist() and few[:4].tolist() == ids[:4].tolist()


def test_top_k_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 50)
    monkeypatch.setattr(topk, "CELL_QUERIES", 3)
    r = np.random.default_rng(9)
    rows = [(k, [float(x) for x in r.integers(-3, 4, 12) / 4]) for k in range(700)] + [(k, [0.25] * 12) for k in range(2000, 2100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in sorted(topk.top_k_embeddings(df).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    want = {q: [(i, -s) for s, i in sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:10]] for q in good if q % 100 == 0}
    assert dict(got) == want


# ---- Main text


def test_extraction_of_made_up_pages():
    r = np.random.default_rng(4242)
    forest, same, n = html_main.model(), 0, 0
    for _ in range(120):
        source, known = html_main.training_page(r)
        page = html_main.Page(source)
        assert len(page.tag) == len(known) + 1
        same += page.text(page.decode(forest.logit(page.features()))) == page.text(np.array([True, *known]))
        n += 1
    assert same / n > 0.85


def test_extraction_contract(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav><div class='ad'>Buy now.</div>"
        "<article><h1>Heading &lt;1&gt;</h1><p><b>Opening  words\n of the text, with more of it.<br><p>Second &eacute; paragraph, <a href='/x'>linked</a>. It goes on, and on.</p>"
        "<p>Third paragraph of the article, which says a lot. It says more.</p></article><!-- gone --><footer>&copy; site &middot; footer text.</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<"), (5, "u", page[:420])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_main.extract_pages(df).collect()}
    assert out[1].text == "Heading <1>\nOpening words of the text, with more of it.\nSecond é paragraph, linked. It goes on, and on.\nThird paragraph of the article, which says a lot. It says more."
    assert out[1].n_chars == len(out[1].text) and out[2].text == out[3].text == "" and out[2].n_chars == 0
    assert html_main.extract_pages(df.limit(0)).count() == 0


def test_malformed_pages_take_linear_time():
    import time

    n = 1 << 20
    pages = ["<a " * (n // 3) + '"', "<div>" * (n // 10) + "</section>" * (n // 20), "<i><div>" + "<b>" * (n // 7) + "</i>" * (n // 8), "<div>" * (n // 10) + "<li></li>" * (n // 18)]
    pages += ["<p " + '="' * (n // 2), "<p " + "='\"" * (n // 3), "<" * n, "<!--" * (n // 4), "<script>" * (n // 8), "<p class" + " " * n + ">", "<p><b>" * (n // 6)]
    for page in pages:
        start = time.process_time()
        html_main.Page(page)
        assert time.process_time() - start < 6, page[:20]


def test_features_equal_plain_counts():
    """Subtree size, depth, text and links of every element, counted by walking up from each."""
    r = np.random.default_rng(12)
    for _ in range(30):
        page = html_main.Page(html_main.training_page(r)[0])
        rows = page.features()
        up = lambda k, page=page: [k] + (up(page.parent[k]) if k else [])
        n = len(page.tag)
        size, chars, own, links = ([0] * n for _ in range(4))
        for k in range(n):
            for a in up(k):
                size[a] += 1
                links[a] += page.tag[k] == "a"
        for node, text, _ in page.pieces:
            own[node] += len(text)
            for a in up(node):
                chars[a] += len(text)
        at = 2 * len(html_main.TOKENS) + 9 + 13
        want = np.column_stack([[len(up(k)) - 1 for k in range(n)], np.log1p(chars), np.log1p(own), np.log1p(size), np.array(links) / size, np.array(chars) / size])
        assert np.allclose(rows[:, [at, at + 3, at + 4, at + 9, at + 13, at + 8]], want)
        for j, words in enumerate(html_main.TOKENS):
            assert rows[:, j].tolist() == [(page.kinds[k] >> j) & 1 for k in range(n)], words


def test_decoding_never_contradicts():
    page = html_main.Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    r = np.random.default_rng(1)
    for _ in range(50):
        logit = r.normal(size=len(page.tag)) * 3
        kept = page.decode(logit)
        assert all(not kept[k] or kept[page.parent[k]] for k in range(1, len(kept)))
        value = lambda m, z=logit: sum((-np.logaddexp(0, -z[k]) if m[k] else -np.logaddexp(0, z[k])) for k in range(1, len(m)))
        best = max(value([True, *m]) for m in np.ndindex(*[2] * (len(kept) - 1)) if all(not m[k - 1] or ([True, *m])[page.parent[k]] for k in range(1, len(kept))))
        assert math.isclose(value(kept), best)


def test_boosted_trees_learn():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = trees.fit(x[:1500], y[:1500], 40)
    assert np.mean((f.logit(x[1500:]) > 0) == y[1500:]) > 0.95


# ---- Mixing


def test_mix_meets_its_target(spark):
    r = random.Random(8)
    rows = [(k, prose(r.randint(1, 60), r), "big" if k % 10 < 6 else "mid" if k % 10 < 9 else None if k % 20 == 9 else "small") for k in range(800)]
    df = frame(spark, rows)
    out = mixing.mix_plan(df).toPandas()
    size = {d: len((t or "").encode().split()) + 1 for d, t, _ in rows}
    total = sum(size.values())
    own = defaultdict(int)
    for d, _, s in rows:
        own[s or ""] += size[d]
    share = {s: n / total for s, n in own.items()}
    made = out.groupby("source").n_tokens.sum().to_dict()
    entropy = lambda p: -sum(x * math.log(x) for x in p.values())
    h = entropy({s: n / sum(made.values()) for s, n in made.items()})
    assert abs(h - (entropy(share) + 0.5 * (math.log(len(share)) - entropy(share)))) < 0.02
    assert abs(sum(made.values()) - total) < 60 * len(share) + 60
    for s, part in out.groupby("source"):  # whole passes first
        n = part.groupby("copy").doc_id.nunique()
        docs = sum((x or "") == s for _, _, x in rows)
        assert all(n[c] == docs for c in n.index[:-1]) and (part.n_tokens == part.doc_id.map(size)).all()
    for _, part in out.groupby("block"):
        assert sorted(part.slot) == list(range(len(part)))
    again = mixing.mix_plan(df.repartition(5)).toPandas()
    key = ["doc_id", "copy"]
    assert again.sort_values(key).reset_index(drop=True).equals(out.sort_values(key).reset_index(drop=True))
    kept = mixing.mixed(df)
    assert kept.columns == df.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(out.doc_id)


def test_mix_keeps_the_repeat_limit(spark):
    rows = [(k, "w " * 20, "a") for k in range(200)] + [(1000, "w " * 20, "b")]
    out = mixing.plan(frame(spark, rows), gain=1.0, max_repeats=3.0)[0].toPandas()
    assert out[out.source == "b"]["copy"].max() <= 2


def test_mix_with_a_hot_id(spark):
    """One doc_id holds a third of the rows: they are taken together and strewn over blocks."""
    rows = [(7 if k % 3 == 0 else 1000 + k, "w " * (5 + k % 40), "a" if k % 4 else "b") for k in range(3000)]
    out = mixing.plan(frame(spark, rows), block_tokens=2000)[0].toPandas()
    held = Counter((d, s) for d, _, s in rows)
    taken = out.groupby(["source", "copy", "doc_id"]).size()
    assert all(n == held[d, s] for (s, _, d), n in taken.items())
    hot = out[out.doc_id == 7]
    assert len(hot) >= 700 and hot.block.nunique() > 5
    for _, part in out.groupby("block"):
        assert sorted(part.slot) == list(range(len(part)))
    assert Counter(x.doc_id for x in mixing.mixed(frame(spark, rows)).collect()) == Counter(mixing.mix_plan(frame(spark, rows)).toPandas().doc_id)


def test_mix_odd_tables(spark):
    assert mixing.mix_plan(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    one = frame(spark, [(1, None, None), (2, "", "x"), (None, "a b", "x"), (2, "", "x")])
    assert mixing.mix_plan(one).count() > 0 and mixing.mixed(one).count() == mixing.mix_plan(one).count()


# ---- N-gram Jaccard join


def shingles(text, width):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, num, den):
    sets = {d: shingles(t, width) for d, t, _ in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width, num", [(4, 85), (5, 80), (2, 50)])
def test_join_is_exact(spark, monkeypatch, width, num):
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 7)
    r = random.Random(width)
    rows, k = [], 0
    common = prose(60, r)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 25, 40, 70, 150, 400):
        words = prose(n, r).split(" ")
        for edits in (0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 4, 6):
            own = list(words)
            for _ in range(edits):
                way, at = r.choice("srid"), r.randrange(len(own))
                own[at : at + (way != "i")] = {"s": [r.choice(WORDS)], "r": [own[at].upper()], "i": [r.choice(WORDS)], "d": []}[way] if len(own) > 1 else own[at : at + 1]
                own = own or ["x"]
            rows.append((k, " ".join(own) + ("\n" + common if k % 11 == 0 else ""), "s"))
            k += 1
    rows += [(k, None, "s"), (k + 1, "", "s"), (k + 2, " \n", "s"), (k + 3, "one", "s"), (k + 4, "ONE", "s"), (k + 5, "w " * 9000, "s"), (k + 6, "w " * 8000, "s")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.linked_components(frame(spark, rows), width, num, 100).collect()}
    want = brute(rows, width, num, 100)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 40
    kept = jaccard.deduplicated(frame(spark, rows + [(None, "x", "s")]), width, num, 100)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted([str(c) for c in {c for _, c in want.values()}] + ["None"])


def test_join_with_repeated_ids_and_rows(spark):
    """A doc_id with two texts: each row goes by its own; of rows alike one stays."""
    r = random.Random(77)
    a, b = prose(60, r), prose(60, r)
    near = b + " end"
    rows = [(5, a, "s"), (5, b, "s"), (7, near, "s"), (1, "x y z", "s"), (1, "x y z", "s"), (2, "X Y Z", "s"), (9, None, "s"), (9, None, "s"), (None, "x y z", "s"), (None, a, "s")]
    got = Counter((x.doc_id, x.component_id) for x in jaccard.linked_components(frame(spark, rows), 4, 85, 100).collect())
    assert got == Counter([(5, 5), (5, 5), (7, 5), (1, 1), (1, 1), (2, 1), (9, 9), (9, 9), (None, None), (None, None)])
    kept = Counter((x.doc_id, x.text) for x in jaccard.deduplicated(frame(spark, rows), 4, 85, 100).collect())
    assert kept == Counter([(5, a), (5, b), (1, "x y z"), (9, None), (9, None), (None, "x y z"), (None, a)])
    clash = frame(spark, rows).withColumnsRenamed({"kept": "_th"}).withColumns({"_id": F.lit(1), "_stays": F.lit("n"), "key": F.lit(2)})
    out = jaccard.deduplicated(clash, 4, 85, 100)
    assert out.columns == clash.columns and out.count() == 7


def test_hot_keys_and_large_families(spark, monkeypatch):
    """Keys that many sets share go another way to the same result; families are split by members and by shingles."""
    monkeypatch.setattr(jaccard, "HOT_KEY", 8)
    monkeypatch.setattr(jaccard, "HOT_PART", 1)
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 5)
    monkeypatch.setattr(jaccard, "FAMILY_SHINGLES", 300)
    r = random.Random(6)
    base, rows = prose(50, r).split(" "), []
    for k in range(60):
        own = list(base)
        for _ in range(k % 4):
            own[r.randrange(len(own))] = r.choice(WORDS)
        rows.append((k, " ".join(own) if k % 5 else prose(30, r), "s"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.linked_components(frame(spark, rows), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_every_linked_pair_shares_a_key():
    r = np.random.default_rng(6)
    for n in [*range(1, 40), 60, 141, 210, 211, 300]:
        for _ in range(30):
            a = r.integers(0, 1 << 63, n + 40).astype(np.uint64)
            base = set(a[:n].tolist())
            h = int(n * 0.3) + 1
            other = set(base)
            for _ in range(r.integers(0, h + 1)):
                if r.random() < 0.5 and len(other) > 1:
                    other.discard(next(iter(other)))
                else:
                    other.add(int(r.integers(0, 1 << 63)))
            both = len(base & other)
            if 100 * both >= 80 * len(base | other) and base != other:
                x, y = (np.sort(np.array(list(s), np.uint64)) for s in (base, other))
                keys, at = jaccard.set_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 80, 100)
                assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


def test_sets_with_empty_segments_share_keys():
    # All hashes in one corner of the universe: nearly every segment is empty.
    x = np.sort(np.arange(1, 301, dtype=np.uint64))
    y = x[7:]
    keys, at = jaccard.set_keys(np.concatenate([x, y]), np.array([0, 300, 593]), 85, 100)
    assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


def test_join_of_an_empty_table(spark):
    assert jaccard.linked_components(frame(spark, [])).count() == 0
    assert jaccard.deduplicated(frame(spark, []), 5, 80, 100).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k + 1, k) for k in range(100, 140)] + [(500, k) for k in range(501, 520)] + [(7, 7), (3, 9), (9, 3)]
    r = random.Random(2)
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 500 for k in range(500, 520)}, 3: 3, 9: 3}


def test_vocabulary_features_depend_on_letters_alone():
    one, two = (toxicity.vocabulary(find_words(*text_buffers(pa.array([t])), lower=True).vocab) for t in ("Idiot,", "(idiot)"))
    assert one.word.tolist() == two.word.tolist() and one.grams.tolist() == two.grams.tolist()


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    rows = [(k, prose(r.randint(30, 200), r), f"s{k % 3}") for k in range(120)]
    rows += [(200 + k, rows[k][1], "s0") for k in range(10)] + [(300, None, "s1"), (301, "", None)]
    frame(spark, rows).drop("kept").write.parquet(f"{tmp_path}/documents.parquet")
    marks(spark, [(k, 1, 0) for k in range(40)]).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    good = [(d, t, s) for d, t, s in rows if (n := base(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]]
    found = brute(good, 5, 80, 100)
    left = [x for x in good if found[x[0]][1] == x[0]]
    plan = mixing.mix_plan(frame(spark, left)).toPandas()
    assert Counter(out[out.start == 0].doc_id) == Counter(plan.doc_id)
    assert all(x.ids_crc32 == zlib.crc32(x.ids) and len(x.ids) == 4 * x.length for x in out.itertuples())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "packing"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names, and no rows at all."""
    import corpus_pipeline
    from vitrine.llm.storage import stored

    r = random.Random(10)
    good = prose(120, r)
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, good, None, None, None), (None, None, None, None, None), (None, prose(80, r), "en", "b", 1), (3, "", "", "", 0), (4, prose(30000, r), "en", "a", 9), (5, " \n\t", "en", "b", 3)]
    odd = spark.createDataFrame([(*x, 1, "q", 2.0, 3) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, ids string, _copy double, sequence_id int")
    marks(spark, [(k, k % 2, int(k % 3 == 0)) for k in range(40)]).selectExpr("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        now = stored(docs, "odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, now, str(tmp_path)), name)
            assert out.columns == docs.columns and out.count() <= 2 * docs.count()
            assert docs.count() == 0 or out.count() > 0
            now = out
        name, stage = corpus_pipeline.STAGES[-1]
        packed = stage(spark, now, str(tmp_path))
        assert packed.where("start = 0").count() == now.count()
        # Each stage on the whole odd table.
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).count()
    assert F is not None
