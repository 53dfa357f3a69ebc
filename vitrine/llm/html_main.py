"""Main text of HTML pages: gradient-boosted trees over the nodes of the document tree, decoded hierarchically.

Every element gets the chance that it belongs to the article, from its tag, its attribute tokens and those of its
ancestors, its depth, the density of its subtree and how it compares with its siblings. Decoding picks the likeliest
choice in which whatever lies in a dropped element is dropped as well. The trees are fitted on pages that a generator
builds, with known articles, from many kinds of page furniture.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import trees

#: Pages that the generator makes for fitting, and its seed.
TRAIN_PAGES, TRAIN_SEED = 700, 11
#: Nodes that are scored together.
BATCH_NODES = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and no text of the page.
RAW = frozenset("script style title textarea noscript template iframe svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Opening one of these ends an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Opening the key ends an open element of the value, up to the nearest of its containers.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Attribute tokens by what they speak for.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs topnav subnav pager pagination toc tabs skip",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense outbrain taboola partner",
    "foot": "footer foot colophon copyright legal imprint bottom",
    "head": "header masthead topbar head site logo branding top",
    "side": "sidebar aside side related recommended recommendations widget widgets rail popular trending more teaser teasers",
    "comment": "comment comments reply replies respond responses discussion disqus thread feedback reviews guestbook commentlist",
    "notice": "cookie cookies consent gdpr notice notices alert alerts modal popup overlay privacy message warning notification toast paywall",
    "form": "form subscribe subscription newsletter signup login search searchbox contact register poll",
    "share": "share sharing social tags tag meta byline author follow print toolbar buttons",
    "main": "content article post entry main body story text page prose maincontent articlebody richtext copy",
}
TAGS = "p h1 h2 h3 h4 li ul ol a div section article main nav header footer aside form table td blockquote pre figure body button label dl span".split()
_TOKEN_KIND = {w: k for k, words in enumerate(TOKENS.values()) for w in words.split()}
_TAG_KIND = {t: k for k, t in enumerate(TAGS)}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: Attributes up to the end of a tag; a quote counts after an equals sign only, and where it is closed. Takes a text once.
_INSIDE = re.compile(r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I | re.S)
#: One attribute after the other, or a stray quoted text; what stands in a value is no name.
_NAMED = re.compile(r"\"[^\"]*+\"|'[^']*+'|([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.S)
_HIDING = re.compile("hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*+:\s*+none", re.I)
_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|$)", re.I | re.A) for tag in RAW}
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _hidden(attributes: str) -> bool:
    """Whether attributes by these names hide their element."""
    if not _HIDING.search(attributes):
        return False
    for found in _NAMED.finditer(attributes):
        name, value = (found[1] or "").lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or (name == "style" and _UNSEEN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
    return False


class _Open:
    """The open elements. Beside the stack: the places of each tag in it, and for each place that of the nearest element
    at or under it that is no inline one. So every question is answered at once, and what is closed is closed once."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.block = [0], ["body"], [0]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.block.append(self.block[-1] if tag in INLINE else place)
        self.places.setdefault(tag, []).append(place)

    def top(self, tag: str) -> int:
        """The highest place of the tag; 0: it is not open."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def cut(self, place: int) -> None:
        """Close what is at this place and above."""
        while len(self.nodes) > max(place, 1):
            self.nodes.pop()
            self.block.pop()
            self.places[self.tags.pop()].pop()

    def end(self, tag: str) -> None:
        place = self.top(tag)
        if place and not (tag in INLINE and place < self.block[-1]):  # an inline end tag does not end blocks
            self.cut(place)

    def end_paragraph(self) -> None:
        place = self.block[-1]
        self.cut(place if self.tags[place] == "p" else place + 1)

    def end_sibling(self, tags: str, within: tuple[str, ...]) -> None:
        place = max(map(self.top, tags.split()))
        if place > max(map(self.top, within)):
            self.cut(place)


class Page:
    """The tree of a page: lists by element, and the text pieces as (element, text, whether a block ends before it)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.depth, self.hidden = ["body"], [-1], [0], [0], [False]
        self.pieces: list[tuple[int, str, bool]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        kinds = 0
        if "=" in attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                for word in _PART.findall(found[2] or found[3] or found[4] or ""):
                    kind = _TOKEN_KIND.get(word.lower())
                    if kind is not None:
                        kinds |= 1 << kind
        self.tag.append(tag)
        self.parent.append(parent)
        self.kinds.append(kinds)
        self.depth.append(self.depth[parent] + 1)
        self.hidden.append(_hidden(attributes))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        """One pass: every step moves on in the source, and what the stack of open elements is asked is kept beside it."""
        opened = _Open()
        at, begin, ended, n = 0, 0, True, len(source)

        def put(text: str) -> None:
            nonlocal ended
            if text:
                if not text.isspace():
                    self.pieces.append((opened.nodes[-1], html.unescape(text), ended))
                    ended = False
                elif not ended:
                    self.pieces.append((opened.nodes[-1], " ", False))

        while (lt := source.find("<", at)) >= 0:
            sign = source[lt + 1 : lt + 2]
            if sign in ("!", "?") and sign:
                put(source[begin:lt])
                if source.startswith("<!--", lt):
                    close = source.find("-->", lt + 4)
                elif source.startswith("<![CDATA[", lt):
                    close = source.find("]]>", lt + 9)
                else:
                    close = source.find(">", lt)
                if close < 0:
                    return
                begin = at = close + (1 if source[close] == ">" else 3)
                continue
            name = _NAME.match(source, lt + 1)
            if not name:
                at = lt + 1  # an ordinary sign
                continue
            put(source[begin:lt])
            inside = _INSIDE.match(source, name.end())
            attributes = inside[0]
            begin = at = inside.end() + 1
            tag = name[0].lower()
            ends = tag[0] == "/"
            tag = tag.lstrip("/")
            if tag not in INLINE:
                ended = True
            elif tag == "br" and not ended:
                self.pieces.append((opened.nodes[-1], " ", False))
            if ends:
                opened.end(tag)
                continue
            if tag in RAW:
                if attributes.endswith("/"):
                    continue
                end = _END[tag].search(source, at)
                close = source.find(">", end.end()) if end else -1
                if close < 0:
                    return
                begin = at = close + 1
                continue
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P:
                opened.end_paragraph()
            if tag in SIBLINGS:
                opened.end_sibling(*SIBLINGS[tag])
            if tag in VOID:
                continue
            node = self._open(tag, attributes, opened.nodes[-1])
            if not attributes.endswith("/") or tag not in INLINE:
                opened.push(node, tag)
        put(source[begin:])

    def features(self) -> np.ndarray:
        """One row for each element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        words, chars, linked, stops, pieces = (np.zeros(n) for _ in range(5))
        in_link = [False] * n
        for k in range(n):
            in_link[k] = self.tag[k] == "a" or (k > 0 and in_link[parent[k]])
        for node, text, _ in self.pieces:
            size = len(text)
            words[node] += text.count(" ") + 1
            chars[node] += size
            stops[node] += text.count(".") + text.count(",") + text.count("。")
            pieces[node] += 1
            if in_link[node]:
                linked[node] += size
        own = chars.copy()
        size, blocks, items, controls, links = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for k, t in enumerate(self.tag):
            if t == "p":
                blocks[k] = 1
            elif t == "li":
                items[k] = 1
            elif t in ("form", "button", "label", "fieldset"):
                controls[k] = 1
            elif t == "a":
                links[k] = 1
        total = np.stack([words, chars, linked, stops, pieces, size, blocks, items, controls, links])
        for k in range(n - 1, 0, -1):  # children come after their parents
            total[:, parent[k]] += total[:, k]
        words, chars, linked, stops, pieces, size, blocks, items, controls, links = total
        kinds = np.array(self.kinds)
        above, inside = np.zeros(n, np.int64), np.zeros(n, np.int64)
        landmark = {"article": 1, "main": 2, "nav": 4, "footer": 8, "header": 16, "aside": 32, "form": 64, "button": 64, "ul": 128, "section": 256}
        count, place = np.zeros(n), np.zeros(n)
        for k in range(1, n):
            p = parent[k]
            above[k] = above[p] | kinds[p]
            inside[k] = inside[p] | landmark.get(self.tag[k], 0)
            place[k] = count[p]
            count[p] += 1
        up = np.maximum(parent, 0)
        begin, seen = np.zeros(n), 0.0
        starts = np.full(n, -1.0)
        for node, text, _ in self.pieces:
            if starts[node] < 0:
                starts[node] = seen
            seen += len(text)
        for k in range(n - 1, 0, -1):
            if starts[k] >= 0 and (starts[parent[k]] < 0 or starts[k] < starts[parent[k]]):
                starts[parent[k]] = starts[k]
        begin = np.maximum(starts, 0) / max(seen, 1)
        beside = (chars[up] - chars) / np.maximum(count[up] - 1, 1)
        tag = np.array([_TAG_KIND.get(t, len(TAGS)) for t in self.tag])
        flags = [(kinds >> k) & 1 for k in range(len(TOKENS))] + [(above >> k) & 1 for k in range(len(TOKENS))] + [(inside >> k) & 1 for k in range(9)]
        named = [tag == _TAG_KIND[t] for t in ("p", "h1", "li", "a", "div", "nav", "footer", "header", "aside", "form", "article", "main", "ul")]
        return np.column_stack(
            flags
            + named
            + [
                np.array(self.depth), place, count[up], np.log1p(chars), np.log1p(own), np.log1p(words), linked / np.maximum(chars, 1), stops / np.maximum(words, 1),
                chars / size, np.log1p(size), blocks, items, controls, links / size, chars / max(seen, 1), begin, (chars - beside) / np.maximum(chars + beside, 1), chars / np.maximum(chars[up], 1),
                np.array(self.hidden),
            ]
        ).astype(np.float64)

    def decode(self, logit: np.ndarray) -> np.ndarray:
        """Which elements stay: the likeliest choice that keeps nothing in a dropped element."""
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
        keep, drop = yes.tolist(), no.tolist()
        parent = self.parent
        keep[0] = 0.0
        for k in range(n - 1, 0, -1):
            keep[parent[k]] += max(keep[k], drop[k])
            drop[parent[k]] += drop[k]
        out = [True] * n
        for k in range(1, n):
            out[k] = out[parent[k]] and keep[k] >= drop[k]
        return np.array(out)

    def text(self, kept: np.ndarray) -> str:
        """The blocks of the kept elements in page order, one to a line."""
        blocks: list[list[str]] = []
        last = True
        for node, text, ended in self.pieces:
            if ended:
                last = True
            if kept[node]:
                if last:
                    blocks.append([])
                    last = False
                blocks[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def extract(sources: list[str | None], forest: trees.Forest) -> list[str]:
    """Main texts of pages; empty for a null or empty one."""
    out: list[str] = []
    waiting: list[Page] = []

    def flush() -> None:
        if waiting:
            rows = [p.features() for p in waiting]
            logit = forest.logit(np.concatenate(rows))
            at = 0
            for page, own in zip(waiting, rows, strict=True):
                out.append(page.text(page.decode(logit[at : at + len(own)])))
                at += len(own)
            waiting.clear()

    nodes = 0
    for source in sources:
        waiting.append(Page(source or ""))
        nodes += len(waiting[-1].tag)
        if nodes >= BATCH_NODES:
            flush()
            nodes = 0
    flush()
    return out


@cache
def _words() -> list[str]:
    """Made-up words of one to three syllables."""
    syllables = "an ber ca de el fa go hin is ja ko lu mer no ou pra qui re sta ti un vel wer xa yo zen ã é ß ö".split()
    r = np.random.default_rng(TRAIN_SEED)
    return ["".join(syllables[k] for k in r.integers(len(syllables), size=r.integers(1, 4))) for _ in range(3000)]


def training_page(r: np.random.Generator) -> tuple[str, list[bool]]:
    """A made-up page, and for each element but body, in order, whether it belongs to the article."""
    words = _words()
    word = lambda: words[r.integers(len(words))]
    pick = lambda *x: x[r.integers(len(x))]
    chance = lambda p: r.random() < p
    marks: list[bool] = []
    out: list[str] = []

    def sentence(most: int) -> str:
        n = r.integers(1, most)
        w = [words[k] + "," if comma else words[k] for k, comma in zip(r.integers(len(words), size=n).tolist(), (r.random(n) < 0.08).tolist(), strict=True)]
        return " ".join(w).capitalize() + pick(".", ".", ".", "!", "?")

    def prose(most: int = 6) -> str:
        return " ".join(sentence(18) for _ in range(r.integers(1, most)))

    def put(tag: str, main: bool, attributes: str = "") -> None:
        out.append(f"<{tag}{' ' + attributes if attributes else ''}>")
        marks.append(main)

    def end(tag: str) -> None:
        out.append(f"</{tag}>")

    def leaf(tag: str, text: str, main: bool, attributes: str = "") -> None:
        put(tag, main, attributes)
        out.append(text)
        end(tag)

    def name(*words: str) -> str:
        w = pick(*words)
        w = pick(w, w, f"{w}-{pick('box', 'wrap', 'inner', 'block', '1')}", f"{pick('c', 'site', 'page', 'x')}-{w}")
        return pick(f'class="{w}"', f'class="{w}"', f'id="{w}"', f'class="{pick("row", "clearfix", "u-x")} {w}"')

    def link_list(n: int) -> None:
        tag = pick("ul", "ul", "ol", "div")
        put(tag, False)
        for _ in range(n):
            if tag != "div":
                put("li", False)
            leaf("a", " ".join(word() for _ in range(r.integers(1, 5))), False, 'href="/x"')
            if tag != "div":
                end("li")
        end(tag)

    def furniture(kind: str) -> None:
        plain = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        words = TOKENS[kind].split()[:8]
        tag = pick(plain, plain, "div", "section" if kind not in ("form",) else "form")
        put(tag, False, name(*words) if tag in ("div", "section") or chance(0.4) else "")
        if kind in ("menu", "head") or (kind in ("foot", "side", "share") and chance(0.6)):
            if kind == "head":
                leaf(pick("div", "span", "h1", "p"), " ".join(word() for _ in range(3)), False)
            link_list(r.integers(2, 9))
        if kind in ("ad", "notice", "foot") or (kind == "side" and chance(0.7)):
            for _ in range(r.integers(1, 3)):
                text = pick("", "", "&copy; 2024 ") + prose(pick(2, 3, 5))
                if chance(0.5):
                    out.append(text)
                else:
                    leaf(pick("p", "span", "div", "h3"), text, False)
            if chance(0.4):
                leaf(pick("a", "button"), word(), False)
        if kind == "comment":
            if chance(0.6):
                leaf(pick("h2", "h3"), word(), False)
            for _ in range(r.integers(1, 6)):
                put(pick("div", "article"), False, name("comment", "reply") if chance(0.7) else "")
                tag_inner = out[-1][1:].split()[0].rstrip(">")
                if chance(0.6):
                    leaf(pick("span", "b", "cite"), word(), False)
                for _ in range(r.integers(1, 4)):
                    leaf("p", prose(5), False)
                end(tag_inner)
        if kind == "form":
            for _ in range(r.integers(1, 4)):
                leaf(pick("label", "p", "span"), word() + " " + word(), False)
                out.append('<input type="text">')
            leaf("button", word(), False)
        if kind == "share":
            leaf("span", " ".join(word() for _ in range(4)), False)
        end(tag)

    def article() -> None:
        wrap = pick(("article", ""), ("article", ""), ("article", name("post", "entry")), ("main", ""), ("div", name("content", "article", "post", "entry", "story", "main")), ("div", ""), ("section", ""))
        put(wrap[0], True, wrap[1])
        inner = chance(0.3)
        if inner:
            put("div", True, pick("", name("content", "body", "text")))
        if chance(0.9):
            headed = chance(0.15)
            if headed:
                put("header", True)
            leaf(pick("h1", "h1", "h2"), sentence(14), True)
            if headed:
                end("header")
        for _ in range(pick(1, 2, 4, 8, 14, 25)):
            kind = r.random()
            if kind < 0.70:
                text = " ".join(word() for _ in range(r.integers(1, 4))) if chance(0.08) else prose(pick(2, 3, 8))
                if chance(0.2):
                    out.append("<p>")
                    marks.append(True)
                    out.append(text + " ")
                    leaf(pick("b", "em", "a"), word(), True)
                    out.append(" " + sentence(12))
                    end("p")
                else:
                    leaf("p", text, True)
            elif kind < 0.77:
                out.append("<p><b>" + prose(3) + "<br>")
                marks.extend([True, True])
            elif kind < 0.84:
                leaf(pick("h2", "h3"), sentence(8), True)
            elif kind < 0.89:
                put(pick("ul", "ol"), True)
                tag = out[-1][1:3]
                for _ in range(r.integers(2, 6)):
                    leaf("li", sentence(15), True)
                end(tag)
            elif kind < 0.93:
                put("blockquote", True)
                leaf("p", prose(4), True)
                end("blockquote")
            elif kind < 0.96:
                leaf("pre", prose(3), True)
            else:
                furniture(pick("ad", "share", "form", "side"))
        if inner:
            end("div")
        if chance(0.25):
            furniture(pick("share", "comment", "side", "foot"))
        end(wrap[0])

    wrapped = chance(0.4)
    if wrapped:
        put("div", True, pick("", 'id="page"', 'class="container"', 'class="wrapper"'))
    for kind in ("notice", "head", "menu", "ad", "form", "side"):
        if chance(0.45 if kind != "menu" else 0.7):
            furniture(kind)
    columns = chance(0.3)
    if columns:
        put("div", True, pick("", 'class="row"', 'class="layout"'))
    article()
    if chance(0.4):
        furniture("side")
    if columns:
        end("div")
    for kind in ("comment", "side", "ad", "form", "notice", "foot"):
        if chance(0.4 if kind != "foot" else 0.8):
            furniture(kind)
    if wrapped:
        end("div")
    return "".join(out), marks


@cache
def model(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> trees.Forest:
    r = np.random.default_rng(seed)
    rows, marks = [], []
    for _ in range(pages):
        source, known = training_page(r)
        page = Page(source)
        if len(page.tag) == len(known) + 1:
            rows.append(page.features()[1:])
            marks.extend(known)
    return trees.fit(np.concatenate(rows), np.array(marks, np.float64))


TEXTS = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The whole html is read, in one pass, however long or malformed it is; a null or empty one, or a page without an
    article, gives an empty text; equal odds keep an element; rows may repeat, nulls in other columns stay, other columns
    are left alone, an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, part.column("url").type), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, TEXTS)
