"""Boxes of one page against each other in numpy, without a row for each pair.

Arithmetic is that of the column expressions in `geometry`, in the same order, so results are the same to the last bit. A box
with a null or non-finite side meets nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Boxes of a tile, pairs that are looked at at once, and boxes of a block, whose list goes out as one; they change no result.
TILE, FIRST, MOST, BLOCK = 512, 32, 1 << 20, 128


def box_arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """x, y, width, height of a column of box structs; NaN for null."""
    one = column.combine_chunks()
    return [pc.struct_field(one, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "width", "height")]


def dense_rank(column: pa.ChunkedArray) -> np.ndarray:
    """From 0; equal values have one rank."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    place = np.empty(len(codes.dictionary), np.int64)
    place[pc.sort_indices(codes.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    return place[codes.indices.to_numpy(zero_copy_only=False)]


def _tiles(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """All places, by neighbourhoods of about TILE."""
    parts = max(1, round((len(x) / TILE) ** 0.5))
    for strip in np.array_split(np.argsort(x, kind="stable"), parts):
        for tile in np.array_split(strip[np.argsort(y[strip], kind="stable")], parts):
            if len(tile):
                yield tile


def overlapped(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """Whether each box has one of lower rank with an intersection over union of `least` (above 0) or more.

    Boxes of a tile ask the boxes around it, the lowest ranks first; one that has found an earlier box asks no more.
    """
    out = np.zeros(len(x), bool)
    x2, y2, area = x + w, y + h, w * h
    some = np.flatnonzero((w > 0) & (h > 0) & np.isfinite(x2) & np.isfinite(y2))
    some = some[np.argsort(rank[some], kind="stable")]
    # Such boxes share `least` of either side, so corners are no farther apart than what is left of the larger one.
    reach = 1.001 * (1 - least) / least
    slack = [1e-9 * np.abs(v[some]).max(initial=0.0) for v in (x, y)]
    for tile in _tiles(x[some], y[some]):
        own = some[tile]
        far = [reach * s[own].max() + e for s, e in zip((w, h), slack, strict=True)]
        inside = [(v[some] >= v[own].min() - r) & (v[some] <= v[own].max() + r) for v, r in zip((x, y), far, strict=True)]
        near = some[inside[0] & inside[1]]
        at, step = 0, FIRST
        while True:
            own = own[rank[own] > rank[near[at]]] if at < len(near) else own[:0]
            if not len(own):
                break
            for k in range(0, len(own), MOST // step):
                a, b = near[at : at + step][None, :], own[k : k + MOST // step, None]
                ox = np.maximum(0.0, np.minimum(x2[a], x2[b]) - np.maximum(x[a], x[b]))
                oy = np.maximum(0.0, np.minimum(y2[a], y2[b]) - np.maximum(y[a], y[b]))
                inter = ox * oy
                union = area[a] + area[b] - inter
                with np.errstate(divide="ignore", invalid="ignore"):
                    met = (inter > 0) & (union > 0) & (inter / union >= least) & (rank[a] < rank[b])
                out[own[k : k + MOST // step]] |= met.any(axis=1)
            own = own[~out[own]]
            at, step = at + step, min(2 * step, MOST // 4)
    return out


def nearest(texts: list[np.ndarray], anchors: list[np.ndarray], near_x: float, near_y: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text the first anchor of the least distance that it can be a caption or a side label of (-1: none), and that
    distance. A text that has found an anchor at distance 0 looks no farther."""
    tx, ty, tw, th = texts
    ax, ay, aw, ah = anchors
    tx2, ty2, ax2, ay2 = tx + tw, ty + th, ax + aw, ay + ah
    found, least = np.full(len(tx), -1), np.full(len(tx), np.inf)
    # Boxes with sides above 0 meet within near_x and near_y; others anywhere.
    flat = ~((aw > 0) & (ah > 0))
    small = ~((tw > 0) & (th > 0))
    places = np.flatnonzero(~small)
    whole = [(np.flatnonzero(small), np.arange(len(ax)))] if small.any() else []
    far = [1.001 * near_x + 1e-9 * np.nanmax(np.abs(np.append(ax, 0.0))), 1.001 * near_y + 1e-9 * np.nanmax(np.abs(np.append(ay, 0.0)))]

    def around() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from whole
        for tile in _tiles(tx[places], ty[places]):
            own = places[tile]
            inside = flat.copy()
            near = np.ones(len(ax), bool)
            for low, high, a, a2, r in ((tx, tx2, ax, ax2, far[0]), (ty, ty2, ay, ay2, far[1])):
                near &= (a <= np.nanmax(high[own]) + r) & (a2 >= np.nanmin(low[own]) - r)
            yield own, np.flatnonzero(inside | near)

    for own, near in around():
        at, step = 0, FIRST
        while at < len(near) and len(own):
            a = near[at : at + step][None, :]
            for k in range(0, len(own), MOST // step):
                mine = own[k : k + MOST // step]
                t = mine[:, None]
                sx = np.maximum(tx[t], ax[a]) - np.minimum(tx2[t], ax2[a])
                sy = np.maximum(ty[t], ay[a]) - np.minimum(ty2[t], ay2[a])
                dx, dy = np.maximum(0.0, sx), np.maximum(0.0, sy)
                caption = (dy <= near_y) & (np.maximum(0.0, -sx) >= share * np.minimum(tw[t], aw[a]))
                beside = (dx <= near_x) & (np.maximum(0.0, -sy) >= share * np.minimum(th[t], ah[a]))
                d = np.where(caption | beside, dx + dy, np.inf)
                best = d.argmin(axis=1)
                d = d[np.arange(len(mine)), best]
                less = d < least[mine]
                found[mine[less]], least[mine[less]] = a[0, best[less]], d[less]
            own = own[least[own] > 0]
            at, step = at + step, min(2 * step, MOST // 4)
    return found, least


def _first_beyond(starts: np.ndarray, ends: np.ndarray, margin: float) -> np.ndarray:
    """How many of the sorted starts lie no more than the margin behind each end, as subtraction rounds it."""
    n = np.searchsorted(starts, ends + margin, "right")
    while (more := (n < len(starts)) & (starts[np.minimum(n, len(starts) - 1)] - ends <= margin)).any():
        n += more
    while (less := (n > 0) & (starts[np.maximum(n, 1) - 1] - ends > margin)).any():
        n -= less
    return n


def _in_space(home: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of boxes in classes of those alike (or near) along y, by x in each; and their classes."""
    by_y = np.lexsort((high, low, home))
    other = np.any([v[by_y][1:] != v[by_y][:-1] for v in (home, low, high)], axis=0)
    code = np.cumsum(np.append(0, other)[: len(by_y)])
    if len(code) and code[-1] >= max(1, len(code) // BLOCK):
        code = np.arange(len(code)) // math.ceil((len(code) * BLOCK) ** 0.5)
    by_x = np.lexsort((start[by_y], code))
    return by_y[by_x], code[by_x]


def touching(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, home: np.ndarray, rank: np.ndarray, margin_x: float, margin_y: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of boxes a, how many boxes b of each lie within both margins of it, and their places. A rank of a is the lower one.
    Each pair comes once, but none of two boxes that are both not at home, or that share a rank. A box with a side that is not a
    number meets nothing. At most BLOCK of b come at once.

    Ranks are halved again and again. The lower half meets blocks of the upper one, those that meet the same boxes one after the
    other: rows of one a follow each other, and its list of b is mostly that of the a before, so a file of them stays small.
    """
    with np.errstate(invalid="ignore"):
        own = np.flatnonzero((x - x2 <= margin_x) & (y - y2 <= margin_y))
    sides = []
    for start, end, margin in ((x, x2, margin_x), (y, y2, margin_y)):
        starts = np.unique(start[own])
        kind = np.int16 if len(starts) < np.iinfo(np.int16).max else np.int32
        sides += [np.searchsorted(starts, start[own]).astype(kind), _first_beyond(starts, end[own], margin).astype(kind)]
    order, code = _in_space(home[own], sides[2], sides[3], sides[0])
    own, (left, right, low, high) = own[order].astype(np.int32), (v[order] for v in sides)
    home, rank = home[own], rank[own]

    def meet(one: np.ndarray, block: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = one[:, None], block[None]
        met = left[b] < right[a]
        met &= left[a] < right[b]
        met &= low[b] < high[a]
        met &= low[a] < high[b]
        if not (home[one].all() or home[block].all()):
            met &= home[a] | home[b]
        if ordered:
            met &= rank[a] < rank[b]
        alike = np.lexsort(np.packbits(met, axis=1).T)
        met = met[alike]
        n = np.count_nonzero(met, axis=1)
        return own[one[alike]][n > 0], n[n > 0], np.broadcast_to(own[block], met.shape)[met]

    nodes = [(np.arange(len(own)), 0, int(rank.max(initial=-1)) + 1)]
    while nodes:
        some, least, most = nodes.pop()
        if len(some) < 2 or most - least < 2:
            continue
        if len(some) <= BLOCK:
            yield meet(some, some, True)
            continue
        middle = (least + most) // 2
        upper = rank[some] >= middle
        a, b = some[~upper], some[upper]
        nodes += [(a, least, middle), (b, middle, most)]
        first = np.flatnonzero(np.append(True, code[b][1:] != code[b][:-1])[: len(b)]).tolist()
        cuts = [at for i, j in zip(first, [*first[1:], len(b)], strict=True) for at in range(i, j, BLOCK)]
        a_left, a_right, a_low, a_high, a_home = left[a], right[a], low[a], high[a], home[a]
        for block in np.split(b, cuts[1:]) if len(a) and len(b) else ():
            b_left, b_right, b_low, b_high = left[block], right[block], low[block], high[block]
            near = (a_left < b_right.max()) & (a_right > b_left.min()) & (a_low < b_high.max()) & (a_high > b_low.min())
            every = near & (a_left < b_right.min()) & (a_right > b_left.max()) & (a_low < b_high.min()) & (a_high > b_low.max())
            if not home[block].all():
                every &= a_home
                near &= a_home | home[block].any()
            for part in _parts(a[every]):
                yield own[part], np.full(len(part), len(block)), np.tile(own[block], len(part))
            for part in _parts(a[near & ~every]):
                yield meet(part, block, False)


def _parts(a: np.ndarray) -> list[np.ndarray]:
    """So many at once that they make at most MOST / 4 pairs with a block."""
    return [a[at : at + MOST // 4 // BLOCK] for at in range(0, len(a), MOST // 4 // BLOCK)]


def touching_components(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, node: np.ndarray, margin_x: float, margin_y: float) -> np.ndarray:
    """The smallest node that boxes reach which lie within both margins of each other; by node (0 ..; boxes may share one).

    A sweep along x: for each stretch of y it keeps how far to the right the boxes there reach. Boxes that are there at the
    same time touch, so the farthest and one of its component are enough.
    """
    root = list(range(int(node.max(initial=-1)) + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    x2, y2 = x + w, y + h
    own = np.flatnonzero((x - x2 <= margin_x) & (y - y2 <= margin_y) & np.isfinite(x2) & np.isfinite(y2))
    own = own[np.argsort(x[own], kind="stable")]
    starts = np.unique(y[own])
    low, high = np.searchsorted(starts, y[own]), _first_beyond(starts, y2[own], margin_y)
    reach, owner = np.full(len(starts), -np.inf), np.zeros(len(starts), np.int64)
    for left, right, k, a, b in zip(x[own].tolist(), x2[own].tolist(), node[own].tolist(), low.tolist(), high.tolist(), strict=True):
        there = reach[a:b]
        met = owner[a:b][left - there <= margin_x]
        if len(met):
            if len(met) > 64:
                met = met[np.flatnonzero(np.append(True, met[1:] != met[:-1]))]
            k = find(k)
            for other in set(met.tolist()):
                if (other := find(other)) != k:
                    root[max(k, other)] = k = min(k, other)
        owner[a:b] = k
        np.maximum(there, right, out=there)
    return np.array([find(k) for k in range(len(root))], np.int64)
