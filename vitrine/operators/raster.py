"""Measures of decoded rasters (rows of width, height, channels, data), with numpy over whole images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pixel classes, gaps, card sizes, quality and boundary thresholds.
WHITE, DARK = 240, 140
GAP_DENSITY, GAP_SPAN = 0.04, 8
MIN_CARD, MIN_AREA, QUALITY = 220, 0.015, 0.6
MAX_TOTAL, MAX_SEARCHABLE = 18, 12
MAX_WIDTH, MAX_HEIGHT, MAX_SHARE, MAX_ASPECT = 750, 1000, 0.35, 3.2
BOUNDARY, VISION_FLOOR = 0.6, 0.45
MIN_IMAGE_SIDE, MAX_IMAGE_WHITE = 150, 0.92
#: Reasons after which a crop is never searchable.
SEVERE = frozenset(
    "too_small too_large mostly_white green_bar orange_bar color_bar header_footer horizontal_bar vertical_column empty_cell too_horizontal "
    "too_vertical insufficient_content card_too_large page_like_crop invalid_box invalid_json duplicate low_confidence bad_card_boundary "
    "low_boundary multi_card_crop non_product_page no_product_signal grid_detection_failed".split()
)

Box = tuple[int, int, int, int]  # x1, y1, x2, y2, all inclusive


def rounded(x: float) -> int:
    return int(np.floor(x + 0.5))


def pixels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """(height, width, 3) of a raster; a fourth channel is laid over white, one channel stands for all three."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    if channels == 4:
        alpha = raw[:, :, 3:].astype(np.float64) / 255
        return np.floor(raw[:, :, :3] * alpha + 255 * (1 - alpha) + 0.5).astype(np.uint8)
    return raw[:, :, :3]


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the pixels under each new one; every measure here is defined on the raster it gets."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image
    ys, xs = np.arange(height + 1) * h // height, np.arange(width + 1) * w // width
    total = np.zeros((h + 1, w + 1, 3))
    total[1:, 1:] = image.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    y1, x1 = np.maximum(ys[1:], ys[:-1] + 1), np.maximum(xs[1:], xs[:-1] + 1)
    area = ((y1 - ys[:-1])[:, None] * (x1 - xs[:-1])[None])[:, :, None]
    part = total[y1][:, x1] - total[ys[:-1]][:, x1] - total[y1][:, xs[:-1]] + total[ys[:-1]][:, xs[:-1]]
    return np.floor(part / area + 0.5).astype(np.uint8)


def fitted(image: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """The image at most `width` wide, and the scale."""
    scale = min(1.0, width / image.shape[1])
    return resized(image, max(1, rounded(image.shape[1] * scale)), max(1, rounded(image.shape[0] * scale))), scale


def cut(image: np.ndarray, box: Box) -> np.ndarray:
    return image[box[1] : box[3] + 1, box[0] : box[2] + 1]


def classes(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of white, green and orange pixels; no pixel is in two."""
    r, g, b = (image[:, :, k].astype(np.int16) for k in range(3))
    white = (r > WHITE) & (g > WHITE) & (b > WHITE)
    green = ~white & (g > 100) & (g > r + 40) & (g > b + 40)
    orange = ~white & ~green & (r > 180) & (g > 60) & (g < r - 20) & (b < 100) & (r > b + 60)
    return white, green, orange


def stats(image: np.ndarray) -> dict[str, float]:
    white, green, orange = (int(m.sum()) for m in classes(image))
    n = image.shape[0] * image.shape[1]
    share = lambda k, empty: k / n if n else empty
    return {"total": n, "white": white, "green": green, "orange": orange, "white_ratio": share(white, 1.0), "green_ratio": share(green, 0.0), "orange_ratio": share(orange, 0.0), "non_white_ratio": share(n - white, 0.0)}


def densities(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of pixels that are not white, by row and by column."""
    filled = ~classes(image)[0]
    return filled.mean(axis=1), filled.mean(axis=0)


def content_box(image: np.ndarray) -> Box | None:
    rows, columns = (np.flatnonzero(d > 0) for d in densities(image))
    return (int(columns[0]), int(rows[0]), int(columns[-1]), int(rows[-1])) if len(rows) else None


def central_mass(image: np.ndarray) -> float:
    """Share of the filled pixels that lie in the inner half of each axis."""
    h, w = image.shape[:2]
    filled = ~classes(image)[0]
    cx, cy, dx, dy = rounded((w - 1) / 2), rounded((h - 1) / 2), rounded(w * 0.25), rounded(h * 0.25)
    inner = filled[max(0, cy - dy) : cy + dy + 1, max(0, cx - dx) : cx + dx + 1]
    return float(inner.sum() / filled.sum()) if filled.any() else 0.0


def text_density(image: np.ndarray) -> float:
    """Changes between dark and light along rows, for each pixel; a row begins light."""
    dark = image.astype(np.int32).sum(axis=2) < 3 * DARK
    before = np.zeros_like(dark)
    before[:, 1:] = dark[:, :-1]
    return float((dark != before).mean()) if dark.size else 0.0


def gaps(density: np.ndarray, threshold: float, span: int) -> list[tuple[int, int]]:
    """Runs under the threshold, of `span` places or more."""
    low = np.concatenate([[False], density < threshold, [False]])
    edge = np.flatnonzero(low[1:] != low[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= span]


def regions(n: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the gaps leave of 0 .. n - 1."""
    starts, ends = [0, *(b + 1 for _, b in found)], [*(a - 1 for a, _ in found), n - 1]
    return [(a, b) for a, b in zip(starts, ends, strict=True) if b >= a]


def content_bands(density: np.ndarray, least_density: float, least_height: int) -> int:
    found = regions(len(density), gaps(density, 0.02, max(4, rounded(len(density) * 0.02))))
    return sum(b - a + 1 >= least_height and density[a : b + 1].mean() >= least_density for a, b in found)


def is_multi_card(image: np.ndarray) -> bool:
    """Whether several products stand one above the other."""
    tall = image.shape[0] / image.shape[1]
    if tall > 3.0:
        return True
    small = fitted(image, 360)[0]
    n = content_bands(densities(small)[0], 0.06, max(8, rounded(small.shape[0] * 0.18)))
    return n >= 3 or (tall > 1.7 and n >= 2)


def _bar(s: dict, aspect: float) -> str | None:
    if aspect < 2.0:
        return None
    return "green_bar" if s["green_ratio"] > 0.3 else "orange_bar" if s["orange_ratio"] > 0.3 else None


def _aspect_score(aspect: float, low: float, high: float) -> float:
    return 1.0 if low <= aspect <= high else max(0.0, 1 - abs(np.log(aspect)) * 0.5)


def _weak(score: float, text: float, central: float) -> str | None:
    if score >= QUALITY:
        return None
    return "text_like" if text > 0.1 else "no_central_object" if central < 0.06 else "low_quality"


def card_quality(page: np.ndarray, box: Box, scale: float) -> tuple[float, str | None]:
    """Score of a cell of a page, and why it is rejected."""
    crop = cut(page, box)
    h, w = crop.shape[:2]
    aspect, page_height = w / h, page.shape[0]
    if min(w, h) / scale < MIN_CARD:
        return 0.0, "too_small"
    if aspect > 3.2 or (aspect > 2.5 and h / scale < MIN_CARD * 1.2):
        return 0.0, "too_horizontal"
    if aspect < 0.3:
        return 0.0, "too_vertical"
    s = stats(crop)
    if s["white_ratio"] > 0.9:
        return 0.0, "mostly_white"
    if reason := _bar(s, aspect):
        return 0.0, reason
    if s["non_white_ratio"] < 0.05:
        return 0.0, "insufficient_content"
    if box[3] / page_height < 0.1 or box[1] / page_height > 0.92:
        return 0.0, "header_footer"
    share = w * h / (page.shape[0] * page.shape[1])
    if share > 0.75:
        return 0.25, "page_like_crop"
    central, text = central_mass(crop), text_density(crop)
    area = share * 30 if share < 0.02 else max(0.3, 1 - (share - 0.55) * 2) if share > 0.55 else 1.0
    leak = 1.5 * (max(0, s["green_ratio"] - 0.18) + max(0, s["orange_ratio"] - 0.18))
    parts = {0.3: min(1, s["non_white_ratio"] * 5), 0.2: min(1, central * 2.5) + _aspect_score(aspect, 0.6, 1.6) + area, 0.1: 1.0, -0.15: max(0, text - 0.09) * 5 + leak}
    score = float(np.clip(sum(k * v for k, v in parts.items()), 0, 0.95))
    return score, _weak(score, text, central)


def crop_quality(image: np.ndarray) -> tuple[float, str | None]:
    """Score of a crop on its own, and why it is rejected."""
    if not image.size:
        return 0.0, "invalid_box"
    small = fitted(image, 600)[0]
    s, aspect = stats(small), small.shape[1] / small.shape[0]
    if s["white_ratio"] > 0.92:
        return 0.0, "mostly_white"
    if s["non_white_ratio"] < 0.04:
        return 0.0, "insufficient_content"
    if reason := _bar(s, aspect):
        return 0.0, reason
    central, text = central_mass(small), text_density(small)
    leak = 1.2 * (max(0, s["green_ratio"] - 0.22) + max(0, s["orange_ratio"] - 0.22))
    parts = {0.35: min(1, s["non_white_ratio"] * 5), 0.25: min(1, central * 2.5), 0.2: _aspect_score(aspect, 0.5, 1.8) + 1.0, -0.15: max(0, text - 0.1) * 5 + leak}
    score = float(np.clip(sum(k * v for k, v in parts.items()), 0, 0.95))
    return score, _weak(score, text, central)


def indexable(score: float, reason: str | None) -> bool:
    return reason not in SEVERE and score >= QUALITY


def hard_rule(width: float, height: float, page_area: float, crop: np.ndarray | None) -> str | None:
    """Why a searchable crop cannot be a single card."""
    if width >= MAX_WIDTH and height >= MAX_HEIGHT:
        return "too_large"
    if page_area > 0 and width * height / page_area > MAX_SHARE:
        return "card_too_large"
    if height > 0 and width / height > MAX_ASPECT:
        return "horizontal_bar"
    return "multi_card_crop" if crop is not None and crop.size and is_multi_card(crop) else None


def grid_cells(image: np.ndarray, box: Box) -> list[Box]:
    """Cells between white gaps: rows first, then columns in each row."""
    x1, y1, _, _ = box
    area, out = cut(image, box), []
    for top, bottom in regions(area.shape[0], gaps(densities(area)[0], GAP_DENSITY, GAP_SPAN)):
        row = area[top : bottom + 1]
        for left, right in regions(area.shape[1], gaps(densities(row)[1], GAP_DENSITY, GAP_SPAN)):
            out.append((x1 + left, y1 + top, x1 + right, y1 + bottom))
    return out


def heuristic_candidates(image: np.ndarray) -> list[dict]:
    """The heuristic detector with the hard rules: x, y, width, height, confidence, quality_score, is_searchable, reject_reason."""
    height, width = image.shape[:2]
    small, scale = fitted(image, 800)
    whole = content_box(small)
    if whole is None:
        return []
    least, area = max(40, rounded(MIN_CARD * scale)), small.shape[0] * small.shape[1]
    big = lambda b: b[2] - b[0] + 1 >= least and b[3] - b[1] + 1 >= least
    found = [b for b in grid_cells(small, whole) if big(b) and (b[2] - b[0] + 1) * (b[3] - b[1] + 1) / area >= MIN_AREA]
    found = found or ([whole] if big(whole) else [])
    rated = [(b, *card_quality(small, b, scale)) for b in found]
    rated.sort(key=lambda r: (not indexable(r[1], r[2]), -r[1]))
    out, searchable = [], 0
    for b, score, reason in rated:
        if len(out) >= MAX_TOTAL:
            break
        good = indexable(score, reason)
        if good and searchable >= MAX_SEARCHABLE:
            continue
        searchable += good
        out.append((b, score, reason, good))
    rows = []
    for b, score, reason, good in out:
        x, y = (int(np.clip(rounded(v / scale), 0, most - 1)) for v, most in ((b[0], width), (b[1], height)))
        w, h = max(1, min(width - x, rounded((b[2] - b[0] + 1) / scale))), max(1, min(height - y, rounded((b[3] - b[1] + 1) / scale)))
        if w < MIN_CARD or h < MIN_CARD:
            continue
        rule = hard_rule(w, h, width * height, image[y : y + h, x : x + w]) if good else None
        rows.append({"x": x, "y": y, "width": w, "height": h, "confidence": 0.75, "quality_score": score, "is_searchable": good and rule is None, "reject_reason": reason or rule})
    return rows


def boundary(image: np.ndarray) -> tuple[float, str | None]:
    """How clean the edges of a crop are, and whether it is cut through a neighbour or holds two stacked cards."""
    height, width = image.shape[:2]
    if min(width, height) < 8:
        return 0.0, "invalid_box"
    scale = min(1.0, 800 / max(width, height))
    rows, columns = densities(resized(image, max(8, rounded(width * scale)), max(8, rounded(height * scale))))
    h, w = max(2, rounded(len(rows) * 0.04)), max(2, rounded(len(columns) * 0.04))
    edges = [rows[:h].mean(), rows[-h:].mean(), columns[:w].mean(), columns[-w:].mean()]
    a, b = rounded(len(rows) * 0.25), rounded(len(rows) * 0.75)
    stacked = rows[a:b].min(initial=1.0) < 0.02 and (rows[:a] > 0.15).any() and (rows[b:] > 0.15).any()
    score = 1 - min(1.0, sum(max(0.0, e - 0.05) * 1.2 for e in edges)) - (0.5 if stacked else 0.0)
    return float(np.clip(score, 0, 1)), "bad_card_boundary" if stacked or max(edges[:2]) > 0.28 else None


def refined(image: np.ndarray, box: tuple[float, float, float, float], margin: float = 0.12) -> tuple[tuple, bool, str | None]:
    """A model's box (x, y, width, height) snapped to the white gaps around it: box, whether it changed, and why (not)."""
    H, W = image.shape[:2]
    x, y, w, h = box
    edge = lambda v, d, most: (max(0, rounded(v) - d), min(most, rounded(v) + d))
    dx, dy = rounded(w * margin), rounded(h * margin)
    left, top, right, bottom = edge(x, dx, W)[0], edge(y, dy, H)[0], edge(x + w, dx, W)[1], edge(y + h, dy, H)[1]
    if right - left < 4 or bottom - top < 4:
        return box, False, "expand_invalid"
    scale = min(1.0, 800 / max(right - left, bottom - top))
    area = resized(image[top:bottom, left:right], max(4, rounded((right - left) * scale)), max(4, rounded((bottom - top) * scale)))
    axes = []
    for density, begin, extent, middle in ((densities(area)[1], left, right - left, x + w / 2), (densities(area)[0], top, bottom - top, y + h / 2)):
        ratio = len(density) / extent
        center = rounded((middle - begin) * ratio)
        if not 0 <= center < len(density):
            return box, False, "center_outside"
        low = np.flatnonzero(density < GAP_DENSITY)
        first = low[low <= center].max(initial=-1) + 1
        last = low[low >= center].min(initial=len(density)) - 1
        axes.append((first, last, begin, ratio))
    if any(last <= first for first, last, _, _ in axes):
        return box, False, "empty_refined"
    out = []
    for (first, last, begin, ratio), start, extent, most in zip(axes, (x, y), (w, h), (W, H), strict=True):
        shift = rounded(extent * 0.15)
        near = lambda v, about, s=shift: min(max(v, about - s), about + s)
        a = rounded(begin + first / ratio)
        b = a + max(1, rounded((last - first + 1) / ratio))
        a, moved = near(a, rounded(start)), near(a, rounded(start)) - a
        b = near(b + moved, rounded(start + extent))
        size = max(1, b - a)
        a = max(0, min(most - 1, a))
        out.append((a, max(1, min(most - a, size))))
    (nx, nw), (ny, nh) = out
    if nw * nh < w * h * 0.7:
        return box, False, "refined_too_small"
    if nw * nh > w * h * 1.4:
        return box, False, "refined_too_large"
    ox, oy = max(0, min(x + w, nx + nw) - max(x, nx)), max(0, min(y + h, ny + nh) - max(y, ny))
    if ox * oy / (w * h + nw * nh - ox * oy) > 0.95:
        return box, False, None
    return (nx, ny, nw, nh), True, "snap_to_card_boundary"


def valid_product_image(image: np.ndarray) -> bool:
    return min(image.shape[:2]) >= MIN_IMAGE_SIDE and stats(image)["white_ratio"] <= MAX_IMAGE_WHITE


def measured(rasters: DataFrame, key: str, measure: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """Rows that `measure` makes of each decoded raster, with its key. A raster that can't be decoded gives none."""
    names = [part.split()[0] for part in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, w, h, c, data in batch[[key, "width", "height", "channels", "data"]].itertuples(index=False):
                if data is not None and w > 0 and h > 0 and len(data) == w * h * c:
                    rows += [{key: k} | r for r in measure(pixels(data, int(w), int(h), int(c)))]
            yield pd.DataFrame(rows, columns=[key, *names])

    return rasters.mapInPandas(work, f"{key} {dict(rasters.dtypes)[key]}, {schema}")


STATS = "total long, white long, green long, orange long, central double, text double"


def raster_stats(rasters: DataFrame, key: str) -> DataFrame:
    row = lambda image: [{k: v for k, v in stats(image).items() if k in ("total", "white", "green", "orange")} | {"central": central_mass(image), "text": text_density(image)}]
    return measured(rasters, key, row, STATS)


CANDIDATES = "x int, y int, width int, height int, confidence double, quality_score double, is_searchable boolean, reject_reason string"


def heuristic(rasters: DataFrame, key: str) -> DataFrame:
    return measured(rasters, key, heuristic_candidates, CANDIDATES)
