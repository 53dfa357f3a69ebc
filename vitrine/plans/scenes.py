"""Queries over drawn rasters: measures of crops and cards, snapping, the detectors that look at pixels.

A scene is 60 x 48: cells in rows and columns on white, as many, as large and of such colours as the page's number gives.
A page is 800 x 1000, with cells of 320 x 280.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import candidates, cascade, raster
from vitrine.plans.views import view

WIDTH, HEIGHT = 60, 48
#: What is cut out of a scene, x1, y1, x2, y2 (inclusive).
CROPS = {"whole": (0, 0, 59, 47), "left": (0, 0, 29, 47), "slim": (4, 0, 27, 47), "strip": (4, 0, 17, 47), "top": (0, 0, 59, 16), "cell": (2, 1, 30, 17), "cut": (10, 5, 40, 40), "narrow": (4, 0, 12, 47), "low": (0, 45, 59, 47), "wide": (0, 0, 40, 17)}
#: Pixels of a scene stand for so many of its page.
SCALE = 0.04


def scene(p: int) -> np.ndarray:
    image = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    for r in range(1 + p % 3):
        for c in range(1 + p % 2):
            x, y, w, h = 4 + c * 28, 3 + r * 15, 22 + p % 5, 10 + p % 4
            cell = image[y : y + h, x : x + w]
            kind = p % 7
            if kind == 3:
                cell[:, (np.arange(x, x + w) % 2) == 0] = 20
            elif kind == 6:
                cell[:] = np.stack([np.arange(y, y + h) * 5, np.full(h, 100), np.full(h, 50)], axis=1)[:, None]
            else:
                cell[:] = {0: (60, 90, 120), 1: (20, 180, 40), 2: (230, 120, 30), 4: (245, 245, 245), 5: (200, 200, 200)}[kind]
    return image


def page_image(k: int) -> np.ndarray:
    image = np.full((1000, 800, 3), 255, np.uint8)
    for r in range(1 + k % 3):
        for c in range(1 + k % 2):
            image[40 + r * 310 : 320 + r * 310, 40 + c * 370 : 360 + c * 370] = (60 + k % 40, 90, 120 + r * 20)
    return image


def _rasters(spark: SparkSession, sf_dir: str, draw) -> DataFrame:
    pages = view(spark, sf_dir, "v_box").select("page_id").distinct()

    def work(batches):
        for batch in batches:
            for k in batch["page_id"]:  # a frame each: a page takes 2.4 MB
                image = draw(int(k))
                yield pd.DataFrame([(k, image.shape[1], image.shape[0], 3, image.tobytes())], columns=["page_id", "width", "height", "channels", "data"])

    return pages.mapInPandas(work, "page_id bigint, width int, height int, channels int, data binary")


def _each(image: np.ndarray, names, measure) -> list[dict]:
    return [{"crop": n} | measure(raster.cut(image, CROPS[n])) for n in names]


def content_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of what is not white, the share of it in the middle, and the densest row and column."""

    def measure(image: np.ndarray) -> list[dict]:
        box = raster.content_box(image) or (None,) * 4
        rows, columns = raster.densities(image)
        return [dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)) | {"central": round(raster.central_mass(image), 6), "rows": round(float(rows.max()), 6), "columns": round(float(columns.max()), 6)}]

    return raster.measured(_rasters(spark, sf_dir, scene), "page_id", measure, "x1 long, y1 long, x2 long, y2 long, central double, rows double, columns double")


def crop_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of crops, why they are rejected, and whether they go into the index."""

    def measure(crop: np.ndarray) -> dict:
        score, reason = raster.crop_quality(crop)
        return {"score": score, "reason": reason}

    out = raster.measured(_rasters(spark, sf_dir, scene), "page_id", lambda i: _each(i, ("whole", "left", "top", "cell", "cut"), measure), "crop string, score double, reason string")
    good = cascade.should_index(F.col("score"), F.col("reason"))
    return out.select("page_id", "crop", F.round("score", 9).alias("score"), "reason", good.alias("good"))


def card_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of cells of a page, and why they are rejected."""

    def measure(image: np.ndarray) -> list[dict]:
        out = []
        for name in ("whole", "top", "cell", "cut", "narrow", "low", "wide"):
            score, reason = raster.card_quality(image, CROPS[name], SCALE)
            out.append({"crop": name, "score": round(score, 9), "reason": reason})
        return out

    return raster.measured(_rasters(spark, sf_dir, scene), "page_id", measure, "crop string, score double, reason string")


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How clean the edges of crops are."""

    def measure(crop: np.ndarray) -> dict:
        score, reason = raster.boundary(crop)
        return {"score": round(score, 9), "reason": reason}

    return raster.measured(_rasters(spark, sf_dir, scene), "page_id", lambda i: _each(i, ("whole", "left", "slim", "cell", "cut"), measure), "crop string, score double, reason string")


def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether crops hold several cards, and which hard rule they break at the size that the page's number gives."""

    def measure(image: np.ndarray) -> list[dict]:
        rows = []
        for name in ("whole", "left", "slim", "strip", "cut"):
            crop = raster.cut(image, CROPS[name])
            rows.append({"crop": name, "multi": bool(raster.is_multi_card(crop)), "pixels": crop})
        return rows

    def rated(k: int) -> list[dict]:
        w, h = 100 * (1 + k % 11), 100 * (1 + k % 13)
        return [{"crop": r["crop"], "multi": r["multi"], "rule": raster.hard_rule(w, h, 2_000_000, r["pixels"])} for r in measure(scene(k))]

    def work(batches):
        for batch in batches:
            rows = [{"page_id": k} | r for k in batch["page_id"] for r in rated(int(k))]
            yield pd.DataFrame(rows, columns=["page_id", "crop", "multi", "rule"])

    return view(spark, sf_dir, "v_box").select("page_id").distinct().mapInPandas(work, "page_id bigint, crop string, multi boolean, rule string")


def refined_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's boxes about the first cell, snapped to the white around it."""

    def work(batches):
        for batch in batches:
            rows = []
            for k in map(int, batch["page_id"]):
                for way, (dx, dy, dw, dh) in enumerate(((-1, -1, 2, 2), (1, 1, 0, 0), (-3, 0, 9, 1), (2, 2, -4, -4), (-2, -2, 30, 20))):
                    box = (4.0 + dx, 3.0 + dy, 22.0 + k % 5 + dw, 10.0 + k % 4 + dh)
                    (x, y, w, h), changed, reason = raster.refined(scene(k), box)
                    rows.append((k, way, float(x), float(y), float(w), float(h), changed, reason))
            yield pd.DataFrame(rows, columns=["page_id", "way", "x", "y", "width", "height", "changed", "reason"])

    return view(spark, sf_dir, "v_box").select("page_id").distinct().mapInPandas(work, "page_id bigint, way int, x double, y double, width double, height double, changed boolean, reason string")


def product_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pieces of a page can be a product's image: a cell, as large as the page's number gives, white, and low ones."""

    def measure(image: np.ndarray) -> list[dict]:
        shade = int(image[50, 50, 0]) - 60  # 0 .. 39
        n = 130 + shade
        pieces = {"cell": image[40 : 40 + n, 40 : 40 + n], "white": image[960:1000, :], "corner": image[:200, :n], "low": image[40:180, 40:360]}
        return [{"piece": k, "side": min(v.shape[:2]), "valid": bool(raster.valid_product_image(v))} for k, v in pieces.items()]

    return raster.measured(_rasters(spark, sf_dir, page_image), "page_id", measure, "piece string, side long, valid boolean")


def heuristic_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristic detector on drawn pages."""
    found = raster.heuristic(_rasters(spark, sf_dir, page_image), "page_id")
    return found.withColumn("quality_score", F.round("quality_score", 6))


def vision_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a model's boxes on drawn pages: about every cell one with a margin, one that repeats it, a small one."""
    pages = view(spark, sf_dir, "v_box").select("page_id").distinct()
    cell = lambda r, c, dx, dy, w, h, s: F.struct((c * 370 + dx).cast("double").alias("x"), (r * 310 + dy).cast("double").alias("y"), F.lit(w).cast("double").alias("width"), F.lit(h).cast("double").alias("height"), F.lit(s).alias("confidence"))
    three = lambda r, c: F.array(cell(r, c, 10, 10, 380, 340, 0.9), cell(r, c, 15, 10, 380, 340, 0.8), cell(r, c, 100, 100, 20, 20, 0.9))
    rows, columns = F.sequence(F.lit(0), F.col("page_id") % 3), F.sequence(F.lit(0), F.col("page_id") % 2)
    boxes = F.flatten(F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: three(r, c)))))
    found = candidates.vision_candidates(pages.select("page_id", boxes.alias("boxes")), _rasters(spark, sf_dir, page_image), "VISION_BOXES_CHEAP")
    return found.select("page_id", "candidate_id", "x", "y", "width", "height", "confidence", F.round("quality_score", 6).alias("quality_score"), "is_searchable", "reject_reason", "source_detector")


QUERIES = {f.__name__: f for f in (content_boxes, crop_quality, card_quality, boundary_scores, hard_rules, refined_boxes, product_images, heuristic_detector, vision_runner)}
