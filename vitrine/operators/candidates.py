"""Candidates from boxes and page images, and the cascade run end to end over layouts, rasters and model answers.

rasters: page_id, width, height, channels, data. A page's image meets its boxes once, in a cogroup by page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.signals import is_non_product, signals
from vitrine.operators import boxes as B
from vitrine.operators import cascade, layout, raster
from vitrine.operators import geometry as G
from vitrine.sources.sinks import settled

CANDIDATE = "page_id bigint, box_id bigint, x int, y int, width int, height int, confidence double, quality_score double, quality_reason string, has_content boolean, rule string"
COLUMNS = ["page_id", "candidate_id", "x", "y", "width", "height", "confidence", "quality_score", "is_searchable", "reject_reason", "source_detector"]


def _crop(image: np.ndarray, x: float, y: float, w: float, h: float) -> tuple[int, int, int, int, np.ndarray]:
    height, width = image.shape[:2]
    left, top = int(np.clip(raster.rounded(x), 0, width - 1)), int(np.clip(raster.rounded(y), 0, height - 1))
    w, h = max(1, min(width - left, raster.rounded(w))), max(1, min(height - top, raster.rounded(h)))
    return left, top, w, h, image[top : top + h, left : left + w]


def _image(row) -> np.ndarray | None:
    if row.data is None or len(row.data) != row.width * row.height * row.channels:
        return None
    return raster.pixels(row.data, int(row.width), int(row.height), int(row.channels))


def crops(found: DataFrame, rasters: DataFrame) -> DataFrame:
    """Boxes (page_id, box_id, x, y, width, height, confidence) as whole-pixel crops with their quality and hard rule."""

    def measure(own: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        image = _image(next(pages.itertuples())) if len(pages) else None
        if image is not None:
            for b in own.sort_values("box_id").itertuples():
                x, y, w, h, crop = _crop(image, b.x, b.y, b.width, b.height)
                score, reason = raster.crop_quality(crop)
                content = raster.stats(raster.resized(crop, 80, 80))["non_white_ratio"] >= 0.05
                rule = raster.hard_rule(w, h, image.shape[0] * image.shape[1], crop)
                rows.append((b.page_id, b.box_id, x, y, w, h, b.confidence, score, reason, content, rule))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    own = found.select(F.col("page_id").cast("long"), F.col("box_id").cast("long"), *[F.col(c).cast("double") for c in ("x", "y", "width", "height", "confidence")])
    pages = rasters.select(F.col("page_id").cast("long").alias("_page"), "width", "height", "channels", "data")
    return own.groupBy("page_id").cogroup(pages.groupBy("_page")).applyInPandas(measure, CANDIDATE)


def layout_candidates(found: DataFrame, rasters: DataFrame, blocks: DataFrame, sizes: DataFrame, detector: str) -> DataFrame:
    """Validated candidates of a layout detector's boxes: quality first, then the signals of the text inside, then the hard rules."""
    texted = layout.text_in_boxes(blocks, sizes, crops(found, rasters))
    verdict = cascade.crop_verdict(signals(F.col("box_text")), F.col("has_content"))
    wide = texted.withColumn("v", verdict)
    good = cascade.should_index(F.col("quality_score"), F.col("quality_reason")) & F.col("v.valid")
    reason = F.coalesce("quality_reason", "v.reason")
    out = wide.withColumns({"_good": good, "_reason": reason})
    return out.select("page_id", F.col("box_id").alias("candidate_id"), "x", "y", "width", "height", "confidence", "quality_score", (F.col("_good") & F.col("rule").isNull()).alias("is_searchable"), F.coalesce("_reason", F.when(F.col("_good"), F.col("rule"))).alias("reject_reason"), F.lit(detector).alias("source_detector"))


def split_composites(found: DataFrame, rasters: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Card candidates in which a composite that splits into two or more searchable parts gives way to these."""
    whole = settled(layout_candidates(found, rasters, blocks, sizes, "PDF_LAYOUT"))
    composite = whole.where("reject_reason = 'multi_card_crop'").select("page_id", F.col("candidate_id").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    parts = layout.split_boxes(blocks, sizes, composite)
    # A part's id holds its composite's, so parts find back to it.
    parts = parts.withColumns({"parent": F.col("box_id"), "box_id": (F.col("box_id") + 1) * 1000 + F.pmod(F.xxhash64("x", "y"), F.lit(997))})
    rated = layout_candidates(settled(parts), rasters, blocks, sizes, "PDF_LAYOUT").where("is_searchable").withColumn("parent", F.expr("candidate_id div 1000 - 1"))
    enough = rated.groupBy("page_id", "parent").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("page_id", "parent")
    kept = rated.join(enough, ["page_id", "parent"], "left_semi").select(*COLUMNS)
    gone = enough.select("page_id", F.col("parent").alias("candidate_id"))
    return whole.join(gone, ["page_id", "candidate_id"], "left_anti").select(*COLUMNS).unionByName(kept)


def vision_candidates(answers: DataFrame, rasters: DataFrame, detector: str) -> DataFrame:
    """Candidates of a model's boxes. answers: page_id, boxes array<struct<x, y, width, height, confidence>> in page pixels.

    Boxes are clamped and classed, duplicates flagged, the others snapped to white gaps, duplicates of the snapped ones
    dropped (all that count then is the model's confidence), and what is left is cropped and rated.
    """
    page = rasters.select(F.col("page_id").alias("_p"), F.col("width").cast("double").alias("page_width"), F.col("height").cast("double").alias("page_height"))
    listed = answers.select("page_id", F.posexplode("boxes").alias("box_id", "m")).join(page, F.col("page_id") == F.col("_p")).drop("_p")
    raw = F.struct(*[F.col(f"m.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])
    placed = listed.withColumn("c", G.clamped_box(raw, F.col("page_width"), F.col("page_height")))
    placed = placed.withColumns({"why": G.box_reject(F.col("c"), F.col("page_width"), F.col("page_height")), "b": F.coalesce("c", raw), "confidence": F.col("m.confidence")})
    flagged = B.flagged_duplicates(placed, "page_id", F.col("why").isNull(), F.col("confidence"), ["box_id", "confidence", "why"], "box_id")
    flagged = flagged.withColumn("why", F.coalesce("why", F.when(F.col("duplicate"), "duplicate")))

    def snap(own: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        image = _image(next(pages.itertuples())) if len(pages) else None
        for b in own.sort_values("box_id").itertuples():
            box = (b.x, b.y, b.width, b.height)
            if image is not None and b.why is None:
                box = raster.refined(image, box)[0]
            rows.append((b.page_id, b.box_id, *map(float, box), b.confidence, b.why))
        return pd.DataFrame(rows, columns=["page_id", "box_id", "x", "y", "width", "height", "confidence", "why"])

    def rate(own: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        image = _image(next(pages.itertuples())) if len(pages) else None
        for b in own.sort_values("box_id").itertuples() if image is not None else ():
            x, y, w, h, crop = _crop(image, b.x, b.y, b.width, b.height)
            score, why, edge = 0.0, b.why, 0.0
            if why is None:
                score, why = raster.crop_quality(crop)
            if why is None:
                edge, why = raster.boundary(crop)
            rows.append((b.page_id, b.box_id, x, y, w, h, b.confidence, score, edge, why))
        return pd.DataFrame(rows, columns=["page_id", "candidate_id", "x", "y", "width", "height", "confidence", "quality_score", "boundary_score", "why"])

    pages = rasters.select(F.col("page_id").cast("long").alias("_page"), "width", "height", "channels", "data")
    flat = flagged.select(F.col("page_id").cast("long").alias("page_id"), F.col("box_id").cast("long").alias("box_id"), "b.*", "confidence", "why")
    box = "page_id bigint, box_id bigint, x double, y double, width double, height double, confidence double, why string"
    snapped = flat.groupBy("page_id").cogroup(pages.groupBy("_page")).applyInPandas(snap, box).withColumn("b", G.box())
    zero = F.lit(0.0)
    kept = B.refined_duplicates(snapped, "page_id", F.col("confidence"), zero, zero, ["box_id", "confidence", "why"], "box_id").select("page_id", "box_id", "b.*", "confidence", "why")
    rated = kept.groupBy("page_id").cogroup(pages.groupBy("_page")).applyInPandas(rate, "page_id bigint, candidate_id bigint, x int, y int, width int, height int, confidence double, quality_score double, boundary_score double, why string")
    searchable, why = cascade.vision_verdict(F.col("why"), F.col("quality_score"), F.col("boundary_score"), F.col("confidence"))
    return rated.select(*[c for c in COLUMNS if c not in ("is_searchable", "reject_reason", "source_detector")], searchable.alias("is_searchable"), why.alias("reject_reason"), F.lit(detector).alias("source_detector"))


def detect(facts: DataFrame, blocks: DataFrame, sizes: DataFrame, rasters: DataFrame, image_width: float, image_height: float) -> tuple[DataFrame, DataFrame]:
    """The cascade without models: (decisions, candidates). facts: as layout.page_facts gives them.

    Cover and index pages are skipped; then the grid, the cards and the heuristic are tried in turn, each only on the
    pages that the tiers before have left.
    """
    pages = settled(facts.select("page_id", "page_type", "expected"))
    skipped = pages.where(is_non_product(F.col("page_type")))
    left = pages.join(skipped, "page_id", "left_anti")
    own = lambda df, some: df.join(some.select("page_id"), "page_id", "left_semi")
    grid_boxes = layout.grid_boxes(own(blocks, left), sizes, left).withColumn("box_id", F.col("r") * 1000 + F.col("c"))
    grid = settled(layout_candidates(settled(grid_boxes), own(rasters, left), blocks, sizes, "GRID_LAYOUT"))
    grid_good = settled(cascade.structural_gate(left, grid).where("good").select("page_id"))
    left = left.join(grid_good, "page_id", "left_anti")
    card_boxes = layout.card_boxes(own(blocks, left), sizes, image_width, image_height).withColumn("box_id", F.col("card_id"))
    cards = settled(split_composites(settled(card_boxes), own(rasters, left), blocks, sizes))
    card_good = settled(cascade.structural_gate(left, cards).where("good").select("page_id"))
    left = left.join(card_good, "page_id", "left_anti")
    heuristic = raster.heuristic(own(rasters, left), "page_id").withColumns({"candidate_id": F.monotonically_increasing_id(), "source_detector": F.lit("HEURISTIC")})
    decided = skipped.select("page_id", F.lit("PAGE_SKIP").alias("decision")).unionByName(grid_good.select("page_id", F.lit("GRID_LAYOUT").alias("decision")))
    decided = decided.unionByName(card_good.select("page_id", F.lit("PDF_LAYOUT").alias("decision"))).unionByName(left.select("page_id", F.lit("HEURISTIC").alias("decision")))
    found = own(grid, grid_good).select(*COLUMNS).unionByName(own(cards, card_good).select(*COLUMNS)).unionByName(heuristic.select(*COLUMNS))
    return decided, found
