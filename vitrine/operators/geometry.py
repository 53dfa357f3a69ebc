"""Rectangles as columns x, y, width, height: scaling, overlap, clamping, classes, and joins by place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators import pairs

#: Limits of a usable box.
MIN_SIDE, MAX_AREA, HEADER, FOOTER, BAR_ASPECT, COLUMN_ASPECT = 180, 0.85, 0.1, 0.92, 4.5, 0.22
#: Page furniture of the layout detector.
FULL_PAGE, BACKGROUND, BAR_WIDTH, BAR_HEIGHT, BAND = 0.9, 0.85, 0.8, 0.04, 0.05
#: When images touch, and how far a text may be from its image (shares of the page).
TOUCH, TOUCH_IOU, NEAR_X, NEAR_Y, OVERLAP, CAPTION_WIDTH = 0.015, 0.2, 0.04, 0.05, 0.4, 0.55
#: Strips of a page in which boxes meet, and tasks that they are dealt to at least; both change no result.
STRIPS, TASKS = 6, 400


def sides(r: Column) -> tuple[Column, Column, Column, Column]:
    return r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"]


def _zero(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def overlaps(a: Column, b: Column) -> tuple[Column, Column]:
    """Length that two boxes share on each axis."""
    ax, ay, ax2, ay2 = sides(a)
    bx, by, bx2, by2 = sides(b)
    return _zero(F.least(ax2, bx2) - F.greatest(ax, bx)), _zero(F.least(ay2, by2) - F.greatest(ay, by))


def gaps(a: Column, b: Column) -> tuple[Column, Column]:
    """Distance of two boxes on each axis."""
    ax, ay, ax2, ay2 = sides(a)
    bx, by, bx2, by2 = sides(b)
    return _zero(F.greatest(ax, bx) - F.least(ax2, bx2)), _zero(F.greatest(ay, by) - F.least(ay2, by2))


def iou(a: Column, b: Column) -> Column:
    ox, oy = overlaps(a, b)
    inter = ox * oy
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])


def scaled(r: Column, sx: Column, sy: Column) -> Column:
    return F.struct((r["x"] * sx).alias("x"), (r["y"] * sy).alias("y"), (r["width"] * sx).alias("width"), (r["height"] * sy).alias("height"))


def clamped_box(r: Column, page_width: Column, page_height: Column) -> Column:
    """The box within its page; boxes that look normalised are scaled up first; null if nothing is left."""
    unit = (r["x"] <= 1) & (r["y"] <= 1) & (r["x"] + r["width"] <= 1.01) & (r["y"] + r["height"] <= 1.01)
    one = F.lit(1.0)
    x, y, x2, y2 = sides(scaled(r, F.when(unit, page_width).otherwise(one), F.when(unit, page_height).otherwise(one)))
    within = lambda v, most: _zero(F.least(most, v))
    left, top = within(x, page_width - 1), within(y, page_height - 1)
    width, height = within(x2, page_width) - left, within(y2, page_height) - top
    inside = F.struct(left.alias("x"), top.alias("y"), width.alias("width"), height.alias("height"))
    return F.when((width > 0) & (height > 0), inside)


def box_reject(r: Column, page_width: Column, page_height: Column) -> Column:
    """Why a clamped box is of no use; null if it is."""
    aspect = r["width"] / r["height"]
    return (
        F.when(r.isNull(), "invalid_box")
        .when((r["width"] < MIN_SIDE) | (r["height"] < MIN_SIDE), "too_small")
        .when(r["width"] * r["height"] / (page_width * page_height) > MAX_AREA, "too_large")
        .when(((r["y"] + r["height"]) / page_height < HEADER) | (r["y"] / page_height > FOOTER), "header_footer")
        .when(aspect > BAR_ASPECT, "horizontal_bar")
        .when(aspect < COLUMN_ASPECT, "vertical_column")
    )


def is_furniture(r: Column, kind: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a block belongs to the page rather than to a product."""
    w, h = r["width"], r["height"]
    middle = r["y"] + h / 2
    full = ((w >= FULL_PAGE * page_width) & (h >= FULL_PAGE * page_height)) | (w * h >= BACKGROUND * page_width * page_height)
    band = (middle < BAND * page_height) | (middle > (1 - BAND) * page_height)
    return (w <= 1) | (h <= 1) | (full & (kind != "text")) | ((w >= BAR_WIDTH * page_width) & (h <= BAR_HEIGHT * page_height)) | (band & (kind != "image"))


def centers_in(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Join points (cx, cy) to the areas (x1, y1, x2, y2) of the same key that hold them; edges belong to both sides."""
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    return points.join(areas, key).where(inside)


def touching_pairs(images: DataFrame, key: str, id_column: str, page_width: float, page_height: float) -> DataFrame:
    """Pairs a < b of one page whose boxes touch or overlap. images: key, id, b (box struct). A null side limits nothing.

    A strip of a page comes to one task, where numpy makes lists in an order that keeps a file of their rows small; they become rows
    at the end. Pairs grow with the square of the boxes, so strips are dealt to many tasks however few bytes they are, and a task
    meets so few ids that a file's dictionary holds them.
    """
    cell = lambda v: F.least(F.lit(STRIPS - 1.0), F.greatest(F.lit(0.0), F.floor(v * STRIPS / page_height))).cast("int")
    x, y, x2, y2 = sides(F.col("b"))
    wide = lambda low, high: (F.coalesce(low, F.lit(-math.inf)), F.coalesce(high, F.lit(math.inf)))
    (x, x2), (y, y2) = wide(x, x2), wide(y, y2)
    # An IoU above the limit is an overlap, so the margins decide alone. Boxes can touch if, with the margin added below (a
    # little more, for rounding), they share a strip. A pair counts in the later one's first strip.
    span = F.sequence(cell(y), F.greatest(cell(y), cell(y2 + TOUCH * page_height * 1.001)))
    placed = images.where(F.col(key).isNotNull() & F.col(id_column).isNotNull())
    placed = placed.select(key, F.col(id_column).alias("a"), x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2"), cell(y).alias("_home"), F.explode(span).alias("_strip"))
    placed = placed.select(key, "_strip", "a", *(F.col(c).cast("double") for c in ("x", "y", "x2", "y2")), (F.col("_home") == F.col("_strip")).alias("home"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A strip's pairs, about pairs.MOST / 2 at once."""
        rows = pa.Table.from_batches(batches).combine_chunks()
        page, names = rows.column(0)[0], rows.column(2).combine_chunks()
        arrays = [rows.column(c).to_numpy() for c in ("x", "y", "x2", "y2", "home")]

        def batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, n, b = (np.concatenate(one) for one in zip(*found, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), names.take(pa.array(b)))
            return pa.RecordBatch.from_arrays([pa.repeat(page, len(a)), names.take(pa.array(a)), lists], names=[key, "a", "b"])

        found, n = [], 0
        for one in pairs.touching(*arrays, pairs.dense_rank(rows.column(2)), TOUCH * page_width, TOUCH * page_height):
            found.append(one)
            n += len(one[2])
            if n >= pairs.MOST // 2:
                yield batch(found)
                found, n = [], 0
        if n:
            yield batch(found)

    types = dict(placed.dtypes)
    placed = placed.repartition(max(TASKS, int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key, "_strip")
    lists = placed.groupBy(key, "_strip").applyInArrow(meet, f"{key} {types[key]}, a {types['a']}, b array<{types['a']}>")
    return lists.select(key, "a", F.explode("b").alias("b"))


def nearest_anchor(texts: DataFrame, anchors: DataFrame, key: str, text_id: str, anchor_id: str, page_width: float, page_height: float) -> DataFrame:
    """For each text the nearest image that it can be a caption or a side label of, the smaller id on ties.

    texts: key, id, t (box struct); anchors: key, id, a (box struct). Texts without such an image are left out.
    """
    texts = texts.where(F.col(key).isNotNull() & (F.col("t.width") <= CAPTION_WIDTH * page_width)).select(key, text_id, box("t.").alias("t"))
    anchors = anchors.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), anchor_id, box("a.").alias("a"))

    def meet(own: pa.Table, images: pa.Table) -> pa.Table:
        """A page's texts and images, without a row for a pair; texts that share an id are one."""
        images = images.take(pa.array(np.argsort(pairs.dense_rank(images.column(1)), kind="stable")))
        found, distance = pairs.nearest(pairs.box_arrays(own.column(2)), pairs.box_arrays(images.column(2)), NEAR_X * page_width, NEAR_Y * page_height, OVERLAP)
        some = np.flatnonzero(found >= 0)
        name = pairs.dense_rank(own.column(1))[some]
        some = some[np.lexsort((found[some], distance[some], name))]
        some = some[np.unique(np.sort(name), return_index=True)[1]]
        columns = [own.column(0).take(pa.array(some)), own.column(1).take(pa.array(some)), images.column(1).take(pa.array(found[some])), pa.array(distance[some])]
        return pa.Table.from_arrays(columns, names=[key, text_id, anchor_id, "distance"])

    types = dict(texts.dtypes) | dict(anchors.dtypes)
    schema = f"{key} {types[key]}, {text_id} {types[text_id]}, {anchor_id} {types[anchor_id]}, distance double"
    return texts.groupBy(key).cogroup(anchors.groupBy("_key")).applyInArrow(meet, schema)


def capped(rows: DataFrame, key: str, order: list[Column], searchable: Column, most: int = 18, most_searchable: int = 12) -> DataFrame:
    """The first rows of each key in rank order, at most `most`, of them at most `most_searchable` searchable ones."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("_s", searchable.cast("int")).withColumn("_n", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("_s") == 0) | (F.col("_n") <= most_searchable)).withColumn("place", F.row_number().over(w))
    return kept.where(F.col("place") <= most).drop("_s", "_n")
