"""Product boxes from a page's layout: the grid of signals, cards around images, and the split of composite cards.

blocks: page_id, block_id, type (text, image, drawing), x, y, width, height (points), text. sizes: page_id, page_width,
page_height (points), image_width, image_height (pixels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.signals import GRID_TYPES, has_signal, page_type, product_count, signals
from vitrine.functions.text import collapsed
from vitrine.operators import geometry as G
from vitrine.operators.boxes import connected, larger_cards
from vitrine.operators.intervals import cells, clusters

#: Fixed values of the grid: page bands, gaps between columns and rows, growth, smallest cell, confidence.
BAND, COLUMN_GAP, ROW_GAP, GRID_GROW, CELL_WIDTH, CELL_HEIGHT, GRID_CONFIDENCE = 0.05, 0.1, 0.06, 0.04, 0.08, 0.05, 0.9
#: Fixed values of cards: growth, smallest and largest card, longest side ratio, confidence, characters of text.
CARD_GROW, CARD_WIDTH, CARD_HEIGHT, CARD_AREA, CARD_ASPECT, CARD_CONFIDENCE, CARD_TEXT = 0.03, 0.08, 0.05, 0.6, 4.0, 0.85, 160
#: Fixed values of the split: gap between centers as a share of the box, smallest side in pixels, confidence.
SPLIT_GAP, SPLIT_SIDE, SPLIT_CONFIDENCE = 0.18, 8, 0.8


def in_pixels(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks with b, their box in pixels of the page image, and its center."""
    good = sizes.where("page_width > 0 and page_height > 0 and image_width > 0 and image_height > 0")
    wide = blocks.join(good, "page_id")
    b = G.scaled(G.box(), F.col("image_width") / F.col("page_width"), F.col("image_height") / F.col("page_height"))
    return wide.withColumn("b", b).withColumns({"cx": F.expr("b.x + b.width / 2"), "cy": F.expr("b.y + b.height / 2")})


def page_facts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text, signals, number of expected products and type of every page. pages: page_id, page_width, page_height, has_layout."""
    share = F.col("width") * F.col("height")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("type") == "text") & (F.col("text") != ""), F.struct("block_id", "text")))), lambda t: t["text"]), "\n")
    own = blocks.groupBy("page_id").agg(text.alias("page_text"), F.count_if(F.col("type") == "image").alias("images"), F.max(F.when(F.col("type") == "image", share)).alias("_largest"))
    wide = pages.join(own, "page_id", "left")
    area = F.col("page_width") * F.col("page_height")
    fraction = F.when(area > 0, F.coalesce(F.col("_largest"), F.lit(0.0)) / area).otherwise(F.lit(0.0))
    wide = wide.withColumns({"signals": signals(F.col("page_text")), "image_fraction": fraction, "images": F.coalesce("images", F.lit(0))})
    kind = page_type(F.col("signals"), F.col("page_text"), F.col("images"), F.col("image_fraction"), F.col("has_layout"))
    return wide.withColumns({"expected": product_count(F.col("signals")), "page_type": kind}).drop("_largest")


def text_in_boxes(blocks: DataFrame, sizes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text of the blocks whose center lies in each box, one to a line. boxes: page_id, box_id, x, y, width, height."""
    areas = boxes.select("page_id", "box_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("x + width").alias("x2"), F.expr("y + height").alias("y2"))
    texts = in_pixels(blocks.where("type = 'text' and text <> ''"), sizes).select("page_id", "block_id", "text", "cx", "cy")
    met = G.centers_in(texts, areas, "page_id").groupBy("page_id", "box_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("t"))
    found = met.select("page_id", "box_id", F.array_join(F.transform("t", lambda t: t["text"]), "\n").alias("box_text"))
    return boxes.join(found, ["page_id", "box_id"], "left").withColumn("box_text", F.coalesce("box_text", F.lit("")))


def grid_boxes(blocks: DataFrame, sizes: DataFrame, types: DataFrame) -> DataFrame:
    """One box for each grid cell with a signal: page_id, r, c, x, y, width, height, confidence. types: page_id, page_type."""
    items = in_pixels(blocks.where("type in ('text', 'image')"), sizes).join(types.where(F.col("page_type").isin(*GRID_TYPES)).select("page_id"), "page_id", "left_semi")
    items = items.where(F.col("cy").between(BAND * F.col("image_height"), (1 - BAND) * F.col("image_height")))
    marked = (F.col("type") == "text") & (F.coalesce(F.col("text"), F.lit("")) != "") & has_signal(signals(F.col("text")))
    items = items.withColumn("signal", marked).withColumn("counts", F.col("signal") | (F.col("type") == "image"))
    marks = items.where("signal")
    enough = marks.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("page_id")
    own = lambda edge, inner: F.coalesce(edge(F.when(F.col("counts"), inner)), F.lit(0.0))
    envelope = items.join(enough, "page_id", "left_semi").groupBy("page_id", "image_width", "image_height").agg(
        F.greatest(F.lit(0.0), own(F.min, F.expr("b.x"))).alias("left"), F.greatest(F.lit(0.0), own(F.min, F.expr("b.y"))).alias("top"),
        F.least(F.col("image_width"), own(F.max, F.expr("b.x + b.width"))).alias("right"), F.least(F.col("image_height"), own(F.max, F.expr("b.y + b.height"))).alias("bottom"),
    )
    marks = marks.join(enough, "page_id", "left_semi")

    def axis(value: str, extent: str, share: float, low: str, high: str, names: tuple[str, str, str]) -> DataFrame:
        found = clusters(marks.select("page_id", extent, value), ["page_id", extent], value, share * F.col(extent))
        around = cells(found.join(envelope.select("page_id", low, high), "page_id"), ["page_id"], F.col(low), F.col(high))
        number = F.row_number().over(Window.partitionBy("page_id").orderBy("center"))
        return around.select("page_id", number.alias(names[0]), F.col("lo").alias(names[1]), F.col("hi").alias(names[2]))

    columns = axis("cx", "image_width", COLUMN_GAP, "left", "right", ("c", "x1", "x2"))
    rows = axis("cy", "image_height", ROW_GAP, "top", "bottom", ("r", "y1", "y2"))
    areas = rows.join(columns, "page_id")
    met = G.centers_in(items.where("counts"), areas, "page_id").groupBy("page_id", "r", "c", "x1", "y1", "x2", "y2", "image_width", "image_height")
    tight = met.agg(F.max("signal").alias("signal"), F.min("b.x").alias("bx1"), F.min("b.y").alias("by1"), F.max(F.expr("b.x + b.width")).alias("bx2"), F.max(F.expr("b.y + b.height")).alias("by2")).where("signal")
    for side, pick, cell in (("bx1", F.greatest, "x1"), ("by1", F.greatest, "y1"), ("bx2", F.least, "x2"), ("by2", F.least, "y2")):
        tight = tight.withColumn(side, pick(side, cell))
    w, h = GRID_GROW * (F.col("bx2") - F.col("bx1")), GRID_GROW * (F.col("by2") - F.col("by1"))
    grown = tight.select(
        "page_id", "r", "c", "image_width", "image_height",
        F.greatest(F.col("x1"), F.col("bx1") - w).alias("x"), F.greatest(F.col("y1"), F.col("by1") - h).alias("y"),
        F.least(F.col("x2"), F.col("bx2") + w).alias("_x2"), F.least(F.col("y2"), F.col("by2") + h).alias("_y2"),
    )
    sized = grown.withColumns({"width": F.col("_x2") - F.col("x"), "height": F.col("_y2") - F.col("y")})
    sized = sized.where((F.col("width") >= CELL_WIDTH * F.col("image_width")) & (F.col("height") >= CELL_HEIGHT * F.col("image_height")))
    return sized.select("page_id", "r", "c", "x", "y", "width", "height", F.lit(GRID_CONFIDENCE).alias("confidence"))


def card_boxes(blocks: DataFrame, sizes: DataFrame, image_width: float, image_height: float) -> DataFrame:
    """A card for each product photo with its texts: page_id, card_id, x, y, width, height, confidence, text.

    All pages have images of one size here; the shares of the page are of that size.
    """
    W, H = float(image_width), float(image_height)
    usable = in_pixels(blocks, sizes).where(~G.is_furniture(F.col("b"), F.col("type"), F.lit(W), F.lit(H)))
    images = usable.where("type = 'image'").select("page_id", "block_id", "b")
    part = connected(images, "page_id", "block_id", W, H)
    hull = lambda c: F.struct(F.min(f"{c}.x").alias("x"), F.min(f"{c}.y").alias("y"), (F.max(F.expr(f"{c}.x + {c}.width")) - F.min(f"{c}.x")).alias("width"), (F.max(F.expr(f"{c}.y + {c}.height")) - F.min(f"{c}.y")).alias("height"))
    anchors = images.join(part, ["page_id", "block_id"]).groupBy("page_id", F.col("component").alias("card_id")).agg(hull("b").alias("a"))
    texts = usable.where("type = 'text'").select("page_id", "block_id", "text", F.col("b").alias("t"))
    near = G.nearest_anchor(texts, anchors, "page_id", "block_id", "card_id", W, H).join(texts, ["page_id", "block_id"])
    members = anchors.select("page_id", "card_id", F.col("a").alias("m"), F.lit(None).cast("long").alias("block_id"), F.lit(None).cast("string").alias("text"))
    members = members.unionByName(near.select("page_id", "card_id", F.col("t").alias("m"), F.col("block_id").cast("long").alias("block_id"), "text"))
    said = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.struct("block_id", "text"))))
    cards = members.groupBy("page_id", "card_id").agg(hull("m").alias("h"), F.array_join(F.transform(said, lambda t: t["text"]), " ").alias("said"))
    x, y, x2, y2 = G.sides(F.col("h"))
    ew, eh = CARD_GROW * F.col("h.width"), CARD_GROW * F.col("h.height")
    cards = cards.withColumns({"x": F.greatest(F.lit(0.0), x - ew), "y": F.greatest(F.lit(0.0), y - eh), "_x2": F.least(F.lit(W), x2 + ew), "_y2": F.least(F.lit(H), y2 + eh)})
    cards = cards.withColumns({"width": F.col("_x2") - F.col("x"), "height": F.col("_y2") - F.col("y")})
    aspect = F.col("width") / F.col("height")
    good = (F.col("width") >= CARD_WIDTH * W) & (F.col("height") >= CARD_HEIGHT * H) & (F.col("width") * F.col("height") <= CARD_AREA * W * H)
    cards = cards.where(good & (aspect <= CARD_ASPECT) & (aspect >= 1 / CARD_ASPECT)).withColumn("b", G.box())
    cards = cards.withColumn("text", F.nullif(collapsed(F.col("said"), CARD_TEXT), F.lit("")))
    kept = larger_cards(cards, "page_id", ["card_id", "text"], "card_id")
    return kept.select("page_id", "card_id", "b.*", F.lit(CARD_CONFIDENCE).alias("confidence"), "text")


def split_boxes(blocks: DataFrame, sizes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells of a composite box by the signals in it; only where there are two or more. boxes: page_id, box_id, x, y, width, height."""
    areas = boxes.select("page_id", "box_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("x + width").alias("x2"), F.expr("y + height").alias("y2"))
    texts = in_pixels(blocks.where("type = 'text' and text <> ''"), sizes).where(has_signal(signals(F.col("text")))).select("page_id", "cx", "cy")
    key = ["page_id", "box_id"]
    marks = G.centers_in(texts, areas, "page_id")

    def axis(value: str, low: str, high: str, names: tuple[str, str]) -> DataFrame:
        found = clusters(marks.select(*key, low, high, value), [*key, low, high], value, SPLIT_GAP * (F.col(high) - F.col(low)))
        around = cells(found, key, F.col(low), F.col(high))
        return around.select(*key, F.col("lo").alias(names[0]), F.col("hi").alias(names[1]))

    parts = axis("cy", "y1", "y2", ("cy1", "cy2")).join(axis("cx", "x1", "x2", ("cx1", "cx2")), key)
    inside = F.col("cx").between(F.col("cx1"), F.col("cx2")) & F.col("cy").between(F.col("cy1"), F.col("cy2"))
    filled = parts.join(marks.select(*key, "cx", "cy"), key).where(inside).select(*key, "cx1", "cy1", "cx2", "cy2").distinct()
    filled = filled.where((F.col("cx2") - F.col("cx1") >= SPLIT_SIDE) & (F.col("cy2") - F.col("cy1") >= SPLIT_SIDE))
    counted = filled.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("n >= 2")
    return counted.select(*key, F.col("cx1").alias("x"), F.col("cy1").alias("y"), F.expr("cx2 - cx1").alias("width"), F.expr("cy2 - cy1").alias("height"), F.lit(SPLIT_CONFIDENCE).alias("confidence"))
