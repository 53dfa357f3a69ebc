"""Order-dependent choices among the boxes of a page: suppression folds and connected images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from vitrine.operators import pairs
from vitrine.operators.geometry import TOUCH, box, iou

#: Thresholds of the three suppressions.
FLAG_IOU, DROP_IOU, CARD_IOU = 0.65, 0.55, 0.6


def suppressed(boxes: DataFrame, key: str, order: list[Column], columns: list[str], threshold: float, strict: bool = False) -> DataFrame:
    """Go through each page's boxes in order; one that overlaps a kept one by the threshold goes.

    strict: only above the threshold. A page's boxes are one array that is folded in the JVM. boxes: key, b (box struct),
    columns.
    """
    rank = [o.alias(f"_o{k}") for k, o in enumerate(order)]
    row = F.struct(*rank, "b", *columns)
    listed = boxes.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.filter("rows", lambda r: F.lit(False))
    beyond = lambda k, r: (iou(k["b"], r["b"]) > threshold) if strict else (iou(k["b"], r["b"]) >= threshold)
    seen = lambda kept, r: F.exists(kept, lambda k: beyond(k, r))
    fold = lambda kept, r: F.when(seen(kept, r), kept).otherwise(F.concat(kept, F.array(r)))
    out = listed.select(key, F.explode(F.aggregate("rows", start, fold)).alias("r"))
    return out.select(key, *[F.col(f"r.{c}").alias(c) for c in columns], F.col("r.b").alias("b"))


def flagged_duplicates(boxes: DataFrame, key: str, valid: Column, confidence: Column, columns: list[str], tie: str) -> DataFrame:
    """Valid boxes first, then by confidence; what overlaps any earlier box, a duplicate or not, is marked.

    So no order of steps is needed: a box looks for an earlier one. A page's boxes come to one task, which makes no row for
    a pair; rows alike in validity, confidence and tie are marked together.
    """
    own = [f"_{c}" for c in ("invalid", "nan", "order", "tie", "box")]
    order = -confidence.cast("double")
    placed = boxes.select(key, *columns, "b", *(c.alias(n) for c, n in zip(((~valid).cast("int"), F.isnan(order), order, F.col(tie), box("b.")), own, strict=True)))
    kept = [key, *columns, "b"]

    def mark(rows: pa.Table) -> pa.Table:
        ranks = np.array([pairs.dense_rank(rows.column(c)) for c in own[:4]])
        order = np.lexsort(ranks[::-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.append(0, (ranks[:, order[1:]] != ranks[:, order[:-1]]).any(axis=0)))
        marked = np.zeros(len(order), bool)
        marked[rank[pairs.overlapped(*pairs.box_arrays(rows.column(own[4])), rank, FLAG_IOU)]] = True
        return pa.Table.from_arrays([*(rows.column(k) for k in range(len(kept))), pa.array(marked[rank])], names=[*kept, "duplicate"])

    schema = StructType([*placed.select(*kept).schema.fields, StructField("duplicate", BooleanType())])
    return placed.groupBy(key).applyInArrow(mark, schema)


def refined_duplicates(boxes: DataFrame, key: str, vision: Column, boundary: Column, quality: Column, columns: list[str], tie: str) -> DataFrame:
    """By the composite of the three scores; duplicates go."""
    return suppressed(boxes, key, [-(0.4 * vision + 0.3 * boundary + 0.3 * quality), F.col(tie)], columns, DROP_IOU)


def larger_cards(boxes: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """The largest first; what overlaps a kept one goes."""
    return suppressed(boxes, key, [-(F.col("b.width") * F.col("b.height")), F.col(tie)], columns, CARD_IOU, strict=True)


def connected(nodes: DataFrame, key: str, id_column: str, page_width: float, page_height: float) -> DataFrame:
    """The component of each node of a page: the smallest id that boxes reach which touch or overlap. nodes: key, id, b (box
    struct). A page's boxes come to one task, which makes no row for a pair. Boxes that share an id are one node."""

    def component(rows: pa.Table) -> pa.Table:
        node = pairs.dense_rank(rows.column(1))
        label = pairs.touching_components(*pairs.box_arrays(rows.column(2)), node, TOUCH * page_width, TOUCH * page_height)
        first = np.unique(node, return_index=True)[1]
        ids = rows.column(1).take(pa.array(first))
        return pa.Table.from_arrays([rows.column(0).take(pa.array(first)), ids, ids.take(pa.array(label))], names=[key, id_column, "component"])

    types = dict(nodes.dtypes)
    schema = f"{key} {types[key]}, {id_column} {types[id_column]}, component {types[id_column]}"
    return nodes.select(key, id_column, box("b.").alias("b")).groupBy(key).applyInArrow(component, schema)
