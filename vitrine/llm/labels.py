"""Bounded samples of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class, and bytes of their texts in all, that a sample takes at most. Scoring takes whole texts of all
#: documents.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 6 << 20
#: Ids that are broadcast at most, 12 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1 << 17


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _within(found: list, most: int) -> list:
    """The first rows whose bytes add up to `most`; a text that alone has more can be in no bounded sample."""
    taken, used = [], 0
    for row in found:
        if row["size"] > most:
            continue
        used += row["size"]
        if used > most:
            break
        taken.append(row)
    return taken


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[tuple[int, str, int]], float | None]:
    """(doc_id, text, label) rows and the share of ones among all usable labels (None: no labels).

    Of each class the labelled documents with a text that are not held out come in the order of a hash of the doc_id;
    the first `rows` of them are taken, or as many as have `most` bytes together. No text is left out for its length
    (but one of more than `most` bytes), and ids without a text take no place. At most 2 * most bytes come to the
    driver, as many as that for any number of documents. Rows whose label is null or not 0 or 1 take no part; of several
    labels of a document the largest counts, of several texts the smallest. Rows come back in doc_id order.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("mark"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("mark").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("mark").alias("mark"))
    share = marks.agg(F.avg("mark")).first()[0]
    if share is None:
        return [], None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    sizes = texts.select("doc_id", F.octet_length("text").alias("size"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    # The first ids of the order go to the documents; more of them where too many have no text.
    take = 2 * rows
    while True:
        picked = marks.where("mark = 0").orderBy(*order).limit(take).unionByName(marks.where("mark = 1").orderBy(*order).limit(take))
        held = sizes.join(F.broadcast(picked) if take <= BROADCAST_IDS else picked, "doc_id").groupBy("doc_id", "mark").agg(F.max("size").alias("size"))
        found = held.where("mark = 0").orderBy(*order).limit(rows).unionByName(held.where("mark = 1").orderBy(*order).limit(rows))
        found = found.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").collect()
        short = [k for k in (0, 1) if sum(r["mark"] == k for r in found) < rows]
        if not short or not marks.where(F.col("mark").isin(*short)).groupBy("mark").count().where(F.col("count") > take).count():
            break
        take *= 8
    taken = [r for k in (0, 1) for r in _within([r for r in found if r["mark"] == k], most)]
    if not taken:
        return [], share
    # At most 2 * rows ids of 12 bytes each.
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["mark"]) for r in taken], "doc_id long, mark int")
    out = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "mark").agg(F.min("text").alias("text")).collect()
    return sorted((r["doc_id"], r["text"], r["mark"]) for r in out), share
