"""Catalogue tables: reads with nested children, roll-ups, inserts with their checks, deletes and reprocessing.

Tables are DataFrames; a write operator returns the rows to append or the table as it is afterwards, so a caller can
write it with any sink (append, or overwrite of the catalogue's partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import storage_path, trimmed
from vitrine.operators.cascade import DECISIONS


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[Column], columns: Sequence[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children, empty where there are none, and its length."""
    sort = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *columns)
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(sort)).alias("_rows"))
    wide = parents.join(nested, key, "left")
    plain = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    empty = F.filter(plain, lambda r: F.lit(False))
    kept = F.coalesce(plain, empty, F.array().cast(f"array<struct<{','.join(f'`{c}`:{dict(rows.dtypes)[c]}' for c in columns)}>>"))
    return wide.withColumn(name, kept).withColumn(f"n_{name}", F.size(name)).drop("_rows")


def catalog_detail(catalogs: DataFrame, suppliers: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Catalogues with their supplier's name, pages by number, and candidates with the searchable and best first."""
    named = catalogs.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    with_pages = children(named, pages, "catalog_id", [F.col("page_number")], ["page_number", "page_id"], "pages")
    order = [F.when(F.col("is_searchable"), 0).otherwise(1), *last_first(F.col("quality_score")), F.col("candidate_id")]
    return children(with_pages, candidates, "catalog_id", order, ["candidate_id", "quality_score", "is_searchable"], "candidates")


def catalog_screen(catalogs: DataFrame, suppliers: DataFrame, pages: DataFrame, candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """What catalog_detail gives, and the catalogue's mentions by page number, the surest of a page first."""
    wide = catalog_detail(catalogs, suppliers, pages, candidates)
    order = [F.col("page_number"), *last_first(F.col("confidence")), F.col("mention_id")]
    return children(wide, mentions, "catalog_id", order, ["mention_id", "page_number", "name_pt", "confidence"], "mentions")


def last_first(x: Column) -> list[Column]:
    """Sort keys, ascending, that bring nulls first and then the largest."""
    return [F.when(x.isNull(), 0).otherwise(1), -x]


def supplier_counts(suppliers: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Every supplier with its number of catalogues, and whether one is still being processed; by name."""
    own = catalogs.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "PROCESSING").alias("busy"))
    wide = suppliers.join(own, "supplier_id", "left")
    return wide.select("supplier_id", "supplier_name", F.coalesce("n", F.lit(0)).alias("catalogs"), F.coalesce("busy", F.lit(False)).alias("processing")).orderBy("supplier_name", "supplier_id")


def supplier_pages(suppliers: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Suppliers with their catalogues, newest first, and whether one is still being processed. catalogs: catalog_id,
    supplier_id, file_name, status, created_at."""
    order = [-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("catalog_id")]
    wide = children(suppliers, catalogs, "supplier_id", order, ["catalog_id", "file_name", "status", "created_at"], "catalogs")
    return wide.withColumn("processing", F.exists("catalogs", lambda c: c["status"] == "PROCESSING"))


def home_counts(suppliers: DataFrame, catalogs: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of four counts; each table is counted where it lies."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")
    parts = one(suppliers, "suppliers").unionByName(one(catalogs.where("status = 'READY'"), "ready_catalogs"))
    parts = parts.unionByName(one(pages, "pages")).unionByName(one(candidates, "candidates"))
    return parts.groupBy().pivot("k", ["suppliers", "ready_catalogs", "pages", "candidates"]).agg(F.first("n"))


def status_rollup(outcomes: DataFrame) -> DataFrame:
    """outcomes: catalog_id, page_number, mentions, error. Pages, analysed and empty pages, mentions and the state of
    each catalogue: a failed page never fails it, an error without any analysed page does."""
    ok = F.col("error").isNull()
    out = outcomes.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("analyzed"), F.count_if(ok & (F.col("mentions") == 0)).alias("empty"),
        F.coalesce(F.sum(F.when(ok, F.col("mentions"))), F.lit(0)).alias("mentions"), F.substring(F.min("error"), 1, 500).alias("error"),
    )
    return out.withColumn("status", F.when(F.col("analyzed") > 0, "READY").otherwise("FAILED"))


def decision_histogram(decisions: DataFrame) -> DataFrame:
    """Pages by decision, zero-filled, with all vision calls and the models used. decisions: catalog_id, decision, vision_calls, model."""
    counts = [F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS]
    models = F.array_join(F.array_sort(F.collect_set("model")), ",")
    return decisions.groupBy("catalog_id").agg(*counts, F.sum("vision_calls").alias("vision_calls"), F.coalesce(F.nullif(models, F.lit("")), F.lit("none")).alias("models"))


def mentions_by_page(pages: DataFrame, mentions: DataFrame, shown: int = 8) -> DataFrame:
    """Pages with their number of mentions and the first few names: the surest first, unknown confidence before all."""
    wide = children(pages, mentions, "page_id", [*last_first(F.col("confidence")), F.col("mention_id")], ["mention_id", "name_pt"], "mentions")
    return wide.withColumn("shown", F.transform(F.slice("mentions", 1, shown), lambda m: m["name_pt"]))


def new_suppliers(suppliers: DataFrame, asked: DataFrame) -> DataFrame:
    """Trimmed names to insert, each once, that are neither blank nor taken; column outcome says why for the others:
    400 blank, 409 taken, 201 inserted."""
    names = asked.select(trimmed(F.coalesce(F.col("name"), F.lit(""))).alias("name")).distinct()
    taken = suppliers.select(F.col("supplier_name").alias("name"), F.lit(True).alias("taken")).distinct()
    wide = names.join(taken, "name", "left")
    return wide.select("name", F.when(F.col("name") == "", 400).when(F.col("taken"), 409).otherwise(201).alias("outcome"))


def new_catalogs(suppliers: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads: upload_id, supplier_id, file_name. Outcome 400 for another file type, 404 without supplier, 201 with PROCESSING."""
    known = suppliers.select("supplier_id", F.lit(True).alias("known")).distinct()
    wide = uploads.join(known, "supplier_id", "left")
    outcome = F.when(~F.lower(F.col("file_name")).endswith(".pdf"), 400).when(F.col("known").isNull(), 404).otherwise(201)
    return wide.select("upload_id", "supplier_id", "file_name", outcome.alias("outcome"), F.when(outcome == 201, "PROCESSING").alias("status"))


def valid_images(requests: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Search requests with an image of at most `most` bytes. requests: media_type, n_bytes; null: no image."""
    return requests.where(F.col("media_type").startswith("image/") & (F.col("n_bytes") <= most))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those that go: a delete, also of the children."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def detached(table: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is gone keep on with a null key."""
    alive = parents.select(F.col(key).alias("_k")).distinct()
    wide = table.join(alive, table[key] == F.col("_k"), "left")
    return wide.withColumn(key, F.col("_k")).drop("_k")


def blob_paths(tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct storage paths that the tables' URL columns name: what a delete has to remove."""
    every = None
    for table, column in tables:
        own = table.select(storage_path(F.col(column)).alias("path"))
        every = own if every is None else every.unionByName(own)
    return every.where("path is not null").distinct()


def replaced(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys in `fresh` replaced by its rows: reprocessing, safe to repeat."""
    return without(table, fresh, key).unionByName(fresh)


def mention_rows(products: DataFrame) -> DataFrame:
    """Products with their search texts and vectors, both by position, as mention rows; no vector, or zeros only: null.

    products: page_id, products array<struct>, search_texts array<string>, embeddings array<array<double>>.
    """
    zipped = F.posexplode(F.arrays_zip("products", "search_texts", "embeddings")).alias("pos", "z")
    wide = products.select("page_id", zipped)
    some = F.coalesce(F.exists("z.embeddings", lambda v: v != 0), F.lit(False))
    return wide.select("page_id", "pos", "z.products.*", F.col("z.search_texts").alias("search_text"), F.when(some, F.col("z.embeddings")).alias("embedding"))


def aligned_embeddings(parts: Column) -> Column:
    """Vectors of a provider's answer, array<struct<index, embedding>>, by index."""
    return F.transform(F.array_sort(parts), lambda p: p["embedding"])


def embed_gate(is_searchable: Column, quality: Column) -> Column:
    return is_searchable & (quality >= 0.6)
