"""Vector search: exact top-k, page search with re-ranking, and the older search over crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.vector import cosine_with
from vitrine.operators.rerank import Profile, reranked

#: Fixed values of the two searches.
CANDIDATES, PAGES, EXTRAS = 200, 30, 4
CROP_CANDIDATES, CROP_RESULTS, MIN_QUALITY, DEDUP = 100, 20, 0.5, 0.97


def nearest(rows: DataFrame, vector: Sequence[float], k: int, id_column: str, embedding: str = "embedding", first: Sequence = ()) -> DataFrame:
    """The k rows with the highest cosine similarity, ties to the smaller id; `first` sorts before similarity.

    One scan, a partial top-k in each task; rows without a vector, or with one of another length, take no part.
    """
    return best(scored(rows, vector, embedding), k, id_column, first)


def scored(rows: DataFrame, vector: Sequence[float], embedding: str = "embedding") -> DataFrame:
    """Rows with a vector of the right length, and its similarity."""
    return rows.where(F.col(embedding).isNotNull()).withColumn("similarity", cosine_with(F.col(embedding), vector)).where("similarity is not null")


def best(rows: DataFrame, k: int, id_column: str, first: Sequence = ()) -> DataFrame:
    """The k rows with the highest similarity. Where vectors lie in a table of their own, score them there and join the
    similarities: vectors are not shuffled."""
    return rows.orderBy(*first, F.desc("similarity"), id_column).limit(k)


def page_results(mentions: DataFrame, profile: Profile, pages: int = PAGES, extras: int = EXTRAS) -> DataFrame:
    """Re-rank at most CANDIDATES mentions and group them by page: the best one, and the next few as other_matches."""
    ranked = reranked(mentions, profile).where("match_type <> 'rejected'")
    in_page = Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc("similarity"), "mention_id")
    ranked = ranked.withColumn("place", F.row_number().over(in_page)).where(F.col("place") <= 1 + extras)
    other = F.struct("place", "mention_id", "name_pt", "match_type", "confidence", "reason")
    best = F.struct("mention_id", "name_pt", "function_group", "catalog_id", "page_number", "match_type", "confidence", "score", "similarity", "reason")
    grouped = ranked.groupBy("page_id").agg(
        F.max(F.when(F.col("place") == 1, best)).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 1, other))).alias("others"),
    )
    out = grouped.select("page_id", "best.*", F.transform("others", lambda o: o.dropFields("place")).alias("other_matches"))
    return out.orderBy(F.desc("score"), F.desc("similarity"), "mention_id").limit(pages)


def crop_rows(crops: DataFrame, catalogs: DataFrame, suppliers: DataFrame, vector: Sequence[float]) -> DataFrame:
    """The older search with what a result shows: crops of a catalogue and supplier that exist, their file and name.

    catalogs: catalog_id, supplier_id, file_name; suppliers: supplier_id, supplier_name. Crops without them take no part,
    so they are left out before the top is taken; the names are joined to the few rows that stay.
    """
    named = catalogs.join(suppliers, "supplier_id").select("catalog_id", F.col("file_name").alias("catalog_file_name"), "supplier_name")
    known = crops.join(named.select("catalog_id"), "catalog_id", "left_semi")
    found = crop_results(known, vector).select("place", "crop_id", "similarity")
    wide = found.join(crops.drop("embedding", "place", "similarity"), "crop_id").join(named, "catalog_id")
    return wide.orderBy("place")


def crop_results(crops: DataFrame, vector: Sequence[float]) -> DataFrame:
    """The older search: page crops first, then by similarity; 20 of the top 100 that are no near-copies in their catalogue.

    Catalogues do not meet in the comparison, so each is folded on its own over the global top 100.
    """
    usable = crops.where(F.col("is_searchable") & (F.col("quality_score") >= MIN_QUALITY))
    order = F.when(F.col("source_type") == "PAGE_CROP", 0).otherwise(1)
    top = nearest(usable, vector, CROP_CANDIDATES, "crop_id", first=[order])
    top = top.withColumn("place", F.row_number().over(Window.orderBy(order, F.desc("similarity"), "crop_id")))  # over 100 rows
    row = F.struct("place", "crop_id", "crop_url", "similarity")
    folded = top.groupBy("catalog_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    near = lambda kept, r: F.exists(kept, lambda k: (k["crop_url"] == r["crop_url"]) | (F.abs(k["similarity"] - r["similarity"]) < F.lit(1 - DEDUP)))
    empty = F.filter("rows", lambda r: F.lit(False))
    kept = F.aggregate("rows", empty, lambda kept, r: F.when(near(kept, r), kept).otherwise(F.concat(kept, F.array(r))))
    return folded.select("catalog_id", F.explode(kept).alias("r")).select("catalog_id", "r.*").orderBy("place").limit(CROP_RESULTS)
