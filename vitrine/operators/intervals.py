"""Intervals on a line, by windows: clusters, boundaries between them, gaps in densities and the regions they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clusters(rows: DataFrame, keys: list[str], value: str, min_gap: Column | float) -> DataFrame:
    """Clusters of values of each key: a new one begins where the gap is above min_gap. keys, cluster, center, n."""
    w = Window.partitionBy(*keys).orderBy(value)
    begins = F.when(F.col(value) - F.lag(value).over(w) > min_gap, 1).otherwise(0)
    numbered = rows.withColumn("_begins", begins).withColumn("cluster", F.sum("_begins").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster").agg(F.avg(value).alias("center"), F.count(F.lit(1)).alias("n"))


def cells(centers: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """The stretch around each center, up to the middle between it and the next, within low and high."""
    w = Window.partitionBy(*keys).orderBy("center")
    middle = lambda other: (F.col("center") + other) / 2
    return centers.withColumns({"lo": F.coalesce(middle(F.lag("center").over(w)), low), "hi": F.coalesce(middle(F.lead("center").over(w)), high)})


def gaps(densities: DataFrame, keys: list[str], threshold: float, min_span: Column | int) -> DataFrame:
    """Runs of places i whose density is under the threshold, of min_span places or more: keys, gap_start, gap_end."""
    low = densities.where(F.col("density") < threshold)
    island = F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    runs = low.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("i").alias("gap_start"), F.max("i").alias("gap_end"))
    return runs.where(F.col("gap_end") - F.col("gap_start") + 1 >= min_span).drop("_island")


def regions(densities: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What the gaps leave of each key's places: keys, region_start, region_end. A key without gaps is one region."""
    ends = densities.groupBy(*keys).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    # A gap of no length on either side of the places makes every region lie between two gaps.
    edges = ends.select(*keys, F.explode(F.array(F.struct((F.col("_first") - 1).alias("s"), (F.col("_first") - 1).alias("e")), F.struct((F.col("_last") + 1).alias("s"), (F.col("_last") + 1).alias("e")))).alias("g"))
    every = found.select(*keys, F.col("gap_start").alias("s"), F.col("gap_end").alias("e")).unionByName(edges.select(*keys, "g.s", "g.e"))
    after = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e"))
    between = every.select(*keys, (F.col("e") + 1).alias("region_start"), (after - 1).alias("region_end"))
    return between.where("region_end >= region_start")


def bands(densities: DataFrame, keys: list[str], min_density: float, min_height: Column, threshold: float = 0.02, share: float = 0.02) -> DataFrame:
    """Content bands of each key: regions between deep gaps that are high and dense enough. keys, bands (0 kept)."""
    n = densities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    span = F.greatest(F.lit(4), F.floor(F.col("n") * share + 0.5).cast("int"))
    wide = densities.join(n, keys)
    low = wide.where(F.col("density") < threshold)
    island = F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    runs = low.withColumn("_island", island).groupBy(*keys, "_island", "n").agg(F.min("i").alias("gap_start"), F.max("i").alias("gap_end"))
    found = runs.where(F.col("gap_end") - F.col("gap_start") + 1 >= span).select(*keys, "gap_start", "gap_end")
    segment = regions(densities, found, keys).join(n, keys)
    inside = segment.join(densities, keys).where(F.col("i").between(F.col("region_start"), F.col("region_end")))
    dense = inside.groupBy(*keys, "region_start", "region_end", "n").agg(F.avg("density").alias("mean"))
    good = dense.where((F.col("region_end") - F.col("region_start") + 1 >= min_height) & (F.col("mean") >= min_density))
    return n.join(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("bands")), keys, "left").select(*keys, F.coalesce("bands", F.lit(0)).alias("bands"))


def walk(densities: DataFrame, keys: list[str], center: Column, gap: float) -> DataFrame:
    """From a center out to the first places under the gap density: keys, lo, hi."""
    under = F.when(F.col("density") < gap, F.col("i"))
    below = F.max(F.when(F.col("i") <= center, under))
    above = F.min(F.when(F.col("i") >= center, under))
    out = densities.groupBy(*keys).agg(below.alias("_b"), above.alias("_a"), F.min("i").alias("_first"), F.max("i").alias("_last"))
    return out.select(*keys, F.coalesce(F.col("_b") + 1, F.col("_first")).alias("lo"), F.coalesce(F.col("_a") - 1, F.col("_last")).alias("hi"))
