"""Connected components of links between documents, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.storage import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (of one type that has an order). Returns node, component: the smallest node that links reach, for every
    node of a link, from a table in the shared folder.

    Large-star and small-star turns by hash shuffles: each turn hangs nodes on the smallest neighbour seen, so chains
    halve and stars stay. A node's least neighbour is counted before the shuffle. Every turn's links are stored in the
    shared folder; only their number and a sum come to the driver, to see that nothing changes any more.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        older, links = links, stored(small.where("a <> b").distinct(), "links")
        discard(older)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
    out = stored(ends.groupBy("node").agg(F.min("component").alias("component")), "components")
    discard(links)
    return out
