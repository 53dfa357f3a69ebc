"""Boxes of one page against each other: equal to all pairs, and without a row for a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vitrine.operators import boxes, geometry, pairs

WIDTH, HEIGHT = 600.0, 840.0


def frame(spark, n=900, odd=True):
    r = np.random.default_rng(3)
    rows = [(int(k % 2), int(k), *map(float, (r.uniform(0, 590), r.integers(0, 60) * 14, r.choice([0.0, 9, 20, 33]), r.choice([0.0, 8, 21, 30]))), float(k % 7) / 7) for k in range(n)]
    rows += [(0, 5000 + k, 10.0 + k % 3, 10.0, 300.0, 200.0, 0.5) for k in range(60)]  # copies and nearly so
    if odd:
        rows += [(0, 6000, 10.0, 10.0, -3.0, 5.0, 1.0), (0, 6001, 10.0, 10.0, -300.0, 5.0, 1.0), (0, 6002, 10.0, 10.0, 4.0, -400.0, 1.0), (0, 6003, None, 1.0, 2.0, 3.0, None), (1, 6004, 0.0, 0.0, 600.0, 840.0, None)]
    return spark.createDataFrame(rows, "page_id long, box_id long, x double, y double, width double, height double, confidence double").withColumn("b", geometry.box())


def joinless(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Explode" not in plan and "Generate" not in plan, plan
    return df.collect()


@pytest.mark.parametrize("n", [0, 1, 900])
def test_connected_equal_all_pairs(spark, n):
    df = frame(spark, n)
    got = {(r.page_id, r.box_id): r.component for r in joinless(boxes.connected(df, "page_id", "box_id", WIDTH, HEIGHT))}
    want = {(r.page_id, r.box_id): r.box_id for r in df.collect()}
    one = df.select("page_id", F.col("box_id").alias("a"), F.col("b").alias("p"))
    two = df.select("page_id", F.col("box_id").alias("b"), F.col("b").alias("q"))
    dx, dy = geometry.gaps(F.col("p"), F.col("q"))
    touch = ((dx <= geometry.TOUCH * WIDTH) & (dy <= geometry.TOUCH * HEIGHT)) | (geometry.iou(F.col("p"), F.col("q")) > geometry.TOUCH_IOU)
    whole = one.crossJoin(two.withColumnRenamed("page_id", "_p")).where("page_id = _p and a <> b and p.x is not null and q.x is not null").where(touch)
    links = [(r.page_id, r.a, r.b) for r in whole.select("page_id", "a", "b").collect()]
    changed = True
    while changed:
        changed = False
        for p, a, b in links:
            if want[p, b] < want[p, a]:
                want[p, a], changed = want[p, b], True
    assert got == want and (not n or 1 < len(set(want.values())) < len(want))


def test_connected_boxes_that_share_an_id_are_one(spark):
    rows = [(1, 2, 0.0), (1, 2, 500.0), (1, 1, 100.0), (1, 3, 509.0)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x double").selectExpr("*", "named_struct('x', x, 'y', 0.0D, 'width', 5.0D, 'height', 5.0D) as b")
    assert sorted(map(tuple, boxes.connected(df, "page_id", "box_id", WIDTH, HEIGHT).collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 2)]


def test_nearest_anchor_equals_all_pairs(spark):
    df = frame(spark)
    texts, anchors = (df.where(w).select("page_id", F.col("box_id").alias(i), F.col("b").alias(b)) for w, i, b in (("box_id % 3 <> 0", "box_id", "t"), ("box_id % 3 = 0", "anchor_id", "a")))
    texts = texts.unionByName(texts.where("box_id % 50 = 1").withColumn("t", F.struct((F.col("t.x") + 31).alias("x"), "t.y", "t.width", "t.height")))  # ids that repeat
    got = [tuple(r) for r in joinless(geometry.nearest_anchor(texts, anchors, "page_id", "box_id", "anchor_id", WIDTH, HEIGHT))]
    t, a = F.col("t"), F.col("a")
    (dx, dy), (ox, oy) = geometry.gaps(t, a), geometry.overlaps(t, a)
    caption = (dy <= geometry.NEAR_Y * HEIGHT) & (ox >= geometry.OVERLAP * F.least(t["width"], a["width"]))
    beside = (dx <= geometry.NEAR_X * WIDTH) & (oy >= geometry.OVERLAP * F.least(t["height"], a["height"]))
    met = texts.where(t["x"].isNotNull() & (t["width"] <= geometry.CAPTION_WIDTH * WIDTH)).join(anchors.where("a.x is not null"), "page_id").where(caption | beside)
    best = met.groupBy("page_id", "box_id").agg(F.min(F.struct((dx + dy).alias("d"), "anchor_id")).alias("m"))
    want = [tuple(r) for r in best.select("page_id", "box_id", "m.anchor_id", "m.d").collect()]
    assert sorted(got) == sorted(want) and len(want) > 400 and any(r[3] > 0 for r in want)


def test_flagged_equal_all_pairs(spark):
    df = frame(spark)
    got = {r.box_id: r.duplicate for r in joinless(boxes.flagged_duplicates(df, "page_id", F.col("box_id") % 9 != 0, F.col("confidence"), ["box_id"], "box_id"))}
    place = F.struct((F.col("box_id") % 9 == 0).cast("int"), -F.col("confidence"), F.col("box_id"))
    own = df.withColumn("place", place).select("page_id", "box_id", "b", "place")
    other = own.select("page_id", F.col("b").alias("q"), F.col("place").alias("earlier"))
    found = {r[0] for r in own.join(other, "page_id").where("earlier < place").where(geometry.iou(F.col("q"), F.col("b")) >= boxes.FLAG_IOU).select("box_id").distinct().collect()}
    assert got == {r.box_id: r.box_id in found for r in df.collect()} and 50 < len(found) < len(got) - 50


def test_vector_literal_rounds_as_sql(spark, tmp_path):
    """0.009 as a float is a little less: its product with 1000 is 9 as a float, below 9 as a double."""
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([(1, [0.009, -0.009, 0.5]), (2, []), (3, None), (4, [None, 0.018])], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"select vec_id, literal from ({__spark_entry__.oracle_sql()['vector_literal']})").fetchall())
    got = sorted(map(tuple, __spark_entry__.queries()["vector_literal"](spark, str(tmp_path)).collect()))
    assert got == want and got[0] == (1, "[9,-9,500]")


def all_touching(df):
    one = df.select("page_id", F.col("box_id").alias("a"), F.col("b").alias("p"))
    two = df.select("page_id", F.col("box_id").alias("b"), F.col("b").alias("q"))
    dx, dy = geometry.gaps(F.col("p"), F.col("q"))
    touch = ((dx <= geometry.TOUCH * WIDTH) & (dy <= geometry.TOUCH * HEIGHT)) | (geometry.iou(F.col("p"), F.col("q")) > geometry.TOUCH_IOU)
    return sorted(map(tuple, one.join(two, "page_id").where(F.col("a") < F.col("b")).where(touch).select("page_id", "a", "b").collect()))


@pytest.mark.parametrize("n", [0, 1, 900])
def test_touching_pairs_equal_all_pairs_without_a_join(spark, n):
    """Null sides, sides below 0, ids that repeat, null ids and keys; numbers and texts as ids."""
    df = frame(spark, n)
    df = df.unionByName(df.where("box_id % 40 = 3")).unionByName(df.limit(2).withColumn("page_id", F.lit(None).cast("long"))).unionByName(df.limit(2).withColumn("box_id", F.lit(None).cast("long")))
    for boxes_of in (df, df.withColumn("box_id", F.col("box_id").cast("string"))):
        found = geometry.touching_pairs(boxes_of, "page_id", "box_id", WIDTH, HEIGHT)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == all_touching(boxes_of) and found.dtypes[1:] == [(c, dict(boxes_of.dtypes)["box_id"]) for c in "ab"]


def test_touching_pairs_of_many_boxes_in_one_place(spark):
    """More pairs than a batch holds, and more for a box than a list holds."""
    df = spark.range(2000).selectExpr("7L as page_id", "id as box_id", "named_struct('x', 1.0D * (id % 9), 'y', 130.0D + id % 20, 'width', 30.0D, 'height', 30.0D) as b")
    found = geometry.touching_pairs(df, "page_id", "box_id", WIDTH, HEIGHT)
    assert found.agg(F.count("*"), F.countDistinct("a", "b"), F.min(F.expr("b - a"))).first() == (1999000, 1999000, 1)


def test_touching_pairs_equal_sql_with_nulls(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.range(1200).selectExpr("if(id = 9, null, id) as o_orderkey", "if(id % 50 = 7, null, id * 7) as o_custkey", "if(id % 60 = 11, null, id * 3.5D) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.sql(f"select page_id, a, b from ({__spark_entry__.oracle_sql()['touching_pairs']})").fetchall())
    got = sorted((r.page_id, r.a, r.b) for r in __spark_entry__.queries()["touching_pairs"](spark, str(tmp_path)).collect())
    assert got == want and any(b % 50 == 7 for _, _, b in got) and any(a % 60 == 11 for _, a, _ in got)


@pytest.mark.parametrize("n, levels", [(0, 1), (1, 1), (129, 3), (1500, 6), (1500, 1000)])
def test_touching_equals_all_pairs_in_numpy(n, levels):
    """Few and many places along y, ranks that repeat, boxes not at home, sides without end, below 0 or not a number."""
    r = np.random.default_rng(n + levels)
    x, y = r.integers(0, 900, n) * 1.0, r.integers(0, levels, n) * (1200.0 / levels)
    x2, y2 = x + r.integers(-20, 260, n), y + r.integers(-30, 240, n)
    x[::50], x2[1::50], y2[2::70], x[3::90] = -np.inf, np.inf, np.inf, np.nan
    home, rank = r.random(n) < 0.7, r.integers(0, max(1, n * 2 // 3), n)
    found = list(pairs.touching(x, y, x2, y2, home, rank, 15.0, 21.0))
    got = [(i, j) for a, m, b in found for i, j in zip(np.repeat(a, m).tolist(), b.tolist(), strict=True)]
    with np.errstate(invalid="ignore"):
        near = lambda v, w, most: v[:, None] - w[None] <= most
        meet = near(x, x2, 15.0) & near(x, x2, 15.0).T & near(y, y2, 21.0) & near(y, y2, 21.0).T & (home[:, None] | home[None]) & (rank[:, None] < rank[None])
        meet &= ((x - x2 <= 15.0) & (y - y2 <= 21.0))[:, None] & ((x - x2 <= 15.0) & (y - y2 <= 21.0))[None]
    assert sorted(got) == list(zip(*(v.tolist() for v in np.nonzero(meet)), strict=True))
    assert all((m > 0).all() and m.max(initial=0) <= pairs.BLOCK for _, m, _ in found) and (n < 129 or got)


def test_touching_pairs_make_a_small_file(spark, tmp_path):
    """A page of 60 times sf0.1 has 92 million pairs: lists that are alike follow each other, so Parquet keeps a row in a fraction of a byte."""
    df = spark.range(6000).selectExpr("7L as page_id", "id * 200 + 7 as box_id", "named_struct('x', 1.0D * (id * 7919 % 900), 'y', 7.0D + id % 6 * 200, 'width', 60.0D + id * 104729 % 200, 'height', 60.0D + id % 9 * 20) as b")
    geometry.touching_pairs(df, "page_id", "box_id", 1000.0, 1400.0).write.parquet(f"{tmp_path}/pairs")
    rows = spark.read.parquet(f"{tmp_path}/pairs").count()
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert rows > 1_000_000 and size < 0.7 * rows, (rows, size / rows)
