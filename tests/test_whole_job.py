"""Registered queries that must take all rows of their tables: against whole SQL or brute force."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "orders", "embeddings"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", "grid_detector card_detector composite_split crop_texts touching_pairs connected_images page_types vector_literal mentions_by_page cascade_decisions cascade_premium nms_flagged vision_runner refined_boxes hard_rules".split())
def test_query_equals_sql_over_whole_tables(spark, duck, name):
    sql = __spark_entry__.oracle_sql()[name]
    assert not any(cut in sql for cut in ("mention_id < 600", "(box_id // 200) % 12", "page_id % 4 <> 0", "[1:4]"))
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_touching_pairs_equal_brute_force(spark):
    """Boxes on cell edges, at the exact margin, beyond the page, and larger than it."""
    from pyspark.sql import functions as F

    from vitrine.operators import geometry

    boxes = [(k % 2, k, float(x), float(y), float(w), float(h)) for k, (x, y, w, h) in enumerate((x, y, w, h) for x in (-40, 0, 90, 115, 200, 585, 700) for y in (0, 100, 121, 400, 900) for w, h in ((10, 0), (100, 100), (75, 79), (2000, 30)))]
    df = spark.createDataFrame(boxes, "page_id long, box_id long, x double, y double, width double, height double").withColumn("b", geometry.box())
    got = [tuple(r) for r in geometry.touching_pairs(df, "page_id", "box_id", 600.0, 840.0).collect()]
    one = df.select("page_id", F.col("box_id").alias("a"), F.col("b").alias("p"))
    two = df.select("page_id", F.col("box_id").alias("b"), F.col("b").alias("q"))
    dx, dy = geometry.gaps(F.col("p"), F.col("q"))
    touch = ((dx <= 0.015 * 600.0) & (dy <= 0.015 * 840.0)) | (geometry.iou(F.col("p"), F.col("q")) > 0.2)
    want = [tuple(r) for r in one.join(two, "page_id").where(F.col("a") < F.col("b")).where(touch).select("page_id", "a", "b").collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want) and want


def test_heuristic_detector_of_all_pages(spark):
    from collections import defaultdict

    from vitrine.plans.views import view

    found = defaultdict(list)
    df = __spark_entry__.queries()["heuristic_detector"](spark, SF)
    for r in df.collect():
        found[r["page_id"]].append(tuple(r[c] for c in df.columns if c != "page_id"))
    assert set(found) == {r[0] for r in view(spark, SF, "v_box").select("page_id").distinct().collect()}
    # The drawing repeats after 120 pages: cells by 3 and 2, shades by 40.
    assert len(found) > 120 and all(sorted(found[k], key=repr) == sorted(found[k - 120], key=repr) for k in found if k >= 120)
