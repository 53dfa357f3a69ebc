"""Queries over the derived tables, one for each group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import jsontext, labels, text, vector
from vitrine.functions.signals import looks_multi, page_type, product_count, signals
from vitrine.operators import boxes, cascade, catalog, geometry, intervals, layout, raster
from vitrine.operators.rerank import Profile, reranked
from vitrine.operators.search import CANDIDATES, best, crop_results, nearest, page_results, scored
from vitrine.plans.views import view
from vitrine.sources.readers import layout_blocks, layout_documents, table
from vitrine.sources.sinks import shared_folder

PROFILE = Profile("red widget", "economy_widget", colors=("red",), synonyms=("gadget",), must_not_match=("small",))
PAGE_WIDTH, PAGE_HEIGHT = 1000.0, 1400.0


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of one row: a query's, as a provider would give it."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_mention")
    none = F.array().cast("array<string>")
    blank = F.lit(None).cast("string")
    return m.withColumns(
        {
            "colors": F.array("color"),
            "visual_attributes": none,
            "technical_attributes": none,
            "kit_contains": F.when(F.col("is_kit"), F.array("thing")).otherwise(none),
            "not_confuse_with": none,
            "commercial_use": blank,
            "description_pt": blank,
            "original_name": blank,
        }
    )


def _top_mentions(spark: SparkSession, sf_dir: str, mentions: DataFrame) -> DataFrame:
    """The nearest mentions: vectors are scored where they lie, and their similarities joined."""
    near = scored(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), query_vector(spark, sf_dir)).select("vec_id", "similarity")
    return best(mentions.join(near, "vec_id"), CANDIDATES, "mention_id")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20, "vec_id")
    return top.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def knn_top200_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k of the mentions first, then their dimensions: every key has its row, so the joins drop nothing."""
    top = _top_mentions(spark, sf_dir, view(spark, sf_dir, "v_mention"))
    s = view(spark, sf_dir, "v_supplier")
    return top.join(s, "supplier_id").select("mention_id", "page_id", "supplier_name", F.round("similarity", 6).alias("similarity"))


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = vector.normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    some = vector.nonzero(F.col("embedding"))
    return e.select("vec_id", F.round(F.get(n, F.lit(0)), 6).alias("first"), F.round(vector.norm(n), 6).alias("norm"), F.size(vector.head(vector.checked(F.transform("embedding", lambda x: x.cast("double")), 64), 16)).alias("head"), some.alias("nonzero"))


def vector_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    # A product of floats is rounded to a float, as in SQL; Spark alone would take a double, whose floor can be one less.
    return e.select("vec_id", vector.literal(F.transform("embedding", lambda x: F.floor(x * F.lit(1000.0).cast("float")).cast("int"))).alias("literal"))


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).withColumn("similarity", F.col("synthetic_similarity"))
    return reranked(m, PROFILE).select("mention_id", "match_type", "confidence", F.round("score", 6).alias("score"), "reason")


def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exact top-k, dimensions, decision table, grouping by page."""
    found = page_results(_top_mentions(spark, sf_dir, _mentions(spark, sf_dir)), PROFILE)
    names = view(spark, sf_dir, "v_supplier")
    wide = found.withColumn("supplier_id", F.col("catalog_id") % 10).join(names, "supplier_id")
    return wide.select("page_id", "mention_id", "catalog_id", "page_number", "supplier_name", "match_type", "confidence", F.round("score", 6).alias("score"), F.size("other_matches").alias("n_others"), F.array_join(F.transform("other_matches", lambda o: o["mention_id"].cast("string")), ",").alias("others"))


def legacy_dedupe_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    crops = e.select(F.col("vec_id").alias("crop_id"), F.col("label").alias("catalog_id"), F.format_string("%d/c%d.jpg", F.col("label"), F.expr("vec_id div 2")).alias("crop_url"), "embedding", (F.col("vec_id") % 3 != 0).alias("is_searchable"), ((F.col("vec_id") % 10) / 10).alias("quality_score"), F.when(F.col("vec_id") % 4 == 0, "EMBEDDED_IMAGE").otherwise("PAGE_CROP").alias("source_type"))
    return crop_results(crops, query_vector(spark, sf_dir)).select("place", "crop_id", "catalog_id", F.round("similarity", 6).alias("similarity"))


def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("norm", text.normalize(F.col("text"))).withColumn("tokens", text.tokens_of(F.col("norm")))
    return d.select("doc_id", F.md5("norm").alias("norm_md5"), F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    names = ("name_pt", "original_name", "description_pt", "category", "function_group", "commercial_use", "colors", "visual_attributes", "technical_attributes", "is_kit", "kit_contains", "not_confuse_with")
    query = {"main_product": F.col("name_pt"), "function_group": F.col("function_group"), "category": F.col("category"), "commercial_use": F.lit(None).cast("string"), "colors": F.col("colors"), "visual_attributes": F.col("visual_attributes"), "technical_attributes": F.col("technical_attributes"), "synonyms": F.array("thing"), "must_not_match": F.array("color")}
    return m.select("mention_id", text.mention_search_text({n: F.col(n) for n in names}).alias("search_text"), text.query_search_text(query).alias("query_text"))


def product_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_mention")
    body = F.concat(F.col("layout_text"), F.lit("\n• "), F.col("name_pt"), F.lit("\nCaixa de Som "), F.col("size").cast("string"), F.when(F.col("is_kit"), F.lit(" UNID. CX R$ 7 R$ 8,50")).otherwise(F.lit("")))
    s = m.withColumn("s", signals(body))
    return s.select("mention_id", F.array_join(F.array_sort("s.codes"), ",").alias("codes"), F.col("s.prices").alias("prices"), F.col("s.pieces").alias("pieces"), F.col("s.units").alias("units"), F.col("s.bullets").alias("bullets"), F.size("s.labels").alias("n_labels"), product_count(F.col("s")).alias("products"), looks_multi(F.col("s")).alias("multi"))


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_mention")
    said = F.when(F.col("page_id") % 5 == 0, F.col("name_pt")).when((F.col("page_id") % 5 == 1) & (F.col("mention_id") % 2 == 0), F.concat(F.lit("CATÁLOGO "), F.col("thing"))).otherwise(F.col("layout_text"))
    pages = m.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("t"), F.count(F.lit(1)).alias("images"), (F.max("size") / 100.0).alias("fraction"))
    s = pages.withColumn("s", signals(F.col("t")))
    return s.select("page_id", product_count(F.col("s")).alias("products"), page_type(F.col("s"), F.col("t"), F.col("images"), F.col("fraction"), F.col("page_id") % 17 != 0).alias("page_type"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_box").withColumn("b", geometry.box())


def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.clusters(view(spark, sf_dir, "v_box").withColumn("cx", F.expr("x + width / 2")), ["page_id"], "cx", 20.0)
    around = intervals.cells(found, ["page_id"], F.lit(0.0), F.lit(1200.0))
    return around.select("page_id", F.col("cluster").cast("long").alias("cluster"), F.round("center", 6).alias("center"), "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "v_box").groupBy("page_id", F.expr("cast(y as int) div 10").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    every = cells.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("i"))
    return every.join(cells, ["page_id", "i"], "left").select("page_id", "i", (F.coalesce("n", F.lit(0)) / 4.0).alias("density"))


def gap_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _densities(spark, sf_dir)
    found = intervals.gaps(d, ["page_id"], 0.04, 3)
    rest = intervals.regions(d, found, ["page_id"])
    gap = found.select("page_id", F.lit("gap").alias("kind"), F.col("gap_start").alias("first"), F.col("gap_end").alias("last"))
    return gap.unionByName(rest.select("page_id", F.lit("region").alias("kind"), F.col("region_start").alias("first"), F.col("region_end").alias("last")))


def walk_to_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.walk(_densities(spark, sf_dir), ["page_id"], F.lit(60), 0.04)


def content_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.bands(_densities(spark, sf_dir), ["page_id"], 0.06, F.lit(8)).select("page_id", F.col("bands").cast("long").alias("bands"))


def point_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "v_box").select("page_id", "box_id", F.expr("x + width / 2").alias("cx"), F.expr("y + height / 2").alias("cy"))
    areas = view(spark, sf_dir, "v_box").select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("cell"))
    areas = areas.selectExpr("page_id", "cell", "cell % 3 * 350.0D as x1", "cell div 3 * 450.0D as y1", "cell % 3 * 350.0D + 350 as x2", "cell div 3 * 450.0D + 450 as y2")
    return geometry.centers_in(points, areas, "page_id").select("page_id", "box_id", F.col("cell").cast("long").alias("cell"))


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    texts = b.where("box_id div 200 % 5 <> 0").select("page_id", "box_id", F.col("b").alias("t"))
    anchors = b.where("box_id div 200 % 5 = 0").select("page_id", F.col("box_id").alias("anchor_id"), F.col("b").alias("a"))
    return geometry.nearest_anchor(texts, anchors, "page_id", "box_id", "anchor_id", PAGE_WIDTH, PAGE_HEIGHT).withColumn("distance", F.round("distance", 6))


def touching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.touching_pairs(_boxes(spark, sf_dir), "page_id", "box_id", PAGE_WIDTH, PAGE_HEIGHT)


def connected_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return boxes.connected(b, "page_id", "box_id", PAGE_WIDTH, PAGE_HEIGHT)


def nms_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).withColumn("valid", F.col("box_id") % 9 != 0)
    return boxes.flagged_duplicates(b, "page_id", F.col("valid"), F.col("confidence"), ["box_id"], "box_id").select("page_id", "box_id", "duplicate")


def nms_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = boxes.refined_duplicates(_boxes(spark, sf_dir), "page_id", F.col("confidence"), F.lit(0.0), F.lit(0.0), ["box_id"], "box_id")
    return kept.select("page_id", "box_id")


def nms_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.larger_cards(_boxes(spark, sf_dir), "page_id", ["box_id"], "box_id").select("page_id", "box_id")


def box_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.struct((F.col("x") - 40).alias("x"), (F.col("y") * 1.2 - 60).alias("y"), (F.col("width") * 3).alias("width"), (F.col("height") * 2).alias("height"))
    c = _boxes(spark, sf_dir).withColumn("c", geometry.clamped_box(wide, F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT)))
    why = geometry.box_reject(F.col("c"), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    return c.select("box_id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"), F.round("c.width", 4).alias("width"), F.round("c.height", 4).alias("height"), why.alias("reason"))


def page_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "v_box").withColumn("searchable", F.col("box_id") % 3 == 0)
    kept = geometry.capped(c, "page_id", [F.desc("searchable"), F.desc("confidence"), F.col("box_id")], F.col("searchable"))
    return kept.select("page_id", "box_id", F.col("place").cast("long").alias("place"))


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Layout documents in JSON, as an extractor would write them, read back: 12 signals and 12 photos in a grid on each page."""
    m = view(spark, sf_dir, "v_mention").withColumns({"p": F.expr("mention_id div 12"), "k": F.expr("mention_id % 12")})
    x, y = F.expr("40 + k % 3 * 180 + mention_id % 7"), F.expr("60 + k div 3 * 190 + mention_id % 5")
    block = lambda kind, y, h, t: F.struct(F.lit(kind).alias("type"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(120.0).alias("width"), F.lit(h).alias("height"), t.alias("text"))
    blocks = m.select("p", "k", F.explode(F.array(block("image", y, 110.0, F.lit(None).cast("string")), block("text", y + 115, 12.0, F.col("layout_text")))).alias("b"))
    page = blocks.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "b"))).alias("rows"))
    doc = page.select(F.col("p").alias("page_id"), F.to_json(F.struct(F.array(F.struct(F.col("p").cast("int").alias("pageNumber"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.transform("rows", lambda r: r["b"]).alias("blocks"))).alias("pages"))).alias("json"))
    found = layout_blocks(layout_documents(doc, "json"), "page_id")
    sizes = found.select("page_id", "page_width", "page_height").distinct().withColumns({"image_width": F.lit(1190.0), "image_height": F.lit(1684.0)})
    return found.select("page_id", "block_id", "type", "x", "y", "width", "height", "text"), sizes


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in ("x", "y", "width", "height")})


def grid_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, sizes = _layout(spark, sf_dir)
    facts = layout.page_facts(sizes.withColumn("has_layout", F.lit(True)), blocks)
    return _rounded(layout.grid_boxes(blocks, sizes, facts)).drop("confidence")


def card_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, sizes = _layout(spark, sf_dir)
    return _rounded(layout.card_boxes(blocks, sizes, 1190.0, 1684.0)).drop("confidence")


def composite_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, sizes = _layout(spark, sf_dir)
    whole = sizes.select("page_id", F.lit(1).alias("box_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(700.0).alias("width"), F.lit(900.0).alias("height"))
    return _rounded(layout.split_boxes(blocks, sizes, whole)).drop("confidence", "box_id")


def crop_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, sizes = _layout(spark, sf_dir)
    found = layout.grid_boxes(blocks, sizes, sizes.select("page_id", F.lit("category_grid").alias("page_type")))
    boxed = layout.text_in_boxes(blocks, sizes, found.withColumn("box_id", F.col("r") * 100 + F.col("c")))
    verdict = cascade.crop_verdict(signals(F.col("box_text")), F.lit(True))
    return boxed.select("page_id", "box_id", "box_text", verdict.alias("v")).select("page_id", F.col("box_id").cast("long").alias("box_id"), "box_text", "v.valid", "v.reason", F.round("v.score", 4).alias("score"))


def supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.supplier_counts(view(spark, sf_dir, "v_supplier"), view(spark, sf_dir, "v_catalog"))


def home_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.home_counts(*(view(spark, sf_dir, v) for v in ("v_supplier", "v_catalog", "v_page", "v_candidate")))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their catalogue; ids repeat in the source, so rows are made distinct."""
    c = view(spark, sf_dir, "v_candidate").groupBy("candidate_id", "page_id").agg(F.max("quality_score").alias("quality_score"), F.max("is_searchable").alias("is_searchable"))
    return c.join(view(spark, sf_dir, "v_page").select("page_id", "catalog_id"), "page_id")


def catalog_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.catalog_detail(view(spark, sf_dir, "v_catalog"), view(spark, sf_dir, "v_supplier"), view(spark, sf_dir, "v_page"), _candidates(spark, sf_dir))
    ids = lambda c, f: F.md5(F.array_join(F.transform(c, lambda r: r[f].cast("string")), ","))
    return d.select("catalog_id", "supplier_name", F.col("n_pages").cast("long").alias("n_pages"), ids("pages", "page_id").alias("pages_md5"), F.col("n_candidates").cast("long").alias("n_candidates"), ids("candidates", "candidate_id").alias("candidates_md5"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_rollup(view(spark, sf_dir, "v_page"))


def decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_page").withColumns({"vision_calls": F.when(F.col("decision") == "VISION_CHEAP", 1).otherwise(0), "model": F.when(F.col("decision") == "VISION_CHEAP", F.col("model"))})
    return catalog.decision_histogram(p)


def mentions_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_mention").withColumn("confidence", F.when(F.col("mention_id") % 6 != 0, F.col("synthetic_similarity")))
    d = catalog.mentions_by_page(m.select("page_id").distinct(), m)
    return d.select("page_id", F.col("n_mentions").cast("long").alias("n_mentions"), F.array_join("shown", "|").alias("shown"))


def upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_supplier")
    asked = view(spark, sf_dir, "v_catalog").select(F.when(F.col("catalog_id") % 10 == 0, F.lit("  ")).when(F.col("catalog_id") % 3 == 0, F.concat(F.lit(" Supplier#"), F.lpad((F.col("catalog_id") % 300).cast("string"), 9, "0"))).otherwise(F.col("file_name")).alias("name"))
    suppliers = catalog.new_suppliers(s, asked).select(F.lit("supplier").alias("kind"), "name", "outcome")
    uploads = view(spark, sf_dir, "v_catalog").select(F.col("catalog_id").alias("upload_id"), (F.col("catalog_id") % 150).alias("supplier_id"), F.when(F.col("catalog_id") % 4 == 0, F.upper("file_name")).when(F.col("catalog_id") % 4 == 1, F.lit("x.docx")).otherwise(F.col("file_name")).alias("file_name"))
    made = catalog.new_catalogs(s, uploads).select(F.lit("catalog").alias("kind"), F.col("upload_id").cast("string").alias("name"), "outcome")
    return suppliers.unionByName(made)


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are left after the FAILED catalogues are gone, and what the page keys of candidates become."""
    c, p = view(spark, sf_dir, "v_catalog"), view(spark, sf_dir, "v_page")
    gone = c.where("status = 'FAILED'")
    alive = catalog.without(p, gone, "catalog_id")
    loose = catalog.detached(_candidates(spark, sf_dir).select("candidate_id", "page_id"), alive, "page_id")
    one = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return one(catalog.without(c, gone, "catalog_id"), "catalogs").unionByName(one(alive, "pages")).unionByName(one(loose.where("page_id is null"), "detached"))


def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_page")
    return catalog.blob_paths([(p, "image_url"), (p.where("page_number > 50"), "image_url")])


def reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_page").select("page_id", "catalog_id", "page_number")
    fresh = p.where("catalog_id % 20 = 3 and page_id % 2 = 0").withColumn("page_number", F.col("page_number") + 1)
    return catalog.replaced(p, fresh, "catalog_id").groupBy("catalog_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("page_number").alias("numbers"))


def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Claro:\n```json\n"), F.col("props"), F.lit("\n```"))).when(k == 2, F.concat(F.lit("resposta "), F.col("props"), F.lit(" fim"))).when(k == 3, F.concat(F.lit("} "), F.col("props"))).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    v = jsontext.tolerant_variant(said)
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def json_array_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    colors = F.when(kind == 0, F.lit('["a", 1, true, " x "]')).when(kind == 1, F.lit('"a, b;c"')).when(kind == 2, F.lit("null")).otherwise(F.lit("[]"))
    group = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"pageNumber": 3, "products": [{"namePt": " n ", "functionGroup": "'), group, F.lit('", "colors": '), colors, F.lit(', "isKit": "false", "confidence": '), F.col("value").cast("string"), F.lit("}]}"))
    a = e.withColumn("a", jsontext.parse_analysis(body))
    p = F.get("a.products", F.lit(0))
    return a.select("event_id", F.col("a.error").isNotNull().alias("failed"), F.size("a.products").alias("n"), p["name_pt"].alias("name"), F.array_join(p["colors"], "|").alias("colors"), p["is_kit"].alias("is_kit"), p["confidence"].alias("confidence"))


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "v_catalog")
    kinds = F.array(*[F.lit(k) for k in (*labels.FUNCTION_GROUPS, "x_y")])
    return c.select("catalog_id", labels.label(labels.STATUS, F.col("status")).alias("status"), labels.label(labels.FUNCTION_GROUPS, F.get(kinds, (F.col("catalog_id") % 14).cast("int"))).alias("label"), text.numbered_path(F.lit("pages"), "page", F.col("catalog_id") % 1000, 3).alias("path"), text.percent(F.col("catalog_id") % 200 / 200).alias("pct"), text.media_type(F.when(F.col("catalog_id") % 3 == 0, F.lit("a.PNG")).otherwise(F.col("file_name"))).alias("media"))


def structural_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "v_candidate")
    pages = view(spark, sf_dir, "v_page").select("page_id", F.when(F.col("page_id") % 5 == 0, "cover").when(F.col("page_id") % 5 == 1, "partial_grid").otherwise("category_grid").alias("page_type"), (F.col("page_id") % 9).cast("int").alias("expected"))
    return cascade.structural_gate(pages, c)


def heuristic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "v_candidate").groupBy("candidate_id", "page_id").agg(*[F.max(c).alias(c) for c in ("width", "height", "is_searchable", "flag")], F.max(F.coalesce("quality_score", F.lit(0.9)) + 0.013).alias("quality_score"))
    c = own.withColumn("reject_reason", F.when(F.col("flag") == "R", "too_small").when(F.col("flag") == "A", "low_quality"))
    return cascade.heuristic_gate(view(spark, sf_dir, "v_page"), c).select("page_id", "good", F.regexp_replace("reason", "\\(.*", "").alias("reason"), "searchable", F.round("average", 6).alias("average"), "expected_min")


def cascade_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, False)


def cascade_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, True)


def _cascade(spark: SparkSession, sf_dir: str, premium: bool) -> DataFrame:
    p = view(spark, sf_dir, "v_page")
    number = F.row_number().over(Window.partitionBy("catalog_id").orderBy("page_id"))
    pages = p.select("page_id", "catalog_id", number.alias("page_number"), F.when(F.col("page_id") % 10 == 0, "cover").otherwise("category_grid").alias("page_type"), (F.col("page_id") % 4 == 1).alias("grid_good"), (F.col("page_id") % 4 == 2).alias("pdf_good"), (F.col("page_id") % 7 == 0).alias("heuristic_good"), (F.col("page_id") % 6 != 0).alias("vision_ok"), (F.col("page_id") % 3).alias("vision_boxes"), F.lit(1).alias("expected_min"), F.lit(True).alias("premium_ok"))
    done = cascade.decided(pages, premium=premium)
    return done.select("page_id", "catalog_id", "decision", F.col("vision_calls").cast("int").alias("vision_calls"))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images whose pixels a formula gives, one for each page of the boxes: 32 x 24, three channels."""
    pages = view(spark, sf_dir, "v_box").select("page_id").distinct()
    place = F.sequence(F.lit(0), F.lit(32 * 24 * 3 - 1))
    value = lambda i: F.pmod((i % 96).cast("long") * 7 + F.floor(i / 96) * 5 + F.col("page_id") * 11 + F.when(F.col("page_id") % 2 == 0, F.floor(i / 300) * 40).otherwise(0), F.lit(256))
    hexed = F.array_join(F.transform(place, lambda i: F.lpad(F.hex(value(i)), 2, "0")), "")
    return pages.select("page_id", F.lit(32).alias("width"), F.lit(24).alias("height"), F.lit(3).alias("channels"), F.unhex(hexed).alias("data"))


def raster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster.raster_stats(_rasters(spark, sf_dir), "page_id")
    return s.select("page_id", "total", "white", "green", "orange", F.round("text", 6).alias("text"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by a file stream of two files, a micro-batch each, into partitions, and what the sink holds afterwards."""
    import uuid

    from vitrine.streaming.ingest import ingest

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "conversations").withColumn("part", F.col("conv_id") % 16)
    source.repartition(2).write.parquet(f"{base}/in")  # every part is in both files
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    count = lambda df: df.groupBy("part", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    ingest(stream, "part", f"{base}/sink", f"{base}/offsets", count).awaitTermination()
    rows = spark.read.schema("role string, n long, chars long, part long, batch long").parquet(f"{base}/sink")
    return rows.groupBy("part", "role").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
