"""Queries over rows as they are written and shown: inserts, vectors written back, blobs, screens and payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schema
from vitrine.functions import jsontext, labels, text
from vitrine.operators import catalog
from vitrine.operators.search import CANDIDATES, best, crop_rows, scored
from vitrine.plans.queries import _mentions, query_vector
from vitrine.plans.views import view
from vitrine.sources import sinks
from vitrine.sources.providers import HashProvider, page_prompt, scaled_boxes
from vitrine.sources.readers import table


def _appended(rows: DataFrame, name: str) -> DataFrame:
    """What a table holds after the rows were appended to it."""
    spark = rows.sparkSession
    path = f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    sinks.append(rows, name, path, None)  # a folder for each of thousands of small catalogues would be mostly folders
    return spark.read.schema(schema.TABLES[name]).parquet(path)


def insert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_page")
    rows = p.select(F.col("page_id").cast("string").alias("id"), F.col("catalog_id").cast("string").alias("catalog_id"), "page_number", "image_url", F.lit(1190).alias("width"), (F.col("page_id") % 2000).cast("int").alias("height"))
    return _appended(rows, "catalog_page").select("id", "catalog_id", "page_number", "image_url", "width", "height")


def insert_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for every page; one for a page that failed has its error and no products."""
    p = view(spark, sf_dir, "v_page")
    bad = F.col("error").isNotNull()
    raw = F.when(bad, F.lit('{"products":[]}')).otherwise(F.concat(F.lit('{"products":['), F.array_join(F.array_repeat(F.lit("{}"), F.col("mentions").cast("int")), ","), F.lit("]}")))
    rows = p.select(F.col("page_id").cast("string").alias("id"), F.col("catalog_id").cast("string").alias("catalog_id"), F.col("page_id").cast("string").alias("page_id"), "page_number", "model", raw.alias("raw_json"), F.when(bad, 0).otherwise(F.col("mentions")).alias("products_count"), "error")
    return _appended(rows, "page_analysis").select("id", "catalog_id", "page_number", "provider", "model", "raw_json", "products_count", "error")


def insert_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with their search texts; of every third the vector is zeros and is not stored, of every fifth there is none."""
    m = _mentions(spark, sf_dir)
    names = ("name_pt", "original_name", "description_pt", "category", "function_group", "commercial_use", "colors", "visual_attributes", "technical_attributes", "is_kit", "kit_contains", "not_confuse_with")
    k = F.col("mention_id")
    vector = F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), (k % 8).cast("double")))
    rows = m.withColumns({"id": k.cast("string"), "search_text": text.mention_search_text({n: F.col(n) for n in names}), "evidence_source": F.lit("vision"), "confidence": F.col("synthetic_similarity")})
    rows = rows.withColumns({"page_id": F.col("page_id").cast("string"), "catalog_id": F.col("catalog_id").cast("string"), "kit_contains": F.when(k % 2 == 0, F.col("kit_contains"))})
    written = sinks.with_vectors(_appended(rows, "page_product_mention"), rows.select("id", vector.alias("vector")))
    return written.select("id", "catalog_id", "page_id", "page_number", "name_pt", F.array_join("colors", ",").alias("colors"), "is_kit", F.size("kit_contains").alias("n_kit"), "confidence", "search_text", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def insert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates; those that pass the gate are embedded."""
    c = view(spark, sf_dir, "v_candidate").groupBy("candidate_id", "page_id").agg(*[F.max(x).alias(x) for x in ("quality_score", "is_searchable", "width", "height", "flag")])
    c = c.join(view(spark, sf_dir, "v_page").select("page_id", "catalog_id"), "page_id")
    key = F.col("candidate_id").cast("string")
    url = F.concat(F.lit("crops/"), key, F.lit(".jpg"))
    rows = c.select(
        key.alias("id"), F.col("catalog_id").cast("string").alias("catalog_id"), F.col("page_id").cast("string").alias("page_id"), F.lit("o").alias("original_url"), url.alias("crop_url"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        F.when(F.col("flag") == "A", "EMBEDDED_IMAGE").otherwise("PAGE_CROP").alias("source_type"), F.when(F.col("candidate_id") % 4 != 0, F.col("is_searchable")).alias("is_searchable"), F.col("quality_score").cast("double").alias("quality_score"),
    )
    out = _appended(rows, "product_candidate")
    gate = F.coalesce(catalog.embed_gate(F.col("is_searchable"), F.col("quality_score")), F.lit(False))
    return out.select("id", "catalog_id", "page_id", "crop_url", "width", "height", "source_type", "is_searchable", F.round("quality_score", 6).alias("quality_score"), gate.alias("embed"))


def vector_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions' vectors after some were written back: an empty vector or one of zeros changes nothing."""
    m = view(spark, sf_dir, "v_mention").select("mention_id", F.when(F.col("mention_id") % 2 == 0, F.array(F.lit(9.0))).alias("embedding"))
    k = F.col("mention_id")
    vector = F.when(k % 3 == 0, F.array(F.lit(0.0))).when(k % 3 == 1, F.array(k.cast("double"))).otherwise(F.array().cast("array<double>"))
    out = sinks.with_vectors(m, m.select("mention_id", vector.alias("vector")), "mention_id")
    return out.select("mention_id", F.get("embedding", F.lit(0)).alias("first"), F.size("embedding").alias("n"))


def reembed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mentions get a vector anew, how many fail, and how many hold one of the provider's length afterwards."""
    m = view(spark, sf_dir, "v_mention").select("mention_id", "name_pt", F.array(F.lit(0.0)).alias("embedding"))
    out, counts = sinks.reembedded(m, "name_pt", lambda: HashProvider(8))
    fresh = out.agg(F.count_if(F.size("embedding") == 8).alias("fresh"))
    return counts.crossJoin(F.broadcast(fresh))  # a row each


def upload_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of the suppliers, their URLs, and what the folder holds."""
    folder = f"{sinks.shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    blobs = view(spark, sf_dir, "v_supplier").select(F.format_string("s/%d.txt", "supplier_id").alias("path"), F.col("supplier_name").cast("binary").alias("content"))
    put = sinks.settled(sinks.uploaded(blobs, folder, "https://x"))
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/s").select(F.regexp_extract("path", "(s/[^/]+)$", 1).alias("path"), F.col("content").cast("string").alias("content"))
    return put.join(held, "path").select("path", "url", "error", "content")


def _catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions' catalogues; the last of them has no supplier."""
    c = view(spark, sf_dir, "v_mention").select("catalog_id").distinct()
    return c.select("catalog_id", F.when(F.col("catalog_id") != 49, F.col("catalog_id") % 10).alias("supplier_id"), F.format_string("catalog-%d.pdf", "catalog_id").alias("file_name"))


def crop_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older search with all that a result shows."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    blank = F.lit(None).cast("string")
    crops = e.select(
        k.alias("crop_id"), (k % 50).alias("catalog_id"), F.format_string("%d/c%d.jpg", k % 50, F.expr("vec_id div 100")).alias("crop_url"), F.format_string("o%d.jpg", "vec_id").alias("original_url"), "embedding", (k % 3 != 0).alias("is_searchable"), ((k % 10) / 10).alias("quality_score"),
        F.when(k % 4 == 0, "EMBEDDED_IMAGE").otherwise("PAGE_CROP").alias("source_type"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("detected_label"), F.lit("g").alias("function_group"), F.lit(0.5).alias("confidence"),
        F.when(k % 2 == 0, F.lit("n")).alias("product_name"), blank.alias("product_name_pt"), F.lit("c").alias("category"), blank.alias("model"), blank.alias("description_pt"), F.lit("HEURISTIC").alias("source_detector"),
    )
    suppliers = spark.range(9).select(F.col("id").alias("supplier_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("supplier_name"))
    out = crop_rows(crops, _catalogs(spark, sf_dir), suppliers, query_vector(spark, sf_dir))
    shown = labels.display_name(F.col("product_name_pt"), F.col("product_name"), F.col("detected_label"))
    return out.select("crop_id", "crop_url", "original_url", "catalog_id", F.round("similarity", 6).alias("similarity"), "catalog_file_name", "supplier_name", "detected_label", "function_group", "confidence", F.round("quality_score", 6).alias("quality_score"), "product_name", "product_name_pt", "category", "model", "description_pt", "source_detector", shown.alias("shown"))


def page_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a page search re-ranks: the nearest mentions with their page, catalogue and supplier, 20 columns."""
    near = scored(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), query_vector(spark, sf_dir)).select("vec_id", "similarity")
    m = _mentions(spark, sf_dir)
    catalogs = _catalogs(spark, sf_dir).where("supplier_id is not null")
    top = best(m.join(near, "vec_id").join(catalogs.select("catalog_id"), "catalog_id", "left_semi"), CANDIDATES, "mention_id")
    pages = m.select("page_id", F.concat(F.lit("https://x/pages/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("page_image_url")).distinct()
    suppliers = view(spark, sf_dir, "v_supplier")
    wide = top.drop("supplier_id").join(pages, "page_id").join(catalogs.withColumnRenamed("file_name", "catalog_file_name"), "catalog_id").join(suppliers, "supplier_id")
    shown = {c: F.array_join(c, ",").alias(c) for c in ("colors", "visual_attributes", "technical_attributes", "kit_contains", "not_confuse_with")}
    names = "mention_id catalog_id page_id page_number name_pt category function_group commercial_use colors visual_attributes technical_attributes is_kit kit_contains not_confuse_with description_pt page_image_url catalog_file_name supplier_id supplier_name".split()
    return wide.select(*[shown.get(c, c) for c in names], F.round("similarity", 6).alias("similarity"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("catalog_id") * 37 % 700).cast("int"))
    return view(spark, sf_dir, "v_catalog").withColumn("created_at", day.cast("timestamp"))


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their catalogues, newest first, as their page shows them."""
    d = catalog.supplier_pages(view(spark, sf_dir, "v_supplier"), _dated(spark, sf_dir))
    rows = F.transform("catalogs", lambda c: F.concat_ws(" ", c["catalog_id"].cast("string"), c["status"], text.shown_date(c["created_at"])))
    return d.select("supplier_id", "supplier_name", F.col("n_catalogs").cast("long").alias("n"), "processing", F.array_join(rows, "|").alias("rows"))


def suppliers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first suppliers by name, as a list shows them: 25 to a page, the second page."""
    return catalog.supplier_counts(view(spark, sf_dir, "v_supplier"), view(spark, sf_dir, "v_catalog")).offset(25).limit(25)


def catalog_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalogue's card shows: its date and its count, or a dash."""
    c = _dated(spark, sf_dir)
    count = labels.shown_count(F.when(F.col("catalog_id") % 3 == 0, F.col("catalog_id") % 7), F.when(F.col("catalog_id") % 3 == 1, F.col("catalog_id") % 5))
    return c.select("catalog_id", text.shown_date(F.col("created_at")).alias("day"), count.alias("shown"))


def boxes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes out of model answers: the new payload, the older one, and ones that fit neither."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    v = F.col("value").cast("string")
    box = lambda w: F.concat(F.lit('"x": 1, "y": 2.5, "width": '), w, F.lit(', "height": 4'))
    said = (
        F.when(k % 6 == 0, F.concat(F.lit('```json\n{"pageNumber": 7, "boxes": [{'), box(F.lit("3")), F.lit('}, {'), box(F.lit("5")), F.lit(', "confidence": '), v, F.lit("}]}\n```")))
        .when(k % 6 == 1, F.concat(F.lit('{"pageNumber": 2, "boxes": "none", "products": [{"box": {'), box(F.lit("6")), F.lit('}, "confidence": '), v, F.lit("}]}")))
        .when(k % 6 == 2, F.concat(F.lit('{"boxes": [{'), box(F.lit("0")), F.lit("}]}")))
        .when(k % 6 == 3, F.lit('{"pageNumber": 1, "products": []}'))
        .when(k % 6 == 4, F.concat(F.lit('{"boxes": 1, "products": [{"box": {'), box(F.lit("6")), F.lit("}}]}")))
        .otherwise(F.lit("nada"))
    )
    a = e.withColumn("a", jsontext.parse_boxes(said))
    last = F.try_element_at("a.boxes", F.lit(-1))
    return a.select("event_id", F.col("a.error").isNotNull().alias("failed"), F.col("a.page_number").alias("page_number"), F.size("a.boxes").alias("n"), last["width"].alias("width"), F.round(last["confidence"], 6).alias("confidence"))


def aligned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a provider's answer, which come in any order, by their index."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    part = lambda i: F.struct(F.lit(i).alias("index"), F.array((F.col("vec_id") * 10 + i).cast("double")).alias("embedding"))
    out = e.withColumn("v", catalog.aligned_embeddings(F.when(F.col("vec_id") % 2 == 0, F.array(part(2), part(0), part(1))).otherwise(F.array(part(1), part(2), part(0)))))
    return out.select("vec_id", F.array_join(F.transform("v", lambda x: x[0].cast("long").cast("string")), ",").alias("firsts"))


def catalog_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's screen: pages, candidates and mentions, each in its order."""
    m = view(spark, sf_dir, "v_mention")
    mentions = m.select("catalog_id", "mention_id", "page_number", "name_pt", F.when(F.col("mention_id") % 6 != 0, F.col("synthetic_similarity")).alias("confidence"))
    c = view(spark, sf_dir, "v_candidate").groupBy("candidate_id", "page_id").agg(F.max("quality_score").alias("quality_score"), F.max("is_searchable").alias("is_searchable"))
    own = c.join(view(spark, sf_dir, "v_page").select("page_id", "catalog_id"), "page_id")
    d = catalog.catalog_screen(view(spark, sf_dir, "v_catalog"), view(spark, sf_dir, "v_supplier"), view(spark, sf_dir, "v_page"), own, mentions)
    ids = F.array_join(F.transform("mentions", lambda r: r["mention_id"].cast("string")), ",")
    return d.select("catalog_id", "supplier_name", F.col("n_pages").cast("long").alias("n_pages"), F.col("n_candidates").cast("long").alias("n_candidates"), F.col("n_mentions").cast("long").alias("n_mentions"), F.md5(ids).alias("mentions_md5"))


def mention_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a page with their texts and vectors by position; a vector of zeros, or none, is null."""
    p = view(spark, sf_dir, "v_page").where("error is null")
    places = F.sequence(F.lit(1), F.col("mentions").cast("int"))
    some = F.when(F.col("mentions") > 0, places).otherwise(F.array().cast("array<int>"))
    rows = p.select("page_id", F.transform(some, lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("name_pt"))).alias("products"), F.transform(some, lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("search_texts"), F.transform(F.filter(some, lambda i: i <= 4), lambda i: F.array(F.lit(0.0), (i % 3).cast("double"))).alias("embeddings"))
    out = catalog.mention_rows(rows)
    return out.select("page_id", F.col("pos").cast("int").alias("pos"), "name_pt", "search_text", F.get("embedding", F.lit(1)).alias("second"))


def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small texts of screens, logs and prompts."""
    m = view(spark, sf_dir, "v_mention")
    k = F.col("mention_id")
    said = F.when(k % 4 == 0, F.lit(" \n ")).when(k % 4 == 1, F.lit(None)).otherwise(F.col("name_pt"))
    detector = F.when(k % 3 == 0, "GRID_LAYOUT").when(k % 3 == 1, "HEURISTIC").otherwise("OTHER")
    prompt = page_prompt(F.when(k % 2 == 0, F.col("category")), F.when(k % 3 == 0, F.lit("f.pdf")), F.col("page_number"), F.when(k % 5 != 0, F.repeat("layout_text", 150)))
    boxes = scaled_boxes(F.array(F.struct((k % 7).cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("width"), F.lit(4.0).alias("height"), F.lit(0.5).alias("confidence"))), 2.0, 0.5)
    return m.select(
        "mention_id", text.text_or_space(said).alias("sent"), text.usage_line(F.when(k % 3 != 0, k % 100), F.when(k % 4 != 0, k % 10)).alias("usage"), text.box_label(k % 9 / 2, F.lit(1.0), F.lit(2.4), F.lit(2.5)).alias("box"),
        labels.label(labels.DETECTOR, detector).alias("detector"), F.md5(prompt).alias("prompt_md5"), boxes[0]["x"].alias("x"), boxes[0]["height"].alias("height"),
    )


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests whose image can be taken."""
    k = F.col("event_id")
    asked = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "image/png").when(k % 4 == 1, "text/plain").when(k % 4 == 2, "image/jpeg").alias("media_type"), F.when(k % 5 != 0, (k % 11) * (1 << 20)).alias("n_bytes"))
    return catalog.valid_images(asked)


QUERIES = {
    f.__name__: f
    for f in (
        insert_pages, insert_analyses, insert_mentions, insert_candidates, vector_writeback, reembed_counts, upload_blobs, crop_search, page_search_rows,
        supplier_pages, suppliers_by_name, catalog_cards, boxes_json, aligned_vectors, valid_requests, catalog_screen, mention_positions, shown_texts,
    )
}
