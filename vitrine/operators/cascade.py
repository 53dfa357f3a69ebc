"""The tiered detection cascade: gates on each tier's candidates, the vision budget, and the first tier that is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.signals import has_signal, is_non_product, looks_multi
from vitrine.operators.raster import BOUNDARY, QUALITY, SEVERE, VISION_FLOOR

#: Decisions, in the order of the report.
DECISIONS = ("PAGE_SKIP", "GRID_LAYOUT", "PDF_LAYOUT", "HEURISTIC", "VISION_CHEAP", "VISION_PREMIUM", "VISION_OFF", "BUDGET_EXCEEDED", "FALLBACK")


def is_severe(reason: Column) -> Column:
    return F.coalesce(reason.isin(*sorted(SEVERE)), F.lit(False))


def should_index(score: Column, reason: Column) -> Column:
    return ~is_severe(reason) & (score >= QUALITY)


def crop_verdict(s: Column, has_content: Column) -> Column:
    """Struct valid, reason, score of a crop from the signals of its text."""
    out = lambda valid, reason, score: F.struct(F.lit(valid).alias("valid"), F.lit(reason).cast("string").alias("reason"), score.cast("double").alias("score"))
    zero = F.lit(0.0)
    rich = (F.size(s["codes"]) > 0).cast("int") + (s["prices"] > 0).cast("int") + ((s["pieces"] > 0) | (s["units"] > 0)).cast("int")
    return (
        F.when((F.size(s["labels"]) >= 4) & ~has_signal(s), out(False, "non_product_page", zero))
        .when(looks_multi(s), out(False, "multi_card_crop", zero))
        .when(~has_signal(s) & ~has_content, out(False, "no_product_signal", zero))
        .when(~has_signal(s), out(True, None, F.lit(0.55)))
        .otherwise(out(True, None, F.least(F.lit(0.95), 0.7 + rich * 0.08)))
    )


def vision_verdict(reason: Column, quality: Column, boundary: Column, confidence: Column) -> tuple[Column, Column]:
    """(searchable, reject reason) of a vision candidate."""
    why = F.coalesce(reason, F.when(confidence < VISION_FLOOR, "low_confidence").when(boundary < BOUNDARY, "low_boundary"))
    return why.isNull() & (quality >= QUALITY), why


def structural_gate(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """page_id, good, reason, searchable for a layout tier. pages: page_id, page_type, expected; candidates: page_id, is_searchable."""
    found = candidates.groupBy("page_id").agg(F.count_if("is_searchable").alias("n"))
    wide = pages.join(found, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    need = F.ceil(F.col("expected") * 0.6)
    few = (F.col("page_type") == "category_grid") & (F.col("expected") >= 4) & (F.col("n") < need)
    skip = is_non_product(F.col("page_type"))
    reason = (
        F.when(skip, "non_product_page")
        .when(F.col("n") == 0, "no_searchable")
        .when(few, F.format_string("below_expected_grid(%s/%s)", F.col("n"), F.col("expected")))
        .otherwise(F.format_string("searchable=%s", F.col("n")))
    )
    good = ~skip & (F.col("n") > 0) & ~few
    return wide.select("page_id", good.alias("good"), reason.alias("reason"), F.when(skip, 0).otherwise(F.col("n")).alias("searchable"))


def expected_count(n: Column) -> Column:
    """How many products so many candidates stand for, at least."""
    return F.when(n == 0, 0).when(n <= 2, 1).when(n <= 4, 3).when(n <= 6, 5).otherwise(7)


def heuristic_gate(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """page_id, good, reason, searchable, average, expected_min. candidates: page_id, candidate_id, width, height, quality_score,
    is_searchable, reject_reason; the first giant in candidate order gives the reason."""
    own = F.col("is_searchable")
    aspect = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(0.0))
    giant = F.when(own & (aspect > 3.0), "horizontal_giant").when(own & (aspect > 0) & (aspect < 0.33), "vertical_giant")
    found = candidates.withColumn("_giant", giant).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(own).alias("n"), F.avg(F.when(own, F.col("quality_score"))).alias("avg"),
        F.min_by("_giant", F.when(F.col("_giant").isNotNull(), F.col("candidate_id"))).alias("giant"), F.count_if(is_severe(F.col("reject_reason"))).alias("severe"),
    )
    wide = pages.select("page_id").join(found, "page_id", "left").na.fill(0, ["total", "n", "severe"])
    least = expected_count(F.col("total"))
    reason = (
        F.when(F.col("n") == 0, "no_searchable")
        .when(F.col("n") < least, F.format_string("below_expected(%s/%s)", F.col("n"), least))
        .when(F.col("giant").isNotNull(), F.col("giant"))
        .when(F.col("avg") < 0.8, F.concat(F.lit("avg_quality_low("), F.format_number("avg", 2), F.lit(")")))
        .when(F.col("severe") > F.col("n"), F.format_string("too_many_severe_rejects(%s)", F.col("severe")))
    )
    early = (F.col("n") == 0) | (F.col("n") < least) | F.col("giant").isNotNull()
    return wide.select("page_id", reason.isNull().alias("good"), reason.alias("reason"), F.col("n").alias("searchable"), F.when(early, 0.0).otherwise(F.col("avg")).alias("average"), least.alias("expected_min"))


def decided(pages: DataFrame, mode: str = "auto", configured: bool = True, budget: int = 20, premium: bool = False) -> DataFrame:
    """The decision for every page, and the vision calls it makes.

    pages: catalog_id, page_number, page_type, grid_good, pdf_good, heuristic_good, vision_ok (did the call return),
    vision_boxes, expected_min, premium_ok. Only the pages that come to the vision tier count against the budget, in
    page order; with the premium tier a page may take two calls, so the pages of a catalogue are then folded in order.
    """
    skip = F.lit(mode != "always") & is_non_product(F.col("page_type"))
    layout = F.lit(mode != "always")
    before = F.when(skip, "PAGE_SKIP").when(layout & F.col("grid_good"), "GRID_LAYOUT").when(layout & F.col("pdf_good"), "PDF_LAYOUT")
    if mode == "off" or not configured:
        return pages.withColumns({"decision": F.coalesce(before, F.lit("VISION_OFF" if mode == "off" else "HEURISTIC")), "vision_calls": F.lit(0)})
    if mode == "auto":
        before = F.coalesce(before, F.when(F.col("heuristic_good"), "HEURISTIC"))
    wide = pages.withColumn("_before", before)
    called = F.when(F.col("vision_ok"), "VISION_CHEAP").otherwise("FALLBACK")
    if not premium or mode != "auto":
        asks = F.col("_before").isNull().cast("int")
        order = Window.partitionBy("catalog_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
        wide = wide.withColumn("_n", F.sum(asks).over(order))
        late = F.lit(mode == "auto") & (F.col("_n") > budget)
        decision = F.coalesce("_before", F.when(late, "BUDGET_EXCEEDED").otherwise(called))
        return wide.withColumns({"decision": decision, "vision_calls": F.when(F.col("_before").isNull() & ~late, 1).otherwise(0)}).drop("_before", "_n")
    # Fold: what is left of the budget goes from page to page of a catalogue.
    second = F.col("vision_ok") & (F.col("vision_boxes") == 0) & (F.col("expected_min") > 0)
    wide = wide.withColumns({"_asks": F.col("_before").isNull(), "_second": second, "_premium": F.col("premium_ok"), "_called": called})
    row = F.struct("page_number", *[c for c in wide.columns if c != "page_number"])
    listed = wide.groupBy("catalog_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(budget).alias("left"), F.transform(F.filter("rows", lambda r: F.lit(False)), lambda r: F.struct(r.alias("r"), F.lit(0).alias("calls"))).alias("out"))

    def step(state: Column, r: Column) -> Column:
        one = r["_asks"] & (state["left"] > 0)
        two = one & r["_second"] & (state["left"] > 1)
        calls = one.cast("int") + two.cast("int")
        return F.struct((state["left"] - calls).alias("left"), F.concat(state["out"], F.array(F.struct(r.alias("r"), calls.alias("calls")))).alias("out"))

    done = listed.select(F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("k"))
    out = done.select(*[F.col(f"k.r.{c}").alias(c) for c in wide.columns], F.col("k.calls").alias("vision_calls"))
    decision = F.when(F.col("_before").isNotNull(), F.col("_before")).when(F.col("vision_calls") == 0, "BUDGET_EXCEEDED").when((F.col("vision_calls") == 2) & F.col("_premium"), "VISION_PREMIUM").otherwise(F.col("_called"))
    return out.withColumn("decision", decision).drop("_before", "_asks", "_second", "_premium", "_called")


def first_accepted(tiers: list[DataFrame], key: str) -> DataFrame:
    """Candidates of the first tier that accepts a page. tiers: DataFrames of the same columns, accepted among them."""
    every = None
    for k, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(k))
        every = t if every is None else every.unionByName(t)
    best = every.where("accepted").withColumn("_best", F.min("tier").over(Window.partitionBy(key)))
    return best.where("tier = _best").drop("_best")
