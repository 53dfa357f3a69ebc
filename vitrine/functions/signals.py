"""Product signals of a text, and the page types that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import EDGE, SPACES, trimmed

#: Patterns of codes, prices, packaging, list lines, summary entries and page keywords.
CODE = f"{EDGE}[A-Z]{{1,4}}[-{SPACES}]?\\d{{2,5}}(?:-[A-Z0-9]{{1,5}})?{EDGE}"
PRICE = f"R\\$[{SPACES}]?\\d{{1,4}}(?:[.,]\\d{{1,3}})?"
PIECES = f"(?i)PCS[{SPACES}]*/[{SPACES}]*CX"
UNITS = f"(?i)UNID\\.?[{SPACES}]*CX"
BULLET = f"^[{SPACES}]*(?:[•▪◦‣·\\-–]|\\d+[.)])[{SPACES}]+[^{SPACES}]"
SUMMARY = f"^[{SPACES}]*(.{{2,40}}?)[{SPACES}]+\\d{{1,3}}[{SPACES}]*$"
PRODUCT_LABEL = f"(?i)R\\$|PCS[{SPACES}]*/[{SPACES}]*CX|UNID"
COVER_WORDS = f"(?iu){EDGE}(?:cat[aá]logo|novidades|produtos|cole[cç][aã]o|institucional){EDGE}"
SUMMARY_WORDS = f"(?iu){EDGE}(?:sum[aá]rio|[ií]ndice|index|conte[uú]do){EDGE}"
#: Thresholds of the page types.
FULL_GRID, SUMMARY_ENTRIES, SUMMARY_PRODUCTS, COVER_FRACTION, COVER_IMAGES, UNKNOWN_IMAGES = 6, 5, 2, 0.35, 2, 3
NON_PRODUCT = ("cover", "summary", "non_product")
GRID_TYPES = ("category_grid", "partial_grid")


def signals(text: Column) -> Column:
    """A struct of product codes, counts of prices, packagings and list lines, and summary labels; null text has none."""
    body = F.coalesce(text, F.lit(""))
    codes = F.transform(F.regexp_extract_all(body, F.lit(CODE), F.lit(0)), lambda c: F.upper(F.regexp_replace(c, f"[{SPACES}]+", "")))
    rows = F.split(body, "\r?\n")
    labels = F.transform(F.filter(rows, lambda r: r.rlike(SUMMARY)), lambda r: trimmed(F.regexp_extract(r, SUMMARY, 1)))
    return F.struct(
        F.array_distinct(codes).alias("codes"),
        F.regexp_count(body, F.lit(PRICE)).alias("prices"),
        F.regexp_count(body, F.lit(PIECES)).alias("pieces"),
        F.regexp_count(body, F.lit(UNITS)).alias("units"),
        F.size(F.filter(rows, lambda r: r.rlike(BULLET))).alias("bullets"),
        F.filter(labels, lambda s: ~s.rlike(PRODUCT_LABEL) & s.rlike("[A-Za-zÀ-ÿ]")).alias("labels"),
    )


def has_signal(s: Column) -> Column:
    return (F.size(s["codes"]) > 0) | (s["prices"] > 0) | (s["pieces"] > 0) | (s["units"] > 0)


def looks_multi(s: Column) -> Column:
    return (s["prices"] >= 2) | (s["pieces"] >= 2) | (s["units"] >= 2) | (F.size(s["codes"]) >= 3)


def product_count(s: Column) -> Column:
    return F.greatest(s["prices"], s["pieces"], s["units"], F.size(s["codes"]))


def page_type(s: Column, text: Column, images: Column, image_fraction: Column, has_layout: Column) -> Column:
    """The first rule that holds names the type."""
    products, body = product_count(s), F.coalesce(text, F.lit(""))
    summary = ((F.size(s["labels"]) >= SUMMARY_ENTRIES) | body.rlike(SUMMARY_WORDS)) & (products <= SUMMARY_PRODUCTS)
    cover = (image_fraction >= COVER_FRACTION) | (body.rlike(COVER_WORDS) & (images <= COVER_IMAGES))
    return (
        F.when(~F.coalesce(has_layout, F.lit(False)), "unknown")
        .when(summary, "summary")
        .when(products >= FULL_GRID, "category_grid")
        .when(products >= 2, "partial_grid")
        .when(products == 1, "single_product")
        .when(cover, "cover")
        .when(images >= UNKNOWN_IMAGES, "unknown")
        .otherwise("non_product")
    )


def is_non_product(kind: Column) -> Column:
    return kind.isin(*NON_PRODUCT)
