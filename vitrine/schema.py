"""Explicit schemas of the catalogue tables. Strings that stand for a choice are checked where rows are appended."""

from __future__ import annotations

SUPPLIER = "id string, name string, created_at timestamp_ntz, updated_at timestamp_ntz"
CATALOG = "id string, supplier_id string, file_name string, status string, page_count int, image_count int, candidate_count int, page_product_count int, pdf_storage_path string, error string, created_at timestamp_ntz, updated_at timestamp_ntz"
PRODUCT_IMAGE = "id string, catalog_id string, image_url string, width int, height int, file_size int, embedding array<float>, created_at timestamp_ntz"
CATALOG_PAGE = "id string, catalog_id string, page_number int, image_url string, width int, height int, created_at timestamp_ntz"
PRODUCT_CANDIDATE = (
    "id string, catalog_id string, page_id string, original_url string, crop_url string, card_url string, width int, height int, file_size int, source_type string, "
    "crop_x int, crop_y int, crop_width int, crop_height int, detected_label string, function_group string, confidence double, is_searchable boolean, quality_score double, "
    "reject_reason string, product_name string, product_name_pt string, category string, model string, original_text string, description_pt string, source_detector string, "
    "vision_confidence double, raw_vision_json string, embedding array<float>, created_at timestamp_ntz"
)
PAGE_ANALYSIS = "id string, catalog_id string, page_id string, page_number int, provider string, model string, raw_json string, products_count int, error string, created_at timestamp_ntz"
PAGE_PRODUCT_MENTION = (
    "id string, catalog_id string, page_id string, page_number int, name_pt string, original_name string, description_pt string, category string, function_group string, "
    "colors array<string>, visual_attributes array<string>, technical_attributes array<string>, not_confuse_with array<string>, commercial_use string, is_kit boolean, "
    "kit_contains array<string>, confidence double, evidence_text string, evidence_source string, search_text string, embedding array<float>, raw_json string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
TABLES = {
    "supplier": SUPPLIER,
    "catalog": CATALOG,
    "product_image": PRODUCT_IMAGE,
    "catalog_page": CATALOG_PAGE,
    "product_candidate": PRODUCT_CANDIDATE,
    "page_analysis": PAGE_ANALYSIS,
    "page_product_mention": PAGE_PRODUCT_MENTION,
}
#: Choices of the columns that have them.
CHOICES = {
    ("catalog", "status"): ("PROCESSING", "READY", "FAILED"),
    ("product_candidate", "source_type"): ("PAGE_CROP", "EMBEDDED_IMAGE", "MANUAL"),
    ("page_product_mention", "evidence_source"): ("vision", "pdf_text", "both", "manual"),
}
#: Columns that may not be null, besides id.
REQUIRED = {
    "supplier": ("name",),
    "catalog": ("supplier_id", "file_name", "status"),
    "product_image": ("catalog_id", "image_url", "width", "height"),
    "catalog_page": ("catalog_id", "page_number", "image_url", "width", "height"),
    "product_candidate": ("catalog_id", "original_url", "crop_url", "width", "height", "source_type"),
    "page_analysis": ("catalog_id", "page_id", "page_number", "raw_json"),
    "page_product_mention": ("catalog_id", "page_id", "page_number", "name_pt", "search_text"),
}
#: Columns whose null means an empty list.
LISTS = ("colors", "visual_attributes", "technical_attributes", "not_confuse_with", "kit_contains")
