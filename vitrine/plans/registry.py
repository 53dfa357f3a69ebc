"""All catalogue queries and their SQL, by name."""

from __future__ import annotations

from vitrine.plans import oracle, queries, records, records_sql, scenes, scenes_sql

NAMES = (
    "page_search knn_topk knn_top200_join vector_normalize vector_literal rerank_scores legacy_dedupe_top20 normalize_tokens search_text "
    "product_signals page_types cluster_1d gap_regions walk_to_gap content_bands point_in_cell nearest_anchor touching_pairs connected_images "
    "nms_flagged nms_refined nms_cards box_classes page_caps grid_detector card_detector composite_split crop_texts supplier_counts home_counts "
    "catalog_detail status_rollup decision_histogram mentions_by_page upsert_outcomes delete_cascade distinct_paths reprocess tolerant_json "
    "json_array_coerce display_labels structural_gate heuristic_gate cascade_decisions cascade_premium raster_stats stream_ingest"
).split()
QUERIES = {name: getattr(queries, name) for name in NAMES} | scenes.QUERIES | records.QUERIES
ORACLE_SQL = oracle.SQL | scenes_sql.SQL | records_sql.SQL
