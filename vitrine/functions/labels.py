"""Display labels. All maps are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTION_GROUPS = {
    "charger": "Carregador", "tv_antenna": "Antena de TV", "tv_mount": "Suporte de TV", "blender_portable": "Liquidificador portátil",
    "cable_usb": "Cabo USB", "camera": "Câmera", "headphone": "Fone de ouvido", "speaker": "Caixa de som", "fan": "Ventilador",
    "iron": "Ferro de passar", "kettle": "Chaleira", "vacuum": "Aspirador", "unknown": "Desconhecido",
}
MATCH = {
    "exact": "Produto exato", "equivalent": "Produto equivalente", "variant": "Variação", "kit_contains": "Kit contém",
    "accessory": "Acessório", "related_but_not_match": "Relacionado", "rejected": "Rejeitado",
}
CONFIDENCE = {"high": "Alta", "medium": "Média", "low": "Baixa"}
STATUS = {"PROCESSING": "Processando", "READY": "Pronto", "FAILED": "Falhou"}
REJECT = {
    "too_small": "muito pequeno", "too_large": "muito grande", "too_horizontal": "muito horizontal", "too_vertical": "muito vertical",
    "mostly_white": "quase branco", "green_bar": "faixa verde", "green_dominant": "verde dominante", "orange_bar": "faixa laranja",
    "color_bar": "faixa colorida", "horizontal_bar": "barra horizontal", "vertical_column": "coluna vertical",
    "header_footer": "cabeçalho/rodapé", "empty_cell": "célula vazia", "insufficient_content": "sem conteúdo",
    "card_too_large": "card inteiro", "page_like_crop": "página inteira", "text_like": "texto/tabela",
    "no_central_object": "sem objeto central", "low_quality": "baixa qualidade", "invalid_box": "box inválido",
    "invalid_json": "JSON inválido", "duplicate": "duplicado", "low_confidence": "confiança baixa",
    "bad_card_boundary": "borda contaminada", "low_boundary": "borda fraca", "multi_card_crop": "vários cards",
    "non_product_page": "página ignorada", "no_product_signal": "sem sinal de produto",
    "grid_detection_failed": "grade não detectada", "no_products_detected": "sem produtos detectados",
    "fallback_used": "fallback heurístico",
}
DETECTOR = {
    "GRID_LAYOUT": "grid layout", "PDF_LAYOUT": "pdf layout", "VISION_JSON": "vision (legado)", "VISION_JSON_CHEAP": "vision JSON (legado)",
    "VISION_JSON_PREMIUM": "vision JSON premium (legado)", "VISION_BOXES_CHEAP": "vision boxes", "VISION_BOXES_PREMIUM": "vision premium",
    "HEURISTIC": "heurístico", "FALLBACK": "fallback",
}


def label(names: dict[str, str], key: Column) -> Column:
    """The key's label; the key itself if it has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def display_name(name_pt: Column, name: Column, detected: Column) -> Column:
    return F.coalesce(name_pt, name, detected)


def shown_count(*counts: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in counts], F.lit("—"))
