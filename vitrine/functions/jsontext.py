"""JSON out of model answers: tolerant parsing, and coercion to fixed schemas."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json|JSON)?\s*(.*?)```", re.S)
_SIGNS = re.compile(r'\\.|["{}]', re.S)
EVIDENCE = ("vision", "pdf_text", "both", "manual")

STRINGS = T.ArrayType(T.StringType(), False)
PRODUCT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name_pt", "original_name", "description_pt", "category", "function_group", "commercial_use", "evidence_text", "evidence_source")]
    + [T.StructField(n, STRINGS) for n in ("colors", "visual_attributes", "technical_attributes", "kit_contains", "not_confuse_with")]
    + [T.StructField("is_kit", T.BooleanType()), T.StructField("confidence", T.DoubleType())]
)
ANALYSIS = T.StructType(
    [T.StructField("page_number", T.IntegerType()), T.StructField("products", T.ArrayType(PRODUCT)), T.StructField("page_summary", T.StringType()), T.StructField("has_products", T.BooleanType()), T.StructField("error", T.StringType())]
)
_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height", "confidence")])
BOXES = T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("boxes", T.ArrayType(_BOX)), T.StructField("error", T.StringType())])


class Invalid(ValueError):
    """A payload that does not fit its schema."""


def balanced_object(text: str) -> str | None:
    """The first {...} whose braces balance, strings left out. Outside a string a backslash is an ordinary sign; a quote
    before the object opens a string, and a closing brace before it makes the depth negative, so nothing is found."""
    depth, start, inside, at = 0, -1, False, 0
    while found := _SIGNS.search(text, at):
        sign, at = found[0], found.end()
        if sign[0] == "\\":
            if not inside:
                at = found.start() + 1
        elif sign == '"':
            inside = not inside
        elif not inside:
            if sign == "{":
                start = found.start() if depth == 0 else start
                depth += 1
            else:
                depth -= 1
                if depth == 0 and start >= 0:
                    return text[start:at]
    return None


def _no_constant(name: str):
    raise ValueError(name)


def tolerant(text: str | None):
    """The JSON value of a text as it is, of its first fenced part, or of its first balanced object; Invalid if none parses."""
    text = text or ""
    fence = _FENCE.search(text)
    inner = (fence[1] if fence else text).strip()
    for part in (lambda: text, lambda: inner, lambda: balanced_object(inner)):
        try:
            return json.loads(part() or "", parse_constant=_no_constant)
        except ValueError:
            continue
    raise Invalid("no valid JSON object found")


def _needed(value) -> str:
    if not isinstance(value, str) or not value.strip():
        raise Invalid("a text is missing")
    return value.strip()


def _optional(value) -> str | None:
    return None if value is None else _needed(value)


def _shown(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def strings(value) -> list[str]:
    """A list of trimmed texts of null, a list of plain values, or a text with , ; or line breaks."""
    if value is None:
        return []
    if isinstance(value, str):
        parts = re.split(r"[,;\n]", value)
    elif isinstance(value, list) and all(isinstance(v, (str, int, float)) for v in value):
        parts = [_shown(v) for v in value]
    else:
        raise Invalid("not a list of texts")
    return [p.strip() for p in parts if p.strip()]


def _number(value, default: float | None = None) -> float:
    if value is None and default is not None:
        return default
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise Invalid("not a number")
    return float(value)


def _page_number(value) -> int | None:
    if value is None:
        return None
    n = _number(value)
    if n < 0 or n != int(n):
        raise Invalid("not a page number")
    return int(n)


def product(p) -> dict:
    if not isinstance(p, dict):
        raise Invalid("not a product")
    if "confidence" in p and p["confidence"] is None:
        raise Invalid("not a number")
    out = {"name_pt": _needed(p.get("namePt")), "function_group": _needed(p.get("functionGroup"))}
    for key in ("originalName", "descriptionPt", "category", "commercialUse", "evidenceText"):
        out[re.sub("([A-Z])", lambda m: "_" + m[1].lower(), key)] = _optional(p.get(key))
    for key in ("colors", "visualAttributes", "technicalAttributes", "kitContains", "notConfuseWith"):
        out[re.sub("([A-Z])", lambda m: "_" + m[1].lower(), key)] = strings(p.get(key))
    source = p.get("evidenceSource")
    kit = p.get("isKit", False)
    out |= {"evidence_source": source if source in EVIDENCE else "vision", "is_kit": kit not in (None, False, 0, "") and kit == kit}
    return out | {"confidence": min(1.0, max(0.0, _number(p.get("confidence"), 0.5)))}


def _rows(value) -> list:
    if value is None:
        raise Invalid("not a list")
    if not isinstance(value, list):
        raise Invalid("not a list")
    return value


def analysis(text: str | None) -> dict:
    """A page analysis; one product that does not fit rejects the page, which then has an error and no products."""
    try:
        value = tolerant(text)
        if not isinstance(value, dict):
            raise Invalid("not an object")
        rows = [product(p) for p in _rows(value.get("products", []))]
        flag = value.get("hasProducts")
        if "hasProducts" in value and not isinstance(flag, bool):
            raise Invalid("not a flag")
        return {"page_number": _page_number(value.get("pageNumber")) or 0, "products": rows, "page_summary": _optional(value.get("pageSummary")), "has_products": flag if isinstance(flag, bool) else bool(rows), "error": None}
    except Invalid as e:
        return {"page_number": None, "products": [], "page_summary": None, "has_products": False, "error": str(e)[:500]}


def _box(b, needs_confidence: bool) -> dict:
    if not isinstance(b, dict):
        raise Invalid("not a box")
    own = {k: _number(b.get(k)) for k in ("x", "y", "width", "height")}
    if own["width"] <= 0 or own["height"] <= 0:
        raise Invalid("an empty box")
    if "confidence" in b and b["confidence"] is None:
        raise Invalid("not a number")
    return own | {"confidence": min(1.0, max(0.0, _number(b.get("confidence"), None if needs_confidence else 0.75)))}


def page_boxes(text: str | None) -> dict:
    """Boxes of the new payload {boxes: [...]}, else of the older one {products: [{box, confidence}]}.

    An older payload without `boxes` fits the new schema, with no boxes; only one whose `boxes` do not fit comes to the
    older schema.
    """
    try:
        value = tolerant(text)
        if not isinstance(value, dict):
            raise Invalid("not an object")
        number = _page_number(value.get("pageNumber"))
        try:
            rows = [_box(b, False) for b in _rows(value.get("boxes", []))]
        except Invalid:
            rows = []
            for p in _rows(value.get("products")):
                if not isinstance(p, dict) or not isinstance(p.get("box"), dict):
                    raise
                rows.append(_box(p["box"] | {"confidence": p.get("confidence")}, True))
        return {"page_number": number, "boxes": rows, "error": None}
    except Invalid as e:
        return {"page_number": None, "boxes": [], "error": str(e)[:500]}


@F.pandas_udf(ANALYSIS)
def parse_analysis(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([analysis(t) for t in text], columns=ANALYSIS.names)


@F.pandas_udf(BOXES)
def parse_boxes(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_boxes(t) for t in text], columns=BOXES.names)


@F.pandas_udf(T.StringType())
def _balanced(text: pd.Series) -> pd.Series:
    return text.map(balanced_object, na_action="ignore")


def tolerant_variant(text: Column) -> Column:
    """A VARIANT of the text, its fenced part or its first balanced object; null if none parses. Braces are searched, in
    Python, only in rows that do not parse without."""
    fenced = F.regexp_extract(text, "(?s)```(?:json|JSON)?\\s*(.*?)```", 1)
    inner = F.when(text.rlike("(?s)```(?:json|JSON)?\\s*.*?```"), fenced).otherwise(text)
    plain = F.coalesce(F.try_parse_json(text), F.try_parse_json(inner))
    return F.coalesce(plain, F.try_parse_json(_balanced(F.when(plain.isNull(), inner))))


def string_list(value: Column) -> Column:
    """Trimmed texts that are not blank, of a text with , ; or line breaks."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[,;\n]"), F.trim), lambda s: s != "")
