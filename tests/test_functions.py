"""Text, vectors, signals, page types, JSON, labels and settings, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from vitrine import config
from vitrine.functions import jsontext, labels, text, vector
from vitrine.functions.signals import has_signal, looks_multi, page_type, product_count, signals


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("given, want", [("Câmera Infantil", "camera infantil"), ("camera_infantil", "camera infantil"), ("Ação—X", "acao x"), ("  ", ""), ("儿童X200相机", "x200"), ("e\u0301a", "ea"), (None, None)])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize(F.col("t")), t=("string", given)) == want


@pytest.mark.parametrize("hay, needle, want", [("microfone sem fio", "fone", True), ("cabo usb", "usb", True), ("cabousb", "usb", False), ("abc", "", False), ("tv de mesa", "TV", True), ("cabo hdmi", "Hdmí", True)])
def test_contains_any(spark, hay, needle, want):
    assert one(spark, text.contains_any(F.col("h"), F.array("n")), h=("string", hay), n=("string", needle)) is want


def test_overlap_counts_tokens(spark):
    assert one(spark, text.overlap(F.array(F.lit("azul claro"), F.lit("Rosa")), F.array(F.lit("claro"), F.lit("rosa"), F.lit(None)))) == 2


@pytest.mark.parametrize(
    "given, codes",
    [("DSZJ-800 PCS/CX X200儿童相机/ 包好/ DQ-226", ["DSZJ-800", "X200", "DQ-226"]), ("EL-1177 60", ["EL-1177"]), ("EL-4043-CC", ["EL-4043-CC"]), ("CATÁLOGO 2026", ["LOGO2026"]), ("PCS/CX 60", ["CX60"]), ("el-10 J\u00a060", ["J60"]), ("", []), (None, [])],
)
def test_codes(spark, given, codes):
    assert one(spark, signals(F.col("t"))["codes"], t=("string", given)) == codes


def test_counters(spark):
    s = one(spark, signals(F.col("t")), t=("string", "R$ 15,9 R$15.90 R$ 1133\nUnid.CX 12 pcs / cx\n• item\n1) two\nCaixa de Som 6\r\nR$ 5 9\n12 34"))
    assert (s.prices, s.units, s.pieces, s.bullets, s.labels) == (4, 1, 1, 2, ["Caixa de Som"])
    flags = lambda t: one(spark, F.array(has_signal(signals(F.col("t"))), looks_multi(signals(F.col("t"))), product_count(signals(F.col("t"))) == 2), t=("string", t))
    assert flags("EL-10 EL-11") == [True, False, True] and flags("R$ 1 R$ 2") == [True, True, True] and flags("none") == [False, False, False]


CASES = [
    ("R$ 1", 0, 0.0, False, "unknown"), ("\n".join(f"Linha {c} {k}" for k, c in enumerate("abcde")), 0, 0.0, True, "summary"), ("Sumário", 0, 0.0, True, "summary"), ("Índice", 0, 0.0, True, "non_product"),
    ("aíndice", 0, 0.0, True, "summary"), ("R$ 1", 0, 0.9, True, "single_product"), ("R$ 1 R$ 2", 0, 0.0, True, "partial_grid"), ("R$ 1 " * 5, 0, 0.0, True, "partial_grid"), ("R$ 1 " * 6, 0, 0.0, True, "category_grid"),
    ("", 1, 0.349, True, "non_product"), ("", 1, 0.35, True, "cover"), ("CATÁLOGO", 2, 0.0, True, "cover"), ("catalogo", 3, 0.0, True, "unknown"), ("x", 3, 0.0, True, "unknown"), (None, 0, 0.0, True, "non_product"), ("Index R$ 1 R$ 2 R$ 3", 0, 0.0, True, "partial_grid"),
]


@pytest.mark.parametrize("body, images, fraction, layout, want", CASES)
def test_page_types(spark, body, images, fraction, layout, want):
    kind = page_type(signals(F.col("t")), F.col("t"), F.col("i"), F.col("f"), F.col("h"))
    assert one(spark, kind, t=("string", body), i=("int", images), f=("double", fraction), h=("boolean", layout)) == want


def test_vectors(spark):
    v = lambda x: ("array<double>", x)
    assert one(spark, vector.normalized(F.col("v")), v=v([3.0, 4.0])) == [0.6, 0.8]
    assert one(spark, vector.normalized(F.col("v")), v=v([0.0, 0.0])) == [0.0, 0.0]
    assert math.isclose(one(spark, vector.cosine_with(F.col("v"), [1.0, 1.0]), v=v([1.0, 0.0])), 0.5**0.5)
    assert one(spark, vector.cosine_with(F.col("v"), [1.0]), v=v([1.0, 0.0])) is None
    long = [float(k % 7) for k in range(400)]
    assert math.isclose(one(spark, vector.cosine_with(F.col("v"), long), v=v(long)), 1.0)
    assert one(spark, vector.literal(F.col("v")), v=("array<int>", [1, -2])) == "[1,-2]"
    assert one(spark, vector.nonzero(F.col("v")), v=v([0.0, 0.0])) is False and one(spark, vector.nonzero(F.col("v")), v=v(None)) is False
    with pytest.raises(Exception, match="expected 3 components"):
        one(spark, vector.checked(F.col("v"), 3), v=v([1.0]))


@pytest.mark.parametrize(
    "said, want",
    [('{"a":1}', {"a": 1}), ('ok\n```json\n{"a":1}\n```', {"a": 1}), ('sure {"a":{"b":"}"}} done', {"a": {"b": "}"}}), ('} {"a":1}', None), ('say "{" {"a":1}', {"a": 1}), ('a " b {"a":1}', None), ('{"a":1', None), ("", None), (None, None), ("\\{\"a\":1}", {"a": 1})],
)
def test_tolerant_json(said, want):
    if want is None:
        with pytest.raises(jsontext.Invalid):
            jsontext.tolerant(said)
    else:
        assert jsontext.tolerant(said) == want


def test_coercion():
    assert jsontext.strings("a, b;c\n d ") == ["a", "b", "c", "d"] and jsontext.strings(None) == [] and jsontext.strings([1, True, " x ", "", 1.0]) == ["1", "true", "x", "1"]
    p = {"namePt": " n ", "functionGroup": "g", "isKit": "false", "confidence": 3, "evidenceSource": "odd"}
    out = jsontext.product(p)
    assert out["name_pt"] == "n" and out["is_kit"] is True and out["confidence"] == 1.0 and out["evidence_source"] == "vision" and out["colors"] == []
    for bad in ({"namePt": ""}, {"category": " "}, {"confidence": "1"}, {"colors": {}}, {"functionGroup": None}):
        assert jsontext.analysis(__import__("json").dumps({"products": [p, p | bad]}))["error"]
    assert jsontext.analysis('{"products": []}') == {"page_number": 0, "products": [], "page_summary": None, "has_products": False, "error": None}


def test_boxes():
    new = jsontext.page_boxes('{"pageNumber": 2, "boxes": [{"x": 1, "y": 2, "width": 3, "height": 4}]}')
    assert new["boxes"] == [{"x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0, "confidence": 0.75}] and new["page_number"] == 2
    old = '"products": [{"box": {"x": 0, "y": 0, "width": 1, "height": 1}, "confidence": 2}]'
    assert jsontext.page_boxes("{" + old + "}")["boxes"] == []  # an older payload fits the new schema, without boxes
    assert jsontext.page_boxes('{"boxes": 1, ' + old + "}")["boxes"][0]["confidence"] == 1.0
    assert jsontext.page_boxes('{"boxes": [{"x": 1, "y": 2, "width": 0, "height": 4}]}')["error"]


def test_json_in_spark(spark):
    rows = spark.createDataFrame([("x {\"k\": 5} y",), ("no",), (None,)], "t string").select(F.try_variant_get(jsontext.tolerant_variant(F.col("t")), "$.k", "int").alias("k"))
    assert [r.k for r in rows.collect()] == [5, None, None]


def test_labels_and_formats(spark):
    assert one(spark, labels.label(labels.STATUS, F.col("k")), k=("string", "READY")) == "Pronto"
    assert one(spark, labels.label(labels.STATUS, F.col("k")), k=("string", "ODD")) == "ODD"
    assert one(spark, labels.shown_count(F.lit(None).cast("int"), F.lit(None).cast("int"))) == "—"
    assert one(spark, text.percent(F.lit(0.125))) == 13 and one(spark, text.percent(F.lit(-0.125))) == -12
    assert one(spark, text.storage_path(F.lit("https://h/storage/v1/object/public/b/a/c.jpg?x=1"))) == "a/c.jpg"
    assert one(spark, text.box_label(*[F.lit(v) for v in (1.5, 2.4, 3.0, 4.5)])) == "[2,2 3×5]"
    assert one(spark, text.usage_line(F.lit(3), F.lit(None).cast("int"))) == "in=3 out=? total=?"
    assert one(spark, text.collapsed(F.lit(" a \u00a0 b\n c "), 4)) == "a b "


def test_settings():
    s = config.Settings.of({"VISION_MAX_PAGES": "0", "VISION_JPEG_QUALITY": "x", "SEARCH_MODE": "odd", "VISION_DETECTOR_MODE": "OFF", "VISION_MAX_WIDTH": "3"})
    assert (s.vision_pages, s.vision_quality, s.search_mode, s.detector_mode, s.vision_width) == (0, 75, "page_mentions", "off", 1280)
    assert config.first(None, " ", "m") == "m" and config.page_list("3, 4,x,5") == {3, 4, 5}
