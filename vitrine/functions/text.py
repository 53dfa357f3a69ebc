"""Text expressions: normalisation, tokens, phrase containment, labelled search texts, formats."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as ECMAScript regular expressions define them (fixed values).
SPACES = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WORD = "[A-Za-z0-9_]"
#: An ASCII word boundary; Java's own is Unicode-aware.
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


@cache
def _accents() -> tuple[str, str]:
    """Lower-case Latin and Greek letters with marks, and what is left of each without them."""
    with_marks, without = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != chr(code):
            with_marks.append(chr(code))
            without.append(bare)
    return "".join(with_marks), "".join(without)


def strip_accents(text: Column) -> Column:
    """Letters without their marks, composed or not."""
    return F.regexp_replace(F.translate(text, *_accents()), "[\\u0300-\\u036F]", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def normalize(text: Column) -> Column:
    """Lower case, no accents, every other run of characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(text)), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return tokens_of(normalize(text))


def tokens_of(normal: Column) -> Column:
    """The tokens of a text that is normalised already."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def token_set(values: Column) -> Column:
    """Distinct tokens of an array of strings; nulls bring none."""
    each = F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()), tokens)
    return F.array_distinct(F.flatten(each))


def overlap(a: Column, b: Column) -> Column:
    """Number of tokens that two arrays of strings share."""
    return F.size(F.array_intersect(token_set(a), token_set(b)))


def contains_any(text: Column, phrases: Column) -> Column:
    """Whether a phrase stands in the text as whole words, or anywhere if it has 4 characters or more."""
    padded = F.concat(F.lit(" "), normalize(text), F.lit(" "))
    hit = lambda p: (p != "") & (padded.contains(F.concat(F.lit(" "), p, F.lit(" "))) | ((F.length(p) >= 4) & padded.contains(p)))
    return F.exists(F.transform(phrases, normalize), hit)


def present(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def labelled(label: str, values: Column) -> Column:
    """'label: a, b' for a non-empty array, else null."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def lines(parts: Iterable[Column]) -> Column:
    """The parts that are not blank, one to a line."""
    return F.concat_ws("\n", *[present(p) for p in parts])


def _prefixed(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def mention_search_text(c: dict[str, Column]) -> Column:
    """What a page's product mention is embedded by."""
    kit = F.when(c["is_kit"], labelled("kit contém", c["kit_contains"]))
    return lines(
        [c["name_pt"], c["original_name"], c["description_pt"], c["category"], _prefixed("função", c["function_group"]), _prefixed("uso", c["commercial_use"])]
        + [labelled("cores", c["colors"]), labelled("aspecto", c["visual_attributes"]), labelled("técnico", c["technical_attributes"]), kit]
        + [labelled("Não confundir com", c["not_confuse_with"])]
    )


def query_search_text(c: dict[str, Column]) -> Column:
    """What a query profile is embedded by; the function group is always labelled."""
    return lines(
        [c["main_product"], F.concat(F.lit("função: "), c["function_group"]), c["category"], _prefixed("uso", c["commercial_use"]), labelled("cores", c["colors"])]
        + [labelled("aspecto", c["visual_attributes"]), labelled("técnico", c["technical_attributes"]), labelled("sinônimos", c["synonyms"])]
        + [labelled("Não confundir com", c["must_not_match"])]
    )


def collapsed(text: Column, most: int) -> Column:
    """White space as single spaces, trimmed, cut at `most` characters."""
    return F.substring(trimmed(F.regexp_replace(text, f"[{SPACES}]+", " ")), 1, most)


def percent(x: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(x * 100 + 0.5)


def shown_date(at: Column) -> Column:
    """Day, month and year, as a Brazilian page shows them."""
    return F.date_format(at, "dd/MM/yyyy")


def numbered_path(folder: Column, kind: str, number: Column, width: int) -> Column:
    return F.concat(folder, F.lit(f"/{kind}-"), F.lpad(number.cast("string"), width, "0"), F.lit(".jpg"))


def storage_path(url: Column) -> Column:
    """The place in the bucket that a public URL names; null for other URLs."""
    return F.nullif(F.regexp_extract(url, "/object/public/[^/]+/([^?]+)", 1), F.lit(""))


def media_type(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.when(end == "png", "image/png").when(end == "webp", "image/webp").otherwise("image/jpeg")


def box_label(x: Column, y: Column, width: Column, height: Column) -> Column:
    whole = lambda v: F.floor(v + 0.5).cast("string")
    return F.concat(F.lit("["), whole(x), F.lit(","), whole(y), F.lit(" "), whole(width), F.lit("×"), whole(height), F.lit("]"))


def text_or_space(text: Column) -> Column:
    """What a batch sends to an embedding provider: never an empty text."""
    return F.when(trimmed(F.coalesce(text, F.lit(""))) == "", F.lit(" ")).otherwise(text)


def usage_line(given: Column, made: Column) -> Column:
    """Token usage for the log: 'in=… out=… total=…' with ? for what is unknown."""
    shown = lambda v: F.coalesce(v.cast("string"), F.lit("?"))
    return F.concat(F.lit("in="), shown(given), F.lit(" out="), shown(made), F.lit(" total="), shown(given + made))
