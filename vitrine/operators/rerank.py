"""Commercial re-ranking: one decision table over token overlaps and similarity, as a single expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import contains_any, normalize, overlap, token_set


@dataclass(frozen=True)
class Profile:
    """What an image query asks for."""

    main_product: str
    function_group: str
    category: str | None = None
    colors: tuple[str, ...] = ()
    visual_attributes: tuple[str, ...] = ()
    technical_attributes: tuple[str, ...] = ()
    commercial_use: str | None = None
    synonyms: tuple[str, ...] = ()
    must_not_match: tuple[str, ...] = ()


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def reranked(mentions: DataFrame, profile: Profile) -> DataFrame:
    """Add match_type, confidence, score and reason. mentions: name_pt, function_group, category, commercial_use,
    description_pt, colors, visual_attributes, technical_attributes, is_kit, kit_contains, similarity."""
    s = clamped(F.col("similarity"))
    group = F.coalesce(normalize(F.col("function_group")), F.lit(""))
    wanted = normalize(F.lit(profile.function_group))
    hay = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name_pt", "function_group", "category", "commercial_use", "description_pt")], _list("visual_attributes"), _list("technical_attributes"))
    asked = token_set(_strings([profile.main_product, *profile.synonyms]))
    offered = token_set(F.array("name_pt", "function_group", "description_pt"))
    first = lambda t: F.split(t, " ")[0]
    facts = mentions.withColumns(
        {
            "_s": s,
            "_banned": contains_any(hay, _strings(profile.must_not_match)),
            "_kit": F.coalesce(F.col("is_kit"), F.lit(False)) & (F.size(_list("kit_contains")) > 0) & contains_any(F.array_join(_list("kit_contains"), " "), _strings([profile.main_product, profile.function_group, *profile.synonyms])),
            "_same": (group != "") & (wanted != "") & (group.contains(wanted) | wanted.contains(group)),
            "_near": (group != "") & (first(wanted) != "") & (first(group) == first(wanted)),
            "_main": F.exists(F.array_intersect(asked, offered), lambda t: F.length(t) >= 4),
            "_colors": overlap(_strings(profile.colors), _list("colors")),
            "_attributes": overlap(_strings(profile.visual_attributes), _list("visual_attributes")) + overlap(_strings(profile.technical_attributes), _list("technical_attributes")),
        }
    )
    c = {k: F.col(f"_{k}") for k in ("s", "banned", "kit", "same", "near", "main", "colors", "attributes")}
    n_colors = F.size(_list("colors"))
    all_colors = F.lit(not profile.colors) | (n_colors == 0) | (c["colors"] >= F.least(F.lit(len(profile.colors)), n_colors))
    counted = lambda what, n: F.when(n > 0, F.concat(F.lit(f"{what} ("), n.cast("string"), F.lit(")")))
    why = F.concat_ws(
        ", ",
        F.when(c["same"], "mesma função comercial").when(c["near"], "função comercial próxima"),
        F.when(c["main"], "produto principal compatível"),
        counted("cor em comum", c["colors"]),
        counted("atributos compatíveis", c["attributes"]),
    )
    row = lambda kind, confidence, at_zero, slope, reason: F.struct(F.lit(kind).alias("match_type"), confidence.alias("confidence"), (F.lit(at_zero) + F.lit(slope) * c["s"]).alias("score"), reason.alias("reason"))
    level = lambda test, yes, no: F.when(test, yes).otherwise(no)
    low = F.lit("low")
    table = [
        (c["banned"], row("rejected", low, 0.05, 0.05, F.lit("Combina visualmente mas a função comercial está na lista mustNotMatch."))),
        (c["kit"], row("kit_contains", level(c["same"] | (c["s"] > 0.78), "high", "medium"), 0.7, 0.2, F.lit(f"Kit contém {profile.main_product}."))),
        (c["same"] & c["main"] & all_colors & (c["s"] >= 0.6), row("exact", level(c["s"] >= 0.7, "high", "medium"), 0.08, 0.92, why)),
        (c["same"] & c["main"], row("equivalent", level(c["s"] >= 0.62, "medium", "low"), 0.05, 0.85, why)),
        (c["same"], row("variant", level((c["s"] >= 0.7) & ((c["colors"] > 0) | (c["attributes"] > 0)), "medium", "low"), 0.0, 0.7, why)),
        (c["near"], row("variant", level(c["s"] >= 0.7, "medium", "low"), 0.0, 0.55, why)),
        (c["s"] < 0.35, row("rejected", low, 0.05, 0.05, F.lit("Função comercial diferente e baixa similaridade textual."))),
    ]
    decided = None
    for test, out in table:
        decided = F.when(test, out) if decided is None else decided.when(test, out)
    decided = decided.otherwise(row("related_but_not_match", low, 0.0, 0.35, F.lit("Função comercial diferente, mas algum sinal textual em comum.")))
    return facts.withColumn("_d", decided).select(*mentions.columns, "_d.match_type", "_d.confidence", "_d.score", "_d.reason")
