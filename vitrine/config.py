"""Settings as values with defaults and floors; an invalid one means its default."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def whole(env: Mapping[str, str], name: str, default: int, least: int = 1) -> int:
    """The setting if it is a whole number of at least `least`, else the default."""
    try:
        value = int(str(env.get(name, "")).strip())
    except ValueError:
        return default
    return value if value >= least else default


def choice(env: Mapping[str, str], name: str, options: tuple[str, ...]) -> str:
    """One of the options; the first if the setting is none of them."""
    value = str(env.get(name, "")).strip().lower()
    return value if value in options else options[0]


def first(*values: str | None) -> str | None:
    """The first that is not blank: a chain of model names."""
    return next((v.strip() for v in values if v and v.strip()), None)


def page_list(text: str | None) -> set[int]:
    """Numbers of a list like '3,4,5'; what is no number is left out."""
    return {int(p) for p in (text or "").replace(" ", "").split(",") if p.lstrip("-").isdigit()}


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of the engine."""

    search_mode: str = "page_mentions"
    index_mode: str = "page_mentions"
    detector_mode: str = "auto"
    vision_pages: int = 20
    vision_width: int = 1280
    vision_quality: int = 75
    box_tokens: int = 800
    page_tokens: int = 2400
    query_tokens: int = 1200
    query_width: int = 1024
    text_dimensions: int = 1536
    image_dimensions: int = 768

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        return cls(
            search_mode=choice(env, "SEARCH_MODE", ("page_mentions", "legacy_visual")),
            index_mode=choice(env, "INDEX_MODE", ("page_mentions", "legacy_crops")),
            detector_mode=choice(env, "VISION_DETECTOR_MODE", ("auto", "always", "off")),
            vision_pages=whole(env, "VISION_MAX_PAGES", cls.vision_pages, 0),
            vision_width=whole(env, "VISION_MAX_WIDTH", cls.vision_width, 256),
            vision_quality=whole(env, "VISION_JPEG_QUALITY", cls.vision_quality, 1),
            box_tokens=whole(env, "VISION_MAX_TOKENS", cls.box_tokens),
            page_tokens=whole(env, "PAGE_ANALYZER_MAX_TOKENS", cls.page_tokens),
            query_tokens=whole(env, "QUERY_ANALYZER_MAX_TOKENS", cls.query_tokens),
            query_width=whole(env, "QUERY_ANALYZER_WIDTH", cls.query_width, 256),
            text_dimensions=whole(env, "TEXT_EMBEDDING_DIMENSIONS", cls.text_dimensions),
        )
