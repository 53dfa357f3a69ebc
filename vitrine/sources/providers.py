"""Model providers: an interface, and a deterministic stand-in for use without a network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import text_or_space


class Provider(Protocol):
    """Answers prompts with JSON text, and embeds texts."""

    def analyze(self, prompt: str, image: bytes | None) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """No model: vectors of hashed words, and an empty page analysis. Stands in for tests and offline runs."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def analyze(self, prompt: str, image: bytes | None) -> str:
        return '{"products": [], "hasProducts": false}'

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[k, int.from_bytes(digest[:4], "little") % self.dimensions] += 1 if digest[4] & 1 else -1
            size = np.linalg.norm(out[k])
            out[k] = out[k] / size if size else out[k]
        return out.tolist()


def embedded(rows: DataFrame, text: str, make: Callable[[], Provider], name: str = "embedding") -> DataFrame:
    """Rows with a vector of their text; a provider is made once for each task and called once for each batch. A batch
    whose call fails keeps its rows, without vectors, and the error in column embedding_error."""

    @F.pandas_udf("vector array<double>, error string")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        for part in parts:
            try:
                yield pd.DataFrame({"vector": provider.embed(part.tolist()), "error": None})
            except Exception as e:  # noqa: BLE001  any failure of a provider is a value
                yield pd.DataFrame({"vector": [None] * len(part), "error": str(e)[:500]})

    out = rows.withColumn("_e", embed(text_or_space(F.coalesce(F.col(text), F.lit("")))))
    return out.withColumns({name: F.col("_e.vector"), f"{name}_error": F.col("_e.error")}).drop("_e")


def analyzed(pages: DataFrame, prompt: str, image: str, make: Callable[[], Provider]) -> DataFrame:
    """Pages with the provider's answer, or the error of a page whose call failed."""

    @F.pandas_udf("answer string, error string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        provider = make()
        for prompts, images in parts:
            rows = []
            for p, i in zip(prompts, images, strict=True):
                try:
                    rows.append((provider.analyze(p, i), None))
                except Exception as e:  # noqa: BLE001  one page's failure is that page's value
                    rows.append((None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return pages.withColumn("_a", ask(F.col(prompt), F.col(image))).select(*pages.columns, "_a.answer", F.col("_a.error").alias("answer_error"))


def page_prompt(supplier, file_name, page_number, page_text):
    """The prompt of a page analysis: a header if supplier or file is known, and up to 4000 characters of its text."""
    parts = [F.when(supplier.isNotNull(), F.concat(F.lit("Fornecedor: "), supplier)), F.when(file_name.isNotNull(), F.concat(F.lit("Arquivo: "), file_name))]
    header = F.concat_ws("\n", *parts)
    text = F.substring(F.coalesce(page_text, F.lit("")), 1, 4000)
    return F.concat_ws("\n\n", F.nullif(header, F.lit("")), F.format_string("Página %s. Responda somente com JSON.", page_number), F.when(text != "", F.concat(F.lit("Texto da página:\n"), text)))


def scaled_boxes(boxes, sx, sy):
    """Boxes of a downscaled image in the page's own pixels."""
    return F.transform(boxes, lambda b: F.struct((b["x"] * sx).alias("x"), (b["y"] * sy).alias("y"), (b["width"] * sx).alias("width"), (b["height"] * sy).alias("height"), b["confidence"].alias("confidence")))
