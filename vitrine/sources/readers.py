"""Readers: layout documents, page images, embedded images, uploads."""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = "pages array<struct<pageNumber int, width double, height double, blocks array<struct<type string, x double, y double, width double, height double, text string>>>>"
BLOCK_TYPES = ("text", "image", "drawing")
#: Characters of a block's text that are kept.
TEXT_MOST = 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each layout file: path and pages; a file that does not parse has null pages and stops nothing."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return layout_documents(texts, "value")


def layout_documents(rows: DataFrame, column: str) -> DataFrame:
    """Rows with `pages` parsed from a JSON column; null where it does not fit the schema."""
    parsed = F.from_json(column, LAYOUT, {"mode": "PERMISSIVE"})
    pages = parsed["pages"]
    bad_block = lambda b: ~F.coalesce(b["type"].isin(*BLOCK_TYPES), F.lit(False)) | b["x"].isNull() | b["y"].isNull() | b["width"].isNull() | b["height"].isNull()
    bad = lambda p: p["pageNumber"].isNull() | p["width"].isNull() | p["height"].isNull() | p["blocks"].isNull() | F.exists(p["blocks"], bad_block)
    fits = pages.isNotNull() & ~F.exists(pages, bad)
    return rows.withColumn("pages", F.when(fits, pages)).drop(column)


def layout_blocks(documents: DataFrame, key: str) -> DataFrame:
    """Blocks of all pages: key, page_number, page_width, page_height, block_id, type, x, y, width, height, text."""
    pages = documents.select(key, F.explode("pages").alias("p"))
    blocks = pages.select(key, F.col("p.pageNumber").alias("page_number"), F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.posexplode_outer("p.blocks").alias("block_id", "b"))
    rounded = [F.round(f"b.{c}", 2).alias(c) for c in ("x", "y", "width", "height")]
    return blocks.select(key, "page_number", "page_width", "page_height", "block_id", "b.type", *rounded, F.substring("b.text", 1, TEXT_MOST).alias("text")).where("type is null or (width >= 1 and height >= 1)")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rasters: path, width, height, channels, data in red-green-blue order."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            rows = []
            for origin, h, w, c, data in batch[["origin", "height", "width", "nChannels", "data"]].itertuples(index=False):
                flat = np.frombuffer(data, np.uint8).reshape(-1, c)
                way = [2, 1, 0, *range(3, c)] if c >= 3 else list(range(c))
                rows.append((origin, w, h, c, flat[:, way].tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "data"])

    return raw.mapInPandas(order, "path string, width int, height int, channels int, data binary")


def numbered_images(spark: SparkSession, path: str, glob: str = "page-*.jpg") -> DataFrame:
    """Page images in the order of their numbers: path, page_number, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    number = F.regexp_extract("path", "page-(\\d+)\\.jpg$", 1)
    return files.where(number != "").select("path", number.cast("int").alias("page_number"), "content").orderBy("page_number")


def embedded_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files that an extractor left: path, content, in order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,ppm,pbm,pnm}").load(path).select("path", "content").orderBy("path")


def _extracted(files: DataFrame, command: list[str], found: str) -> DataFrame:
    """Files (path, content) given to an external program, once each, with what it leaves: path, number, content, error.

    command: the program and its arguments, {source} and {folder} in them; found: a pattern of the files it leaves, whose
    numbers are the last in their names. One file's failure is one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                with tempfile.TemporaryDirectory() as folder:
                    source = Path(folder) / "in.pdf"
                    source.write_bytes(content)
                    try:
                        subprocess.run([c.format(source=source, folder=folder) for c in command], check=True, capture_output=True, timeout=600)
                        left = [(int(re.findall(r"\d+", p.stem)[-1]), p) for p in Path(folder).glob(found) if re.search(r"\d", p.stem)]
                        rows = [(path, n, p.read_bytes(), None) for n, p in sorted(left)]
                    except (OSError, subprocess.SubprocessError) as e:
                        rows = [(path, None, None, str(e)[:500])]
                yield pd.DataFrame(rows, columns=["path", "number", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, number int, content binary, error string")


def extracted_images(pdfs: DataFrame, program: str = "pdfimages") -> DataFrame:
    """Embedded images of PDFs (path, content) by an external program: path, number, content, error."""
    return _extracted(pdfs, [program, "-all", "{source}", "{folder}/image"], "image-*")


def extracted_layouts(pdfs: DataFrame, open_pdf: Callable[[bytes], Iterable] | None = None) -> DataFrame:
    """Layout blocks of PDFs (path, content): path, pages as layout_documents gives them, error.

    open_pdf gives the pages of a PDF, each with rect (width, height), get_text("dict") and get_drawings(), as PyMuPDF's
    have; that is what is used if none is given and it is installed. A box goes if a side is under a point; places are
    rounded to two digits; a text is its spans, a space after each line, trimmed and cut. A PDF that can't be read gives
    null pages and the error; drawings that can't be read are left out.
    """

    def blocks_of(page) -> list[dict]:
        boxes = []
        for b in page.get_text("dict").get("blocks", []):
            kind = ("text", "image")[b["type"]] if b.get("type", 0) in (0, 1) else None
            if kind and b.get("bbox"):
                said = "".join("".join(s.get("text", "") for s in line.get("spans", [])) + " " for line in b.get("lines", [])).strip() if kind == "text" else ""
                boxes.append((kind, tuple(b["bbox"]), said[:TEXT_MOST] or None))
        try:
            boxes += [("drawing", (d["rect"].x0, d["rect"].y0, d["rect"].x1, d["rect"].y1), None) for d in page.get_drawings() if d.get("rect") is not None]
        except Exception:  # noqa: BLE001  drawings are not needed
            pass
        wide = [(kind, x, y, x2 - x, y2 - y, said) for kind, (x, y, x2, y2), said in boxes]
        return [{"type": k, "x": round(x, 2), "y": round(y, 2), "width": round(w, 2), "height": round(h, 2), "text": said} for k, x, y, w, h, said in wide if w >= 1 and h >= 1]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = open_pdf
        if opened is None:
            try:
                import fitz

                opened = lambda content: fitz.open(stream=content, filetype="pdf")
            except ImportError:
                opened = None
        for batch in batches:
            rows = []
            for path, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    if opened is None:
                        raise RuntimeError("no program to read PDFs is installed")
                    pages = [{"pageNumber": n + 1, "width": round(p.rect.width, 2), "height": round(p.rect.height, 2), "blocks": blocks_of(p)} for n, p in enumerate(opened(content))]
                    rows.append((path, pages, None))
                except Exception as e:  # noqa: BLE001  one PDF's failure is that PDF's value
                    rows.append((path, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    return pdfs.select("path", "content").mapInPandas(read, f"path string, {LAYOUT}, error string")


def rendered_pages(pdfs: DataFrame, dpi: int = 180, program: str = "pdftoppm") -> DataFrame:
    """Page images of PDFs (path, content) by an external program: path, page_number, content, error.

    A PDF that the program can't render, or a machine without it, gives one row with the error."""
    return _extracted(pdfs, [program, "-jpeg", "-r", str(dpi), "{source}", "{folder}/page"], "page-*.jpg").withColumnRenamed("number", "page_number")
