"""Pages of documents: from PDF bytes through a page extractor, or from plain text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = "doc_id string, page_number int, text string, html string, confidence double, has_tables boolean, has_figures boolean, word_count int, error string"
#: bytes of a document -> (text, html, has_tables, has_figures) of each page; None for what is to be told from the text.
Extractor = Callable[[bytes], list]


def text_layer(content: bytes) -> list:
    """The text layer of a PDF, by an optional library."""
    import fitz  # optional

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [(p.get_text("text"), p.get_text("html"), bool(p.find_tables().tables), bool(p.get_images())) for p in doc]


def by_fitz(content: bytes, dpi: int) -> Iterator[np.ndarray]:
    """Pixels of the pages, height * width * channels, one page at a time."""
    import fitz  # optional

    with fitz.open(stream=content, filetype="pdf") as doc:
        for p in doc:
            x = p.get_pixmap(dpi=dpi)
            yield np.frombuffer(x.samples, np.uint8).reshape(x.height, x.width, x.n)


def by_pdf2image(content: bytes, dpi: int) -> Iterator[np.ndarray]:
    from pdf2image import convert_from_bytes, pdfinfo_from_bytes  # optional

    for k in range(1, pdfinfo_from_bytes(content)["Pages"] + 1):
        yield np.asarray(convert_from_bytes(content, dpi=dpi, first_page=k, last_page=k)[0])


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels: grey is repeated, a fourth channel is taken as cover over white."""
    image = image[:, :, None] if image.ndim == 2 else image
    if image.shape[2] in (2, 4):
        cover = image[:, :, -1:].astype(float) / 255
        image = (image[:, :, :-1] * cover + 255 * (1 - cover)).round().astype(np.uint8)
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]


class Rendered:
    """Extractor that renders pages and hands them to a vision model, in batches: ``read(images) -> texts``.

    At most ``batch`` pages are in memory. A renderer whose library is not there leaves the document to the next one.
    """

    def __init__(self, read: Callable[[list], list], dpi: int = 150, batch: int = 5, renderers: tuple = (by_pdf2image, by_fitz), prepare: Callable | None = None) -> None:
        self.read, self.dpi, self.batch, self.renderers, self.prepare = read, dpi, batch, renderers, prepare

    def __call__(self, content: bytes) -> list:
        for k, renderer in enumerate(self.renderers):
            try:
                images, out = renderer(content, self.dpi), []
                while some := [rgb(x) if self.prepare is None else self.prepare(rgb(x)) for x in islice(images, self.batch)]:
                    out += [(text, None, None, None) for text in self.read(some)]
                return out
            except ImportError:
                if k + 1 == len(self.renderers):
                    raise
        return []


def extract(documents: DataFrame, extractor: Extractor = text_layer, confidence: float = 0.90) -> DataFrame:
    """documents: doc_id, content. One row per page, or one with an error for a document that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, content in zip(pdf.doc_id, pdf.content):
                try:
                    out += [(doc, k, *page, None) for k, page in enumerate(extractor(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  kept in the row
                    out.append((doc, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "text", "html", "has_tables", "has_figures", "error"]).astype({"page_number": "Int32", "has_tables": "boolean", "has_figures": "boolean"})

    rows = documents.select(F.col("doc_id").cast("string"), "content").mapInPandas(run, "doc_id string, page_number int, text string, html string, has_tables boolean, has_figures boolean, error string")
    return described(rows, confidence)


def described(rows: DataFrame, confidence: float) -> DataFrame:
    """Adds what the extractor left open: html, tables, figures, words."""
    rows = rows.withColumn("html", F.coalesce("html", T.to_html(F.col("text"))))
    return rows.select(
        "doc_id", "page_number", "text", "html", F.when(F.col("text").isNotNull(), F.lit(confidence)).alias("confidence"), F.coalesce("has_tables", T.has_tables(F.col("html"), F.col("text"))).alias("has_tables"), F.coalesce("has_figures", T.has_figures(F.col("html"), F.col("text"))).alias("has_figures"), T.count_words(F.col("text")).alias("word_count"), "error"
    )


def full_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, full_text: pages in order, each under its mark."""
    page = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), "text")
    got = pages.filter("text IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", page.alias("page")))).alias("all"))
    return got.select(key, F.array_join(F.transform("all", lambda p: p["page"]), "\n\n").alias("full_text"))


def page_text(pages: DataFrame, number: int) -> DataFrame:
    """doc_id, text of one page; empty where a document has no such page."""
    own = pages.filter(F.col("page_number") == number).select("doc_id", F.col("text").alias("own"))
    return pages.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", F.coalesce("own", F.lit("")).alias("text"))


def serialised(pages: DataFrame, seconds: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """doc_id, json: a document's pages as one JSON object, with the time they took and what else is known, as columns of the document give it."""
    names = ["page_number", "text", "html", "confidence", "has_tables", "has_figures", "word_count"]
    time = (F.lit(None).cast("double") if seconds is None else seconds).alias("seconds")
    more = (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata")
    got = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("pages"), F.max(time).alias("seconds"), F.first(more).alias("metadata"))
    head = F.struct(F.col("doc_id").alias("document_path"), F.size("pages").alias("total_pages"), F.col("seconds").alias("processing_time_seconds"), "metadata", "pages")
    return got.select("doc_id", F.to_json(head, {"ignoreNullFields": "false"}).alias("json"))
