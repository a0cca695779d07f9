"""Received files: kinds, refusals, identity, names, stamps and the choice between native text and OCR."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenio.functions.text import useful_characters

# Signatures, limits and the stamp of the intake policy.
SIGNATURES = (("pdf", "255044462D"), ("png", "89504E470D0A1A0A"), ("jpg", "FFD8FF"))
PDF_WITHIN = 1024
MAX_BYTES = 25 * 1024 * 1024
MAX_PAGES = 150
LEAST_NATIVE = 80
STAMP = "FICTÍCIO"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, content) of all files below a path, in any store Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def kind_of(content: Column) -> Column:
    """pdf, png, jpg or null, by the bytes; a PDF's mark may follow within its first kilobyte."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, mark in SIGNATURES:
        out = out.when(F.startswith(content, F.unhex(F.lit(mark))), kind)
    return out.when(F.contains(F.substring(content, 1, PDF_WITHIN), F.unhex(F.lit(SIGNATURES[0][1]))), "pdf")


def refusal(content: Column, pages: Column | None = None, encrypted: Column | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """The first reason against a file, or null.

    pages, encrypted: what a PDF reader found, null pages for one it couldn't read; without a reader these reasons don't arise.
    """
    kind = kind_of(content)
    out = F.when(content.isNull() | (F.length(content) == 0), "empty").when(F.length(content) > max_bytes, "too_large").when(kind.isNull(), "unknown_kind")
    if encrypted is not None:
        out = out.when((kind == "pdf") & encrypted, "encrypted")
    if pages is not None:
        out = out.when((kind == "pdf") & pages.isNull(), "corrupt").when((kind == "pdf") & (pages > MAX_PAGES), "too_many_pages")
        out = out.when((kind == "pdf") & (pages == 0), "no_pages")
    return out


def identity(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def short_id(sha256: Column) -> Column:
    return F.substring(sha256, 1, 12)


def first_of_each(files: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in order; a hot key meets as partial minima, not as rows."""
    rest = [c for c in files.columns if c != key and c not in order]
    first = files.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(key, *[F.col(f"first.{c}").alias(c) for c in (*order, *rest)])


def safe_name(name: Column) -> Column:
    kept = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}._\- ()]", ""))
    return F.substring(F.coalesce(F.nullif(kept, F.lit("")), F.lit("documento")), 1, 120)


def stamped(pages: DataFrame, stamp: str = STAMP) -> DataFrame:
    """Rows (doc_id, is_synthetic) from rows (doc_id, page_no, text): the stamp counts on the first two pages."""
    there = F.coalesce(F.contains(F.upper("text"), F.lit(stamp)), F.lit(False)) & (F.col("page_no") <= 2)
    return pages.groupBy("doc_id").agg(F.bool_or(there).alias("is_synthetic"))


def reading_method(text: Column) -> Column:
    return F.when(useful_characters(text) < LEAST_NATIVE, "ocr").otherwise("native")


def recognised_lines(boxes: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, text, ocr_conf) from recognised boxes (doc_id, page_no, x, y, height, text, score).

    Boxes go down the page; one joins the line as long as it is near the line's first box. A page is one group.
    """

    def assemble(page: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []
        for box in page.sort_values(["y", "x"], kind="stable").itertuples():
            near = lines and abs(box.y - lines[-1][0].y) < max(6.0, 0.5 * box.height)
            lines[-1].append(box) if near else lines.append([box])
        text = "\n".join(" ".join(b.text for b in sorted(line, key=lambda b: b.x)) for line in lines)
        return pd.DataFrame({"doc_id": page["doc_id"].iloc[:1], "page_no": page["page_no"].iloc[:1], "text": text, "ocr_conf": page["score"].mean()})

    kind = boxes.schema["doc_id"].dataType.simpleString()
    return boxes.groupBy("doc_id", "page_no").applyInPandas(assemble, f"doc_id {kind}, page_no int, text string, ocr_conf double")


def read_pages(files: DataFrame, engine: Callable[[], Callable[[bytes], list[tuple[str, str, float]]]]) -> DataFrame:
    """Rows (doc_id, page_no, text, method, ocr_conf) by an injected reader.

    engine: called once for each task; gives a function from a file's bytes to (text, method, confidence) of its pages.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            rows = [(i, n, *page) for i, content in zip(batch["doc_id"], batch["content"], strict=True) for n, page in enumerate(read(content), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "method", "ocr_conf"])

    return files.select("doc_id", "content").mapInPandas(each, "doc_id string, page_no int, text string, method string, ocr_conf double")


def keep_latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Upsert: of each key the row with the largest `by`."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def listing(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents with n_pages and n_ocr."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("method") == "ocr").alias("n_ocr"))
    out = documents.join(counts, "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_pages", "n_ocr")})


def with_metadata(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files (sha256, ...) with `meta`, what a declared list (sha256, meta) says of a file of that content; the first entry of several counts."""
    known = sources.groupBy("sha256").agg(F.min_by("meta", "ordinal").alias("meta"))
    return files.join(known, "sha256", "left")
