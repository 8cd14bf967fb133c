"""Text from files: plain text, Word documents and, through given readers, PDF and scanned pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Takes a file's bytes; returns the text of each page (None for a page without).
PageReader = Callable[[bytes], list]

SCANNED_EMPTY = "[Aviso: Este PDF parece ser uma imagem escaneada. Processamento OCR falhou ou não encontrou texto.]"
MIN_PDF_CHARS = 50
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    """What follows the last dot of the path's last part, in lower case; empty without a dot."""
    return F.coalesce(F.regexp_extract(F.lower(path), r"\.([^./]*)\z", 1), F.lit(""))  # a path that is made is made once


def utf8_text(content: Column) -> Column:
    """Bytes as text, what is not UTF-8 replaced."""
    return F.make_valid_utf8(content.cast("string"))


def strict_utf8(files: DataFrame) -> DataFrame:
    """files (path, content) with text, only those that are UTF-8 throughout."""
    text = F.col("content").cast("string")
    return files.where(F.is_valid_utf8(text)).withColumn("text", text)


def docx_text(content: bytes) -> str:
    """The body's paragraphs, a line each; tables and headers are left out."""
    try:
        body = ElementTree.parse(io.BytesIO(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))).getroot().find(f"{_W}body")
    except Exception as error:
        raise ValueError(f"Erro ao processar DOCX: {error}") from error
    signs = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda _: "\t", f"{_W}br": lambda _: "\n", f"{_W}cr": lambda _: "\n"}
    lines = []
    for paragraph in body.findall(f"{_W}p") if body is not None else []:
        runs = [r for r in paragraph.iter(f"{_W}r")]
        lines.append("".join(signs[x.tag](x) for r in runs for x in r if x.tag in signs) + "\n")
    return "".join(lines)


def pdf_text(content: bytes, pages: PageReader | None, scanned: PageReader | None) -> str:
    """Page texts, a line end after each; under MIN_PDF_CHARS the pages are read as images."""
    if pages is None:
        raise ValueError("Erro ao processar PDF: no reader of PDF pages is given")
    try:
        text = "".join(f"{p}\n" for p in pages(content) if p)
        if len(text.strip()) < MIN_PDF_CHARS:
            text = scanned_text(content, scanned) or SCANNED_EMPTY
    except Exception as error:
        raise ValueError(f"Erro ao processar PDF: {error}") from error
    return text


def scanned_text(content: bytes, scanned: PageReader | None) -> str:
    """Text of page images; empty where there is no reader or it fails."""
    try:
        return "".join(f"{p}\n" for p in scanned(content)) if scanned else ""
    except Exception:
        return ""


def _binary(pages: PageReader | None, scanned: PageReader | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, content in zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    texts.append(docx_text(content) if kind == "docx" else pdf_text(content, pages, scanned))
                    errors.append(None)
                except ValueError as error:
                    texts.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return run


def extract_text(files: DataFrame, pages: PageReader | None = None, scanned: PageReader | None = None) -> DataFrame:
    """path, text and error of files (path, content), by the extension of path.

    txt and md are decoded in the engine; only pdf and docx go through Python. Other extensions have an error.
    """
    files = files.select("path", "content", extension(F.col("path")).alias("kind"))
    none = F.lit(None).cast("string")
    plain = files.where(F.col("kind").isin("txt", "md")).select("path", utf8_text(F.col("content")).alias("text"), none.alias("error"))
    binary = files.where(F.col("kind").isin("pdf", "docx")).mapInArrow(_binary(pages, scanned), "path string, text string, error string")
    other = files.where(~F.col("kind").isin("txt", "md", "pdf", "docx")).select("path", none.alias("text"), F.concat(F.lit("Formato não suportado: "), "kind").alias("error"))
    return plain.unionByName(binary).unionByName(other)


def read_files(spark: SparkSession, path: str, **readers) -> DataFrame:
    return extract_text(spark.read.format("binaryFile").load(path).select("path", "content"), **readers)


def write_json(rows: DataFrame, path: str, scores: tuple[str, ...] = (), digits: int = 4) -> None:
    """Rows as JSON lines, with the named scores rounded."""
    rows.withColumns({c: F.round(c, digits) for c in scores}).write.mode("overwrite").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
