"""Folders of DOCX, PDF, HTML and text files into paragraphs."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.tables import EXTENSIONS
from clausemill.operators import paragraphs as P


def scan(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """(source, rel_path, ext, content, content_hash) of all supported files below ``folder``; others aren't opened."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{any_case}}}").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    root = folder.rstrip("/").removeprefix("file:")
    rel = F.replace(F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/*", "/"), F.lit("\\"), F.lit("/"))
    rel = F.substring(rel, len(root) + 2, F.length(rel))
    return files.select(F.lit(source).alias("source"), rel.alias("rel_path"), ext.alias("ext"), "content", F.sha2("content", 256).alias("content_hash")).where(ext.isin(*EXTENSIONS))


def docx_paragraphs(data: bytes) -> list[tuple[str, int | None, str | None]] | None:
    """(text, heading level, raw XML) of each paragraph; null for a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml")
        root = ElementTree.fromstring(xml)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for p in root.iter():
        if local(p) != "p":
            continue
        if not out and p.tag.startswith("{"):
            ElementTree.register_namespace("w", p.tag[1:].partition("}")[0])  # raw XML keeps its usual prefix
        text, level = [], None
        for e in p.iter():
            name = local(e)
            if name == "t" or name == "instrText":
                text.append(e.text or "")
            elif name in ("tab", "br", "cr"):
                text.append(" ")
            elif name == "pStyle":
                style = next((v for k, v in e.attrib.items() if k.endswith("val")), "").replace(" ", "").lower()
                level = 1 if style == "title" else int(style[7:]) if style[:7] == "heading" and style[7:].isdigit() and 1 <= int(style[7:]) <= 9 else level
        line = " ".join("".join(text).split())
        if line:
            out.append((line, level, ElementTree.tostring(p, encoding="unicode")))
    return out


def pdf_text(data: bytes) -> str | None:
    """The text layer, where a PDF library is installed; null otherwise (no optical recognition)."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    except Exception:  # noqa: BLE001  a broken file is passed over
        return None


#: para_no of the one row that a file has which couldn't be read; its text is the reason.
FAILED = -1


def parse(files: DataFrame) -> DataFrame:
    """(source, rel_path, para_no, text, heading_level, ooxml) of the files that can be read."""
    return attempt(files).where(F.col("para_no") != FAILED)


def attempt(files: DataFrame) -> DataFrame:
    """As parse(), and one row with para_no FAILED for each file that can't be read; each format by its own reader, one union."""
    keyed = files.withColumn("k", F.concat_ws("\x01", "source", "rel_path"))
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    plain = P.from_text(keyed.where(F.col("ext").isin("txt", "md")).select("k", valid.alias("text")), "k", "text")
    web = P.from_html(keyed.where(F.col("ext").isin("html", "htm")).select("k", valid.alias("html")), "k", "html")

    def word(batches):
        for batch in batches:
            rows = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = docx_paragraphs(c)
                rows += [(k, FAILED, "not a readable DOCX file", None, None)] if found is None else [(k, i, *p) for i, p in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["k", "para_no", "text", "heading_level", "ooxml"])

    doc = keyed.where("ext = 'docx'").select("k", "content").mapInArrow(word, "k string, para_no int, text string, heading_level int, ooxml string")

    def pdf(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pdf_text(c) for c in batch.column(1).to_pylist()], type=pa.string())], names=["k", "text"])

    layer = keyed.where("ext = 'pdf'").select("k", "content").mapInArrow(pdf, "k string, text string")
    scanned = P.from_text(layer, "k", "text")
    bad = layer.where("text is null").select("k", F.lit(FAILED).alias("para_no"), F.lit("no PDF library, or a broken file").alias("text"))
    empty = lambda df: df.select("k", F.col("para_no").cast("int").alias("para_no"), "text", F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("string").alias("ooxml"))
    every = empty(plain).unionByName(empty(scanned)).unionByName(empty(bad)).unionByName(doc).unionByName(web.select("k", F.col("para_no").cast("int").alias("para_no"), "text", "heading_level", F.lit(None).cast("string").alias("ooxml")))
    return every.select(F.split_part("k", F.lit("\x01"), F.lit(1)).alias("source"), F.split_part("k", F.lit("\x01"), F.lit(2)).alias("rel_path"), "para_no", "text", "heading_level", "ooxml")
