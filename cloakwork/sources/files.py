"""Sources and sinks: text, DOCX and PDF files, labelled corpora, entity and state JSON, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import ship
from ..plans.settings import Settings

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ENTITY = (
    "id string, doc_id string, type string, value string, start int, end int, confidence double, replacement string, page int, context string, method string, "
    "source_model string, total_occurrences int, variants array<string>, all_positions array<struct<start:int,end:int>>"
)
GROUP = "id string, name string, description string, type string, token string, entity_ids array<string>"
FORMATS = ("txt", "docx", "pdf", "doc")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def binary(spark: SparkSession, path: str, settings: Settings = Settings(), types=FORMATS) -> DataFrame:
    """path, modificationTime, length, content, extension, hash of files of supported types and sizes; Spark lists no file without a byte."""
    files = listed(spark, path, types).where(F.col("length") <= settings.max_file_bytes)
    return files.withColumn("hash", F.md5("content"))


def listed(spark: SparkSession, path: str, types=FORMATS) -> DataFrame:
    """Files of supported types and any size; a file's content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(*types))


def refused(spark: SparkSession, path: str, settings: Settings = Settings(), types=FORMATS) -> DataFrame:
    """path, text, meta, error: a row for each file that is too large to be read, to stand beside those of `documents`."""
    large = listed(spark, path, types).where(F.col("length") > settings.max_file_bytes)
    return large.select("path", F.lit(None).cast("string").alias("text"), F.create_map(F.lit("length"), F.col("length").cast("string")).alias("meta"), F.concat(F.lit("file over "), F.lit(str(settings.max_file_bytes)), F.lit(" bytes")).alias("error"))


def info(files: DataFrame) -> DataFrame:
    from ..functions import text

    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), text.file_size(F.col("length")).alias("size_formatted"), "extension", F.col("modificationTime").alias("modified"), "hash")


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Each content once, without those whose hash was seen."""
    return files.dropDuplicates(["hash"]).join(seen.select("hash"), "hash", "left_anti")


def decoded(content: Column) -> Column:
    """UTF-8, without its mark; Latin-1 where it isn't that."""
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return F.coalesce(utf8, F.decode(content, "ISO-8859-1"))


def docx_text(data: bytes) -> tuple[str, dict]:
    """Paragraphs, tables as rows of cells, headers and footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        lines, tables = [], 0
        spell = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
        paragraphs = [s for p in body.findall(f"{W}p") if (s := spell(p)).strip()]
        lines += paragraphs
        for table in body.findall(f"{W}tbl"):
            tables += 1
            lines.append(f"--- Tableau {tables} ---")
            lines += [" | ".join(spell(c).strip() for c in row.findall(f"{W}tc")) for row in table.findall(f"{W}tr")]
        for kind, mark in (("header", "[EN-TÊTE]"), ("footer", "[PIED DE PAGE]")):
            for n in sorted(n for n in names if n.startswith(f"word/{kind}") and n.endswith(".xml")):
                lines += [f"{mark} {s}" for p in ElementTree.fromstring(z.read(n)).iter(f"{W}p") if (s := spell(p)).strip()]
    return "\n".join(lines), {"format": "docx", "paragraphs": str(len(paragraphs)), "tables": str(tables)}


def pdf_text(data: bytes) -> tuple[str, dict]:
    """Pages under markers, by whichever library is installed."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            pages = [p.extract_text() or "" for p in pdf.pages]
    except ImportError:
        import fitz

        pages = [p.get_text() for p in fitz.open(stream=data, filetype="pdf")]
    return "\n".join(f"--- Page {k} ---\n{p}" for k, p in enumerate(pages, 1)), {"format": "pdf", "pages": str(len(pages))}


def documents(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """path, text, meta, error of files. Text files are decoded in the JVM; containers go through Python, one file at a time.

    A text over settings.max_text_chars is cut, and meta then says truncated = true. `refused` has the files that `binary`
    leaves out.
    """
    most = settings.max_text_chars
    ship(files.sparkSession)
    plain = files.where("extension = 'txt'").withColumn("whole", decoded(F.col("content"))).withColumn("text", F.substring("whole", 1, most))
    encoding = F.when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("latin-1")
    plain = plain.select("path", "text", F.create_map(F.lit("format"), F.lit("txt"), F.lit("encoding"), encoding, F.lit("length"), F.length("text").cast("string"), F.lit("lines"), F.size(F.split("text", "\n")).cast("string"), F.lit("truncated"), (F.length("whole") > most).cast("string")).alias("meta"), F.when(F.trim("text") == "", "empty document").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, data in zip(b["path"], b["extension"], b["content"]):
                try:
                    body, meta = {"docx": docx_text, "pdf": pdf_text}[kind](data)
                    rows.append((path, body[:most], meta | {"truncated": str(len(body) > most).lower()}, None if body.strip() else "empty document"))
                except (KeyError, ValueError, ImportError, zipfile.BadZipFile, ElementTree.ParseError, RuntimeError) as e:
                    rows.append((path, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "meta", "error"])

    packed = files.where("extension <> 'txt'").select("path", "extension", "content").mapInPandas(run, "path string, text string, meta map<string,string>, error string")
    return plain.unionByName(packed)


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """tokens, labels of a folder of JSON files, one document each."""
    return spark.read.schema("tokens array<string>, labels array<string>").option("multiLine", "true").json(path)


def entities_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY).option("multiLine", "true").json(path)


def write_entities(entities: DataFrame, path: str) -> None:
    entities.write.mode("errorifexists").json(path)


def state_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and groups of a saved state."""
    state = spark.read.schema(f"version string, entities array<struct<{_fields(ENTITY)}>>, groups array<struct<{_fields(GROUP)}>>").option("multiLine", "true").json(path)
    return state.select(F.inline("entities")), state.select(F.inline("groups"))


def write_state(entities: DataFrame, groups: DataFrame, path: str) -> None:
    """One object: meant for one case's tables, which fit one row."""
    e = entities.agg(F.collect_list(F.struct(*entities.columns)).alias("entities"))
    g = groups.agg(F.collect_list(F.struct(*groups.columns)).alias("groups"))
    e.crossJoin(g).select(F.lit("1.0").alias("version"), "entities", "groups").write.mode("errorifexists").json(path)


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in ddl.split(", ")))


def write_texts(anonymized: DataFrame, path: str, id_col: str = "doc_id", out_col: str = "anonymized", watermark: str = "") -> None:
    """Anonymised texts beside their ids as Parquet; never over what is there."""
    body = F.concat(F.col(out_col), F.lit(f"\n\n{watermark}")) if watermark else F.col(out_col)
    anonymized.select(id_col, body.alias("text")).write.mode("errorifexists").parquet(path)


def write_json(report: DataFrame, path: str) -> None:
    """Merge histories, mappings, metrics: a JSON object a row."""
    report.write.mode("errorifexists").json(path)


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Saved figures: name, value."""
    return spark.read.schema("name string, value double").json(path)


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").option("header", "true").csv(path)


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A document of plain paragraphs."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def as_docx(anonymized: DataFrame, id_col: str = "doc_id", out_col: str = "anonymized") -> DataFrame:
    """id, content: each anonymised text as a DOCX file's bytes."""

    ship()

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: docx_bytes((t or "").split("\n")))

    return anonymized.select(id_col, pack(F.col(out_col)).alias("content"))


def rewrite_docx(data: bytes, pairs: list[tuple[str, str]], watermark: str = "", sections: tuple[str, ...] = ()) -> bytes:
    """The file with each value replaced in every run of body, tables, headers, footers and notes, and in its properties; the
    layout stays. A value that is split between runs is not found. The watermark and sections are paragraphs of their own."""
    parts = ("document.xml", "header", "footer", "footnotes.xml", "endnotes.xml", "comments.xml")
    out = io.BytesIO()

    def spelt(body: str | None) -> str | None:
        for value, token in pairs:
            body = body.replace(value, token) if body else body
        return body

    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            content = z.read(item.filename)
            name = item.filename
            if name.endswith(".xml") and (name.startswith("docProps/") or name.startswith("word/") and name[5:].startswith(parts)):
                for prefix, (_, uri) in enumerate(n for _, n in ElementTree.iterparse(io.BytesIO(content), ["start-ns"])):
                    if uri not in ElementTree._namespace_map:
                        ElementTree.register_namespace(f"x{prefix}", uri)
                root = ElementTree.fromstring(content)
                for e in root.iter() if name.startswith("docProps/") else root.iter(f"{W}t"):
                    e.text = spelt(e.text)
                if name == "word/document.xml":
                    body = root.find(f"{W}body")
                    if watermark:
                        body.insert(0, _paragraph(watermark))
                    last = body.find(f"{W}sectPr")
                    at = list(body).index(last) if last is not None else len(body)
                    for k, line in enumerate(x for s in sections for x in s.split("\n")):
                        body.insert(at + k, _paragraph(line))
                content = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            to.writestr(item, content)
    return out.getvalue()


def _paragraph(body: str) -> ElementTree.Element:
    p = ElementTree.Element(f"{W}p")
    t = ElementTree.SubElement(ElementTree.SubElement(p, f"{W}r"), f"{W}t")
    t.text = body
    return p


def rewritten_docx(found: DataFrame, id_col: str = "doc_id", watermark: str = "") -> DataFrame:
    """id, content: rewrite_docx of rows of (id, file, pairs: array<struct<value,token>>, sections). Null where a file can't be read."""
    ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data, pairs, sections in zip(b["file"], b["pairs"], b["sections"]):
                try:
                    out.append(rewrite_docx(data, [(x["value"], x["token"]) for x in pairs], watermark, tuple(sections)))
                except (KeyError, TypeError, zipfile.BadZipFile, ElementTree.ParseError):
                    out.append(None)
            yield pd.DataFrame({id_col: b[id_col], "content": out})

    return found.mapInPandas(run, f"`{id_col}` {found.schema[id_col].dataType.simpleString()}, content binary")
