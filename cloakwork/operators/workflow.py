"""The document entry: detection, pseudonymisation, validation and figures of each document, and its export.

Everything up to the export is one narrow stage. A language model may refine what detection finds; without one the answers
are fixed, so a run without a server gives the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text
from ..functions.workers import ship
from ..plans import catalogue
from ..plans.settings import Settings
from ..sources import files
from . import anonymize, audit, detect, ner

# Heads of an export's sections, and what is said where no model answers.
AUDIT_HEAD, FIGURES_HEAD = "=== AUDIT REPORT ===", "=== STATISTICS ==="
UNKNOWN, NO_SERVER = "unknown", "server unavailable"


def process(docs: DataFrame, settings: Settings = Settings(), mode: str = "regex", backend=None, table=catalogue.RUNTIME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities, tokens, anonymized, validation figures, status, error, detection_method and result_hash.

    mode: `regex`, or `ai`, which adds a backend's spans and falls back to patterns where there is none. An entity below
    settings.min_confidence goes. Null and blank texts have status `error` and nothing found.
    """
    clean = docs.withColumn(text_col, F.coalesce(text.preprocess(F.col(text_col).cast("string")), F.lit("")))
    found = detect.detect(clean, table, settings, text_col)
    model = mode == "ai" and backend is not None and backend.method != "none"
    if model:
        regex = detect.exploded(found, id_col).select(id_col, "type", "value", "start", "end", "confidence", F.lit("regex").alias("method"))
        fused = ner.fuse(regex, ner.detect_model(clean, backend, id_col, text_col), clean, settings, id_col, text_col)
        label = F.transform("entities", lambda e: e.withField("replacement", detect.label(e["type"])))
        found = fused.withColumn("entities", spans.once(label))
    if settings.min_confidence > 0:
        found = found.withColumn("entities", F.filter("entities", lambda e: F.coalesce(e["confidence"], F.lit(1.0)) >= settings.min_confidence))
    done = audit.validation(anonymize.anonymize(found, settings, text_col), text_col)
    blank = F.trim(text_col) == ""
    return done.withColumns(
        {
            "status": F.when(blank, "error").otherwise("success"),
            "error": F.when(blank, "no text found in the document"),
            "detection_method": F.lit("ai" if model else "regex"),
            "result_hash": F.substring(F.md5("anonymized"), 1, 16),
        }
    )


def throughput(entities: int, size: int, seconds: float) -> dict[str, float]:
    """Entities and bytes a second; 0 for no time."""
    return {"entities_per_second": entities / seconds if seconds > 0 else 0.0, "bytes_per_second": size / seconds if seconds > 0 else 0.0}


def section(head: str, figures: dict[str, Column]) -> Column:
    """A head and a line `name: value` for each figure."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in figures.items()]
    return F.concat_ws("\n", F.lit(head), *lines)


def figures() -> dict[str, dict[str, Column]]:
    """What an export reports of a processed document, by section."""
    n = F.size("entities")
    by_type = F.transform(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["type"]))), lambda k: F.concat(k, F.lit("="), F.size(F.filter("entities", lambda e: e["type"] == k)).cast("string")))
    return {
        AUDIT_HEAD: {"detection_method": F.col("detection_method"), "success": F.col("success"), "not_replaced": F.col("not_replaced_count"), "potential_leaks": F.col("potential_leaks"), "result_hash": F.col("result_hash")},
        FIGURES_HEAD: {"total_entities": n, "entity_types": F.array_join(by_type, ", "), "original_length": F.col("original_length"), "anonymized_length": F.col("anonymized_length")},
    }


def export_text(watermark: str = "", with_audit: bool = False) -> Column:
    """The text as it is exported: the watermark above it, the sections below."""
    head = [F.lit(f"{watermark}\n\n")] if watermark else []
    tail = [F.concat(F.lit("\n\n"), section(k, v), F.lit("\n")) for k, v in figures().items()] if with_audit else []
    return F.concat(*head, F.col("anonymized"), *tail)


def replacements() -> Column:
    """array<struct<value,token>>: each variant and its token, the longest first, for rewriting a container."""
    pairs = F.flatten(F.transform("tokens", lambda t: F.transform(t["variants"], lambda v: F.struct((-F.length(v)).alias("n"), v.alias("value"), t["token"].alias("token")))))
    return F.transform(F.array_sort(F.array_distinct(pairs)), lambda p: F.struct(p["value"].alias("value"), p["token"].alias("token")))


def export(processed: DataFrame, folder: str, kind: str = "txt", watermark: str = "", with_audit: bool = False, source: str | None = None, id_col: str = "doc_id", content_col: str | None = None) -> None:
    """Writes processed documents as a table of id and content in `folder`, never over the source or anything that is there.

    kind: `txt`; `docx`, from `content_col` (the original file, rewritten run by run) or, without it, of plain paragraphs.
    """
    if source is not None and folder.rstrip("/") == source.rstrip("/"):
        raise ValueError("the output can't be the source")
    if kind == "txt":
        out = processed.select(id_col, export_text(watermark, with_audit).alias("content"))
    elif kind == "docx" and content_col:
        more = F.array(*[section(k, v) for k, v in figures().items()]) if with_audit else F.array().cast("array<string>")
        out = files.rewritten_docx(processed.select(id_col, F.col(content_col).alias("file"), replacements().alias("pairs"), more.alias("sections")), id_col, watermark)
    elif kind == "docx":
        out = files.as_docx(processed.withColumn("anonymized", export_text(watermark, with_audit)), id_col)
    else:
        raise ValueError(f"no such export format: {kind}")
    out.write.mode("errorifexists").parquet(folder)


def reviewed(processed: DataFrame, client: Callable[[], Callable[[str, str], str | None]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kind, coherent, issues, suggestions of each document, by a language model.

    client: loads, once a worker, a function from (question, text) to an answer, or None where the server doesn't answer. The
    questions are `kind`, `coherence` (answered by issues, a line each; none: coherent) and `suggestions`. Without a client, or
    an answer, the kind is unknown, the document coherent, and the issue and suggestion that no server is there.
    """
    schema = f"{id_col} {processed.schema[id_col].dataType.simpleString()}, kind string, coherent boolean, issues array<string>, suggestions string"
    if client is None:
        return processed.select(id_col, F.lit(UNKNOWN).alias("kind"), F.lit(True).alias("coherent"), F.array(F.lit(NO_SERVER)).alias("issues"), F.lit(NO_SERVER).alias("suggestions"))
    ship(processed.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for b in batches:
            rows = []
            for i, body, out in zip(b[id_col], b[text_col], b["anonymized"]):
                kind, issues, hints = ask("kind", body), ask("coherence", out), ask("suggestions", out)
                lines = [NO_SERVER] if issues is None else [x for x in issues.splitlines() if x.strip()]
                rows.append((i, (kind or "").strip().lower() or UNKNOWN, issues is None or not lines, lines, NO_SERVER if hints is None else hints))
            yield pd.DataFrame(rows, columns=[id_col, "kind", "coherent", "issues", "suggestions"])

    return processed.select(id_col, text_col, "anonymized").mapInPandas(run, schema)
