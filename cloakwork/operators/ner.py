"""Model detection behind an interface: a backend says which spans a chunk of text has; everything else is DataFrame work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks, spans, text
from ..functions.workers import ship
from ..plans import catalogue
from ..plans.settings import Settings
from . import detect

MODEL_SPAN = "type string, value string, start int, end int, confidence double"


class NullBackend:
    """No model: no spans."""

    method = "none"

    def load(self) -> Callable[[str], list[tuple]]:
        return lambda body: []


class CallableBackend:
    """A function from text to (label, start, end, confidence or None) tuples, loaded once a worker."""

    def __init__(self, loader: Callable[[], Callable[[str], list[tuple]]], method: str = "spacy"):
        self.loader, self.method = loader, method

    def load(self) -> Callable[[str], list[tuple]]:
        return self.loader()


def detect_model(docs: DataFrame, backend, id_col: str = "doc_id", text_col: str = "text", most: int = 512) -> DataFrame:
    """id, type, value, start, end, confidence, method: a model's spans, chunk by chunk, with offsets in the whole text."""
    pieces = docs.select(id_col, F.explode(chunks.by_sentence(F.col(text_col), most)).alias("c")).select(id_col, "c.offset", "c.chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend.load()
        for b in batches:
            rows = [(i, label, chunk[s:e], at + s, at + e, c) for i, at, chunk in zip(b[id_col], b["offset"], b["chunk"]) for label, s, e, c in model(chunk)]
            yield pd.DataFrame(rows, columns=[id_col, "label", "value", "start", "end", "model_confidence"])

    found = pieces.mapInPandas(run, f"`{id_col}` {kind}, label string, value string, start int, end int, model_confidence double")
    confidence = F.coalesce("model_confidence", detect.model_confidence(F.col("label"), F.col("value")))
    return found.select(id_col, detect.renamed(F.upper("label"), catalogue.TRANSFORMER_LABELS if backend.method == "transformers" else catalogue.MODEL_LABELS).alias("type"), "value", "start", "end", confidence.alias("confidence"), F.lit(backend.method).alias("method"))


def fuse(regex: DataFrame, model: DataFrame, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `entities`: pattern and model spans merged, post-processed and scored. A document's spans meet in its row."""
    fields = ["type", "value", "start", "end", "confidence", "method"]

    def listed(rows: DataFrame, name: str) -> DataFrame:
        span = F.struct(*[F.col(c).alias(c) for c in fields], F.lit("").alias("context"), F.lit(0.0).alias("agreement"))
        return rows.groupBy(F.col(id_col).alias(f"{name}_id")).agg(F.array_sort(F.collect_list(span)).alias(name))

    both = docs.join(listed(regex, "rx"), F.col(id_col) == F.col("rx_id"), "left").join(listed(model, "ai"), F.col(id_col) == F.col("ai_id"), "left")
    empty = "array<struct<type:string,value:string,start:int,end:int,confidence:double,method:string,context:string,agreement:double>>"
    both = both.withColumns({c: F.coalesce(F.col(c).cast(empty), F.array().cast(empty)) for c in ("rx", "ai")})
    both = both.withColumns({"_rx": detect.agree(F.col("rx"), F.col("ai")), "_ai": detect.agree(F.col("ai"), F.col("rx"))})
    merged = both.withColumn("entities", spans.once(detect.merge_model(F.col("_rx"), F.col("_ai"))))
    done = detect.post_process(merged, settings, text_col)
    return done.withColumn("entities", spans.once(detect.final_confidence(F.col("entities"), settings.confidence_weights))).select(*docs.columns, "entities")


def add_missing(regex: DataFrame, model: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The plainer merge: pattern rows, and the model's with other positions or types, types harmonised."""
    harmonised = [t.withColumn("type", detect.renamed(F.col("type"), catalogue.HARMONISED)) for t in (regex, model)]
    return harmonised[0].unionByName(harmonised[1].join(harmonised[0], [id_col, "start", "end", "type"], "left_anti"), allowMissingColumns=True)


def canonical(entities: DataFrame) -> DataFrame:
    """entities with `canonical`: a person's normalised name, else the value."""
    return entities.withColumn("canonical", F.when(F.col("type") == "PERSON", text.name_parts(F.col("value"))["canonical"]).otherwise(F.col("value")))
