"""Search in documents: literal or regex, by line, with absolute offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text

# Patterns offered for quick searches.
QUICK = {
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phones": r"(?:\+33|0)[1-9](?:[0-9\s.-]{8,})",
    "addresses": r"\b\d+\s+[A-Za-z\s]+(?:rue|avenue|boulevard)",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]+\b",
    "names": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
}


def pattern(query: str, case_sensitive: bool = False, whole_words: bool = False, regex: bool = False) -> str:
    """A regex stands for itself: whole_words is about literal queries."""
    body = query if regex else text.quoted(query)
    return ("(?U)" if case_sensitive else "(?iU)") + (rf"\b(?:{body})\b" if whole_words and not regex else body)


HITS = "array<struct<line:int,at:int,content:string>>"


def hit_lines(body: Column, p: str) -> Column:
    """array<struct<line,at,content>>: each line with a match, its number from 1 and where it starts. One pass over the text."""
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("at"), F.array().cast(HITS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        met = F.when(x.rlike(p), F.array_append(s["out"], F.struct(s["line"].alias("line"), s["at"].alias("at"), x.alias("content"))).cast(HITS)).otherwise(s["out"])
        return F.struct((s["line"] + 1).alias("line"), (s["at"] + F.length(x) + 1).alias("at"), met.alias("out"))

    return F.aggregate(F.split(body, "\n", -1), start, step, lambda s: s["out"])


def search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, line, match, start, end: every match, with offsets in the whole text. Lines without one are never rows, and no row
    carries the text."""
    p = pattern(query, **options)
    rows = docs.where(F.col(text_col).rlike(p)).select(id_col, spans.once(hit_lines(F.col(text_col), p)).alias("hits"))
    found = rows.select(id_col, F.inline("hits")).select(id_col, "line", "at", F.inline_outer(spans.find(F.col("content"), p))).where("value is not null")
    return found.select(id_col, "line", F.col("value").alias("match"), (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))


def quick(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The search by one of the QUICK patterns."""
    return search(docs, QUICK[name], id_col, text_col, regex=True)


def with_entities(found: DataFrame, entities: DataFrame, query: str, id_col: str = "doc_id", case_sensitive: bool = False) -> DataFrame:
    """The matches and the entities whose `type: value` holds the query; these have no line."""
    spelt = F.concat("type", F.lit(": "), "value")
    met = spelt.contains(query) if case_sensitive else F.lower(spelt).contains(query.lower())
    hits = entities.where(met).select(id_col, F.lit(None).cast("int").alias("line"), F.lit(query).alias("match"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"))
    return found.unionByName(hits)
