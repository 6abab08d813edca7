"""Reports over entity rows (type, value, start, end, confidence, method, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import audit


def count_by(entities: DataFrame, *columns: str) -> DataFrame:
    return entities.groupBy(*columns).agg(F.count("*").alias("n"))


def type_shares(entities: DataFrame) -> DataFrame:
    """type, n, share (per cent); the most frequent first. The total is one small row, joined to the few types."""
    counts = count_by(entities, "type")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("type", "n", (F.col("n") * 100.0 / F.col("total")).alias("share")).orderBy(F.desc("n"), "type")


def confidence_stats(entities: DataFrame, *by: str, high: float = 0.8, medium: float = 0.5) -> DataFrame:
    """Least, greatest and mean confidence, its sample deviation (0 for fewer than two), and the number in each band. An absent one counts as 1."""
    c = F.coalesce(F.col("confidence"), F.lit(1.0))
    return entities.groupBy(*by).agg(
        F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), F.avg(c).alias("avg_confidence"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_confidence"),
        F.count_if(c >= high).alias("high"), F.count_if((c >= medium) & (c < high)).alias("medium"), F.count_if(c < medium).alias("low"),
    )


def most_common_type(entities: DataFrame, *by: str) -> DataFrame:
    """The most frequent type; of equals the one that stands first."""
    counts = entities.groupBy(*by, "type").agg(F.count("*").alias("n"), F.min(F.struct(*[F.col(c) for c in ("doc_id", "start") if c in entities.columns and c not in by])).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first", "type"))
    return counts.withColumn("rank", rank).where("rank = 1").drop("rank", "first")


def histogram(entities: DataFrame, bins: int = 20) -> DataFrame:
    """bin (from 1), n: confidences in equal steps from 0 to 1; 1 belongs to the last."""
    return entities.groupBy(F.least(F.lit(bins), F.floor(F.col("confidence") * bins) + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def coverage(entities: DataFrame, docs: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """by, covered, coverage (per cent): characters in the union of each document's spans, by running ends."""
    before = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    covered = entities.select(by, F.greatest(F.col("end") - F.greatest(F.col("start"), reached), F.lit(0)).alias("new")).groupBy(by).agg(F.sum("new").alias("covered"))
    lengths = docs.select(by, F.length(text_col).alias("length"))
    c = F.coalesce(F.col("covered"), F.lit(0))
    return lengths.join(covered, by, "left").select(by, c.alias("covered"), F.when(F.col("length") > 0, c * 100.0 / F.col("length")).otherwise(F.lit(0.0)).alias("coverage"))


def density(n: Column, length: Column) -> Column:
    """Entities a thousand characters."""
    return F.when(length > 0, n * 1000.0 / length).otherwise(F.lit(0.0))


def document_report(entities: DataFrame, docs: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, confidences, coverage, density, most common type, recommendations."""
    figures = entities.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("type").alias("types"), F.bool_or(F.col("method").isin("spacy", "transformers")).alias("ai_used"), F.bool_or(F.col("type").isin(*audit.SENSITIVE)).alias("sensitive"))
    out = docs.select(by, F.length(text_col).alias("length")).join(figures, by, "left").join(confidence_stats(entities, by), by, "left").join(coverage(entities, docs, by, text_col), by, "left").join(most_common_type(entities, by).select(by, F.col("type").alias("most_common_type")), by, "left")
    n, low = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("low"), F.lit(0))
    return out.withColumn("density", density(n, F.col("length"))).withColumn("recommendations", audit.recommendations(low, F.col("coverage"), F.coalesce(F.col("sensitive"), F.lit(False)))).withColumn("n", n)


def page_ranges(positions: DataFrame, page_col: str = "page", step: int = 5) -> DataFrame:
    """first_page, label, n: occurrences in runs of pages; the last run ends at the last page."""
    last = positions.agg(F.max(page_col).alias("last"))
    first = (F.floor((F.col(page_col) - 1) / step) * step + 1).cast("int")
    counts = positions.where(F.col(page_col).isNotNull()).groupBy(first.alias("first_page")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(last)).select("first_page", F.concat(F.lit("Pages "), F.col("first_page"), F.lit("-"), F.least(F.col("first_page") + step - 1, F.col("last"))).alias("label"), "n")


def running_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("documents"), F.sum("n").alias("entities"))


def rollup(entities: DataFrame) -> DataFrame:
    """Counts by type and method, by type, and in all."""
    return entities.rollup("type", "method").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
