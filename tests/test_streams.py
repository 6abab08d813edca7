"""Windows over late events, and the preview of a rewrite."""

from pyspark.sql import functions as F

from cloakwork.operators import anonymize
from cloakwork.streaming import detect


def test_windowed_counts(spark):
    """Over a table the windows are the same, and nothing is late."""
    rows = [("EMAIL", "2024-01-01 10:05:00"), ("EMAIL", "2024-01-01 10:55:00"), ("PHONE", "2024-01-01 10:10:00"), ("EMAIL", "2024-01-01 11:00:00")]
    found = spark.createDataFrame(rows, "type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {(str(r["window"]["start"])[11:16], r["type"], r["n"]) for r in detect.windowed_counts(found, "ts").collect()}
    assert len({g[0] for g in got}) == 2 and {g[1:] for g in got} == {("EMAIL", 2), ("PHONE", 1), ("EMAIL", 1)}


def test_preview(spark):
    body = "ab jean@ex.fr " + "x" * 490 + " jean@ex.fr"
    span = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(s + 10).alias("end"), F.lit("[EMAIL_1]").alias("replacement")) for s in (3, 505)])
    row = anonymize.preview(spark.createDataFrame([(1, body)], "doc_id long, text string").withColumn("entities", span)).first()
    assert row["preview"] == ("ab [EMAIL_1] " + "x" * 490)[: 500 - 10 + 9]
