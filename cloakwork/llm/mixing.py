"""Mixing sources to target weights (operator 2) by Sainte-Lague apportionment.

The words of all documents are shared among the sources by weight; a source's target stops at CAP times its size, and the
excess is shared again by weight among the others until none is above. Each source's documents are dealt to shards by a
seeded hash, and a shard's words, in seeded order, are cut into blocks of BLOCK words. Seats, each worth one block, go to
the sources by highest quotients of target / (2 seats + 1), targets counted in the source's blocks, then a source's seats
to its shards likewise, by size. A shard with as many seats as blocks takes each block once, with twice as many twice, and
so on; the seats left over take the blocks that a seeded permutation puts first. So reruns agree, and no block is taken more
than CAP times.

The plan shuffles (doc_id, source, size) alone; `apply` shuffles each row once. A hot source has many shards, so no task
gets all of it. The driver gets one row a shard: at most SHARDS and one more for each source, of which at most SOURCES are
mixed (more is an error), so what is broadcast has a bound of some 20 MB. A shard's rows are streamed in order, not held.

Null texts have size 0 and nothing is taken of them. The null source is a source of its own, the last. Rows that share id
and text are dealt alike but taken each by itself. Extra columns stay as they are, whatever their names. An empty table
gives no rows. The same rows, seed and block give the same mix on every run.
"""

from __future__ import annotations

import heapq
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop, texts

WEIGHTS, CAP, BLOCK = (5, 2, 1), 3, 64
#: Documents a shard, at least about; shards in all, beyond one for each source; most sources.
SHARD, SHARDS, SOURCES = 4096, 1 << 16, 100_000


def shares(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets: the sum of sizes shared by weight, each at most cap times its own size."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in above:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def seats(votes: list[float], total: int, most: list[int]) -> list[int]:
    """Sainte-Lague: total seats, one after the other to the highest votes / (2 seats + 1), the first of equals, none beyond its most.

    Seats that surely fall are given at once by rounding; the last few go by quotient.
    """
    n, all_votes = len(votes), sum(votes)
    total = min(total, sum(most))
    out = [0] * n
    if all_votes:
        sure = max(0, total - n)  # rounding down never gives more than the quotients do
        out = [min(m, max(0, math.floor(v / all_votes * sure - 0.5))) for v, m in zip(votes, most)]
    queue = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, out, most)) if s < m]
    heapq.heapify(queue)
    for _ in range(total - sum(out)):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def plan(found: list, block: int, weights: tuple, cap: int, seed: int) -> list[tuple]:
    """(source, shard, source_size, target, times that each block is taken, blocks taken once more, blocks, step, shift) of each (source, shard, size).

    k * step + shift modulo the number of blocks is the shard's seeded permutation of its blocks.
    """
    by: dict = {}
    for source, shard, size in found:
        by.setdefault(source, []).append((shard, size))
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    sizes = [sum(n for _, n in by[s]) for s in names]
    targets = shares(sizes, [weights[k % len(weights)] for k in range(len(names))], cap)
    blocks = [[-(-n // block) for _, n in by[s]] for s in names]
    votes = [t * sum(b) / n if n else 0.0 for t, b, n in zip(targets, blocks, sizes)]  # a shard's last block is short: targets in blocks as they are
    quotas = seats(votes, round(sum(votes)), [cap * sum(b) for b in blocks])
    out = []
    for s, size, target, quota, b in zip(names, sizes, targets, quotas, blocks):
        for (shard, _), q, n in zip(by[s], seats([x for _, x in by[s]], quota, [cap * x for x in b]), b):
            rng = random.Random(f"{seed} {s!r} {shard}")
            step = next(x for x in (rng.randrange(1, n + 1) for _ in range(10**6)) if math.gcd(x, n) == 1) if n else 1
            out.append((s, shard, size, target, q // n if n else 0, q % n if n else 0, max(n, 1), step, rng.randrange(n) if n else 0))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """doc_id, source, size, text_hash and more columns of each row."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), *more)


def _dealt(rows: DataFrame, parts: DataFrame, seed: int) -> DataFrame:
    """rows with `place` (their seeded hash) and `shard`."""
    place = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    return rows.join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("of")), "left").select(*rows.columns, place.alias("place"), F.pmod(place, F.col("shards")).alias("shard"))


def _planned(sized: DataFrame, seed: int, block: int, weights: tuple, cap: int) -> tuple[DataFrame, DataFrame]:
    """The sources' numbers of shards, and the plan of the shards."""
    spark = sized.sparkSession
    counts = sized.groupBy("source").agg(F.count("*").alias("rows")).limit(SOURCES + 1).collect()
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources can't be mixed")
    each = max(SHARD, -(-sum(r["rows"] for r in counts) // SHARDS))
    parts = spark.createDataFrame([(r["source"], -(-r["rows"] // each)) for r in counts], "of string, shards long")
    found = _dealt(sized, parts, seed).groupBy("source", "shard").agg(F.sum("size").alias("size")).orderBy("source", "shard").collect()
    planned = plan([(r["source"], r["shard"], r["size"]) for r in found], block, weights, cap, seed)
    return parts, spark.createDataFrame(planned, "of string, part long, source_size long, target double, whole long, more long, blocks long, step long, shift long")


def _placed(rows: DataFrame, parts: DataFrame, planned: DataFrame, seed: int, block: int, *ties: str) -> DataFrame:
    """rows with source_size, target, whole (times that all words are taken) and spans (start and words of what is taken once more)."""
    # Within a shard: where the document's words start, and which of the blocks that they meet are taken.
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("place"), "place", "doc_id", "size", "text_hash", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = _dealt(rows, parts, seed).withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")), "left")
    end = F.col("start") + F.col("size")
    met = F.when((F.col("size") > 0) & (F.col("more") > 0), F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.filter(met, lambda k: F.pmod(k * F.col("step") + F.col("shift"), F.col("blocks")) < F.col("more"))
    spans = F.transform(chosen, lambda k: F.struct(F.greatest(k * block - F.col("start"), F.lit(0)).alias("start"), (F.least((k + 1) * block, end) - F.greatest(k * block, F.col("start"))).alias("words")))
    return placed.withColumn("spans", spans).select(*rows.columns, "source_size", "target", "whole", "spans")


def mix(docs: DataFrame, seed: int = 2, block: int = BLOCK, weights: tuple = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole (times that all of the text is taken), spans (start and words of the parts that are taken once more), text_hash."""
    sized = cut(_rows(docs, id_col, text_col, source_col), "sizes")
    placed = _placed(sized, *_planned(sized, seed, block, weights, cap), seed, block)
    taken = F.col("whole") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "whole", "spans", "text_hash")


def apply(docs: DataFrame, seed: int = 2, block: int = BLOCK, weights: tuple = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: each row's text as often as all of it is taken, and once its words in the
    spans taken once more, joined by one space. Rows of which nothing is taken go. It is what `mix` plans with the same
    arguments; rows travel whole, under one name, so they need not be found again by their values."""
    sized = cut(_rows(docs, id_col, text_col, source_col), "sizes")
    made = _planned(sized, seed, block, weights, cap)
    drop(sized)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _rows(docs, id_col, text_col, source_col, whole_row.alias("row"), F.xxhash64(whole_row).alias("row_hash"))
    taken = _placed(rows, *made, seed, block, "row_hash").where("size > 0 and (whole > 0 or size(spans) > 0)").select("row", "whole", "spans", F.col("row").getField(text_col).cast("string").alias("text"))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("words"), s["start"].cast("int") + 1, s["words"].cast("int")))), " ")
    copies = F.concat(F.array_repeat("text", F.col("whole").cast("int")), F.when(F.size("spans") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    found = taken.withColumn("words", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).select("row", F.explode(copies).alias("new"))
    new = {text_col: F.col("new"), "n_chars": F.length("new").cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
