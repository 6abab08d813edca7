"""SimHash near-dedup (operator 3): fingerprints, pigeonhole blocks, verified links, components.

A fingerprint's 64 bits are split into BLOCKS blocks; fingerprints that differ in at most two bits agree in all but two of
them at least. Each different fingerprint is keyed by every BLOCKS - 2 of its blocks (with five, ten keys of 38 or 39 bits,
so that at 10^10 different fingerprints a key is shared by chance by one in some 30), fingerprints that share a key are
joined, and the number of their differing bits is verified. A key with more than CROWD fingerprints isn't joined, as its
pairs would grow with its square. Its fingerprints are linked exactly by another way: each is keyed by itself and by its 64
neighbours at one bit. Two fingerprints differ in at most two bits just if they share such a key, and those of a key are
all linked to the smallest one, which keeps the components whole with one link a key. The distance of two bits is part of
that, and so no parameter.

Equal fingerprints are linked from the start, so only different ones are keyed, and a group of copies is one of them.
Components spread the smallest fingerprint along the links, with jumps to the label's own label, until nothing changes.
Every round is written to the shared folder; nothing is collected.

Null and empty texts, and texts of spaces alone, have fingerprint 0 and are linked to each other like any. A component's id
is its smallest doc_id that is not null; rows with a null doc_id get it too. Repeated rows give repeated rows. Other columns
are left out, but kept by `representatives`, which gives one row of those that are equal in all columns. An empty table
gives no rows. The last join is on the fingerprint, where a third of all rows may be alike: its rows are of 40 bytes, and
adaptive execution splits such a partition.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, first_of, map_arrow, picked, raw, row_hashes

SHINGLE, SEED, BLOCKS, CROWD = 3, 42, 5, 64


def hashes(text: bytes, words: int = SHINGLE, at_once: int = 1 << 16):
    """XXH64 of each shingle, in arrays of at most at_once."""
    parts = text.lower().split()  # bytes: A-Z alone are lowered, and words end at ASCII white space
    if not parts:
        return
    n, h = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    for k in range(0, n, at_once):
        yield np.array([h(b" ".join(parts[i : i + words]), SEED) for i in range(k, min(n, k + at_once))], np.uint64)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    total, ones = 0, np.zeros(64, np.int64)
    for h in hashes(text, words):
        total += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer), h1, h2 (hashes of the row)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in raw(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2), b.column(3)], names=["doc_id", "fp", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_hashes(docs, id_col, text_col))
    return map_arrow(rows, run, "doc_id long, fp long, h1 long, h2 long")


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """The bits of every choice of all blocks but two, as signed 64-bit integers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(each, blocks - 2))]


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links between different fingerprints (the column fp of fps, each once) that keep all components; each verified."""
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(block_masks())])
    keyed = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.choice", "key.bits")
    crowded = cut(keyed.groupBy("choice", "bits").count().where(F.col("count") > crowd).select("choice", "bits"), "crowded-blocks")
    few = keyed.join(crowded, ["choice", "bits"], "left_anti")
    near = few.select("choice", "bits", F.col("fp").alias("a")).join(few.select("choice", "bits", F.col("fp").alias("b")), ["choice", "bits"]).where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    many = cut(keyed.join(crowded, ["choice", "bits"], "left_semi").select("fp").distinct(), "crowd")
    around = many.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))).alias("key"))
    least = around.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("key", "a")
    starred = around.join(least, "key").where("a < fp and bit_count(a ^ fp) <= 2").select("a", F.col("fp").alias("b"))
    found = cut(near.unionByName(starred).distinct(), "links")
    drop(crowded, many)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, label: each node of the edges (a, b), and the smallest node that it is connected to."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        told = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("heard")), "v").groupBy("u").agg(F.min("heard").alias("heard"))
        further = labels.select(F.col("node").alias("mid"), F.col("label").alias("jump"))
        now = labels.select("node", "label").join(told, F.col("node") == F.col("u"), "left").join(further, F.col("label") == F.col("mid"), "left")
        least = F.least("label", "heard", "jump")
        before, labels = labels, cut(now.select("node", least.alias("label"), (least < F.col("label")).alias("changed")), "labels")
        drop(before)
    drop(both)
    return labels.select("node", "label")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, root (the component's smallest fingerprint, signed), h1, h2 (hashes of the row)."""
    rows = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "different-fingerprints")
    edges = links(fps, crowd)
    labelled = components(edges)
    rooted = fps.join(labelled, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    firsts = rooted.groupBy(F.col("root").alias("top")).agg(F.min("first").alias("component_id"))
    ids = cut(rooted.join(firsts, F.col("root") == F.col("top")).select(F.col("fp").alias("of"), "component_id", "root"), "components")
    drop(fps, edges)
    return rows.join(ids, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "h1", "h2")


def representatives(docs: DataFrame, words: int = SHINGLE, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each component: that with the smallest doc_id (nulls last), then the smallest hashes."""
    return picked(docs, first_of(near_duplicates(docs, words, crowd, id_col, text_col)), id_col, text_col)
