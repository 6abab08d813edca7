"""Near duplicates by SimHash, verified by exact similarity; and an exact way for the links that SimHash does not see.

A text's set is the 64-bit hashes of its WORDS-word shingles, in lower case (A-Z); a shorter text has one shingle of all its
words. Texts are linked if the Jaccard similarity of their sets is LEAST or more, and every such pair is connected. Equal
sets are one node.

First come SimHash's links: a set's fingerprint has a bit where over half of its hashes have it, `simhash.links` finds all
fingerprints within two bits by their blocks, and each such pair is verified on its texts. Nodes of one fingerprint are held
against its smallest node. At a similarity of 0.8 some 15 % of the bits differ, and blocks for that would have a few bits
each; so what these links leave in different components is compared by keys, as follows, which loses no pair.

With all shingles in one order, two sets of that similarity share one of the first n - ceil(LEAST * n) + 1 shingles of each,
so those are the keys. The order is by the number of nodes that have a shingle:

1. Shingles that no other node has come first; they are keys without partners. Each node's shingles are dealt by their
   hashes once, and those that are shared come back; a node with too few of them has no partner and goes. The rest is
   counted once more among the nodes left.
2. Shared ones follow by their number of nodes.
3. Those that are common in a sample come last, by their number there. They are not dealt, so no task gets the rows of a
   line that a third of all documents have.

The nodes of a key are compared with the one before them by size and with the key's HUBS first nodes by hash, if those are
in other components, so a large group of near copies gives pairs in proportion to its nodes and keys, and not to their
square. Only nodes of a key that are in different components after that are compared in all pairs, within the join on the
key. Links become a star for each group of a batch before components are found, and further links join whole components, so
the rows of a round follow the nodes and not the links. A pair is no row if sizes, places of
the key or sketches rule it out: a sketch holds BITS bits, each telling whether an odd number of the set's shingles fall on
it, and two sets differ in at least as many shingles as their sketches in bits. All others are verified on their texts. The
comparisons (not the rows) of a key still grow with the square of its components that are no near duplicates.

Null and empty texts, and texts of spaces alone, have the empty set and are linked to each other. A node is 64 bits of its
set: of 10^10 different sets about three pairs would be taken for equal. Rows equal in all columns give one row. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, cut, drop, first_of, map_arrow, picked, row_hashes, texts, window_hashes, word_hashes, word_spans
from .simhash import components, links

WORDS, LEAST = 5, 0.8
#: About so many documents tell which shingles are common; a shingle is if it is in OFTEN of them, and at most COMMON are told.
SAMPLE, OFTEN, COMMON = 8192, 4, 1 << 17
HUBS, BITS = 8, 512
#: The columns of a sketch.
SKETCH = [f"bits{k}" for k in range(BITS // 64)]


def shingles(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each row's set of shingle hashes, ascending."""
    flat, limits = buffers(column)
    flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    starts, ends, rows = word_spans(flat, limits)
    each = word_hashes(flat, starts, ends)
    h, _, row = window_hashes(each, rows, words)
    cuts = np.searchsorted(row, np.arange(len(rows)))
    out = []
    for k, n in enumerate(np.diff(rows)):
        if 0 < n < words:
            out.append(window_hashes(each[rows[k] : rows[k + 1]], np.array([0, n]), int(n))[0])
        else:
            out.append(np.unique(h[cuts[k] : cuts[k + 1]]))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' Jaccard similarity is at least so many hundredths."""
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of BITS bits whether an odd number of the set's shingles fall on it, as signed 64-bit integers."""
    odd = np.bincount((s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(s: np.ndarray, at_once: int = 1 << 16) -> int:
    """SimHash of a set: the bits that over half of its hashes have, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(s), at_once):
        ones += np.unpackbits(s[k : k + at_once].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<u8")[0])


def common_shingles(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and in how many of its documents each is."""

    def run(batches):
        for b in batches:
            found = shingles(b.column(1), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])

    rows = texts(docs.withColumn("cw_id", F.lit(0)), "cw_id", text_col)
    parts = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).where("text is not null")
    got = map_arrow(some, run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h, n = np.array([r[0] for r in got], np.int64).view(np.uint64), np.array([r[1] for r in got], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def node_of(found: list[np.ndarray]) -> np.ndarray:
    """The hash of each set."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)


def first_places(n, percent: int):
    """How many of a set's n shingles are keys."""
    return n - -(-percent * n // 100) + 1


def parted(s: np.ndarray, known: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles that are not common, and the common ones, the most common last."""
    if not len(known):
        return s, s[:0]
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    seen = np.where(known[at] == s, often[at], 0)
    return s[seen == 0], s[seen > 0][np.argsort(seen[seen > 0], kind="stable")]


def nodes(docs: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2 (hashes of the row), node (hash of the set), fp (its fingerprint, signed), n (its size), rest (its shingles that are not common), last
    (the common ones that are keys, with places from `rest` on), the columns of SKETCH."""

    def run(batches):
        for b in batches:
            found = shingles(b.column(1), words)
            sketches = np.array([sketch(s) for s in found], np.int64).reshape(-1, len(SKETCH))
            halves = [parted(s, *common) for s in found]
            last = [c[: max(0, first_places(len(p) + len(c), percent) - len(p))].view(np.int64) for p, c in halves]
            fps = np.array([fingerprint(s) for s in found], np.uint64).view(np.int64)
            columns = [pa.array(node_of(found)), pa.array(fps), pa.array([len(s) for s in found], pa.int32()), pa.array([len(p) for p, _ in halves], pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, last)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *last])))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *columns, *map(pa.array, sketches.T.copy())], names=["doc_id", "h1", "h2", "node", "fp", "n", "rest", "last", *SKETCH])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_hashes(docs, id_col, text_col))
    return map_arrow(rows, run, "doc_id long, h1 long, h2 long, node long, fp long, n int, rest int, last array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def rows_of_shingles(docs: DataFrame, words: int, common: tuple[np.ndarray, np.ndarray], text_col: str) -> DataFrame:
    """node, key: a row for each shingle of a node that is not common. A task gives a node's rows once."""

    def run(batches):
        done: set[int] = set()
        for b in batches:
            every = shingles(b.column(0), words)
            found = {node: s for node, s in zip(node_of(every).tolist(), every) if node not in done}
            done.update(found)
            plain = [parted(s, *common)[0] for s in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([*found], np.int64), [len(x) for x in plain])), pa.array(np.concatenate([np.zeros(0, np.uint64), *plain]).view(np.int64))], names=["node", "key"])

    return map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "node long, key long")


def keys(docs: DataFrame, sets: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray], text_col: str) -> DataFrame:
    """node, n, key, at: the keys of each node that another one may share, with their places in the order."""
    of_key, of_node = Window.partitionBy("key"), Window.partitionBy("node")
    rows = rows_of_shingles(docs, words, common, text_col)
    met = rows.select("*", F.min("node").over(of_key).alias("low"), F.max("node").over(of_key).alias("high")).where("low < high")
    shared = cut(met.select("node", "key").dropDuplicates(["key", "node"]), "shared-shingles")
    alone = F.col("rest") - F.count("*").over(of_node)
    most = F.col("n") - F.ceil(F.col("n") * percent / 100)  # so many shingles of a set may be its own alone
    left = shared.join(sets.select("node", "n", "rest"), "node").withColumn("alone", alone).where(F.col("alone") <= most)
    counted = left.withColumn("nodes", F.count("*").over(of_key)).where("nodes > 1").withColumn("alone", alone).where(F.col("alone") <= most)
    placed = counted.withColumn("at", F.col("alone") + F.row_number().over(of_node.orderBy("nodes", "key")) - 1).where(F.col("at") <= most)
    common_keys = sets.select("node", "n", "rest", F.posexplode("last").alias("place", "key")).select("node", "n", "key", (F.col("rest") + F.col("place")).alias("at"))
    found = cut(placed.select("node", "n", "key", F.col("at").cast("int").alias("at")).unionByName(common_keys), "keys")
    drop(shared)
    return found


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of nodes, stored; and those of them whose sets are alike."""

    def run(batches):
        for b in batches:
            found = [alike(x, y, percent) for x, y in zip(shingles(b.column(2), words), shingles(b.column(3), words))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    likely = cut(pairs, "likely-pairs")
    asked = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    chosen = sets.join(asked, "node", "left_semi").select("node", "h1", "h2")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *row_hashes(docs, id_col, text_col))
    named = rows.join(chosen, ["h1", "h2"]).dropDuplicates(["node"]).select("node", "text")
    x, y = named.select(F.col("node").alias("a"), F.col("text").alias("x")), named.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return likely, cut(map_arrow(likely.join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a long, b long"), "verified-pairs")


def starred(edges: DataFrame, at_once: int = 1 << 18) -> DataFrame:
    """a, b: edges that connect what the given ones do, at most one a node for each at_once edges of a task, to the smallest node."""

    def star(some: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([np.zeros((0, 2), np.int64), *some])
        names, at = np.unique(ends, return_inverse=True)
        top = list(range(len(names)))

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for x, y in at.reshape(-1, 2).tolist():
            x, y = root(x), root(y)
            top[max(x, y)] = min(x, y)
        tops = np.array([root(k) for k in range(len(names))], np.int64)
        far = np.flatnonzero(tops != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[tops[far]]), pa.array(names[far])], names=["a", "b"])

    def run(batches):
        some, n = [], 0
        for b in batches:
            some.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            n += len(b)
            if n >= at_once:
                yield star(some)
                some, n = [], 0
        if some:
            yield star(some)

    return map_arrow(edges.select("a", "b"), run, "a long, b long")


def simhash_pairs(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: nodes whose fingerprints differ in at most two bits, by pigeonhole blocks, and nodes of one fingerprint, each
    beside the smallest one; and the stored table of fingerprints that these read."""
    fps = cut(sets.groupBy("fp").agg(F.min("node").alias("first")), "shingle-fingerprints")
    x, y = fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), fps.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = links(fps.select("fp")).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = sets.select("node", "fp").join(fps, "fp").where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return near.unionByName(equal), fps


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the components of labels after further edges (a, b), which join whole components."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()
    above = components(starred(between))
    new = above.join(labels.select("node"), "node", "left_anti")
    old = labels.join(above.select(F.col("node").alias("of"), F.col("label").alias("above")), F.col("label") == F.col("of"), "left").select("node", F.coalesce("above", "label").alias("label"))
    return cut(old.unionByName(new), "joined-labels")


def representatives(docs: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each component: that with the smallest doc_id (nulls last), then the smallest hashes."""
    percent = round(100 * least)
    common = common_shingles(docs, words, text_col)
    made = cut(nodes(docs, words, percent, common, id_col, text_col), "shingle-nodes")
    members = made.select("doc_id", "h1", "h2", "node")
    whole = F.struct("h1", "h2", "fp", "n", "rest", "last", *SKETCH)
    sets = cut(made.groupBy("node").agg(F.min_by(whole, F.struct("h1", "h2")).alias("set")).select("node", "set.*"), "shingle-sets")

    # SimHash's links, and the keys of what they may have missed.
    near, fps = simhash_pairs(sets)
    close, edges = verified(near, sets, docs, words, percent, id_col, text_col)
    labels = components(starred(edges))
    keyed = keys(docs, sets, words, percent, common, text_col)
    labelled = lambda rows, labels: rows.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").drop("of").withColumn("label", F.coalesce("label", "node"))
    described = keyed.join(labelled(sets.select("node", F.struct(*SKETCH).alias("sketch")), labels), "node")
    # Sets of one size or another can be alike; enough of both must follow a shared key; and at most n + m - 2 * both may be
    # in one only: 100 * both >= percent * (n + m - both).
    after, apart = "least(n - at, m - be)", " + ".join(f"bit_count(sketch.{c} ^ drawn.{c})" for c in SKETCH)
    fits = f"100 * {after} >= {percent} * (n + m - {after}) and 100 * (n + m - ({apart})) >= {percent} * (n + m + {apart})"
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    as_other = [F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("be"), F.col("sketch").alias("drawn"), F.col("label").alias("with")]

    # Each node beside the one before it by size, and beside each hub of the key, unless they are in one component.
    by_size = Window.partitionBy("key").orderBy("n", "node")
    before = F.lag(F.struct(*as_other)).over(by_size)
    ahead = described.select("key", "node", "n", "at", "sketch", "label", before.alias("before"), F.lead("node").over(by_size).alias("next"))
    met = cut(ahead.where("before is not null or next is not null").drop("next"), "shared-keys")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    hubs = met.select("key", *as_other, rank.alias("rank")).where(F.col("rank") <= HUBS).drop("rank")
    beside = met.where("before is not null").select("node", "n", "at", "sketch", "label", "before.*").where("label <> with").where(fits).select(*pair)
    around = met.drop("before").join(hubs, "key").where("label <> with").where(fits).select(*pair)
    first, further = verified(beside.unionByName(around).distinct(), sets, docs, words, percent, id_col, text_col)
    if further.limit(1).count():
        labels = joined(labels, further)

    # All pairs of what is in different components still.
    parted_keys = labelled(met.drop("before", "label"), labels)
    several = parted_keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    split = cut(parted_keys.join(several, "key"), "split-keys")
    rest = split.join(split.select("key", *as_other), "key").where("node < other and label <> with").where(fits).select(*pair).distinct()
    second, more = verified(rest.join(close.unionByName(first), ["a", "b"], "left_anti"), sets, docs, words, percent, id_col, text_col)
    if more.limit(1).count():
        labels = joined(labels, more)

    found = members.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("doc_id", "h1", "h2", F.coalesce("label", "node").alias("root"))
    chosen = cut(first_of(found), "representatives")
    drop(made, sets, fps, keyed, met, close, edges, first, further, split, second, more)
    return picked(docs, chosen, id_col, text_col)
