"""Substring dedup (operator 8): words in windows that a document with a smaller id has too are removed.

Each window of WIDTH consecutive words gets a Rabin-Karp hash of 64 bits and 32 bits of another one; both together tell
windows apart (at the 10^13 windows of 100 TB about one chance in a thousand that any two collide). A task sorts the
windows of a chunk of documents and settles what it can: of a window's documents in the chunk, all but the one with the
smallest id lose it, and only that one is dealt on, so a passage that a third of all documents share makes one entry a
chunk. Entries go to buckets by the hash's top bits, packed as one row a chunk and bucket; a bucket's entries are sorted
again, and those with a document that has a smaller id elsewhere are hits. The number of buckets follows the bytes read, so
a bucket's size does not grow; where there are more than 2^STEP of them, entries are dealt in passes of STEP bits each, so
that rows stay packed. Hits are packed and dealt once more, by groups of documents, and each document gets its own as one
row. There the hit windows merge into maximal intervals of words, which are removed.

Null and empty texts have no words and lose none. A null doc_id is smaller than none and greater than none: such rows stay
whole, take nothing from others, and are not joined. Rows that share a doc_id never take from each other; repeated rows
give repeated rows. Very long texts are windows like any. An empty table gives no rows. Windows are judged on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship
from .common import buffers, covered, cut, map_arrow, mix, scan_partitions, texts, window_checks, window_hashes, word_hashes, word_spans

WIDTH = 13
#: Words whose windows a task sorts together.
CHUNK = 1 << 20
#: Bits of the hash by which entries are dealt in one pass.
STEP = 12
PACKED = "hashes binary, checks binary, ids binary, counts binary"

#: Windows: hashes, checks, documents.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def planes(h: np.ndarray) -> bytes:
    """The numbers byte by byte, the first bytes first: those are alike in a bucket, and so compress."""
    return h.astype(h.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, h.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).newbyteorder(">")
    return np.frombuffer(data, np.uint8).reshape(wide.itemsize, -1).T.copy().view(wide).astype(kind).ravel()


def by_document(e: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and checks ordered by document, each document once, and its number of them."""
    h, x, d = e
    order = np.argsort(d, kind="stable")
    ids, counts = np.unique(d, return_counts=True)
    return h[order], x[order], ids, counts


def pack(e: Entries) -> tuple[bytes, bytes, bytes, bytes]:
    h, x, ids, counts = by_document(e)
    return planes(h), planes(x), planes(np.diff(ids, prepend=np.int64(0))), planes(counts.astype(np.uint32))


def unpack(rows: pa.Table | pa.RecordBatch) -> Entries:
    """The entries of all rows."""
    found = [
        (unplanes(h, np.uint64), unplanes(x, np.uint32), np.repeat(np.cumsum(unplanes(i, np.int64)), unplanes(n, np.uint32)))
        for h, x, i, n in zip(*(rows.column(c).to_pylist() for c in ("hashes", "checks", "ids", "counts")))
    ]
    return joined(found)


def joined(parts: list[Entries]) -> Entries:
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def settle(e: Entries) -> tuple[Entries, Entries]:
    """Each window once, in order, with its smallest document; and the windows that other documents lose."""
    h, x, d = e
    if not len(h):
        return e, e
    order = np.argsort(h)
    h, x, d = h[order], x[order], d[order]
    same = h[1:] == h[:-1]
    if (same & (x[1:] != x[:-1])).any():  # windows that agree in the hash alone
        order = np.lexsort((x, h))
        h, x, d = h[order], x[order], d[order]
        same = h[1:] == h[:-1]
    new = np.concatenate(([True], ~same | (x[1:] != x[:-1])))
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(d, first)
    later = d > np.repeat(least, np.diff(np.append(first, len(h))))
    return (h[new], x[new], least), (h[later], x[later], d[later])


def dealt(parts: list[Entries], bits: int) -> list[tuple]:
    """A chunk's rows: its windows by bucket, and those that documents lose within it as one row more."""
    whole = joined(parts)
    parts.clear()  # they are the most that a worker holds
    (h, x, d), lost = settle(whole)
    del whole
    cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits <= STEP else None
    if cuts is None:  # most buckets of so many have none of the chunk
        top = (h >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(top) else np.zeros(0, np.int64)
        found = zip(top[at].tolist(), at, np.append(at[1:], len(top)))
    else:
        found = ((k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a)
    out = [(k, True, *pack((h[a:b], x[a:b], d[a:b]))) for k, a, b in found]
    if len(lost[0]):
        out.append((int(lost[2][0]) % (1 << bits), False, *pack(lost)))
    return out


def hits(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, bits: int | None = None, step: int = STEP) -> DataFrame:
    """doc_id, hashes, checks (binary: of the windows that the document loses): one row a document that loses any.

    chunk: words whose windows a task holds at once. bits: by default four buckets or more for each partition read. step:
    bits dealt in a pass. None of them changes what is lost.
    """
    rows = texts(docs, id_col, text_col)
    bits = bits or max(4, (4 * scan_partitions(rows)).bit_length())
    names = ["bucket", "open", "hashes", "checks", "ids", "counts"]
    kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 4]

    def as_batch(out: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def windows(batches):
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            flat, limits = buffers(b.column(1))
            starts, ends, first = word_spans(flat, limits)
            words = word_hashes(flat, starts, ends)
            h, at, row = window_hashes(words, first, width)
            if len(h):
                yield h, window_checks(words, at, width), b.column(0).to_numpy()[row]

    def in_chunks(found, to: int):
        parts, n = [], 0
        for e in found:
            parts.append(e)
            n += len(e[0])
            if n >= chunk:
                yield as_batch(dealt(parts, to))
                parts, n = [], 0
        if parts:
            yield as_batch(dealt(parts, to))

    def deal(to: int):
        return lambda batches: in_chunks(windows(batches), to)

    def deal_again(to: int):
        def run(batches):
            def open_entries():
                for b in batches:
                    for k in range(len(b)):
                        if b.column(1)[k].as_py():
                            yield unpack(b.slice(k, 1))
                        else:
                            sure.append(as_batch([tuple(c[0].as_py() for c in b.slice(k, 1).columns)]))

            sure: list = []
            for out in in_chunks(open_entries(), to):
                yield out
                while sure:
                    yield sure.pop()
            yield from sure

        return run

    def judge(table):
        sure = table.filter(pc.invert(table.column("open")))
        h, x, d = joined([unpack(sure), settle(unpack(table.filter(table.column("open"))))[1]])
        group = (mix(d.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        h, x, d, group = h[order], x[order], d[order], group[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
        out = [(int(group[a]), *pack((h[a:b], x[a:b], d[a:b]))) for a, b in zip(first, [*first[1:], len(h)])]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, [pa.int64(), *kinds[2:]])], names=["docs", *names[2:]])

    def regroup(table):
        h, x, ids, counts = by_document(unpack(table))
        ends = np.cumsum(counts)
        of = lambda a: pa.array([a[e - n : e].tobytes() for e, n in zip(ends, counts)], pa.binary())
        return pa.table({"doc_id": pa.array(ids), "hashes": of(h), "checks": of(x)})

    ship(docs.sparkSession)
    entries = map_arrow(rows, deal(min(step, bits)), f"bucket long, open boolean, {PACKED}")
    for to in range(2 * step, bits + step, step):
        entries = entries.repartition(1 << step, F.col("bucket")).mapInArrow(deal_again(min(to, bits)), f"bucket long, open boolean, {PACKED}")
    lost = entries.groupBy("bucket").applyInArrow(judge, f"docs long, {PACKED}")
    return cut(lost.groupBy("docs").applyInArrow(regroup, "doc_id long, hashes binary, checks binary"), "window-hits")


def intervals(mask: np.ndarray) -> list[dict]:
    """Maximal runs of true words, as start and end (exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def pair(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number for hash and check together."""
    return mix(h) + x


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **how) -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of words), kept (the words left, joined by one space); carry: further columns, as carry_<name>; how: as of hits."""
    found = hits(docs, width, id_col, text_col, **how).select(F.col("doc_id").alias("hit_id"), "hashes", "checks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    fields = ["doc_id", "text", "hashes", "checks", *[f"carry_{c}" for c in carry]]
    known = rows.where("doc_id is not null").join(found, F.col("doc_id") == F.col("hit_id"), "left").select(*fields)
    nameless = rows.where("doc_id is null").withColumns({c: F.lit(None).cast("binary") for c in ("hashes", "checks")})
    both = known.unionByName(nameless.select(*fields))
    names = ["doc_id", "n_words", "n_removed", "removed", "kept", *[f"carry_{c}" for c in carry]]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            flat, limits = buffers(b.column(1))
            data = flat.tobytes()
            n, removed, spans, kept = [], [], [], []
            for x, y, lost, checks in zip(limits, limits[1:], b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = data[x:y].split()
                n.append(len(words))
                mask = np.zeros(0, bool)
                if lost:
                    starts, ends, one = word_spans(flat[x:y], np.array([0, y - x]))
                    each, lost_h = word_hashes(flat[x:y], starts, ends), np.frombuffer(lost, np.uint64)
                    h, first, _ = window_hashes(each, one, width)
                    at = np.flatnonzero(np.isin(h, lost_h))
                    both_ = pair(h[at], window_checks(each, first[at], width))
                    mask = covered(first[at[np.isin(both_, pair(lost_h, np.frombuffer(checks, np.uint32)))]], width, len(words))
                    words = [w for w, gone in zip(words, mask.tolist()) if not gone]
                removed.append(n[-1] - len(words))
                spans.append(intervals(mask))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string()), *b.columns[4:]], names=names)

    more = "".join(f", `carry_{c}` {both.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)
    return map_arrow(both, run, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string" + more)
