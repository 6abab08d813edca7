"""Token ids in files of fixed-width bit packing (operator 6).

A file holds documents in ascending doc_id order, cut into blocks of BLOCK ids (the last one of a file is shorter):

    magic (8 bytes) | per block: ids of `bits` bits each, least significant bit first, padded to whole bytes
    | uint64 byte offset of each block, and of the end | int64 doc_id of each document | uint64 first id of each document, and their number
    | footer: uint64 blocks, documents, ids; uint32 bits, uint32 BLOCK; magic

All numbers are little-endian. `bits` is the least that the vocabulary needs. A block's offset gives random access to any
id; numpy unpacks whole blocks at once. Documents are dealt by ranges of doc_id and a hash of the text (so that one id, or
null, may hold many rows), sorted, encoded and written by one task a range. A file gets its own name first and its lasting one when it is whole, so that a task may be run again or twice.

Null texts count as empty, and have the end id alone. A null doc_id comes first and is stored as the least number of 64
bits. Rows of one doc_id follow each other by that hash. An empty table gives no file with
documents and no rows. Other columns are left out.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, raw, scan_partitions, shared_dir, texts

BLOCK, MAGIC, FOOTER, NO_ID = 4096, b"CWTOKID1", "<QQQII8s", -(1 << 63)
_loaded: dict[str, "Words"] = {}


class Words:
    """Ids of a text by the tokenizers library, remembered by word: for vocabularies whose pieces never hold white space.

    remember: most words whose ids a worker keeps; older ones are encoded again.
    """

    def __init__(self, path: str, remember: int = 700_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.library.to_str())
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = [t.encode() for t in added]
        self.parting = next(iter(added.items()), None)
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.remember, self.new, self.old = remember, {}, {}

    def _encode(self, unknown: list[bytes]) -> dict[bytes, bytes]:
        """The library's ids of each word; many words are one text, with a special token, which parts a text, between them."""
        out = {}
        for at in range(0, len(unknown), 2048):
            some = unknown[at : at + 2048]
            if self.parting is None:
                got = [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            else:
                text = self.parting[0].join(w.decode() for w in some)
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without offsets
                data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.parting[1])).tolist()
                got = [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)])]
            if len(got) != len(some):
                raise ValueError(f"{len(some)} words were encoded as {len(got)}")
            out.update(zip(some, got))
        return out

    def encode_all(self, documents: list[bytes]) -> list[bytes]:
        """Ids of each document as little-endian unsigned 32-bit integers."""
        if len(self.new) >= self.remember:
            self.new, self.old = {}, self.new
        lowered = [x.lower() for x in documents] if self.lowers else documents
        # The library finds special tokens before it lowers a text; a word that becomes one by lowering is not one.
        odd = [k for k, (x, y) in enumerate(zip(documents, lowered)) if any(t in x or t in y for t in self.special)]
        words = [x.split() for x in lowered]
        for k in odd:
            words[k] = []
        found = [list(map(self.new.get, x)) for x in words]
        missing = {w for x, ids in zip(words, found) if None in ids for w, i in zip(x, ids) if i is None}
        fresh = {w: ids for w in missing if (ids := self.old.get(w)) is not None}
        # A stop or comma after an ASCII letter is a piece of its own.
        stems = {w: w[:-1] for w in missing if w not in fresh and w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
        wanted = {stems.get(w, w) for w in missing if w not in fresh} | {w[-1:] for w in stems}
        known = {w: ids for w in wanted if (ids := self.new.get(w) or self.old.get(w)) is not None}
        known |= self._encode([w for w in wanted if w not in known])
        fresh |= known
        fresh.update((w, known[stem] + known[w[-1:]]) for w, stem in stems.items())
        self.new.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
        out = [b"".join([fresh[w] if i is None else i for w, i in zip(x, ids)] if None in ids else ids) for x, ids in zip(words, found)]
        for k in odd:
            out[k] = np.array(self.library.encode(documents[k].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def words(path: str) -> Words:
    """Each worker loads a vocabulary once."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1, axis=None, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.rest = out, bits, np.zeros(0, np.uint32)
        self.docs, self.firsts, self.offsets, self.ids, self.at = [], [], [], 0, len(MAGIC)
        out.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), BLOCK):
            data = pack(ids[k : k + BLOCK], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)

    def add(self, doc_ids: list[int], ids: list[np.ndarray]) -> None:
        for d, x in zip(doc_ids, ids):
            self.docs.append(d)
            self.firsts.append(self.ids)
            self.ids += len(x)
        joined = np.concatenate([self.rest, *ids])
        whole = len(joined) // BLOCK * BLOCK
        self._blocks(joined[:whole])
        self.rest = joined[whole:]

    def close(self) -> None:
        self._blocks(self.rest)
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array([*self.firsts, self.ids], "<u8").tobytes())
        self.out.write(struct.pack(FOOTER, len(self.offsets), len(self.docs), self.ids, self.bits, BLOCK, MAGIC))


class Reader:
    """Random access to the ids of a file; only the blocks asked for are read."""

    def __init__(self, source):
        self.source, n = source, source.size()
        tail = struct.calcsize(FOOTER)
        blocks, docs, self.ids, self.bits, self.block, magic = struct.unpack(FOOTER, self._read(n - tail, tail))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = n - tail - 8 * (blocks + 1 + docs + docs + 1)
        index = self._read(at, n - tail - at)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        self.firsts = np.frombuffer(index, "<u8", docs + 1, 8 * (blocks + 1 + docs))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block + 1
        data = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        if self.bits in (8, 16, 32) or self.block * self.bits % 8 == 0:  # then blocks join without gaps
            ids = unpack(data, self.bits, min(self.ids, b * self.block) - a * self.block)
        else:
            cuts = self.offsets[a : b + 1] - self.offsets[a]
            ids = np.concatenate([unpack(data[int(x) : int(y)], self.bits, min(self.ids - (a + k) * self.block, self.block)) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))])
        return ids[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.firsts[k]), int(self.firsts[k + 1]))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path, or a URI of any store that pyarrow reaches."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns one row a file, in ascending doc_id order by part: part, path, n_docs, n_ids.

    folder: a path or URI that all machines share. end_id: appended to each document.
    """

    def run(batches):
        encoder, out, writer, name = words(tokenizer), None, None, uuid.uuid4().hex
        part = None
        end = np.array([] if end_id is None else [end_id], np.uint32)
        store, where = opened(folder)
        bits = max(1, int(max(encoder.size - 1, end_id or 0)).bit_length())
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                part = b.column(2)[0].as_py()
                store.create_dir(where, recursive=True)
                out = store.open_output_stream(f"{where}/.{name}")
                writer = Writer(out, bits)
            ids = [np.concatenate((np.frombuffer(x, "<u4"), end)) for x in encoder.encode_all(raw(b.column(1)))]
            writer.add([NO_ID if d is None else d for d in b.column(0).to_pylist()], ids)
        if writer:
            writer.close()
            out.close()
            store.move(f"{where}/.{name}", f"{where}/{part:06d}-{name}.tok")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{part:06d}-{name}.tok"], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = texts(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(2 * scan_partitions(rows), *order).sortWithinPartitions(*order)
    return cut(map_arrow(ranged.withColumn("part", F.spark_partition_id()), run, "part int, path string, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), ids (binary: little-endian unsigned 32-bit integers).

    The files' ids are summed in order on the driver: one small row a file, no more of them than tasks that wrote. at_once:
    ids unpacked together, or those of one document if it has more.
    """
    spark = files.sparkSession
    at, firsts = 0, []
    for f in sorted(files.collect(), key=lambda f: f["part"]):
        firsts.append((f["path"], at))
        at += f["n_ids"]

    def run(batches):
        for b in batches:
            for path, before in zip(*(c.to_pylist() for c in b.columns)):
                store, where = opened(path)
                with store.open_input_file(where) as f:
                    r = Reader(f)
                    last = 0
                    while last < len(r.docs):
                        k = last
                        last = min(k + 1024, max(k + 1, int(np.searchsorted(r.firsts, r.firsts[k] + np.uint64(at_once), "right")) - 1))
                        first = int(r.firsts[k])
                        ids = r.span(first, int(r.firsts[last])).astype("<u4")
                        cuts = (r.firsts[k : last + 1] - r.firsts[k]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([None if d == NO_ID else d for d in r.docs[k:last].tolist()], pa.int64()), pa.array(r.firsts[k:last].astype(np.int64) + before), pa.array([ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], names=["doc_id", "start", "ids"])

    todo = spark.createDataFrame(firsts, "path string, before long").repartition(max(1, len(firsts)))
    return map_arrow(todo, run, "doc_id long, start long, ids binary")


def token_folder(spark) -> str:
    return f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"


def from_bytes(data: bytes) -> Reader:
    return Reader(pa.BufferReader(data))


def to_bytes(doc_ids: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    w = Writer(out := io.BytesIO(), bits)
    w.add(doc_ids, ids)
    w.close()
    return out.getvalue()


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
