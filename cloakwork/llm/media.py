"""Media columns (operator 10): AVI files of motion JPEG.

`store` keeps bytes losslessly as the 8-bit samples of a video: each byte is the grey of one 8 x 8 block of a baseline JPEG
frame. A block has a DC coefficient alone, in steps of 8, so its pixels are exactly that grey, and any JPEG decoder gives
the bytes back. Rows of 64 blocks make a frame, at most ROWS of them; the RIFF index lists the frames, and a chunk of its
own holds the number of payload bytes. The Huffman table gives a DC difference of s bits a code of 9 - s bits, so all
blocks have equally many bits, and numpy codes and decodes a frame at once.

`read` parses the RIFF index of any AVI of grey or YCbCr baseline frames, decodes its intra frames (the luminance, one
sample a block: the mean; `pixels` decodes all), and detects shots: a new clip starts where the histogram differs from the
last frame's by more than the mean and three standard deviations of the differences before it in its clip.

Null texts count as empty. Bytes 0 are appended to a positive multiple of 64. Each row stands for itself; equal texts give
equal files. A null or broken file raises nothing: it gives no frames and an empty payload, feature `broken`.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw, texts

UNIT, ROWS, FPS, BINS = 64, 16, 25, 32
#: A difference of histograms (0 to 2) below this never starts a clip.
FLOOR = 0.25
# The zigzag order of a JPEG block's coefficients, by rule: diagonals, alternately upwards and downwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DIFF = np.arange(-255, 256)
_SIZE = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])
_CODE = (512 - (2 << _SIZE) + np.where(_DIFF > 0, _DIFF, _DIFF + (1 << _SIZE) - 1)) << 1
_DIFF_OF = np.full(1024, 999)
_DIFF_OF[_CODE] = _DIFF


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_TABLES = _marker(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)) + b"\x10" + bytes([1] + [0] * 15) + b"\x00")


def _head(width: int, height: int) -> bytes:
    return b"\xff\xd8" + _marker(0xDB, b"\x00" + bytes([8] * 64)) + _marker(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)) + _TABLES + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def frames_of(samples: np.ndarray) -> list[bytes]:
    """A baseline JPEG for each of samples (frames x rows x columns), a block a sample; columns is a multiple of 4."""
    n, rows, columns = samples.shape
    v = samples.reshape(n, -1).astype(np.int64)
    codes = _CODE[np.diff(v, axis=1, prepend=128) + 255].reshape(n, -1, 4)
    packed = (codes[:, :, 0] << 30) | (codes[:, :, 1] << 20) | (codes[:, :, 2] << 10) | codes[:, :, 3]
    data = packed.astype(">u8").view(np.uint8).reshape(n, -1, 8)[:, :, 3:].reshape(n, -1)
    head = _head(8 * columns, 8 * rows)
    return [head + x.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for x in data]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def avi(frames: list[bytes], width: int, height: int, payload: int, fps: int = FPS) -> bytes:
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 3 * width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    movie, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"plen", struct.pack("<Q", payload)) + _chunk(b"LIST", b"movi" + b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def store_bytes(data: bytes) -> bytes:
    """The AVI that holds data, padded with bytes 0 to a positive multiple of 64."""
    rows = max(1, -(-len(data) // UNIT))
    n = -(-rows // ROWS)
    each = -(-rows // n)
    samples = np.zeros(n * each * UNIT, np.uint8)
    samples[: len(data)] = np.frombuffer(data, np.uint8)
    return avi(frames_of(samples.reshape(n, each, UNIT)), 8 * UNIT, 8 * each, rows * UNIT)


def _chunks(data: bytes, at: int, end: int):
    """(name, start, size) of each chunk; lists are gone into."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name in (b"RIFF", b"LIST"):
            yield data[at + 8 : at + 12], at + 12, size - 4
            if data[at + 8 : at + 12] != b"movi":
                yield from _chunks(data, at + 12, min(end, at + 8 + size))
        else:
            yield name, at + 8, size
        at += 8 + size + size % 2


def parse(data: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames by the RIFF index, seconds a frame, and the payload's bytes if the file says them."""
    found = {}
    for name, at, size in _chunks(data, 0, len(data)):
        found.setdefault(name, (at, size))
    if not {b"movi", b"idx1", b"avih"} <= found.keys():
        raise ValueError("no AVI with an index")
    movie, (at, size) = found[b"movi"][0] - 4, found[b"idx1"]
    entries = list(struct.iter_unpack("<4sIII", data[at : at + size // 16 * 16]))
    video = [(x, n) for name, _, x, n in entries if name[2:] in (b"dc", b"db")]
    base = movie if not video or data[movie + video[0][0] : movie + video[0][0] + 4] == entries[0][0] else 0  # some writers count from the file's start
    step = int.from_bytes(data[found[b"avih"][0] : found[b"avih"][0] + 4], "little") / 1e6
    length = struct.unpack_from("<Q", data, found[b"plen"][0])[0] if b"plen" in found else None
    return [data[base + x + 8 : base + x + 8 + n] for x, n in video], step, length


def header(frame: bytes) -> dict:
    """Tables and sizes of a baseline JPEG, and where its scan starts."""
    h = {"dc": {}, "ac": {}, "q": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        kind, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                h["q"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind in (0xC0, 0xC1):
            _, h["height"], h["width"], parts = struct.unpack_from(">BHHB", body)
            h["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif kind == 0xC4:
            while body:
                counts, total = body[1:17], sum(body[1:17])
                codes, code, k = {}, 0, 17
                for length, many in enumerate(counts, 1):
                    for _ in range(many):
                        codes[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                h["ac" if body[0] >> 4 else "dc"][body[0] & 15] = codes
                body = body[17 + total :]
        elif kind == 0xDD:
            h["restart"] = int.from_bytes(body, "big")
        elif kind == 0xDA:
            h["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            h["at"] = at
            break
    return h


_EVEN = header(_head(8, 8))
_heads: dict[bytes, dict] = {}


def _even(h: dict) -> bool:
    """Whether the frame is one grey with the tables of `frames_of`."""
    return len(h["parts"]) == 1 and not h["restart"] and h["dc"].get(0) == _EVEN["dc"][0] and h["ac"].get(0) == _EVEN["ac"][0] and list(h["scan"].values()) == [(0, 0)]


def blocks(frame: bytes, h: dict) -> np.ndarray:
    """Dequantised coefficients of the first component (rows x columns of blocks x 64), Huffman codes read one by one."""
    across, down = max(p[1] for p in h["parts"]), max(p[2] for p in h["parts"])
    columns, rows = -(-h["width"] // (8 * across)), -(-h["height"] // (8 * down))
    parts = [(p, *h["scan"][p[0]]) for p in h["parts"]]
    if len(parts) == 1:
        columns, rows = -(-h["width"] // 8), -(-h["height"] // 8)
        parts = [((parts[0][0][0], 1, 1, parts[0][0][3]), *parts[0][1:])]
    wide, high = parts[0][0][1], parts[0][0][2]
    out = np.zeros((rows * high, columns * wide, 64), np.int64)
    bits, at = "", 0

    def load(data: bytes) -> str:
        return "".join(f"{x:08b}" for x in data.replace(b"\xff\x00", b"\xff"))

    body, segments, start = frame[h["at"] :], [], 0
    k = 0
    while (k := body.find(b"\xff", k)) >= 0 and k + 1 < len(body):
        if body[k + 1] == 0:
            k += 2
        elif 0xD0 <= body[k + 1] <= 0xD7:
            segments.append(body[start:k])
            k += 2
            start = k
        else:
            break
    segments.append(body[start : k if k >= 0 else len(body)])

    def symbol(codes: dict) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | (bits[at] == "1")
            at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def number(size: int) -> int:
        nonlocal at
        if not size:
            return 0
        x = int(bits[at : at + size], 2)
        at += size
        return x if x >> (size - 1) else x - (1 << size) + 1

    each = h["restart"] or rows * columns
    for s, data in enumerate(segments):
        bits, at, last = load(data), 0, [0] * len(parts)
        for unit in range(s * each, min((s + 1) * each, rows * columns)):
            for c, ((_, hs, vs, table), dc, ac) in enumerate(parts):
                for y in range(vs):
                    for x in range(hs):
                        last[c] += number(symbol(h["dc"][dc]))
                        block = np.zeros(64, np.int64)
                        block[0], j = last[c], 1
                        while j < 64:
                            code = symbol(h["ac"][ac])
                            if code == 0:
                                break
                            j += code >> 4
                            if code != 0xF0:
                                block[j] = number(code & 15)
                            j += 1
                        if c == 0:
                            out[unit // columns * high + y, unit % columns * wide + x, ZIGZAG] = block * h["q"][table]
    return out


def pixels(frame: bytes) -> np.ndarray:
    """The luminance of a baseline frame, 8 bits a pixel."""
    h = header(frame)
    c = blocks(frame, h)
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) / 2
    basis[:, 0] = 8**-0.5
    grey = basis @ c.reshape(*c.shape[:2], 8, 8) @ basis.T
    return np.clip(np.rint(grey.transpose(0, 2, 1, 3).reshape(8 * c.shape[0], -1)) + 128, 0, 255).astype(np.uint8)[: h["height"], : h["width"]]


def samples_of(frames: list[bytes]) -> np.ndarray:
    """One sample a block of each frame: the mean of its luminance."""
    out = []
    for f in frames:
        cut = f.find(b"\xff\xda") + 10
        h = _heads.get(f[:cut])
        if h is None:
            if len(_heads) >= 256:
                _heads.clear()
            h = _heads[f[:cut]] = header(f)
            h["even"] = _even(h)
        if h["even"]:
            data = np.frombuffer(f[h["at"] : -2].replace(b"\xff\x00", b"\xff"), np.uint8)
            rows, columns = -(-h["height"] // 8), -(-h["width"] // 8)
            five = data[: len(data) // 5 * 5].reshape(-1, 5).astype(np.int64)
            packed = (five[:, 0] << 32) | (five[:, 1] << 24) | (five[:, 2] << 16) | (five[:, 3] << 8) | five[:, 4]
            diffs = _DIFF_OF[(packed[:, None] >> np.array([30, 20, 10, 0])) & 1023].ravel()[: rows * columns]
            dc = np.cumsum(diffs).reshape(rows, columns) * int(h["q"][h["parts"][0][3]][0])
        else:
            dc = blocks(f, h)[:, :, 0]
        out.append(np.clip(np.rint(dc / 8) + 128, 0, 255).astype(np.uint8))
    return np.stack(out) if out else np.zeros((0, 1, 1), np.uint8)


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """First frame, and the one after the last, of each clip."""
    n = len(samples)
    if not n:
        return []
    bins = samples.reshape(n, -1) // (256 // BINS) + (np.arange(n) * BINS)[:, None]
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS) / (samples.size // n)
    differences = np.abs(np.diff(hist, axis=0)).sum(1).tolist()
    starts, seen, total, squares = [0], 0, 0.0, 0.0
    for k, d in enumerate(differences, 1):
        mean = total / seen if seen else 0.0
        spread = max(0.0, squares / seen - mean * mean) ** 0.5 if seen else 0.0
        if d > FLOOR and d > mean + 3 * spread:
            starts.append(k)
            seen, total, squares = 0, 0.0, 0.0
        else:
            seen, total, squares = seen + 1, total + d, squares + d * d
    return list(zip(starts, [*starts[1:], n]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (an AVI file that holds the text's bytes)."""

    def run(batches):
        for b in batches:
            data = raw(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(map(store_bytes, data), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, media, payload (the samples in order), frames, clips (first_frame, end_frame, start_s, end_s), feature; carry: further columns."""
    names = ["doc_id", "media", "payload", "frames", "clips", "feature", *carry]
    clip = pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def one(data: bytes | None) -> tuple:
        try:
            frames, step, length = parse(data or b"")
            samples = samples_of(frames)
        except (ValueError, KeyError, IndexError, struct.error):
            return b"", 0, [], "broken"
        clips = [{"first_frame": a, "end_frame": e, "start_s": round(a * step, 6), "end_s": round(e * step, 6)} for a, e in shots(samples)]
        payload = samples.tobytes()
        longest = max((c["end_frame"] - c["first_frame"] for c in clips), default=0)
        return payload if length is None else payload[:length], len(frames), clips, f"frames={len(frames)};clips={len(clips)};longest={longest};mean={int(samples.astype(np.int64).sum()) // max(1, samples.size)}"

    def run(batches):
        for b in batches:
            payload, frames, clips, feature = zip(*map(one, b.column(1).to_pylist())) if len(b) else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(payload, pa.binary()), pa.array(frames, pa.int32()), pa.array(clips, pa.list_(clip)), pa.array(feature, pa.string()), *b.columns[2:]], names=names)

    more = "".join(f", `{c}` {stored.schema[c].dataType.simpleString()}" for c in carry)
    return map_arrow(stored.select("doc_id", "media", *carry), run, "doc_id long, media binary, payload binary, frames int, clips array<struct<first_frame:int,end_frame:int,start_s:double,end_s:double>>, feature string" + more)


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, end_frame, start_s, end_s: one row a clip."""
    return media.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
