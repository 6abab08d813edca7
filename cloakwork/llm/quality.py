"""Quality rules (operator 7): counts of each text, and a hashed n-gram log-likelihood ratio.

The n-grams are the GRAM consecutive UTF-8 bytes at each place of a text, hashed into BUCKETS buckets. Two multinomials
over the buckets are counted: the trusted target, over a bounded sample of documents that the labels call
good and not toxic, and the raw corpus, over every document. The corpus is smoothed by one, the target by the corpus. A text's score is the mean of log(target / raw) over its
n-grams, so its length does not matter. A text is rejected if the base rules reject it or the score is below `least`.

Null and empty texts have no words: all counts 0, score 0, and the base rules reject them. Without trusted documents every
score is 0. Repeated rows give repeated rows; other columns are left out of the result of `judge`, and kept by `keep`.
A null doc_id is judged like any other. No text is shuffled: only bucket counts are, summed within each task first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, covered, map_arrow, texts, window_hashes, word_hashes, word_spans

GRAM, BUCKETS = 4, 1 << 15
WINDOW = 8
#: N-grams of the raw corpus that the target is smoothed with, so that few trusted documents don't speak against what they lack.
PRIOR = 1 << 18
#: Most trusted documents that are counted; beyond it those with the smallest hashes of their ids are.
TRUSTED = 20_000
#: Least mean log-likelihood ratio of a kept document.
LEAST = -0.25
#: Steps of a ratio that is summed.
UNIT = 1 << 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def buckets(flat: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram at each place but the last GRAM - 1."""
    if len(flat) < GRAM:
        return np.zeros(0, np.int64)
    n = len(flat) - GRAM + 1
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = (h << np.uint32(8)) | flat[k : k + n]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def inner(limits: np.ndarray, n: int) -> np.ndarray:
    """Which of n n-grams of a batch lie within one row."""
    ok = np.ones(n, bool)
    for k in range(1, GRAM):
        at = limits[1:] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> list[int]:
    """At most `limit` ids, the same on each run."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def fit(docs: DataFrame, trusted: list[int], id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket."""
    known = np.array(sorted(trusted), np.int64)

    def count(batches):
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            flat, limits = buffers(b.column(1))
            h = buckets(flat)
            ok = inner(limits, len(h))
            good = np.repeat(np.isin(b.column(0).fill_null(-1).to_numpy(), known) & b.column(0).is_valid().to_numpy(zero_copy_only=False), np.diff(limits))[: len(h)]
            raw += np.bincount(h[ok], minlength=BUCKETS)
            target += np.bincount(h[ok & good], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(target[seen]), pa.array(raw[seen])], names=["bucket", "target", "raw"])

    found = map_arrow(texts(docs, id_col, text_col), count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.collect():  # one row a bucket at most
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    if not target.sum():
        return np.zeros(BUCKETS)
    corpus = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + PRIOR * corpus) / (target.sum() + PRIOR)) - np.log(corpus)


def row_sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Each row's sum of whole numbers, or truth values."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[limits[1:]] - total[limits[:-1]]


def repeated(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of each row's words in windows that the row has twice or more."""
    h, first, row = window_hashes(words, rows, WINDOW)
    if not len(h):
        return np.zeros(len(rows) - 1, np.int64)
    order = np.lexsort((h, row))
    h, first, row = h[order], first[order], row[order]
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    if same.any():  # equal hashes are looked at word by word
        at = np.flatnonzero(same)
        same[at] = (words[first[at][:, None] + np.arange(WINDOW)] == words[first[at + 1][:, None] + np.arange(WINDOW)]).all(1)
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return row_sums(covered(first[twice], WINDOW, len(words)), rows)


def scores(flat: np.ndarray, limits: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Each row's mean ratio of its n-grams: in whole units of 1 / UNIT, so that a text's score doesn't depend on its neighbours."""
    h = buckets(flat)
    ok = inner(limits, len(h))
    most = np.minimum(limits, len(h))
    units = np.rint(ratio * UNIT).astype(np.int64)
    return row_sums(np.where(ok, units[h], 0), most) / UNIT / np.maximum(row_sums(ok, most), 1)


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, ratio: np.ndarray, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""

    def run(batches):
        for b in batches:
            flat, limits = buffers(b.column(1))
            starts, ends, rows = word_spans(flat, limits)
            n = np.diff(rows)
            chars = row_sums(((flat & 0xC0) != 0x80) & ~_WHITE[flat], limits)
            again = repeated(word_hashes(flat, starts, ends), rows)
            score = scores(flat, limits, ratio)
            data = flat.tobytes()
            lines = [dup_lines(data[x:y]) for x, y in zip(limits, limits[1:])]
            failed = (n < 20) | (100 * again > 30 * n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.asarray(x, np.int64)) for x in (n, chars, row_sums(_SYMBOL[flat], limits), lines, again)), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)], names=names
            )

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, ratio: np.ndarray, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is kept."""
    types = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            flat, limits = buffers(b.column(at).cast(pa.string()))
            starts, ends, rows = word_spans(flat, limits)
            n = np.diff(rows)
            again = repeated(word_hashes(flat, starts, ends), rows)
            yield b.filter(pa.array((n >= 20) & (100 * again <= 30 * n) & (scores(flat, limits, ratio) >= least)))

    return map_arrow(docs, run, types)


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST, trusted: int = TRUSTED) -> DataFrame:
    return judge(docs, fit(docs, trusted_ids(labels, trusted)), least)
