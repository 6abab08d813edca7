"""Language ID (operator 9): averaged hashed subword embeddings under a linear softmax.

Subwords are the GRAM consecutive bytes at each place of the folded text, in which ASCII letters are in lower case and every
other ASCII byte is a space; those with a space inside, rather than at an end, are left out. A text's vector is the mean of
its subwords' embeddings. Embeddings and softmax are trained together by stochastic gradient descent in numpy on the driver,
on at most `sample` labelled texts, chosen by hashes of their ids. One in five of these is held back to fit a temperature
for the scores and the least score that is accepted.

Prediction covers every whole text. Null texts and those without a letter get `und` and score 0, and are not accepted. A text
whose letters make no subword gets the language most frequent in training. Ties go to the first language by code point.
A null lang is not learned from. Without any labelled text all predictions are `und`. A null doc_id counts as held out.
Nothing but the text enters a prediction. Repeated rows give repeated rows; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, map_arrow, texts

GRAM, BUCKETS, DIM = 4, 1 << 16, 16
#: Most labelled texts that are learned from.
SAMPLE = 6_000
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def subwords(flat: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the subword at each place but the last GRAM - 1, and whether it counts."""
    n = len(flat) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    folded = _FOLD[flat]
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = (h << np.uint32(8)) | folded[k : k + n]
    ok = np.ones(n, bool)
    for k in range(1, GRAM - 1):
        ok &= folded[k : k + n] != 0x20
    for k in range(1, GRAM):
        at = limits[1:] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), ok


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def samples(docs: DataFrame, limit: int, id_col: str, text_col: str, lang_col: str) -> list:
    """(lang, buckets, counts) of the sample; the features are counted on the executors."""
    rows = texts(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang").where("lang is not null and text is not null").where(~held_out("doc_id"))
    # Those with the smallest hashes of their ids: a bound that about three times as many meet goes first, so that tasks
    # pass on few keys; only the chosen keys, at most `limit`, are sent along to pick the texts.
    share = min(1.0, 3 * limit / max(1, rows.count()))
    bound = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    place = F.xxhash64("doc_id")
    near = rows.where(place <= bound).withColumn("key", F.xxhash64("doc_id", "text", "lang"))
    keys = [r["key"] for r in near.select(place.alias("place"), "key").distinct().orderBy("place", "key").limit(limit).collect()]
    picked = near.sparkSession.createDataFrame([(k,) for k in keys], "key long")
    chosen = near.join(F.broadcast(picked), "key", "left_semi").select("doc_id", "text", "lang", "key")

    def count(batches):
        for b in batches:
            flat, limits = buffers(b.column(1))
            h, ok = subwords(flat, limits)
            found = [np.unique(h[x:y][ok[x:y]], return_counts=True) for x, y in zip(limits, limits[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary()), b.column(3)], names=["doc_id", "lang", "buckets", "counts", "key"])

    got = map_arrow(chosen, count, "doc_id long, lang string, buckets binary, counts binary, key long").dropDuplicates(["key"]).collect()
    return [(r.lang, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in sorted(got, key=lambda r: (r.doc_id, r.lang, bytes(r.buckets)))]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list, epochs: int = 4, rate: float = 0.5, seed: int = 9) -> dict | None:
    """languages (in code point order), table (each bucket's part of the logits), bias, temperature, least (accepted score)."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back = [rows[i] for i in order[: len(rows) // 5]]
    learn = [rows[i] for i in order[len(rows) // 5 :]]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            lang, at, counts = learn[i]
            eta, step = rate * (1 - step / steps), step + 1
            weight = counts / max(1, counts.sum())
            mean = weight @ vectors[at]
            error = softmax(mean @ out + bias)
            error[languages.index(lang)] -= 1
            back_to = out @ error
            out -= eta * np.outer(mean, error)
            bias -= 0.01 * eta * error
            vectors[at] -= eta * len(at) ** 0.5 * weight[:, None] * back_to  # each subword's own share of a long text is small
    table = vectors @ out
    temperature, least = 1.0, 0.0
    scored = [((c / max(1, c.sum())) @ table[a] + bias, languages.index(lang)) for lang, a, c in back if len(a)]
    if scored:
        logits, truth = np.array([z for z, _ in scored]), np.array([t for _, t in scored])
        temperature = min((2.0**k for k in range(-6, 7)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        right = softmax(logits / temperature).max(1)[logits.argmax(1) == truth]
        least = float(np.quantile(right, 0.01)) if len(right) else 1.0
    return {"languages": languages, "table": table.astype(np.float32), "bias": bias, "temperature": temperature, "least": least}


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted (the score is as high as almost all right predictions' are)."""

    def run(batches):
        for b in batches:
            flat, limits = buffers(b.column(1))
            letters = np.array([bool(x and _LETTER.search(x)) for x in b.column(1).to_pylist()], bool)
            if model is None:
                letters[:] = False
                best, score, languages = np.zeros(len(b), int), np.zeros(len(b)), ["und"]
            else:
                languages = model["languages"]
                h, ok = subwords(flat, limits)
                h = np.where(ok, h, BUCKETS)
                values = np.concatenate((model["table"], np.zeros((1, len(languages)), np.float32)))
                most = np.minimum(limits, len(h))
                grams = np.concatenate(([0], np.cumsum(ok)))
                grams = grams[most[1:]] - grams[most[:-1]]
                logits = np.zeros((len(b), len(languages)))
                for k in range(len(languages)):
                    total = np.concatenate(([0.0], np.cumsum(values[:, k][h], dtype=np.float64)))
                    logits[:, k] = (total[most[1:]] - total[most[:-1]]) / np.maximum(grams, 1)
                p = softmax((logits + model["bias"]) / model["temperature"])
                best, score = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([languages[k] if x else "und" for k, x in zip(best, letters)], pa.string()), pa.array(np.where(letters, np.round(score, 9), 0.0)), pa.array(letters & (score >= (model["least"] if model else 2)))], names=["doc_id", "lang_pred", "score", "accepted"]
            )

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted."""
    model = train(samples(docs, sample, id_col, text_col, lang_col))
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
