"""Texts cut into chunks. Where a cut depends on the one before it there is no closed form, so these are Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .workers import ship

CHUNKS = "array<struct<offset:int,chunk:string>>"


def _sentences(body: str, most: int) -> list[dict]:
    out, at = [], 0
    while len(body) - at > most:
        half, end = at + most // 2, at + most
        stop, space = body.rfind(". ", at, end), body.rfind(" ", half, end)
        cut = stop + 1 if stop > half else space if space > at else end
        out.append({"offset": at, "chunk": body[at:cut]})
        at = cut
    return [*out, {"offset": at, "chunk": body[at:]}] if at < len(body) or not out else out


def _overlapping(body: str, size: int, overlap: int) -> list[dict]:
    out, at = [], 0
    while at < len(body) or not out:
        end = at + size
        if end < len(body):
            space = body.rfind(" ", max(0, end - 50), end)
            end = space if space > at else end
        out.append({"offset": at, "chunk": body[at:end]})
        if end >= len(body):
            break
        at = max(end - overlap, at + 1)
    return out


def by_sentence(body: Column, most: int = 512) -> Column:
    """Chunks of at most `most` characters without overlap, cut after a sentence in the second half, else at a space there."""

    ship()

    @F.pandas_udf(CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _sentences(t, most))

    return cut(body)


def overlapping(body: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Chunks of at most `size` characters, cut at a space of the last 50, each from `overlap` before the last one's end."""

    ship()

    @F.pandas_udf(CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _overlapping(t, size, overlap))

    return cut(body)


def strided(body: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Chunks at fixed strides: a closed form, so built-in."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(body) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(body, s + 1, F.lit(size)).alias("chunk")))
