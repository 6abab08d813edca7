"""Spans as arrays of structs on a document's row: found, put in context, resolved, spliced. Nothing here shuffles.

Offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalogue

SPAN = "struct<value:string,start:int,end:int>"


def once(c: Column) -> Column:
    """The same values, but computed where this stands: the optimizer neither copies nor moves what it takes as not
    deterministic, and else it would push filters on a long expression's result, with the expression, below it."""
    return F.when(F.rand(0) >= 0, c)


#: A character that stands in no text: a noncharacter of Unicode.
_MARK = "\uffff"


def _aligned(gaps: Column, matches: Column) -> Column:
    """Spans of matches and of what lies before each: a match starts after all of both before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(s: Column, pair: Column) -> Column:
        first = s["at"] + F.length(pair["gap"])
        end = first + F.length(pair["match"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(pair["match"].alias("value"), first.alias("start"), end.alias("end"))).cast(f"array<{SPAN}>").alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def find(text: Column, pattern: str, guard: str | None = None) -> Column:
    """array<struct<value,start,end>> of the pattern's matches, left to right.

    A text without a match, by a cheaper guard or the pattern, is left at that. Else matches are replaced by a mark and the
    text is split at it, as Spark keeps a compiled pattern for replacing but not for splitting.
    """
    text = F.coalesce(text, F.lit(""))
    p = F.lit(pattern)
    gaps = F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, p, F.lit(_MARK)), _MARK, -1))
    met = text.rlike(guard) & text.rlike(pattern) if guard else text.rlike(pattern)
    return F.when(met, _aligned(gaps, F.regexp_extract_all(text, p, F.lit(0)))).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_value(text: Column, value: Column) -> Column:
    """The same for a value as it is, whatever its case. Where lower case has another length, a regex finds it."""
    low, v = F.lower(text), F.lower(value)
    gaps = F.split(F.replace(low, v, F.lit(_MARK)), _MARK, -1)
    plain = _aligned(gaps, F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: v))
    p = literal(value)
    slow = _aligned(F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0)))
    return F.when((F.length(low) == F.length(text)) & (F.length(v) == F.length(value)) & ~text.contains(_MARK), plain).otherwise(slow)


def literal(value: Column, ignore_case: bool = True, words: bool = False) -> Column:
    """A regex column that matches the value as it is."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    edge = F.lit(r"\b" if words else "")
    return F.concat(F.lit("(?iU)" if ignore_case else "(?U)"), edge, quoted, edge)


def replacement(token: Column) -> Column:
    """A token as a regex's replacement, its signs taken as they are."""
    return F.regexp_replace(token, r"([\\$])", r"\\$1")


def overlap(a, b) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def ranked(kind: Column, values: dict, default) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), values.items(), F.when(kind.isNull(), F.lit(default))).otherwise(F.lit(default))


def wins(new: Column, old: Column) -> Column:
    """Whether a span displaces an accepted one: a checked type, then the method, then a confidence ahead by more than 0.15, then at least the length."""
    a, b = new["type"].isin(*catalogue.VALIDATED), old["type"].isin(*catalogue.VALIDATED)
    x, y = ranked(new["method"], catalogue.METHOD_RANK, 0), ranked(old["method"], catalogue.METHOD_RANK, 0)
    ahead = new["confidence"] - old["confidence"]
    length = (new["end"] - new["start"]) >= (old["end"] - old["start"])
    return F.when(a != b, a).when(x != y, x > y).when(F.abs(ahead) > 0.15, ahead > 0).otherwise(length)


def longer(new: Column, old: Column) -> Column:
    """The plainer rule: only a longer span displaces an accepted one."""
    return (new["end"] - new["start"]) > (old["end"] - old["start"])


def by_position(spans: Column, *ties: str, longest_first: bool = True) -> Column:
    """Sorted by start, then length, then the fields named, then the order they had."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(s["start"].alias("k0"), ((s["start"] - s["end"]) if longest_first else F.lit(0)).alias("k1"), *[s[t].alias(f"t{n}") for n, t in enumerate(ties)], i.alias("k2"), s.alias("span")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def resolve(spans: Column, rule=wins, longest_first: bool = True) -> Column:
    """Greedy resolution: spans come by position; each is held against the first accepted span that it overlaps, which it
    replaces or gives way to. Needs type, method, confidence, start, end."""

    def step(kept: Column, new: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda old: overlap(new, old)), F.lit(True)).cast("int")
        swapped = F.concat(F.slice(kept, 1, F.greatest(at - 1, F.lit(0))), F.array(new), F.slice(kept, at + 1, F.size(kept)))
        return F.when(at == 0, F.array_append(kept, new)).when(rule(new, F.get(kept, F.greatest(at - 1, F.lit(0)))), swapped).otherwise(kept)

    return F.aggregate(by_position(spans, longest_first=longest_first), F.filter(spans, lambda s: F.lit(False)), step)


def splice(text: Column, spans: Column, token) -> Column:
    """The text with each span, by its offsets, replaced; spans must not overlap. token: struct -> Column."""
    ordered = by_position(spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), token(x)).alias("out")))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def coverage(spans: Column, length: Column) -> Column:
    """Per cent of a text's characters that spans cover, each once; 0 for an empty text."""
    start = F.struct(F.lit(0).cast("int").alias("to"), F.lit(0).cast("int").alias("n"))
    got = F.aggregate(by_position(spans), start, lambda s, x: F.struct(F.greatest(s["to"], x["end"]).cast("int").alias("to"), (s["n"] + F.greatest(x["end"] - F.greatest(s["to"], x["start"]), F.lit(0))).cast("int").alias("n")))
    return F.when(length > 0, got["n"] * 100.0 / length).otherwise(F.lit(0.0))
