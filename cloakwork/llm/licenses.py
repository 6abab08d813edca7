"""License scans (operator 5): a positional index of rare words.

A template is a run of words with a label and a mandatory key phrase in it. Over all documents it is counted in how many
each template word occurs; the two words of a key phrase with the highest IDF (the first of equals) are looked up. In a
document that has such a word, each place of one gives a start that the template would have; starts that both words agree
on are verified: the key phrase must stand there, word by word, at its relative position. The share of the template's words
that stand at their own relative positions is the match's score, and a label needs `least` of it. A template that is all
key phrase needs nothing else, so all its places are found.

Words are maximal runs of characters other than ASCII ones that are neither letters nor digits; A-Z count as a-z. Null and
empty texts have no words, no labels and score 0. Each row stands for itself: repeated rows give repeated rows, and no text
is shuffled. Other columns are left out. Only counts of template words reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def at(self) -> int:
        """Where the key phrase stands in the template."""
        k = self.key.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)


#: Base phrases, and short forms of well-known licences' notices.
TEMPLATES = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, and the number of documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(words_of(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count().collect()  # the empty word counts documents
    counts = {r["word"]: r["count"] for r in rows}
    return counts, counts.pop("", 0)


def rare(t: Template, counts: dict[str, int], n: int) -> list[tuple[str, int]]:
    """The key phrase's two words of highest IDF, and where they stand in the template."""
    key = t.key.split()
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) for w in key}
    first = {w: k for k, w in reversed(list(enumerate(key)))}
    return [(w, t.at + first[w]) for w in sorted(first, key=lambda w: (-idf[w], first[w]))[:2]]


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches (template, label, base, start, score), in the order of templates and places."""
    counts, n = frequencies(docs, templates, text_col)
    looked = [rare(t, counts, n) for t in templates]
    rarest = sorted({pair[0][0] for pair in looked})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    has = F.col("text").rlike("(?i)" + "|".join(rarest)) if rarest else F.lit(False)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = F.array(*map(F.lit, sorted({w for pair in looked for w, _ in pair})))
    nothing = "array<struct<word:string,at:int>>"
    postings = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda p: F.array_contains(wanted, p["word"]))
    rows = rows.withColumn("words", F.when(has, words_of(lower)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long")).withColumn("postings", F.when(F.size("words") > 0, postings).otherwise(F.array().cast(nothing)))
    found = [_places(k, t, pair, least) for k, (t, pair) in enumerate(zip(templates, looked))]
    return rows.select("doc_id", "n_words", F.when(F.size("postings") > 0, F.concat(*found)).otherwise(F.array().cast(_MATCHES)).alias("matches"))


_MATCHES = "array<struct<template:int,label:string,base:boolean,start:int,score:double>>"


def _places(number: int, t: Template, pair: list[tuple[str, int]], least: float) -> Column:
    def starts_by(w: str, rel: int) -> Column:
        return F.transform(F.filter("postings", lambda p: p["word"] == w), lambda p: p["at"] - rel)

    starts = [starts_by(w, rel) for w, rel in pair]
    both = F.array_intersect(*starts) if len(starts) == 2 else F.array_distinct(starts[0])
    key = t.key.split()
    verified = F.filter(both, lambda s: (s + t.at >= 0) & (F.slice("words", F.greatest(s + t.at, F.lit(0)) + 1, len(key)) == F.array(*map(F.lit, key))))

    def score(s: Column) -> Column:
        if t.key == t.text:
            return F.lit(1.0)
        same = [F.when((s + k >= 0) & (F.get("words", F.greatest(s + k, F.lit(0))) == w), 1).otherwise(0) for k, w in enumerate(t.words)]
        total = same[0]
        for x in same[1:]:
            total = total + x
        return total / F.lit(float(len(t.words)))

    matches = F.transform(verified, lambda s: F.struct(F.lit(number).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), (s + t.at).cast("int").alias("start"), score(s).cast("double").alias("score")))
    return F.filter(matches, lambda m: m["score"] >= least).cast(_MATCHES)


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
