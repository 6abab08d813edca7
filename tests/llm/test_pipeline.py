"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_operators import plain_substrings, same
from test_similar import left
from tokenizers import Tokenizer

import corpus_pipeline
from cloakwork.llm import mixing, quality
from cloakwork.llm.common import cut

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "encode"]


@pytest.mark.parametrize("corpus", ["docs", "odd", "empty"])
def test_stages(spark, request, corpus):
    docs = request.getfixturevalue(corpus)
    columns = docs.columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = cut(corpus_pipeline.quality_rules(spark, docs, SF), "t1")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge(docs, quality.fit(docs, quality.trusted_ids(labels))).where("kept")
    same([d for d, _ in rows(kept)], [r["doc_id"] for r in judged.collect()])
    assert kept.columns == columns and (corpus == "empty" or 0 < kept.count() < docs.count())

    before = rows(kept)
    single = cut(corpus_pipeline.near_dedup(spark, kept, SF), "t2")
    same([d for d, _ in rows(single)], left(before))
    assert single.columns == columns

    cleaned = cut(corpus_pipeline.substring_dedup(spark, single, SF), "t3")
    want = [(d, text if removed else original) for (d, original), (_, _, removed, text) in zip(rows(single), plain_substrings(rows(single)))]
    same(rows(cleaned), want)
    assert cleaned.columns == columns and all(r["n_chars"] == len(r["text"] or "") for r in cleaned.collect())

    mixed = cut(corpus_pipeline.source_mix(spark, cleaned, SF), "t4")
    taken = Counter({r["doc_id"]: r["taken"] for r in mixing.mix(cleaned).collect() if r["taken"]})
    got = Counter()
    originals = {d: WORD.findall(t or "") for d, t in rows(cleaned)}
    for d, t in rows(mixed):
        words = WORD.findall(t)
        got[d] += len(words)
        assert not Counter(words) - Counter(originals[d])
    assert got == taken and mixed.columns == columns

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.encode(spark, mixed, SF)
    same([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in out.collect()], [(d, library.encode(t, add_special_tokens=False).ids) for d, t in rows(mixed)])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0
