"""The near-duplicate stage against all pairs of texts."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from test_operators import same

import corpus_pipeline
from cloakwork.llm import similar, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_groups(texts, words=5, percent=80):
    """For each text, the first text that it is connected to."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    top = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((top[i], top[j]))
                top = [x if t == y else t for t in top]
    return top


def left(rows):
    groups = defaultdict(list)
    for (d, _), g in zip(rows, plain_groups([t for _, t in rows])):
        groups[g].append(d)
    return [min((d for d in g if d is not None), default=None) for g in groups.values()]


@pytest.mark.parametrize("corpus", ["docs", "odd", "empty"])
def test_stage(spark, request, corpus):
    docs = request.getfixturevalue(corpus)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    same([r["doc_id"] for r in got.collect()], left(rows))


def test_near_copies(spark):
    """Copies on both sides of the threshold, chains of them, a common passage, and one large group."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(12)]
    texts = []
    for k in range(60):
        text = [word() for _ in range(rng.randrange(20, 160))] + passage * (k % 3 == 0)
        for _ in range(120 if k == 0 else rng.randrange(1, 6)):
            texts.append(" ".join(text))
            copy = list(text)
            for _ in range(rng.randrange(1, 1 + max(1, len(text) // 30))):
                copy[rng.randrange(len(copy))] = word()
            text = copy if rng.random() < 0.5 else text
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = similar.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    want = left(rows)
    assert 60 < len(want) < len(rows)
    same([r["doc_id"] for r in got.collect()], want)


def test_simhash_first(spark, monkeypatch):
    """Near copies are linked by SimHash blocks; what differs in more bits is linked by keys, and only once for each component."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(4000)}" for _ in range(2000)]
    near = [" ".join([*text[:k], "new", *text[k + 1 :]]) for k in range(0, 2000, 100)]
    far = " ".join([*text[:1800], *(f"x{k}" for k in range(190))])
    odd = [" ".join(f"y{rng.randrange(4000)}" for _ in range(50)) for _ in range(5)]
    rows = list(enumerate([*near, far, *odd]))
    sets = [similar.shingles(pa.array([t]))[0] for _, t in rows]
    fps = [similar.fingerprint(s) for s in sets]
    for s, f in zip(sets, fps):
        assert f == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s))
    asked, found = [], []
    links, verified = simhash.links, similar.verified
    monkeypatch.setattr(similar, "links", lambda df: asked.append({r["fp"] % 2**64 for r in df.collect()}) or links(df))
    monkeypatch.setattr(similar, "verified", lambda *a: found.append(verified(*a)) or found[-1])
    counts = []
    monkeypatch.setattr(similar, "drop", lambda *cuts: counts.append(len(cuts)) or counts.extend(e.count() for _, e in found))
    got = similar.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    same([r["doc_id"] for r in got.collect()], left(rows))
    assert asked == [set(fps)]
    linked, further, more = counts[-3:]
    close = sum((a ^ b).bit_count() <= 2 for k, a in enumerate(fps) for b in fps[:k] if a != b)
    assert linked >= 10 and linked <= close + len(near) and further <= 8 * len(near) and more == 0


def test_stars(spark):
    """As many rows as nodes, not as links; components after further links."""
    pairs = [(a, b) for a in range(80) for b in range(a + 1, 80)] + [(100, 101), (102, 101)]
    edges = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    got = {(r["a"], r["b"]) for r in similar.starred(edges).collect()}
    assert got == {(0, k) for k in range(1, 80)} | {(100, 101), (100, 102)}
    labels = simhash.components(similar.starred(edges))
    after = similar.joined(labels, spark.createDataFrame([(5, 101), (200, 201), (3, 300), (7, 8)], "a long, b long"))
    assert {(r["node"], r["label"]) for r in after.collect()} == {(k, 0) for k in [*range(80), 100, 101, 102, 300]} | {(200, 200), (201, 200)}
