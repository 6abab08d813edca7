"""Each operator against a plain version of its contract, on odd rows, an empty table, and the smallest documents."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from cloakwork.llm import bpe, language, licenses, media, mixing, packing, quality, queries, simhash, similar, substrings, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def pairs(spark, docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(params=["odd", "docs", "empty"])
def corpus(request):
    return request.getfixturevalue(request.param)


def test_bpe(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = rows_of(bpe.encode(corpus, path, decoded=True))
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in pairs(spark, corpus)]
    same([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"]) for r in got], [(d, ids, len(ids), library.decode(ids, skip_special_tokens=False)) for d, ids in want])
    back = rows_of(bpe.decode(bpe.encode(corpus, path), path))
    same([(r["doc_id"], r["text"]) for r in back], [(d, t or "") for d, t in pairs(spark, corpus)])


def test_bpe_random():
    import random

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    library, codec = Tokenizer.from_file(path), bpe.Codec(path, remember=50)
    letters = "aabcdee\u00e9 \u00f1  \n\t'stre!?.,0123456789\u00b2\u00bd\u00a0\x1c\x85\u3000<|\u6f22\u5b57\U0001f600\u00df\u0416\r\x00"
    for k in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        s += "<|endoftext|>" * (k % 9 == 0) + s * (k % 4)
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, s


def test_mixing(spark, corpus):
    got = rows_of(mixing.mix(corpus))
    again = rows_of(mixing.mix(corpus))
    same(got, again)
    want = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in corpus.select("doc_id", "text", "source").collect()]
    same([(r["doc_id"], r["size"], r["source"]) for r in got], want)
    sizes = defaultdict(int)
    for _, n, s in want:
        sizes[s] += n
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    targets = mixing.shares([sizes[s] for s in names], weights)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["whole"] * r["size"] + sum(x["words"] for x in r["spans"])
        assert all(0 <= x["start"] and x["words"] > 0 and x["start"] + x["words"] <= r["size"] for x in r["spans"])
        assert math.isclose(r["target"], targets[names.index(r["source"])])
        taken[r["source"]] += r["taken"]
    for s, t in zip(names, targets):
        assert abs(taken[s] - t) <= 0.02 * t + 70, (s, taken[s], t)


def test_shares():
    assert mixing.shares([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.shares([10, 1000, 10], [5, 2, 1]) == [30.0, 960.0, 30.0]
    assert mixing.shares([], []) == [] and mixing.shares([0, 8], [5, 2]) == [0.0, 8.0]


def test_seats():
    """Against seats given one by one."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        votes = rng.integers(0, 1000, rng.integers(1, 9)).tolist()
        most = rng.integers(0, 40, len(votes)).tolist()
        total = int(rng.integers(0, 120))
        out = [0] * len(votes)
        for _ in range(min(total, sum(most))):
            i = max((k for k in range(len(votes)) if out[k] < most[k]), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
            out[i] += 1
        assert mixing.seats(votes, total, most) == out


def test_mix_applied(spark, corpus):
    """What apply gives is what mix plans, copy by copy; other columns stay, whatever their names."""
    names = ["mix_id", "mix_hash", "mix_whole", "mix_spans", "mix_words", "mix_part", "mix_text", "row", "spans", "new", "size", "place", "of", "start"]
    docs = corpus.withColumns({c: language.F.concat(language.F.lit(f"{c} "), language.F.coalesce(language.F.col("text"), language.F.lit("-"))) for c in names})
    for block in (64, 3):
        want = Counter()
        words = defaultdict(list)
        for d, t in pairs(spark, corpus):
            words[d].append(t)
        taken = defaultdict(int)
        for r in rows_of(mixing.mix(docs, block=block)):
            taken[r["doc_id"]] += r["taken"]
            (text,) = {t for t in words[r["doc_id"]] if len(WORD.findall(t or "")) == r["size"]} if len(words[r["doc_id"]]) > 1 else words[r["doc_id"]]
            want[r["doc_id"], text] += r["whole"] if r["size"] else 0
            if r["spans"]:
                w = WORD.findall(text)
                want[r["doc_id"], " ".join(x for s in r["spans"] for x in w[s["start"] : s["start"] + s["words"]])] += 1
        out = rows_of(mixing.apply(docs, block=block))
        assert Counter((r["doc_id"], r["text"]) for r in out) == +want
        got = Counter()
        for r in out:
            got[r["doc_id"]] += len(WORD.findall(r["text"]))
            assert r["n_chars"] == len(r["text"])
            whole = [t for t in words[r["doc_id"]] if t is not None]
            assert any(all(r[c] == f"{c} {t}" for c in names) for t in whole)
        assert got == Counter({d: n for d, n in taken.items() if n})


def test_mix_repeated(spark):
    """Equal rows are taken each by itself."""
    text = " ".join(f"w{k}" for k in range(7))
    rows = [(1, text, "a")] * 2 + [(2, "x y z", "b"), (None, text, "a"), (None, text, "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(4):
        mixed = rows_of(mixing.mix(docs, seed=seed, block=2))
        out = rows_of(mixing.apply(docs, seed=seed, block=2))
        assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in mixed)
        for d in (1, 2, None):
            assert sum(len(r["text"].split()) for r in out if r["doc_id"] == d) == sum(r["taken"] for r in mixed if r["doc_id"] == d)


def test_mix_shards(spark, docs, monkeypatch):
    """Many shards give each source its target as well."""
    monkeypatch.setattr(mixing, "SHARD", 5)
    taken, target = defaultdict(int), {}
    for r in rows_of(mixing.mix(docs, block=8)):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 200 for s, t in target.items())


def plain_fingerprint(text):
    words = [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, most=2):
    different = sorted(set(fps))
    root = {f: f for f in different}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= most:
                root[top(a)] = top(b)
    least = {}
    for d, f in zip(ids, fps):
        if d is not None:
            least[top(f)] = min(least.get(top(f), d), d)
    return [least.get(top(f)) for f in fps]


def test_simhash(spark, corpus):
    want = [(d, plain_fingerprint(t)) for d, t in pairs(spark, corpus)]
    tops = plain_components(*zip(*want)) if want else []
    for crowd in (1, 64):
        got = rows_of(simhash.near_duplicates(corpus, crowd=crowd))
        same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], [(d, f"{f:016x}", c) for (d, f), c in zip(want, tops)])


def test_simhash_chains(spark):
    """Crowded blocks, chains of links, and links at one and two bits; all by either way."""
    rng = np.random.default_rng(2)
    fps = [0, (1 << 64) - 1]
    for _ in range(30):
        f = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(rng.integers(1, 12)):
            fps.append(f)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
    fps += [b << 1 for b in fps[:20] if b < 1 << 63]
    different = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in different]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_components(list(range(len(different))), different)
    for crowd in (1, 4, 64):
        label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, crowd)).collect()}
        groups = defaultdict(set)
        for k, f in enumerate(signed):
            groups[label.get(f, f)].add(k)
        expected = defaultdict(set)
        for k, c in enumerate(want):
            expected[c].add(k)
        same(groups.values(), expected.values())


def test_representatives(spark, corpus):
    got = rows_of(simhash.representatives(corpus))
    want = [(d, plain_fingerprint(t)) for d, t in pairs(spark, corpus)]
    tops = plain_components(list(range(len(want))), [f for _, f in want]) if want else []
    assert len(got) == len(set(tops))
    groups = defaultdict(list)
    for (d, _), c in zip(want, tops):
        groups[c].append(d)
    same([r["doc_id"] for r in got], [min((d for d in g if d is not None), default=None) for g in groups.values()])


def test_representatives_further_columns(spark):
    """Rows equal in id and text are told apart by their other columns, the same on each run; equal ones are one."""
    text = "one two three four five six seven eight"
    rows = [(1, text, c) for c in "dbca"] + [(1, text, "a"), (None, text, "z"), (2, "other " * 9, None), (2, "other " * 9, None)]
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(n)
        for found in (simhash.representatives(df), similar.representatives(df)):
            got = sorted((r["doc_id"], r["row"]) for r in found.collect())
            assert [d for d, _ in got] == [1, 2] and got[0][1] in "abcd"
            if n == 1:
                seen = got
            assert got == seen


def test_blocks(spark):
    """Any two bits leave one choice of blocks untouched."""
    masks = [m & (2**64 - 1) for m in simhash.block_masks()]
    assert len(masks) == 10
    for a in range(64):
        for b in range(a + 1):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


PAGES = [None, "", "no scheme", "http://", "http://Org/", "https://www.EXAMPLE.org/es/12?x=/de/", "http://example.org/en/1203#top", "http://example.org/en/", "http://x.org", "http://x.org?/", "http://a.com/fr/1", "http://com/de/", "http://xcom/de/", "http://x.net/de/1",
         "ftp://example.org/es", "http://.org/x", "http://org./x", "http://example.org:80/es/1", "http://b.c.d.example.org/es/\n/x", "a://b://org/x", "http://notexample.org/es/1", "http://example.org/es/1", "http://example.org/es/1", "://org/\u00e9"]


def plain_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("rules", [urls.RULES, [], [urls.Rule("block", f"h{k}.net", f"/{k}/") for k in range(300)] + urls.RULES])
def test_urls(spark, rules):
    more = [f"http://h{k}.net/{k // 2}/x" for k in range(400)] + [f"http://h{k}.net/{k}/x" for k in range(400)] if len(rules) > 10 else []
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(PAGES + more)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got == {k: plain_url(u, rules) for k, u in enumerate(PAGES + more)}


def test_url_cascade(spark):
    """Exact over its universe, even where each level is mistaken often."""
    universe = spark.range(3000).selectExpr("cast(id as string) key")
    members = universe.where("key % 3 = 0")
    levels = urls.cascade(members, universe)
    assert len(levels) > 1
    from pyspark.sql import functions as F

    got = universe.select("key", urls.listed(F.col("key"), levels).alias("x")).collect()
    assert all(r["x"] == (int(r["key"]) % 3 == 0) for r in got)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


def test_licenses(spark, corpus):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.summary(licenses.scan(corpus)).collect()}
    want = set()
    phrases = {t.text: t.label for t in licenses.TEMPLATES if t.base}
    for d, t in pairs(spark, corpus):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        found = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in found]
        want.add((d, len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    assert got == want


def test_license_labels(spark):
    texts = {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under the Apache License, Version 2.0": "apache-2", "nothing": "", "an MIT license": "", "licensed under the MIT license!": "mit", "source and binary forms": "",
             "Redistribution and use in source and binary forms, with or without modification, are allowed": "bsd", "GNU General Public License version 3": "gpl,gpl-3"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(df)).collect()}
    assert [got[k]["labels"] for k in range(len(texts))] == list(texts.values())
    assert all((0 < r["score"] <= 1) == bool(r["labels"]) for r in got.values())


def test_packing_bits():
    rng = np.random.default_rng(4)
    for bits in (1, 7, 13, 16, 17, 32):
        docs = [rng.integers(0, 1 << bits, n, dtype=np.uint32) for n in (0, 5, 9000, 1, 0, 4096)]
        r = packing.from_bytes(packing.to_bytes(list(range(6)), docs, bits))
        assert all((r.document(k) == x).all() for k, x in enumerate(docs))
        joined = np.concatenate(docs)
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(joined) + 1, 2).tolist())
            assert (r.span(a, b) == joined[a:b]).all()


def test_packing(spark, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    files = packing.write(corpus, public_tokenizers.path("word_bpe_49k.json"), packing.token_folder(spark), end_id=1)
    got = sorted(rows_of(packing.read(files)), key=lambda r: r["start"])
    same(got, rows_of(packing.read(files, at_once=7)))
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    want = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in pairs(spark, corpus)]
    same([(r["doc_id"], bytes(r["ids"])) for r in got], want)


def test_packing_one_id(spark):
    """Rows of one id, or none, are dealt to many files and come back whole and in order."""
    rows = [(5, f"text {k} of one id") for k in range(300)] + [(None, f"nameless {k}") for k in range(300)] + [(9, "last"), (1, "first")]
    files = packing.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), public_tokenizers.path("word_bpe_49k.json"), packing.token_folder(spark))
    assert sum(f["n_docs"] > 0 for f in files.collect()) > 2 and max(f["n_docs"] for f in files.collect()) < 300
    got = sorted(rows_of(packing.read(files)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + [1] + [5] * 300 + [9]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    same([(r["doc_id"], bytes(r["ids"])) for r in got], [(d, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for d, t in rows])


def test_packing_odd_width(spark, tmp_path):
    """Files of a width that is no whole number of bytes, through Spark: a small vocabulary in a file of its own."""
    from tokenizers import Tokenizer as T, models, pre_tokenizers

    vocabulary = {w: k for k, w in enumerate(["?", *[f"w{k}" for k in range(90)]])}
    small = T(models.WordLevel(vocabulary, unk_token="?"))
    small.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    small.save(str(tmp_path / "small.json"))
    rows = [(k, " ".join(f"w{(k * j) % 90}" for j in range(k * 37 % 6000))) for k in range(40)]
    files = packing.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "small.json"), packing.token_folder(spark), end_id=100)
    got = sorted(rows_of(packing.read(files)), key=lambda r: r["start"])
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == [(d, [*(vocabulary[w] for w in t.split()), 100]) for d, t in rows]
    with open(files.collect()[0]["path"].removeprefix("file:"), "rb") as f:
        assert packing.from_bytes(f.read()).bits == 7


def test_quality(spark, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows_of(quality.quality(corpus, labels))]
    want = []
    for d, t in pairs(spark, corpus):
        t = t or ""
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        counts = Counter(windows)
        again = len({i for k, w in enumerate(windows) if counts[w] > 1 for i in range(k, k + 8)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, len(words) < 20 or 100 * again > 30 * len(words)))
    same(got, want)


def test_quality_partitions(spark):
    """A text's score is the same, bit by bit, whatever rows are beside it."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.unionByName(docs.withColumn("doc_id", language.F.col("doc_id") + 10**6))
    found = [{(r["doc_id"], r["score"], r["kept"]) for r in rows_of(quality.judge(twice.repartition(n), quality.fit(docs, quality.trusted_ids(labels))))} for n in (1, 7)]
    assert found[0] == found[1]
    score = {d: s for d, s, _ in found[0]}
    assert all(score[d] == score[d + 10**6] for d in score if d < 10**6)


def test_quality_verdicts(spark):
    """Documents that the labels call good stay, and most of those that they call bad go."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert not any(r["kept"] and r["base_failed"] for r in judged.values())
    by = defaultdict(list)
    for r in labels.collect():
        if not judged[r["doc_id"]]["base_failed"]:
            by[r["quality"], r["toxic"]].append(judged[r["doc_id"]]["kept"])
    assert all(by[1, 0]) and np.mean(by[0, 0]) < 0.3
    ratio = quality.fit(docs, quality.trusted_ids(labels))
    same([r["doc_id"] for r in quality.keep(docs, ratio).collect()], [d for d, r in judged.items() if r["kept"]])
    assert quality.quality(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def plain_substrings(rows, width=13):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - width + 1):
            if d is not None:
                first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), d), d)
    for d, w in words:
        gone = {i for k in range(len(w) - width + 1) if d is not None and first[tuple(w[k : k + width])] < d for i in range(k, k + width)}
        yield d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def test_substrings(spark, corpus):
    got = rows_of(substrings.dedup(corpus.repartition(5) if corpus.count() else corpus))
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], plain_substrings(pairs(spark, corpus)))
    for r in got:
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


@pytest.mark.parametrize("how", [{}, {"chunk": 5000, "bits": 4}, {"chunk": 20_000, "bits": 8, "step": 3}, {"chunk": 1, "bits": 5, "step": 2}])
def test_substring_chunks(spark, how):
    """Many chunks, buckets and passes agree with one."""
    df = spark.read.parquet(f"/root/testdata/{'sf0.01' if how.get('chunk') != 1 else 'sf0.001'}/documents.parquet").repartition(7)
    got = rows_of(substrings.dedup(df, **how))
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], plain_substrings(pairs(spark, df)))


def balanced(n, letters="ab"):
    """The Thue-Morse word of length 2^n, and its complement: a polynomial modulo 2^64 can't tell long ones apart."""
    bits = [k.bit_count() % 2 for k in range(1 << n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [10, 11, 12])
def test_colliding_words(spark, n):
    """Words that polynomial hashes confuse make neither equal windows across documents nor within one."""
    x, y = balanced(n)
    rest = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([x, *rest])), (2, " ".join([y, *rest])), (3, " ".join([y, *rest])), (4, " ".join([x, *rest[:7], y, *rest[:7], *rest[:8]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(substrings.dedup(df))}
    assert got == {d: tuple(v) for d, *v in plain_substrings(rows)}
    assert [got[k][1] for k in (1, 2, 3)] == [0, 0, 13]
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows_of(quality.judge(df, np.zeros(quality.BUCKETS)))}[4] == 0


def test_settle_by_check():
    """Windows whose 64 bits agree are told apart by the further 32."""
    h = np.array([5, 5, 5, 9, 5, 5], np.uint64)
    x = np.array([1, 2, 1, 7, 2, 1], np.uint32)
    d = np.array([4, 3, 6, 1, 8, 4], np.int64)
    once, lost = substrings.settle((h, x, d))
    same(zip(*map(np.ndarray.tolist, once)), [(5, 1, 4), (5, 2, 3), (9, 7, 1)])
    same(zip(*map(np.ndarray.tolist, lost)), [(5, 1, 6), (5, 2, 8)])
    back = substrings.unpack(pa.table({c: [v] for c, v in zip(("hashes", "checks", "ids", "counts"), substrings.pack(once))}))
    same(zip(*map(np.ndarray.tolist, back)), [(5, 1, 4), (5, 2, 3), (9, 7, 1)])


def test_language(spark, corpus):
    got = rows_of(language.identify(corpus))
    learned = {r["lang"] for r in corpus.collect() if r["lang"] is not None}
    want = {(d, zlib.crc32(str(d).encode()) % 4 == 2 if d is not None else True, not any(c.isalpha() for c in t or "")) for d, t in pairs(spark, corpus)}
    assert {(r["doc_id"], r["held_out"], r["lang_pred"] == "und") for r in got} == want
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in learned | {"und"} for r in got) and len(got) == corpus.count()


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).withColumnRenamed("doc_id", "id").join(docs, docs.doc_id == language.F.col("id")).where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert np.mean([r["accepted"] for r in got]) > 0.9
    assert {r["lang_pred"] for r in language.identify(docs.drop("lang").withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}


def test_media(spark, corpus):
    got = rows_of(media.read(media.store(corpus), carry=("n_bytes",)))
    want = []
    for d, t in pairs(spark, corpus):
        data = (t or "").encode()
        want.append((d, len(data), data + b"\x00" * (-len(data) % 64 if data else 64)))
    same([(r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in got], want)
    values = defaultdict(set)
    for r in got:
        values[bytes(r["payload"])].add((bytes(r["media"]), r["feature"]))
        assert r["clips"][0]["first_frame"] == 0 and r["clips"][-1]["end_frame"] == r["frames"]
        assert all(a["end_frame"] == b["first_frame"] for a, b in zip(r["clips"], r["clips"][1:]))
    assert all(len(v) == 1 for v in values.values())


def test_media_frames():
    """The even reader, the general one, and all pixels agree."""
    data = bytes(np.random.default_rng(6).integers(0, 256, 3000, dtype=np.uint8))
    frames, step, length = media.parse(media.store_bytes(data))
    assert step == 0.04 and length == 3008
    samples = media.samples_of(frames)
    for f, s in zip(frames, samples):
        assert (media.blocks(f, media.header(f))[:, :, 0] // 8 + 128 == s).all()
        px = media.pixels(f)
        assert (px == np.kron(s, np.ones((8, 8), np.uint8))).all()


def encode_baseline(grey: np.ndarray) -> bytes:
    """A plain baseline JPEG of whole blocks: steps of 1, eight-bit codes for all DC sizes and AC symbols."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) / 2
    basis[:, 0] = 8**-0.5
    symbols = [0x00, 0xF0, *(r << 4 | s for r in range(15) for s in range(1, 11))]
    table = lambda kind, values: struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(values), kind) + bytes([0] * 7 + [len(values)] + [0] * 8) + bytes(values)
    out = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([1] * 64) + struct.pack(">BBHBHHB3B", 0xFF, 0xC0, 11, 8, *grey.shape, 1, 1, 0x11, 0) + table(0, range(12)) + table(0x10, symbols) + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    bits, last = "", 0
    number = lambda x: (abs(x).bit_length(), f"{x if x > 0 else x + (1 << abs(x).bit_length()) - 1:0{abs(x).bit_length()}b}" if x else "")
    for y in range(0, grey.shape[0], 8):
        for x in range(0, grey.shape[1], 8):
            c = np.rint(basis.T @ (grey[y : y + 8, x : x + 8] - 128.0) @ basis).astype(int).ravel()[media.ZIGZAG]
            size, tail = number(int(c[0]) - last)
            last = int(c[0])
            bits += f"{size:08b}" + tail
            run = 0
            for v in c[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 14:
                    bits, run = bits + f"{1:08b}", run - 16 if run >= 16 else run
                    if run == 15:
                        break
                size, tail = number(int(v))
                bits, run = bits + f"{symbols.index(max(run, 0) << 4 | size):08b}" + tail, 0
            if run:
                bits += f"{0:08b}"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    return out + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def test_media_general():
    """Frames with all coefficients, in an AVI: pixels close to the picture, shots where it changes."""
    y, x = np.mgrid[0:16, 0:24]
    pictures = [(100 + 4 * np.cos(x / 3.0 + t) * 8 + 20 * np.sin(y / 5.0)).astype(float) for t in range(4)] + [np.full((16, 24), 240.0)] * 3
    frames = [encode_baseline(p) for p in pictures]
    for f, p in zip(frames, pictures):
        assert np.abs(media.pixels(f).astype(float) - p).max() <= 3
    got, step, length = media.parse(media.avi(frames, 24, 16, 7, fps=10))
    assert got == frames and step == 0.1 and length == 7
    clips = media.shots(media.samples_of(got))
    assert clips[-1] == (4, 7)


def test_media_broken(spark):
    df = spark.createDataFrame([(1, bytearray(b"RIFFxxxx")), (2, None), (3, bytearray(media.store_bytes(b"abc")[:100]))], "doc_id long, media binary")
    assert [(r["feature"], r["frames"]) for r in media.read(df).collect()] == [("broken", 0)] * 3
    assert media.clips(media.read(media.store(spark.createDataFrame([(1, "x" * 5000)], "doc_id long, text string")))).count() == 1


def test_queries(spark):
    """The registered queries return the columns of their contracts over whole tables."""
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    columns = {
        "op1_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_source_mix": "doc_id size source_size target taken", "op3_simhash_groups": "doc_id fingerprint component_id", "op4_url_filter": "page_id host path rule verdict",
        "op5_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score", "op6_token_files": "doc_id start n_tokens ids_crc32", "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op8_substring_dedup": "doc_id n_words n_removed kept_sha256", "op9_language_id": "doc_id held_out lang_pred score", "op10_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    }
    assert columns.keys() == queries.QUERIES.keys()
    for name, wanted in columns.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns[: len(wanted.split())] == wanted.split(), name
        if name != "op4_url_filter":
            assert df.count() == n, name
    row = {r["doc_id"]: r for r in queries.op10_media_columns(spark, SF).collect()}[0]
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}[0].encode()
    padded = text + b"\x00" * (-len(text) % 64)
    assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest() and row["tail_crc32"] == zlib.crc32(padded[-64:])
