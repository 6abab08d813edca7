import json

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import chunks, similarity, spans, text, validators
from cloakwork.operators import anonymize, audit, detect, evaluate, legal, manager, ner, search, stats
from cloakwork.plans import catalogue, settings
from cloakwork.plans.settings import Settings
from cloakwork.sources import files


def found(spark, *texts, table=catalogue.RUNTIME, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return detect.detect(docs, table, **options)


def entities_of(spark, body, **options):
    return found(spark, body, **options).collect()[0]["entities"]


GOLDEN = [
    ("Contact : john.doe@example.com ou admin@test.fr", [("EMAIL", "john.doe@example.com"), ("EMAIL", "admin@test.fr")]),
    ("Appelez 01 23 45 67 89 ou 0987654321", [("PHONE", "01 23 45 67 89")]),
    ("Le 15/03/2024 puis 31/12/2025", [("DATE", "15/03/2024"), ("DATE", "31/12/2025")]),
    ("M. le Président a parlé.", []),
    ("l'article 12/03/2014 dit ceci et bien plus encore, et fut signé le 15/03/2014", [("DATE", "15/03/2014")]),
    ("IBAN FR1420041010050500013M02606 et FR1420041010050500013M02607", [("IBAN", "FR1420041010050500013M02606")]),
    ("NIR 184127645108946 et 184127645108900", [("SSN", "184127645108946")]),
    ("SIREN 100000009 SIRET 10000000910008", [("SIREN", "100000009"), ("SIRET", "10000000910008")]),
    ("123456789 12345678900000", []),
    ("29/02/2020 31/02/2020", [("DATE", "29/02/2020")]),
    ("habite 10 bis rue de la Paix 75002 Paris", [("FRENCH_ADDRESS", "10 bis rue de la Paix 75002 Paris")]),
    (None, []),
    ("", []),
]


def test_detection(spark):
    got = {r["doc_id"]: [(e["type"], e["value"]) for e in r["entities"]] for r in found(spark, *[t for t, _ in GOLDEN]).collect()}
    assert got == {k: want for k, (_, want) in enumerate(GOLDEN)}


def test_dedup_and_confidence(spark):
    (e,) = entities_of(spark, "a@test.fr puis A@test.fr, a@test.fr")
    assert e["total_occurrences"] == 3 and e["variants"] == ["a@test.fr", "A@test.fr"] and len(e["all_positions"]) == 3 and e["confidence"] == 0.8
    (d,) = entities_of(spark, "le 15/03/2024")
    assert d["confidence"] == 0.65 and d["context"] == "le **15/03/2024**" and (d["start"], d["end"]) == (3, 13)
    assert entities_of(spark, "le 15/03/2024", settings=Settings(min_confidence=0.7)) == []


def test_offsets_count_code_points(spark):
    (e,) = entities_of(spark, "😀é ab@cd.fr")
    assert (e["start"], e["end"]) == (3, 11)


def test_person_tokens(spark):
    def tokens(*names):
        df = spark.createDataFrame([([(n, "PERSON") for n in names],)], "e array<struct<value:string,type:string>>")
        got = df.select(anonymize.person_tokens(F.col("e")).alias("t")).collect()[0]["t"]
        return {v: t["token"] for t in got for v in t["variants"]}

    assert len({*tokens("M. Jean Dûpont", "Dupont", "Mme Jean Dupont").values()}) == 1
    assert len({*tokens("Jean Dupont", "J. Dupont").values()}) == 1 and len({*tokens("Jean Dupont", "J. Dupon").values()}) == 2
    assert tokens("Ann", "Joanna Roy") == {"Ann": "[PERSON_1]", "Joanna Roy": "[PERSON_1]"}


def test_other_tokens(spark):
    def tokens(cutoff, *values):
        df = spark.createDataFrame([([("ORG", v) for v in values],)], "e array<struct<type:string,value:string>>")
        return [t["token"] for t in df.select(anonymize.other_tokens(F.col("e"), cutoff).alias("t")).collect()[0]["t"]]

    assert tokens(0.7, "ACME SARL", "ACME SARLX", "Other") == ["[ORG_1]", "[ORG_1]", "[ORG_2]"]
    assert tokens(0.85, "John", "John Doe") == ["[ORG_1]", "[ORG_2]"]


def test_anonymize_and_validate(spark):
    done = anonymize.anonymize(found(spark, "Mme Jean Dupont, a.b@c.fr et 15/03/2024; a.b@c.fr", "rien", None))
    rows = {r["doc_id"]: r for r in audit.validation(done).collect()}
    assert rows[0]["anonymized"] == "[PERSON_1], [EMAIL_1] et [DATE_1]; [EMAIL_1]" and rows[0]["success"] and rows[0]["success_rate"] == 100
    assert rows[1]["anonymized"] == "rien" and rows[2]["anonymized"] is None
    mapping = {r["doc_id"]: json.loads(r["mapping"]) for r in anonymize.mapping_json(done).collect()}
    assert mapping[0]["PERSON"]["jean dupont"] == {"token": "[PERSON_1]", "variants": ["Mme Jean Dupont"], "canonical": "jean dupont"}


def test_merge_history(spark):
    ent = "array<struct<type:string,value:string,replacement:string>>"
    df = spark.createDataFrame([(1, "ACME SARL et ACME SARLX", [("ORG", "ACME SARL", None), ("ORG", "ACME SARLX", None)])], f"doc_id int, text string, entities {ent}")
    done = anonymize.anonymize(df, Settings(similarity_threshold=0.7))
    assert done.collect()[0]["anonymized"] == "[ORG_1] et [ORG_1]"
    assert [(r["original"], r["variant"]) for r in anonymize.merge_history(done).collect()] == [("ACME SARL", "ACME SARLX")]
    assert [r["variants"] for r in anonymize.token_map(done).collect()] == [["ACME SARL", "ACME SARLX"]]


def test_merge_history_rows(spark):
    """Each row is a document, whatever its id; a text is read once, without a join."""
    ent = "array<struct<type:string,value:string,replacement:string>>"
    values = lambda *vs: [(kind, v, None) for kind, v in vs]
    orgs = values(("ORG", "ACME SARL"), ("ORG", "ACME SARLX"), ("ORG", "Other"), ("ORG", "ACME SARL Y"), ("PERSON", "Ann"), ("PERSON", "Ann Roy"))
    docs = [(1, "a", orgs), (1, "b", values(("ORG", "Others"), ("ORG", "Other"))), (None, "c", values(("ORG", "Others"), ("ORG", "Other"))), (2, "d", values(("ORG", "x"))), (3, "e", []), (4, "f", None)]
    got = anonymize.merge_history(anonymize.anonymize(spark.createDataFrame(docs, f"doc_id int, text string, entities {ent}"), Settings(similarity_threshold=0.7)))
    other = ("ORG", "[ORG_1]", "Others", "Other")
    want = [(1, "ORG", "[ORG_1]", "ACME SARL", "ACME SARLX"), (1, "ORG", "[ORG_1]", "ACME SARL", "ACME SARL Y"), (1, *other), (None, *other)]
    assert got.columns == ["doc_id", "type", "token", "original", "variant"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rewrite_quotes(spark):
    df = spark.createDataFrame([("a $1 b.c \\E x", [("b.c", "[$1\\]"), ("a", "[A]")])], "text string, p array<struct<v:string,t:string>>")
    tokens = F.transform("p", lambda p: F.struct(F.array(p["v"]).alias("variants"), p["t"].alias("token")))
    assert df.select(anonymize.rewrite(F.col("text"), tokens).alias("x")).collect()[0]["x"] == "[A] $1 [$1\\] \\E x"


def test_resolution(spark):
    schema = "s array<struct<id:string,type:string,method:string,confidence:double,start:int,end:int>>"
    cases = [
        ([("mobile", "FRENCH_MOBILE", "regex", 1.0, 5, 15), ("person", "PERSON", "regex", 1.0, 0, 8), ("phone", "PHONE", "regex", 1.0, 5, 15)], ["phone"]),
        ([("a", "ORG", "spacy", 0.9, 0, 5), ("b", "ORG", "spacy", 0.9, 5, 9)], ["a", "b"]),
        ([("a", "ORG", "spacy", 0.9, 0, 5), ("b", "ORG", "transformers", 0.99, 0, 9)], ["a"]),
        ([("a", "ORG", "spacy", 0.5, 0, 9), ("b", "ORG", "spacy", 0.9, 1, 3)], ["b"]),
        ([("a", "ORG", "spacy", 0.9, 0, 5), ("b", "ORG", "spacy", 0.9, 2, 7)], ["b"]),
        ([], []),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], schema)
    got = [[x["id"] for x in r["k"]] for r in df.select(spans.resolve(F.col("s")).alias("k")).collect()]
    assert got == [w for _, w in cases]
    strict = df.select(spans.resolve(F.col("s"), spans.longer).alias("k")).collect()
    assert [x["id"] for x in strict[4]["k"]] == ["a"]


def test_splice_and_coverage(spark):
    df = spark.createDataFrame([("abcdefghij", [(2, 4, "[X]"), (6, 10, "[Y]")])], "t string, s array<struct<start:int,end:int,r:string>>")
    row = df.select(spans.splice(F.col("t"), F.col("s"), lambda s: s["r"]).alias("x"), spans.coverage(F.col("s"), F.length("t")).alias("c")).collect()[0]
    assert row["x"] == "ab[X]ef[Y]" and row["c"] == 60.0


def test_names(spark):
    df = spark.createDataFrame([("Mr Jean de La Fontaine",), ("Dr Jean Dûpont",), ("Mme de La Tour",), ("",), ("M. Élodie d'Œuvre-Ñu",)], "n string")
    rows = df.select(text.name_parts(F.col("n")).alias("p"), text.last_name(F.col("n")).alias("l"), text.person_key(F.col("n")).alias("k")).collect()
    assert rows[0]["p"].asDict() == {"canonical": "jean de la fontaine", "first_names": ["jean"], "last_name": "fontaine", "particles": ["de", "la"]}
    assert rows[1]["l"] == "dupont" and rows[2]["l"] == "de la tour" and rows[3]["l"] == "" and rows[1]["k"] == "jean dupont"


def test_similarity(spark):
    df = spark.createDataFrame([("Mme Dupont", "Dupont"), ("Dupont", "Martin"), ("", "x")], "a string, b string")
    scores = [r["s"] for r in df.select(similarity.name_similarity(F.col("a"), F.col("b"), Settings().weights()).alias("s")).collect()]
    assert scores[0] > 0.9 and scores[1] < 0.5 and scores[2] == 0.0
    r = df.select(similarity.indel_ratio(F.lit("kitten"), F.lit("sitting")).alias("r")).first()["r"]
    assert r == pytest.approx(2 * 4 / 13)


def test_fuzzy_join_is_complete(spark):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for most in (1, 2, 3):
        got = {(r["a"], r["b"], r["distance"]) for r in similarity.fuzzy_join(df, df, "w", "w", most).collect()}
        assert got == {(a, b, d) for a in words for b in words if a != b and (d := distance(a, b)) <= most}


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0]["x"]
    assert one(text.preprocess(F.lit(" «œuvre»\n ‘x’  \x01y "))) == "\"oeuvre\" 'x' y"
    assert one(text.clean_value(F.lit("  a   b.,! "))) == "a b"
    assert one(text.slug(F.lit("Groupe é-1 "))) == "GROUPE_1"
    assert [one(text.file_size(F.lit(n))) for n in (0, 512, 2048, 5 * 1024**3)] == ["0 B", "512.0 B", "2.0 KB", "5.0 GB"]
    assert len(one(text.safe_filename(F.lit("a/" * 200 + ".txt")))) == 255 and one(text.safe_filename(F.lit("a<b>.txt"))) == "a_b_.txt"
    assert one(text.preceding_word(F.lit("chez Élodie  ici"), F.lit(13))) == "Élodie"
    assert one(text.metaphone_fr(F.lit("Philippe"))) == "FLPP"


def test_validators(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0]["x"]
    assert one(validators.phone_fr(F.lit("+33 6 12 34 56 78"))) and not one(validators.phone_fr(F.lit("0812345678"))) and not one(validators.phone_fr(F.lit(None).cast("string")))
    assert one(validators.iban_fr(F.lit("fr14 2004 1010 0505 0001 3M02 606"))) and not one(validators.iban_fr(F.lit("FR14é")))
    assert one(validators.nir(F.lit("1 84 12 76 451 089 46"))) and not one(validators.nir(F.lit("x")))
    assert not one(validators.date_fr(F.lit("01/01/2020"), F.lit("la loi du **01/01/2020**")))


def test_leaks(spark):
    df = spark.createDataFrame([(1, "Selon le Code Civil et le Tribunal Administratif"), (2, "Jean Dupont 01/02/2020 0612345678 x@y.fr")], "doc_id int, text string")
    assert {r["doc_id"]: r["leaks"] for r in audit.leaks(df).collect()} == {1: [], 2: ["email_like", "phone_like", "potential_name", "date_like"]}


E1 = [("e1", 1, "PERSON", "Alice", 0, 5, 0.9, "[PERSON_1]", 2, [(0, 5), (9, 14)]), ("e2", 1, "PERSON", "Bob", 3, 8, 0.6, "[PERSON_1]", None, None), ("e3", 1, "EMAIL", "Alice", 20, 29, 0.4, "[EMAIL_1]", 1, [])]
SCHEMA = "id string, doc_id int, type string, value string, start int, end int, confidence double, replacement string, total_occurrences int, all_positions array<struct<start:int,end:int>>"


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(E1, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_groups(spark, entities):
    got = {r["token"]: r for r in manager.grouped(entities).collect()}
    assert got["[PERSON_1]"]["total_occurrences"] == 3 and got["[PERSON_1]"]["id"] == "PERSON_1"
    counts = {(r["token"], r["value"]): (r["count"], len(r["positions"])) for r in manager.variant_counts(entities).collect()}
    assert counts[("[PERSON_1]", "Alice")] == (2, 2) and counts[("[PERSON_1]", "Bob")] == (1, 1)
    manual = spark.createDataFrame([("PERSON_1", "[CLIENT]", "X"), ("NEW", "[NEW]", "Y"), ("NONE", None, "Z")], "id string, token string, type string")
    over = {r["id"]: (r["token"], r["type"], r["total_occurrences"]) for r in manager.grouped(entities, manual).collect()}
    assert over == {"PERSON_1": ("[CLIENT]", "X", 3), "EMAIL_1": ("[EMAIL_1]", "EMAIL", 1), "NEW": ("[NEW]", "Y", 0)}


def test_group_edits(spark, entities):
    groups = spark.createDataFrame([("AMIS", "Amis", "", "PERSON", "[AMIS]", ["e1", "gone"])], files.GROUP)
    g, e = manager.create_group(groups, entities, "Amis", ["e3"])
    assert {r["id"]: r["token"] for r in g.collect()} == {"AMIS": "[AMIS]", "AMIS_2": "[AMIS_2]"} and ids(e.where("replacement = '[AMIS_2]'")) == ["e3"]
    g, e = manager.update_group(groups, entities.withColumn("replacement", F.lit("[AMIS]")), "AMIS", "[VUS]")
    assert [(r["id"], r["token"]) for r in g.collect()] == [("VUS", "[VUS]")] and e.where("replacement = '[VUS]'").count() == 3
    assert manager.join_group(groups, "AMIS", ["e1", "e2"]).first()["entity_ids"] == ["e1", "gone", "e2"]
    assert manager.leave_group(groups, "AMIS", ["e1"]).first()["entity_ids"] == ["gone"]
    assert manager.cleanup(groups, entities).first()["entity_ids"] == ["e1"] and manager.forget(groups, entities).first()["entity_ids"] == ["gone"]
    assert manager.delete_group(groups, "AMIS").count() == 0 and ids(manager.members(entities, groups)) == ["e1"]


def test_entity_edits(spark, entities):
    assert ids(manager.delete(entities, entities.where("id = 'e1'"))) == ["e2", "e3"] and ids(manager.delete_by_token(entities, "[PERSON_1]")) == ["e3"]
    assert manager.update(entities, spark.createDataFrame([("e1", "Zoe")], "id string, value string")).where("value = 'Zoe'").count() == 1
    parts = spark.createDataFrame([("e1", 0, 2, "Al"), ("e1", 2, 5, "ice")], "id string, start int, end int, value string")
    assert ids(manager.split(entities, parts)) == ["e1-1", "e1-2", "e2", "e3"]
    added = manager.add(entities, spark.createDataFrame([("ORG", "x", 1, 2), ("ORG", None, 1, 2)], "type string, value string, start int, end int"))
    assert added.count() == 4
    tokens = spark.createDataFrame([("[A]", ["x"])], "token string, variants array<string>")
    assert manager.edit_variants(tokens, "[A]", [" y ", "x", " "]).first()["variants"] == ["x", "y"] and manager.edit_variants(tokens, "[A]", ["z"], True).first()["variants"] == ["z"]


def test_conflicts(spark, entities):
    (c,) = audit.overlap_conflicts(entities).collect()
    assert (c["id1"], c["id2"], c["overlap_start"], c["overlap_end"], c["overlap_length"]) == ("e1", "e2", 3, 5, 2)
    assert [(r["value"], r["tokens"]) for r in audit.token_conflicts(entities).collect()] == [("Alice", ["[EMAIL_1]", "[PERSON_1]"])]
    assert ids(audit.resolve_conflicts(entities)) == ["e1", "e3"] == ids(audit.resolve_conflicts(entities, "keep_longest"))


def test_stats(spark, entities):
    s = stats.confidence_stats(entities).first()
    assert (s["high"], s["medium"], s["low"]) == (1, 1, 1) and s["avg_confidence"] == pytest.approx(0.633333, abs=1e-6)
    docs = spark.createDataFrame([(1, "x" * 100), (2, "")], "doc_id int, text string")
    assert {r["doc_id"]: (r["covered"], r["coverage"]) for r in stats.coverage(entities, docs).collect()} == {1: (17, 17.0), 2: (0, 0.0)}
    report = {r["doc_id"]: r for r in stats.document_report(entities.withColumn("method", F.lit("regex")), docs).collect()}
    assert report[1]["recommendations"] == ["low_confidence", "sensitive_data"] and report[2]["n"] == 0 and report[1]["most_common_type"] == "PERSON"


def test_model_fusion(spark):
    docs = spark.createDataFrame([(1, "Paul Martin écrit à p.m@test.fr depuis Lyon")], "doc_id int, text string")

    def loader():
        return lambda body: [("PER", 0, 11, 0.9), ("ORG", 20, 29, 0.9), ("MISC", 39, 43, None)]

    model = ner.detect_model(docs, ner.CallableBackend(loader))
    regex = detect.exploded(detect.detect(docs))
    got = ner.fuse(regex, model, docs).collect()[0]["entities"]
    assert [(e["type"], e["value"], e["method"], round(e["confidence"], 3)) for e in got] == [("PERSON", "Paul Martin", "spacy", 0.6), ("EMAIL", "p.m@test.fr", "regex", 1.0), ("MISC", "Lyon", "spacy", round(0.5 * 0.75 * 1.02 + 0.15, 3))]
    assert ner.detect_model(docs, ner.NullBackend()).count() == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "abc\nxx abc ABC\n"), (2, "none"), (3, None)], "doc_id int, text string")
    got = [(r["line"], r["match"], r["start"], r["end"]) for r in search.search(docs, "abc").orderBy("start").collect()]
    assert got == [(1, "abc", 0, 3), (2, "abc", 7, 10), (2, "ABC", 11, 14)]
    assert search.search(docs, "a.c", case_sensitive=True, regex=True).count() == 2 and search.search(docs, "a.c").count() == 0


def test_templates(spark):
    df = spark.createDataFrame([("Contrat de bail entre le Bailleur",), ("Audience",), ("x",)], "t string")
    assert [r[0] for r in df.select(legal.template_of(F.col("t"))).collect()] == ["contrat_bail", "procedure_civile", None]


def test_evaluation(spark):
    """Labelled sentences of one shape; that case is ignored lets a name run on over a small word."""
    words = "M. Jean Dupont a envoyé un email à Mme Louise Petit le 01/02/2020 . Son email est a@b.fr et son téléphone est 0612345678 .".split()
    labels = ["O", "PERSON", "PERSON", *["O"] * 6, "PERSON", "PERSON", "O", "DATE", "O", "O", "O", "O", "EMAIL", "O", "O", "O", "O", "PHONE", "O"]
    corpus = spark.createDataFrame([(words, ["PERSON" if w == "M." or w == "Mme" else x for w, x in zip(words, labels)])] * 3, "tokens array<string>, labels array<string>")
    got = {r["entity"]: (round(r["precision"], 3), r["recall"], r["support"]) for r in evaluate.evaluate(corpus).collect()}
    assert got == {"DATE": (1.0, 1.0, 3), "EMAIL": (1.0, 1.0, 3), "PERSON": (0.857, 1.0, 18), "PHONE": (1.0, 1.0, 3)}


def test_chunks(spark):
    body = "Une phrase. " * 100
    df = spark.createDataFrame([(body,), ("",), (None,), ("x" * 700,)], "t string")
    rows = df.select(chunks.by_sentence(F.col("t")).alias("s"), chunks.overlapping(F.col("t"), 300, 50).alias("o"), chunks.strided(F.col("t"), 300, 50).alias("f")).collect()
    assert "".join(c["chunk"] for c in rows[0]["s"]) == body and all(len(c["chunk"]) <= 512 for c in rows[0]["s"]) and rows[2]["s"] is None
    assert all(body[c["offset"] : c["offset"] + len(c["chunk"])] == c["chunk"] for c in [*rows[0]["o"], *rows[0]["f"]])
    assert [c["offset"] for c in rows[3]["o"]] == [0, 250, 500]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("déjà\nvu".encode())
    (tmp_path / "b.txt").write_bytes("déjà".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b" ")
    (tmp_path / "d.docx").write_bytes(files.docx_bytes(["M. Jean Dupont", "", "x & y"]))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.png").write_bytes(b"no document")
    got = {r["path"][-5]: r for r in files.documents(files.binary(spark, str(tmp_path))).collect()}
    assert got["a"]["text"] == "déjà\nvu" and got["a"]["meta"]["lines"] == "2" and got["b"]["text"] == "déjà" and got["b"]["meta"]["encoding"] == "latin-1"
    docx = next(r for r in files.documents(files.binary(spark, str(tmp_path))).collect() if r["path"].endswith("d.docx"))
    assert docx["text"] == "M. Jean Dupont\nx & y"
    errors = {r["path"].split("/")[-1]: r["error"] for r in files.documents(files.binary(spark, str(tmp_path))).collect()}
    assert errors["c.txt"] == "empty document" and errors["e.docx"].startswith("BadZipFile") and errors["a.txt"] is None and "f.png" not in errors


def test_state(spark, entities, tmp_path):
    full = entities.select("id", F.col("doc_id").cast("string").alias("doc_id"), *[c for c in entities.columns if c not in ("id", "doc_id")])
    groups = spark.createDataFrame([("A", "a", "", "PERSON", "[A]", ["e1"])], files.GROUP)
    files.write_state(full, groups, f"{tmp_path}/state")
    e, g = files.state_json(spark, f"{tmp_path}/state")
    assert ids(e) == ["e1", "e2", "e3"] and ids(g) == ["A"]
    with pytest.raises(Exception):
        files.write_state(full, groups, f"{tmp_path}/state")


def test_settings(tmp_path):
    assert Settings().weights() == {"levenshtein": 0.5, "jaccard": 0.3, "phonetic": 0.2}
    s = settings.from_environment({"ANONYMIZER_TITLES": "Sir, Dame", "ANONYMIZER_SIMILARITY_THRESHOLD": "x", "ANONYMIZER_SIMILARITY_WEIGHTS": "jaccard=1"})
    assert s.titles == ("sir", "dame") and s.similarity_threshold == 0.85 and s.weights()["jaccard"] == pytest.approx(1 / 1.7)
    (tmp_path / "t.json").write_text('{"cities": ["Nice"]}')
    lists = settings.term_lists({"ANONYMIZER_EXTRA_TERMS_FILE": f"{tmp_path}/t.json", "ANONYMIZER_EXTRA_TITLES": "Juge, "})
    assert "Nice" in lists["cities"] and "Juge" in lists["titles"] and settings.terms("a\n# b\n\n c ") == ["a", "c"]


def test_catalogue():
    import re

    assert len(catalogue.RUNTIME) == 16 and len(catalogue.EXTENDED) == 31
    for d in (*catalogue.RUNTIME, *catalogue.EXTENDED):
        re.compile(d.pattern)
