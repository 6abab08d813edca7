"""The document entry, exports, history of groups, and lookups."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import manager, ner, search, workflow
from cloakwork.plans.settings import Settings
from cloakwork.sources import files

BODY = "M. Jean Dupont écrit à jean@ex.fr le 15/03/2024.\nTel 0612345678 ou jean@ex.fr"


@pytest.fixture(scope="module")
def processed(spark):
    docs = spark.createDataFrame([(1, BODY), (2, None), (3, "  "), (4, "rien ici")], "doc_id long, text string")
    return workflow.process(docs).cache()


def test_process(processed):
    got = {r["doc_id"]: r for r in processed.collect()}
    assert got[1]["status"] == "success" and got[1]["success"] and got[1]["detection_method"] == "regex"
    assert "jean@ex.fr" not in got[1]["anonymized"] and got[1]["anonymized"].count("[EMAIL_1]") == 2
    assert [got[k]["status"] for k in (2, 3)] == ["error", "error"] and got[2]["error"] and got[4]["entities"] == []
    assert all(len(r["result_hash"]) == 16 for r in got.values())


def test_process_model(spark):
    """A backend adds its spans; without one, patterns serve."""

    def loader():
        return lambda body: [("PER", at, at + 4, 0.9)] if (at := body.find("Zola")) >= 0 else []

    docs = spark.createDataFrame([(1, "Selon Zola, jean@ex.fr répond.")], "doc_id long, text string")
    row = workflow.process(docs, mode="ai", backend=ner.CallableBackend(loader)).collect()[0]
    assert row["detection_method"] == "ai" and {e["type"] for e in row["entities"]} == {"PERSON", "EMAIL"} and "Zola" not in row["anonymized"]
    for backend in (None, ner.NullBackend()):
        row = workflow.process(docs, mode="ai", backend=backend).collect()[0]
        assert row["detection_method"] == "regex" and {e["type"] for e in row["entities"]} == {"EMAIL"}
    assert workflow.process(docs, Settings(min_confidence=1.1)).collect()[0]["entities"] == []


def test_export(spark, processed, tmp_path):
    workflow.export(processed, str(tmp_path / "out"), watermark="COPIE", with_audit=True)
    got = {r["doc_id"]: r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].startswith("COPIE\n\n") and "=== AUDIT REPORT ===\ndetection_method: regex" in got[1] and "=== STATISTICS ===\ntotal_entities: 4" in got[1]
    plain = {r["doc_id"]: r["content"] for r in processed.select("doc_id", workflow.export_text().alias("content")).collect()}
    assert plain[4] == "rien ici"
    with pytest.raises(ValueError):
        workflow.export(processed, "/a/b/", source="/a/b")
    with pytest.raises(ValueError):
        workflow.export(processed, str(tmp_path / "x"), kind="odt")
    with pytest.raises(Exception):
        workflow.export(processed, str(tmp_path / "out"))


def test_export_docx(spark, processed, tmp_path):
    """Runs are rewritten in place; layout, properties, watermark and sections."""
    one = processed.where("doc_id = 1")
    data = files.docx_bytes(BODY.split("\n"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["word/document.xml"] = parts["word/document.xml"].replace(b"<w:r>", b"<w:r><w:rPr><w:b/></w:rPr>")
    parts["docProps/core.xml"] = b'<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:creator>jean@ex.fr</dc:creator></cp:coreProperties>'
    parts["word/header1.xml"] = b'<w:hdr xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>0612345678</w:t></w:r></w:p></w:hdr>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    with_file = one.withColumn("file", F.lit(bytearray(out.getvalue())))
    workflow.export(with_file, str(tmp_path / "docx"), kind="docx", watermark="COPIE", with_audit=True, content_col="file")
    back = bytes(spark.read.parquet(str(tmp_path / "docx")).collect()[0]["content"])
    text, meta = files.docx_text(back)
    assert text.startswith("COPIE\n") and "[EMAIL_1]" in text and "jean@ex.fr" not in text and "=== STATISTICS ===" in text and "[EN-TÊTE] [PHONE_1]" in text
    with zipfile.ZipFile(io.BytesIO(back)) as z:
        assert b"[EMAIL_1]" in z.read("docProps/core.xml") and z.read("word/document.xml").count(b":b />") == 2
    workflow.export(one, str(tmp_path / "plain"), kind="docx")
    assert "[EMAIL_1]" in files.docx_text(bytes(spark.read.parquet(str(tmp_path / "plain")).collect()[0]["content"]))[0]
    broken = one.withColumn("file", F.lit(bytearray(b"no zip")))
    workflow.export(broken, str(tmp_path / "broken"), kind="docx", content_col="file")
    assert spark.read.parquet(str(tmp_path / "broken")).collect()[0]["content"] is None


def test_reviewed(processed):
    alone = workflow.reviewed(processed).collect()
    assert {(r["kind"], r["coherent"], tuple(r["issues"])) for r in alone} == {("unknown", True, ("server unavailable",))}

    def client():
        return lambda question, body: {"kind": " Bail ", "coherence": "a name is left\n" if "EMAIL" in body else "", "suggestions": None}[question]

    got = {r["doc_id"]: r for r in workflow.reviewed(processed, client).collect()}
    assert got[1]["kind"] == "bail" and not got[1]["coherent"] and got[1]["issues"] == ["a name is left"] and got[4]["coherent"] and got[4]["suggestions"] == "server unavailable"


def test_throughput():
    assert workflow.throughput(10, 4000, 2.0) == {"entities_per_second": 5.0, "bytes_per_second": 2000.0}
    assert workflow.throughput(10, 4000, 0) == {"entities_per_second": 0.0, "bytes_per_second": 0.0}


def test_large_and_long_files(spark, tmp_path):
    (tmp_path / "long.txt").write_text("x" * 50)
    (tmp_path / "large.txt").write_text("y" * 500)
    small = Settings(max_file_bytes=100, max_text_chars=20)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.documents(files.binary(spark, str(tmp_path), small), small).unionByName(files.refused(spark, str(tmp_path), small)).collect()}
    assert len(rows["long.txt"]["text"]) == 20 and rows["long.txt"]["meta"]["truncated"] == "true"
    assert rows["large.txt"]["text"] is None and "100 bytes" in rows["large.txt"]["error"]


def test_lookup_and_pages(spark):
    df = spark.range(120).selectExpr("cast(id as string) id")
    assert [r["id"] for r in manager.by_id(df, "7").collect()] == ["7"] and manager.by_id(df, "x").count() == 0
    order = F.col("id").cast("int")
    assert manager.page(df, 99, order).count() == 20 and manager.page(df, 0, order).first()["id"] == "0"


def test_undo_groups(spark):
    groups = spark.createDataFrame([("G1", "new", ["a", "b"]), ("G2", "named", ["c", "x"])], "id string, name string, entity_ids array<string>")
    entities = spark.createDataFrame([("a", "[G1]"), ("b", "[G1]"), ("c", "[C]")], "id string, replacement string")
    history = spark.createDataFrame(
        [
            (1, "update_group", "G2", '{"id":"G2","name":"old","entity_ids":["c","d"]}'),
            (2, "add_entity_to_group", "G2:x", None),
            (3, "remove_entity_from_group", "G2:d", None),
            (4, "create_group", "G1", '{"entities":[{"id":"a","replacement":"[A]"},{"id":"b","replacement":null}]}'),
            (5, "delete_group", "G3", '{"id":"G3","name":"gone","entity_ids":[]}'),
        ],
        "seq int, action string, target_id string, old_data string",
    )
    back, restored = manager.undo_groups(groups, entities, history, 2)
    assert {(r["id"], r["name"], tuple(r["entity_ids"])) for r in back.collect()} == {("G2", "named", ("c", "d")), ("G3", "gone", ())}
    assert {(r["id"], r["replacement"]) for r in restored.collect()} == {("a", "[A]"), ("b", None), ("c", "[C]")}
    assert {r["name"] for r in manager.undo_groups(groups, entities, history, 1)[0].collect()} == {"old", "gone"}
    assert manager.log(history, history, 3).count() == 3 and manager.cleared(history).count() == 0


def test_grouped_memo(spark):
    entities = spark.createDataFrame([("[A]", "x", "PERSON"), ("[A]", "y", "PERSON")], "replacement string, value string, type string").withColumns({"start": F.lit(0), "end": F.lit(1), "total_occurrences": F.lit(1), "id": F.col("value"), "all_positions": F.lit(None).cast("array<struct<start:int,end:int>>")})
    memo = manager.Grouped()
    first = memo.get(entities)
    assert memo.get(entities) is first and first.count() == 1
    assert memo.get(entities.limit(1)) is not first
    memo.invalidate()


def test_search_lines(spark):
    docs = spark.createDataFrame([(1, "un deux\ntrois un\n\nun"), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in search.search(docs, "un").orderBy("start").collect()]
    assert got == [(1, 1, "un", 0, 2), (1, 2, "un", 14, 16), (1, 4, "un", 18, 20)]
    entities = spark.createDataFrame([(1, "PERSON", "Ann", 0, 3), (1, "ORG", "Ann", 5, 8)], "doc_id long, type string, value string, start int, end int")
    assert search.with_entities(search.search(docs, "person: a"), entities, "person: a").count() == 1
    assert search.with_entities(search.search(docs, "person: a"), entities, "person: a", case_sensitive=True).count() == 0
    assert search.search(docs, "u.", regex=True, whole_words=True).count() == 4 and search.quick(docs, "emails").count() == 0
