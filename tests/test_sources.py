"""Files read and written."""

import json

from quizloom.sources import files, schemas


def test_bank_round_trip(spark, tmp_path):
    q = {"id": "a1", "n": 1, "topic": "R", "source": "s1", "stem": "x", "options": ["p", "q"], "answer": [1], "optNotes": {"0": [{"anchor": "a", "html": "h"}]}}
    doc = {"types": ["Finals"], "topics": [{"id": "R", "name": "r"}], "sources": [{"id": "s1", "topic": "R"}], "cases": [], "questions": [q, {**q, "id": "a2"}]}
    (tmp_path / "bank.json").write_text(json.dumps(doc, indent=1))
    got = files.bank(spark, str(tmp_path / "bank.json"))
    assert [r["id"] for r in got["questions"].orderBy("ord").collect()] == ["a1", "a2"]
    assert got["questions"].first()["optNotes"]["0"][0]["html"] == "h" and got["cases"].count() == 0
    files.write_json(got["questions"].select("id", "dupOf"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id"]
    assert len(files.version(got["questions"].select("ord", "id"), "ord").first()[0]) == 12


def test_maps_and_texts(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"R1": {"answer": [1, 2], "why": "w"}, "R2": {"answer": [], "why": null}}')
    got = {r["key"]: r["value"]["answer"] for r in files.json_map(spark, str(tmp_path / "s.json"), "struct<answer:array<int>,why:string>").collect()}
    assert got == {"R1": [1, 2], "R2": []}
    (tmp_path / "b.txt").write_text("  hello \n")
    assert files.texts(spark, str(tmp_path)).first()["name"] == "b.txt"


def test_document_runs_and_numbering(spark, tmp_path):
    word = tmp_path / "d" / "word"
    word.mkdir(parents=True)
    (word / "document.xml").write_text('<w:body><w:p ><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>A</w:t></w:r></w:p><w:p ><w:r><w:rPr><w:b/><w:shd w:val="clear" w:fill="D9EAD3"/></w:rPr><w:t xml:space="preserve">x </w:t><w:br/><w:t>y</w:t></w:r></w:p></w:body>')
    (word / "numbering.xml").write_text('<n><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="7"/></w:num></n>')
    got = [tuple(r)[1:] for r in files.docx_runs(spark, str(tmp_path)).orderBy("p", "r").collect()]
    assert got == [(0, 0, "Title", None, False, False, "A"), (1, 0, "", "d9ead3", True, False, "x \ny")]
    assert [tuple(r)[1:] for r in files.docx_numbering(spark, str(tmp_path)).collect()] == [(2, 0, "decimal")]


def test_schemas_parse():
    assert all(files.schema_of(getattr(schemas, s)).fields for s in ("QUESTION", "SET", "CORRECTION", "UPDATE", "BANK"))
