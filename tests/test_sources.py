import io
import zipfile

from pyspark.sql import functions as F

from foliant.sources import files, versions
from foliant.streaming import outbox


def docx(paragraphs, row):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tc>{p(c)}</w:tc>" for c in row)
    body = f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Main"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3</v></c><c r="C1"><f>A1</f></c><c r="D1" t="b"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files_are_scanned_and_read(spark, tmp_path):
    (tmp_path / "svc" / "2020").mkdir(parents=True)
    (tmp_path / "skip").mkdir()
    (tmp_path / "svc" / "2020" / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "svc" / "b.docx").write_bytes(docx(["first", "second"], ["x", "y"]))
    (tmp_path / "svc" / "c.xlsx").write_bytes(xlsx())
    (tmp_path / "svc" / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "svc" / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip" / "f.txt").write_bytes(b"x")
    rows = {r["relative_path"]: r for r in files.read_blocks(files.scan_files(spark, str(tmp_path), ["SKIP"])).collect()}
    assert set(rows) == {"svc/2020/a.txt", "svc/b.docx", "svc/c.xlsx", "svc/d.docx", "svc/e.pdf"}
    assert rows["svc/2020/a.txt"]["blocks"][0]["text"] == "café �"
    assert [b["text"] for b in rows["svc/b.docx"]["blocks"]] == ["first", "second", "x\ty"]
    assert [(b["cell"], b["text"]) for b in rows["svc/c.xlsx"]["blocks"]] == [("A1", "hello"), ("B1", "3"), ("C1", ""), ("D1", "TRUE")]
    assert {p: r["status"] for p, r in rows.items()} == {"svc/2020/a.txt": "ok", "svc/b.docx": "ok", "svc/c.xlsx": "partial", "svc/d.docx": "error", "svc/e.pdf": "tool_missing"}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    first = versions.write_version(spark.range(3), root)
    versions.activate(spark, root, first)
    assert versions.active(spark, root).count() == 3
    second = versions.write_version(spark.range(5), root)
    assert versions.active(spark, root).count() == 3
    versions.activate(spark, root, second)
    assert versions.active(spark, root).count() == 5
    assert versions.manifest(spark, root, second).agg(F.count("*")).first()[0] >= 1


def test_replay_keeps_the_last_mutation(spark, tmp_path):
    source, got = str(tmp_path / "in"), {}
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, seq long, op string").write.parquet(source)
    stream = spark.readStream.schema("k long, seq long, op string").parquet(source)
    q = outbox.replay(stream, lambda batch, _: got.update({r["k"]: r["op"] for r in batch.collect()}), str(tmp_path / "cp"), "k", "seq")
    q.awaitTermination(60)
    assert got == {1: "b", 2: "c"}


def test_ocr_blocks(spark):
    rows = [(5, 1, 1, 1, 1, 1, 10, 10, 5, 5, 90.0, "Hello"), (5, 1, 1, 1, 2, 1, 10, 20, 5, 5, 70.0, "there"), (5, 1, 1, 1, 1, 2, 20, 10, 5, 5, -1.0, "big"), (4, 1, 1, 1, 1, 0, 0, 0, 0, 0, -1.0, "")]
    df = spark.createDataFrame(rows, "level int, page int, block int, paragraph int, line int, word int, left int, top int, width int, height int, conf double, text string")
    r = files.ocr_blocks(df).first()
    assert (r["text"], r["x0"], r["x1"], r["y1"], r["confidence"]) == ("Hello big there", 10.0, 25.0, 25.0, 0.8)


def workbook(rows, styles):
    """An XLSX file: rows of (cell, style, type, value); styles as (id, format code) of own formats and as style -> id."""
    out = io.BytesIO()
    formats, uses = styles
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/styles.xml", f"<styleSheet><numFmts>{''.join(f'<numFmt numFmtId="{i}" formatCode="{c}"/>' for i, c in formats)}</numFmts><cellXfs>{''.join(f'<xf numFmtId="{i}"/>' for i in uses)}</cellXfs></styleSheet>")
        cells = "".join(f'<c r="{r}" s="{s}"{f' t="{t}"' if t else ""}><v>{v}</v></c>' for r, s, t, v in rows)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>")
    return out.getvalue()


def test_numbers_are_shown_by_their_masks(spark, tmp_path):
    formats = [(164, "00000"), (165, "0000 / 0000"), (166, "&quot;Nr &quot;000"), (167, "dd.mm.yyyy"), (168, "0.00")]
    rows = [("A1", 0, None, "7"), ("B1", 1, None, "7"), ("C1", 2, None, "3012345"), ("D1", 3, None, "5"), ("E1", 4, None, "45292"), ("F1", 5, None, "45292.5"), ("G1", 6, None, "2.5"), ("H1", 1, "b", "1"), ("I1", 1, None, "123456"), ("J1", 1, None, "-7")]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows, (formats, [0, 164, 165, 166, 167, 22, 168])))
    (tmp_path / "b.docx").write_bytes(docx(["text"], ["x"]))
    found = files.read_blocks(files.scan_files(spark, str(tmp_path))).where("extension = 'xlsx'").first()
    assert [b["text"] for b in found["blocks"]] == ["7", "00007", "0301 / 2345", "5", "2024-01-01T00:00:00", "2024-01-01T12:00:00", "2.5", "TRUE", "123456", "-00007"]


def test_a_large_workbook_is_partial(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_CELLS", 3)
    blocks = files.xlsx_blocks(workbook([(f"A{i}", 0, None, str(i)) for i in range(1, 9)], ([], [0])))
    assert len(blocks) == 4  # one more than is kept says that there are more
