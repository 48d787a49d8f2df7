import json
import zipfile

from pyspark.sql import functions as F

from millrace.sources import files, sinks


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Qty</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')


def test_files_become_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfSupplier,x\r\n"Acme, Inc",1\r\nshort\r\n')
    (tmp_path / "notes.txt").write_bytes("سعر".encode("cp1256"))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "skip.exe").write_bytes(b"")
    workbook(tmp_path / "b.xlsx")
    found = files.files(spark, str(tmp_path))
    assert found.count() == 4
    rows = files.sheets(found)
    assert sorted((r.sheet or "", r.row_idx, r.cells) for r in rows.collect() if r.sheet)[:3] == [("Cleaned Data", 0, ["Supplier", "x"]), ("Cleaned Data", 1, ["Acme, Inc", "1"]), ("Cleaned Data", 2, ["short"])]
    assert [r.cells for r in rows.where("sheet = 'One'").collect()] == [["Qty", "", "2"]]
    assert rows.where("sheet IS NULL").first().cells[0].startswith("BadZipFile")
    assert files.texts(found).first().text == "سعر"
    assert {r.value for r in files.master(rows.where("sheet = 'Cleaned Data'")).where("field = 'supplier'").collect()} == {"Acme, Inc", "short"}
    assert [r.cells for r in files.csv_lines(spark, str(tmp_path / "a.csv")).where("value LIKE '%Acme%'").collect()] == [["Acme, Inc", "1"]]


def test_sniffing(spark):
    given = [(b"%PDF-1.7", "pdf"), (b"\x89PNG\r\n", "png"), (b"PK\x03\x04", "zip"), (b"a;b\n1;2", "csv"), (b"\0\1", "unknown"), (b"RIFF1234WEBP", "webp"), (b"", "unknown")]
    rows = spark.createDataFrame([(c, k) for c, k in given], "c binary, k string").select(files.sniff(F.col("c")).alias("got"), "k").collect()
    assert [r.got for r in rows] == [r.k for r in rows]


def test_templates(spark, tmp_path):
    good = {"source": "a", "type": "invoice", "fingerprint": "f", "header_text": "h", "columns": ["x"]}
    (tmp_path / "1.json").write_text(json.dumps([good, good]))
    (tmp_path / "2.json").write_text("{ not json")
    known = files.templates(spark, str(tmp_path))
    assert known.count() == 1
    assert sinks.merged_templates(known, known.withColumn("fingerprint", F.lit("g")).union(known)).count() == 2
    assert files.match_templates(spark.createDataFrame([("f",), ("q",)], "fingerprint string"), known, ("invoice",)).where("template IS NOT NULL").count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "S", ["a", ""], [50.0, 10.0], False), ("s", "S", ["", "b"], [90.0, 90.0], True)], "source string, sheet string, cells array<string>, confidence array<double>, flagged boolean")
    out = sinks.cleaned_table(rows, F.lit(3))
    assert [(r.cells, r.review) for r in out.collect()] == [(["a", "", ""], [0]), (["", "b", ""], [1])]
    sinks.write_sheets(out, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    invoices = spark.createDataFrame([(1, {"supplier": "x", "subtotal": "5"}, [("d", 1.0)], {"grand_total": "9"})], "doc_id long, header map<string,string>, items array<struct<description:string,qty:double>>, totals map<string,string>")
    head, items, totals = sinks.invoice_tables(invoices)
    assert {r.field: r.value for r in totals.collect()}["subtotal"] == "5" and items.count() == 1 and head.count() == len(sinks.HEADER_FIELDS)
    assert sinks.data_sheet(invoices).first().supplier == "x"
    titles = spark.createDataFrame([(1, 0, "A/B"), (1, 1, "a b"), (1, 2, None)], "d int, position int, name string")
    assert [r.title for r in sinks.sheet_titles(titles, ["d"]).orderBy("position").collect()] == ["A B", "a b_2", "Sheet"]


def test_providers(spark):
    from millrace.sources import provider

    def down(_):
        raise provider.Unavailable("no route")

    def reads(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return [("text", content.decode())]

    images = spark.createDataFrame([("p1", b"hello"), ("p2", b"bad")], "path string, content binary")
    got = {r.path: r for r in provider.read_pages(images, [("first", down), ("second", reads)]).collect()}
    assert got["p1"].provider == "second" and got["p1"].blocks[0].content == "hello" and got["p1"].fallback_reason == "first: no route"
    assert got["p2"].error == "ValueError: unreadable" and got["p2"].blocks == []
    answers = spark.createDataFrame([(1, '{"parsing_res_list": [{"block_label": "table", "block_content": "x"}]}'), (2, '{"blocks": [{"type": "text", "text": "y"}]}')], "id int, j string")
    assert {(r.id, r.label, r.content) for r in provider.blocks_of(answers, "id", "j").collect()} == {(1, "table", "x"), (2, "text", "y")}


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Dear </w:t></w:r><w:r><w:t>all</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sld>')
    (tmp_path / "c.docx").write_bytes(b"junk")
    got = sorted((r.kind, r.cells) for r in files.office(files.files(spark, str(tmp_path))).collect() if r.kind != "error")
    assert got == [("table", ["a", "b"]), ("text", ["Dear all"]), ("text", ["Title"])]


def test_blocks_on_a_sheet(spark):
    from millrace.operators import assembly

    blocks = spark.createDataFrame([(1, 0, [["a"], ["b", "c", "d"]]), (1, 1, [["e"]])], "doc_id int, block_idx int, rows array<array<string>>")
    assert [(r.row, r.cells) for r in assembly.sheet_rows(blocks).orderBy("row").collect()] == [(0, ["a", "", ""]), (1, ["b", "c", "d"]), (3, ["e", "", ""])]
