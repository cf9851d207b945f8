"""Files read as rows and written back."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from quern.sources import archives, files


def test_sheets_keep_their_file_lines(spark, tmp_path):
    sheet = ["[Sheet: Sales]", "name,amount,region", *[f'"x, {i}",{i},n' for i in range(10)], "total", "[Sheet: Two]", "a;b", "1;2", "3;4"]
    (tmp_path / "s.txt").write_text("\n".join(sheet))
    (tmp_path / "b.bin").write_bytes(bytes(range(1, 9)) * 50)
    lines = files.read_lines(spark, str(tmp_path))
    placed = files.blocks(lines)
    assert {(r["block"], r["sheet"]) for r in placed.select("block", "sheet").distinct().collect()} == {(1, "Sales"), (2, "Two")}
    rows = files.parse_block(placed.filter("block = 1"))
    assert rows.columns == ["line_no", "name", "amount", "region"] and rows.count() == 10
    assert tuple(rows.orderBy("line_no").first()) == (3, "x, 0", "0", "n")
    assert files.parse_block(lines.limit(0)) is None


def test_delimiters():
    assert files.detect_delimiter(["a;b;c", "1;2;3"]) == (";", 3) and files.detect_delimiter(["plain", "text"]) is None


def test_kinds_archives_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b.PDF",), (".env",), ("x.tsv",), ("y",)], "p string")
    assert [r["k"] for r in df.select(files.kind(F.col("p")).alias("k")).collect()] == ["pdf", "text", "spreadsheet", "unknown"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.txt", "abc")
        z.writestr("../out.txt", "x")
    assert [(r["entry"], r["size"], r["refused"]) for r in archives.archive_entries(spark, str(tmp_path / "z.zip")).orderBy("entry").collect()] == [(None, 1, "path"), ("in/a.txt", 3, None)]
    odd = spark.createDataFrame([('say "hi", x', None), ("a\nb", 2)], "t string, n int")
    files.write(odd, f"{tmp_path}/csv", "csv")
    assert {r["t"] for r in spark.read.csv(f"{tmp_path}/csv", header=True, quote='"', escape='"', multiLine=True).collect()} == {'say "hi", x', "a\nb"}
    page = spark.createDataFrame([("<table><tr><th>A</th><th> B </th></tr><tr><td>1</td><td><b>2</b></td></tr></table>",)], "html string")
    assert [r["cells"] for r in files.html_rows(page).collect()] == [["A", "B"], ["1", "2"]]


def _book(path, sheets, strings="", styles=""):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<r Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</R>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{strings}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    sales = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>note</t></is></c></row><row r="2"/>'
    sales += '<row r="3"><c r="A3" s="1"><v>45000.5</v></c><c r="B3"><f>1+1</f><v>2</v></c><c r="C3" t="s"><v>1</v></c><c r="AA3" t="b"><v>1</v></c></row>'
    strings = '<si><t>when</t></si><si><r><t>two, </t></r><r><t>"runs"</t></r><rPh><t>x</t></rPh></si>'
    styles = '<numFmts><numFmt numFmtId="164" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs>'
    _book(tmp_path / "b.xlsx", {"Sales": sales, "Two": '<row><c s="2"><v>1.5</v></c><c t="str"><v>a</v></c></row>'}, strings, styles)
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    lines = files.read_sheets(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["raw"] for r in lines] == ["[Sheet: Sales]", "when,,note", '2023-03-15T12:00:00.000Z,2,"two, ""runs""",' + "," * 23 + "true", "[Sheet: Two]", "1.5,a"]
    assert {r["sheet"] for r in files.blocks(files.read_sheets(spark, str(tmp_path))).collect()} == {"Sales", "Two"}


def test_markdown_and_html_sinks_and_append(spark, tmp_path):
    odd = spark.createDataFrame([("a|b\nc", None), ("<i>", 2)], "t string, n int").coalesce(1)
    files.write(odd, f"{tmp_path}/md", "md")
    files.write(odd, f"{tmp_path}/md", "md", mode="append")
    files.write(odd, f"{tmp_path}/html", "html")
    text = lambda kind: [r["value"] for r in spark.read.text(f"{tmp_path}/{kind}", wholetext=True).collect()]
    assert text("md") == ["| t | n |\n|---|---|\n| a\\|b<br>c |  |\n| <i> | 2 |\n"] * 2
    assert text("html") == ["<table>\n<tr><th>t</th><th>n</th></tr>\n<tr><td>a|b\nc</td><td></td></tr>\n<tr><td>&lt;i&gt;</td><td>2</td></tr>\n</table>\n"]
