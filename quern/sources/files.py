"""Text files as rows: kinds of files, lines, sheets and delimited tables inside text, archives, and text sinks."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.archives import END, Opener, open_at, text_files

# File kinds by ending, delimiters in the order in which they are tried.
KINDS = {
    "pdf": ["pdf"], "document": ["docx", "doc", "odt", "rtf"], "spreadsheet": ["xlsx", "xls", "csv", "tsv", "ods"], "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp"], "archive": ["zip", "tar", "gz", "7z"],
    "code": ["js", "ts", "py", "java", "go", "rs", "c", "cpp", "sql", "sh", "abap", "css"], "text": ["txt", "log", "md", "json", "xml", "yaml", "yml", "html", "trc", "ini", "conf"],
}
DELIMITERS = [",", "\t", ";", "|"]
BANNER = r"^\[Sheet: (.*)\]\s*$"


def kind(path: Column) -> Column:
    """What kind of file a path names; names that begin with a dot are text, unknown endings unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(name.startswith("."), "text").otherwise(F.coalesce(*[F.when(ending.isin(v), k) for k, v in KINDS.items()], F.lit("unknown")))


def kind_of(name: str) -> str:
    """The same for one name."""
    name = name.rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return "text" if name.startswith(".") else next((k for k, v in KINDS.items() if ending in v), "unknown")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of text files, line numbers from 1; files whose two ends are over a tenth control characters are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    ends = F.when(F.length("text") <= 2 * END, F.col("text")).otherwise(F.concat(F.left("text", F.lit(END)), F.right("text", F.lit(END))))
    plain = whole.filter(F.regexp_count(ends, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]")) * 10 <= F.length(ends))
    return plain.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)


def read_long_lines(spark: SparkSession, path: str, open_file: Opener = open_at) -> DataFrame:
    """(file, line_no, raw) of text files of any size: a file is read in splits by many tasks, and its line numbers are those of the whole file.

    Lines are numbered inside their split and the counts of the splits before are added. A split's lines come in their order, so their
    places follow from the row ids of the scan; both scans of a file are cut into the same splits. Files that ``text_files`` finds not
    readable by their two ends are left out. A row for each split (about 100 bytes for 128 MB of text) is sent to all tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("raw"))
    # a row for each split
    held = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("_at")) - F.col("_n")).drop("_n")
    before = before.join(text_files(spark, path, open_file).filter("readable"), "file", "left_semi")
    return lines.join(F.broadcast(before), ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "raw")


def blocks(lines: DataFrame) -> DataFrame:
    """``lines`` (file, line_no, raw) without sheet banners, with the number and name of their sheet; line numbers stay those of the file."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    banner = F.regexp_extract("raw", BANNER, 1)
    named = lines.withColumn("_b", F.when(F.col("raw").rlike(BANNER), banner))
    named = named.withColumn("block", F.count("_b").over(order)).withColumn("sheet", F.last("_b", ignorenulls=True).over(order))
    return named.filter("_b is null and trim(raw) != ''").drop("_b")


def _cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), [])


def detect_delimiter(sample: list[str]) -> tuple[str, int] | None:
    """(delimiter, columns) of up to 60 lines: the commonest width above 1 held by 70 % of them, wide and steady ones first; None if there is none."""
    best, most = None, 0.0
    for d in DELIMITERS:
        widths = Counter(w for w in (len(_cells(x, d)) for x in sample[:60]) if w > 1)
        if widths:
            width, n = widths.most_common(1)[0]
            share = n / len(sample[:60])
            if share >= 0.7 and share * min(width, 12) > most:
                best, most = (d, width), share * min(width, 12)
    return best


def parse_block(lines: DataFrame) -> DataFrame | None:
    """The rows of one delimited block (line_no, raw) as columns c1, c2, ... or its header's names, with line_no; None if it is no table.

    Only a sample of 60 lines reaches the driver, for the delimiter and the header; rows of another width are left out.
    """
    sample = [r["raw"] for r in lines.orderBy("line_no").limit(60).collect()]
    found = detect_delimiter(sample)
    if not found or len(sample) < 3:
        return None
    d, width = found
    cells = F.from_csv("raw", F.lit(", ".join(f"c{k} string" for k in range(1, width + 2))), {"sep": d, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    first = [c.strip() for c in _cells(sample[0], d)]
    numeric = sum(c.replace(".", "", 1).replace("-", "", 1).isdigit() for c in first)
    header = numeric <= width // 4 and len(set(first)) == width and all(first)
    rows = lines.withColumn("c", cells).filter(F.col(f"c.c{width}").isNotNull() & F.col(f"c.c{width + 1}").isNull())
    if header:
        rows = rows.filter(F.col("raw") != sample[0])
    names = first if header else [f"c{k}" for k in range(1, width + 1)]
    return rows.select("line_no", *[F.col(f"c.c{k}").alias(n) for k, n in enumerate(names, 1)])


def html_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a row for each table row of the page: cells without markup, as an array."""
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return pages.withColumn("row", F.explode(rows)).withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell)).drop("row")


# Fixed values of the spreadsheet format: number formats that are dates, and its first day.
DATE_FORMATS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
DAY_0 = datetime(1899, 12, 30, tzinfo=UTC)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _joined(element: ElementTree.Element) -> str:
    """The text of a string item: that of its runs, without phonetic hints."""
    return "".join(t.text or "" for part in element if _local(part.tag) in ("t", "r") for t in part.iter() if _local(t.tag) == "t")


def _dates(z: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows dates."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^]]*\]', "", x.get("formatCode", "")) for x in root.iter() if _local(x.tag) == "numFmt"}
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    return [int(x.get("numFmtId", 0)) in DATE_FORMATS or bool(re.search("[dyhs]", own.get(int(x.get("numFmtId", 0)), ""))) for x in styles]


def _cell(cell: ElementTree.Element, strings: list[str], dates: list[bool]) -> str:
    kind, held = cell.get("t", "n"), {_local(x.tag): x for x in cell}
    if kind == "inlineStr":
        return _joined(held["is"]) if "is" in held else ""
    text = held["v"].text or "" if "v" in held else ""
    if kind == "s" and text:
        return strings[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    style = int(cell.get("s", 0))
    if kind == "n" and text and style < len(dates) and dates[style]:
        return (DAY_0 + timedelta(milliseconds=round(float(text) * 86_400_000))).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return text


def _column(reference: str, other: int) -> int:
    """The number of a column by letters: A is 0."""
    letters = re.match("[A-Z]*", reference)[0]
    return reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0) - 1 if letters else other


def _sheet_lines(content: bytes) -> Iterator[str]:
    """Per sheet its banner and its rows as quoted cells, one row in memory at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, strings, dates = set(z.namelist()), [], _dates(z)
        if "xl/sharedStrings.xml" in names:
            strings = [_joined(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for sheet in (x for x in book.iter() if _local(x.tag) == "sheet"):
            target = targets.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)) or ""
            target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            yield f"[Sheet: {sheet.get('name')}]"
            if target not in names:
                continue
            with z.open(target) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if _local(row.tag) != "row":
                        continue
                    cells: list[str] = []
                    for cell in (x for x in row if _local(x.tag) == "c"):
                        at = _column(cell.get("r", ""), len(cells))
                        cells += [""] * (at - len(cells)) + [_cell(cell, strings, dates)]
                    if any(cells):
                        out = io.StringIO()
                        csv.writer(out, lineterminator="").writerow([re.sub(r"\r?\n", " ", c) for c in cells])
                        yield out.getvalue()
                    row.clear()


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of .xlsx files, as ``read_lines`` has them, for ``blocks`` and ``parse_block``.

    A sheet is a banner and its rows that aren't empty, cells parted by commas: formulas as their last result, styled text joined,
    dates in ISO form. Line ends inside a cell become a space. Files that are no workbook have no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for file, content in zip(part["path"], part["content"], strict=True):
                try:
                    lines = enumerate(_sheet_lines(content), 1)
                    while some := list(islice(lines, 10_000)):
                        yield pd.DataFrame({"file": file, "line_no": [k for k, _ in some], "raw": [x for _, x in some]})
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, line_no int, raw string")


def _table_lines(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as lines of Markdown or HTML tables, one table for each part."""
    escapes = {"md": [("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")], "html": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]}[kind]
    plain = lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), escapes, c)
    safe = lambda t: reduce(lambda x, e: x.replace(*e), escapes, t)
    cells = [plain(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    if kind == "md":
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        head, end = ["| " + " | ".join(map(safe, df.columns)) + " |", "|" + "---|" * len(df.columns)], []
    else:
        row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
        head, end = ["<table>", "<tr><th>" + "</th><th>".join(map(safe, df.columns)) + "</th></tr>"], ["</table>"]

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        if first is not None:
            yield pd.DataFrame({"value": head})
            yield first
            yield from batches
            if end:
                yield pd.DataFrame({"value": end})

    return df.select(row.alias("value")).mapInPandas(framed, "value string")


def write(df: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """A table as csv (quoted where needed), json, parquet, md or html files below ``path``; ``mode`` may be append or overwrite.

    Every md and html file holds one table with its header.
    """
    if kind in ("md", "html"):
        _table_lines(df, kind).write.mode(mode).text(path)
        return
    options = {"csv": {"header": "true", "quote": '"', "escape": '"'}, "json": {"ignoreNullFields": "false"}, "parquet": {}}[kind]
    df.write.format(kind).mode(mode).options(**options).save(path)
