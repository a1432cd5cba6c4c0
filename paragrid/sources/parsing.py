"""Files to typed blocks: format by content, HTML, Markdown, and zipped office formats of the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

BLOCKS = (
    "document_id string, block_id string, block_type string, text string, reading_order int, parser string, page int, "
    "section_path array<string>, table_id string, row_no int, column_no int"
)
# Limits of an archive's members: their number, the size of each and of all, and size over packed size.
MAX_MEMBERS, MAX_MEMBER, MAX_BYTES, MAX_RATIO = 100_000, 1 << 30, 4 << 30, 1_000
# Members that tell what a zipped file is.
ZIP_KINDS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("Contents/section0.xml", "hwpx"), ("META-INF/container.xml", "epub"))
_SKIP = {"script", "style", "noscript", "svg", "template"}
_TEXT = {"p": "paragraph", "li": "list_item", "caption": "caption", "figcaption": "caption", "dt": "list_item", "dd": "paragraph", "pre": "paragraph", "blockquote": "paragraph"}


def files(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """``(path, length, content)`` of the files below a folder, hidden ones left out, limited to the extensions if any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if extensions:
        found = found.where(F.lower(F.regexp_extract("path", r"([.][A-Za-z0-9]+)$", 1)).isin(*(e.lower() for e in extensions)))
    return found.where(~F.col("path").rlike(r"/[.][^/]*$")).select("path", "length", "content")


def strict_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of a JSON-lines file; a line that is no object of the schema ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def sniff(content: Column) -> Column:
    """The format of a file by its first bytes, whatever its name says."""
    head = F.upper(F.hex(F.substring(content, 1, 8)))
    text = F.lower(F.substring(content, 1, 512).cast("string"))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("504B0304"), "zip")
        .when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(text.rlike(r"^(\x{feff})?\s*(<!doctype html|<html|<head|<body)"), "html").otherwise("unknown")
    )


def page_class(characters: Column, words: Column, image_share: Column, tables: Column, columns: Column) -> Column:
    """A page's class: scan, table, complex or clean."""
    scan = (characters < 40) & ((words < 10) | (image_share >= 0.5))
    return F.when(scan, "scan").when(tables > 0, "table").when(columns > 1, "complex").otherwise("clean")


class _Page(HTMLParser):
    """Collects ``(type, text, section path, table, row, column)`` in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.path: list[tuple[int, str]] = []
        self.kind, self.buffer, self.skipped = "paragraph", [], 0
        self.tables = 0
        self.table: list[list[str]] | None = None
        self.depth = 0

    def _flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.buffer)).strip()
        self.buffer = []
        if not text:
            return
        if self.kind[0] == "h" and self.kind[1:].isdigit():
            level = int(self.kind[1:])
            self.path = [p for p in self.path if p[0] < level] + [(level, text)]
            self.rows.append(("heading", text, [p[1] for p in self.path], None, None, None))
        else:
            self.rows.append((self.kind, text, [p[1] for p in self.path], None, None, None))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skipped += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self._flush()
                self.table = []
        elif self.table is not None:
            if tag == "tr" and self.depth == 1:
                self.table.append([])
            elif tag in ("td", "th") and self.depth == 1:
                self.buffer = []
        elif re.fullmatch("h[1-6]|title", tag) or tag in _TEXT:
            self._flush()
            self.kind = "h1" if tag == "title" else tag if tag[0] == "h" and tag[1:].isdigit() else _TEXT[tag]
        elif tag in ("div", "section", "article", "main", "br", "tr", "body"):
            self._flush()
            self.kind = "paragraph"

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if self.depth == 0:
                self._table()
        elif self.table is not None:
            if tag in ("td", "th") and self.depth == 1 and self.table:
                self.table[-1].append(re.sub(r"\s+", " ", "".join(self.buffer)).strip())
                self.buffer = []
        elif re.fullmatch("h[1-6]|title", tag) or tag in _TEXT or tag in ("div", "section", "article"):
            self._flush()
            self.kind = "paragraph"

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.buffer.append(data)

    def _table(self) -> None:
        rows = [r for r in self.table or [] if any(r)]
        self.table, self.buffer = None, []
        if rows:
            _append_table(self.rows, rows, [p[1] for p in self.path], self.tables)
            self.tables += 1

    def blocks(self, html: str) -> list[tuple]:
        self.feed(html)
        self.close()
        self._flush()
        return self.rows


def _append_table(out: list[tuple], rows: list[list[str]], path: list[str], number: int) -> None:
    out.append(("table", "\n".join("\t".join(r) for r in rows), path, number, None, None))
    out += [("table_cell", cell, path, number, i, j) for i, row in enumerate(rows) for j, cell in enumerate(row)]


def html_blocks(content: bytes) -> list[tuple]:
    """Blocks of an HTML page; its bytes are UTF-8 or, where they are not, Korean."""
    for code in ("utf-8-sig", "cp949"):
        try:
            return _Page().blocks(content.decode(code))
        except UnicodeDecodeError:
            continue
    return _Page().blocks(content.decode("utf-8", "replace"))


def markdown_blocks(content: bytes) -> list[tuple]:
    """Blocks of a Markdown text: headings, list items, pipe tables and paragraphs."""
    out, path, table, number = [], [], [], 0
    paragraph: list[str] = []

    def flush() -> None:
        nonlocal number
        if paragraph:
            out.append(("paragraph", " ".join(paragraph), [p[1] for p in path], None, None, None))
            paragraph.clear()
        if table:
            _append_table(out, [r for r in table if not all(re.fullmatch(":?-+:?", c) for c in r)], [p[1] for p in path], number)
            number += 1
            table.clear()

    for line in content.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if heading := re.match(r"(#{1,6})\s+(.+)", line):
            flush()
            level = len(heading[1])
            path = [p for p in path if p[0] < level] + [(level, heading[2].strip())]
            out.append(("heading", heading[2].strip(), [p[1] for p in path], None, None, None))
        elif line.startswith("|") and line.endswith("|") and len(line) > 1:
            if paragraph:
                flush()
            table.append([c.strip() for c in line.strip("|").split("|")])
        elif item := re.match(r"([-*+]|\d+[.)])\s+(.+)", line):
            flush()
            out.append(("list_item", item[2], [p[1] for p in path], None, None, None))
        elif not line:
            flush()
        else:
            if table:
                flush()
            paragraph.append(line)
    flush()
    return out


def zip_fault(entries: list[zipfile.ZipInfo]) -> str | None:
    """Why an archive's members are refused: too_many, too_large, all_too_large, ratio, path; None if they are not."""
    size, packed = sum(e.file_size for e in entries), max(1, sum(e.compress_size for e in entries))
    if len(entries) > MAX_MEMBERS:
        return "too_many"
    if any(e.file_size > MAX_MEMBER for e in entries):
        return "too_large"
    if size > MAX_BYTES:
        return "all_too_large"
    if size > 1 << 20 and size / packed > MAX_RATIO:
        return "ratio"
    if any(e.filename.startswith("/") or ".." in e.filename.replace("\\", "/").split("/") for e in entries):
        return "path"
    return None


def _members(content: bytes) -> zipfile.ZipFile:
    """The archive, if its members keep the limits."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    if fault := zip_fault(archive.infolist()):
        raise ValueError(f"zip_{fault}")
    return archive


@F.pandas_udf(StringType())
def zip_kind(content: pd.Series) -> pd.Series:
    """What a zipped file is by its members: docx, xlsx, pptx, hwpx, epub or zip; the fault of one that is refused; null for no archive."""

    def kind(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            archive = _members(bytes(data))
        except zipfile.BadZipFile:
            return None
        except ValueError as fault:
            return str(fault)
        names = set(archive.namelist())
        return next((k for member, k in ZIP_KINDS if member in names), "zip")

    return pd.Series([kind(c) for c in content], dtype=object)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _words(element: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(t.text or "" for t in element.iter() if _local(t) == "t")).strip()


def _level(paragraph: ElementTree.Element) -> int | None:
    """A paragraph's heading level by the name of its style, if it has one."""
    for element in paragraph.iter():
        if _local(element) == "pStyle":
            style = next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == "val"), "")
            found = re.fullmatch(r"(?i)(?:heading|제목) ?([1-9])|title", style)
            return (int(found[1]) if found[1] else 1) if found else None
    return None


def office_blocks(content: bytes) -> list[tuple]:
    """Blocks of a zipped office file (docx, pptx, hwpx): headings by style, list items, paragraphs, and tables in their place; a slide is a page."""
    archive = _members(content)
    names = archive.namelist()
    parts = [n for n in ("word/document.xml",) if n in names]
    parts += sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml|Contents/section\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out: list[tuple] = []
    path: list[tuple[int, str]] = []
    number = 0
    for page, part in enumerate(parts, 1):
        inside: set = set()
        for element in ElementTree.fromstring(archive.read(part)).iter():
            if _local(element) == "tbl" and element not in inside:
                inside |= set(element.iter())
                rows = [[_words(c) for c in r if _local(c) == "tc"] for r in element.iter() if _local(r) == "tr"]
                _append_table(out, [r for r in rows if r], [p[1] for p in path], number)
                number += 1
            elif _local(element) == "p" and element not in inside and (text := _words(element)):
                level = _level(element)
                if level is not None:
                    path = [p for p in path if p[0] < level] + [(level, text)]
                listed = any(_local(e) == "numPr" for e in element.iter())
                kind = "heading" if level is not None else "list_item" if listed else "paragraph"
                out.append((kind, text, [p[1] for p in path], None, None, None, page if part.startswith("ppt/") else 1))
    return out


def sheet_blocks(content: bytes) -> list[tuple]:
    """Blocks of a workbook (xlsx): each sheet's name as a heading and its filled rows as a table, cells at their columns."""
    archive = _members(content)
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [_words(e) for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _local(e) == "si"]
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    titles = [e.attrib.get("name", "") for e in book.iter() if _local(e) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))

    def value(cell: ElementTree.Element) -> str:
        kind = cell.attrib.get("t", "n")
        if kind == "inlineStr":
            return _words(cell)
        raw = next((e.text or "" for e in cell if _local(e) == "v"), "")
        return shared[int(raw)] if kind == "s" and raw.isdigit() and int(raw) < len(shared) else {"0": "FALSE", "1": "TRUE"}.get(raw, raw) if kind == "b" else raw

    def column(reference: str) -> int:
        n = 0
        for c in re.sub("[^A-Z]", "", reference.upper()):
            n = n * 26 + ord(c) - 64
        return n - 1

    out: list[tuple] = []
    for page, name in enumerate(sheets, 1):
        rows = []
        for row in (e for e in ElementTree.fromstring(archive.read(name)).iter() if _local(e) == "row"):
            cells = {column(c.attrib.get("r", "")) if c.attrib.get("r") else i: value(c) for i, c in enumerate(e for e in row if _local(e) == "c")}
            if any(v.strip() for v in cells.values()):
                rows.append([re.sub(r"\s+", " ", cells.get(i, "")).strip() for i in range(max(cells) + 1)])
        title = titles[page - 1] if page <= len(titles) else name
        if rows:
            out.append(("heading", title, [title], None, None, None, page))
            before = len(out)
            _append_table(out, rows, [title], page - 1)
            out[before:] = [(*b, page) for b in out[before:]]
    return out


PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {"native/html": html_blocks, "native/markdown": markdown_blocks, "native/office": office_blocks, "native/sheets": sheet_blocks}


def _read(read: Callable[[bytes], list[tuple]], content: bytes) -> tuple[list[tuple], str | None]:
    """Blocks, or the fault of a file that cannot be read."""
    try:
        return read(bytes(content)), None
    except zipfile.BadZipFile:
        return [], "no_archive"
    except ElementTree.ParseError:
        return [], "no_xml"
    except KeyError:
        return [], "part_missing"
    except ValueError as fault:
        return [], str(fault)


def parse(documents: DataFrame, parser: str) -> DataFrame:
    """Blocks of ``(document_id, content)`` rows by one of ``PARSERS``; a file that cannot be read has none (see :func:`attempts`). Null contents have none."""
    read = PARSERS[parser]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame["document_id"], frame["content"]):
                for n, (kind, text, path, table, row, column, *page) in enumerate(_read(read, content)[0]):
                    mark = None if table is None else f"{key}:t{table:04d}"
                    rows.append((key, f"{key}:b{n:06d}", kind, text, n, parser, page[0] if page else 1, path, mark, row, column))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])
            yield made.astype({"row_no": "Int32", "column_no": "Int32"})

    return documents.where("content is not null").select("document_id", "content").mapInPandas(run, BLOCKS)


def attempts(documents: DataFrame, parser: str) -> DataFrame:
    """``(document_id, parser, status, fault, blocks, characters)``: a row for every document, of those that cannot be read too."""
    read = PARSERS[parser]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame["document_id"], frame["content"]):
                found, fault = _read(read, content) if content is not None else ([], "no_content")
                size = sum(len("".join(b[1].split())) for b in found if b[0] != "table_cell")
                rows.append((key, parser, "error" if fault else "empty" if not size else "parsed", fault, len(found), size))
            yield pd.DataFrame(rows, columns=["document_id", "parser", "status", "fault", "blocks", "characters"])

    return documents.select("document_id", "content").mapInPandas(run, "document_id string, parser string, status string, fault string, blocks long, characters long")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt that counts for each document: the first that passed, else the best score, else the most text."""
    order = F.struct((F.col("decision") == "pass").cast("int"), F.when(F.col("decision") == "pass", -F.col("attempt")).otherwise(F.lit(0)), "score", "characters")
    best = F.max_by(F.struct(*attempts.columns), order)
    return attempts.groupBy("document_id").agg(best.alias("b")).select("b.*")
