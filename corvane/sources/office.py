"""Word and sheet files as elements: their parts are XML in a zip, read without a library for either.

An element is (seq, type, level, text): titles and paragraphs and table rows of a document in their order, a title and the rows of each sheet. Cells of a
row stand between bars; a sheet's first row is its header.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.storage import light_batches

# Name spaces of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

ELEMENT = "seq int, type string, level int, text string"
Element = tuple[int, str, int | None, str]


def bars(cells: list[str]) -> str:
    return " | ".join(c for c in cells if c)


def _said(e: ElementTree.Element) -> str:
    """Text of a paragraph or cell; tabs and breaks are white space."""
    parts = {f"{WORD}t": lambda x: x.text or "", f"{WORD}tab": lambda x: "\t", f"{WORD}br": lambda x: "\n"}
    return "".join(parts[x.tag](x) for x in e.iter() if x.tag in parts).strip()


def docx_elements(raw: bytes) -> list[Element]:
    """Paragraphs, titles (by style Title or Heading n) and table rows, in the order of the body."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{WORD}body")
    out: list[tuple[str, int | None, str]] = []
    for part in body if body is not None else ():
        if part.tag == f"{WORD}p":
            style = part.find(f"{WORD}pPr/{WORD}pStyle")
            named = re.fullmatch(r"(?i)(?:title|heading\s*([1-9]))", (style.get(f"{WORD}val") or "") if style is not None else "")
            out.append(("title" if named else "paragraph", int(named[1] or 1) if named else None, _said(part)))
        elif part.tag == f"{WORD}tbl":
            out += [("table_row", None, bars([_said(c) for c in row.findall(f"{WORD}tc")])) for row in part.findall(f"{WORD}tr")]
    return [(i, *x) for i, x in enumerate(x for x in out if x[2])]


def _column(reference: str) -> int:
    """A1 -> 0, AB7 -> 27."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of each sheet in the order of the book; gaps between cells are empty strings."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = set(book.namelist())
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{SHEET}t"))
    shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/{targets[sheet.get(f'{REL}id')]}")).iter(f"{SHEET}row"):
            cells: list[str] = []
            for cell in row.findall(f"{SHEET}c"):
                value, kind, at = cell.findtext(f"{SHEET}v") or "", cell.get("t"), _column(cell.get("r") or "")
                said = shared[int(value)] if kind == "s" else text(cell) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
                cells += [""] * (max(at, len(cells)) - len(cells))
                cells.append(said.strip())
            rows.append(cells)
        out.append((sheet.get("name") or "", rows))
    return out


def xlsx_elements(raw: bytes) -> list[Element]:
    out: list[tuple[str, int | None, str]] = []
    for name, rows in sheets(raw):
        out.append(("title", 1, f"Sheet: {name}"))
        out += [("table_row", None, said) for said in map(bars, rows) if said]
    return [(i, *x) for i, x in enumerate(out)]


def sheet_text(raw: bytes) -> str:
    """All sheets as text, each under its name; raises where no cell can be read."""
    parts = [f"# {text}" if kind == "title" else text for _, kind, _, text in xlsx_elements(raw)]
    if all(p.startswith("# Sheet: ") for p in parts):
        raise ValueError("no readable cells extracted")
    return "\n".join(parts)


#: Files whose elements are held at once.
FILES = 32
READERS = {"docx": docx_elements, "xlsx": xlsx_elements}


def elements(files: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col, seq, type, level, text, error of files (id_col, ext, content). A file that can't be read is one row with an error."""
    kind = files.schema[id_col].dataType.simpleString()
    light_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, FILES) for b in batches for start in range(0, b.num_rows, FILES)):
            at, rows = [], []
            for i, (ext, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    found = [(*x, None) for x in READERS[ext](raw)]
                except Exception as e:  # one file's fault is its own
                    found = [(None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                at += [i] * len(found)
                rows += found
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, "seq", "type", "level", "text", "error"])

    return files.select(id_col, "ext", "content").mapInArrow(run, f"{id_col} {kind}, {ELEMENT}, error string")
