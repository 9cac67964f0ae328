"""The data source ``sheets``: raw cells of delimited, HTML-table and xlsx files, with the standard library only.

``spark.read.format("sheets").option("path", ...).load()`` gives ``file, sheet, row_no, cells``. A
partition has as many whole files as make ``PART_BYTES``. Options: ``path`` (a file, folder or glob pattern), ``sheet`` (a name, or a 0-based index;
default all), ``max_col`` (columns read, default all). The format follows the file's content: a zip is a
workbook, text with ``<table`` is HTML whatever its ending, all else is delimited.
"""

from __future__ import annotations

import csv
import glob
import io
import os
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row_no int, cells array<string>"
DELIMITERS = (",", "\t", ";", "|")
#: Bytes of a partition's files, each of which counts as ``OPEN_BYTES`` more than it has; so small files are read some 250 to a task.
PART_BYTES, OPEN_BYTES = 8 << 20, 32 << 10


def sniff_delimiter(text: str, chars: int = 8192) -> str:
    """The candidate that occurs most often outside quotes in the first ``chars``; of equal counts the earlier of ``, tab ; |``."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in text[:chars]:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    return max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))


def delimited_rows(data: bytes) -> list[list[str]]:
    """Rows of a delimited file: byte order mark dropped, doubled quotes, any line end, no blank rows at the end."""
    text = data.decode("utf-8-sig", errors="replace")
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text)))
    while rows and not any(x.strip() for x in rows[-1]):
        rows.pop()
    return rows


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def html_tables(data: bytes) -> list[list[list[str]]]:
    """All tables of a page as rows of stripped texts of ``th`` and ``td``; read as UTF-8 whatever it claims."""
    p = _Tables()
    p.feed(data.decode("utf-8-sig", errors="replace"))
    p.close()
    p._end_cell()
    return p.tables


def column_index(ref: str) -> int:
    """0-based column of a cell reference such as ``AB12``."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _texts(node: ElementTree.Element) -> str:
    # Phonetic guides of a string are not part of it.
    return "".join(t.text or "" for r in node.iter() if r.tag.endswith(("}si", "}is", "}r")) for t in r if t.tag.endswith("}t"))


def workbook_sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(name, rows) of every sheet in workbook order; stored values, never formulas; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if not s.tag.endswith("}sheet"):
                continue
            target = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            out.append((s.get("name", ""), _sheet_rows(z.read(part), shared)))
        return out


def _sheet_rows(data: bytes, shared: list[str]) -> list[list[str | None]]:
    rows: list[list[str | None]] = []
    for row in ElementTree.fromstring(data).iter():
        if not row.tag.endswith("}row"):
            continue
        at = int(row.get("r", len(rows) + 1)) - 1
        rows += [[] for _ in range(at + 1 - len(rows))]
        for c in row:
            if not c.tag.endswith("}c"):
                continue
            i = column_index(c.get("r", "")) if c.get("r") else len(rows[at])
            rows[at] += [None] * (i + 1 - len(rows[at]))
            v = next((x.text for x in c if x.tag.endswith("}v")), None)
            kind = c.get("t")
            if kind == "s" and v is not None:
                v = shared[int(v)]
            elif kind == "inlineStr":
                v = next((_texts(x) for x in c if x.tag.endswith("}is")), None)
            rows[at][i] = v
    return rows


def file_sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(name, rows) of every sheet of a file, whatever its format."""
    if data[:4] == b"PK\x03\x04":
        return workbook_sheets(data)
    if b"<table" in data[:1_000_000].lower():
        return [(f"table{i}", t) for i, t in enumerate(html_tables(data))]
    return [("main", delimited_rows(data))]


def best_sheet(names: list[str]) -> int:
    """The first sheet whose name speaks of players, else the first."""
    hits = [i for i, n in enumerate(names) if any(w in n.lower() for w in ("project", "skater", "forward", "player", "goalie"))]
    return hits[0] if hits else 0


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sheet, self.max_col = options.get("sheet"), int(options.get("max_col", 0)) or None
        path = options["path"]
        self.files = sorted(f for p in ([path] if not os.path.isdir(path) else [os.path.join(path, "*")]) for f in glob.glob(p) if os.path.isfile(f))
        if not self.files:
            raise FileNotFoundError(path)

    def partitions(self) -> list[InputPartition]:
        parts: list[list[str]] = []
        room = 0
        for f in self.files:
            size = os.path.getsize(f) + OPEN_BYTES
            if size > room:
                parts.append([])
                room = PART_BYTES
            parts[-1].append(f)
            room -= size
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                sheets = file_sheets(f.read())
            for i, (name, rows) in enumerate(sheets):
                if self.sheet is None or self.sheet == name or self.sheet == str(i):
                    for n, cells in enumerate(rows, 1):
                        yield path, name, n, list(cells[: self.max_col])


class SheetsDataSource(DataSource):
    """Register with ``spark.dataSource.register(SheetsDataSource)``."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
