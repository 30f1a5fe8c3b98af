"""DOCX scan: word-processing files to block rows, with the standard library only.

A file is one row of a binary scan; body children are walked in their order.
Automatic numbers are replayed from the numbering part (start values, templates,
deeper levels reset). A rendered page break counts for its block if it comes before
the block's first visible text, else for the next. Cells that a vertical merge goes
on into have the text of the cell above; tables within cells are not read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, ord int, kind string, text string, style string, label string, template string, raw_page int, table_index int, row_index int, cells array<string>, heading_style boolean"


def _text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append(" ")
    return re.sub(r"\s+", " ", "".join(out)).strip()


class Numbers:
    """Counters of multilevel lists, by list."""

    def __init__(self, part: bytes | None):
        self.levels: dict[str, dict[int, tuple[int, str, str]]] = {}
        self.lists: dict[str, str] = {}
        self.state: dict[str, list[int | None]] = {}
        if part:
            root = ET.fromstring(part)
            for a in root.iter(f"{W}abstractNum"):
                rows = {}
                for level in a.iter(f"{W}lvl"):
                    value = lambda tag, level=level: (level.find(f"{W}{tag}").get(f"{W}val") if level.find(f"{W}{tag}") is not None else "")
                    rows[int(level.get(f"{W}ilvl"))] = int(value("start") or 1), value("numFmt"), value("lvlText")
                self.levels[a.get(f"{W}abstractNumId")] = rows
            for n in root.iter(f"{W}num"):
                self.lists[n.get(f"{W}numId")] = n.find(f"{W}abstractNumId").get(f"{W}val")

    def next(self, list_id: str, level: int) -> tuple[str, str] | None:
        """(label, template) of the next paragraph of a list at a level; only decimal levels have labels."""
        rows = self.levels.get(self.lists.get(list_id, ""), {})
        if level not in rows or rows[level][1] != "decimal":
            return None
        held = self.state.setdefault(list_id, [None] * 9)
        held[level] = rows[level][0] if held[level] is None else held[level] + 1
        held[level + 1 :] = [None] * (8 - level)
        label = rows[level][2]
        for i in range(level + 1):
            shown = held[i] if held[i] is not None else rows.get(i, (1,))[0]
            label = label.replace(f"%{i + 1}", str(shown))
        return label, rows[level][2]


class Styles:
    """Which paragraph styles are headings: by their name or outline level, or those of a style they are based on."""

    def __init__(self, part: bytes | None):
        self.rows: dict[str, tuple[str, bool, str | None]] = {}
        for style in ET.fromstring(part).iter(f"{W}style") if part else ():
            value = lambda tag, style=style: (style.find(tag).get(f"{W}val") if style.find(tag) is not None else None)
            outline = value(f"{W}pPr/{W}outlineLvl")
            self.rows[style.get(f"{W}styleId") or ""] = (value(f"{W}name") or "").lower(), outline is not None and int(outline) < 9, value(f"{W}basedOn")

    def heading(self, style: str | None) -> bool:
        met: set[str] = set()
        while style in self.rows and style not in met:
            met.add(style)
            name, outlined, base = self.rows[style]
            if outlined or "heading" in name or "title" in name:
                return True
            style = base
        return False


def _breaks(node: ET.Element) -> tuple[int, int]:
    """Rendered page breaks before a node's first visible text, and after."""
    counts, seen = [0, 0], 0
    for x in node.iter():
        if x.tag == f"{W}lastRenderedPageBreak":
            counts[seen] += 1
        elif x.tag == f"{W}t" and (x.text or "").strip():
            seen = 1
    return counts[0], counts[1]


def _cells(row: ET.Element, above: dict[int, str]) -> list[str]:
    """The texts of a row's cells, in the columns of the grid; ``above`` holds each column's last text."""
    out, column = [], 0
    for cell in row.findall(f"{W}tc"):
        span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
        if merge is not None and merge.get(f"{W}val") != "restart":
            text = above.get(column, "")
        else:
            text = re.sub(r"\s+", " ", " ".join(_text(p) for p in cell.findall(f"{W}p"))).strip()
        out.append(text)
        for _ in range(int(span.get(f"{W}val")) if span is not None else 1):
            above[column] = text
            column += 1
    return out


def unique_cells(cells: list[str]) -> list[str]:
    """Cells without empty ones and without repeats of the one before, as merged cells leave them."""
    out: list[str] = []
    for c in cells:
        if c and (not out or out[-1] != c):
            out.append(c)
    return out


def parse(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        part = lambda name: z.read(name) if name in names else None
        numbers, styles = Numbers(part("word/numbering.xml")), Styles(part("word/styles.xml"))
    page, ord_, tables = 1, 0, 0
    for node in body:
        before, after = _breaks(node)
        if node.tag == f"{W}p":
            page += before
            style = node.find(f"{W}pPr/{W}pStyle")
            style = style.get(f"{W}val") if style is not None else None
            num = node.find(f"{W}pPr/{W}numPr")
            made = None
            if num is not None and num.find(f"{W}numId") is not None:
                level = num.find(f"{W}ilvl")
                made = numbers.next(num.find(f"{W}numId").get(f"{W}val"), int(level.get(f"{W}val")) if level is not None else 0)
            text = _text(node)
            if text:
                yield path, ord_, "paragraph", text, style, made and made[0], made and made[1], page, None, None, None, styles.heading(style)
                ord_ += 1
            page += after
        elif node.tag == f"{W}tbl":
            above: dict[int, str] = {}
            for i, row in enumerate(node.findall(f"{W}tr")):
                before, after = _breaks(row)
                page += before
                cells = unique_cells(_cells(row, above))
                if cells:
                    yield path, ord_, "table_row", " | ".join(cells), None, None, None, page, tables, i, cells, False
                    ord_ += 1
                page += after
            tables += 1


def scan(files: DataFrame) -> DataFrame:
    """Block rows of (path, content) files; a file that is not a DOCX archive gives none."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(parse(path, bytes(content)))
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    rows = []
                if rows:
                    frame = pd.DataFrame(rows, columns=names)
                    for c in ("raw_page", "table_index", "row_index", "ord"):
                        frame[c] = frame[c].astype("Int32")
                    yield frame

    return files.select("path", "content").mapInPandas(run, SCHEMA)
