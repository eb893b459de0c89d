"""Workbook exports (``.xlsx``) as rows of typed cells.

A workbook is a zip archive of XML parts.  Spark's ``binaryFile`` source hands
each file to one task, whatever store it lies in; the task streams the active
sheet, so that beside the compressed file only the workbook's shared strings,
one block of the sheet and one batch of rows are held (and an empty element for
each earlier row, where an XML parser reads it).  Cells keep what the workbook
says they are: text, number, boolean, error, or date (a number with a date
format, in the workbook's date system).

Plainly written sheet XML is taken apart by the block, in numpy and Arrow; its
head and tail, and from the first row of another kind on the whole sheet, go
through an XML parser, with the same cells.  Sheet XML that is broken ends the
file with an error row; files beside it are not affected.
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from posixpath import dirname, join, normpath
from xml.etree.ElementTree import ParseError, XMLPullParser, iterparse
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.session import ship_package

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROW, CELL, VALUE, INLINE, TEXT, RUN = (MAIN + tag for tag in ("row", "c", "v", "is", "t", "r"))
SHEET, SHEET_DATA = MAIN + "worksheet", MAIN + "sheetData"
BATCH_ROWS = 2000
WRITTEN_ROWS = 1 << 13      # that are written at once
BLOCK_BYTES = 1 << 20       # of a sheet that are taken apart at once (one row at least)
MOST_BYTES = 1 << 26        # of a sheet's head, or of one row, that are looked at without an XML parser
KEPT = 1 << 16              # dates and column names that a worker remembers
# Numbers of the built-in date and time formats.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
# Quoted text, escaped characters and bracketed parts of a format say nothing about dates,
# but for elapsed times such as [h].
_PLAIN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)
_ELAPSED = re.compile(r"\[(?:h+|m+|s+)\]", re.I)
_DATE_LETTER = re.compile(r"[dmyhs]", re.I)
_COLUMN = re.compile(r"([A-Z]+)")

Cell = tuple[str, str]          # kind (s text, n number, b boolean, d date, t time, e error) and text
# What a workbook that cannot be read raises.
BROKEN = (zipfile.BadZipFile, ParseError, KeyError, ValueError, IndexError, EOFError, OSError, zipfile.zlib.error)

# The tags of plain rows, each with those that may follow it: that alone says whether rows are well formed.
_AFTER = {"row": ("c", "c/", "/row"), "/row": ("row", "row/"), "row/": ("row", "row/"), "c": ("v", "is", "/c"),
          "/c": ("c", "c/", "/row"), "c/": ("c", "c/", "/row"), "v": ("/v",), "/v": ("/c",),
          "is": ("t",), "t": ("/t",), "/t": ("/is",), "/is": ("/c",)}
_TAGS = {name: i for i, name in enumerate(_AFTER)}
_FOLLOWS = np.array([b in after for after in _AFTER.values() for b in _AFTER])
# Where a run of tags may begin and end, next to a text.
_FIRST, _LAST = frozenset(["/v", "/t", "c", "c/", "row", "row/", "/row"]), frozenset(["v", "t", "/c", "c/", "row", "row/", "/row"])
_NONE, _EMPTY, _NEXT = range(3)     # a cell's text: none, of no letters, or what follows its run of tags
LONG_RUN = 4096             # letters of a run of tags that is not remembered; so many others are
_TAG = re.compile(r'<(/?[a-z]+)((?:[ \t\n]+[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?="[^"<&]*")*)[ \t\n]*(/?)>', re.A)
_CELL_ROW = re.compile(rb'(<c(?: [^<>]*)? r="[A-Z]+)[0-9]+"')
_ATTRIBUTE = re.compile(r'([^\s="]+)="([^"]*)"')
# In the order in which they are replaced.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
# How a cell's text is read: as it is (inline, and three kinds of values), or by ``Workbook._value``.
_PLAIN_FORMS = {"inlineStr": "s", "str": "s", "e": "e"}


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time (not an elapsed time)."""
    shown = _PLAIN.sub("", code.split(";")[0])
    return not _ELAPSED.search(shown) and bool(_DATE_LETTER.search(shown.replace("General", "")))


@lru_cache(KEPT)
def column_number(reference: str) -> int:
    """0 for column A, from a reference such as ``AB12``."""
    n = 0
    for c in _COLUMN.match(reference)[1]:
        n = 26 * n + ord(c) - 64
    return n - 1


def number_text(raw: str) -> str:
    """The number as Python writes it: whole numbers without a point."""
    return str(int(raw)) if re.fullmatch(r"[+-]?[0-9]+", raw) else repr(float(raw))


@lru_cache(KEPT)
def date_cell(raw: str, from_1904: bool) -> Cell:
    """A serial day number as a date and time; below 1 it is a time of day."""
    value = float(raw)
    if 0 <= value < 1:
        at = dt.datetime.min + dt.timedelta(milliseconds=round(value * 86_400_000))
        return "t", str(at.time())
    days, part = divmod(value, 1)
    # The 1900 system counts a 29 February 1900 that never was.
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30) + dt.timedelta(days=0 < value < 60)
    try:
        return "d", str(start + dt.timedelta(days=days, milliseconds=round(part * 86_400_000)))
    except OverflowError:
        return "e", "#VALUE!"


@lru_cache(KEPT)
def plain_tag(tag: str) -> tuple[str, dict[str, str]]:
    """Which of the plain tags it is, and its attributes."""
    found = _TAG.fullmatch(tag)
    if not found or (name := found[1] + found[3]) not in _TAGS:
        raise ValueError("no plain tag")
    pairs = _ATTRIBUTE.findall(found[2])
    own = dict(pairs)
    if len(own) < len(pairs) or own and name[0] == "/" or any(k.split(":")[0] == "xmlns" for k in own):
        raise ValueError("no plain tag")
    return name, own


@dataclass(frozen=True)
class Run:
    """Tags that follow each other without a text between them."""
    first: str
    last: str
    cells: list[tuple[str, str, int, int]]      # those that begin here: type, style, column (-1: the next), text
    rows: list[tuple[int, str | None]]          # likewise: how many of the cells come before, number
    prefixes: set[str]                          # of attributes


@lru_cache(LONG_RUN)
def plain_run(run: str) -> Run:
    """The run that a text of tags is."""
    tags = [plain_tag(f"<{t}>") for t in run[1:-1].split("><")]
    names = [name for name, _ in tags]
    if (names[0] not in _FIRST or names[-1] not in _LAST or any(b not in _AFTER[a] for a, b in itertools.pairwise(names))):
        raise ValueError("no plain tags")
    cells, rows = [], []
    for i, (name, own) in enumerate(tags):
        if name in ("row", "row/"):
            rows.append((len(cells), own.get("r")))
        elif name in ("c", "c/"):
            reference = own.get("r")
            cells.append((own.get("t", "n"), own.get("s", "0"),
                          column_number(reference.rstrip("0123456789")) if reference else -1, _NONE))
        elif name in ("v", "t") and (name == "t") == (cells[-1][0] == "inlineStr"):
            # An empty value is none, an empty text is one.
            cells[-1] = (*cells[-1][:3], _NEXT if i == len(tags) - 1 else _EMPTY if name == "t" else _NONE)
    return Run(names[0], names[-1], cells, rows, {k.split(":")[0] for _, own in tags for k in own if ":" in k})


class Workbook:
    """The active sheet of a workbook."""

    def __init__(self, data: bytes) -> None:
        self.parts = zipfile.ZipFile(io.BytesIO(data))
        self.book = self._target_of("", "/officeDocument") or "xl/workbook.xml"
        self.sheet, self.from_1904 = self._active_sheet()
        self.dates = self._date_styles()
        self.strings = self._shared_strings()

    def _links(self, part: str) -> dict[str, tuple[str, str]]:
        """Links of a part: id -> (type, target part)."""
        folder, name = part.rpartition("/")[::2]
        links = f"{folder}/_rels/{name}.rels" if part else "_rels/.rels"
        out = {}
        if links.lstrip("/") in self.parts.namelist():
            with self.parts.open(links.lstrip("/")) as f:
                for _, e in iterparse(f):
                    if e.tag.endswith("}Relationship"):
                        target = e.get("Target", "")
                        target = target[1:] if target.startswith("/") else normpath(join(dirname(part), target))
                        out[e.get("Id", "")] = (e.get("Type", ""), target)
        return out

    def _target_of(self, part: str, kind: str) -> str | None:
        return next((t for k, t in self._links(part).values() if k.endswith(kind)), None)

    def _active_sheet(self) -> tuple[str, bool]:
        links, sheets, active, from_1904 = self._links(self.book), [], 0, False
        with self.parts.open(self.book) as f:
            for _, e in iterparse(f):
                if e.tag == MAIN + "sheet":
                    sheets.append(links.get(e.get(LINK, ""), ("", ""))[1])
                elif e.tag == MAIN + "workbookView":
                    active = int(e.get("activeTab", "0"))
                elif e.tag == MAIN + "workbookPr":
                    from_1904 = e.get("date1904", "0") in ("1", "true")
        if not sheets:
            raise ValueError("workbook without a sheet")
        return sheets[active if active < len(sheets) else 0], from_1904

    def _date_styles(self) -> frozenset[int]:
        """Numbers of the cell styles whose format is a date."""
        part = self._target_of(self.book, "/styles")
        if not part or part not in self.parts.namelist():
            return frozenset()
        codes, dates, cell_styles, at = {}, set(), False, 0
        with self.parts.open(part) as f:
            for event, e in iterparse(f, ("start", "end")):
                if e.tag == MAIN + "cellXfs":
                    cell_styles = event == "start"
                elif event == "end" and e.tag == MAIN + "numFmt":
                    codes[int(e.get("numFmtId"))] = e.get("formatCode", "")
                elif event == "end" and e.tag == MAIN + "xf" and cell_styles:
                    number = int(e.get("numFmtId", "0"))
                    if is_date_format(codes[number]) if number in codes else number in DATE_FORMATS:
                        dates.add(at)
                    at += 1
        return frozenset(dates)

    def _shared_strings(self) -> list[str]:
        part = self._target_of(self.book, "/sharedStrings")
        if not part or part not in self.parts.namelist():
            return []
        out = []
        with self.parts.open(part) as f:
            for _, e in iterparse(f):
                if e.tag == MAIN + "si":
                    out.append(self._text(e))
                    e.clear()
        return out

    @staticmethod
    def _text(e) -> str:
        """The text of a string item: its runs, without phonetic hints."""
        if len(e) == 1 and e[0].tag == TEXT:
            return e[0].text or ""
        own = [t.text or "" for t in e.findall(TEXT)]
        return "".join(own + [t.text or "" for r in e.findall(RUN) for t in r.findall(TEXT)])

    def _cell(self, e) -> Cell | None:
        kind = e.get("t", "n")
        if kind == "inlineStr":
            inline = e.find(INLINE)
            return None if inline is None else ("s", self._text(inline))
        value = e.find(VALUE)
        if value is None or value.text is None:
            return None
        return self._value(kind, e.get("s", "0"), value.text)

    def _value(self, kind: str, style: str, raw: str) -> Cell:
        """The cell of a stored value, by the cell's type and style."""
        if kind == "s":
            return "s", self.strings[int(raw)]
        if kind == "b":
            return "b", str(raw.strip() in ("1", "true"))
        if kind == "d":
            return "d", str(dt.datetime.fromisoformat(raw))
        if kind == "e":
            return "e", raw
        if kind == "str":
            return "s", raw
        if int(style) in self.dates:
            return date_cell(raw, self.from_1904)
        return "n", number_text(raw.strip())

    def rows(self) -> Iterator[tuple[int, list[Cell | None]]]:
        """Row number (from 1) and cells of every row that the sheet stores."""
        row_number = 0
        with self.parts.open(self.sheet) as f:
            for _, e in iterparse(f):
                if e.tag == ROW:
                    row_number = int(e.get("r", row_number + 1))
                    yield row_number, self._cells(e)
                    e.clear()

    def _cells(self, row) -> list[Cell | None]:
        at, cells = -1, []
        for e in row.iter(CELL):
            reference = e.get("r")
            at = column_number(reference.rstrip("0123456789")) if reference else at + 1
            cell = self._cell(e) if len(e) else None
            if at == len(cells):
                cells.append(cell)
            else:
                cells += [None] * (at - len(cells))
                cells[at:] = [cell]
        return cells

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The ``rows`` as ``row, cells`` in batches of ``BATCH_ROWS``."""
        done = 0
        try:
            for batch in self._plain_batches():
                yield batch
                done += len(batch)
            return
        except BROKEN:
            pass            # not plain, or broken: the parser tells
        for rows in itertools.batched(itertools.islice(self.rows(), done, None), BATCH_ROWS):
            flat = [c for _, row in rows for c in row]
            ends = list(itertools.accumulate((len(row) for _, row in rows), initial=0))
            kinds, texts = (pa.array([c and c[i] for c in flat], pa.string()) for i in range(2))
            yield _batch([r for r, _ in rows], ends, kinds, texts)

    def _plain_batches(self) -> Iterator[pa.RecordBatch]:
        """The ``batches`` of a plainly written sheet; a ``BROKEN`` error before
        the first batch that has another row."""
        ready, number = [], 0
        for block in self._blocks():
            ready.append(self._plain_rows(block, number))
            number = ready[-1].column(0)[-1].as_py()
            if sum(map(len, ready)) >= BATCH_ROWS:
                whole = pa.concat_batches(ready)
                full = len(whole) - len(whole) % BATCH_ROWS
                for i in range(0, full, BATCH_ROWS):
                    yield whole.slice(i, BATCH_ROWS)
                ready = [whole.slice(full)]
        if sum(map(len, ready)):
            yield pa.concat_batches(ready)

    def _blocks(self) -> Iterator[bytes]:
        """Whole rows of the active sheet, as they are written; what stands before
        and after them has gone through an XML parser."""
        parser = XMLPullParser(("start", "start-ns"))
        with self.parts.open(self.sheet) as f:
            held = b""
            while (at := held.find(b"<sheetData>")) < 0:
                if len(held) > MOST_BYTES or not (more := f.read(BLOCK_BYTES)):
                    raise ValueError("no plain sheet data")
                held += more
            at += len(b"<sheetData>")
            head, held = held[:at], held[at:]
            declared = re.match(rb"(?:\xef\xbb\xbf)?<\?xml [^>]*?encoding=[\"']([^\"']*)", head)
            if b"<!" in head or declared and declared[1].lower() != b"utf-8":
                raise ValueError("no plain head")
            parser.feed(head)
            events = list(parser.read_events())
            opened = [e.tag for event, e in events if event == "start"]
            if opened[0] != SHEET or opened[-1] != SHEET_DATA or ROW in opened:
                raise ValueError("no plain head")
            # Prefixes of the sheet's own tag hold for all rows.
            self._prefixes = frozenset(["xml"]).union(
                e[0] for event, e in itertools.takewhile(lambda x: x[0] == "start-ns", events))
            while (end := held.find(b"</sheetData>")) < 0:
                cut = held.rfind(b"</row>") + 6
                if cut > 6:
                    yield held[:cut]
                    held = held[cut:]
                if len(held) > MOST_BYTES or not (more := f.read(BLOCK_BYTES)):
                    raise ValueError("no plain rows")
                held += more
            if b"<" in held[:end]:
                yield held[:end]
            elif held[:end].strip(b" \t\n\r"):
                raise ValueError("text beside rows")
            parser.feed(held[end:])
            while more := f.read(BLOCK_BYTES):
                parser.feed(more)
            parser.close()
            if any(event == "start" and e.tag == ROW for event, e in parser.read_events()):
                raise ValueError("rows beside the sheet data")

    def _plain_rows(self, block: bytes, before: int) -> pa.RecordBatch:
        """The rows of a block, each run of tags and each text of which is one
        piece of it; ``before`` is the number of the row before them."""
        if b"\r" in block:
            block = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        block = block.strip(b" \t\n")
        if b' r="' in block[:LONG_RUN]:
            block = _CELL_ROW.sub(rb'\1"', block)        # the column is enough, and makes fewer runs
        data = np.frombuffer(block, np.uint8)
        control = data < 32
        if control.any() and np.isin(data[control], (9, 10), invert=True).any():
            raise ValueError("no text")
        if not block.isascii() and (b"\xef\xbf\xbe" in block or b"\xef\xbf\xbf" in block or not block.decode()):
            raise ValueError("no text")
        opens, closes = data == ord("<"), data == ord(">")
        turns = np.flatnonzero(closes[:-1] ^ opens[1:]) + 1         # ends of runs and of the texts behind them
        if not (opens[0] and closes[-1] and closes[turns[::2] - 1].all() and opens[turns[1::2]].all()) or len(turns) % 2:
            raise ValueError("no plain tags")
        # Runs at even places, texts at odd ones, the last one empty.
        n = len(turns) // 2
        edges = np.empty(2 * n + 3, np.int32)
        edges[0], edges[1:-2], edges[-2:] = 0, turns, len(block)
        pieces = pa.Array.from_buffers(pa.string(), 2 * n + 2, [None, pa.py_buffer(edges), pa.py_buffer(block)])
        runs = pieces.take(pa.array(np.arange(0, 2 * n + 1, 2, np.int32))).dictionary_encode()
        which = runs.indices.to_numpy()
        known = [(plain_run if len(run) < LONG_RUN else plain_run.__wrapped__)(run) for run in _listed(runs.dictionary)]
        first, last = (np.array([_TAGS[name] for name in names])[which] for names in zip(*((k.first, k.last) for k in known)))
        if (not _FOLLOWS[last[:-1] * len(_TAGS) + first[1:]].all() or known[which[0]].first not in ("row", "row/")
                or known[which[-1]].last not in ("/row", "row/") or not set().union(*(k.prefixes for k in known)) <= self._prefixes):
            raise ValueError("no plain rows")

        # All runs' cells, out of those of each known run.
        sizes = np.array([len(k.cells) for k in known])
        count = sizes[which]
        starts = np.cumsum(count) - count
        run = np.repeat(np.arange(n + 1, dtype=np.int32), count)
        like = np.repeat((np.cumsum(sizes) - sizes)[which] - starts, count) + np.arange(len(run))
        forms: dict[tuple[str, str], int] = {}
        some = np.array([(forms.setdefault(cell[:2], len(forms)), *cell[2:]) for k in known for cell in k.cells], np.int32).reshape(-1, 3)
        form, columns, filled = (some[:, i].take(like) for i in range(3))
        there = filled != _NONE
        text = pieces.take(pa.array(np.where(filled == _NEXT, 2 * run + 1, 2 * n + 1).astype(np.int32), mask=~there))
        if b"&" in block:
            used = [e for e in _ENTITIES if e.encode() in block]
            if sum(block.count(e.encode()) for e in used) < block.count(b"&"):
                raise ValueError("no plain text")
            for e in used:
                text = pc.replace_substring(text, e, _ENTITIES[e])
        kind = pa.array([_PLAIN_FORMS.get(k) for k, _ in forms], pa.string()).take(pa.array(form, mask=~there))
        for (k, style), i in forms.items():
            of = there & (form == i)
            if k not in _PLAIN_FORMS and of.any():
                raw = text.filter(pa.array(of)).dictionary_encode()
                made = [self._value(k, style, x) for x in _listed(raw.dictionary)]
                kind, text = (pc.replace_with_mask(old, pa.array(of), pa.array([c[j] for c in made], pa.string()).take(raw.indices))
                              for j, old in enumerate((kind, text)))

        # Their places: in turn, or as their references say.
        numbers, ends = [], []
        for i in np.flatnonzero(np.array([len(k.rows) for k in known])[which]):
            for at, number in known[which[i]].rows:
                before = before + 1 if number is None else int(number)
                numbers.append(before)
                ends.append(starts[i] + at)
        ends = np.array([*ends, len(run)])
        if (columns >= 0).any():
            row = np.repeat(np.arange(len(numbers)), np.diff(ends))
            if (columns < 0).any() or ((np.diff(columns) <= 0) & (np.diff(row) == 0)).any():
                raise ValueError("no plain references")
            wide = np.zeros(len(numbers), np.int64)
            np.maximum.at(wide, row, columns + 1)
            ends = np.append(0, np.cumsum(wide))
            if ends[-1] > 16 * len(run) + BLOCK_BYTES:
                raise ValueError("far between")
            place = np.full(ends[-1], -1)
            place[ends[row] + columns] = np.arange(len(run))
            place = pa.array(place, mask=place < 0)
            kind, text = kind.take(place), text.take(place)
        return _batch(numbers, ends, kind, text)


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()        # much faster than to_pylist


def _batch(numbers: list[int], starts, kinds: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows ``row, cells``, the cells' kinds and texts given one after another."""
    cells = pa.StructArray.from_arrays([kinds, texts], fields=list(_CELL), mask=kinds.is_null())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), cells)],
                                      ["row", "cells"])


_CELL = pa.struct([("kind", pa.string()), ("text", pa.string())])
_SCHEMA = "_file string, row int, cells array<struct<kind:string,text:string>>, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(path: str, rows: pa.RecordBatch, error: str | None = None) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.repeat(path, n), *rows.columns, pa.array([error] * n, pa.string())],
                                          ["_file", "row", "cells", "error"])

    for batch in batches:
        for i in range(len(batch)):
            path = batch.column(0)[i].as_py()
            try:
                for rows in Workbook(batch.column(1)[i].as_py()).batches():
                    yield out(path, rows)
            except BROKEN as e:
                none = pa.array([], pa.string())
                yield out(path, _batch([-1], [0, 0], none, none), f"{type(e).__name__}: {e}"[:200])


def cells_of(files: DataFrame) -> DataFrame:
    """``_file, row, cells, error`` of workbooks (``path, content``): the rows
    that their active sheets store, by number from 1, with their cells (kind and
    text; null where there is none).  A workbook that cannot be read ends with a
    row -1 and its error."""
    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(_read, _SCHEMA)


def read_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The cells of the workbooks at ``paths``, see ``cells_of``."""
    return cells_of(spark.read.format("binaryFile").load(paths))


# ------------------------------------------------------------------ writing
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
# The parts that every workbook has beside its sheet.  Style 1 is a date and time.
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/'
    'vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/>'
    f'<Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument"'
    ' Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_SHEET_NS}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1"'
    ' r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" '
    f'Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" '
    'Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_SHEET_NS}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2">'
    '<xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'}
_TEXT_CELL = '<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"
_ISO = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?")
_MARKUP_ENTITIES = {"&": "&amp;", ">": "&gt;", "<": "&lt;"}          # the first one first
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_NOT_XML_RE2 = r"[^\t\n\r\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]"


def _written(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, dt.date):
        at = value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
        return f'<c s="1"><v>{(at - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)!r}</v></c>'
    return escape(_NOT_XML.sub("", value)).join(_TEXT_CELL)


@lru_cache(KEPT)
def _written_date(value: str) -> str:
    """A text of the length of a date, or of a date and time, as a date cell if
    it is one."""
    try:
        return _written(dt.datetime.fromisoformat(value) if _ISO.fullmatch(value) else value)
    except ValueError:
        return _written(value)


def _written_column(values: list) -> list[str]:
    """The cells of a column; ISO texts become dates, and NaN is none."""
    return [_written_date(v) if isinstance(v, str) else _written(None if v != v else v) for v in values]


def _stored(texts: pa.Array) -> memoryview:
    """The bytes of an Arrow column's texts, one after another."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2] or b"")[ends[0]:ends[-1]]


def _written_array(column: pa.Array) -> pa.Array:
    """``_written_column`` of an Arrow column."""
    if not pa.types.is_string(column.type):
        return pa.array(_written_column(column.to_pandas().astype(object).tolist()), pa.string())
    text, whole = column, bytes(_stored(column)).decode()
    if not whole.isprintable() or any(mark in whole for mark in _MARKUP_ENTITIES):
        text = pc.replace_substring_regex(text, _NOT_XML_RE2, "")
        for mark, entity in _MARKUP_ENTITIES.items():
            text = pc.replace_substring(text, mark, entity)
    before, after = _TEXT_CELL
    cells, size = pc.binary_join_element_wise(before, text, after, ""), pc.binary_length(column)
    dated = pc.fill_null(pc.or_(pc.equal(size, 10), pc.equal(size, 19)), False).to_numpy(zero_copy_only=False).nonzero()[0]
    dated = dated[pc.match_substring_regex(column.take(dated), f"^{_ISO.pattern}$").to_numpy(zero_copy_only=False)]
    if len(dated):
        own = column.take(dated).dictionary_encode()
        made = pa.array([_written_date(v) for v in _listed(own.dictionary)], pa.string())
        mask = np.zeros(len(column), bool)
        mask[dated] = True
        cells = pc.replace_with_mask(cells, pa.array(mask), made.take(own.indices))
    return pc.fill_null(cells, _written(None))


def workbook_bytes(rows: Iterable[Iterable]) -> bytes:
    """A workbook of one sheet with the given rows of text, numbers, booleans,
    dates (from March 1900 on) and None."""
    return _zipped(map(_written, row) for row in rows)


def _zipped(rows: Iterable[Iterable[str]]) -> bytes:
    """A workbook of rows of written cells."""
    return _zipped_parts("".join([f"<row>{''.join(row)}</row>" for row in part]).encode()
                         for part in itertools.batched(rows, BATCH_ROWS))


def _zipped_parts(rows: Iterable) -> bytes:
    """A workbook of written rows, some in each part (bytes or a buffer)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, body in _PARTS.items():
            z.writestr(name, _HEAD + body)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{_HEAD}<worksheet xmlns="{_SHEET_NS}"><sheetData>'.encode())
            for part in rows:
                f.write(part)
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _written_rows(headers: tuple[str, ...], rows: Iterable[pa.RecordBatch]) -> Iterator:
    """The header row and the rows of Arrow batches as a sheet stores them."""
    yield f"<row>{''.join(map(_written, headers))}</row>".encode()
    for batch in rows:
        for i in range(0, len(batch), WRITTEN_ROWS):
            cells = [_written_array(column) for column in batch.slice(i, WRITTEN_ROWS).columns]
            yield _stored(pc.binary_join_element_wise("<row>", *cells, "</row>", ""))


def workbooks(rows: DataFrame, headers: tuple[str, ...], parts: Column | int, name: str) -> DataFrame:
    """``path, content``: the rows as workbooks with a header row, one for each
    value of ``parts`` (all of whose rows one task holds).  Where ``parts`` is a
    number, one for each so many rows that follow each other in a partition;
    these stay where they are.  A text that is an ISO date or date and time
    becomes a date cell."""
    def write(key: tuple, part: pa.Table) -> pa.Table:
        data = _zipped_parts(_written_rows(headers, part.drop_columns("_part").to_batches()))
        return pa.table({"path": [f"{name}-{key[0].as_py()}.xlsx"], "content": pa.array([data], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def book() -> pa.RecordBatch:
            path, data = f"{name}-{TaskContext.get().partitionId()}-{number}.xlsx", _zipped_parts(_written_rows(headers, held))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], ["path", "content"])

        held, number = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, parts - sum(map(len, held))))
                batch = batch.slice(len(held[-1]))
                if sum(map(len, held)) == parts:
                    yield book()
                    held, number = [], number + 1
        if held:
            yield book()

    ship_package(rows.sparkSession)
    if not isinstance(parts, int):
        rows = rows.withColumn("_part", parts.cast("string"))
    # Cells show a time stamp as the session's clock does.
    rows = rows.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c, t in rows.dtypes if t == "timestamp"})
    if isinstance(parts, int):
        return rows.mapInArrow(cut, "path string, content binary")
    return rows.groupBy("_part").applyInArrow(write, "path string, content binary")
