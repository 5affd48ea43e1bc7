"""Cell grids of workbooks: xlsx and ods archives, and xls records in a compound file.

A sheet is its used area, from the first used row and column on, up to ``ROWS`` and ``COLUMNS``. Whole numbers
have no decimal point, others no exponent; truth values are words. Empty cells at the end of a row and empty
rows go.
"""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from decimal import Decimal

#: The part of a sheet that is read, and the names of error cells by their code.
ROWS, COLUMNS = 500, 26
ERRORS = {0x00: "Null", 0x07: "Div0", 0x0F: "Value", 0x17: "Ref", 0x1D: "Name", 0x24: "Num", 0x2A: "NA"}
Cells = dict[tuple[int, int], str]


class SheetError(ValueError):
    """Why a workbook cannot be read."""


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else format(Decimal(repr(x)), "f")


def grid(title: str, cells: Cells) -> str:
    """A heading and a line for each row with something in it."""
    out = [f"\n## Sheet: {title}\n"]
    used = [k for k, v in cells.items() if v]
    if used:
        top, left = min(r for r, _ in used), min(c for _, c in used)
        rows: dict[int, list[str]] = {}
        for (r, c), v in cells.items():
            if v and r - top < ROWS and c - left < COLUMNS:
                row = rows.setdefault(r, [])
                row += [""] * (c - left + 1 - len(row))
                row[c - left] = v
        out += [f"| {' | '.join(rows[r])} |\n" for r in sorted(rows)]
    return "".join(out)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(x: ET.Element, name: str, other: str = "") -> str:
    return next((v for k, v in x.attrib.items() if _local(k) == name), other)


def _archive(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise SheetError(f"not a valid archive: {e}") from None


def _text(x: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in x.iter() if _local(t.tag) == tag)


def _xlsx_cell(cell: ET.Element, shared: list[str]) -> str:
    kind, value = cell.get("t", "n"), next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
    if kind == "s":
        return shared[int(value)]
    if kind == "inlineStr":
        return _text(cell, "t")
    if kind == "b":
        return "true" if value == "1" else "false"
    return number(float(value)) if kind == "n" and value else value


def xlsx(raw: bytes) -> tuple[str, int]:
    with _archive(raw) as z:
        names = z.namelist()
        if "xl/workbook.xml" not in names:
            raise SheetError("no workbook")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(si, "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        titles = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        out = []
        for i, title in enumerate(titles, 1):
            if f"xl/worksheets/sheet{i}.xml" not in names:
                out.append(f"\n## Sheet: {title}\n(sheet unreadable)\n")
                continue
            cells: Cells = {}
            for at, row in enumerate(x for x in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter() if _local(x.tag) == "row"):
                r = int(row.get("r", at + 1)) - 1
                for k, cell in enumerate(x for x in row if _local(x.tag) == "c"):
                    letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                    c = k
                    if letters:
                        c = 0
                        for ch in letters:
                            c = c * 26 + ord(ch) - 64
                        c -= 1
                    cells[r, c] = _xlsx_cell(cell, shared)
            out.append(grid(title, cells))
    return "".join(out), max(1, len(titles))


def _ods_cell(cell: ET.Element) -> str:
    kind = _attribute(cell, "value-type")
    if kind in ("float", "percentage", "currency"):
        return number(float(_attribute(cell, "value", "0")))
    if kind == "boolean":
        return _attribute(cell, "boolean-value")
    if kind in ("date", "time"):
        return _attribute(cell, f"{kind}-value")
    return "\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p")


def ods(raw: bytes) -> tuple[str, int]:
    """Repeated cells and rows stand for as many; empty ones only move on."""
    with _archive(raw) as z:
        if "content.xml" not in z.namelist():
            raise SheetError("no content.xml")
        tables = [x for x in ET.fromstring(z.read("content.xml")).iter() if _local(x.tag) == "table"]
    if not tables:
        raise SheetError("no sheets")
    out = []
    for table in tables:
        cells: Cells = {}
        top, r = None, 0
        for row in (x for x in table.iter() if _local(x.tag) == "table-row"):
            c, own = 0, {}
            for cell in (x for x in row if _local(x.tag) in ("table-cell", "covered-table-cell")):
                times, value = int(_attribute(cell, "number-columns-repeated", "1")), _ods_cell(cell)
                if value:  # what lies beyond the last column that can be read may be left out
                    own |= {c + k: value for k in range(min(times, 2 * COLUMNS + 1))}
                c += times
            times = int(_attribute(row, "number-rows-repeated", "1"))
            if own:
                top = r if top is None else top
                for k in range(min(times, max(0, top + ROWS - r))):
                    cells |= {(r + k, c): v for c, v in own.items()}
            r += times
        out.append(grid(_attribute(table, "name"), cells))
    return "".join(out), len(tables)


class Compound:
    """Streams of a compound file: chains of sectors by its allocation tables."""

    FREE = 0xFFFFFFFA

    def __init__(self, raw: bytes) -> None:
        if not raw.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") or len(raw) < 512:
            raise SheetError("not a compound file")
        self.raw, self.sector = raw, 1 << struct.unpack_from("<H", raw, 30)[0]
        n_tables, directory = struct.unpack_from("<I", raw, 44)[0], struct.unpack_from("<I", raw, 48)[0]
        small_first, more, n_more = struct.unpack_from("<I", raw, 60)[0], *struct.unpack_from("<II", raw, 68)
        places = list(struct.unpack_from("<109I", raw, 76))
        for _ in range(n_more):  # further places of the table stand in sectors of their own
            block = self._numbers(more)
            places, more = places + block[:-1], block[-1]
        self.table = [k for p in places[:n_tables] if p < self.FREE for k in self._numbers(p)]
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            size = struct.unpack_from("<H", entries, at + 64)[0]
            name = entries[at : at + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
            kind, first, length = entries[at + 66], struct.unpack_from("<I", entries, at + 116)[0], struct.unpack_from("<I", entries, at + 120)[0]
            self.entries.setdefault("" if kind == 5 else name, (first, length))
        first, length = self.entries.get("", (self.FREE, 0))
        self.small = self._chain(first)[:length] if length else b""
        self.small_table = list(struct.unpack(f"<{len(x) // 4}I", x)) if (x := self._chain(small_first)) else []

    def _at(self, k: int) -> bytes:
        return self.raw[(k + 1) * self.sector : (k + 2) * self.sector]

    def _numbers(self, k: int) -> list[int]:
        data = self._at(k)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def _chain(self, k: int) -> bytes:
        out, seen = [], 0
        while k < self.FREE and seen <= len(self.table):
            out.append(self._at(k))
            k, seen = self.table[k] if k < len(self.table) else self.FREE, seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        k, length = self.entries[name]
        if length >= 4096:
            return self._chain(k)[:length]
        out, seen = [], 0
        while k < self.FREE and seen <= len(self.small_table):
            out.append(self.small[k * 64 : k * 64 + 64])
            k, seen = self.small_table[k] if k < len(self.small_table) else self.FREE, seen + 1
        return b"".join(out)[:length]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, list[int]]]:
    """(kind, body, where continuations start in it) of workbook records."""
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body, at, joints = data[at + 4 : at + 4 + size], at + 4 + size, []
        while at + 4 <= len(data) and struct.unpack_from("<H", data, at)[0] == 0x3C:
            size = struct.unpack_from("<H", data, at + 2)[0]
            joints.append(len(body))
            body, at = body + data[at + 4 : at + 4 + size], at + 4 + size
        yield kind, body, joints


def _string(body: bytes, at: int, joints: list[int], wide: int = 2) -> tuple[str, int]:
    """A string with its length in ``wide`` bytes; after a joint, a flag says anew how characters are stored."""
    left = int.from_bytes(body[at : at + wide], "little")
    flags, at = body[at + wide], at + wide + 1
    runs, extra = 0, 0
    if flags & 8:
        runs, at = struct.unpack_from("<H", body, at)[0], at + 2
    if flags & 4:
        extra, at = struct.unpack_from("<I", body, at)[0], at + 4
    out = []
    while left:
        joint = next((j for j in joints if j >= at), len(body))
        if joint == at and at < len(body):
            flags, at = body[at], at + 1
            joint = next((j for j in joints if j > at), len(body))
        each = 2 if flags & 1 else 1
        n = min(left, (joint - at) // each)
        if n <= 0:
            break
        out.append(body[at : at + n * each].decode("utf-16-le" if each == 2 else "latin-1", "replace"))
        at, left = at + n * each, left - n
    return "".join(out), at + 4 * runs + extra


def _packed(k: int) -> float:
    """A number in 30 bits: whole or the head of a double, perhaps times a hundred."""
    x = float(k >> 2) if k & 2 else struct.unpack("<d", struct.pack("<Q", (k & 0xFFFFFFFC) << 32))[0]
    if k & 2 and k & 0x80000000:
        x -= float(1 << 30)
    return x / 100 if k & 1 else x


def _cells(data: bytes, at: int, shared: list[str]) -> Cells:
    cells: Cells = {}
    waiting = None
    for kind, body, joints in records(data, at):
        if kind == 0x0A:
            break
        if kind == 0x207 and waiting:
            cells[waiting] = _string(body, 0, joints)[0]
        if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x205, 0x06) or len(body) < 6:
            continue
        r, c = struct.unpack_from("<HH", body)
        if kind == 0xFD:
            cells[r, c] = shared[struct.unpack_from("<I", body, 6)[0]]
        elif kind == 0x203:
            cells[r, c] = number(struct.unpack_from("<d", body, 6)[0])
        elif kind == 0x27E:
            cells[r, c] = number(_packed(struct.unpack_from("<I", body, 6)[0]))
        elif kind == 0xBD:
            cells |= {(r, c + i): number(_packed(struct.unpack_from("<I", body, 6 + 6 * i)[0])) for i in range((len(body) - 6) // 6)}
        elif kind == 0x204:
            cells[r, c] = _string(body, 6, joints)[0]
        elif kind == 0x205:
            cells[r, c] = ERRORS.get(body[6], "") if body[7] else "true" if body[6] else "false"
        else:  # a formula's last value; a string follows in a record of its own
            waiting = None
            if body[12:14] != b"\xff\xff":
                cells[r, c] = number(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waiting = (r, c)
            elif body[6] in (1, 2):
                cells[r, c] = ERRORS.get(body[8], "") if body[6] == 2 else "true" if body[8] else "false"
    return cells


def xls(raw: bytes) -> tuple[str, int]:
    file = Compound(raw)
    data = file.stream("Workbook")
    if data is None:
        raise SheetError("no workbook stream" if file.stream("Book") is None else "workbooks before BIFF8 are not read")
    sheets, shared = [], []
    for kind, body, joints in records(data):
        if kind == 0x0A:
            break
        if kind == 0x2F:
            raise SheetError("workbook is encrypted")
        if kind == 0x85 and body[5] == 0:
            sheets.append((struct.unpack_from("<I", body)[0], _string(body, 6, joints, 1)[0]))
        elif kind == 0xFC:
            at = 8
            for _ in range(struct.unpack_from("<I", body, 4)[0]):
                text, at = _string(body, at, joints)
                shared.append(text)
    if not sheets:
        raise SheetError("no sheets")
    return "".join(grid(title, _cells(data, at, shared)) for at, title in sheets), len(sheets)
