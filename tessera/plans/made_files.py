"""Writers of small documents and workbooks, from which the queries of sources read their texts back."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

#: Fixed value: characters of a cell.
CELL = 32_767
Row = list[str | int | float | bool | None]


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def clean(text: str) -> str:
    """Text as XML can hold it."""
    return escape("".join(ch for ch in text if ch >= " " or ch == "\n"))


# --- workbooks


def sheet_rows(text: str) -> list[Row]:
    """A row for each line: the line, its length, whether that is even, and an eighth of it for each third length."""
    return [[x[:CELL], len(x), len(x) % 2 == 0, None, *([len(x) / 8] if len(x) % 3 == 0 else [])] for x in text.split("\n")]


def xlsx(rows: list[Row]) -> bytes:
    def cell(ref: str, v: str | float | bool) -> str:
        if isinstance(v, bool):
            return f"<c r='{ref}' t='b'><v>{int(v)}</v></c>"
        return f"<c r='{ref}' t='inlineStr'><is><t>{clean(v)}</t></is></c>" if isinstance(v, str) else f"<c r='{ref}'><v>{float(v)}</v></c>"

    body = "".join(f"<row r='{i}'>{''.join(cell(f'{"ABCDEFGH"[k]}{i}', v) for k, v in enumerate(row) if v is not None)}</row>" for i, row in enumerate(rows, 3))
    return archive({"xl/workbook.xml": "<wb><sheets><sheet name='S1'/></sheets></wb>", "xl/worksheets/sheet1.xml": f"<ws><sheetData>{body}</sheetData></ws>"})


def ods(rows: list[Row]) -> bytes:
    """Equal neighbours are one repeated cell or row; empty space is repeated to the edge."""

    def cell(v: str | float | bool | None, times: int) -> str:
        repeat = f" t:number-columns-repeated='{times}'" if times > 1 else ""
        if v is None:
            return f"<t:table-cell{repeat}/>"
        if isinstance(v, bool):
            return f"<t:table-cell{repeat} o:value-type='boolean' o:boolean-value='{str(v).lower()}'/>"
        if isinstance(v, str):
            return f"<t:table-cell{repeat} o:value-type='string'><x:p>{clean(v)}</x:p></t:table-cell>"
        return f"<t:table-cell{repeat} o:value-type='float' o:value='{v}'><x:p>{v:.1f}</x:p></t:table-cell>"

    def runs(items: list) -> list[tuple]:
        out: list[list] = []
        for v in items:
            if out and out[-1][0] == v and type(out[-1][0]) is type(v):
                out[-1][1] += 1
            else:
                out.append([v, 1])
        return [tuple(x) for x in out]

    body = "<t:table-row t:number-rows-repeated='2'><t:table-cell t:number-columns-repeated='1024'/></t:table-row>"
    for row, times in runs(rows):
        body += f"<t:table-row t:number-rows-repeated='{times}'>{''.join(cell(v, n) for v, n in runs(row))}<t:table-cell t:number-columns-repeated='{1024 - len(row)}'/></t:table-row>"
    body += "<t:table-row t:number-rows-repeated='1048000'><t:table-cell t:number-columns-repeated='1024'/></t:table-row>"
    return archive({"content.xml": f"<o:doc xmlns:o='o' xmlns:t='t' xmlns:x='x'><t:table t:name={quoteattr('S1')}>{body}</t:table></o:doc>"})


def _record(kind: int, body: bytes) -> bytes:
    """A record, continued where it is too long."""
    return b"".join(struct.pack("<HH", kind if not at else 0x3C, len(part)) + part for at in range(0, max(1, len(body)), 8224) for part in [body[at : at + 8224]])


def _shared_strings(texts: list[str]) -> bytes:
    """The table of strings; one that crosses a record's end says anew how its characters are stored."""
    parts, now = [], struct.pack("<II", len(texts), len(texts))
    for text in texts:
        wide = any(ch > "\xff" for ch in text)
        raw, unit = (text.encode("utf-16-le"), 2) if wide else (text.encode("latin-1"), 1)
        if len(now) + 3 > 8224:
            parts, now = [*parts, now], b""
        now += struct.pack("<HB", len(raw) // unit, wide)
        while raw:
            room = (8224 - len(now)) // unit * unit
            now, raw = now + raw[:room], raw[room:]
            if raw:
                parts, now = [*parts, now], bytes([wide])
    return b"".join(struct.pack("<HH", 0x3C if k else 0xFC, len(x)) + x for k, x in enumerate([*parts, now]))


def _compound(data: bytes) -> bytes:
    """A compound file with one stream, Workbook."""
    data = data.ljust(4096, b"\0")
    pad = lambda x: x + bytes(-len(x) % 512)
    n_data = len(pad(data)) // 512
    n_table = 1
    while n_table * 128 < n_data + 1 + n_table:
        n_table += 1
    chain = lambda first, n: [*range(first + 1, first + n), 0xFFFFFFFE]
    table = [0xFFFFFFFD] * n_table + chain(n_table, 1) + chain(n_table + 1, n_data)
    table += [0xFFFFFFFF] * (n_table * 128 - len(table))

    def entry(name: str, kind: int, child: int, first: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le") if name else b""
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", first, size)

    directory = entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0xFFFFFFFF, n_table + 1, len(data)) + entry("", 0, 0xFFFFFFFF, 0, 0) * 2
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<9I", n_table, n_table, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)[:-4]
    places = [*range(n_table), *[0xFFFFFFFF] * (109 - n_table)]
    return (head + struct.pack("<109I", *places)).ljust(512, b"\0") + struct.pack(f"<{len(table)}I", *table) + directory + pad(data)


def xls(rows: list[Row]) -> bytes:
    """Strings stand in the shared table, whole numbers are packed, others are doubles."""
    texts = {v: None for row in rows for v in row if isinstance(v, str)}
    place = {v: k for k, v in enumerate(texts)}
    begin = lambda kind: _record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 6))
    end = _record(0x0A, b"")
    cells = []
    for r, row in enumerate(rows, 2):
        for c, v in enumerate(row):
            at = struct.pack("<HHH", r, c, 15)
            if isinstance(v, bool):
                cells.append(_record(0x205, at + bytes([v, 0])))
            elif isinstance(v, str):
                cells.append(_record(0xFD, at + struct.pack("<I", place[v])))
            elif isinstance(v, int):
                cells.append(_record(0x27E, at + struct.pack("<I", v << 2 | 2)))
            elif v is not None:
                cells.append(_record(0x203, at + struct.pack("<d", v)))
    strings = _shared_strings(list(texts))
    name = struct.pack("<BB", 2, 0) + b"S1"
    head = begin(5) + _record(0x85, bytes(6) + name) + strings + end
    sheet_at = struct.pack("<IBB", len(head), 0, 0)
    return _compound(begin(5) + _record(0x85, sheet_at + name) + strings + end + begin(0x10) + b"".join(cells) + end)


# --- pdf


class _Objects:
    """Objects of a pdf in the order they are added; number 1 is the catalog, 2 the page tree."""

    def __init__(self) -> None:
        self.bodies: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}

    def add(self, body: bytes) -> int:
        number = max(self.bodies, default=2) + 1 if len(self.bodies) > 1 else 3
        self.bodies[number] = body
        return number

    def stream(self, data: bytes, packed: bool, info: bytes = b"") -> int:
        raw = zlib.compress(data) if packed else data
        return self.add(b"<< /Length %d %s%s>>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode " if packed else b"", info, raw))

    def plain(self) -> bytes:
        """With a table of cross-references."""
        out, at = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", {}
        for k in sorted(self.bodies):
            at[k] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, self.bodies[k])
        size = max(self.bodies) + 1
        rows = b"0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[k] for k in range(1, size))
        return out + b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, rows, size, len(out))

    def packed(self) -> bytes:
        """With a stream of cross-references, and objects without streams in an object stream."""
        inner = [k for k in sorted(self.bodies) if b"stream\n" not in self.bodies[k]]
        places, data = b"", b""
        for k in inner:
            places += b"%d %d " % (k, len(data))
            data += self.bodies.pop(k) + b" "
        holder = max([*self.bodies, *inner]) + 1
        raw = zlib.compress(places + data)
        self.bodies[holder] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(inner), len(places), len(raw), raw)
        out, rows = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n", {0: (0, 0, 255)} | {k: (2, holder, i) for i, k in enumerate(inner)}
        for k in sorted(self.bodies):
            rows[k] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (k, self.bodies[k])
        size = holder + 2
        rows[holder + 1] = (1, len(out), 0)
        width = 7
        table, last = b"", bytes(width)
        for k in range(size):  # rows are stored as differences from the row above
            row = struct.pack(">BIH", *rows[k])
            table += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, last, strict=True))
            last = row
        raw = zlib.compress(table)
        info = b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns %d >>" % (size, width)
        return out + b"%d 0 obj\n<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (holder + 1, info, len(raw), raw, len(out))


def _literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def pdf(text: str, way: int, per_page: int = 40) -> bytes:
    """Lines of text with something on them, in one of three ways: plain strings in a simple font; two-byte codes with a
    Unicode map, compressed; or words placed apart by gaps, in a compressed file whose cross-references are a stream."""
    lines = [x for x in text.split("\n") if x.strip()]
    codes = {ch: k for k, ch in enumerate(sorted(set("".join(lines))), 1)}
    simple = way == 0
    try:
        encode = lambda x: _literal(x.encode("cp1252"))
        encode("".join(codes))
    except UnicodeEncodeError:
        simple = False
    file = _Objects()
    if simple:
        font = file.add(b"<< /Type /Font /Subtype /TrueType /BaseFont /F /Encoding /WinAnsiEncoding >>")
    else:
        encode = lambda x: b"<" + "".join(f"{codes[ch]:04X}" for ch in x).encode() + b">"
        pairs = [b"<%04X> <%s>" % (k, ch.encode("utf-16-be").hex().encode()) for ch, k in codes.items()]
        maps = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(part), b"\n".join(part)) for at in range(0, len(pairs), 100) for part in [pairs[at : at + 100]])
        to_unicode = file.stream(b"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n%sendcmap end" % maps, way > 0)
        below = file.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F >>")
        font = file.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (below, to_unicode))
    pages = []
    for at in range(0, len(lines), per_page):
        show = []
        for line in lines[at : at + per_page]:
            if way == 2:
                show.append(b"[" + b" -300 ".join(encode(w) for w in line.split()) + b"] TJ 0 -12 Td")
            else:
                show.append(encode(line) + (b" Tj T*" if way else b" '"))
        content = file.stream(b"q BT /F1 10 Tf 12 TL 1 0 0 1 40 780 Tm\n%s\nET Q" % b"\n".join(show), way > 0)
        pages.append(file.add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R >>" % content))
    file.bodies[2] = b"<< /Type /Pages /Count %d /Resources << /Font << /F1 %d 0 R >> >> /Kids [%s] >>" % (len(pages), font, b" ".join(b"%d 0 R" % p for p in pages))
    return file.packed() if way == 2 else file.plain()
