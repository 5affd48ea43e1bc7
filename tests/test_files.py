"""Readers of PDF files and workbooks: round trips, and files as other programs write them."""

import struct
import zlib

import pandas as pd
import pytest

from tessera.operators import mixing
from tessera.plans import made_files
from tessera.session import slices
from tessera.sources import documents, pdf, sheets

TEXT = "First (line) \\ with marks\nécole zwei & <b>\n\nкириллица 漢字 😀\nlast   one"


@pytest.mark.parametrize("way", [0, 1, 2])
def test_pdf_lines_come_back(way):
    want = [" ".join(x.split()) if way == 2 else x for x in TEXT.split("\n") if x]
    assert pdf.read(made_files.pdf(TEXT, way)) == ("\n".join(want), 1)
    text, pages = pdf.read(made_files.pdf("\n".join(f"line {i}" for i in range(100)), way))
    assert (text.split("\n"), pages) == ([f"line {i}" for i in range(100)], 3)


@pytest.mark.parametrize("way", [0, 1, 2])
def test_pdf_with_broken_references_is_searched(way):
    raw = made_files.pdf("one\ntwo", way)
    at = raw.rindex(b"startxref")
    assert pdf.read(raw[:at] + b"startxref\n7\n%%EOF")[0] == "one\ntwo"
    assert pdf.read(raw[:at])[0] == "one\ntwo"


def one_page(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", filters=b""):
    head = b"%PDF-1.3\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n"
    page = b"3 0 obj <</Type/Page/Parent 2 0 R/Resources<</Font<</F 5 0 R>>>>/Contents [4 0 R]>> endobj\n"
    return head + page + b"4 0 obj <</Length %d%s>> stream\n%s\nendstream endobj\n5 0 obj %s endobj\ntrailer <</Root 1 0 R>>" % (len(content), filters, content, font)


@pytest.mark.parametrize(("content", "text"), [
    (b"BT /F 12 Tf 72 700 Td (Hel) Tj (lo) Tj 0 -14 Td (next) Tj ET", "Hello\nnext"),
    (b"BT /F 12 Tf 14 TL 72 700 Td [(W) 30 (ord) -400 (gap)] TJ (under) ' ET", "Word gap\nunder"),
    (b"BT /F 12 Tf 1 0 0 1 72 700 Tm (a\\(b\\)\\\\ \\101\\r) Tj 1 0 0 1 72 400 Tm <4142> Tj ET", "a(b)\\ A\r\nAB"),
    (b"BT /F 10 Tf 72 700 Td (one) Tj 40 0 Td (two) Tj 15 0 Td (x) Tj ET", "one twox"),
    (b"q BI /W 1 /H 1 ID \x00(Tj EI Q BT /F 9 Tf (after an image) Tj ET", "after an image"),
    (b"% (no) Tj\nBT /F 9 Tf (nested (parts) stay) Tj ET", "nested (parts) stay"),
])
def test_pdf_operators(content, text):
    assert pdf.read(one_page(content)) == (text, 1)


def test_pdf_encodings_and_filters():
    font = b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/eacute/Ccedilla/uni20AC 97/one/parenleft/fi/ncaron/aring]>>>>"
    assert pdf.read(one_page(b"BT /F 9 Tf (ABCabcdeZ) Tj ET", font))[0] == "éÇ€1(finčå".replace("nč", "ň") + "Z"
    assert pdf.read(one_page(b"BT /F 9 Tf (\x80\xe9) Tj ET", b"<</Type/Font/Encoding/WinAnsiEncoding>>"))[0] == "€é"
    assert pdf.read(one_page(b"BT /F 9 Tf (hex) Tj ET".hex().encode() + b">", filters=b"/Filter/ASCIIHexDecode"))[0] == "hex"
    assert pdf.read(one_page(zlib.compress(b"BT /F 9 Tf (flate) Tj ET"), filters=b"/Filter[/FlateDecode]"))[0] == "flate"
    ranges = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <41> <43> <0430> <61> <62> [<0078> <00790079>] endbfrange"
    raw = one_page(b"BT /F 9 Tf (ABCab) Tj ET", b"<</Type/Font/ToUnicode 6 0 R>>").replace(b"trailer", b"6 0 obj <</Length %d>> stream\n%s\nendstream endobj\ntrailer" % (len(ranges), ranges))
    assert pdf.read(raw)[0] == "абвxyy"


@pytest.mark.parametrize(("raw", "why"), [(b"no pdf", "not a pdf"), (one_page(b"").replace(b"<</Root", b"<</Encrypt 9 0 R/Root"), "encrypted"), (one_page(b"x", filters=b"/Filter/LZWDecode"), "LZWDecode"), (b"%PDF-1.4 nothing", "")])
def test_unreadable_pdf_gives_its_reason(raw, why):
    path, kind, text, pages, error = documents.extract("a.pdf", raw)
    assert (kind, text, pages) == ("pdf", "", 0)
    assert error and why in error


@pytest.mark.parametrize("lines", [["one line"], ["", ""], ["a & b", "", "x" * 9000, "y", "y", "y"], ["ü" * 5000, "漢" * 5000, "plain", "漢字"] * 3, [f"row {i}" for i in range(700)]])
def test_three_formats_give_one_grid(lines):
    rows = made_files.sheet_rows("\n".join(lines))
    found = [sheets.xlsx(made_files.xlsx(rows)), sheets.ods(made_files.ods(rows)), sheets.xls(made_files.xls(rows))]
    assert found[0] == found[1] == found[2]
    assert found[0][0].count("\n| ") == min(len(lines), sheets.ROWS)
    assert lines[0] in found[0][0]


def records(*parts):
    return b"".join(struct.pack("<HH", kind, len(body)) + body for kind, body in parts)


def test_records_of_other_programs():
    text = struct.pack("<HBH", 4, 9, 1) + "caf\xe9".encode("utf-16-le") + struct.pack("<HH", 0, 5)  # a rich string
    phonetic = struct.pack("<HBI", 2, 4, 6) + b"hi" + b"\0" * 6
    strings = struct.pack("<II", 2, 2) + text + phonetic
    at = lambda r, c: struct.pack("<HHH", r, c, 0)
    formula = lambda r, c, value: (0x06, at(r, c) + value + bytes(8))
    packed = lambda x: struct.pack("<HI", 0, x)
    cells = [
        (0xFD, at(4, 2) + struct.pack("<I", 0)), (0xFD, at(4, 3) + struct.pack("<I", 1)), (0x204, at(4, 4) + struct.pack("<HB", 2, 0) + b"ok"),
        (0xBD, struct.pack("<HH", 5, 2) + packed((-5 << 2 | 2) & 0xFFFFFFFF) + packed(250 << 2 | 3) + packed(struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32) + struct.pack("<H", 4)),
        formula(6, 2, struct.pack("<d", 1e-7)), formula(6, 3, b"\0" * 6 + b"\xff\xff"), (0x207, struct.pack("<HB", 3, 0) + b"str"), formula(6, 4, b"\x01\0\x01\0\0\0\xff\xff"), formula(6, 5, b"\x02\0\x07\0\0\0\xff\xff"),
        (0x205, at(7, 2) + b"\x2a\x01"), (0x203, at(7, 3) + struct.pack("<d", 1e15)), (0x0A, b""),
    ]
    bof = (0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 6))
    head = lambda place: records(bof, (0x85, struct.pack("<IBBBB", place, 0, 0, 1, 0) + b"T"), (0xFC, strings), (0x0A, b""))
    raw = made_files._compound(head(len(head(0))) + records(bof, *cells))
    assert sheets.xls(raw)[0] == "\n## Sheet: T\n| café | hi | ok |\n| -5 | 2.5 | 0.5 |\n| 0.0000001 | str | true | Div0 |\n| NA | 1000000000000000 |\n".replace("1000000000000000", sheets.number(1e15))


@pytest.mark.parametrize("name", ["a.xls", "a.ods", "a.xlsx", "a.pdf"])
def test_cut_files_give_a_reason(name):
    kind = name[2:]
    whole = made_files.pdf("x" * 50, 2) if kind == "pdf" else getattr(made_files, kind)(made_files.sheet_rows("x\ny"))
    for size in (0, 1, 10, 100, len(whole) // 2, len(whole) - 1):
        path, found, text, pages, error = documents.extract(name, whole[:size])
        assert error or text


def test_files_go_to_python_some_at_a_time(spark):
    """Not in Arrow batches of thousands, and what is made of slices is sent on slice by slice."""
    files = spark.range(3).selectExpr("concat('f', id, '.txt') AS path", "CAST(concat('text ', id) AS BINARY) AS content")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for found in (documents.extract_files(files), mixing.blocks(files)):
        assert "BatchEvalPython" in plan(found) and "MapInPandas" not in plan(found)
    assert sorted(tuple(r) for r in documents.extract_files(files).select("path", "text").collect()) == [(f"f{k}.txt", f"text {k}") for k in range(3)]
    assert [len(x) for x in slices(iter([pd.DataFrame({"a": range(150)}), pd.DataFrame({"a": range(3)})]))] == [64, 64, 22, 3]
