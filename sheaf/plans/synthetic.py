"""Files made from table rows, for round trips: each function turns columns into the bytes of a file."""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _made(build: Callable[..., bytes], *columns: Column) -> Column:
    @F.arrow_udf("binary")
    def each(*arrays: pa.Array) -> pa.Array:
        return pa.array([build(*values) for values in zip(*(a.to_pylist() for a in arrays), strict=True)], pa.binary())

    return each(*columns)


def zipped(members: list[tuple[str, bytes]], stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tarred(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _pairs(rows: list[dict]) -> list[tuple[str, bytes]]:
    return [(r["name"], (r["text"] or "").encode()) for r in rows]


def zip_file(members: Column, stored: bool = False) -> Column:
    """Of an array of struct(name, text)."""
    return _made(lambda rows: zipped(_pairs(rows), stored), members)


def tar_gz(members: Column) -> Column:
    return _made(lambda rows: gzip.compress(tarred(_pairs(rows)), 6, mtime=0), members)


def tar_bz2(members: Column) -> Column:
    return _made(lambda rows: bz2.compress(tarred(_pairs(rows))), members)


def gz_file(content: Column) -> Column:
    return _made(lambda text: gzip.compress((text or "").encode(), 6, mtime=0), content)


def nested_zip(members: Column, levels: int) -> Column:
    """A zip within zips; the innermost holds the members."""
    def build(rows: list[dict]) -> bytes:
        data = zipped(_pairs(rows))
        for n in range(levels):
            data = zipped([(f"level{n}.zip", data)], stored=True)
        return data

    return _made(build, members)


def docx(paragraphs: Column) -> Column:
    def build(texts: list[str]) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in texts)
        xml = f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
        return zipped([("[Content_Types].xml", b"<Types>wordprocessingml</Types>"), ("word/document.xml", xml.encode())])

    return _made(build, paragraphs)


def xlsx(rows: Column) -> Column:
    """Of an array of rows of text; numbers by shared strings as well."""
    def build(cells: list[list[str]]) -> bytes:
        strings = list(dict.fromkeys(v for r in cells for v in r))
        sst = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
        at = {s: n for n, s in enumerate(strings)}
        body = "".join(f'<row r="{n}">' + "".join(f'<c r="{chr(65 + c)}{n}" t="s"><v>{at[v]}</v></c>' for c, v in enumerate(r)) + "</row>" for n, r in enumerate(cells, 1))
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        return zipped([
            ("[Content_Types].xml", b"<Types>spreadsheetml</Types>"), ("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>'.encode()),
            ("xl/_rels/workbook.xml.rels", b'<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'),
            ("xl/sharedStrings.xml", f"<sst {ns}>{sst}</sst>".encode()), ("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>".encode()),
        ])

    return _made(build, rows)


def typed_xlsx(rows: list[list]) -> bytes:
    """One sheet of inline texts, numbers, truth values, ("date", serial) with a date's style, and None for no cell."""
    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f'<c r="{ref}" s="1"><v>{v[1]}</v></c>' if isinstance(v, tuple) else f'<c r="{ref}"><v>{v}</v></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{chr(65 + c)}{n}", v) for c, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    return zipped(sheet_parts(body) + [("xl/styles.xml", f'<styleSheet {_SHEET}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'.encode())])


_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def sheet_parts(body: str) -> list[tuple[str, bytes]]:
    """A workbook of one sheet with these rows."""
    return [
        ("[Content_Types].xml", b"<Types>spreadsheetml</Types>"), ("xl/workbook.xml", f'<workbook {_SHEET}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>'.encode()),
        ("xl/_rels/workbook.xml.rels", b'<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'), ("xl/worksheets/sheet1.xml", f"<worksheet {_SHEET}><sheetData>{body}</sheetData></worksheet>".encode()),
    ]


def pptx(slides: Column) -> Column:
    """Of an array of struct(title, body)."""
    def build(rows: list[dict]) -> bytes:
        ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
        text = lambda t: "<p:txBody>" + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in t.split("\n")) + "</p:txBody>"
        shape = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>{text(t)}</p:sp>'
        parts = [("[Content_Types].xml", b"<Types>presentationml</Types>"), ("ppt/presentation.xml", b"<p/>")]
        parts += [(f"ppt/slides/slide{n}.xml", f"<p:sld {ns}><p:cSld><p:spTree>{shape('title', r['title'])}{shape('body', r['body'])}</p:spTree></p:cSld></p:sld>".encode()) for n, r in enumerate(rows, 1)]
        return zipped(parts)

    return _made(build, slides)


_ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'


def _odf(kind: str, body: str) -> bytes:
    xml = f"<office:document-content {_ODF}><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>"
    return zipped([("mimetype", f"application/vnd.oasis.opendocument.{kind}".encode()), ("META-INF/manifest.xml", b"<m/>"), ("content.xml", xml.encode())])


def ods(rows: Column) -> Column:
    def build(cells: list[list[str]]) -> bytes:
        body = "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(v)}</text:p></table:table-cell>" for v in r) + "</table:table-row>" for r in cells)
        return _odf("spreadsheet", f'<table:table table:name="Data">{body}</table:table>')

    return _made(build, rows)


def odt(paragraphs: Column) -> Column:
    return _made(lambda texts: _odf("text", "".join(f"<text:p>{escape(t)}</text:p>" for t in texts)), paragraphs)


def rtf(paragraphs: Column) -> Column:
    def build(texts: list[str]) -> bytes:
        coded = lambda t: "".join(c if c.isascii() and c not in "\\{}" else "\\" + c if c in "\\{}" else "".join(f"\\u{int.from_bytes(u, 'little', signed=True)}?" for u in (c.encode("utf-16-le")[i : i + 2] for i in range(0, len(c.encode("utf-16-le")), 2))) for c in t)
        return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}" + "".join(coded(t) + "\\par " for t in texts) + "}").encode()

    return _made(build, paragraphs)


def eml(subject: Column, sender: Column, body: Column) -> Column:
    def build(s: str, f: str, b: str) -> bytes:
        import base64

        word = lambda t: f"=?UTF-8?B?{base64.b64encode(t.encode()).decode()}?="
        coded = base64.encodebytes(b.encode()).decode()
        return f"Subject: {word(s)}\r\nFrom: {f}\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=\"b1\"\r\n\r\n--b1\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n{coded}\r\n--b1\r\nContent-Type: text/html\r\n\r\n<p>other</p>\r\n--b1--\r\n".encode()

    return _made(build, subject, sender, body)


def pdf(lines: Column) -> Column:
    """One page with a line of text for each entry."""
    def build(texts: list[str]) -> bytes:
        show = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        content = b"BT /F1 12 Tf 72 720 Td 14 TL\n" + b"".join(b"(" + show(t) + b") Tj T*\n" for t in texts) + b"ET"
        objects = [
            b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
            b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        ]
        out, at = b"%PDF-1.4\n", []
        for n, o in enumerate(objects, 1):
            at.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
        table = b"".join(b"%010d 00000 n \n" % a for a in at)
        return out + b"xref\n0 6\n0000000000 65535 f \n" + table + b"trailer\n<< /Size 6 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(out)

    return _made(build, lines)


def pdf_pages(lines: Column, per_page: int = 40) -> Column:
    """As many pages as the lines need, with a line of text for each entry."""
    def build(texts: list[str]) -> bytes:
        show = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        parts = [texts[a : a + per_page] for a in range(0, len(texts), per_page)] or [[]]
        kids = b" ".join(b"%d 0 R" % (4 + 2 * n) for n in range(len(parts)))
        objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(parts)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
        for n, part in enumerate(parts):
            content = b"BT /F1 12 Tf 72 720 Td 14 TL\n" + b"".join(b"(" + show(t) + b") Tj T*\n" for t in part) + b"ET"
            objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (5 + 2 * n))
            objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
        out, at = b"%PDF-1.4\n", []
        for n, o in enumerate(objects, 1):
            at.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
        table = b"".join(b"%010d 00000 n \n" % a for a in at)
        return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, len(out))

    return _made(build, lines)


def _deflated(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def alz(members: Column) -> Column:
    """Local headers with four-byte sizes, deflated content."""
    def build(rows: list[dict]) -> bytes:
        out = b"ALZ\1" + b"\0" * 4
        for name, data in _pairs(rows):
            raw, label = _deflated(data), name.encode("cp949")
            out += b"BLZ\1" + struct.pack("<HBIH", len(label), 0, 0, 0x40) + struct.pack("<HIII", 2, zlib.crc32(data), len(raw), len(data)) + label + raw
        return out + b"CLZ\2"

    return _made(build, members)


def egg(members: Column) -> Column:
    """File headers with a name, then one deflated block each."""
    def build(rows: list[dict]) -> bytes:
        end = struct.pack("<I", 0x08E28222)
        out = struct.pack("<I", 0x41474745) + b"\0\1" + b"\0" * 8 + end
        for name, data in _pairs(rows):
            raw, label = _deflated(data), name.encode()
            out += struct.pack("<IIQ", 0x0A8590E3, 0, len(data)) + struct.pack("<IBH", 0x0A8591AC, 0, len(label)) + label + end
            out += struct.pack("<IBBIII", 0x02B50C13, 1, 0, len(data), len(raw), zlib.crc32(data)) + end + raw
        return out + end

    return _made(build, members)


def rar(members: Column) -> Column:
    """A RAR 4 archive of stored members."""
    def build(rows: list[dict]) -> bytes:
        out = b"Rar!\x1a\x07\0" + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6
        for name, data in _pairs(rows):
            label = name.encode("cp949")
            out += struct.pack("<HBHH", 0, 0x74, 0x8000, 32 + len(label)) + struct.pack("<IIBIIBBHI", len(data), len(data), 0, zlib.crc32(data), 0, 20, 0x30, len(label), 0) + label + data
        return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)

    return _made(build, members)


def hwpx(paragraphs: Column) -> Column:
    def build(texts: list[str]) -> bytes:
        ns = 'xmlns:hp="p" xmlns:hs="s"'
        body = "".join(f'<hp:p><hp:run charPrIDRef="0"><hp:t>{escape(t)}</hp:t></hp:run></hp:p>' for t in texts)
        return zipped([("mimetype", b"application/hwp+zip"), ("Contents/header.xml", b'<h><charPr id="0" height="1000"/></h>'), ("Contents/section0.xml", f"<hs:sec {ns}>{body}</hs:sec>".encode())])

    return _made(build, paragraphs)
