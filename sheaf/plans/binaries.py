"""Bytes of binary office files, metafiles, Hangul documents, 7z archives and PDF files, for round trips."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import struct
import zlib

FREE, END, FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with one level of storages; streams of at least 4096 bytes each, in whole sectors."""
    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    sectors: list[bytes] = []
    fat: list[int] = []
    entries: list[list] = [["Root Entry", 5, END, 0, []], *([f, 1, 0, 0, []] for f in folders)]
    entries[0][4] += range(1, len(entries))

    def put(data: bytes) -> int:
        first, blocks = len(sectors), [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(blocks)
        fat.extend([*range(first + 1, first + len(blocks)), END])
        return first

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        owner = folders.index(name.split("/")[0]) + 1 if "/" in name else 0
        entries[owner][4].append(len(entries))
        entries.append([name.split("/")[-1], 2, put(data), len(data), []])
    right = {a: b for e in entries for a, b in zip(e[4], e[4][1:], strict=False)}
    raw = b""
    for n, (name, kind, start, size, children) in enumerate(entries):
        wide = name.encode("utf-16-le")
        raw += wide.ljust(64, b"\0") + struct.pack("<HBBIII", len(wide) + 2, kind, 1, FREE, right.get(n, FREE), children[0] if children else FREE) + b"\0" * 36 + struct.pack("<IQ", start, size)
    root, count = put(raw), 1
    while len(fat) + count > 128 * count:
        count += 1
    table, first = [*fat, *[FAT] * count], len(sectors)
    table += [FREE] * (128 * count - len(table))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<10I", 0, count, root, 0, 4096, END, 0, END, 0, first)
    head += struct.pack("<108I", *(first + k if k < count else FREE for k in range(1, 109)))
    return head.ljust(512, b"\0") + b"".join(sectors) + struct.pack(f"<{len(table)}I", *table)


def biff(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def xls(rows: list[list]) -> bytes:
    """One sheet: texts as shared strings, whole numbers as RK values, other ones as doubles, truth values, and
    ("date", serial) with a date's style."""
    texts = list(dict.fromkeys(v for r in rows for v in r if isinstance(v, str)))
    sst = biff(0xFC, struct.pack("<II", len(texts), len(texts)) + b"".join(struct.pack("<HB", len(t), 1) + t.encode("utf-16-le") for t in texts))

    def cell(r: int, c: int, v) -> bytes:
        if isinstance(v, bool):
            return biff(0x205, struct.pack("<HHHBB", r, c, 0, v, 0))
        if isinstance(v, str):
            return biff(0xFD, struct.pack("<HHHI", r, c, 0, texts.index(v)))
        if isinstance(v, int):
            return biff(0x27E, struct.pack("<HHHi", r, c, 0, v << 2 | 2))
        return biff(0x203, struct.pack("<HHHd", r, c, 1, v[1]) if isinstance(v, tuple) else struct.pack("<HHHd", r, c, 0, v))

    begin, end = biff(0x809, b"\0" * 16), biff(0x0A, b"")
    styles = biff(0xE0, struct.pack("<HH", 0, 0)) + biff(0xE0, struct.pack("<HH", 0, 14))
    bound = lambda at: biff(0x85, struct.pack("<IBBBB", at, 0, 0, 4, 0) + b"Data")
    where = len(begin + bound(0) + styles + sst + end)
    return compound({"Workbook": begin + bound(where) + styles + sst + end + begin + b"".join(cell(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)) + end})


def xlsb_parts(rows: list[list]) -> list[tuple[str, bytes]]:
    def rec(kind: int, body: bytes) -> bytes:
        size, n = b"", len(body)
        while True:
            size += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                break
        return (bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])) + size + body

    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    texts = list(dict.fromkeys(v for r in rows for v in r if isinstance(v, str)))

    def cell(c: int, v) -> bytes:
        if isinstance(v, bool):
            return rec(4, struct.pack("<IIB", c, 0, v))
        if isinstance(v, str):
            return rec(7, struct.pack("<III", c, 0, texts.index(v)))
        return rec(2, struct.pack("<IIi", c, 0, v << 2 | 2)) if isinstance(v, int) else rec(5, struct.pack("<IId", c, 0, v))

    body = b"".join(rec(0, struct.pack("<I", n)) + b"".join(cell(c, v) for c, v in enumerate(r)) for n, r in enumerate(rows))
    return [
        ("[Content_Types].xml", b"<Types>spreadsheetml binaryFormat</Types>"), ("xl/workbook.bin", rec(156, struct.pack("<II", 0, 1) + wide("r1") + wide("Data"))),
        ("xl/_rels/workbook.bin.rels", b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.bin"/></Relationships>'),
        ("xl/sharedStrings.bin", b"".join(rec(19, b"\0" + wide(t)) for t in texts)), ("xl/worksheets/sheet1.bin", body),
    ]


def doc(body: str) -> bytes:
    """A Word file of two pieces: the first half in 8-bit characters where they allow it, the rest in 16-bit ones."""
    fib, cut = bytearray(0x1AA), 0
    while cut < len(body) // 2 and body[cut].isascii():
        cut += 1
    struct.pack_into("<HH", fib, 0, 0xA5EC, 0xC1)
    narrow, wide = body[:cut].encode("ascii"), body[cut:].encode("utf-16-le")
    second = 0x400 + len(narrow) + len(narrow) % 2
    ends = struct.pack("<III", 0, cut, cut + len(wide) // 2)
    plc = ends + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0) + struct.pack("<HIH", 0, second, 0)
    pieces = b"\2" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", fib, 0x1A2, 0, len(pieces))
    return compound({"WordDocument": (bytes(fib).ljust(0x400, b"\0") + narrow).ljust(second, b"\0") + wide, "0Table": pieces})


def _format_pages(ranges: list[tuple[int, int, bytes]], step: int, first: int) -> tuple[bytes, bytes]:
    """Pages of 512 bytes that hold formats (empty for none) by range of bytes, and the table that leads to them."""
    pages, bounds = b"", []
    for a in range(0, len(ranges), 12):
        some, page, end = ranges[a : a + 12], bytearray(512), 510
        struct.pack_into(f"<{len(some) + 1}I", page, 0, *(r[0] for r in some), some[-1][1])
        for k, (_, _, made) in enumerate(some):
            if made:
                end -= len(made) + len(made) % 2
                page[end : end + len(made)] = made
                page[4 * (len(some) + 1) + step * k] = end // 2
        page[511] = len(some)
        bounds.append(some[0][0])
        pages += bytes(page)
    bounds.append(ranges[-1][1])
    return pages, struct.pack(f"<{len(bounds)}I", *bounds) + b"".join(struct.pack("<I", first + n) for n in range(len(bounds) - 1))


def marked_doc(runs: list[tuple[str, bool]]) -> bytes:
    """A Word file of runs, bold or not; a run that is one cell mark in bold ends a row of a table."""
    place, at, characters, paragraphs = 0x400, 0x400, [], []
    for text, bold in runs:
        end, row = at + 2 * len(text), bold and text == "\x07"
        characters.append((at, end, b"\3" + struct.pack("<HB", 0x0835, 1) if bold and not row else b""))
        paragraphs.append((at, end, b"\0\4\0\0" + struct.pack("<HBHB", 0x2416, 1, 0x2417, 1) if row else b""))
        at = end
    word = b"".join(t.encode("utf-16-le") for t, _ in runs)
    word += b"\0" * (-len(word) % 512)
    one, led = _format_pages(characters, 1, (place + len(word)) // 512)
    two, to = _format_pages(paragraphs, 13, (place + len(word) + len(one)) // 512)
    plc = struct.pack("<II", 0, (at - place) // 2) + struct.pack("<HIH", 0, place, 0)
    pieces = b"\2" + struct.pack("<I", len(plc)) + plc
    fib = bytearray(0x400)
    struct.pack_into("<HH", fib, 0, 0xA5EC, 0xC1)
    for where, start, size in ((0xFA, 0, len(led)), (0x102, len(led), len(to)), (0x1A2, len(led + to), len(pieces))):
        struct.pack_into("<II", fib, where, start, size)
    return compound({"WordDocument": bytes(fib) + word + one + two, "0Table": led + to + pieces})


def ppt(slides: list[tuple[str, str]]) -> bytes:
    rec = lambda kind, body, version=0, instance=0: struct.pack("<HHI", version | instance << 4, kind, len(body)) + body
    text = lambda kind, t: rec(0x0F9F, struct.pack("<I", kind)) + rec(0x0FA0, t.encode("utf-16-le"))
    listed = b"".join(rec(0x03F3, b"\0" * 20) + text(0, title) + text(1, body) for title, body in slides)
    return compound({"PowerPoint Document": rec(0x03E8, rec(0x0FF0, listed, 15), 15), "Current User": b"\0" * 20})


def msg(subject: str, sender: str, address: str, to: str, body: str) -> bytes:
    wide = lambda s: s.encode("utf-16-le")
    return compound({
        "__properties_version1.0": b"", "__substg1.0_0037001F": wide(subject), "__substg1.0_0C1A001F": wide(sender), "__substg1.0_0C1F001F": wide(address), "__substg1.0_1000001F": wide(body),
        "__recip_version1.0_#00000000/__substg1.0_3001001F": wide(to), "__attach_version1.0_#00000000/__substg1.0_3707001F": wide("f.txt"),
    })


def _hwp(tag: int, level: int, body: bytes) -> bytes:
    return struct.pack("<I", tag | level << 10 | min(len(body), 0xFFF) << 20) + (struct.pack("<I", len(body)) if len(body) >= 0xFFF else b"") + body


def hwp5(texts: list[str], cells: list[list[str]] = ()) -> bytes:
    """Paragraphs, then a table if there are cells; records compressed."""
    para = lambda text, level: _hwp(0x42, level, struct.pack("<IIHBB", len(text) + 1, 0, 0, 0, 0)) + _hwp(0x43, level + 1, (text + "\r").encode("utf-16-le"))
    body = b"".join(para(t, 0) for t in texts)
    if cells:
        body += _hwp(0x42, 0, b"\0" * 12) + _hwp(0x47, 1, b" lbt") + _hwp(0x4D, 2, struct.pack("<IHH", 0, len(cells), len(cells[0])))
        body += b"".join(_hwp(0x48, 2, struct.pack("<HI5H", 1, 0, 0, c, r, 1, 1)) + para(t, 2) for r, row in enumerate(cells) for c, t in enumerate(row))
    info = _hwp(0x19, 0, struct.pack("<I", 0))
    head = b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 1)
    return compound({"FileHeader": head, "DocInfo": deflated(info), "BodyText/Section0": deflated(body)})


def hwp3(texts: list[str]) -> bytes:
    para = lambda t: struct.pack("<BHHBBIB", 1, len(t) + 1, 0, 0, 0, 0, 0) + b"\0" * 31 + b"".join(struct.pack("<H", ord(c)) for c in t + "\r")
    end = struct.pack("<BHHBBIB", 0, 0, 0, 0, 0, 0, 0) + b"\0" * 31
    return b"HWP Document File V3.00 \x1a\1\2\3\4\5" + b"\0" * 128 + b"\0" * 1008 + b"\0\0" * 8 + b"".join(map(para, texts)) + end


def emf(runs: list[tuple[int, int, str]]) -> bytes:
    """Runs of text at places, as ExtTextOutW records."""
    def run(x: int, y: int, s: str) -> bytes:
        raw = s.encode("utf-16-le")
        raw += b"\0" * (-len(raw) % 4)
        return struct.pack("<II", 84, 76 + len(raw)) + b"\0" * 28 + struct.pack("<iiII", x, y, len(s), 76) + b"\0" * 24 + raw

    return struct.pack("<II", 1, 88) + b"\0" * 32 + b" EMF" + b"\0" * 44 + b"".join(run(*r) for r in runs) + struct.pack("<IIIII", 14, 20, 0, 0, 20)


def wmf(lines: list[str]) -> bytes:
    """Lines of text, one below the other, as TextOut records of a placeable metafile."""
    out = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0)
    for n, t in enumerate(lines):
        raw = t.encode("ascii")
        text = struct.pack("<H", len(raw)) + raw + b"\0" * (len(raw) % 2) + struct.pack("<hh", 40 * (n + 1), 3)
        out += struct.pack("<IH", 3 + len(text) // 2, 0x521) + text
    return b"\xd7\xcd\xc6\x9a" + b"\0" * 18 + out + struct.pack("<IH", 3, 0)


def deflated(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


#: Method ids of 7z, their properties, and coders.
_SEVEN = {
    b"\0": (b"", lambda d: d),
    b"\x21": (b"\x16", lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 23}])),
    b"\3\1\1": (b"\x5d" + struct.pack("<I", 1 << 23), lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 23, "lc": 3, "lp": 0, "pb": 2}])),
    b"\4\1\x08": (b"", deflated), b"\4\2\2": (b"", bz2.compress),
}
SEVEN_METHODS = list(_SEVEN)


def seven(members: list[tuple[str, bytes]], method: bytes) -> bytes:
    """One solid folder of all members, none of them empty."""
    def number(n: int) -> bytes:
        for k in range(8):
            if n < 1 << (7 * (k + 1)):
                return bytes([(0xFF00 >> k & 0xFF) | n >> (8 * k)]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
        return b"\xff" + n.to_bytes(8, "little")

    properties, coder = _SEVEN[method]
    whole = b"".join(d for _, d in members)
    raw = coder(whole)
    flag = len(method) | (0x20 if properties else 0)
    folder = b"\1" + bytes([flag]) + method + (number(len(properties)) + properties if properties else b"")
    streams = b"\x06\0\1\x09" + number(len(raw)) + b"\0" + b"\x07\x0b\1\0" + folder + b"\x0c" + number(len(whole)) + b"\0"
    parts = b"\x08\x0d" + number(len(members)) + (b"\x09" + b"".join(number(len(d)) for _, d in members[:-1]) if len(members) > 1 else b"")
    parts += b"\x0a\1" + b"".join(struct.pack("<I", zlib.crc32(d)) for _, d in members) + b"\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in members)
    head = b"\1\4" + streams + parts + b"\0" + b"\5" + number(len(members)) + b"\x11" + number(len(names)) + names + b"\0\0"
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start := struct.pack("<QQI", len(raw), len(head), zlib.crc32(head)))) + start + raw + head


def rar5(members: list[tuple[str, bytes]]) -> bytes:
    """Stored members."""
    def vint(n: int) -> bytes:
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def block(body: bytes) -> bytes:
        sized = vint(len(body)) + body
        return struct.pack("<I", zlib.crc32(sized)) + sized

    out = b"Rar!\x1a\7\1\0" + block(vint(1) + vint(0) + vint(0))
    for name, data in members:
        label = name.encode()
        own = vint(0x0004) + vint(len(data)) + vint(0) + struct.pack("<I", zlib.crc32(data)) + vint(0) + vint(1) + vint(len(label)) + label
        out += block(vint(2) + vint(2) + vint(len(data)) + own) + data
    return out + block(vint(5) + vint(0) + vint(0))


def pdf(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    out, at = b"%PDF-1.5\n", {}
    for n, o in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    size = max(objects) + 1
    rows = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size))
    return out + b"xref\n0 %d\n" % size + rows + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (size, trailer, len(out))


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


def page(content: bytes, extra: bytes = b"", catalog: bytes = b"", resources: bytes = b"") -> dict[int, bytes]:
    """Objects 1 to 6 of a file of one page: catalog, pages, page, its content (deflated), a font and its bold one."""
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R " + catalog + b">>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> " + resources + b">> " + extra + b">>", 4: stream(zlib.compress(content), b"/Filter /FlateDecode"),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
    }


def shown(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def at(x: float, y: float, text: str, size: int = 10) -> bytes:
    return b"BT /F1 %d Tf %d %d Td %s Tj ET " % (size, x, y, shown(text))


def lines(texts: list[str], top: int = 740) -> bytes:
    return b"".join(at(72, top - 14 * n, t) for n, t in enumerate(texts))


def rc4(key: bytes, data: bytes) -> bytes:
    box, j, out = list(range(256)), 0, bytearray()
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    i = j = 0
    for b in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(b ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


#: Fixed value: the padding of passwords that the format prescribes.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def encrypted_pdf(content: bytes) -> bytes:
    """With an empty user password, 40-bit RC4."""
    ident, owner = b"0123456789abcdef", b"\7" * 32
    key = hashlib.md5(PAD + owner + struct.pack("<i", -4) + ident).digest()[:5]
    own = hashlib.md5(key + struct.pack("<I", 4)[:3] + b"\0\0").digest()[:10]
    objects = page(b"")
    objects[4] = stream(rc4(own, zlib.compress(content)), b"/Filter /FlateDecode")
    objects[7] = b"<< /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >>" % (owner.hex().encode(), rc4(key, PAD).hex().encode())
    return pdf(objects, b"/Root 1 0 R /Encrypt 7 0 R /ID [<%s> <%s>]" % (ident.hex().encode(), ident.hex().encode()))


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, from the high bit on; the table is cleared when it is full."""
    out, bits, width, table, word = 0, 0, 9, {bytes([n]): n for n in range(256)}, b""

    def put(code: int) -> None:
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    for n in range(len(data)):
        longer = word + data[n : n + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        if len(table) + 2 >= 1 << width and width < 12:
            width += 1
        elif len(table) + 2 >= 4094:
            put(256)
            table, width = {bytes([n]): n for n in range(256)}, 9
        word = data[n : n + 1]
    if word:
        put(table[word])
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def predicted(data: bytes, columns: int) -> bytes:
    """Rows of so many bytes, each as differences to the row above (the Up filter of PNG)."""
    rows = [data[i : i + columns].ljust(columns) for i in range(0, len(data), columns)]
    return b"".join(b"\2" + bytes(x - y & 255 for x, y in zip(r, above, strict=True)) for r, above in zip(rows, [bytes(columns), *rows], strict=False))


def run_lengths(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def png_rows(data: bytes) -> bytes:
    """The rows of a PNG of one IDAT chunk, each after its filter's byte."""
    (size,) = struct.unpack_from(">I", data, 33)
    return zlib.decompress(data[41 : 41 + size])


def fax(rows: list[bytes], columns: int, k: int = -1) -> bytes:
    """Rows of one byte a pixel, 1 for black, coded against the row above (k below 0) or alone (0, without marks)."""
    from ..parsers import ccitt

    mode = {v: w for w, v in ccitt.MODES.items()}
    out: list[str] = []

    def run(n: int, colour: int) -> str:
        words, text = ccitt.BLACK if colour else ccitt.WHITE, ""
        while n >= 2560:
            text, n = text + ccitt.LONG[-1], n - 2560
        if n >= 1792:
            text, n = text + ccitt.LONG[(n - 1792) // 64], n % 64
        elif n >= 64:
            text, n = text + words[63 + n // 64], n % 64
        return text + words[n]

    def change(row: bytes, at: int, colour: int) -> int:
        """The first place from `at` on whose pixel has another colour."""
        place = row.find(1 - colour, max(at, 0))
        return place if place >= 0 else columns

    above = bytes(columns)
    for row in rows:
        at, colour = (-1 if k < 0 else 0), 0
        while at < columns and k >= 0:
            end = change(row, at, colour)
            out.append(run(end - at, colour))
            at, colour = end, colour ^ 1
        while at < columns and k < 0:
            own = change(row, at, colour) if at >= 0 else change(row, 0, 0)
            b1 = next((x for x in range(at + 1, columns) if above[x] != colour and (above[x - 1] if x else 0) == colour), columns)
            b2 = change(above, b1, colour ^ 1)
            if b2 < own:
                out.append(mode["pass"])
                at = b2
            elif abs(own - b1) <= 3:
                out.append(mode[own - b1])
                at, colour = own, colour ^ 1
            else:
                second = change(row, own, colour ^ 1)
                out.append(mode["across"] + run(own - max(at, 0), colour) + run(second - own, colour ^ 1))
                at = second
        above = row
    text = "".join(out) + (2 * ccitt.EOL if k < 0 else "")
    text += "0" * (-len(text) % 8)
    return int(text or "0", 2).to_bytes(len(text) // 8, "big")


class JbigCoder:
    """The adaptive binary encoder that parsers.jbig2.Arithmetic undoes, with its whole numbers and symbols."""

    def __init__(self):
        self.out, self.code, self.left, self.span, self.contexts = bytearray(b"\0"), 0, 12, 0x8000, {}

    def bit(self, kind: str, context: int, value: int) -> None:
        from ..parsers.jbig2 import STATES

        state, likely = self.contexts.get((kind, context), (0, 0))
        part, after, unlikely, turned = STATES[state]
        self.span -= part
        if value == likely:
            if self.span & 0x8000:
                self.code += part
                return
            if self.span < part:
                self.span = part
            else:
                self.code += part
            self.contexts[kind, context] = (after, likely)
        else:
            if self.span < part:
                self.code += part
            else:
                self.span = part
            self.contexts[kind, context] = (unlikely, likely ^ turned)
        while not self.span & 0x8000:
            self.span, self.code, self.left = self.span << 1, self.code << 1, self.left - 1
            if not self.left:
                self._byte()

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.code >= 0x8000000:
            self.out[-1] += 1
            self.code &= 0x7FFFFFF
        after = 20 if self.out[-1] == 0xFF else 19
        self.out.append(self.code >> after & 0xFF)
        self.code, self.left = self.code & (1 << after) - 1, 7 if after == 20 else 8

    def number(self, kind: str, value: int | None) -> None:
        from ..parsers.jbig2 import CLASSES

        size = abs(value or 0)
        k = max(n for n, (_, least) in enumerate(CLASSES) if least <= size)
        bits, least = CLASSES[k]
        word = [int(value is None or value < 0), *[1] * k, *[0] * (k < 5), *((size - least) >> n & 1 for n in range(bits - 1, -1, -1))]
        before = 1
        for b in word:
            self.bit(kind, before, b)
            before = before << 1 | b if before < 256 else (before << 1 | b) & 511 | 256

    def symbol(self, length: int, value: int) -> None:
        at = 1
        for n in range(length - 1, -1, -1):
            self.bit("symbol", at, value >> n & 1)
            at = at << 1 | value >> n & 1

    def picture(self, rows: list[bytes], template: int, adaptive: list[tuple[int, int]]) -> None:
        from ..parsers.jbig2 import places

        around = places(template, adaptive)
        pixel = lambda x, y: rows[y][x] if y >= 0 and 0 <= x < len(rows[y]) else 0
        for y, row in enumerate(rows):
            for x, value in enumerate(row):
                context = 0
                for right, up in around:
                    context = context << 1 | pixel(x + right, y - up)
                self.bit("picture", context, value)

    def done(self) -> bytes:
        top = self.code + self.span
        self.code |= 0xFFFF
        if self.code >= top:
            self.code -= 0x8000
        for _ in range(2):
            self.code <<= self.left
            self._byte()
        return bytes(self.out[1:]) + b"\xff\xac"


#: Where the adaptive pixels of each template mostly are.
_NEAR = [[(3, -1), (-3, -1), (2, -2), (-2, -2)], [(3, -1)], [(2, -1)], [(2, -1)]]


def _segment(number: int, kind: int, data: bytes, referred: bytes = b"") -> bytes:
    return struct.pack(">IBB", number, kind, len(referred) << 5) + referred + b"\1" + struct.pack(">I", len(data)) + data


def jbig2(rows: list[bytes], template: int) -> bytes:
    """A page and one generic region of rows of one byte a pixel."""
    coder, size = JbigCoder(), struct.pack(">II", len(rows[0]), len(rows))
    coder.picture(rows, template, _NEAR[template])
    pixels = b"".join(struct.pack(">bb", *p) for p in _NEAR[template])
    return _segment(0, 48, size + b"\0" * 11) + _segment(1, 38, size + b"\0" * 9 + bytes([template << 1]) + pixels + coder.done())


def jbig2_text(symbols: list[list[bytes]], placed: list[tuple[int, int]], wide: int, high: int) -> tuple[bytes, bytes]:
    """A dictionary of symbols of one size, and a page of (symbol, x) side by side at the top, their upper left corners given."""
    coder = JbigCoder()
    w, h = len(symbols[0][0]), len(symbols[0])
    coder.number("height", h)
    for n, rows in enumerate(symbols):
        coder.number("width", w if not n else 0)
        coder.picture(rows, 1, _NEAR[1])
    coder.number("width", None)
    coder.number("export", 0)
    coder.number("export", len(symbols))
    own = struct.pack(">HbbII", 1 << 10, *_NEAR[1][0], len(symbols), len(symbols)) + coder.done()
    text, length, end = JbigCoder(), (len(symbols) - 1).bit_length(), 0
    text.number("strip", 0)
    text.number("strip", 0)
    for n, (k, x) in enumerate(placed):
        text.number("next" if n else "first", x - end)
        text.symbol(length, k)
        end = x + w - 1
    text.number("next", None)
    size = struct.pack(">II", wide, high)
    region = size + b"\0" * 9 + struct.pack(">HI", 1 << 4, len(placed)) + text.done()
    return _segment(0, 0, own), _segment(1, 48, size + b"\0" * 11) + _segment(2, 6, region, b"\0")
