"""Parsers on files made here; none needs Spark."""

from __future__ import annotations

import base64
import gzip
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.operators import convert
from sheaf.parsers import charsets, doc, docx, hwp, hwp3, html, images, mail, metafiles, numbers, pdf, pdf_core, pdf_crypt, rtf, xls, xlsb
from sheaf.parsers.base import ConversionError, Options
from sheaf.parsers.markdown import padded_table, strip_markdown, table
from sheaf.plans import binaries
from sheaf.plans.synthetic import tarred, zipped

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://r"'


def test_html_worked_example():
    page = '<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{}</style></head><body><nav><ul><li><a href="/x">X</a></li></ul></nav><!-- ad --><div class="ad">Ad.</div><article><h1>H</h1><p><b>B.<br><p>C.</p></article><footer>&copy; e &middot; f</footer></body></html>'
    md = html.html_to_markdown(page)
    assert md == "# T & U\n\n- X\n\nAd.\n\n# H\n\n**B.\nC.\n\n© e &middot; f"
    assert strip_markdown(md) == "T & U\n\n- X\n\nAd.\n\nH\n\nB.\nC.\n\n© e &middot; f"


@pytest.mark.parametrize(
    ("page", "md"),
    [
        ("<table><tr><th>a|b</th><th>c</th></tr><tr><td>é</td></tr></table>", "\n| a\\|b | c   |\n| ---- | --- |\n| é   |     |\n\n"),
        ("<p>a <i>b</i> <code>c</code></p>", "a *b* `c`\n\n"),
        ('<p><a href="u">t</a><a>plain</a></p>', "[t](u)plain\n\n"),
        ("<ol><li>a<li>b</li><ul><li>c</li></ul></ol>", "1. b\n  - c\n\n"),
        ("x<hr>y", "x\n---\n\ny"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```\n\n"),
        ("<blockquote>q</blockquote>", "> q\n\n"),
        ("a<script>if (1 < 2) {}</script>b", "ab"),
        ("a<script>never closed", "anever closed"),
        ('<img data-src="d" alt="A">', "![A](d)"),
        ("&#65;&#x42;&nosuch;&#xD800;&amp;lt;", "AB&nosuch;�&lt;"),
        ("a  \n\t b", "a b"),
        ("<h2>x</h2>\n\n\n\n<p>y", "## x\n\n \n\ny"),
        ("", ""),
    ],
)
def test_html(page, md):
    assert html.html_to_markdown(page) == md


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/!-?\"'= abphltdri\n&;#x1"), max_size=60))
def test_html_never_fails(page):
    html.html_to_markdown(page)


def test_html_data_image_and_charset():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 64, 80)
    page = f'<p><img src="data:image/png;base64,{base64.b64encode(png).decode()}"></p>'
    (one,) = list(convert.pages(page.encode(), "a.html"))
    assert one.text == "![image](page1_img0.png)\n\n" and (one.images[0].width, one.images[0].height) == (64, 80)
    (small,) = list(convert.pages(page.encode(), "a.html", Options(min_image_size=70)))
    assert small.text == "\n\n" and not small.images
    assert convert.markdown("<meta charset=euc-kr><p>한글".encode("euc-kr"), "a.html") == "한글"
    assert convert.markdown("<p>é".encode("utf-16"), "a.html") == "é"


@pytest.mark.parametrize(
    ("md", "text"),
    [
        ("# A\n**b** *c*", "A\nb c"), ("---\nx", "\nx"), ("| a | b |\n| --- | --- |\n| c | |", "a  b\nc  \n"), ("![alt](x) ![](y)z", "[image: alt] z"), ("a -- b\n----", "a -- b\n"), ("# | a |", "| a |"), ("#x", "#x"),
    ],
)
def test_strip_markdown(md, text):
    assert strip_markdown(md) == text


def test_tables():
    assert table([["a", "b"], ["c"]]) == "| a | b |\n| --- | --- |\n| c |  |\n" and table([]) == ""
    assert padded_table([["é"], ["abcd"]]) == "| é   |\n| ---- |\n| abcd |\n"


def test_mail():
    raw = (
        b"Subject: =?utf-8?B?7ZWc?=  =?utf-8?Q?=EA=B8=80_x?=\r\nFrom: a@b\r\nTo: c@d\r\nDate: today\r\n continued\r\nContent-Type: multipart/mixed; boundary=\"q\"\r\n\r\n"
        b"--q\r\nContent-Type: multipart/alternative; boundary=r\r\n\r\n--r\r\nContent-Type: text/html\r\n\r\n<b>h</b>\r\n--r\r\nContent-Type: text/plain; charset=euc-kr\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n=C7=D1=\r\n=B1=DB\r\n--r--\r\n"
        b"--q\r\nContent-Type: application/pdf; name=\"a.pdf\"\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--q--\r\n"
    )
    assert mail.markdown(raw) == "# 한글 x\n\n**From:** a@b\n**To:** c@d\n**Date:** today continued\n\n---\n\n한글\n\n## 첨부파일\n- a.pdf (application/pdf)\n"
    assert convert.kind_of(raw, "x.eml") == "EML"


def test_mail_nested_too_deeply():
    body = "end"
    for n in range(60):
        body = f"Content-Type: multipart/mixed; boundary=b{n}\n\n--b{n}\n{body}\n--b{n}--"
    mail.markdown(body.encode())


def test_rtf():
    page = next(rtf.pages(rb"{\rtf1\ansi\ansicpg949{\fonttbl{\f0 Arial;}}Hi \'c7\'d1\u-21920?x\par{\*\foo bar}line\par\trowd a\cell b|\cell\row c\cell d\cell\row}"))
    assert page.text.startswith("Hi 한" + chr(65536 - 21920) + "x\n\nline") and "| a | b/ |" in page.text
    assert (page.page_width, page.body_font_size) == (612.0, 12.0)


def package(**parts: str) -> bytes:
    return zipped([("[Content_Types].xml", b"<Types>wordprocessingml</Types>"), *((k.replace("__", "/"), v.encode()) for k, v in parts.items())])


def test_docx():
    data = zipped([
        ("[Content_Types].xml", b"<Types>wordprocessingml</Types>"),
        ("word/styles.xml", f'<w:styles {W}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>'.encode()),
        ("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'.encode()),
        ("word/_rels/document.xml.rels", b'<Relationships><Relationship Id="r1" Target="http://x" TargetMode="External"/></Relationships>'),
        ("word/footnotes.xml", f'<w:footnotes {W}><w:footnote w:type="separator"><w:p/></w:footnote><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'.encode()),
        ("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Top line</w:t></w:r></w:p><w:p><w:r><w:t>Big</w:t></w:r></w:p></w:hdr>".encode()),
        ("word/embeddings/a.xlsx", b"x" * 2048),
        ("word/document.xml", f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Big</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Sub</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>in</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>b</w:t></w:r><w:r><w:rPr><w:b/><w:i/></w:rPr><w:t>c</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>go</w:t></w:r></w:hyperlink></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x|y</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:br w:type="page"/><w:t>next</w:t></w:r></w:p>
<w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:sdtContent></w:sdt></w:body></w:document>""".encode()),
    ])
    md = docx.markdown(data)
    assert md.startswith("--- Page 1 ---\n\n# Big\n\n## Sub\n\n1. one\n  - in\n2. two\n**ab*****c***[go](http://x)\n\n\n| x/y | z |\n| --- | --- |\n\n\n--- Page 2 ---\n\nnext\n\ninside\n\n\n[^1]: note\n")
    assert "\n--- Header / Footer ---\n\nTop line\n" in md and md.endswith("\n## Attachments\n\n- a.xlsx (2.0 KB)\n\n")
    found = list(docx.pages(data))
    assert [p.page_number for p in found] == [1, 2] and found[0].tables == [[["x/y", "z"]]]
    assert [p.page_number for p in docx.pages(data, Options(pages=(2,)))] == [2]
    assert "| x/y" not in docx.markdown(data, Options(tables=False))


def test_broken_packages():
    for name in ("a.docx", "a.xlsx", "a.pptx", "a.odt", "a.hwpx", "a.xlsb"):
        for data in (b"PK\3\4" + b"\0" * 40, zipped([("x", b"y")]), zipped([("[Content_Types].xml", b"<a"), ("word/document.xml", b"<w>")])):
            text, error = convert.safe_markdown(data, name, Options())
            assert (text is None) != (error is None)


def test_deep_xml_is_cut():
    inner = "<a>" * 100_000 + "</a>" * 100_000
    text, error = convert.safe_markdown(package(word__document=f"<w:document {W}><w:body>{inner}</w:body></w:document>").replace(b"word/document", b"word/document"), "a.docx", Options())
    assert (text is None) != (error is None)


def test_number_formats():
    f = numbers.formatted
    assert [f("45000.5", 14), f("45000.5", 22), f("0.5", 20), f("0.1234", 10), f("0.5", 9), f("1234567.891", 4), f("-1234567.5", 3), f("0.125", 2), f("12345", 11), f("7", 0), f("0.256", 164, "0.0%"), f("3.14159", 165, "0.000"), f("44197", 166, "yyyy/mm/dd")] == [
        "2023-03-15", "2023-03-15 12:00:00", "12:00:00", "12.34%", "50%", "1,234,567.89", "-1,234,568", "0.12", "1.23E+04", "7", "25.6%", "3.142", "2021-01-01",
    ]
    assert [numbers.date_of_serial(n) for n in (0, 1, 59, 60, 61)] == ["0000-00-00", "1900-01-01", "1900-02-28", "1900-03-01", "1900-03-01"]
    assert numbers.time_of_serial(0.999999) == "24:00:00"
    assert numbers.cell_reference("AB12") == (27, 11) and [numbers.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with one level of storages; streams of at least 4096 bytes each, in whole sectors."""
    names, sectors, fat = [], [], []
    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    entries: list[list] = [["Root Entry", 5, 0xFFFFFFFE, 0, []]]
    for f in folders:
        entries.append([f, 1, 0, 0, []])
        entries[0][4].append(len(entries) - 1)
    for n, data in streams.items():
        data = data.ljust(4096, b"\0")
        blocks = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        start = len(sectors)
        sectors += blocks
        fat += [start + k + 1 for k in range(len(blocks) - 1)] + [0xFFFFFFFE]
        entries.append([n.split("/")[-1], 2, start, len(data), []])
        owner = folders.index(n.split("/")[0]) + 1 if "/" in n else 0
        entries[owner][4].append(len(entries) - 1)
    right = [0xFFFFFFFF] * len(entries)
    for e in entries:
        for a, b in zip(e[4], e[4][1:], strict=False):
            right[a] = b
    raw = b""
    for n, (name, kind, start, size, children) in enumerate(entries):
        wide = name.encode("utf-16-le")
        raw += wide.ljust(64, b"\0") + struct.pack("<HBBIII", len(wide) + 2, kind, 1, 0xFFFFFFFF, right[n], children[0] if children else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)
    blocks = [raw[i : i + 512].ljust(512, b"\0") for i in range(0, len(raw), 512)]
    root = len(sectors)
    sectors += blocks
    fat += [root + k + 1 for k in range(len(blocks) - 1)] + [0xFFFFFFFE]
    count = 1
    while (len(fat) + count) > 128 * count:
        count += 1
    table = fat + [0xFFFFFFFD] * count
    table += [0xFFFFFFFF] * (128 * count - len(table))
    first = len(sectors)
    sectors += [struct.pack("<128I", *table[128 * k : 128 * k + 128]) for k in range(count)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, count, root, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, first)
    head = head + struct.pack(f"<{108}I", *[first + k if k < count else 0xFFFFFFFF for k in range(1, 109)])
    return head.ljust(512, b"\0") + b"".join(sectors)


def test_compound_file():
    from sheaf.containers.cfb import CompoundFile

    f = CompoundFile(compound({"A": b"x" * 5000, "Dir/B": b"y" * 4096}))
    assert f.read("a").startswith(b"x" * 5000) and f.read("Dir/B") == b"y" * 4096 and not f.has("C") and "Dir/B" in f.paths()
    for n in range(0, 3000, 97):
        try:
            CompoundFile(compound({"A": b"x" * 5000})[:n])
        except ValueError:
            pass


def test_xls():
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode()
    sst = record(0xFC, struct.pack("<II", 2, 2) + text("alpha") + struct.pack("<HB", 6, 0) + b"be") + record(0x3C, b"\1" + "ta|!".encode("utf-16-le"))
    sheet = record(0x809, b"\0" * 16) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 1, 45000.0)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, 1234 << 2 | 3)) + record(0x205, struct.pack("<HHHBB", 2, 0, 0, 1, 0)) + record(0x06, struct.pack("<HHHd", 2, 1, 0, 2.5) + b"\0" * 8) + record(0x0A, b"")
    styles = record(0xE0, struct.pack("<HH", 0, 0)) + record(0xE0, struct.pack("<HH", 0, 14))
    begin = record(0x809, b"\0" * 16)
    for at in (0, None):
        where = at if at is not None else len(begin + bound + styles + sst + record(0x0A, b""))
        bound = record(0x85, struct.pack("<IBBBB", where, 0, 0, 4, 0) + b"Data")
    data = compound({"Workbook": begin + bound + styles + sst + record(0x0A, b"") + sheet})
    assert convert.markdown(data, "a.xls") == "## Data\n\n| alpha | beta\\|! |\n| --- | --- |\n| 2023-03-15 | 12.34 |\n| TRUE | 2.5 |\n\n"
    assert xls.rk(0x40590000 | 0) == 100.0 and xls.rk((-5 << 2 & 0xFFFFFFFF) | 2) == -5


def test_xls_shows_every_digit():
    values = [100000.5, 1234567.25, 0.1 + 0.2, -0.0, 1e-10, 20000.5, 1e15]
    assert [numbers.general(v) for v in values] == ["100000.5", "1234567.25", "0.3", "0", "1e-10", "20000.5", "1e+15"]
    assert [p.tables[0] for p in xls.pages(binaries.xls([[1100019.5, 7]]), Options(tables=True))] == [[["1100019.5", "7"]]]


def test_xlsb():
    rec = lambda kind, body: (bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])) + bytes([len(body)]) + body
    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    data = zipped([
        ("[Content_Types].xml", b"<Types>spreadsheetml binaryFormat</Types>"), ("xl/workbook.bin", rec(156, struct.pack("<II", 0, 1) + wide("r1") + wide("S"))),
        ("xl/_rels/workbook.bin.rels", b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.bin"/></Relationships>'), ("xl/sharedStrings.bin", rec(19, b"\0" + wide("hey"))),
        ("xl/worksheets/sheet1.bin", rec(0, struct.pack("<I", 0)) + rec(7, struct.pack("<III", 0, 0, 0)) + rec(5, struct.pack("<IId", 1, 0, 2.5)) + rec(4, struct.pack("<IIB", 2, 0, 1))),
    ])
    assert convert.markdown(data, "a.xlsb") == "## S\n\n| hey | 2.5 | TRUE |\n| --- | --- | --- |\n\n"
    assert list(xlsb.records(b"\x80")) == []


def test_msg():
    wide = lambda s: s.encode("utf-16-le")
    data = compound({
        "__properties_version1.0": b"", "__substg1.0_0037001F": wide("Hello"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_0C1F001F": wide("a@b"), "__substg1.0_1000001F": wide("Body"),
        "__recip_version1.0_#00000000/__substg1.0_3001001F": wide("Bob"), "__attach_version1.0_#00000000/__substg1.0_3707001F": wide("f.txt"),
    })
    text = convert.markdown(data, "x.msg")
    assert text.startswith("# Hello\n\n- **From:** Ann <a@b>\n- **To:** Bob\n\n---\n\nBody") and text.endswith("**첨부(1)**: f.txt\n")


def test_ppt():
    rec = lambda kind, body, version=0, instance=0: struct.pack("<HHI", version | instance << 4, kind, len(body)) + body
    text = rec(0x0F9F, struct.pack("<I", 0)) + rec(0x0FA0, "Title".encode("utf-16-le")) + rec(0x0F9F, struct.pack("<I", 1)) + rec(0x0FA8, b"one\rtwo")
    stream = rec(0x03E8, rec(0x0FF0, rec(0x03F3, b"\0" * 20) + text, 15), 15)
    assert convert.markdown(compound({"PowerPoint Document": stream, "Current User": b"\0" * 20}), "a.ppt") == "--- Page 1 ---\n\n# Title\n\none\ntwo\n\n"


def test_doc():
    body = "Title\r\rText \x13 HYPERLINK \"http://u\" \x14here\x15 end.\rcell\x07two\x07\x07"
    fib = bytearray(0x1AA)
    struct.pack_into("<HH", fib, 0, 0xA5EC, 0xC1)
    raw = body.encode("cp1252")
    pieces = b"\2" + struct.pack("<I", 16) + struct.pack("<II", 0, len(raw)) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0)
    struct.pack_into("<II", fib, 0x1A2, 0, len(pieces))
    word = bytes(fib).ljust(0x400, b"\0") + raw
    md = doc.markdown(compound({"WordDocument": word, "0Table": pieces}))
    assert "## Title" in md and "Text [here](http://u) end." in md and "| cell | two |" in md


def hwp_record(tag: int, level: int, body: bytes) -> bytes:
    return struct.pack("<I", tag | level << 10 | min(len(body), 0xFFF) << 20) + (struct.pack("<I", len(body)) if len(body) >= 0xFFF else b"") + body


def test_hwp5():
    para = lambda text, level, shape=0: hwp_record(0x42, level, struct.pack("<IIHBB", len(text) + 1, 0, shape, 0, 0)) + hwp_record(0x43, level + 1, (text + "\r").encode("utf-16-le"))
    cell = lambda c, r, text, level: hwp_record(0x48, level, struct.pack("<HIHHHHH", 1, 0, 0, c, r, 1, 1)) + para(text, level)
    table = hwp_record(0x42, 0, b"\0" * 12) + hwp_record(0x47, 1, b" lbt") + hwp_record(0x4D, 2, struct.pack("<IHH", 0, 1, 2)) + cell(0, 0, "A", 2) + cell(1, 0, "B|", 2)
    info = hwp_record(0x19, 0, struct.pack("<I", 0)) + hwp_record(0x19, 0, struct.pack("<I", 1 << 23 | 1 << 25))
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    pack = lambda b: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(b) + c.flush()
    data = compound({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 1), "DocInfo": pack(info), "BodyText/Section0": pack(para("제목", 0, 1) + para("본문", 0) + table)})
    assert raw and convert.kind_of(data, "a.hwp") == "HWP"
    text = convert.markdown(data, "a.hwp")
    assert text.startswith("## 제목\n\n본문\n\n") and "| A | B\\| |" in text
    assert list(hwp.pages(data, Options(pages=(1,)))) == []


def test_hwpx():
    ns = 'xmlns:hp="p" xmlns:hh="h" xmlns:hs="s"'
    head = f'<hh:head {ns}><hh:charPr id="0" height="1000"/><hh:charPr id="1" height="2000"><hh:bold/></hh:charPr></hh:head>'
    cell = lambda c, t: f'<hp:tc><hp:subList><hp:p><hp:run charPrIDRef="0"><hp:t>{t}</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="{c}" rowAddr="0"/></hp:tc>'
    body = f'<hs:sec {ns}><hp:p><hp:run charPrIDRef="1"><hp:t>Head</hp:t></hp:run></hp:p><hp:p><hp:run charPrIDRef="0"><hp:t>body text<hp:lineBreak/>more</hp:t></hp:run></hp:p><hp:p><hp:run charPrIDRef="0"><hp:tbl rowCnt="1" colCnt="2"><hp:tr>{cell(0, "a")}{cell(1, "b")}</hp:tr></hp:tbl></hp:run></hp:p></hs:sec>'
    data = zipped([("mimetype", b"application/hwp+zip"), ("Contents/header.xml", head.encode()), ("Contents/section0.xml", body.encode())])
    assert convert.markdown(data, "a.hwpx") == "--- Page 1 ---\n\n# Head\n\nbody text\nmore\n\n| a | b |\n| --- | --- |\n\n"


def test_hwp3():
    def para(codes: list[int]) -> bytes:
        units = codes + [13]
        return struct.pack("<BHHBBIB", 1, len(units), 0, 0, 0, 0, 0) + b"\0" * 31 + b"".join(struct.pack("<H", c) for c in units)

    end = struct.pack("<BHHBBIB", 0, 0, 0, 0, 0, 0, 0) + b"\0" * 31
    johab = int.from_bytes("한".encode("johab"), "big")
    body = b"\0\0" * 7 + b"\0\0" + para([ord("H"), johab]) + para([ord("x"), 31, 31, ord("y")]) + end
    data = b"HWP Document File V3.00 \x1a\1\2\3\4\5" + b"\0" * 128 + b"\0" * 1008 + body
    assert hwp3.markdown(data) == "H한\n\nx y\n\n"
    assert convert.kind_of(data, "a.hwp") == "HWP3"
    with pytest.raises(ConversionError):
        hwp3.markdown(data[:1200])


def test_metafiles():
    head = struct.pack("<II", 1, 88) + b"\0" * 32 + b" EMF" + b"\0" * 44
    run = lambda x, y, s: struct.pack("<II", 84, 76 + len(s) * 2 + (4 - len(s) * 2 % 4) % 4) + b"\0" * 28 + struct.pack("<iiII", x, y, len(s), 76) + b"\0" * 24 + (s.encode("utf-16-le")).ljust((len(s) * 2 + 3) // 4 * 4, b"\0")
    emf = head + run(50, 10, "two") + run(0, 10, "one") + run(0, 90, "next") + struct.pack("<IIIII", 14, 20, 0, 0, 20)
    assert convert.markdown(emf, "a.emf") == "one two\nnext\n"
    text = struct.pack("<H", 5) + b"hello\0" + struct.pack("<hh", 4, 3)
    wmf = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + struct.pack("<IH", 3 + len(text) // 2, 0x521) + text + struct.pack("<IH", 3, 0)
    assert convert.markdown(b"\xd7\xcd\xc6\x9a" + b"\0" * 18 + wmf, "a.wmf") == "hello\n"
    assert metafiles.emf_runs(b"\1\0\0\0") == []


def make_pdf(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    out, at = b"%PDF-1.5\n", {}
    for n, o in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    size = max(objects) + 1
    rows = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size))
    return out + b"xref\n0 %d\n" % size + rows + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (size, trailer, len(out))


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


def one_page(content: bytes, extra: bytes = b"", **more: bytes) -> dict[int, bytes]:
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R " + more.get("catalog", b"") + b">>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> " + extra + b">>", 4: stream(zlib.compress(content), b"/Filter /FlateDecode"),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
    }


BODY = b"BT /F1 10 Tf 72 700 Td (Plain body text goes here for a while) Tj 0 -12 Td (and goes on in a second line of it) Tj ET "


def test_pdf_headings_links_and_rest():
    objects = one_page(
        b"BT /F1 20 Tf 72 740 Td (Top heading) Tj ET " + BODY + b"BT /F1 10 Tf 300 30 Td (- 3 -) Tj ET", b"/Annots [7 0 R 8 0 R]",
        catalog=b"/Outlines 9 0 R /Names << /EmbeddedFiles << /Names [(a) 11 0 R] >> >>",
    ) | {
        7: b"<< /Subtype /Link /Rect [70 695 200 712] /A << /URI (http://u) >> >>", 8: b"<< /Subtype /Text /Contents (a note) >>", 9: b"<< /First 10 0 R >>", 10: b"<< /Title (Begin) /Dest [3 0 R /Fit] >>",
        11: b"<< /F (f.txt) /EF << /F 12 0 R >> /Desc (about) >>", 12: stream(b"x" * 2048),
    }
    for data in (make_pdf(objects), make_pdf(objects).replace(b"startxref", b"startxxxx"), b"junk\n" + make_pdf(objects)):
        md = convert.markdown(data, "a.pdf")
        assert md.startswith("## Table of Contents\n\n- Begin *(p.1)*\n\n## Attachments\n\n- f.txt (2.0 KB) — about\n\n--- Page 1 ---\n\n# Top heading\n\nPlain body text goes here for a while\nand goes on in a second line of it\n\n")
        assert "**Links:**\n- [Plain body text goes here for a while](http://u)\n" in md and "**Notes:**\n> a note\n" in md and "- 3 -" not in md
    assert list(pdf.pages(make_pdf(objects), Options(pages=(5,)))) == []


def test_pdf_ruled_table():
    rules = b"".join(b"%d 500 m %d 560 l S " % (x, x) for x in (72, 172, 272)) + b"".join(b"72 %d m 272 %d l S " % (y, y) for y in (500, 530, 560))
    cells = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x, y, t) for x, y, t in ((80, 540, b"k"), (180, 540, b"v"), (80, 510, b"one"), (180, 510, b"1")))
    (page,) = list(convert.pages(make_pdf(one_page(BODY + rules + cells)), "a.pdf"))
    assert page.tables == [[["k", "v"], ["one", "1"]]] and "| k   | v   |\n| --- | --- |\n| one | 1   |\n" in page.text
    (plain,) = list(convert.pages(make_pdf(one_page(BODY + rules + cells)), "a.pdf", Options("text")))
    assert not plain.tables and "one" in plain.text


def test_pdf_unicode_map_and_object_streams():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <D55C> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange endcmap"
    objects = one_page(b"BT /F1 12 Tf 72 700 Td <000100020003> Tj ET")
    objects[5] = b"<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /Subtype /CIDFontType2 /DW 1000 >>] /ToUnicode 7 0 R >>"
    objects[7] = stream(cmap)
    assert "한AB" in convert.markdown(make_pdf(objects), "a.pdf")
    inner = [(n, objects.pop(n)) for n in (1, 2, 3, 5)]
    head, body = "", b""
    for n, o in inner:
        head += f"{n} {len(body)} "
        body += o + b" "
    objects[8] = stream(zlib.compress(head.encode() + body), b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(head))
    assert "한AB" in convert.markdown(make_pdf(objects).replace(b"startxref", b"xx"), "a.pdf")


def test_pdf_filters():
    text = b"The same text again and again and again."
    assert pdf_core._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), {}) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf_core._ascii85(base64.a85encode(text) + b"~>", {}) == text and pdf_core._ascii_hex(text.hex().encode() + b">", {}) == text
    assert pdf_core._runs(bytes([2, 65, 66, 67, 254, 68, 128]), {}) == b"ABCDDD"
    rows = b"\1\1\1\1" + b"\2\1\1\1"
    assert pdf_core._predicted(rows, {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])


def test_ciphers():
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert pdf_crypt.Aes(key).block_in(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert pdf_crypt.Aes(key).block_out(bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")) == block
    long = pdf_crypt.Aes(bytes(range(32)))
    assert long.block_in(block).hex() == "8ea2b7ca516745bfeafc49904b496089" and long.block_out(long.block_in(block)) == block


def test_encrypted_pdf():
    import hashlib

    ident, owner = b"0123456789abcdef", b"\7" * 32
    key = hashlib.md5(pdf_crypt.PAD + owner + struct.pack("<i", -4) + ident).digest()[:5]
    objects = one_page(b"")
    own = hashlib.md5(key + struct.pack("<I", 4)[:3] + b"\0\0").digest()[:10]
    objects[4] = stream(pdf_crypt.rc4(own, zlib.compress(b"BT /F1 12 Tf 72 700 Td (secret words) Tj ET")), b"/Filter /FlateDecode")
    objects[7] = b"<< /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >>" % (owner.hex().encode(), pdf_crypt.rc4(key, pdf_crypt.PAD).hex().encode())
    data = make_pdf(objects, b"/Root 1 0 R /Encrypt 7 0 R /ID [<%s> <%s>]" % (ident.hex().encode(), ident.hex().encode()))
    assert "secret words" in convert.markdown(data, "a.pdf")
    with pytest.raises(ConversionError, match="encrypted"):
        convert.markdown(data.replace(pdf_crypt.rc4(key, pdf_crypt.PAD).hex().encode(), b"00" * 32), "a.pdf")


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 5000), st.binary(max_size=6))
def test_damaged_pdfs_end_as_errors(at, junk):
    data = make_pdf(one_page(BODY))
    at %= len(data)
    text, error = convert.safe_markdown(data[:at] + junk + data[at + len(junk) :], "a.pdf", Options())
    assert (text is None) != (error is None)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["doc", "xls", "ppt", "msg", "hwp", "rtf", "eml", "html", "emf", "wmf", "pdf", "docx", "txt", "bin", "xlsb"]))
def test_hostile_bytes_end_as_errors(data, ext):
    heads = {"doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "hwp": b"HWP Document File V3.00", "rtf": b"{\\rtf1 ", "emf": b"\1\0\0\0", "wmf": b"\xd7\xcd\xc6\x9a", "pdf": b"%PDF-1.4\n"}
    text, error = convert.safe_markdown(heads.get(ext, b"") + data, f"a.{ext}", Options())
    assert (text is None) != (error is None)


def test_options():
    with pytest.raises(ValueError, match="negative"):
        Options(pages=(-1,))
    with pytest.raises(ValueError, match="format"):
        Options("docx")


def test_charsets():
    assert charsets.plain_text("한글".encode("cp949")) == "한글" and charsets.by_label(b"\x93x\x94", "Windows-1252") == "“x”"
    assert charsets.utf16(b"a\0\0") == "a" and charsets.charset_of_label("UTF_16BE") == "utf-16-be"


def test_image_sizes():
    assert images.dimensions(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert images.dimensions(b"\xff\xd8\xff\xe0\0\4\0\0\xff\xc0\0\x0b\x08\0\5\0\6" + b"\0" * 9) == (6, 5)
    assert images.extension_to_save(".png/../x", "jpeg") == ".jpg" and images.extension_to_save(".webp", "bin") == ".webp"


def test_gzipped_tar_is_made_here():
    assert gzip.decompress(gzip.compress(tarred([("a", b"b")])))[257:262] == b"ustar"


def test_pdf_aligned_table_and_pixels():
    cells = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x, 400 - 14 * r, t) for r, row in enumerate(((b"Name", b"Count", b"Unit"), (b"apple", b"3", b"kg"), (b"pear", b"14", b"kg"), (b"plum", b"5", b"g"))) for x, t in zip((72, 200, 320), row, strict=True))
    objects = one_page(BODY + cells + b"q 100 0 0 100 72 100 cm /I Do Q")
    objects[3] = objects[3].replace(b"/Resources << ", b"/Resources << /XObject << /I 7 0 R >> ")
    objects[7] = stream(zlib.compress(bytes(range(60)) * 200), b"/Subtype /Image /Width 80 /Height 50 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode")
    (page,) = list(convert.pages(make_pdf(objects), "a.pdf"))
    assert page.tables == [[["Name", "Count", "Unit"], ["apple", "3", "kg"], ["pear", "14", "kg"], ["plum", "5", "g"]]]
    assert page.images[0].format == "png" and images.dimensions(page.images[0].data) == (80, 50) and "![page1_img0](page1_img0.png)" in page.text


def test_png():
    from sheaf.parsers import png

    made = png.encoded(2, 1, 3, bytes([1, 2, 3, 4, 5, 6]))
    assert images.dimensions(made) == (2, 1) and zlib.decompress(made[41 : 41 + struct.unpack(">I", made[33:37])[0]]) == bytes([0, 1, 2, 3, 4, 5, 6])
    bitmap = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([3, 2, 1, 6, 5, 4, 0, 0])
    assert png.of_bitmap(bitmap) == made and png.of_bitmap(b"BM") == b""
    assert png.unpacked(bytes([0b10100000]), 3, 1, 1) == bytes([1, 0, 1])


def test_pictures_of_old_office():
    from sheaf.parsers import escher

    picture = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 64, 80)
    rec = lambda kind, body, version=0, instance=0: struct.pack("<HHI", version | instance << 4, kind, len(body)) + body
    one = rec(0xF01E, b"\0" * 17 + picture, 0, 0x6E0)
    entry = rec(0xF007, b"\0" * 36 + one, 2)
    group = rec(0xF000, rec(0xF001, entry, 15), 15)
    assert escher.blips(group) == [("png", picture)]
    sheet = record(0x809, b"\0" * 16) + record(0x203, struct.pack("<HHHd", 0, 0, 0, 1.0)) + record(0x0A, b"")
    for at in (0, None):
        where = at if at is not None else len(begin + bound + record(0xEB, group) + record(0x0A, b""))
        begin, bound = record(0x809, b"\0" * 16), record(0x85, struct.pack("<IBBBB", where, 0, 0, 1, 0) + b"S")
    (page,) = list(convert.pages(compound({"Workbook": begin + bound + record(0xEB, group) + record(0x0A, b"") + sheet}), "a.xls"))
    assert page.images[0].data == picture and page.text.endswith("![page1_img0](page1_img0.png)\n\n")
    shape = rec(0xF002, rec(0xF004, rec(0xF00B, struct.pack("<HI", 0x4104, 1), 3, 1), 15), 15)
    slide = rec(0x03EE, rec(0x040C, shape, 15), 15)
    document = rec(0x03E8, rec(0x040B, rec(0xF000, rec(0xF001, rec(0xF007, b"\0" * 36, 2), 15), 15), 15), 15)
    (page,) = list(convert.pages(compound({"PowerPoint Document": document + slide, "Pictures": one, "Current User": b"\0" * 20}), "a.ppt"))
    assert page.images[0].data[: len(picture)] == picture and "![page1_img0](page1_img0.png)" in page.text


def test_entities_after_a_long_prolog():
    from sheaf.parsers import xml

    plain = b"<?xml version='1.0'?><!-- " + b"x" * 200_000 + b" --><!DOCTYPE r [<!ELEMENT r ANY>]><r>&lt;!ENTITY</r>"
    declared = plain.replace(b"<!ELEMENT r ANY>", b"<!ENTITY a 'aaaa'>")
    assert xml.parse(plain).text == "<!ENTITY" and xml.parse(declared) is None
    assert xml.declares_entities(declared.decode().encode("utf-16")) and not xml.declares_entities(b"")


def test_text_is_strict_utf8_up_to_a_cut():
    from sheaf.formats import looks_like_text

    for whole in ("é".encode(), "€".encode(), "😀".encode()):
        assert all(looks_like_text(b"a" + whole[:n]) for n in range(1, len(whole) + 1))
    assert not any(map(looks_like_text, (b"a\0", b"\xc0\x80", b"\xed\xa0\x80", b"\xe0\x80", b"\x80", b"a\xff")))


def test_sheets_are_streamed():
    """Memory doesn't grow with the rows of a part; entities and deep nesting end it."""
    import tracemalloc

    from sheaf.containers.zips import ZipFileReader
    from sheaf.parsers import xml

    def peak(rows: int) -> int:
        body = "".join(f'<row r="{n}"><c r="A{n}"><v>{n}</v></c></row>' for n in range(1, rows + 1))
        z = ZipFileReader(zipped([("s.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>".encode())]))
        tracemalloc.start()
        assert sum(1 for _ in xml.streamed(z, "s.xml", "c")) == rows
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(200_000) < 2 * peak(20_000) + (4 << 20)
    made = lambda text: [xml.text_of(v) for v in xml.streamed(ZipFileReader(zipped([("s.xml", text.encode())])), "s.xml", "v")]
    assert made("<a><v>1</v><b><v>2</v></b></a>") == ["1", "2"] and made("<!DOCTYPE a [<!ENTITY e 'x'>]><a><v>&e;</v></a>") == []
    assert made("<a><v>1</v>" + "<b>" * 1000 + "<v>2</v>") == ["1"] and made("<a><v>1</v><v>2") == ["1"]


def test_jbig2_coder_on_the_published_sequence():
    from sheaf.parsers.jbig2 import Arithmetic, Unsupported, decoded

    coder, contexts = Arithmetic(bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")), [0]
    bits = "".join(str(coder.bit(contexts, 0)) for _ in range(256))
    assert f"{int(bits, 2):064x}" == "00020051000000c00352872aaaaaaaaa82c02000fcd79ef6bf7fed904f46a3bf"
    for junk in (b"", b"\0" * 40, bytes(range(200)), struct.pack(">IBBBI", 1, 38, 0, 1, 18) + b"\1" * 18, struct.pack(">IBBBI", 1, 0, 0, 1, 30) + b"\0" * 30):
        try:
            assert len(decoded(junk, b"", 9, 4)) == 8
        except Unsupported:
            pass


@pytest.mark.parametrize("template", range(4))
def test_jbig2_pictures(template):
    import random

    from sheaf.parsers.jbig2 import decoded
    from sheaf.plans import binaries

    rnd = random.Random(template)
    for wide, high in ((1, 1), (17, 9), (64, 40), (130, 5)):
        rows = [bytes(int(rnd.random() < 0.3) for _ in range(wide)) for _ in range(high)]
        want = b"".join((int(bytes(b + 48 for b in r), 2) << -wide % 8).to_bytes((wide + 7) // 8, "big") for r in rows)
        assert decoded(binaries.jbig2(rows, template), b"", wide, high) == want


@pytest.mark.parametrize("k", [-1, 0])
def test_fax_pictures(k):
    import random

    from sheaf.parsers import ccitt
    from sheaf.plans import binaries

    for words in (ccitt.WHITE + ccitt.LONG, ccitt.BLACK + ccitt.LONG, list(ccitt.MODES)):
        assert not any(b.startswith(a) for a, b in zip(sorted(words), sorted(words)[1:], strict=False))
    rnd = random.Random(k)
    for _ in range(60):
        wide, rows = rnd.choice([1, 7, 8, 33, 1728, 3000]), []
        for _ in range(rnd.choice([1, 2, 9])):
            row, colour = bytearray(), rnd.randrange(2)
            while len(row) < wide:
                row += bytes([colour]) * rnd.choice([1, 2, 3, 10, 70, 700])
                colour ^= 1
            rows.append(rows[-1] if rows and rnd.random() < 0.4 else bytes(row[:wide]))
        want = b"".join((int(bytes(b + 48 for b in r), 2) << -wide % 8).to_bytes((wide + 7) // 8, "big") for r in rows)
        assert ccitt.decoded(binaries.fax(rows, wide, k), wide, len(rows), k, black_is_1=True) == (want, len(rows))
    for junk in (b"", b"\0" * 50, bytes(range(256))):
        assert ccitt.decoded(junk, 100, 10, k)[1] <= 10
