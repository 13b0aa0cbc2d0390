"""Detection of what containers hold, walks and their options, pictures by reference, and the reading order of pages."""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..containers.walk import Limits
from ..functions import udf
from ..operators import tables
from ..parsers import png
from ..parsers.base import Options
from . import binaries, synthetic
from .features import _A, _W, _docx, _markdown, _paragraph
from .registry import query, table
from .roundtrips import _grouped, _sheets, _walked_as
from .synthetic import _made, zipped

_KINDS = ["DOCX", "XLSX", "PPTX", "ODT", "ODS", "ODP", "HWPX", "ZIP", "DOC", "XLS", "PPT", "MSG", "HWP", "ENCRYPTED_PASSWORD", "ENCRYPTED_RIGHTS"]


def _container(kind: str) -> bytes:
    types = lambda x: ("[Content_Types].xml", f"<Types>{x}</Types>".encode())
    made = {
        "DOCX": lambda: zipped([types("wordprocessingml"), ("word/document.xml", b"<x/>")]), "XLSX": lambda: synthetic.typed_xlsx([["a"]]), "PPTX": lambda: zipped([types("presentationml"), ("ppt/presentation.xml", b"<p/>")]),
        "ODT": lambda: synthetic._odf("text", ""), "ODS": lambda: synthetic._odf("spreadsheet", ""), "ODP": lambda: synthetic._odf("presentation", ""), "HWPX": lambda: zipped([("mimetype", b"application/hwp+zip"), ("Contents/section0.xml", b"<x/>")]),
        "ZIP": lambda: zipped([("a.txt", b"x")]), "DOC": lambda: binaries.doc("x\r"), "XLS": lambda: binaries.xls([["a"]]), "PPT": lambda: binaries.ppt([("a", "b")]), "MSG": lambda: binaries.msg("a", "b", "c", "d", "e"),
        "HWP": lambda: binaries.hwp5(["x"]), "ENCRYPTED_PASSWORD": lambda: binaries.compound({"EncryptedPackage": b"x", "EncryptionInfo": b"y"}), "ENCRYPTED_RIGHTS": lambda: binaries.compound({"EncryptedPackage": b"x"}),
    }
    return made[kind]()


@query(f"SELECT n_nationkey, {_KINDS}[n_nationkey % {len(_KINDS)} + 1] AS format FROM nation")
def detect_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a name, told apart by what their container holds."""
    made = _made(lambda n: _container(_KINDS[n % len(_KINDS)]), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", udf.detect(made, F.lit("")).alias("format"))


@query("SELECT source, doc_id || '.txt' AS member_path, CASE WHEN strlen(text) > 2000 THEN 'member exceeds max_member_bytes limit (2000 bytes, member is at least ' || strlen(text) || ' bytes); skipped — raise max_member_bytes (--max-member-mb)' ELSE '' END AS error FROM documents")
def archive_limit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members")).alias("content"))
    return tables.archive_members(files, name="name", keep=["source"], limits=Limits(max_member_bytes=2000)).select("source", "member_path", "error")


@query("SELECT n_nationkey, 't' || n_nationkey || '.txt' AS member_path, n_name AS markdown, 'TXT' AS format FROM nation UNION ALL SELECT n_nationkey, 'p.gif', '![p.gif](p.gif)', 'IMAGE' FROM nation WHERE n_nationkey % 2 = 0")
def archive_skips_and_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs, films and fonts aren't unpacked; pictures only where images are wanted."""
    def build(key: int, name: str) -> bytes:
        return zipped([("a.exe", b"MZ"), ("b.mp4", b"x"), ("c.ttf", b"x"), (f"t{key}.txt", name.encode()), ("p.gif", _gif(60, 70))])

    files = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("a.zip").alias("name"), _made(build, F.col("n_nationkey"), F.col("n_name")).alias("content"))
    walked = [tables.archive_members(files.where(F.col("n_nationkey") % 2 == odd), name="name", keep=["n_nationkey"], options=Options(images=not odd)) for odd in (0, 1)]
    return walked[0].union(walked[1]).select("n_nationkey", "member_path", F.rtrim("markdown").alias("markdown"), "format").withColumn("markdown", F.regexp_replace("markdown", "\n$", ""))


def _gif(wide: int, high: int) -> bytes:
    return b"GIF89a" + struct.pack("<HH", wide, high) + b"\0" * 20


@query("SELECT n_nationkey, 'f.html' AS member_path, 'x' || chr(10) || chr(10) || '![image](f.html/page1_img0.gif)' AS markdown FROM nation")
def archive_image_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a member are referred to below the member's path."""
    build = lambda n: zipped([("f.html", f"<p>x</p><img src='data:image/gif;base64,{base64.b64encode(_gif(60 + n, 70)).decode()}'>".encode())])
    files = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("a.zip").alias("name"), _made(build, F.col("n_nationkey")).alias("content"))
    return tables.archive_members(files, name="name", keep=["n_nationkey"]).select("n_nationkey", "member_path", "markdown")


@query("SELECT source, '나라/' || doc_id || '.txt' AS member_path, text AS markdown FROM documents WHERE text <> ''")
def legacy_member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the Korean code page."""
    named = lambda m: F.transform(m, lambda x: F.struct(F.concat(F.lit("나라/"), x["name"]).alias("name"), x["text"].alias("text")))
    return _walked_as(spark, sf_dir, lambda m: synthetic.alz(named(m)), "a.alz")


@query("SELECT n_nationkey, 'gif' AS format, (60 + n_nationkey)::BIGINT AS width, 70::BIGINT AS height FROM nation WHERE n_nationkey >= 5")
def html_data_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures within a page, with the sizes their data tell; those below the least size left out."""
    build = lambda n: f"<p>x</p><img alt='a' src='x.png'><img src='data:image/gif;base64,{base64.b64encode(_gif(60 + n, 70)).decode()}'>".encode()
    files = table(spark, sf_dir, "nation").select("n_nationkey", _made(build, F.col("n_nationkey")).alias("content"), F.lit("a.html").alias("name"))
    return tables.document_images(files, name="name", keep=["n_nationkey"], options=Options(min_image_size=65)).where(F.octet_length("data") > 0).select("n_nationkey", "format", "width", "height")


@query("SELECT n_nationkey, '![a](x' || n_nationkey || '.png)![image](y.png)' || chr(10) || chr(10) || '**' || n_name || chr(10) || ': D' || chr(10) || chr(10) || '[l](http://u)' || chr(10) || chr(10) AS markdown FROM nation")
def html_attributes_and_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda k, v: f"<img alt='a' src='x{k}.png'><img src=\"y.png\"><dl><dt>{v}</dt><dd>D</dd></dl><p data-href='no'><a href=\"http://u\">l</a></p>".encode()
    return _markdown(table(spark, sf_dir, "nation"), "n_nationkey", "a.html", build, F.col("n_nationkey"), F.col("n_name"))


@query("SELECT n_nationkey, '![p.gif](p.gif)' || chr(10) AS picture, n_name || chr(65533) AS broken FROM nation")
def pictures_and_broken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture file is a reference to itself; bytes that aren't UTF-8 become the replacement character."""
    md = lambda build, column, name: udf.to_markdown(_made(build, F.col(column)), F.lit(name)).getField("markdown")
    page = md(lambda v: b"<meta charset=utf-8><p>" + v.encode() + b"\xff</p>", "n_name", "a.html")
    return table(spark, sf_dir, "nation").select("n_nationkey", md(lambda n: _gif(60 + n, 70), "n_nationkey", "dir/p.gif").alias("picture"), F.regexp_replace(page, r"\s+$", "").alias("broken"))


@query("SELECT n_nationkey, '--- Page 1 ---' || chr(10) || chr(10) || 'inside' || chr(10) || chr(10) || n_name || chr(10) || chr(10) AS markdown FROM nation")
def docx_controls_without_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content controls and alternatives hold; tables only where they are wanted."""
    def build(name: str) -> bytes:
        chosen = f'<mc:AlternateContent xmlns:mc="m"><mc:Choice>{_paragraph(name)}</mc:Choice><mc:Fallback>{_paragraph("other")}</mc:Fallback></mc:AlternateContent>'
        return _docx(f"<w:sdt><w:sdtContent>{_paragraph('inside')}</w:sdtContent></w:sdt><w:tbl><w:tr><w:tc>{_paragraph('cell')}</w:tc></w:tr></w:tbl>{chosen}")

    return _markdown(table(spark, sf_dir, "nation"), "n_nationkey", "a.docx", build, F.col("n_name"), options=Options(tables=False))


_FORMATTED = "SELECT p_partkey, format('{:.2f}', p_size / 4.0) AS fixed, format('{:.2f}', p_size / 4.0) || '%' AS share, format('{:,.2f}', p_partkey * 1000.25) AS grouped, format('{:.3f}', p_size / 8.0) AS custom FROM part"


@query(_FORMATTED)
def xlsx_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as their cell's format shows them: fixed, shares, groups, and a format of its own."""
    styles = '<styleSheet><numFmts><numFmt numFmtId="165" formatCode="0.000"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 2, 10, 4, 165)) + "</cellXfs></styleSheet>"

    def build(rows: list[dict]) -> bytes:
        cells = lambda n, r: f'<c r="A{n}"><v>{r["key"]}</v></c>' + "".join(f'<c r="{c}{n}" s="{s}"><v>{v!r}</v></c>' for s, (c, v) in enumerate(zip("BCDE", (r["size"] / 4, r["size"] / 400, r["key"] * 1000.25, r["size"] / 8), strict=True), 1))
        body = "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1))
        return zipped([*synthetic.sheet_parts(body), ("xl/styles.xml", styles.encode())])

    part = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("parcel")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))).alias("rows"))
    found = tables.table_cells(part.select("parcel", _made(build, F.col("rows")).alias("content")), keep=["parcel"])
    value = lambda c: F.max(F.when(F.col("column_no") == c, F.col("value")))
    return found.groupBy("parcel", "row_no").agg(value(0).cast("long").alias("p_partkey"), *(value(c).alias(n) for c, n in enumerate(("fixed", "share", "grouped", "custom"), 1))).drop("parcel", "row_no")


@query("SELECT n_nationkey, '# ' || n_name || ' heading of' || ' two lines' AS heading, string_agg('left ' || k || ' of ' || n_name || ' with words', chr(10) ORDER BY k) || chr(10) || string_agg('right ' || k || ' of ' || n_name || ' with words', chr(10) ORDER BY k) AS lines FROM nation, range(12) t(k) GROUP BY n_nationkey, n_name")
def pdf_columns_and_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns are read one after the other; a heading's lines are one."""
    def build(name: str) -> bytes:
        side = lambda x, word: b"".join(binaries.at(x, 690 - 14 * n, f"{word} {n} of {name} with words") for n in range(12))
        return binaries.pdf(binaries.page(binaries.at(72, 760, f"{name} heading of", 20) + binaries.at(72, 736, "two lines", 20) + side(72, "left") + side(330, "right")))

    made = udf.to_markdown(_made(build, F.col("n_name")), F.lit("a.pdf")).getField("markdown")
    md = table(spark, sf_dir, "nation").select("n_nationkey", F.filter(F.split(made, "\n"), lambda x: (x != "") & ~x.startswith("--- ")).alias("lines"))
    return md.select("n_nationkey", F.element_at("lines", 1).alias("heading"), F.array_join(F.slice("lines", F.lit(2), F.size("lines") - 1), "\n").alias("lines"))


@query("SELECT n_regionkey, row_no, column_no, value FROM (SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS row_no, 0::INTEGER AS column_no, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER, 1, n_name FROM nation)")
def hwpx_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(rows: list[list[str]]) -> bytes:
        cell = lambda r, c, t: f'<hp:tc><hp:subList><hp:p><hp:run charPrIDRef="0"><hp:t>{t}</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/></hp:tc>'
        grid = "".join("<hp:tr>" + "".join(cell(n, c, t) for c, t in enumerate(r)) + "</hp:tr>" for n, r in enumerate(rows))
        body = f'<hs:sec xmlns:hp="p" xmlns:hs="s"><hp:p><hp:run charPrIDRef="0"><hp:tbl rowCnt="{len(rows)}" colCnt="2">{grid}</hp:tbl></hp:run></hp:p></hs:sec>'
        return zipped([("mimetype", b"application/hwp+zip"), ("Contents/header.xml", b'<h><charPr id="0" height="1000"/></h>'), ("Contents/section0.xml", body.encode())])

    files = _sheets(spark, sf_dir).select("n_regionkey", _made(build, F.col("rows")).alias("content"), F.lit("a.hwpx").alias("name"))
    return tables.table_cells(files, name="name", keep=["n_regionkey"]).where("row_no > 0").select("n_regionkey", "row_no", "column_no", "value")


_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_BLIP = '<a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="r1"/>'


def _picture_file(kind: str, data: bytes) -> bytes:
    """A file of a kind that holds a PNG picture, DOCX twice."""
    rels = lambda target: f'<Relationships><Relationship Id="r1" Target="{target}"/></Relationships>'.encode()
    rec = lambda number, body, version=0, instance=0: struct.pack("<HHI", version | instance << 4, number, len(body)) + body
    if kind == "docx":
        drawn = f"<w:p><w:r><w:drawing>{_BLIP}</w:drawing></w:r></w:p>"
        parts = [("word/_rels/document.xml.rels", rels("media/image1.png")), ("word/media/image1.png", data)]
        return zipped([("[Content_Types].xml", b"<Types>wordprocessingml</Types>"), ("word/document.xml", f"<w:document {_W}><w:body>{drawn}{_paragraph('t')}{drawn}</w:body></w:document>".encode()), *parts])
    if kind == "pptx":
        slide = f'<p:sld {_A} {_REL}><p:cSld><p:spTree><p:pic><p:blipFill><a:blip r:embed="r1"/></p:blipFill></p:pic></p:spTree></p:cSld></p:sld>'
        parts = [("ppt/slides/slide1.xml", slide.encode()), ("ppt/slides/_rels/slide1.xml.rels", rels("../media/image1.png")), ("ppt/media/image1.png", data)]
        return zipped([("[Content_Types].xml", b"<Types>presentationml</Types>"), ("ppt/presentation.xml", b"<p/>"), *parts])
    if kind == "xlsx":
        parts = [("xl/worksheets/_rels/sheet1.xml.rels", rels("../drawings/drawing1.xml")), ("xl/drawings/drawing1.xml", f"<d {_REL}>{_BLIP}</d>".encode()), ("xl/drawings/_rels/drawing1.xml.rels", rels("../media/image1.png"))]
        return zipped([*synthetic.sheet_parts('<row r="1"><c r="A1"><v>1</v></c></row>'), *parts, ("xl/media/image1.png", data)])
    if kind == "ppt":
        blip = rec(0xF01E, b"\0" * 17 + data, 0, 0x6E0)
        slide = rec(0x03EE, rec(0x040C, rec(0xF002, rec(0xF004, rec(0xF00B, struct.pack("<HI", 0x4104, 1), 3, 1), 15), 15), 15), 15)
        document = rec(0x03E8, rec(0x040B, rec(0xF000, rec(0xF001, rec(0xF007, b"\0" * 36, 2), 15), 15), 15), 15)
        return binaries.compound({"PowerPoint Document": document + slide, "Pictures": blip, "Current User": b"\0" * 20})
    if kind == "hwpx":
        listed = b'<opf:package xmlns:opf="o"><opf:manifest><opf:item id="image1" href="BinData/image1.png"/></opf:manifest></opf:package>'
        body = b'<hs:sec xmlns:hp="p" xmlns:hs="s" xmlns:hc="c"><hp:p><hp:run charPrIDRef="0"><hp:pic><hc:img binaryItemIDRef="image1"/></hp:pic></hp:run></hp:p></hs:sec>'
        return zipped([("mimetype", b"application/hwp+zip"), ("Contents/header.xml", b'<h><charPr id="0" height="1000"/></h>'), ("Contents/content.hpf", listed), ("Contents/section0.xml", body), ("BinData/image1.png", data)])
    return b"{\\rtf1 text{\\pict\\pngblip\\picw60\\pich70 " + data.hex().encode() + b"}\\par}"


_HOLDERS = ["docx", "pptx", "xlsx", "ppt", "hwpx", "rtf"]


@query(f"SELECT n_nationkey, {_HOLDERS}[n_nationkey % {len(_HOLDERS)} + 1] AS kind, 'page1_img0' AS name, 'png' AS format, (60 + n_nationkey)::BIGINT AS width, 70::BIGINT AS height, md5(n_name) AS digest FROM nation")
def office_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of documents, each once; the first pixels carry a digest."""
    def build(key: int, name: str) -> bytes:
        pixels = hashlib.md5(name.encode()).digest().ljust((60 + key) * 70, b"\7")
        return _picture_file(_HOLDERS[key % len(_HOLDERS)], png.encoded(60 + key, 70, 1, pixels))

    kind = F.element_at(F.array(*map(F.lit, _HOLDERS)), (F.col("n_nationkey") % len(_HOLDERS) + 1).cast("int"))
    files = table(spark, sf_dir, "nation").select("n_nationkey", kind.alias("kind"), F.concat(F.lit("a."), kind).alias("file"), _made(build, F.col("n_nationkey"), F.col("n_name")).alias("content"))
    found = tables.document_images(files, name="file", keep=["n_nationkey", "kind"])
    digest = F.lower(F.hex(_made(lambda d: binaries.png_rows(d)[1:17] if d[:4] == b"\x89PNG" else b"", F.col("data"))))
    return found.select("n_nationkey", "kind", "name", "format", "width", "height", digest.alias("digest"))


@query("SELECT n_nationkey, p.page_number, CASE WHEN p.page_number = 1 THEN '--- Page 1 ---' || chr(10) || chr(10) || '# ' || n_name || chr(10) || chr(10) ELSE chr(10) || '--- Slide Master / Layout ---' || chr(10) || chr(10) || 'master of ' || n_name || chr(10) || 'layout' || chr(10) END AS text FROM nation, (VALUES (1::INTEGER), (2)) AS p(page_number)")
def pptx_master_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of masters and layouts that no slide has, by their parts' names; a title that a slide has isn't repeated."""
    def build(name: str) -> bytes:
        shape = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
        tree = lambda tag, *shapes: f"<p:{tag} {_A}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:{tag}>".encode()
        return zipped([
            ("[Content_Types].xml", b"<Types>presentationml</Types>"), ("ppt/presentation.xml", b"<p/>"), ("ppt/slides/slide1.xml", tree("sld", shape(name, '<p:ph type="title"/>'))),
            ("ppt/slideLayouts/slideLayout1.xml", tree("sldLayout", shape("layout"), shape(name))), ("ppt/slideMasters/slideMaster1.xml", tree("sldMaster", shape(f"master of {name}"))),
        ])

    files = table(spark, sf_dir, "nation").select("n_nationkey", _made(build, F.col("n_name")).alias("content"))
    return tables.document_pages(files, keep=["n_nationkey"]).select("n_nationkey", "page_number", "text")
