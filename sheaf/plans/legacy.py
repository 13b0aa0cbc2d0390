"""Round trips through binary office files, Hangul documents, metafiles, 7z and RAR 5 archives and PDF files."""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf
from ..operators import tables
from ..parsers.base import Options
from . import binaries, synthetic
from .registry import query, table
from .roundtrips import _LINES, _MEMBERS, _NATION, _WRAPPED, _paragraphs, _sheets, _walked_as
from .synthetic import _made, _pairs


def _converted(files: DataFrame, keep: str, name: str, content, options: Options | None = None) -> DataFrame:
    made = udf.to_markdown(content, F.lit(name), options) if options else udf.to_markdown(content, F.lit(name))
    return files.select(keep, made.getField("markdown").alias("markdown"))


def _plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of printable ASCII; other characters become x."""
    return _paragraphs(spark, sf_dir).withColumn("lines", F.transform("lines", lambda x: F.regexp_replace(x, "[^ -~]", "x")))


_PLAIN = f"(SELECT conv_id, turn, regexp_replace(line, '[^ -~]', 'x', 'g') AS line FROM {_LINES})"


@query(_MEMBERS + " WHERE text <> ''")
def seven_zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turns stored, LZMA2, LZMA, deflate and bzip2."""
    def build(rows: list[dict]) -> bytes:
        members = [m for m in _pairs(rows) if m[1]]
        return binaries.seven(members, binaries.SEVEN_METHODS[zlib.crc32(members[0][0].encode()) % len(binaries.SEVEN_METHODS)]) if members else b""

    return _walked_as(spark, sf_dir, lambda m: _made(build, m), "a.7z")


@query(_MEMBERS + " WHERE text <> ''")
def rar5_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked_as(spark, sf_dir, lambda m: _made(lambda rows: binaries.rar5(_pairs(rows)), m), "a.rar")


def _typed(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Sheets of a hundred parts each: a text, a whole number, a broken one, a truth value and a date; cells as rows."""
    part = table(spark, sf_dir, "part")
    row = F.struct("p_partkey", "p_name", "p_size", (F.col("p_partkey") + 0.5).alias("half"), (F.col("p_size") % 2 == 0).alias("even"), (40000.0 + F.col("p_partkey")).alias("serial"))
    files = part.groupBy(F.floor(F.col("p_partkey") / 100).alias("parcel")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    cells = lambda rows: build([[r["p_name"], r["p_size"], r["half"], bool(r["even"]), ("date", r["serial"])] for r in rows])
    found = tables.table_cells(files.select("parcel", _made(cells, F.col("rows")).alias("content")), keep=["parcel"])
    return found.select("parcel", "row_no", "column_no", "value")


_CELLS = """WITH r AS (SELECT *, p_partkey // 100 AS parcel, (row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1)::INTEGER AS row_no FROM part)
SELECT parcel, row_no, 0::INTEGER AS column_no, p_name AS value FROM r UNION ALL SELECT parcel, row_no, 1, p_size::VARCHAR FROM r UNION ALL SELECT parcel, row_no, 2, p_partkey || '.5' FROM r
UNION ALL SELECT parcel, row_no, 3, CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END FROM r UNION ALL SELECT parcel, row_no, 4, """
_DATED = _CELLS + "strftime(DATE '1899-12-30' + (40000 + p_partkey)::INTEGER, '%Y-%m-%d') FROM r"


@query(_DATED)
def xls_typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, binaries.xls)


@query(_CELLS + "(40000 + p_partkey)::VARCHAR FROM r")
def xlsb_typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, lambda rows: synthetic.zipped(binaries.xlsb_parts([[*r[:4], r[4][1]] for r in rows])))


@query(_DATED)
def xlsx_typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, synthetic.typed_xlsx)


@query(_NATION + " || chr(10) AS text FROM nation GROUP BY n_regionkey")
def xls_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sheets(spark, sf_dir).select("n_regionkey", _made(binaries.xls, F.col("rows")).alias("content"))
    return tables.document_pages(files, keep=["n_regionkey"]).select("n_regionkey", "text")


@query(f"SELECT conv_id, '--- Page 1 ---' || chr(10) || chr(10) || string_agg('t' || turn || ' ' || line || '.', chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM {_LINES} GROUP BY conv_id")
def doc_roundtrip_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files of two pieces, 8-bit and 16-bit."""
    build = lambda lines: binaries.doc("".join(f"t{n} {x}.\r" for n, x in enumerate(lines)))
    return _converted(_paragraphs(spark, sf_dir), "conv_id", "a.doc", _made(build, F.col("lines")))


@query("SELECT n_regionkey, '--- Page 1 ---' || chr(10) || chr(10) || '## Nations' || chr(10) || chr(10) || 'See [them](http://n/' || n_regionkey || ').' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) || chr(10) || 'The end.' || chr(10) AS markdown FROM nation GROUP BY n_regionkey")
def doc_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading, a link field and a table by cell marks."""
    def build(key: int, rows: list[list[str]]) -> bytes:
        link = f'See \x13 HYPERLINK "http://n/{key}" \x14them\x15.\r'
        return binaries.doc("Nations\r\r" + link + "".join("".join(c + "\x07" for c in r) + "\x07" for r in rows) + "The end.\r")

    return _converted(_sheets(spark, sf_dir), "n_regionkey", "a.doc", _made(build, F.col("n_regionkey"), F.col("rows")))


@query("SELECT n_regionkey, '--- Page 1 ---' || chr(10) || chr(10) || 'All **of them** here.' || chr(10) || chr(10) || '| key |  | **name** |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' |  | **' || n_name || '** |' || chr(10), '' ORDER BY n_nationkey) || chr(10) || 'The end.' || chr(10) AS markdown FROM nation GROUP BY n_regionkey")
def doc_bold_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold text, and rows with empty cells, by the formats in side tables."""
    def build(rows: list[list[str]]) -> bytes:
        runs = [("All ", False), ("of them", True), (" here.\r", False)]
        for key, name in rows:
            runs += [(f"{key}\x07\x07", False), (name, True), ("\x07", False), ("\x07", True)]
        return binaries.marked_doc([*runs, ("The end.\r", False)])

    return _converted(_sheets(spark, sf_dir), "n_regionkey", "a.doc", _made(build, F.col("rows")))


_SLIDES = f"SELECT conv_id, (turn + 1)::INTEGER AS page_number, CASE WHEN turn > 0 THEN chr(10) ELSE '' END || '--- Page ' || (turn + 1) || ' ---' || chr(10) || chr(10) || '# ' || 'Turn ' || turn || chr(10) || chr(10) || line || chr(10) || chr(10) AS text FROM {_LINES}"


def _titled(lines: list[str]) -> list[tuple[str, str]]:
    return [(f"Turn {n}", x) for n, x in enumerate(lines)]


@query(_SLIDES)
def ppt_roundtrip_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paragraphs(spark, sf_dir).select("conv_id", _made(lambda x: binaries.ppt(_titled(x)), F.col("lines")).alias("content"))
    return tables.document_pages(files, keep=["conv_id"]).select("conv_id", "page_number", "text")


@query(_SLIDES + " WHERE turn IN (0, 2)")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first and third slide are converted."""
    files = _paragraphs(spark, sf_dir).select("conv_id", _made(lambda x: binaries.ppt(_titled(x)), F.col("lines")).alias("content"))
    return tables.document_pages(files, keep=["conv_id"], options=Options(pages=(1, 3))).select("conv_id", "page_number", "text")


@query(f"SELECT conv_id, turn, '# Turn ' || turn || chr(10) || chr(10) || '- **From:** Ann <ann' || conv_id || '@example.org>' || chr(10) || '- **To:** Bob' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || line || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**첨부(1)**: f.txt' || chr(10) AS markdown FROM {_LINES}")
def msg_roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _paragraphs(spark, sf_dir).select("conv_id", F.posexplode("lines").alias("turn", "line"))
    made = _made(lambda c, t, x: binaries.msg(f"Turn {t}", "Ann", f"ann{c}@example.org", "Bob", x), F.col("conv_id"), F.col("turn"), F.col("line"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), udf.to_markdown(made, F.lit("a.msg")).getField("markdown").alias("markdown"))


@query(f"SELECT conv_id, string_agg(line || chr(10) || chr(10), '' ORDER BY turn) AS markdown FROM {_LINES} GROUP BY conv_id")
def hwp5_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_paragraphs(spark, sf_dir), "conv_id", "a.hwp", _made(lambda x: binaries.hwp5(x), F.col("lines")))


@query("SELECT n_regionkey, 'Nations' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) || chr(10) AS markdown FROM nation GROUP BY n_regionkey")
def hwp5_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_sheets(spark, sf_dir), "n_regionkey", "a.hwp", _made(lambda rows: binaries.hwp5(["Nations"], rows), F.col("rows")))


@query(f"SELECT conv_id, string_agg(line || chr(10) || chr(10), '' ORDER BY turn) AS markdown FROM {_PLAIN} GROUP BY conv_id")
def hwp3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_plain_lines(spark, sf_dir), "conv_id", "a.hwp", _made(binaries.hwp3, F.col("lines")))


@query(f"SELECT conv_id, string_agg('T' || turn || ' ' || line || chr(10), '' ORDER BY turn) AS markdown FROM {_LINES} GROUP BY conv_id")
def emf_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs a line, the right one first; lines from below."""
    build = lambda lines: binaries.emf([r for n, x in reversed(list(enumerate(lines))) for r in ((900, 40 * n, x), (0, 40 * n, f"T{n}"))])
    return _converted(_paragraphs(spark, sf_dir), "conv_id", "a.emf", _made(build, F.col("lines")))


@query(f"SELECT conv_id, string_agg(line || chr(10), '' ORDER BY turn) AS markdown FROM {_PLAIN} GROUP BY conv_id")
def wmf_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_plain_lines(spark, sf_dir), "conv_id", "a.wmf", _made(binaries.wmf, F.col("lines")))


_PDF_LINES = rf"SELECT conv_id, string_agg(array_to_string(regexp_extract_all('T' || turn || ' ' || line || 'z', '{_WRAPPED}', 1), chr(10)), chr(10) ORDER BY turn) AS lines FROM {_PLAIN} GROUP BY conv_id"


def _pdf_lines(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Each turn's lines of up to 60 characters, forty a page, from files that build(contents of pages, conv_id) gives."""
    wrapped = lambda x, n: F.regexp_extract_all(F.concat(F.lit("T"), n.cast("string"), F.lit(" "), x, F.lit("z")), F.lit(_WRAPPED), 1)
    parts = _plain_lines(spark, sf_dir).withColumn("all", F.flatten(F.transform("lines", wrapped)))
    parts = parts.select("conv_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 40))).alias("part"), "all")
    files = parts.select("conv_id", "part", _made(lambda x, c: build(binaries.lines(x), c), F.slice("all", F.col("part").cast("int") * 40 + 1, 40), F.col("conv_id")).alias("content"))
    pages = tables.document_pages(files, keep=["conv_id", "part"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    whole = pages.groupBy("conv_id").agg(F.array_join(texts, "\n").alias("text"))
    kept = F.filter(F.split("text", "\n"), lambda x: (x != "") & ~x.startswith("--- Page "))
    return whole.select("conv_id", F.array_join(kept, "\n").alias("lines"))


@query(_PDF_LINES)
def pdf_encrypted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf_lines(spark, sf_dir, lambda content, _: binaries.encrypted_pdf(content))


@query(_PDF_LINES)
def pdf_filters_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turns LZW, base 85, hexadecimal digits, run lengths, and deflate with a predictor, or two of them."""
    def build(content: bytes, key: int) -> bytes:
        ways = [
            (b"/Filter /LZWDecode", binaries.lzw), (b"/Filter /ASCII85Decode", lambda d: base64.a85encode(d) + b"~>"), (b"/Filter /ASCIIHexDecode", lambda d: d.hex().encode() + b">"),
            (b"/Filter /RunLengthDecode", binaries.run_lengths), (b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>", lambda d: zlib.compress(binaries.predicted(d, 16))),
            (b"/Filter [/ASCII85Decode /LZWDecode]", lambda d: base64.a85encode(binaries.lzw(d)) + b"~>"),
        ]
        named, coder = ways[key % len(ways)]
        return binaries.pdf(binaries.page(b"") | {4: binaries.stream(coder(content), named)})

    return _pdf_lines(spark, sf_dir, build)


@query(_PDF_LINES)
def pdf_object_streams_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in an object stream and no table of places: what is there is found by reading the file."""
    def build(content: bytes, _: int) -> bytes:
        objects = binaries.page(content)
        inner = [(n, objects.pop(n)) for n in (1, 2, 3, 5, 6)]
        head, body = "", b""
        for n, o in inner:
            head += f"{n} {len(body)} "
            body += o + b" "
        objects[8] = binaries.stream(zlib.compress(head.encode() + body), b"/Type /ObjStm /N 5 /First %d /Filter /FlateDecode" % len(head))
        return binaries.pdf(objects).replace(b"startxref", b"xx")

    return _pdf_lines(spark, sf_dir, build)


_GRID = "SELECT n_regionkey, 0::INTEGER AS row_no, 0::INTEGER AS column_no, 'key' AS value FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 0, 1, 'name' FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER, 0, n_nationkey::VARCHAR FROM nation UNION ALL SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER, 1, n_name FROM nation"
_BODY = binaries.lines(["Plain body text goes here for a while", "and goes on in a second line of it"])


@query(_GRID)
def pdf_ruled_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells between drawn rules."""
    def build(rows: list[list[str]]) -> bytes:
        top, low = 600, 600 - 20 * len(rows)
        rules = b"".join(b"%d %d m %d %d l S " % (x, low, x, top) for x in (72, 172, 372)) + b"".join(b"72 %d m 372 %d l S " % (y, y) for y in range(low, top + 1, 20))
        cells = b"".join(binaries.at(x, top - 14 - 20 * n, t) for n, r in enumerate(rows) for x, t in zip((80, 180), r, strict=True))
        return binaries.pdf(binaries.page(_BODY + rules + cells))

    files = _sheets(spark, sf_dir).select("n_regionkey", _made(build, F.col("rows")).alias("content"))
    return tables.table_cells(files, keep=["n_regionkey"]).select("n_regionkey", "row_no", "column_no", "value")


_NOTED = "WITH r AS (SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS row_no, n_nationkey, n_name FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, NULL, NULL FROM nation) SELECT n_regionkey, row_no, 0::INTEGER AS column_no, coalesce(n_nationkey::VARCHAR, 'key') AS value FROM r UNION ALL SELECT n_regionkey, row_no, 1, coalesce(n_name, 'name') FROM r UNION ALL SELECT n_regionkey, row_no, 2, coalesce('a note on ' || n_name || ' of two lines', 'note') FROM r"


def _noted(rows: list[list[str]]) -> tuple[bytes, int]:
    """Text of rows whose last cell takes two lines, and where it ends."""
    out, y = b"", 560
    for n, (key, name) in enumerate(rows):
        out += binaries.at(72, y, key) + binaries.at(140, y, name) + binaries.at(300, y, f"a note on {name}" if n else "note")
        if n:
            y -= 12
            out += binaries.at(300, y, "of two lines")
        y -= 18
    return out, y + 12


@query(_NOTED)
def pdf_borderless_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by their edges, cells of several lines, no rules."""
    build = lambda rows: binaries.pdf(binaries.page(_BODY + _noted(rows)[0]))
    files = _sheets(spark, sf_dir).select("n_regionkey", _made(build, F.col("rows")).alias("content"))
    return tables.table_cells(files, keep=["n_regionkey"]).select("n_regionkey", "row_no", "column_no", "value")


@query(_NOTED)
def pdf_barred_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules above, below the head and below the table only."""
    def build(rows: list[list[str]]) -> bytes:
        text, low = _noted(rows)
        return binaries.pdf(binaries.page(_BODY + text + b"".join(b"70 %d m 500 %d l S " % (y, y) for y in (574, 554, low))))

    files = _sheets(spark, sf_dir).select("n_regionkey", _made(build, F.col("rows")).alias("content"))
    return tables.table_cells(files, keep=["n_regionkey"]).select("n_regionkey", "row_no", "column_no", "value")


@query("SELECT n_regionkey, n, lines FROM (SELECT n_regionkey, count(*)::INTEGER + 1 AS n, 'Plain body text goes here for a while' || chr(10) || 'and goes on in a second line of it' AS lines FROM nation GROUP BY 1)")
def bbox_range_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a table's box don't also show as text."""
    def build(rows: list[list[str]]) -> bytes:
        top, low = 600, 600 - 20 * len(rows)
        rules = b"".join(b"%d %d m %d %d l S " % (x, low, x, top) for x in (72, 172, 372)) + b"".join(b"72 %d m 372 %d l S " % (y, y) for y in range(low, top + 1, 20))
        return binaries.pdf(binaries.page(_BODY + rules + b"".join(binaries.at(x, top - 14 - 20 * n, t) for n, r in enumerate(rows) for x, t in zip((80, 180), r, strict=True))))

    files = _sheets(spark, sf_dir).select("n_regionkey", _made(build, F.col("rows")).alias("content"))
    pages = tables.document_pages(files, keep=["n_regionkey"])
    kept = F.filter(F.split("text", "\n"), lambda x: (x != "") & ~x.startswith("--- Page ") & ~x.startswith("|"))
    return pages.select("n_regionkey", F.size(F.element_at("tables", 1)).alias("n"), F.array_join(kept, "\n").alias("lines"))


@query("SELECT n_regionkey, n_nationkey, '## Table of Contents' || chr(10) || chr(10) || '- ' || n_name || ' *(p.1)*' || chr(10) || chr(10) || '## Attachments' || chr(10) || chr(10) || '- f' || n_nationkey || '.txt (2.0 KB) — about ' || n_name AS head, '- [See it](http://n/' || n_nationkey || ')' AS link, '> note ' || n_nationkey AS note FROM nation")
def pdf_links_notes_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(key: int, name: str) -> bytes:
        objects = binaries.page(
            binaries.at(72, 740, "See it") + _BODY.replace(b"740", b"640"), b"/Annots [7 0 R 8 0 R]", catalog=b"/Outlines 9 0 R /Names << /EmbeddedFiles << /Names [(a) 11 0 R] >> >>"
        ) | {
            7: b"<< /Subtype /Link /Rect [70 735 200 752] /A << /URI (http://n/%d) >> >>" % key, 8: b"<< /Subtype /Text /Contents (note %d) >>" % key, 9: b"<< /First 10 0 R >>",
            10: b"<< /Title %s /Dest [3 0 R /Fit] >>" % binaries.shown(name), 11: b"<< /F (f%d.txt) /EF << /F 12 0 R >> /Desc %s >>" % (key, binaries.shown("about " + name)), 12: binaries.stream(b"x" * 2048),
        }
        return binaries.pdf(objects)

    made = udf.to_markdown(_made(build, F.col("n_nationkey"), F.col("n_name")), F.lit("a.pdf")).getField("markdown")
    md = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", made.alias("md"))
    first = lambda pattern: F.regexp_extract("md", pattern, 0)
    return md.select("n_regionkey", "n_nationkey", F.rtrim(F.split_part("md", F.lit("\n\n--- Page"), F.lit(1))).alias("head"), first(r"- \[See it\]\([^)]*\)").alias("link"), first(r"> note \d+").alias("note"))


@query("SELECT n_nationkey, '# ' || n_name AS heading, 'text of ' || n_name AS line FROM nation")
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common size of a page's characters is its body's; a much larger line is a heading."""
    build = lambda name: binaries.pdf(binaries.page(binaries.at(72, 740, name, 20) + b"".join(binaries.at(72, 700 - 14 * n, f"text of {name}") for n in range(4))))
    made = udf.to_markdown(_made(build, F.col("n_name")), F.lit("a.pdf")).getField("markdown")
    md = table(spark, sf_dir, "nation").select("n_nationkey", F.filter(F.split(made, "\n"), lambda x: (x != "") & ~x.startswith("--- ")).alias("lines"))
    return md.select("n_nationkey", F.element_at("lines", 1).alias("heading"), F.element_at("lines", -1).alias("line"))


@query("SELECT n_nationkey, n_name || ' 한글 — é ' || n_nationkey AS line FROM nation")
def pdf_unicode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-byte codes that only the font's map to Unicode explains."""
    def build(text: str) -> bytes:
        codes = "".join(f"{ord(c):04X}" for c in text)
        cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
        objects = binaries.page(b"BT /F1 12 Tf 72 700 Td <%s> Tj ET" % codes.encode())
        objects[5] = b"<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /Subtype /CIDFontType2 /DW 600 >>] /ToUnicode 7 0 R >>"
        return binaries.pdf(objects | {7: binaries.stream(cmap)})

    line = F.concat("n_name", F.lit(" 한글 — é "), F.col("n_nationkey").cast("string"))
    made = udf.to_markdown(_made(build, line), F.lit("a.pdf")).getField("markdown")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.filter(F.split(made, "\n"), lambda x: (x != "") & ~x.startswith("--- ")), 1).alias("line"))


@query("SELECT n_nationkey, 'png' AS format, (20 + n_nationkey)::BIGINT AS width, (30 + n_nationkey)::BIGINT AS height, md5(n_name || n_nationkey) AS pixels FROM nation WHERE n_nationkey >= 20")
def min_image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of PDF pages as PNG, the small ones left out; the first bytes of the pixels carry a digest."""
    def build(key: int, name: str) -> bytes:
        wide, high = 20 + key, 30 + key
        pixels = hashlib.md5(f"{name}{key}".encode()).digest().ljust(wide * high, b"\7")
        objects = binaries.page(_BODY + b"q 100 0 0 100 72 100 cm /I Do Q", resources=b"/XObject << /I 7 0 R >> ")
        return binaries.pdf(objects | {7: binaries.stream(zlib.compress(pixels), b"/Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode" % (wide, high))})

    def first(data: bytes) -> bytes:
        return binaries.png_rows(data)[1:17]

    files = table(spark, sf_dir, "nation").select("n_nationkey", _made(build, F.col("n_nationkey"), F.col("n_name")).alias("content"))
    found = tables.document_images(files, keep=["n_nationkey"], options=Options(min_image_size=40))
    return found.select("n_nationkey", "format", "width", "height", F.lower(F.hex(_made(first, F.col("data")))).alias("pixels"))


def _pictures(spark: SparkSession, sf_dir: str, build, shown) -> DataFrame:
    """What shown(PNG, width) gives of the one picture in each nation's file."""
    files = table(spark, sf_dir, "nation").select("n_nationkey", _made(build, F.col("n_name")).alias("content"))
    found = tables.document_images(files, keep=["n_nationkey"], options=Options(min_image_size=1))
    return found.select("n_nationkey", "format", "width", "height", F.decode(_made(shown, F.col("data"), F.col("width")), "UTF-8").alias("pixels"))


def _rows(data: bytes, row: int) -> list[bytes]:
    raw = binaries.png_rows(data)
    return [raw[a + 1 : a + 1 + row] for a in range(0, len(raw), row + 1)]


def _digests(name: str, n: int) -> list[bytes]:
    return [hashlib.md5(f"{name}{r}".encode()).digest() for r in range(n)]


def _image(n: int, data: bytes, extra: bytes) -> dict[int, bytes]:
    return {n: binaries.stream(data, b"/Subtype /Image " + extra)}


_ROWS = "(SELECT n_nationkey, string_agg(md5(n_name || r), '' ORDER BY r) AS pixels FROM nation, range(12) t(r) GROUP BY n_nationkey)"


@query(f"SELECT n_nationkey, 'png' AS format, 128::BIGINT AS width, 12::BIGINT AS height, pixels FROM {_ROWS}")
def pdf_ccitt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fax coded pictures: rows against the row above, or alone."""
    def build(name: str) -> bytes:
        digests, k = _digests(name, 12), -1 if len(name) % 2 else 0
        rows = [bytes(b >> (7 - i) & 1 for b in d for i in range(8)) for d in digests]
        own = b"/Width 128 /Height 12 /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /CCITTFaxDecode /DecodeParms << /K %d /Columns 128 /Rows 12 >>" % k
        return binaries.pdf(binaries.page(_BODY + b"q 100 0 0 100 72 100 cm /I Do Q", resources=b"/XObject << /I 7 0 R >> ") | _image(7, binaries.fax(rows, 128, k), own))

    return _pictures(spark, sf_dir, build, _black_bits)


@query(f"SELECT n_nationkey, 'png' AS format, 16::BIGINT AS width, 12::BIGINT AS height, pixels FROM {_ROWS}")
def pdf_strips_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture in three strips, drawn in another order, is one picture again."""
    def build(name: str) -> bytes:
        digests, objects, draw = _digests(name, 12), {}, b""
        for s in (1, 0, 2):
            objects |= _image(7 + s, zlib.compress(b"".join(digests[4 * s : 4 * s + 4])), b"/Width 16 /Height 4 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode")
            draw += b"q 160 0 0 40 72 %d cm /I%d Do Q " % (500 - 40 * s, s)
        return binaries.pdf(binaries.page(_BODY + draw, resources=b"/XObject << /I0 7 0 R /I1 8 0 R /I2 9 0 R >> ") | objects)

    return _pictures(spark, sf_dir, build, lambda data, wide: b"".join(_rows(data, wide)).hex().encode())


@query(f"SELECT n_nationkey, 'png' AS format, 16::BIGINT AS width, 12::BIGINT AS height, pixels FROM {_ROWS}")
def pdf_soft_mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alpha of a picture is its soft mask."""
    def build(name: str) -> bytes:
        shape = b"/Width 16 /Height 12 /BitsPerComponent 8 /ColorSpace /DeviceGray "
        objects = _image(7, bytes(192), shape + b"/SMask 8 0 R") | _image(8, b"".join(_digests(name, 12)), shape)
        return binaries.pdf(binaries.page(_BODY + b"q 100 0 0 100 72 100 cm /I Do Q", resources=b"/XObject << /I 7 0 R >> ") | objects)

    return _pictures(spark, sf_dir, build, lambda data, wide: b"".join(row[3::4] for row in _rows(data, 4 * wide)).hex().encode())


def _black_bits(data: bytes, wide: int) -> bytes:
    bits = "".join("0" if v else "1" for row in _rows(data, wide) for v in row)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").hex().encode()


@query(f"SELECT n_nationkey, 'png' AS format, 128::BIGINT AS width, 12::BIGINT AS height, pixels FROM {_ROWS}")
def pdf_jbig2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic coding by each of the four templates."""
    def build(name: str) -> bytes:
        rows = [bytes(b >> (7 - i) & 1 for b in d for i in range(8)) for d in _digests(name, 12)]
        own = b"/Width 128 /Height 12 /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /JBIG2Decode"
        return binaries.pdf(binaries.page(_BODY + b"q 100 0 0 100 72 100 cm /I Do Q", resources=b"/XObject << /I 7 0 R >> ") | _image(7, binaries.jbig2(rows, zlib.crc32(name.encode()) % 4), own))

    return _pictures(spark, sf_dir, build, _black_bits)


@query("SELECT n_nationkey, 'png' AS format, 256::BIGINT AS width, 4::BIGINT AS height, string_agg(substr(md5('glyph' || substr(md5(n_name), i + 1, 1)), 2 * r + 1, 2), '' ORDER BY r, i) AS pixels FROM nation, range(4) a(r), range(32) b(i) GROUP BY n_nationkey")
def pdf_jbig2_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of symbols, whose dictionary is a stream of its own."""
    def build(name: str) -> bytes:
        digits = "0123456789abcdef"
        glyphs = [[bytes(b >> (7 - i) & 1 for i in range(8)) for b in hashlib.md5(f"glyph{d}".encode()).digest()[:4]] for d in digits]
        shared, coded = binaries.jbig2_text(glyphs, [(digits.index(d), 8 * n) for n, d in enumerate(hashlib.md5(name.encode()).hexdigest())], 256, 4)
        own = b"/Width 256 /Height 4 /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /JBIG2Decode /DecodeParms << /JBIG2Globals 8 0 R >>"
        objects = _image(7, coded, own) | {8: binaries.stream(shared)}
        return binaries.pdf(binaries.page(_BODY + b"q 100 0 0 100 72 100 cm /I Do Q", resources=b"/XObject << /I 7 0 R >> ") | objects)

    return _pictures(spark, sf_dir, build, _black_bits)
