"""Round trips through features of documents: lists, runs, breaks, headers, notes, links, tables, comments, lists and code of pages, charsets, sinks."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf
from ..operators import tables
from ..parsers.base import Options
from ..sources import files, sinks
from .events import _folder
from .legacy import _GRID
from .registry import query, table
from .roundtrips import _LINES, _NATION, _paragraphs, _sheets
from .synthetic import _made, sheet_parts, typed_xlsx, zipped

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_A = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def _docx(body: str, *parts: tuple[str, str]) -> bytes:
    xml = f"<w:document {_W}><w:body>{body}</w:body></w:document>"
    return zipped([("[Content_Types].xml", b"<Types>wordprocessingml</Types>"), ("word/document.xml", xml.encode()), *((name, text.encode()) for name, text in parts)])


def _run(text: str, marks: str = "") -> str:
    return f'<w:r>{marks}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def _paragraph(text: str, properties: str = "") -> str:
    return f"<w:p>{properties}{_run(text)}</w:p>"


def _markdown(rows: DataFrame, keep: str, name: str, build, *columns, options: Options | None = None) -> DataFrame:
    made = udf.to_markdown(_made(build, *columns), F.lit(name), *([options] if options else []))
    return rows.select(keep, made.getField("markdown").alias("markdown"))


_TOP = "'--- Page 1 ---' || chr(10) || chr(10) || "
_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM {_LINES})"


@query(f"SELECT conv_id, {_TOP} string_agg((n - n // 3) || '. ' || line || chr(10), '' ORDER BY n) FILTER (n % 3 > 0) AS markdown FROM {_NUMBERED} GROUP BY conv_id HAVING count(*) > 1")
def ordered_list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three turns are items of one numbered list; numbers go on."""
    numbering = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    mark = '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>'
    build = lambda lines: _docx("".join(_paragraph(x, mark) for n, x in enumerate(lines) if n % 3), ("word/numbering.xml", numbering))
    return _markdown(_paragraphs(spark, sf_dir).where(F.size("lines") > 1), "conv_id", "a.docx", build, F.col("lines"))


@query(f"SELECT conv_id, {_TOP} string_agg(CASE WHEN n % 2 = 0 THEN '## ' ELSE '' END || line || chr(10) || chr(10), '' ORDER BY n) AS markdown FROM {_NUMBERED} GROUP BY conv_id")
def docx_heading_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by the outline level of their style."""
    styles = f'<w:styles {_W}><w:style w:styleId="H"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>'
    mark = '<w:pPr><w:pStyle w:val="H"/></w:pPr>'
    build = lambda lines: _docx("".join(_paragraph(x, "" if n % 2 else mark) for n, x in enumerate(lines)), ("word/styles.xml", styles))
    return _markdown(_paragraphs(spark, sf_dir), "conv_id", "a.docx", build, F.col("lines"))


@query(f"SELECT conv_id, {_TOP} string_agg(CASE WHEN island % 2 = 1 THEN '**' || merged || '**' ELSE merged END, '' ORDER BY island) || chr(10) || chr(10) AS markdown FROM (SELECT conv_id, n // 2 AS island, string_agg('T' || n || ':' || line || ';', '' ORDER BY n) AS merged FROM {_NUMBERED} GROUP BY conv_id, n // 2) GROUP BY conv_id")
def run_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a turn, every second pair of them bold: neighbours of one style become one."""
    bold = "<w:rPr><w:b/></w:rPr>"
    build = lambda lines: _docx("<w:p>" + "".join(_run(f"T{n}:{x};", bold if n // 2 % 2 else "") for n, x in enumerate(lines)) + "</w:p>")
    return _markdown(_paragraphs(spark, sf_dir), "conv_id", "a.docx", build, F.col("lines"))


@query(f"SELECT conv_id, (n // 3 + 1)::INTEGER AS page_number, string_agg(line, chr(10) ORDER BY n) AS lines FROM {_NUMBERED} GROUP BY conv_id, n // 3")
def page_index_from_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the breaks before every third turn."""
    mark = lambda n: '<w:r><w:br w:type="page"/></w:r>' if n and n % 3 == 0 else ""
    made = _made(lambda lines: _docx("".join(f"<w:p>{mark(n)}{_run(x)}</w:p>" for n, x in enumerate(lines))), F.col("lines"))
    pages = tables.document_pages(_paragraphs(spark, sf_dir).select("conv_id", made.alias("content")), keep=["conv_id"])
    kept = F.filter(F.split("text", "\n"), lambda x: (x != "") & ~x.startswith("--- Page "))
    return pages.select("conv_id", "page_number", F.array_join(kept, "\n").alias("lines"))


@query(f"SELECT conv_id, {_TOP} string_agg(line || chr(10) || chr(10), '' ORDER BY n) || chr(10) || '--- Header / Footer ---' || chr(10) || chr(10) || '#Top-' || conv_id || chr(10) || '#Bottom' || chr(10) AS markdown FROM {_NUMBERED} GROUP BY conv_id")
def header_dedupe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of headers and footers that the body doesn't have."""
    def build(key: int, lines: list[str]) -> bytes:
        head = f"<w:hdr {_W}>{_paragraph(f'#Top-{key}')}{_paragraph(lines[0])}</w:hdr>"
        return _docx("".join(map(_paragraph, lines)), ("word/header1.xml", head), ("word/footer1.xml", f"<w:ftr {_W}>{_paragraph('#Bottom')}</w:ftr>"))

    return _markdown(_paragraphs(spark, sf_dir), "conv_id", "a.docx", build, F.col("conv_id"), F.col("lines"))


@query(f"SELECT n_regionkey, {_TOP} string_agg('[' || n_name || '](http://n/' || n_nationkey || ')' || chr(10) || chr(10), '' ORDER BY n_nationkey) || chr(10) || '[^1]: note ' || n_regionkey || chr(10) AS markdown FROM nation GROUP BY n_regionkey")
def docx_links_and_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(key: int, rows: list[list[str]]) -> bytes:
        rels = "".join(f'<Relationship Id="r{k}" Target="http://n/{k}" TargetMode="External"/>' for k, _ in rows[1:])
        body = "".join(f'<w:p><w:hyperlink r:id="r{k}">{_run(v)}</w:hyperlink></w:p>' for k, v in rows[1:])
        notes = f'<w:footnotes {_W}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2">{_paragraph(f"note {key}")}</w:footnote></w:footnotes>'
        return _docx(body, ("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>"), ("word/footnotes.xml", notes))

    return _markdown(_sheets(spark, sf_dir), "n_regionkey", "a.docx", build, F.col("n_regionkey"), F.col("rows"))


@query(_GRID)
def docx_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(rows: list[list[str]]) -> bytes:
        return _docx("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")

    made = _sheets(spark, sf_dir).select("n_regionkey", _made(build, F.col("rows")).alias("content"))
    return tables.table_cells(made, keep=["n_regionkey"]).select("n_regionkey", "row_no", "column_no", "value")


_BARS = "'| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey)"


@query(f"SELECT n_regionkey, {_TOP} chr(10) || {_BARS} || chr(10) || chr(10) || '> **Notes:** note ' || n_regionkey || chr(10) || chr(10) AS markdown FROM nation GROUP BY n_regionkey")
def pptx_table_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(key: int, rows: list[list[str]]) -> bytes:
        text = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
        cells = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{text(c)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
        slide = f"<p:sld {_A}><p:cSld><p:spTree><p:graphicFrame><a:graphic><a:graphicData><a:tbl>{cells}</a:tbl></a:graphicData></a:graphic></p:graphicFrame></p:spTree></p:cSld></p:sld>"
        notes = f'<p:notes {_A}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody>{text(f"note {key}")}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
        rels = '<Relationships><Relationship Id="r1" Type="x/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
        parts = [("[Content_Types].xml", "<Types>presentationml</Types>"), ("ppt/presentation.xml", "<p/>"), ("ppt/slides/slide1.xml", slide), ("ppt/slides/_rels/slide1.xml.rels", rels), ("ppt/notesSlides/notesSlide1.xml", notes)]
        return zipped([(n, t.encode()) for n, t in parts])

    return _markdown(_sheets(spark, sf_dir), "n_regionkey", "a.pptx", build, F.col("n_regionkey"), F.col("rows"))


@query("SELECT k::INTEGER AS row_no, trim(coalesce(CASE WHEN k % 3 <> 0 THEN n_name END, '') || CASE WHEN k % 2 = 0 THEN ' [Ann: note ' || n_regionkey || ']' ELSE '' END) AS value FROM (SELECT n_nationkey AS k, * FROM nation)")
def comment_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's cells with their comments, also where there is only one of the two."""
    def build(rows: list[dict]) -> bytes:
        cells = "".join(f'<row r="{r["k"] + 1}"><c r="A{r["k"] + 1}" t="inlineStr"><is><t>{r["name"]}</t></is></c></row>' for r in rows if r["k"] % 3)
        notes = "".join(f'<comment ref="A{r["k"] + 1}" authorId="0"><text><t>note {r["region"]}</t></text></comment>' for r in rows if r["k"] % 2 == 0)
        rels = b'<Relationships><Relationship Id="c" Target="../comments1.xml"/></Relationships>'
        return zipped([*sheet_parts(cells), ("xl/worksheets/_rels/sheet1.xml.rels", rels), ("xl/comments1.xml", f"<comments><authors><author>Ann</author></authors><commentList>{notes}</commentList></comments>".encode())])

    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))
    one = table(spark, sf_dir, "nation").agg(rows.alias("rows"))  # 25 rows, one sheet
    return tables.table_cells(one.select(_made(build, F.col("rows")).alias("content"))).select("row_no", "value")


@query("SELECT g.r::INTEGER AS row_no, g.c::INTEGER AS column_no, coalesce(n.n_name, '') AS value FROM (SELECT r, c FROM range(4) a(r), range(7) b(c)) g LEFT JOIN (SELECT n_nationkey // 7 AS r, n_nationkey % 7 AS c, n_name FROM nation WHERE n_nationkey % 4 <> 1) n ON n.r = g.r AND n.c = g.c")
def dense_grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet that lacks cells has all of its grid as rows."""
    def build(rows: list[dict]) -> bytes:
        grid: list[list] = [[None] * 7 for _ in range(4)]
        for r in rows:
            if r["k"] % 4 != 1:
                grid[r["k"] // 7][r["k"] % 7] = r["name"]
        return typed_xlsx(grid)

    rows = F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    one = table(spark, sf_dir, "nation").agg(rows.alias("rows"))  # 25 rows, one sheet
    return tables.table_cells(one.select(_made(build, F.col("rows")).alias("content"))).select("row_no", "column_no", "value")


@query(f"SELECT n_regionkey, 'before' || chr(10) || chr(10) || {_BARS} || chr(10) || 'after' AS markdown FROM nation GROUP BY n_regionkey")
def rtf_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda rows: ("{\\rtf1\\ansi before\\par" + "".join("\\trowd " + "".join(f"{c}\\cell " for c in r) + "\\row " for r in rows) + "\\pard after\\par}").encode()
    return _markdown(_sheets(spark, sf_dir), "n_regionkey", "a.rtf", build, F.col("rows"))


@query("SELECT n_regionkey, string_agg(k || '. ' || n_name || chr(10), '' ORDER BY k) || chr(10) || '```' || chr(10) || 'x < ' || n_regionkey || chr(10) || 'y' || chr(10) || '```' || chr(10) || chr(10) || 'a `c` *i* [l](http://u/' || n_regionkey || ') ![alt](p.png)' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '> q' || chr(10) || chr(10) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY n_regionkey")
def html_lists_code_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(key: int, rows: list[list[str]]) -> bytes:
        items = "".join(f"<li>{v}</li>" for _, v in rows[1:])
        return f"<ol>{items}</ol><pre><code>x &lt; {key}\ny</code></pre><p>a <code>c</code> <em>i</em> <a href='http://u/{key}'>l</a> <img src='p.png' alt='alt'></p><hr><blockquote>q</blockquote>".encode()

    return _markdown(_sheets(spark, sf_dir), "n_regionkey", "a.html", build, F.col("n_regionkey"), F.col("rows"))


@query("SELECT n_nationkey, n_name || chr(10) || chr(10) || 'x ' || n_nationkey || chr(10) || chr(10) || '- z' || chr(10) || chr(10) AS markdown FROM nation")
def plain_text_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as plain text: without the marks that its Markdown has."""
    build = lambda k, v: f"<h1>{v}</h1><p><b>x</b> {k}</p><ul><li>z</li></ul>".encode()
    return _markdown(table(spark, sf_dir, "nation"), "n_nationkey", "a.html", build, F.col("n_nationkey"), F.col("n_name"), options=Options("text"))


@query("SELECT n_nationkey, '한글 ' || n_name AS text, '한글 ' || n_name AS page, 'é “' || n_name || '”' AS latin FROM nation")
def charset_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Korean text without a label, and pages whose charset is declared."""
    nation = table(spark, sf_dir, "nation")
    md = lambda build, name: udf.to_markdown(_made(build, F.col("n_name")), F.lit(name)).getField("markdown")
    page = lambda charset, coded, text: lambda v: f"<html><head><meta charset='{charset}'></head><body><p>".encode() + text(v).encode(coded) + b"</p>"
    return nation.select(
        "n_nationkey", md(lambda v: f"한글 {v}".encode("cp949"), "a.txt").alias("text"), F.rtrim(md(page("euc-kr", "cp949", lambda v: f"한글 {v}"), "a.html")).alias("page"),
        F.rtrim(md(page("windows-1252", "cp1252", lambda v: f"é “{v}”"), "a.html")).alias("latin"),
    ).select("n_nationkey", "text", F.regexp_replace("page", r"\s+$", "").alias("page"), F.regexp_replace("latin", r"\s+$", "").alias("latin"))


@query("SELECT n_nationkey, n_name || '.html' AS name, 'HTML' AS format, '# ' || n_name || chr(10) || chr(10) AS markdown, ('<h1>' || n_name || '</h1>').strlen()::BIGINT AS length FROM nation")
def files_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files, listed and read again as binary files, detected by content and converted."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("folder"), F.concat("n_name", F.lit(".html")).alias("file_name"), F.concat(F.lit("<h1>"), "n_name", F.lit("</h1>")).cast("binary").alias("data"))
    at = _folder(spark)
    sinks.write_images(nation, at)
    found = files.read_files(spark, at).select("name", "length", udf.detect(F.col("content"), F.col("name")).alias("format"), udf.to_markdown(F.col("content"), F.col("name")).getField("markdown").alias("markdown"))
    return found.join(nation.select("n_nationkey", F.col("file_name").alias("name")), "name").select("n_nationkey", "name", "format", "markdown", "length")


@query("SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY line")
def markdown_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines of files, and the lines read again."""
    at = _folder(spark)
    sinks.write_markdown(table(spark, sf_dir, "conversations"), at, "text")
    return spark.read.text(at, lineSep="\n").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
