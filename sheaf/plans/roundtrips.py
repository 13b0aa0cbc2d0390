"""Round trips: files made from table rows, read back by the operators, held against the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..containers.walk import Limits
from ..functions import udf
from ..operators import tables
from ..sources.sinks import exit_code
from . import synthetic
from .registry import query, table

_MEMBERS = "SELECT source, doc_id || '.txt' AS member_path, text AS markdown FROM documents"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, in parcels of twenty by id, as members of one archive a parcel."""
    member = F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 400).alias("parcel")).agg(F.array_sort(F.collect_list(member)).alias("members"))


def _walked(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return tables.archive_members(files, name="name", keep=["source"], limits=limits)


@query(_MEMBERS)
def zip_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members")).alias("content"))
    return _walked(files).select("source", "member_path", "markdown")


@query("SELECT source, doc_id || '.txt' AS member_path, 'TXT' AS format, strlen(text) AS uncompressed_size FROM documents")
def archive_entries_then_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members"), stored=True).alias("content"))
    entries = tables.archive_entries(files, name="name", keep=["source"]).repartition("member_path")
    made = entries.select("source", "member_path", "format", "uncompressed_size", udf.to_markdown(F.col("content"), F.col("member_path")).alias("c"))
    return made.where("c.error IS NULL").select("source", "member_path", "format", "uncompressed_size")


@query(_MEMBERS + " WHERE text <> ''")
def tar_gz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.tar.gz").alias("name"), synthetic.tar_gz(F.col("members")).alias("content"))
    return _walked(files).select("source", "member_path", "markdown")


@query(_MEMBERS + " WHERE text <> ''")
def tar_bz2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.tbz2").alias("name"), synthetic.tar_bz2(F.col("members")).alias("content"))
    return _walked(files).select("source", "member_path", "markdown")


@query("SELECT doc_id, doc_id || '.txt' AS member_path, text AS markdown FROM documents")
def gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt.gz")).alias("name"), synthetic.gz_file(F.col("text")).alias("content"))
    return tables.archive_members(files, name="name", keep=["doc_id"]).select("doc_id", "member_path", "markdown")


@query("SELECT source, 'level1.zip/level0.zip/' || doc_id || '.txt' AS member_path, text AS markdown, 'OK' AS error_code FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, 'level2.zip/level1.zip/level0.zip', '', 'DEPTH_LIMIT' FROM documents WHERE doc_id % 2 = 1 GROUP BY source, doc_id // 400")
def nested_zip_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _grouped(spark, sf_dir)
    even = F.filter("members", lambda m: m["doc_id"] % 2 == 0)
    odd = F.filter("members", lambda m: m["doc_id"] % 2 == 1)
    shallow = grouped.where(F.size(even) > 0).select("source", F.lit("a.zip").alias("name"), synthetic.nested_zip(even, 2).alias("content"))
    deep = grouped.where(F.size(odd) > 0).select("source", F.lit("a.zip").alias("name"), synthetic.nested_zip(odd, 3).alias("content"))
    return _walked(shallow.union(deep)).select("source", "member_path", F.col("markdown"), "error_code")


@query("SELECT source, doc_id || '.txt' AS member_path FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT source, 'dir/' || doc_id || '.txt' FROM documents WHERE doc_id % 4 = 3")
def zip_metadata_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(F.lit(""), F.lit("__MACOSX/"), F.lit("x/._"), F.lit("../dir\\")), (F.col("doc_id") % 4 + 1).cast("int"))
    member = F.struct(F.concat(prefix, F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    files = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 400)).agg(F.collect_list(member).alias("members")).select("source", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members")).alias("content"))
    return _walked(files).select("source", "member_path")


@query("SELECT source, least(count(*), 5) AS converted, count(*) > 5 AS cut FROM documents GROUP BY source, doc_id // 400")
def zip_entry_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _grouped(spark, sf_dir).select("source", "parcel", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members")).alias("content"))
    found = tables.archive_members(grouped, name="name", keep=["source", "parcel"], limits=Limits(max_entries=5))
    return found.groupBy("source", "parcel").agg(F.count_if(F.col("error_code") == "OK").alias("converted"), F.max(F.col("error_code") == "ENTRY_LIMIT").alias("cut")).drop("parcel")


@query("SELECT source, doc_id || '.txt' AS member_path, CASE WHEN strlen(text) > 2000 THEN 'MEMBER_LIMIT' ELSE 'OK' END AS error_code FROM documents")
def zip_member_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members")).alias("content"))
    return _walked(files, Limits(max_member_bytes=2000)).select("source", "member_path", "error_code")


@query("SELECT doc_id, '=== ' || doc_id || '.txt ===' || chr(10) || text || chr(10) || chr(10) AS shown FROM documents")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import member_text

    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt.gz")).alias("name"), synthetic.gz_file(F.col("text")).alias("content"))
    return tables.archive_members(files, name="name", keep=["doc_id"]).select("doc_id", member_text(F.col("member_path"), F.col("markdown"), F.col("error")).alias("shown"))


_WORDS = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: x), chr(10))"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as paragraphs, white space within a turn as single spaces."""
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    turns = table(spark, sf_dir, "conversations").withColumn("line", F.when(line == "", "empty").otherwise(line))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda t: t["line"]).alias("lines"))


_LINES = r"(SELECT conv_id, turn, CASE WHEN line = '' THEN 'empty' ELSE line END AS line FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations))"


@query(f"SELECT conv_id, '--- Page 1 ---' || chr(10) || chr(10) || string_agg(line || chr(10) || chr(10), '' ORDER BY turn) AS markdown FROM {_LINES} GROUP BY conv_id")
def docx_roundtrip_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paragraphs(spark, sf_dir).select("conv_id", synthetic.docx(F.col("lines")).alias("content"))
    return files.select("conv_id", udf.to_markdown(F.col("content"), F.lit("a.docx")).getField("markdown").alias("markdown"))


@query(f"SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS text FROM {_LINES} GROUP BY conv_id")
def odt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paragraphs(spark, sf_dir).select("conv_id", synthetic.odt(F.col("lines")).alias("content"))
    return tables.document_pages(files, keep=["conv_id"]).select("conv_id", "text")


@query(f"SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS text FROM {_LINES} GROUP BY conv_id")
def rtf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paragraphs(spark, sf_dir).select("conv_id", synthetic.rtf(F.col("lines")).alias("content"))
    return tables.document_pages(files, keep=["conv_id"]).select("conv_id", "text")


@query(f"SELECT conv_id, (turn + 1)::INTEGER AS page_number, '--- Page ' || (turn + 1) || ' ---' || chr(10) || chr(10) || '# ' || 'Turn ' || turn || chr(10) || chr(10) || line || chr(10) || chr(10) AS text FROM {_LINES}")
def pptx_roundtrip_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = F.transform("lines", lambda x, n: F.struct(F.concat(F.lit("Turn "), n.cast("string")).alias("title"), x.alias("body")))
    files = _paragraphs(spark, sf_dir).select("conv_id", synthetic.pptx(slides).alias("content"))
    return tables.document_pages(files, keep=["conv_id"]).select("conv_id", "page_number", "text")


@query("SELECT conv_id, turn, '# Turn ' || turn || chr(10) || chr(10) || '**From:** ' || role || '@example.org' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS markdown FROM conversations")
def eml_roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mail = synthetic.eml(F.concat(F.lit("Turn "), F.col("turn").cast("string")), F.concat("role", F.lit("@example.org")), F.col("text"))
    return turns.select("conv_id", "turn", udf.to_markdown(mail, F.lit("a.eml")).getField("markdown").alias("markdown"))


@query("SELECT conv_id, turn, p.path, p.content_type FROM conversations, (VALUES ('', 'multipart/alternative'), ('0', 'text/plain'), ('1', 'text/html')) AS p(path, content_type)")
def mime_parts_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", synthetic.eml(F.lit("s"), F.lit("f@example.org"), F.col("text")).alias("content"))
    return tables.mime_parts(turns, keep=["conv_id", "turn"]).select("conv_id", "turn", "path", "content_type")


_NATION = "SELECT n_regionkey, '## Data' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey)"


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), rows).alias("rows"))


@query(_NATION + " || chr(10) AS text FROM nation GROUP BY n_regionkey")
def xlsx_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sheets(spark, sf_dir).select("n_regionkey", synthetic.xlsx(F.col("rows")).alias("content"))
    return tables.document_pages(files, keep=["n_regionkey"]).select("n_regionkey", "text")


@query("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, n_name AS value FROM nation")
def xlsx_cells_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sheets(spark, sf_dir).select("n_regionkey", synthetic.xlsx(F.col("rows")).alias("content"))
    cells = tables.table_cells(files, keep=["n_regionkey"]).where("row_no > 0 AND column_no = 1")
    return cells.select("n_regionkey", F.col("row_no").cast("long").alias("row_no"), "value")


@query("SELECT n_regionkey, rtrim(text, chr(10)) AS text FROM (" + _NATION + " AS text FROM nation GROUP BY n_regionkey)")
def ods_roundtrip_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sheets(spark, sf_dir).select("n_regionkey", synthetic.ods(F.col("rows")).alias("content"))
    return tables.document_pages(files, keep=["n_regionkey"]).select("n_regionkey", "text")


@query("SELECT doc_id, text AS member, text AS direct FROM documents")
def archive_equals_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".txt.gz")).alias("name"), synthetic.gz_file(F.col("text")).alias("content"))
    member = tables.archive_members(files, name="name", keep=["doc_id"]).select("doc_id", F.col("markdown").alias("member"))
    direct = files.select("doc_id", udf.to_markdown(F.col("text").cast("binary"), F.lit("a.txt")).getField("markdown").alias("direct"))
    return member.join(direct, "doc_id")


@query("SELECT conv_id, turn, 'unsupported format' AS error FROM conversations")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = F.concat(F.unhex(F.lit("00FF00FE")), F.col("text").cast("binary"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", udf.to_markdown(hostile, F.lit("a.bin")).getField("error").alias("error"))


@query(r"SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS lines FROM (SELECT conv_id, turn, rtrim(substr(regexp_replace(line, '[^ -~]', 'x', 'g'), 1, 60)) AS line FROM (SELECT conv_id, turn, 'T' || turn || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || 'z' AS line FROM conversations)) GROUP BY conv_id")
def pdf_roundtrip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("T"), F.col("turn").cast("string"), F.lit(" "), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("z"))
    turns = table(spark, sf_dir, "conversations").withColumn("line", F.rtrim(F.substring(F.regexp_replace(line, "[^ -~]", "x"), 1, 60)))
    files = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda t: t["line"]).alias("lines"))
    pages = tables.document_pages(files.select("conv_id", synthetic.pdf(F.col("lines")).alias("content")), keep=["conv_id"])
    return pages.select("conv_id", F.array_join(F.filter(F.split("text", "\n"), lambda x: x != ""), "\n").alias("lines"))


#: A turn's lines of up to 60 characters, broken at spaces; a longer word has a line of its own.
_WRAPPED = r"(\S{61,}|\S.{0,59})(?: |$)"


@query(rf"SELECT conv_id, string_agg(array_to_string(regexp_extract_all(line, '{_WRAPPED}', 1), chr(10)), chr(10) ORDER BY turn) AS lines FROM (SELECT conv_id, turn, regexp_replace('T' || turn || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || 'z', '[^ -~]', 'x', 'g') AS line FROM conversations) GROUP BY conv_id")
def pdf_roundtrip_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("T"), F.col("turn").cast("string"), F.lit(" "), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("z"))
    turns = table(spark, sf_dir, "conversations").withColumn("wrapped", F.regexp_extract_all(F.regexp_replace(line, "[^ -~]", "x"), F.lit(_WRAPPED), 1))
    files = turns.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "wrapped"))), lambda t: t["wrapped"])).alias("lines"))
    pages = tables.document_pages(files.select("conv_id", synthetic.pdf_pages(F.col("lines")).alias("content")), keep=["conv_id"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"])
    whole = pages.groupBy("conv_id").agg(F.array_join(texts, "\n").alias("text"))
    return whole.select("conv_id", F.array_join(F.filter(F.split("text", "\n"), lambda x: x != ""), "\n").alias("lines"))


def _walked_as(spark: SparkSession, sf_dir: str, make, name: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit(name).alias("name"), make(F.col("members")).alias("content"))
    return _walked(files).select("source", "member_path", "markdown")


@query(_MEMBERS + " WHERE text <> ''")
def alz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked_as(spark, sf_dir, synthetic.alz, "a.alz")


@query(_MEMBERS + " WHERE text <> ''")
def egg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked_as(spark, sf_dir, synthetic.egg, "a.egg")


@query(_MEMBERS + " WHERE text <> ''")
def rar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked_as(spark, sf_dir, synthetic.rar, "a.rar")


@query(f"SELECT conv_id, '--- Page 1 ---' || chr(10) || chr(10) || string_agg(line || chr(10) || chr(10), '' ORDER BY turn) AS markdown FROM {_LINES} GROUP BY conv_id")
def hwpx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paragraphs(spark, sf_dir).select("conv_id", synthetic.hwpx(F.col("lines")).alias("content"))
    return files.select("conv_id", udf.to_markdown(F.col("content"), F.lit("a.hwpx")).getField("markdown").alias("markdown"))


@query("SELECT n_regionkey, chr(10) || '| ' || rpad('key', 3, ' ') || ' | ' || rpad('name', w, ' ') || ' |' || chr(10) || '| --- | ' || repeat('-', w) || ' |' || chr(10) || string_agg('| ' || rpad(n_nationkey::VARCHAR, 3, ' ') || ' | ' || rpad(n_name, w, ' ') || ' |' || chr(10), '' ORDER BY n_nationkey) || chr(10) AS markdown FROM nation JOIN (SELECT n_regionkey AS k, greatest(4, max(strlen(n_name)))::INTEGER AS w FROM nation GROUP BY 1) ON k = n_regionkey GROUP BY n_regionkey, w")
def html_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(F.lit("<tr>"), cell(r["n_nationkey"].cast("string")), cell(r["n_name"]), F.lit("</tr>")))
    pages = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
    return pages.select("n_regionkey", udf.html_to_markdown(F.col("html")).alias("markdown"))


@query("SELECT source, CASE WHEN max(strlen(text)) > 2000 THEN 2 ELSE 0 END AS exit_code FROM documents GROUP BY source")
def archive_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _grouped(spark, sf_dir).select("source", F.lit("a.zip").alias("name"), synthetic.zip_file(F.col("members")).alias("content"))
    found = _walked(files, Limits(max_member_bytes=2000))
    return exit_code(found, "source")
