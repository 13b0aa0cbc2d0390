"""Text, Markdown, path, encoding and number queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import excel, text, udf
from .registry import query, table

_STRIP = r"""
SELECT doc_id, string_agg(piece, '' ORDER BY n) AS plain FROM (
  SELECT doc_id, n, CASE
    WHEN regexp_matches(line, '^\|[|: \-]*$') AND contains(line, '-') THEN ''
    WHEN line LIKE '|%' THEN ltrim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(substr(line, 2), '\|$', ''), '\|$', ''), '|'), lambda c: replace(trim(c, ' ' || chr(9) || chr(13) || chr(10)), '*', '')), '  '), ' ') || chr(10)
    WHEN regexp_matches(line, '^-{3,}$') THEN CASE WHEN n < total THEN chr(10) ELSE '' END
    ELSE replace(regexp_replace(regexp_replace(regexp_replace(line, '^#+ ', ''), '!\[\]\([^)]*\)', '', 'g'), '!\[([^\]]+)\]\([^)]*\)', '[image: \1]', 'g'), '*', '') || CASE WHEN n < total THEN chr(10) ELSE '' END
  END AS piece
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n, len(lines) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
) GROUP BY doc_id
"""


@query(_STRIP)
def strip_markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_markdown(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(text, '(?m)^#+ ', '', 'g') AS plain FROM documents")
def strip_heading_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^#+ ", "").alias("plain"))


@query("SELECT doc_id, replace(text, '*', '') AS plain FROM documents")
def strip_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("*"), F.lit("")).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(replace(text, '. ', chr(10) || '---' || chr(10)), '(?m)^-{3,}$', '', 'g') AS plain FROM documents")
def strip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.replace("text", F.lit(". "), F.lit("\n---\n")), r"(?m)^-{3,}$", "").alias("plain"))


@query("SELECT doc_id, trim(replace(replace(text, '|', '\\|'), chr(10), ' '), ' ' || chr(9) || chr(13) || chr(10)) AS cell FROM documents")
def escape_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.escaped_cell(F.col("text")).alias("cell"))


@query("SELECT doc_id, replace(replace(text, '\\', '\\\\'), '|', '\\|') AS escaped FROM documents")
def escape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.escaped_markdown(F.col("text")).alias("escaped"))


@query("SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) AS md FROM nation")
def markdown_table_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    cells = F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"))), F.transform(rows, lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])))
    return table(spark, sf_dir, "nation").agg(text.markdown_table(cells).alias("md"))


@query("SELECT '| ' || rpad('name', w, ' ') || ' |' || chr(10) || '| ' || repeat('-', w) || ' |' || chr(10) || string_agg('| ' || rpad(r_name, w, ' ') || ' |' || chr(10), '' ORDER BY r_regionkey) AS md FROM region, (SELECT greatest(4, max(strlen(r_name)))::INTEGER AS w FROM region) GROUP BY w")
def markdown_table_region_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("rows"), F.greatest(F.lit(4), F.max(F.octet_length("r_name"))).alias("w"))
    line = lambda c: F.concat(F.lit("| "), F.rpad(c, F.col("w"), F.lit(" ")), F.lit(" |\n"))
    return rows.select(F.concat(line(F.lit("name")), line(F.repeat(F.lit("-"), F.col("w"))), F.array_join(F.transform("rows", lambda r: line(r["r_name"])), "")).alias("md"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS normal FROM (SELECT doc_id, '..\\' || source || '//./' || lang || '/../' || doc_id || '.txt' AS path FROM documents)")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("..\\"), "source", F.lit("//./"), "lang", F.lit("/../"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalised_path(path).alias("normal"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(p, '%', '%25'), ' ', '%20'), '(', '%28'), ')', '%29'), '<', '%3C'), '>', '%3E') AS encoded FROM (SELECT doc_id, source || ' (' || lang || ') 100% <' || doc_id || '>' AS p FROM documents)")
def percent_encode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit(" ("), "lang", F.lit(") 100% <"), F.col("doc_id").cast("string"), F.lit(">"))
    return table(spark, sf_dir, "documents").select("doc_id", text.percent_encoded(path).alias("encoded"))


@query("SELECT doc_id, 'img' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'tiff' ELSE 'bin' END AS ref, CASE WHEN doc_id % 3 = 0 THEN '.jpeg' WHEN doc_id % 3 = 1 THEN '.webp' ELSE '.' || CASE doc_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'tiff' ELSE 'bin' END END AS saved FROM documents")
def image_ref_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".jpg", ".png", ".tif", ".xyz"])), (F.col("doc_id") % 4 + 1).cast("int"))
    declared = F.element_at(F.array(*map(F.lit, [".jpeg", ".webp", ".png/../../x"])), (F.col("doc_id") % 3 + 1).cast("int"))
    kind = text.image_format(ext)
    return table(spark, sf_dir, "documents").select("doc_id", text.image_reference(F.concat(F.lit("img"), F.col("doc_id").cast("string")), kind, F.lit("")).alias("ref"), text.image_extension_to_save(declared, kind).alias("saved"))


@query("SELECT doc_id, CASE WHEN b >= 1048576 THEN replace(format('{:,.1f}', b / 1048576.0), ',', '') || ' MB' WHEN b >= 1024 THEN replace(format('{:,.1f}', b / 1024.0), ',', '') || ' KB' ELSE b || ' B' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 7 + 1) * (doc_id % 7 + 1) AS b FROM documents)")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 7 + 1
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(F.col("n_chars") * m * m).alias("size"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10)) AS line FROM documents")
def single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.single_line(F.col("text")).alias("line"))


@query("SELECT doc_id, text AS decoded FROM documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    junk = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\\$-\r\n")
    return table(spark, sf_dir, "documents").select("doc_id", text.base64_decoded(junk).cast("string").alias("decoded"))


@query("SELECT doc_id, text AS decoded FROM documents")
def hex_to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.regexp_replace(F.hex(F.col("text").cast("binary")), "(.{64})", "$1\r\n ")
    return table(spark, sf_dir, "documents").select("doc_id", text.hex_decoded(spaced).cast("string").alias("decoded"))


@query("SELECT doc_id, text AS decoded FROM documents")
def quoted_printable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat(F.lit("="), F.array_join(F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("(..)"), 1), "="))
    soft = F.regexp_replace(F.when(F.col("text") == "", "").otherwise(coded), "((?:=..){24})", "$1=\r\n")
    return table(spark, sf_dir, "documents").select("doc_id", udf.quoted_printable(soft.cast("binary")).cast("string").alias("decoded"))


@query("SELECT doc_id, true AS valid, text FROM documents")
def txt_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_valid_utf8(F.col("text")).alias("valid"), udf.plain_text(F.col("text").cast("binary")).alias("text"))


@query("SELECT doc_id, replace(replace(text, '’', ''''), '—', '-') AS decoded FROM (SELECT doc_id, 'page ' || doc_id || ' naïve café' AS text FROM documents)")
def charset_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(" naïve café")), "iso-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", udf.charset_text(raw, "windows-1252").alias("decoded"))


@query("SELECT doc_id, text AS decoded FROM documents")
def charset_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", udf.charset_text(F.encode("text", "utf-16le"), "UTF-16").alias("decoded"))


@query("SELECT conv_id, turn, text AS subject FROM conversations")
def encoded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat(F.lit("=?UTF-8?B?"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""), F.lit("?="))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", udf.encoded_words(word).alias("subject"))


@query("SELECT doc_id, (doc_id % 9 + 1) || '.' || (doc_id % 4 + 1) || CASE WHEN doc_id % 3 = 0 THEN '.7 T' WHEN doc_id % 3 = 1 THEN ' T' ELSE 'T' END AS heading, CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS depth FROM documents")
def section_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 4 + 1).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".7 T").when(F.col("doc_id") % 3 == 1, " T").otherwise("T"))
    return table(spark, sf_dir, "documents").select("doc_id", heading.alias("heading"), text.section_depth(heading).alias("depth"))


@query("SELECT doc_id, doc_id % 5 <> 4 AS footer FROM documents")
def page_footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(F.lit("12"), F.lit("- 3 -"), F.lit(" iv "), F.lit("Ⅻ"), F.lit("3 pages")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_page_number(line).alias("footer"))


@query("SELECT doc_id, '=== Page ' || (doc_id % 50) || ' (' || format('{:,.0f}', 612.0) || 'x' || format('{:,.0f}', 792.0) || ', body=' || format('{:,.1f}', (doc_id % 30) / 2.0) || 'pt) ===' AS header FROM documents")
def cli_page_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.page_header(F.col("doc_id") % 50, F.lit(612.0), F.lit(792.0), (F.col("doc_id") % 30) / 2).alias("header"))


@query("SELECT doc_id, n, CASE WHEN n / 10.0 >= 1.8 THEN 1 WHEN n / 10.0 >= 1.5 THEN 2 WHEN n / 10.0 >= 1.3 THEN 3 WHEN doc_id % 2 = 0 AND n / 10.0 >= 1.1 THEN 3 ELSE 0 END AS level FROM (SELECT doc_id, doc_id % 25 AS n FROM documents)")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 25
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), text.heading_level(n.cast("double"), F.lit(10.0), F.col("doc_id") % 2 == 0).alias("level"))


@query("SELECT l_orderkey, l_linenumber, strftime(d, '%Y-%m-%d') AS shown FROM (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS d FROM lineitem)")
def excel_serial_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.datediff(F.to_date("l_shipdate"), F.lit("1899-12-30").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", excel.date_of_serial(serial).alias("shown"))


@query("SELECT n, CASE WHEN n < 1 THEN '0000-00-00' ELSE strftime(DATE '1899-12-31' + (n - CASE WHEN n > 60 THEN 1 ELSE 0 END)::INTEGER, '%Y-%m-%d') END AS shown FROM (SELECT DISTINCT doc_id % 120 AS n FROM documents)")
def excel_early_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 120).alias("n")).distinct().select("n", excel.date_of_serial(F.col("n")).alias("shown"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS shown FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def excel_serial_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select("event_id", excel.time_of_serial(F.lit(45000) + seconds / 86400).alias("shown"))


@query("SELECT o_orderkey, format('{:,.0f}', round_even(o_totalprice, 0)) AS shown FROM orders")
def number_group_0dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", excel.grouped(F.col("o_totalprice"), 0).alias("shown"))


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS shown FROM orders")
def number_group_2dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", excel.grouped(F.col("o_totalprice"), 2).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, format('{:.2f}', l_discount * 100) || '%' AS shown FROM lineitem")
def percent_2dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", excel.percent(F.col("l_discount"), 2).alias("shown"))


_LETTERS = "CASE WHEN c > 702 THEN chr((((c - 703) // 676) % 26 + 65)::INTEGER) ELSE '' END || CASE WHEN c > 26 THEN chr((((c - 27) // 26) % 26 + 65)::INTEGER) ELSE '' END || chr(((c - 1) % 26 + 65)::INTEGER)"


@query(f"SELECT p_partkey, {_LETTERS} AS letters FROM (SELECT p_partkey, p_partkey % 16384 + 1 AS c FROM part)")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", excel.column_letters(F.col("p_partkey") % 16384).alias("letters"))


@query("SELECT p_partkey, (p_partkey % 16384)::INTEGER AS column_no, (p_size - 1)::INTEGER AS row_no FROM part")
def cell_ref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(excel.column_letters(F.col("p_partkey") % 16384), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", excel.cell_column(ref).alias("column_no"), excel.cell_row(ref).alias("row_no"))


@query("SELECT p_type, count(DISTINCT p_brand) AS brands, min(p_size) AS least, list_sort(list(p_size))[(count(*) // 2 + 1)::INTEGER] AS middle FROM part GROUP BY p_type")
def median_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes are counted first, so that a window sees a type's different sizes, not its rows
    part, order = table(spark, sf_dir, "part"), Window.partitionBy("p_type").orderBy("p_size")
    counts = part.groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("p_type")))
    middle = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("p_type").agg(F.min("p_size").alias("middle"))
    return part.groupBy("p_type").agg(F.countDistinct("p_brand").alias("brands"), F.min("p_size").alias("least")).join(middle, "p_type")


@query("SELECT r_regionkey, regexp_matches(name, '^(word|xl|ppt)/embeddings/[^/]+$') AS embedded FROM (SELECT r_regionkey, ['word/embeddings/a.xlsx','xl/embeddings/b/c.bin','ppt/embeddings/d.docx','word/media/e.png','xl/embeddings/'][r_regionkey + 1] AS name FROM region)")
def embedded_part_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["word/embeddings/a.xlsx", "xl/embeddings/b/c.bin", "ppt/embeddings/d.docx", "word/media/e.png", "xl/embeddings/"]))
    return table(spark, sf_dir, "region").select("r_regionkey", text.is_embedded_part(F.element_at(names, F.col("r_regionkey") + 1)).alias("embedded"))
