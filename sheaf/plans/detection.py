"""Detection queries: signatures, extensions, the format table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats
from ..functions import text, udf
from .registry import query, table

_VALUES = ", ".join(f"('{n}','{c}','{e}','{m}',{str(v).lower()})" for n, c, e, m, v in formats.FORMATS)
DIMENSION = f"(VALUES {_VALUES}) AS f(format, category, extension, mime, convertible)"
#: Names made from documents: an extension for each remainder of the id.
NAMES = ["report.pdf", "notes.HWPX", "old.hwp", "mail.eml", "pic.JPG", "book.xlsx", "page.htm", "draw.dwg", "pack.tgz", "pack.tar", "a.b.c.PY", "noext", "x.unknown", "data.CSV", "slides.odp"]
_CASES = " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(NAMES))
_EXTENSION_CASE = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es.split())}) THEN '{f}'" for f, es in formats.EXTENSIONS.items()) + " ELSE 'UNKNOWN' END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, NAMES))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % len(NAMES) + 1).cast("int")).alias("name"))


@query(f"SELECT doc_id, name, ext AS extension, {_EXTENSION_CASE} AS format FROM (SELECT *, lower(regexp_extract(name, '\\.[^.]*$')) AS ext FROM (SELECT doc_id, CASE doc_id % {len(NAMES)} {_CASES} END AS name FROM documents))")
def detect_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", "name", formats.extension(F.col("name")).alias("extension"), formats.format_of_extension(F.col("name")).alias("format"))


@query("SELECT page_id, 'HTML' AS format, 'document' AS category, 'text/html' AS mime, true AS convertible FROM pages WHERE lower(substr(html, 1, 256)) LIKE '%<!doctype html%' OR lower(substr(html, 1, 256)) LIKE '%<html%' UNION ALL SELECT page_id, CASE WHEN html LIKE '<%' THEN 'OFFICE' ELSE 'TXT' END, CASE WHEN html LIKE '<%' THEN 'document' ELSE 'text' END, CASE WHEN html LIKE '<%' THEN '' ELSE 'text/plain' END, true FROM pages WHERE NOT (lower(substr(html, 1, 256)) LIKE '%<!doctype html%' OR lower(substr(html, 1, 256)) LIKE '%<html%')")
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("html").cast("binary")
    found = table(spark, sf_dir, "pages").select("page_id", formats.detect_native(content, F.lit("")).alias("format"))
    return formats.described(found).select("page_id", "format", "category", "mime", "convertible")


@query("SELECT format, count(*) AS n FROM (SELECT 'HTML' AS format FROM pages WHERE html LIKE '<!DOCTYPE html%' OR html LIKE '<html%' UNION ALL SELECT 'TXT' FROM documents) GROUP BY format")
def detect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("html").cast("binary").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"))
    return pages.union(docs).select(formats.detect_native(F.col("content"), F.lit("")).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


#: Signatures to try, with what they are and what detection must say.
_SIGNATURES = [
    ("255044462D312E37", "PDF"), ("1F8B0800", "GZIP"), ("425A683931", "BZIP2"), ("377ABCAF271C0004", "7Z"), ("414C5A010A000000", "ALZ"), ("4547474100010000", "EGG"), ("526172211A070100", "RAR"),
    ("7B5C727466310000", "RTF"), ("89504E470D0A1A0A", "PNG"), ("FFD8FFE000104A46", "JPEG"), ("474946383961", "GIF"), ("38425053", "PSD"), ("49492A00", "TIFF"), ("524946460000000057454250", "WEBP"),
    ("00000100", "ICO"), ("424D000000000000000000", "BMP"), ("D7CDC69A0000", "WMF"), ("41433130333200", "DWG"), ("41433130333220636162", "TXT"), ("284457462056", "DWF"), ("00FF00FF", "UNKNOWN"), ("68656C6C6F", "TXT"), ("", "TXT"),
]
_SIGNED = " ".join(f"WHEN {n} THEN '{fmt}'" for n, (_, fmt) in enumerate(_SIGNATURES))


@query(f"SELECT doc_id, CASE doc_id % {len(_SIGNATURES)} {_SIGNED} END AS format FROM documents")
def detect_magic_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*(F.lit(h) for h, _ in _SIGNATURES))
    content = F.unhex(F.element_at(heads, (F.col("doc_id") % len(_SIGNATURES) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", formats.detect_native(content, F.lit("")).alias("format"))


@query(f"SELECT doc_id, CASE doc_id % {len(_SIGNATURES)} {_SIGNED} END AS format FROM documents")
def detect_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*(F.lit(h) for h, _ in _SIGNATURES))
    content = F.unhex(F.element_at(heads, (F.col("doc_id") % len(_SIGNATURES) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", udf.detect(content, F.lit("")).alias("format"))


@query(f"SELECT * FROM {DIMENSION}")
def format_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.dimension(spark)


@query(f"SELECT d.doc_id, d.format, f.category, f.extension, f.mime, f.convertible FROM (SELECT doc_id, ['PDF','DOCX','XLSX','ZIP','TXT'][doc_id % 5 + 1] AS format FROM documents) d JOIN {DIMENSION} ON d.format = f.format")
def format_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["PDF", "DOCX", "XLSX", "ZIP", "TXT"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("format"))
    return formats.described(docs).select("doc_id", "format", "category", "extension", "mime", "convertible")


@query(f"SELECT coalesce(category, 'all') AS category, coalesce(convertible::VARCHAR, 'all') AS convertible, count(*) AS n, grouping_id(category, convertible) AS level FROM {DIMENSION} GROUP BY ROLLUP (category, convertible)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.dimension(spark).rollup("category", "convertible").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce(F.col("convertible").cast("string"), F.lit("all")).alias("convertible"), "n", "level")


@query("SELECT doc_id, doc_id % 3 = 0 AS archive FROM documents")
def archive_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["ZIP", "PDF", "TXT"]))
    return table(spark, sf_dir, "documents").select("doc_id", formats.is_archive(F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int"))).alias("archive"))


@query("SELECT doc_id, lower(regexp_extract(path, '\\.[^.]*$')) AS extension, regexp_extract(path, '[^/\\\\]*$') AS filename FROM (SELECT doc_id, source || '/' || lang || '\\' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '.TXT' WHEN doc_id % 4 = 2 THEN '.tar.gz' ELSE '.' END AS path FROM documents)")
def filename_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, ".TXT").when(F.col("doc_id") % 4 == 2, ".tar.gz").otherwise(".")
    path = F.concat("source", F.lit("/"), "lang", F.lit("\\"), F.col("doc_id").cast("string"), end)
    return table(spark, sf_dir, "documents").select("doc_id", text.extension(path).alias("extension"), text.filename(path).alias("filename"))
