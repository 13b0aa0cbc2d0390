"""Names for SQL: scalar functions, and table functions for LATERAL.

    SELECT f.path, p.* FROM files f, LATERAL document_pages(f.content, f.name) p
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import formats
from ..containers.walk import Limits, Walk
from ..parsers import charsets, html
from ..parsers.base import ConversionError, Options
from ..parsers.markdown import strip_markdown
from . import convert


class DocumentPages:
    def eval(self, content: bytes, name: str) -> Iterator[tuple]:
        n = 0
        try:
            for n, p in enumerate(convert.pages(content or b"", name or ""), 1) if content is not None else ():
                yield n - 1, p.page_number, p.text, p.page_width, p.page_height, p.body_font_size, None
        except ConversionError as e:
            yield n, None, None, None, None, None, str(e)


class ArchiveMembers:
    def eval(self, content: bytes, name: str) -> Iterator[tuple]:
        for r in Walk(Limits(), Options(), convert.markdown).run(bytes(content), name or "") if content is not None else ():
            yield r.member_path, r.format, r.markdown, r.error, r.error_code, r.uncompressed_size


class TableCells:
    def eval(self, content: bytes, name: str) -> Iterator[tuple]:
        try:
            for n, p in enumerate(convert.pages(content or b"", name or "") if content is not None else ()):
                for t, table in enumerate(p.tables):
                    for r, row in enumerate(table):
                        yield from ((n, t, r, c, v) for c, v in enumerate(row))
        except ConversionError:
            return


class DocumentImages:
    def eval(self, content: bytes, name: str) -> Iterator[tuple]:
        try:
            for n, p in enumerate(convert.pages(content or b"", name or "") if content is not None else ()):
                yield from ((n, i.name, i.format, i.width, i.height, i.data) for i in p.images)
        except ConversionError:
            return


_TABLES = {
    "document_pages": (DocumentPages, "page_ordinal INT, page_number INT, text STRING, page_width DOUBLE, page_height DOUBLE, body_font_size DOUBLE, error STRING"),
    "archive_members": (ArchiveMembers, "member_path STRING, format STRING, markdown STRING, error STRING, error_code STRING, uncompressed_size BIGINT"),
    "table_cells": (TableCells, "page_ordinal INT, table_no INT, row_no INT, column_no INT, value STRING"),
    "document_images": (DocumentImages, "page_ordinal INT, name STRING, format STRING, width BIGINT, height BIGINT, data BINARY"),
}
#: Scalar functions of one or two columns, run over Arrow batches.
_SCALARS = {
    "detect_format": lambda data, name: None if data is None else formats.detect_bytes(bytes(data), name or ""),
    "document_markdown": lambda data, name: convert.safe_markdown(bytes(data) if data is not None else None, name, Options())[0],
    "document_error": lambda data, name: convert.safe_markdown(bytes(data) if data is not None else None, name, Options())[1],
    "html_markdown": lambda page: None if page is None else html.html_to_markdown(page),
    "plain_markdown": lambda md: None if md is None else strip_markdown(md),
    "charset_text": lambda data, label: None if data is None else charsets.by_label(bytes(data), label or ""),
}


def register(spark: SparkSession) -> None:
    """Makes all of them known to a session under these names."""
    for name, (handler, returns) in _TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=returns))
    for name, one in _SCALARS.items():
        spark.udf.register(name, F.udf(one, StringType(), useArrow=True))
