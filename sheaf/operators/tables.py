"""Table functions over a column of file contents: one row in, rows of pages, cells, images, members or parts out.

All run as mapInArrow in the partition that holds the file, so nothing is shuffled; keep columns are repeated. A file is
one task's work; `archive_entries` splits the walk from the conversion, so that members can be dealt out before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema
from ..containers.walk import Limits, Walk
from ..parsers import mail
from ..parsers.base import ConversionError, Options
from . import convert

Row = dict
#: Rows gathered before they go back to Spark, and their bytes of content.
ROWS, BYTES = 256, 8 << 20


def _table(df: DataFrame, content: str, name: str | None, keep: Sequence[str], ddl: str, rows: Callable[[bytes, str], Iterator[Row]]) -> DataFrame:
    """Applies rows(content, name) to each file; a null content gives no row. Columns to keep must not be named as those given."""
    own = StructType.fromDDL(ddl)
    clash = {f.name.lower() for f in own} & {k.lower() for k in keep}
    if clash:
        raise ValueError(f"columns to keep are named as results: {sorted(clash)}")
    source = df.select(*(F.col(k) for k in keep), F.col(content).cast("binary").alias("__content"), (F.col(name).cast("string") if name else F.lit("")).alias("__name"))
    shape = StructType([*(df.select(*keep).schema if keep else []), *own])
    arrow, given = to_arrow_schema(shape), to_arrow_schema(own)

    def made(batch: pa.RecordBatch, at: list[int], out: list[Row]) -> pa.RecordBatch:
        """Rows of results beside what is kept of the files they are from, taken as Arrow columns."""
        kept = [batch.column(n).take(pa.array(at, pa.int64())).cast(arrow.field(n).type) for n in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, *pa.RecordBatch.from_pylist(out, schema=given).columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, size = [], [], 0
            for i in range(batch.num_rows):
                data, label = batch.column(len(keep))[i].as_py(), batch.column(len(keep) + 1)[i].as_py()
                if data is None:
                    continue
                for row in rows(data, label or ""):
                    at.append(i)
                    out.append(row)
                    size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
                    if len(out) >= ROWS or size >= BYTES:
                        yield made(batch, at, out)
                        at, out, size = [], [], 0
            if out:
                yield made(batch, at, out)

    return source.mapInArrow(run, shape)


def _pages(options: Options, permissive: bool) -> Callable[[bytes, str], Iterator[Row]]:
    def rows(data: bytes, name: str) -> Iterator[Row]:
        n = 0
        try:
            for n, p in enumerate(convert.pages(data, name, options), 1):
                images = [{"page_number": i.page_number, "name": i.name, "width": i.width, "height": i.height, "components": i.components, "data": i.data, "format": i.format, "embedded_text": i.embedded_text} for i in p.images]
                yield {"page_ordinal": n - 1, "page_number": p.page_number, "text": p.text, "page_width": p.page_width, "page_height": p.page_height, "body_font_size": p.body_font_size, "tables": p.tables, "images": images, "degraded_images": p.degraded_images, "error": None}
        except ConversionError as e:
            if not permissive:
                raise
            yield {"page_ordinal": n, "error": str(e)}

    return rows


def document_pages(df: DataFrame, content: str = "content", name: str | None = None, keep: Sequence[str] = (), options: Options = Options(), mode: str = "PERMISSIVE") -> DataFrame:
    """A row a page: see schema.PAGE. PERMISSIVE gives a file that can't be converted a row with `error`; FAILFAST raises."""
    return _table(df, content, name, keep, schema.PAGE, _pages(options, mode.upper() != "FAILFAST"))


def table_cells(df: DataFrame, content: str = "content", name: str | None = None, keep: Sequence[str] = (), options: Options = Options()) -> DataFrame:
    """A row a cell of the tables found on pages."""
    def rows(data: bytes, label: str) -> Iterator[Row]:
        try:
            for n, page in enumerate(convert.pages(data, label, options)):
                for t, table in enumerate(page.tables):
                    for r, row in enumerate(table):
                        yield from ({"page_ordinal": n, "table_no": t, "row_no": r, "column_no": c, "value": v} for c, v in enumerate(row))
        except ConversionError:
            return

    return _table(df, content, name, keep, schema.CELL, rows)


def document_images(df: DataFrame, content: str = "content", name: str | None = None, keep: Sequence[str] = (), options: Options = Options()) -> DataFrame:
    """A row an image; the payload stays a column."""
    found = document_pages(df, content, name, keep, options)
    return found.select(*keep, "page_ordinal", F.inline("images"))


def archive_members(df: DataFrame, content: str = "content", name: str | None = None, keep: Sequence[str] = (), options: Options = Options(), limits: Limits = Limits()) -> DataFrame:
    """A row a member, converted; nested archives are walked under one budget per file. Files that are no archive are one row."""
    def rows(data: bytes, label: str) -> Iterator[Row]:
        for r in Walk(limits, options, convert.markdown).run(data, label):
            yield {"member_path": r.member_path, "format": r.format, "markdown": r.markdown, "error": r.error, "error_code": r.error_code, "uncompressed_size": r.uncompressed_size}

    return _table(df, content, name, keep, schema.MEMBER, rows)


def archive_entries(df: DataFrame, content: str = "content", name: str | None = None, keep: Sequence[str] = (), options: Options = Options(), limits: Limits = Limits()) -> DataFrame:
    """A row a member with its bytes: repartition them, then convert, where a few large archives hold most of the work."""
    def rows(data: bytes, label: str) -> Iterator[Row]:
        for r in Walk(limits, options, None).run(data, label):
            yield {"member_path": r.member_path, "format": r.format, "content": r.content, "error": r.error, "error_code": r.error_code, "uncompressed_size": r.uncompressed_size}

    return _table(df, content, name, keep, schema.ENTRY, rows)


def mime_parts(df: DataFrame, content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """A row a part of a mail's MIME tree, in order."""
    def rows(data: bytes, label: str) -> Iterator[Row]:
        headers, body = mail.split_headers(mail.latin(data))
        for p in mail.flat(mail.read_part(headers, body)):
            yield {"path": ".".join(map(str, p.path)), "content_type": p.content_type, "charset": p.charset, "filename": p.filename, "disposition": p.disposition, "size": p.size, "body": p.body if p.content_type.startswith("text/") else ""}

    return _table(df, content, None, keep, schema.MIME_PART, rows)
