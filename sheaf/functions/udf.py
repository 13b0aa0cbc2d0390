"""Arrow functions for what no native expression can do: conversion and charsets. Batches, never single rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import formats
from ..operators import convert
from ..parsers import charsets, codecs, html, mail
from ..parsers.base import Options


def _texts(one: Callable[[object], str | None], *columns: Column, returns: str = "string") -> Column:
    kind = pa.binary() if returns == "binary" else pa.string()

    @F.arrow_udf(returns)
    def each(*arrays: pa.Array) -> pa.Array:
        return pa.array([one(*values) for values in zip(*(a.to_pylist() for a in arrays), strict=True)], kind)

    return each(*columns)


def _kept(one: Callable) -> Callable:
    return lambda x: None if x is None else one(x)


def html_to_markdown(c: Column) -> Column:
    """Of HTML text."""
    return _texts(_kept(html.html_to_markdown), c)


def html_bytes_to_markdown(c: Column) -> Column:
    """Of HTML as bytes, whose charset is found out."""
    return _texts(_kept(lambda b: html.html_to_markdown(charsets.html_text(b))), c)


def to_markdown(content: Column, name: Column, options: Options = Options()) -> Column:
    """A struct (markdown, error) for files of any format."""
    @F.arrow_udf("markdown string, error string")
    def each(data: pa.Array, names: pa.Array) -> pa.Array:
        found = [convert.safe_markdown(d, n, options) for d, n in zip(data.to_pylist(), names.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["markdown", "error"])

    return each(content, name)


def detect(content: Column, name: Column) -> Column:
    """The format's name, containers opened."""
    return _texts(lambda d, n: None if d is None else formats.detect_bytes(d, n or ""), content, name)


def plain_text(c: Column) -> Column:
    return _texts(_kept(charsets.plain_text), c)


def charset_text(c: Column, label: str) -> Column:
    return _texts(_kept(lambda b: charsets.by_label(b, label)), c)


def encoded_words(c: Column) -> Column:
    """A header's value with its encoded words decoded."""
    return _texts(_kept(lambda s: mail.decoded_words(s.encode().decode("latin-1"))), c)


def quoted_printable(c: Column, header: bool = False) -> Column:
    return _texts(_kept(lambda b: codecs.quoted_printable(b, header)), c, returns="binary")


def entities(c: Column) -> Column:
    """Named and numeric entities."""
    return _texts(_kept(html.decode_entities), c)


def image_dimensions(c: Column) -> Column:
    """Width and height by an image's header."""
    from ..parsers import images

    @F.arrow_udf("width int, height int")
    def each(data: pa.Array) -> pa.Array:
        found = [images.dimensions(d or b"") for d in data.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())], ["width", "height"])

    return each(c)
