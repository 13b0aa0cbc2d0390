"""Bytes to text by charset label, byte order mark, declaration or validity."""

from __future__ import annotations

import re

#: Labels without signs, in small letters.
LABELS = {
    "euc-kr": "euckr ksc56011987 ksc5601 cp949 windows949 ms949 uhc korean xwindows949",
    "utf-16-be": "utf16be",
    "utf-16-le": "utf16 utf16le unicode",
    "latin-1": "iso88591 latin1 windows1252 cp1252",
    "utf-8": "utf8 usascii ascii",
}
_BY_LABEL = {label: kind for kind, labels in LABELS.items() for label in labels.split()}
_META = re.compile(rb"<meta[^>]*?charset[^>=]*=[ \"']*([^\"' ;>]+)", re.I)


def charset_of_label(label: str) -> str:
    """The charset that a label names; empty if unknown."""
    return _BY_LABEL.get(re.sub(r"[^a-z0-9]", "", label.lower()), "")


def is_valid_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def sanitized(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def cp949(data: bytes) -> str:
    return data.decode("cp949", "replace")


def windows1252(data: bytes) -> str:
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data) if any(b in data for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else data.decode("cp1252")


def utf16(data: bytes, order: str = "le") -> str:
    """An odd last byte is dropped; lone surrogates become U+FFFD."""
    return data[: len(data) // 2 * 2].decode(f"utf-16-{order}", "replace")


def plain_text(data: bytes) -> str:
    """UTF-8 if valid, else Korean."""
    return data.decode() if is_valid_utf8(data) else cp949(data)


def decoded(data: bytes, charset: str) -> str:
    """By a charset from charset_of_label; a document that is UTF-8 in spite of a Korean label stays so."""
    if charset == "utf-8":
        return sanitized(data)
    if charset == "utf-16-le":
        return utf16(data)
    if charset == "utf-16-be":
        return utf16(data, "be")
    if charset == "latin-1":
        return windows1252(data)
    return plain_text(data)


def by_label(data: bytes, label: str) -> str:
    """Mail bodies and headers: by their label, else like plain text."""
    return decoded(data, charset_of_label(label))


def html_text(data: bytes, hint: str = "") -> str:
    """Byte order mark, then the hint, then a <meta> in the first 2048 bytes, then validity."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return decoded(data[len(mark) :], charset)
    declared = _META.search(data[:2048])
    charset = charset_of_label(hint) or (charset_of_label(declared[1].decode("latin-1")) if declared else "")
    return decoded(data, charset)
