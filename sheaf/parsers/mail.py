"""Mail messages (.eml): headers, the MIME tree, the body, attachments by name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import charsets, html
from .base import Options, Page, Pages
from .codecs import base64_bytes, quoted_printable
from .markdown import SPACE

DEPTH = 32
_WORD = re.compile(r"=\?([^?]*)\?([^?]*)\?(.*?)\?=", re.S)
_PARAMETER = re.compile(r"[; \t]*([^=;]*(?:;[^=]*)?)=[ \t]*(?:\"([^\"]*)\"?|([^;]*))")


@dataclass
class Part:
    path: tuple[int, ...]
    content_type: str = "text/plain"
    charset: str = ""
    filename: str = ""
    disposition: str = ""
    body: str = ""
    size: int = 0
    parts: list[Part] = field(default_factory=list)

    @property
    def multipart(self) -> bool:
        return self.content_type.startswith("multipart/")


def latin(data: bytes) -> str:
    """Bytes as characters one by one, for looking at structure."""
    return data.decode("latin-1")


def decoded_words(value: str) -> str:
    """Encoded words of a header (given byte by byte), without white space between two of them."""
    out, at, after_word = [], 0, False
    for m in _WORD.finditer(value):
        between = value[at : m.start()]
        if not (after_word and between and not between.strip(SPACE)):
            out.append(charsets.plain_text(between.encode("latin-1")))
        raw = m[3].encode("latin-1")
        kind = m[2].lower()
        raw = base64_bytes(raw) if kind == "b" else quoted_printable(raw, underscores=True) if kind == "q" else raw
        out.append(charsets.by_label(raw, m[1]))
        at, after_word = m.end(), True
    return "".join(out) + charsets.plain_text(value[at:].encode("latin-1"))


def parameters(value: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _PARAMETER.finditer(value):
        key = m[1].strip(SPACE).lower()
        if key:
            found[key] = m[2] if m[2] is not None else m[3].strip(SPACE)
    return found


def split_headers(raw: str) -> tuple[dict[str, str], str]:
    """Headers by name in small letters, the first of a name; and what comes after the blank line."""
    headers: dict[str, str] = {}
    name, at = "", 0
    while at < len(raw):
        end = raw.find("\n", at)
        line, at = (raw[at:], len(raw)) if end < 0 else (raw[at:end], end + 1)
        line = line.removesuffix("\r")
        if not line:
            break
        if line[0] in " \t":
            if name:
                headers[name] += " " + line.lstrip(" \t")
            continue
        name, colon, value = line.partition(":")
        name = name.lower() if colon and name.lower() not in headers else ""
        if name:
            headers[name] = value.lstrip(" \t")
    return headers, raw[at:]


def read_part(headers: dict[str, str], body: str, path: tuple[int, ...] = ()) -> Part:
    kind, _, rest = headers.get("content-type", "text/plain").partition(";")
    own = parameters(rest)
    where, _, more = headers.get("content-disposition", "").partition(";")
    part = Part(path, kind.strip(SPACE).lower(), own.get("charset", "").lower(), disposition=where.strip(SPACE).lower())
    part.filename = decoded_words(parameters(more).get("filename") or own.get("name", ""))
    boundary = own.get("boundary", "")
    if part.multipart and boundary and len(path) < DEPTH:
        part.parts = [read_part(*split_headers(x), (*path, n)) for n, x in enumerate(_between(body, "--" + boundary))]
        return part
    raw, coding = body.encode("latin-1"), headers.get("content-transfer-encoding", "").strip(SPACE).lower()
    raw = base64_bytes(raw) if coding == "base64" else quoted_printable(raw) if coding == "quoted-printable" else raw
    part.size = len(raw)
    part.body = charsets.by_label(raw, part.charset) if part.content_type.startswith("text/") else latin(raw)
    return part


def _between(body: str, mark: str) -> Iterator[str]:
    """What stands between lines that begin with the mark, until one that goes on with `--`."""
    start = None
    for m in re.finditer(r"^.*(?:\n|\Z)", body, re.M):
        line = m[0]
        if line.startswith(mark):
            if start is not None:
                yield body[start : m.start()]
            if line.startswith(mark + "--"):
                return
            start = m.end()


def flat(part: Part) -> Iterator[Part]:
    yield part
    for x in part.parts:
        yield from flat(x)


def body_of(part: Part, attachments: list[str], options: Options) -> str:
    """The text of a part; an alternative's plain text before its HTML; attachments are only named."""
    if part.content_type == "multipart/alternative":
        by = {x.content_type: x for x in reversed(part.parts)}
        chosen = by.get("text/plain") or by.get("text/html") or (part.parts[0] if part.parts else None)
        return body_of(chosen, attachments, options) if chosen else ""
    if part.multipart:
        return "\n\n".join(filter(None, [body_of(x, attachments, options) for x in part.parts]))
    text = part.content_type.startswith("text/")
    if part.disposition == "attachment" or part.filename and not text:
        attachments.append(f"{part.filename or part.content_type} ({part.content_type})")
        return ""
    if part.content_type == "text/html":
        return html.convert(part.body, options)[0] if part.body else ""
    return part.body if text else ""


def markdown(data: bytes, options: Options = Options()) -> str:
    headers, body = split_headers(latin(data))
    attachments: list[str] = []
    text = body_of(read_part(headers, body), attachments, options).strip(SPACE)
    value = lambda name: decoded_words(headers.get(name, ""))
    subject, known = value("subject"), [(n, value(n.lower())) for n in ("From", "To", "Cc", "Date")]
    lines = "".join(f"**{n}:** {v}\n" for n, v in known if v)
    out = (f"# {subject}\n\n" if subject else "") + (f"{lines}\n---\n\n" if lines else "") + text
    return out + ("\n\n## 첨부파일\n" + "".join(f"- {a}\n" for a in attachments) if attachments else "")


def pages(data: bytes, options: Options = Options()) -> Pages:
    yield Page(0, markdown(data, options))
