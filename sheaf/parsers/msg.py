"""Outlook messages (.msg): properties as streams of a compound file."""

from __future__ import annotations

from ..containers.cfb import CompoundFile
from . import charsets, html
from .base import ConversionError, Options, Page, Pages
from .markdown import SPACE


class Message:
    def __init__(self, data: bytes):
        try:
            self.file = CompoundFile(data)
        except ValueError as e:
            raise ConversionError("cannot open message") from e

    def text(self, number: int, storage: str = "") -> str:
        """A property as UTF-16, else in a code page."""
        base = f"{storage}__substg1.0_{number:04X}"
        if self.file.has(base + "001F"):
            return charsets.utf16(self.file.read(base + "001F")).rstrip("\0")
        return charsets.plain_text(self.file.read(base + "001E")).rstrip("\0")

    def storages(self, prefix: str) -> list[str]:
        return sorted({p.partition("/")[0] + "/" for p in self.file.paths(prefix) if "/" in p})

    def header(self) -> str:
        who = lambda name, mail: f"{name} <{mail}>" if name and mail else f"<{mail}>" if mail else name
        sender = who(self.text(0x0C1A) or self.text(0x0042), self.text(0x0C1F) or self.text(0x0065))
        to = "; ".join(filter(None, (who(self.text(0x3001, s), self.text(0x3003, s)) for s in self.storages("__recip_version1.0_#")))) or self.text(0x0E04)
        lines = [(n, v) for n, v in (("From", sender), ("To", to), ("Cc", self.text(0x0E03))) if v]
        return f"# {self.text(0x0037) or self.text(0x0070) or '(제목 없음)'}\n\n" + "".join(f"- **{n}:** {v}\n" for n, v in lines) + "\n---\n\n"

    def body(self, options: Options) -> str:
        if plain := self.text(0x1000):
            return plain
        if web := self.text(0x1013):
            return html.convert(web, options)[0]
        raw = self.file.read("__substg1.0_10130102")
        return html.convert(charsets.html_text(raw), options)[0] if raw else ""

    def attachments(self) -> str:
        own = self.storages("__attach_version1.0_#")
        names = [n for s in own if (n := self.text(0x3707, s) or self.text(0x3704, s))]
        return f"\n\n---\n\n**첨부({len(own)})**" + (": " + ", ".join(names) if names else "") + "\n" if own else ""


def markdown(data: bytes, options: Options = Options()) -> str:
    m = Message(data)
    body = m.body(options)
    return m.header() + (body if body.strip(SPACE) else "*(본문 없음)*\n") + m.attachments()


def pages(data: bytes, options: Options = Options()) -> Pages:
    yield Page(1, markdown(data, options))
