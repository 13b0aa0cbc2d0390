"""Rich text: groups and control words; destinations that aren't the body are skipped."""

from __future__ import annotations

import re

from .base import Image, Options, Page, Pages
from .codecs import hex_bytes
from .markdown import capped_lines, table as markdown_table

_TOKEN = re.compile(rb"\\'([0-9A-Fa-f]{2})|\\([A-Za-z]+)(-?\d+)? ?|\\([^A-Za-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
#: Destinations without body text.
SKIPPED = frozenset("fonttbl colortbl stylesheet info header headerl headerr headerf footer footerl footerr footerf listtable listoverridetable rsidtbl generator themedata colorschememapping datastore latentstyles xmlnstbl fldinst bkmkstart bkmkend object objdata pgdsctbl filetbl revtbl".split())
_SIGNS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
_CODEPAGES = {949: "cp949", 1361: "johab", 932: "cp932", 936: "gbk", 950: "big5", 65001: "utf-8"}
#: Parts cells from each other within a line.
CELL = "\x1f"


class Reader:
    def __init__(self, data: bytes, options: Options):
        self.options, self.out, self.pending = options, [], bytearray()
        self.codepage, self.images = "cp1252", []
        self.state = {"skip": False, "uc": 1, "bold": False, "italic": False, "picture": None}
        self.stack: list[dict] = []
        self.left = 0  # characters that stand for the last \u
        self.starred = False
        for m in _TOKEN.finditer(data):
            self._token(m)
        self._flush()

    def _flush(self) -> None:
        if self.pending:
            self.out.append(self.pending.decode(self.codepage, "replace"))
            self.pending.clear()

    def _put(self, text: str) -> None:
        self._flush()
        if not self.state["skip"]:
            self.out.append(text)

    def _bytes(self, raw: bytes) -> None:
        if self.left:
            gone = min(self.left, len(raw))
            self.left, raw = self.left - gone, raw[gone:]
        if self.state["picture"] is not None:
            self.state["picture"]["hex"] += raw.decode("latin-1")
        elif not self.state["skip"]:
            self.pending += raw

    def _token(self, m: re.Match) -> None:
        if m[1]:
            self._bytes(bytes([int(m[1], 16)]))
        elif m[2]:
            self._word(m[2].decode(), int(m[3]) if m[3] else None)
        elif m[4]:
            sign = m[4].decode("latin-1")
            if sign in "\\{}":
                self._bytes(m[4])
            elif sign == "~":
                self._put(" ")
            elif sign == "*":
                self.starred = True
            elif sign in "\r\n":
                self._put("\n")
        elif m[5] == b"{":
            self._flush()
            self.stack.append(self.state)
            self.state, self.starred = dict(self.state), False
        elif m[5] == b"}":
            self._flush()
            if self.state["picture"] is not None and (not self.stack or self.stack[-1]["picture"] is None):
                self._picture(self.state["picture"])
            self.state = self.stack.pop() if self.stack else self.state
        elif m[6]:
            self._bytes(m[6])

    def _word(self, word: str, value: int | None) -> None:
        if self.starred or word in SKIPPED:
            if word not in ("shppict", "nonshppict") or word == "nonshppict":
                self.state["skip"] = True
            self.starred = False
        if word == "pict":
            self.state["picture"] = None if self.state["skip"] else {"hex": "", "format": "bin", "w": 0, "h": 0}
            return
        picture = self.state["picture"]
        if picture is not None:
            kinds = {"pngblip": "png", "jpegblip": "jpeg", "emfblip": "emf", "wmetafile": "wmf", "dibitmap": "bmp"}
            picture["format"] = kinds.get(word, picture["format"])
            picture |= {"w": value or 0} if word == "picw" else {"h": value or 0} if word == "pich" else {}
        elif word == "u" and value is not None:
            self._put(chr(value % 65536) if not 0xD800 <= value % 65536 < 0xE000 else self._surrogate(value % 65536))
            self.left = self.state["uc"]
        elif word == "uc":
            self.state["uc"] = value or 0
        elif word == "ansicpg":
            self._flush()
            self.codepage = _CODEPAGES.get(value or 1252, f"cp{value}" if value in range(1250, 1259) else "cp1252")
        elif word == "par":
            self._put("\n\n" if not self.state["skip"] else "")
        elif word == "sect" or word == "page":
            self._put("\n\n")
        elif word == "cell":
            self._put(CELL)
        elif word == "row":
            self._put(CELL + "\n")
        elif word in _SIGNS:
            self._put(_SIGNS[word])

    def _surrogate(self, unit: int) -> str:
        self._flush()
        if 0xDC00 <= unit and self.out and "\ud800" <= self.out[-1][-1:] < "\udc00":
            high = self.out.pop()
            self.out.append(high[:-1])
            return chr(0x10000 + ((ord(high[-1]) - 0xD800) << 10) + unit - 0xDC00)
        return chr(unit)

    def _picture(self, p: dict) -> None:
        from . import images

        image = Image(1, f"page1_img{len(self.images)}", p["format"], hex_bytes(p["hex"]))
        image.width, image.height = images.dimensions(image.data)
        if self.options.images and image.data and images.wanted(image, self.options):
            self.images.append(image)
            self.out.append(f"\n\n![{image.name}]({images.reference(image, self.options)})\n\n")

    def text(self) -> str:
        return "".join(self.out).encode("utf-8", "replace").decode()


def rendered(text: str) -> tuple[str, list[list[list[str]]]]:
    """Lines with cells as tables, and the tables."""
    out, rows, tables = [], [], []
    for line in [*text.split("\n"), None]:
        if line is not None and CELL in line:
            cells = [c.strip().replace("|", "/") for c in line.split(CELL)]
            while cells and not cells[-1]:
                cells.pop()
            rows.append(cells)
            continue
        if rows and (line or line is None):
            rows = [r for r in rows if r]
            if rows:
                tables.append(rows)
                out.append("\n" + markdown_table(rows))
            rows = []
        if line is not None:
            out.append(line)
    return capped_lines("\n".join(out)).strip(), tables


def pages(data: bytes, options: Options = Options()) -> Pages:
    reader = Reader(data, options)
    text, tables = rendered(reader.text())
    yield Page(1, text, 612.0, 792.0, 12.0, tables if options.tables else [], reader.images)
