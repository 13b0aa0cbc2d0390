"""HTML to Markdown: tokens by one regular expression, and a writer that knows where text goes at the moment."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from .base import Image, Options, Page, Pages
from .charsets import html_text
from .markdown import SPACE, capped_lines, padded_table

_TOKEN = re.compile(
    r"(?P<text>[^<]+)"
    r"|<\ *!(?=--)(?:.*?-->|.*)"
    r"|<\ *![^>]*>?"
    r"|<\ *\?(?:.*?\?>|.*)"
    r"|<\ *(?P<close>/?)(?P<name>[^\ >/\n\r\t]*)(?P<attrs>(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|(?!/>)[^>\"'])*)(?:/?>|\Z)",
    re.S | re.X,
)
_SKIPPED = {"script": ("</script>", "</SCRIPT>"), "style": ("</style>", "</STYLE>")}
_ENTITY = re.compile(r"&([^;&]{0,10});|&([^;]{0,10});")
#: Entities by name; the no-break space becomes a common one.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019",
    "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "hellip": "\u2026", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122",
}
_BLANKS = re.compile(r"[ \n\r\t]+")


def _entity(m: re.Match) -> str:
    name = m[1] if m[1] is not None else m[2]
    if name in ENTITIES:
        return ENTITIES[name]
    if not name.startswith("#"):
        return m[0]
    hexadecimal = name[1:2] in ("x", "X")
    digits = re.sub(r"[^0-9a-fA-F]" if hexadecimal else r"\D", "", name[2:] if hexadecimal else name[1:])
    code = int(digits, 16 if hexadecimal else 10) if digits else 0
    return ("\ufffd" if 0xD800 <= code < 0xE000 else chr(code)) if 0 < code < 0x110000 else ""


def decode_entities(text: str) -> str:
    """Named entities that are known and numeric ones; others stay as they are."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


def attribute(attrs: str, key: str) -> str:
    """A value by its name as written; no letter or digit may stand before the name."""
    for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(key)}=(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^ >]*))?", attrs):
        return next((g for g in m.groups() if g is not None), "")
    return ""


def data_uri(src: str) -> tuple[bytes, str] | None:
    """The payload and format of a base64 data: URI of an image."""
    m = re.match(r"data:(image/([^;,]*)[^,]*),(.*)", src, re.S)
    if not m or "base64" not in m[1]:
        return None
    kind = {"svg+xml": "svg", "x-icon": "ico", "vnd.microsoft.icon": "ico"}.get(m[2].lower(), m[2].lower() or "bin")
    raw = re.sub(r"[^A-Za-z0-9+/]", "", m[3].split("=")[0])
    data = base64.b64decode(raw[: len(raw) - (len(raw) % 4 == 1)] + "=" * (-len(raw) % 4))
    return (data, kind) if data else None


class _Writer:
    """One conversion. `place` is where inline text goes: the innermost of cell, list item, link and document."""

    def __init__(self, options: Options):
        self.options, self.out, self.last = options, [], ""
        self.head = self.titled = self.pre = self.code = False
        self.title: list[str] = []
        self.cell: list[str] | None = None
        self.item: list[str] | None = None
        self.link: list[str] | None = None
        self.href = ""
        self.rows: list[list[str]] = []
        self.row: list[str] = []
        self.lists: list[list] = []  # [ordered, items so far]
        self.images: list[Image] = []

    def put(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.last = text[-1]

    def fresh(self, text: str = "\n") -> None:
        if self.last not in ("", "\n"):
            self.put(text)

    def inline(self, text: str, within_link: bool = True) -> None:
        for place in (self.cell, self.item, self.link if within_link else None):
            if place is not None:
                place.append(text)
                return
        self.put(text)

    def text(self, raw: str) -> None:
        if self.head:
            if self.titled:
                self.title.append(raw)
            return
        text = decode_entities(raw)
        if self.cell is not None or self.item is not None or self.link is not None or self.pre or self.code:
            self.inline(text)
            return
        text = _BLANKS.sub(" ", text)
        self.put(text[1:] if self.last == " " and text.startswith(" ") else text)

    def tag(self, name: str, closing: bool, attrs: str) -> None:
        if name == "head":
            self.head = not closing
        elif self.head:
            if name == "title":
                self.titled = not closing
        elif handler := _HANDLERS.get(name):
            handler(self, closing, attrs)

    def markdown(self) -> str:
        body, title = capped_lines("".join(self.out)), "".join(self.title).strip(SPACE)
        return f"# {decode_entities(title)}\n\n{body}" if title else body


def _heading(level: int) -> Callable:
    def handle(w: _Writer, closing: bool, attrs: str) -> None:
        if closing:
            w.put("\n\n")
        else:
            w.fresh()
            w.put("#" * level + " ")
    return handle


def _block(w: _Writer, closing: bool, attrs: str) -> None:
    if closing:
        w.put("\n\n")
    else:
        w.fresh("\n\n")


def _mark(sign: str) -> Callable:
    return lambda w, closing, attrs: w.inline(sign)


def _break(w: _Writer, closing: bool, attrs: str) -> None:
    if w.cell is not None or w.item is not None:
        w.inline(" ")
    else:
        w.put("\n")


def _code(w: _Writer, closing: bool, attrs: str) -> None:
    w.put("" if w.pre else "`")
    w.code = not closing


def _pre(w: _Writer, closing: bool, attrs: str) -> None:
    if closing:
        w.put("\n```\n\n")
    else:
        w.fresh()
        w.put("```\n")
    w.pre = not closing


def _quote(w: _Writer, closing: bool, attrs: str) -> None:
    if closing:
        w.put("\n\n")
    else:
        w.fresh()
        w.put("> ")


def _link(w: _Writer, closing: bool, attrs: str) -> None:
    if not closing:
        w.link, w.href = [], attribute(attrs, "href")
        return
    text, w.link = "".join(w.link or ()), None
    if text:
        w.inline(f"[{text}]({w.href})" if w.href else text, within_link=False)
    w.href = ""


def _image(w: _Writer, closing: bool, attrs: str) -> None:
    src, alt = attribute(attrs, "src"), attribute(attrs, "alt") or "image"
    if not src:
        return
    from . import images

    image = Image(1, f"page1_img{len(w.images)}", format=images.format_of_extension(images.extension(src)))
    if found := data_uri(src):
        image.data, image.format = found
        image.width, image.height = images.dimensions(image.data)
        if not images.wanted(image, w.options):
            return
        src = w.options.image_ref_prefix + f"{image.name}.{images.file_extension(image.format)}"
    w.inline(f"![{alt}]({src})", within_link=False)
    w.images.append(image)


def _list(ordered: bool) -> Callable:
    def handle(w: _Writer, closing: bool, attrs: str) -> None:
        if not closing:
            w.fresh()
            w.lists.append([ordered, 0])
            return
        if w.lists:
            w.lists.pop()
        if not w.lists:
            w.put("\n")
    return handle


def _item(w: _Writer, closing: bool, attrs: str) -> None:
    if closing and w.item is not None and w.lists:
        own = w.lists[-1]
        own[1] += own[0]
        w.put("  " * (len(w.lists) - 1) + (f"{own[1]}. " if own[0] else "- ") + "".join(w.item).strip(SPACE) + "\n")
    w.item = None if closing else []


def _table(w: _Writer, closing: bool, attrs: str) -> None:
    if closing and w.rows:
        w.put("\n" + padded_table(w.rows) + "\n")
    w.rows = []


def _row(w: _Writer, closing: bool, attrs: str) -> None:
    if closing and w.row:
        w.rows.append(w.row)
    w.row = []


def _cell(w: _Writer, closing: bool, attrs: str) -> None:
    if closing:
        w.row.append("".join(w.cell or ()).strip(SPACE).replace("|", "\\|").replace("\n", " ").replace("\r", " "))
    w.cell = None if closing else []


def _definitions(w: _Writer, closing: bool, attrs: str) -> None:
    if closing:
        w.put("\n")
    else:
        w.fresh("\n\n")


_HANDLERS: dict[str, Callable[[_Writer, bool, str], None]] = {
    **{f"h{n}": _heading(n) for n in range(1, 7)},
    **dict.fromkeys(("p", "div", "section", "article", "main"), _block),
    **dict.fromkeys(("b", "strong"), _mark("**")),
    **dict.fromkeys(("i", "em"), _mark("*")),
    **dict.fromkeys(("td", "th"), _cell),
    "br": _break,
    "hr": lambda w, closing, attrs: w.put("\n---\n\n"),
    "code": _code,
    "pre": _pre,
    "blockquote": _quote,
    "a": _link,
    "img": _image,
    "ul": _list(False),
    "ol": _list(True),
    "li": _item,
    "table": _table,
    "tr": _row,
    "dl": _definitions,
    "dt": lambda w, closing, attrs: w.put("\n" if closing else "**"),
    "dd": lambda w, closing, attrs: w.put("\n" if closing else ": "),
}


def convert(text: str, options: Options = Options()) -> tuple[str, list[Image]]:
    """The Markdown of an HTML text, and its images. Scripts and styles are skipped when their end is found."""
    w, pos, size = _Writer(options), 0, len(text)
    while pos < size:
        m = _TOKEN.match(text, pos)
        pos = m.end()
        if m["text"]:
            w.text(m["text"])
        elif m["name"]:
            name = m["name"].lower()
            if name in _SKIPPED:
                ends = [text.find(e, pos) for e in _SKIPPED[name]] if not m["close"] else []
                end = next((e for e in ends if e >= 0), -1)
                pos = end + len(name) + 3 if end >= 0 else pos
            else:
                w.tag(name, bool(m["close"]), m["attrs"])
    return w.markdown(), w.images


def html_to_markdown(text: str) -> str:
    return convert(text)[0] if text else ""


def pages(data: bytes, options: Options = Options(), hint: str = "") -> Pages:
    text, images = convert(html_text(data, hint), options)
    yield Page(1, text, images=images)
