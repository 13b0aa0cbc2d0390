"""Markdown made and taken away."""

from __future__ import annotations

import re
from collections.abc import Sequence

SPACE = " \t\r\n"
_MARKS = re.compile(r"(?P<row>^\|[^\n]*\n?)|(?P<heading>^#+ )|(?P<rule>^-{3,}(?=\n|\Z))|(?P<image>!\[(?P<alt>[^\]]*)\]\([^)]*\))|\*+", re.M)
_RUNS = re.compile(r"\n{3,}")


def strip_markdown(text: str) -> str:
    """Plain text: without heading marks, rules, stars, table lines; images as [image: alt].

    Rows become cells two spaces apart and always end their line; lines that part a table's head from its body go.
    """
    return _MARKS.sub(_plain, text)


def _plain(m: re.Match) -> str:
    if m["row"]:
        line = m["row"].rstrip("\n")
        if "-" in line and not set(line) - set("|-: "):
            return ""
        inner = line[1:-1] if len(line) > 1 and line.endswith("|") else line[1:]
        row = ""
        for cell in inner.split("|")[: -1 if inner.endswith("|") else None]:
            row += ("  " if row else "") + cell.strip(SPACE).replace("*", "")
        return row + "\n"
    if m["image"]:
        return f"[image: {m['alt']}]" if m["alt"] else ""
    return ""


def escape_cell(text: str, pipe: str = "\\|") -> str:
    return text.replace("|", pipe).replace("\n", " ").strip(SPACE)


def table(rows: Sequence[Sequence[str]]) -> str:
    """A table whose first row is the head; short rows are filled, an empty one is nothing."""
    wide = max((len(r) for r in rows), default=0)
    if not wide:
        return ""
    line = lambda cells: "|" + "".join(f" {c} |" for c in [*cells, *[""] * (wide - len(cells))]) + "\n"
    return line(rows[0]) + "|" + " --- |" * wide + "\n" + "".join(map(line, rows[1:]))


def padded_table(rows: Sequence[Sequence[str]]) -> str:
    """A table whose columns are filled to their widest cell in UTF-8 bytes, three at least."""
    wide = max((len(r) for r in rows), default=0)
    if not wide:
        return ""
    full = [[*r, *[""] * (wide - len(r))] for r in rows]
    sizes = [max(3, *(len(r[c].encode()) for r in full)) for c in range(wide)]
    line = lambda cells: "|" + "".join(f" {x}{' ' * (n - len(x.encode()))} |" for x, n in zip(cells, sizes, strict=True)) + "\n"
    return line(full[0]) + line(["-" * n for n in sizes]) + "".join(map(line, full[1:]))


def capped_lines(text: str) -> str:
    """At most one blank line in a row."""
    return _RUNS.sub("\n\n", text)
