"""What spreadsheets share: sparse cells to a grid and its Markdown."""

from __future__ import annotations

from dataclasses import dataclass, field

from .base import Options, Page
from .markdown import table as markdown_table

ROWS, COLUMNS = 1 << 20, 1 << 14
#: A grid of more cells than this is refused; the sparse cells themselves have no limit.
MOST_CELLS = 1 << 26


@dataclass
class Sheet:
    name: str
    #: (row, column) to (value, bold).
    cells: dict[tuple[int, int], tuple[str, bool]] = field(default_factory=dict)

    def put(self, row: int, column: int, value: str, bold: bool = False, pipe: str = "/") -> None:
        value = value.replace("|", pipe).replace("\n", " ")
        if value and 0 <= row < ROWS and 0 <= column < COLUMNS:
            self.cells[row, column] = (value, bold)

    def grid(self, marks: bool = False) -> list[list[str]]:
        if not self.cells:
            return []
        high, wide = max(r for r, _ in self.cells) + 1, max(c for _, c in self.cells) + 1
        if high * wide > MOST_CELLS:
            raise ValueError("sheet too large for a grid")
        rows = [[""] * wide for _ in range(high)]
        for (r, c), (value, bold) in self.cells.items():
            rows[r][c] = f"**{value}**" if marks and bold else value
        return rows

    def markdown(self, empty: str = "*Empty sheet*\n\n") -> str:
        rows = self.grid(marks=True)
        return f"## {self.name}\n\n" + (markdown_table(rows) + "\n" if rows else empty)

    def page(self, number: int, options: Options) -> Page:
        return Page(number, self.markdown(), tables=[self.grid()] if self.cells and options.tables else [])
