"""Pictures of a page that were stored in pieces, put together again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import png
from .base import Image

#: Points by which edges of neighbouring pieces may differ.
NEAR = 0.75
#: Pieces of at most this part of their length are strips: two of them are put together, of others three at least.
STRIP = 0.25


@dataclass
class Placed:
    """Pixels and where the page shows them: the matrix of the unit square."""

    matrix: tuple
    wide: int
    high: int
    channels: int
    samples: bytes

    @property
    def box(self) -> tuple[float, float, float, float] | None:
        """x0, y0, x1, y1 of a picture that is neither turned nor mirrored."""
        a, b, c, d, x, y = self.matrix
        return (x, y, x + a, y + d) if a > 0 and d > 0 and abs(b) < 1e-6 and abs(c) < 1e-6 else None

    @property
    def strip(self) -> bool:
        x0, y0, x1, y1 = self.box
        return min(x1 - x0, y1 - y0) <= STRIP * max(x1 - x0, y1 - y0)


def _beside(run: list[Placed]) -> Placed:
    """From left to right."""
    wide, rows = sum(p.wide for p in run), []
    for y in range(run[0].high):
        rows += [p.samples[y * p.wide * p.channels : (y + 1) * p.wide * p.channels] for p in run]
    first, last = run[0].box, run[-1].box
    return Placed((last[2] - first[0], 0, 0, first[3] - first[1], first[0], first[1]), wide, run[0].high, run[0].channels, b"".join(rows))


def _below(run: list[Placed]) -> Placed:
    """From top to bottom."""
    first, last = run[0].box, run[-1].box
    return Placed((first[2] - first[0], 0, 0, first[3] - last[1], first[0], last[1]), run[0].wide, sum(p.high for p in run), run[0].channels, b"".join(p.samples for p in run))


def _joined(pieces: list[tuple[int, Placed]], same: Callable, order: Callable, touch: Callable, put: Callable) -> list[tuple[int, Placed]]:
    """Runs of pieces of one breadth, each touching the one before, as one piece with the least number of them."""
    groups: dict[tuple, list[tuple[int, Placed]]] = {}
    for n, p in pieces:
        groups.setdefault((p.channels, *same(p)), []).append((n, p))
    out: list[tuple[int, Placed]] = []
    for group in groups.values():
        group.sort(key=lambda x: order(x[1].box))
        run: list[tuple[int, Placed]] = []
        for item in [*group, None]:
            if item and run and abs(touch(run[-1][1].box, item[1].box)) <= NEAR:
                run.append(item)
                continue
            if len(run) > 2 or len(run) == 2 and all(p.strip for _, p in run):
                pixels = sum(p.wide * p.high for _, p in run)
                out += [(min(n for n, _ in run), put([p for _, p in run]))] if pixels <= png.MOST_PIXELS else run
            else:
                out += run
            run = [item] if item else []
    return out


def stitched(read: list[tuple[Placed | None, Image, tuple]]) -> list[tuple[Placed | None, Image, tuple]]:
    """Pictures whose pieces, strips or tiles of one breadth, touch each other become one; the others stay as they are."""
    pieces = [(n, p) for n, (p, _, _) in enumerate(read) if p and p.box]
    near = lambda v: round(v / (2 * NEAR))
    rows = _joined(pieces, lambda p: (p.high, near(p.box[1]), near(p.box[3])), lambda b: b[0], lambda a, b: b[0] - a[2], _beside)
    whole = dict(_joined(rows, lambda p: (p.wide, near(p.box[0]), near(p.box[2])), lambda b: -b[3], lambda a, b: a[1] - b[3], _below))
    out: list[tuple[Placed | None, Image, tuple]] = []
    free = {n for n, _ in pieces}
    for n, (picture, image, ctm) in enumerate(read):
        if n in whole:
            image.width, image.height = whole[n].wide, whole[n].high
            out.append((whole[n], image, whole[n].matrix))
        elif n not in free:
            out.append((picture, image, ctm))
    return out
