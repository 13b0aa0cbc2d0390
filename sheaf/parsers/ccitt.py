"""Fax coding of black and white pictures (ITU-T T.4 and T.6): rows of runs, alone or against the row above."""

from __future__ import annotations

from functools import cache

# The code words of the recommendations, in the order of the run lengths 0 to 63, then 64, 128, ... 1728.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 "
    "0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 "
    "00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 "
    "01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 "
    "00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 "
    "000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 "
    "000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 "
    "000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 "
    "0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 "
    "0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
#: Of both colours, 1792, 1856, ... 2560.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Against the row above: pass, horizontal, or the distance to the change there.
MODES = {"0001": "pass", "001": "across", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
EOL, WIDEST = "000000000001", 13


@cache
def _lookup(kind: str) -> list:
    """(bits, meaning) for every value of the next 13 bits."""
    runs = WHITE if kind == "white" else BLACK
    words = dict(MODES) if kind == "mode" else {w: n if n < 64 else 64 * (n - 63) for n, w in enumerate(runs)} | {w: 1792 + 64 * n for n, w in enumerate(LONG)}
    table: list = [None] * (1 << WIDEST)
    for word, meaning in words.items():
        free = WIDEST - len(word)
        first = int(word, 2) << free
        table[first : first + (1 << free)] = [(len(word), meaning)] * (1 << free)
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int = WIDEST) -> int:
        byte = self.at >> 3
        held = int.from_bytes(self.data[byte : byte + 4].ljust(4, b"\0"), "big")
        return held >> (32 - n - (self.at & 7)) & ((1 << n) - 1)

    def run(self, colour: int) -> int:
        """The length of a run: as many long words as there are, then a short one; -1 if there is no such word."""
        table, total = _lookup("black" if colour else "white"), 0
        while True:
            found = table[self.peek()]
            if not found or self.at >= self.end:
                return -1
            self.at += found[0]
            total += found[1]
            if found[1] < 64:
                return total


def _alone(bits: _Bits, columns: int) -> list[int] | None:
    """A row's changes from its runs, the first white."""
    changes, at, colour = [], 0, 0
    while at < columns:
        n = bits.run(colour)
        if n < 0:
            return None
        at += n
        changes.append(min(at, columns))
        colour ^= 1
    return changes


def _against(bits: _Bits, columns: int, above: list[int]) -> list[int] | None:
    """A row's changes by the modes; `above` are those of the row before."""
    changes: list[int] = []
    at, colour, k = -1, 0, 0
    modes = _lookup("mode")
    while at < columns:
        while k > 0 and above[k - 1] > at:
            k -= 1
        while k < len(above) and (above[k] <= at or k & 1 != colour):
            k += 1
        next_ = above[k] if k < len(above) else columns
        found = modes[bits.peek()]
        if not found or bits.at >= bits.end:
            return None
        bits.at += found[0]
        if found[1] == "pass":
            at = above[k + 1] if k + 1 < len(above) else columns
        elif found[1] == "across":
            one, two = bits.run(colour), bits.run(colour ^ 1)
            if one < 0 or two < 0:
                return None
            first = max(at, 0) + one
            changes += [min(first, columns), min(first + two, columns)]
            at = first + two
        else:
            at = next_ + found[1]
            if at < (changes[-1] if changes else 0):
                return None
            changes.append(min(at, columns))
            colour ^= 1
    return changes


def decoded(data: bytes, columns: int = 1728, rows: int = 0, k: int = 0, aligned: bool = False, black_is_1: bool = False) -> tuple[bytes, int]:
    """Rows of one bit a pixel, each from a whole byte on, and their number. k below 0: every row against the one above;
    0: rows alone; above 0: a bit before each row says which. What is damaged ends the picture."""
    bits, above, out = _Bits(data), [], []
    full, flip = (1 << columns) - 1, 0 if black_is_1 else (1 << columns) - 1
    spare = -columns % 8
    while bits.at < bits.end and (not rows or len(out) < rows):
        if aligned:
            bits.at = (bits.at + 7) & ~7
        marks, two = 0, k < 0
        while True:
            zeros = bits.at
            while k >= 0 and bits.peek(12) == 0 and bits.at < bits.end:  # fill before the mark
                bits.at += 1
            if bits.peek(12) != 1:
                bits.at = zeros if bits.peek(12) == 0 else bits.at
                break
            bits.at += 12
            marks += 1
            if k > 0:
                two = not bits.peek(1)
                bits.at += 1
        if marks > 1 or k < 0 and marks:
            break
        changes = _against(bits, columns, above) if two else _alone(bits, columns)
        if changes is None:
            break
        black = 0
        for a, b in zip(changes[::2], [*changes[1::2], columns] if len(changes) % 2 else changes[1::2], strict=True):
            black |= (full >> a) ^ (full >> b)
        out.append(((black ^ flip) << spare).to_bytes((columns + 7) // 8, "big"))
        above = changes
    return b"".join(out), len(out)
