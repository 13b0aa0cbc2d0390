"""Cell values as spreadsheets show them."""

from __future__ import annotations

import datetime
import re
from decimal import ROUND_HALF_EVEN, Decimal

#: Built-in formats that are dates or times, and those that are times only.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
TIMES = {18, 19, 20, 21, 45, 46, 47}


def is_date(number: int, code: str) -> bool:
    """By a built-in number, or a letter of a date outside quotes in the code."""
    if number in DATES:
        return True
    bare = re.sub(r'\\.|"[^"]*"?', "", code.lower())
    return bool(re.search(r"[ydh]|(?<=.)s", bare))


def date_of_serial(serial: float) -> str:
    """Days since 1899-12-31; serials from 61 on count a day that never was."""
    days = int(serial)
    if days < 1:
        return "0000-00-00"
    try:
        return (datetime.date(1899, 12, 31) + datetime.timedelta(days - (days > 60))).isoformat()
    except OverflowError:
        return "0000-00-00"


def time_of_serial(serial: float) -> str:
    """The nearest second; the last half second of a day is 24:00:00."""
    seconds = int((serial - int(serial)) * 86400 + 0.5)
    return f"{seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"


def fixed(value: float, places: int, grouped: bool = False) -> str:
    """As printf does: the exact value of the double, ties to even."""
    return f"{value:,.{places}f}" if grouped else f"{value:.{places}f}"


def general(value: float) -> str:
    """Integers plainly, others to the 15 significant digits that a cell keeps."""
    return str(round(value)) if abs(value) < 1e15 and value == round(value) else f"{value:.15g}"


def _decimals(code: str, signs: str) -> int:
    tail = code.partition(".")[2]
    return min(sum(c in signs for c in tail), 30)


def formatted(raw: str, number: int, code: str = "") -> str:
    """A raw number under a format: dates, percents, grouped, scientific, fixed places; General leaves it as written."""
    if not number:
        return raw
    m = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", raw)
    value = float(m[0]) if m else 0.0
    if is_date(number, code):
        if number in TIMES:
            return time_of_serial(value)
        shows_time = number == 22 or "h" in code.lower()
        return date_of_serial(value) + (" " + time_of_serial(value) if shows_time and value - int(value) > 0.0001 else "")
    if number in (9, 10):
        return fixed(value * 100, 0 if number == 9 else 2) + "%"
    if "%" in code:
        return fixed(value * 100, _decimals(code.partition("%")[0], "0")) + "%"
    if number in (3, 37, 38):
        return f"{int(value + (0.5 if value >= 0 else -0.5)):,}"
    if number in (4, 5, 6, 7, 8, 39, 40):
        return fixed(value, 2, grouped=True)
    if number == 11:
        return f"{value:.2E}"
    if number in (12, 13):
        return f"{value:.4g}"
    if number in (1, 2):
        return fixed(value, 0 if number == 1 else 2)
    if "#" in code or "0" in code:
        return fixed(value, _decimals(code, "0#"))
    return raw


def exact(value: str, places: int) -> str:
    """A decimal text to so many places, ties to even."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN))


def cell_reference(ref: str) -> tuple[int, int]:
    """`AB12` as (column, row) from 0."""
    m = re.match(r"([A-Za-z]*)(\d*)", ref)
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return max(column - 1, 0), max(int(m[2] or 0) - 1, 0)


def column_letters(n: int) -> str:
    """The letters of a column from 0."""
    out, n = "", n + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out
