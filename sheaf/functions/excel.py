"""Spreadsheet values as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_of_serial(serial: Column) -> Column:
    """Days since 1899-12-31; from serial 61 on a day that never was is left out; below 1 nothing but zeros."""
    day = F.floor(serial).cast("int")
    return F.when(day < 1, "0000-00-00").otherwise(F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), day - F.when(day > 60, 1).otherwise(0)), "yyyy-MM-dd"))


def time_of_serial(serial: Column) -> Column:
    seconds = F.floor((serial - F.floor(serial)) * 86400 + 0.5).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds % 3600 / 60)), two(seconds % 60))


def grouped(value: Column, places: int) -> Column:
    """With thousands separators; ties to even."""
    return F.format_number(value, places)


def percent(value: Column, places: int) -> Column:
    return F.concat(F.replace(F.format_number(value * 100, places), F.lit(","), F.lit("")), F.lit("%"))


def cell_column(ref: Column) -> Column:
    """The column, from 0, of a reference such as AB12."""
    letters = F.split(F.upper(F.regexp_extract(ref, "^[A-Za-z]+", 0)), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def cell_row(ref: Column) -> Column:
    return F.regexp_extract(ref, r"\d+$", 0).cast("int") - 1


def column_letters(n: Column) -> Column:
    """The letters of a column, from 0, up to three of them."""
    one, letter = n + 1, lambda c: F.char(c.cast("int") + 65)
    first, second = F.floor((one - 703) / 676), F.floor((one - 27) / 26)
    return F.concat(F.when(one > 702, letter(first % 26)).otherwise(""), F.when(one > 26, letter(second % 26)).otherwise(""), letter((one - 1) % 26))


def comment_text(author: Column, text: Column) -> Column:
    return F.when(author != "", F.concat(author, F.lit(": "), text)).otherwise(text)
