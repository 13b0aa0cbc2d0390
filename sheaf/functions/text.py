"""Text functions as native column expressions; each works on whole columns within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def trimmed(c: Column) -> Column:
    """Without spaces, tabs and line ends at both sides."""
    return F.btrim(c, F.lit(BLANK))


def extension(path: Column) -> Column:
    """From the last dot on in small letters, or nothing."""
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))


def filename(path: Column) -> Column:
    """What follows the last separator of either kind."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def image_format(ext: Column) -> Column:
    return F.when(ext.isin(".jpg", ".jpeg"), "jpeg").when(ext.isin(".tiff", ".tif"), "tiff").when(ext.isin(".png", ".gif", ".bmp", ".emf", ".wmf", ".svg"), F.substring(ext, 2, 8)).otherwise("bin")


def image_file_extension(kind: Column) -> Column:
    return F.when(kind == "jpeg", "jpg").when(kind == "", "bin").otherwise(kind)


def image_extension_to_save(declared: Column, kind: Column) -> Column:
    """A declared extension of up to 15 letters or digits, else the format's."""
    return F.when(declared.rlike(r"^\.[A-Za-z0-9]{1,15}$"), declared).otherwise(F.concat(F.lit("."), image_file_extension(kind)))


def image_reference(name: Column, kind: Column, saved: Column) -> Column:
    return F.when(saved != "", filename(saved)).otherwise(F.concat(name, F.lit("."), image_file_extension(kind)))


def normalised_path(path: Column) -> Column:
    """Either separator; without empty parts, `.` and `..`."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def percent_encoded(path: Column) -> Column:
    """For a reference within Markdown: percent, space, parentheses and angle brackets."""
    for sign, code in (("%", "%25"), (" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E")):
        path = F.replace(path, F.lit(sign), F.lit(code))
    return path


def human_bytes(size: Column) -> Column:
    def shown(divisor: int, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_number(size / divisor, 1), ",", ""), F.lit(unit))

    return F.when(size >= 1 << 20, shown(1 << 20, " MB")).when(size >= 1024, shown(1024, " KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def single_line(c: Column) -> Column:
    """Control characters as spaces, then trimmed."""
    return trimmed(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "))


def escaped_cell(c: Column, pipe: str = "\\|") -> Column:
    return trimmed(F.replace(F.replace(c, F.lit("|"), F.lit(pipe)), F.lit("\n"), F.lit(" ")))


def escaped_markdown(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def capped_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a table; short rows are filled; nothing for no cell."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide), F.lit("\n"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line), "")
    return F.when((F.size(rows) > 0) & (wide > 0), F.concat(line(F.element_at(rows, 1)), rule, body)).otherwise("")


def strip_markdown(md: Column) -> Column:
    """Plain text line by line: without heading marks, rules, stars and table marks; images as [image: alt].

    An image's reference lies within a line. A table row always ends its line; lines under a table's head go.
    """
    lines = F.split(md, "\n", -1)

    def cleaned(line: Column, k: Column) -> Column:
        end = F.when(k < F.size(lines) - 1, "\n").otherwise("")
        inner = F.regexp_replace(F.substring(line, F.lit(2), F.length(line)), r"\|$", "")
        cells = F.transform(F.split(F.regexp_replace(inner, r"\|$", ""), r"\|", -1), lambda c: F.replace(trimmed(c), F.lit("*"), F.lit("")))
        row = F.concat(F.regexp_replace(F.array_join(cells, "  "), r"^ +", ""), F.lit("\n"))
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^#+ ", ""), r"!\[\]\([^)]*\)", ""), r"!\[([^\]]+)\]\([^)]*\)", "[image: $1]")
        return (
            F.when(line.rlike(r"^\|[|: \-]*$") & F.contains(line, F.lit("-")), F.lit(""))
            .when(F.startswith(line, F.lit("|")), row)
            .when(line.rlike(r"^-{3,}$"), end)
            .otherwise(F.concat(F.replace(plain, F.lit("*"), F.lit("")), end))
        )

    return F.array_join(F.transform(lines, cleaned), "")


def base64_decoded(c: Column) -> Column:
    """Up to the first `=`, other signs of no alphabet skipped; the padding is made anew."""
    raw = F.regexp_replace(F.substring_index(c, "=", 1), r"[^A-Za-z0-9+/]", "")
    whole = F.substring(raw, F.lit(1), F.length(raw) - F.when(F.length(raw) % 4 == 1, 1).otherwise(0))
    return F.unbase64(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("=")))


def hex_decoded(c: Column) -> Column:
    raw = F.regexp_replace(c, "[^0-9A-Fa-f]", "")
    return F.unhex(F.substring(raw, F.lit(1), F.floor(F.length(raw) / 2).cast("int") * 2))


def is_valid_utf8(c: Column) -> Column:
    """Valid, and without a replacement character."""
    return F.is_valid_utf8(c) & (F.instr(c, "�") == 0)


def section_depth(c: Column) -> Column:
    """Of a heading like `2.1 Title`: 2; 0 without a number before a blank."""
    number = F.regexp_extract(c, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def is_page_number(c: Column) -> Column:
    """A line that is only a page's number, plain, between dashes or roman."""
    return trimmed(c).rlike(r"^(?:[-–—]\s*)?(?:\d{1,4}|[ivxlcdmIVXLCDM]{1,8}|[ⅰ-ⅿⅠ-Ⅿ]{1,6})(?:\s*[-–—])?$")


def html_title(html: Column) -> Column:
    return trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Entities that stand for one character; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&bull;", "•"), ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&amp;", "&"))


def named_entities(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def page_header(number: Column, width: Column, height: Column, font: Column) -> Column:
    """The line before a page in chunked output."""
    return F.format_string("=== Page %d (%sx%s, body=%spt) ===", number, F.format_number(width, 0), F.format_number(height, 0), F.format_number(font, 1))


def is_embedded_part(name: Column) -> Column:
    return name.rlike(r"^(?:word|xl|ppt)/embeddings/[^/]+$")


def heading_level(size: Column, body: Column, bold: Column) -> Column:
    """By a line's font size against the document's most common one: 1 to 3, 0 for none."""
    ratio = F.when(body > 0, size / body).otherwise(F.lit(1.0))
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).when(ratio >= 1.3, 3).when(bold & (ratio >= 1.1), 3).otherwise(0)
