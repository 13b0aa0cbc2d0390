"""Files to Markdown and pages: dispatch by format. Takes bytes; used by functions, table functions and sources alike."""

from __future__ import annotations

from collections.abc import Iterator

from .. import formats
from ..parsers import charsets
from ..parsers.base import ConversionError, Image, Options, Page
from ..parsers.markdown import strip_markdown

_PAGED = {"DOCX", "PPTX", "PPT", "HWPX", "DOC", "PDF"}


def _module(kind: str):
    from ..parsers import doc, docx, hwp, hwp3, hwpx, metafiles, msg, odf, pdf, ppt, pptx, rtf, xls, xlsb, xlsx

    return {
        "DOCX": docx, "PPTX": pptx, "XLSX": xlsx, "XLSB": xlsb, "RTF": rtf, "ODT": odf, "ODS": odf, "ODP": odf, "PDF": pdf, "DOC": doc, "XLS": xls,
        "PPT": ppt, "MSG": msg, "HWP": hwp, "HWP3": hwp3, "HWPX": hwpx, "EMF": metafiles, "WMF": metafiles,
    }.get(kind)


def kind_of(data: bytes, name: str = "") -> str:
    """The format that decides how bytes are converted; IMAGE for rasters."""
    coarse = formats.coarse_bytes(data, name)
    if coarse == "OFFICE":
        return formats.office_bytes(data, name)
    if coarse == "HWP" and data[:4] != b"\xd0\xcf\x11\xe0":
        return "HWP3"
    return coarse


def pages(data: bytes, name: str = "", options: Options = Options()) -> Iterator[Page]:
    """Pages of a document, by its own unit (page, sheet, slide, section or the whole file)."""
    data, kind = bytes(data or b""), kind_of(data or b"", name)
    if kind in formats.ARCHIVES:
        raise ConversionError("archive input: list its members instead")
    for page in _pages(data, name, kind, options):
        if options.plain and kind not in ("TXT", "IMAGE"):
            page.text = strip_markdown(page.text)
        yield page


def _pages(data: bytes, name: str, kind: str, options: Options) -> Iterator[Page]:
    from ..parsers import html, images, mail

    if kind == "TXT":
        yield Page(0, charsets.plain_text(data))
    elif kind == "HTML":
        yield from html.pages(data, options)
    elif kind == "EML":
        yield from mail.pages(data, options)
    elif kind == "IMAGE":
        leaf = name.replace("\\", "/").rpartition("/")[2] or "image"
        wide, high = images.dimensions(data)
        image = Image(1, leaf.rpartition(".")[0] or leaf, images.format_of_extension(images.extension(leaf)), data if options.images else b"", wide, high)
        yield Page(1, f"![{leaf}]({options.image_ref_prefix}{leaf})\n", images=[image])
    elif (module := _module(kind)) is not None:
        try:
            yield from module.pages(data, options)
        except ConversionError:
            raise
        except Exception as e:  # noqa: BLE001  hostile content must end as a row's error
            raise ConversionError(f"corrupt {kind} document: {type(e).__name__}") from e
    elif kind.startswith("ENCRYPTED"):
        raise ConversionError("document is encrypted")
    else:
        raise ConversionError("unsupported format")


def markdown(data: bytes, name: str = "", options: Options = Options()) -> str:
    """The whole document as Markdown, or plain text if asked for."""
    data, kind = bytes(data or b""), kind_of(data or b"", name)
    if kind == "HTML" and not data:
        return ""
    module = _module(kind)
    if hasattr(module, "markdown") and kind not in ("ODT", "ODS", "ODP"):
        if options.plain and kind in ("DOCX", "PPTX", "PDF"):
            return _joined(pages(data, name, options), kind)
        try:
            text = module.markdown(data, options)
        except ConversionError:
            raise
        except Exception as e:  # noqa: BLE001
            raise ConversionError(f"corrupt {kind} document: {type(e).__name__}") from e
        return strip_markdown(text) if options.plain else text
    return _joined(pages(data, name, options), kind)


def _joined(found: Iterator[Page], kind: str) -> str:
    out = []
    for n, page in enumerate(found):
        mark = f"--- Page {page.page_number} ---\n\n" if kind in ("PDF", "ODP") else ""
        out.append(("\n" if n else "") + ("" if page.text.startswith("--- Page") else mark) + page.text)
    return "".join(out)


def safe_markdown(data: bytes | None, name: str | None, options: Options) -> tuple[str | None, str | None]:
    """Markdown and no error, or no Markdown and the error."""
    if data is None:
        return None, None
    try:
        return markdown(data, name or "", options), None
    except ConversionError as e:
        return None, str(e)
    except RecursionError:
        return None, "document nested too deeply"
