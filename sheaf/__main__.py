"""Command line: python -m sheaf FILE [--text] [--pages 0,2] [--chunks] [--archive] [--detect] ..."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__, api
from .parsers.base import ConversionError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sheaf", description="Documents to Markdown.")
    p.add_argument("file")
    p.add_argument("-o", "--output")
    p.add_argument("--text", "--plaintext", dest="text", action="store_true", help="plain text")
    p.add_argument("--pages", default="", help="numbers between commas")
    p.add_argument("--chunks", action="store_true", help="page by page")
    p.add_argument("--archive", action="store_true", help="members of an archive")
    p.add_argument("--detect", action="store_true", help="only the format")
    p.add_argument("--no-tables", action="store_true")
    p.add_argument("--no-images", action="store_true")
    p.add_argument("--min-image-size", type=int, default=50)
    p.add_argument("--image-ref-prefix", default="")
    p.add_argument("--image-dir", default="", help="write images there")
    p.add_argument("--max-depth", type=int, default=3)
    p.add_argument("--max-member-mb", type=int, default=512)
    p.add_argument("--max-entries", type=int, default=200_000)
    p.add_argument("--max-ratio", type=int, default=10_000)
    p.add_argument("--include-unsupported", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.detect:
            text, code = json.dumps(api.detect(a.file)) + "\n", 0
        elif a.archive or api.is_archive_file(a.file):
            text, code = _archive(a)
        else:
            options = {"format": "text" if a.text else "markdown", "pages": [int(x) for x in a.pages.split(",") if x.strip()], "tables": not a.no_tables, "images": not a.no_images, "min_image_size": a.min_image_size, "image_ref_prefix": a.image_ref_prefix}
            text = "".join(f"=== Page {p.page_number} ({p.page_width:.0f}x{p.page_height:.0f}, body={p.body_font_size:.1f}pt) ===\n{p.text}\n\n" for p in api.stream_pages(a.file, **options)) if a.chunks else api.convert(a.file, image_dir=a.image_dir, **options)
            code = 0
    except (OSError, ValueError, ConversionError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return code


def _archive(a: argparse.Namespace) -> tuple[str, int]:
    out, code = [], 0
    for r in api.convert_archive(a.file, max_depth=a.max_depth, max_member_bytes=a.max_member_mb << 20, max_entries=a.max_entries, max_ratio=a.max_ratio, include_unsupported=a.include_unsupported, format="text" if a.text else "markdown", images=not a.no_images):
        out.append(f"=== {r.member_path} ===\n{r.markdown}\n\n" if r.ok else f"=== {r.member_path} — ERROR: {r.error} ===\n\n")
        code = code if r.ok else 2
    return "".join(out), code


if __name__ == "__main__":
    sys.exit(main())
