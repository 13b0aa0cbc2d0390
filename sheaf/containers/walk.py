"""Archives to members: one walk over all containers, nested ones included, under one budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from .. import formats
from ..parsers.base import ConversionError, Options
from . import base, korean, rar, seven, tars
from .base import Member, MemberError
from .zips import ZipFileReader

_RASTERS = frozenset("png jpg jpeg gif bmp tif tiff webp".split())
_SKIPPED = frozenset("ico mp3 mp4 avi mov mkv wav flac exe dll so dylib class o a ttf otf woff woff2 dwg dwf dwfx".split())
#: Below this size no ratio is suspicious.
FREE = 16 << 20


@dataclass(frozen=True)
class Limits:
    """Negative: no limit."""

    max_depth: int = 3
    max_member_bytes: int = 512 << 20
    max_total_bytes: int = 64 << 30
    max_entries: int = 200_000
    max_ratio: int = 10_000
    include_unsupported: bool = False


@dataclass
class Result:
    member_path: str
    format: str = "UNKNOWN"
    markdown: str = ""
    error: str = ""
    error_code: str = "OK"
    uncompressed_size: int = 0
    content: bytes | None = None

    @property
    def ok(self) -> bool:
        return not self.error


class Stop(Exception):
    """The budget for the whole walk is gone."""


def normalised(name: str) -> str:
    """Either separator; without empty parts, `.` and `..`."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def is_metadata(name: str) -> bool:
    leaf = name.rpartition("/")[2]
    return name.startswith("__MACOSX/") or leaf.startswith("._") or leaf == ".DS_Store"


def skipped_by_name(name: str, images: bool) -> bool:
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    return ext in _SKIPPED or ext in _RASTERS and not images


def human_size(n: int) -> str:
    for unit, size in (("GiB", 1 << 30), ("MiB", 1 << 20)):
        if n >= size:
            return f"{n / size:.4g} {unit}"
    return f"{n} bytes"


def ungzipped_name(name: str, ends: dict[str, str]) -> str:
    for end, new in ends.items():
        if name.lower().endswith(end) and len(name) > len(end):
            return name[: -len(end)] + new
    return name


class Walk:
    """One top-level file. `convert` turns a member's bytes to Markdown; None keeps the bytes for a later stage."""

    def __init__(self, limits: Limits, options: Options, convert: Callable[[bytes, str, Options], str] | None):
        self.limits, self.options, self.convert = limits, options, convert
        self.total = self.entries = 0

    def run(self, data: bytes, name: str) -> Iterator[Result]:
        kind = formats.coarse_bytes(data, name)
        try:
            if kind in formats.ARCHIVES:
                yield from self._container(data, kind, name, "", 1)
            else:
                yield from self._handled(data, name, 0, name)
        except Stop:
            return

    def _over(self, value: int, limit: int) -> bool:
        return 0 <= limit < value

    def _container(self, data: bytes, kind: str, name: str, prefix: str, depth: int) -> Iterator[Result]:
        try:
            for m in self._members(data, kind, name):
                yield from self._member(m, prefix, depth, kind)
        except MemberError as e:
            code = "ENCRYPTED" if "encrypted" in str(e) else "UNSUPPORTED" if "unsupported" in str(e) else "CORRUPT"
            yield Result(prefix.rstrip("/") or normalised(name), kind, error=str(e), error_code=code)

    def _members(self, data: bytes, kind: str, name: str) -> Iterator[Member]:
        if kind == "ZIP":
            try:
                return ZipFileReader(data).members()
            except ValueError as e:
                raise MemberError("cannot open archive") from e
        if kind == "TAR":
            return tars.members(data)
        if kind in ("GZIP", "BZIP2"):
            return self._single(data, kind, name)
        if kind == "ALZ":
            return korean.alz_members(data)
        if kind == "EGG":
            return korean.Egg(data).members()
        return rar.members(data) if kind == "RAR" else seven.members(data)

    def _single(self, data: bytes, kind: str, name: str) -> Iterator[Member]:
        """A compressed tar's members, or the one compressed file."""
        unpacked = base.gunzipped if kind == "GZIP" else base.bunzipped
        head = bytearray()
        try:
            for part in unpacked(data):
                head += part
                if len(head) >= 512:
                    break
        except MemberError:
            pass
        if head[257:262] == b"ustar":
            return tars.members(self._bounded(unpacked(data), len(data)))
        leaf = normalised(name).rpartition("/")[2]
        leaf = ungzipped_name(leaf, {".tgz": ".tar", ".gz": ""} if kind == "GZIP" else {".tbz2": ".tar", ".bz2": ""})
        return iter([Member(leaf, 0, len(data), lambda: unpacked(data))])

    def _bounded(self, parts: Iterator[bytes], packed: int) -> bytes:
        """A whole inner tar, within the limit for all output and the ratio."""
        out = bytearray()
        for part in parts:
            out += part
            if self._over(len(out), self.limits.max_total_bytes) or self._ratio(len(out), packed):
                raise MemberError("compressed tar exceeds the limits")
        return bytes(out)

    def _ratio(self, size: int, packed: int) -> bool:
        return packed > 0 and self.limits.max_ratio > 0 and size > max(FREE, packed * self.limits.max_ratio)

    def _member(self, m: Member, prefix: str, depth: int, kind: str) -> Iterator[Result]:
        if m.directory or is_metadata(m.name) or m.skip_empty and not m.size and not m.encrypted:
            return
        path = prefix + normalised(m.name)
        self.entries += 1
        if self._over(self.entries, self.limits.max_entries):
            yield Result(path, error=f"archive entry count exceeds max_entries limit ({self.limits.max_entries}); walk stopped — raise max_entries", error_code="ENTRY_LIMIT")
            raise Stop
        if skipped_by_name(m.name, self.options.images):
            if self.limits.include_unsupported:
                yield Result(path, formats.BY_EXTENSION.get(formats.name_extension(path), "UNKNOWN"), error="unsupported format", error_code="UNSUPPORTED", uncompressed_size=m.size)
            return
        if self._over(m.size, self.limits.max_member_bytes):
            yield self._too_large(path, m.size)
            return
        data, failed = self._read(m, path)
        if failed:
            yield failed
            if failed.error_code == "TOTAL_LIMIT":
                raise Stop
            return
        yield from self._handled(data, path, depth, path)

    def _too_large(self, path: str, size: int) -> Result:
        needs = f", member is at least {human_size(size)}" if size > self.limits.max_member_bytes else ""
        return Result(path, error=f"member exceeds max_member_bytes limit ({human_size(self.limits.max_member_bytes)}{needs}); skipped — raise max_member_bytes (--max-member-mb)", error_code="MEMBER_LIMIT", uncompressed_size=size)

    def _read(self, m: Member, path: str) -> tuple[bytes, Result | None]:
        out = bytearray()
        try:
            for part in m.parts():
                out += part
                self.total += len(part)
                if self._over(len(out), self.limits.max_member_bytes):
                    return b"", self._too_large(path, max(m.size, len(out)))
                if self._ratio(len(out), m.packed):
                    return b"", Result(path, error=f"member expansion exceeds max_ratio limit ({self.limits.max_ratio}x compression ratio, suspected archive bomb); skipped — raise max_ratio only for trusted input", error_code="RATIO_LIMIT", uncompressed_size=len(out))
                if self._over(self.total, self.limits.max_total_bytes):
                    return b"", Result(path, error=f"total uncompressed output exceeds max_total_bytes limit ({human_size(self.limits.max_total_bytes)}); walk stopped — raise max_total_bytes", error_code="TOTAL_LIMIT", uncompressed_size=len(out))
        except MemberError as e:
            text = str(e)
            code = "ENCRYPTED" if "encrypted" in text else "UNSUPPORTED" if "unsupported" in text else "CORRUPT"
            return b"", Result(path, error=text, error_code=code, uncompressed_size=len(out))
        return bytes(out), None

    def _handled(self, data: bytes, path: str, depth: int, name: str) -> Iterator[Result]:
        kind = formats.coarse_bytes(data, path)
        result = Result(path, kind, uncompressed_size=len(data))
        if kind in formats.ARCHIVES:
            if self._over(depth + 1, self.limits.max_depth):
                yield replace(result, error=f"nested archive exceeds max_depth limit ({self.limits.max_depth}); raise max_depth (--max-depth) to descend", error_code="DEPTH_LIMIT")
                return
            yield from self._container(data, kind, name, path + "/", depth + 1)
        elif kind in ("UNKNOWN", "CAD"):
            if self.limits.include_unsupported or not depth:
                yield replace(result, error="unsupported format", error_code="UNSUPPORTED")
        elif self.convert is None:
            yield replace(result, content=data)
        elif kind == "IMAGE":
            yield replace(result, markdown=f"![{path.rpartition('/')[2]}]({self.options.image_ref_prefix}{path})")
        else:
            try:
                own = replace(self.options, image_ref_prefix=f"{self.options.image_ref_prefix}{path}/") if depth else self.options
                yield replace(result, markdown=self.convert(data, path, own))
            except ConversionError as e:
                yield replace(result, error=str(e), error_code="CONVERT_FAILED")
