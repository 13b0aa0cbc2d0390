"""Containers and walks on archives made here."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.containers.walk import Limits, Walk, normalised
from sheaf.operators import convert
from sheaf.parsers.base import Options
from sheaf.plans.synthetic import tarred, zipped


def walk(data: bytes, name: str = "a.zip", options: Options = Options(), **limits) -> list:
    return list(Walk(Limits(**limits), options, convert.markdown).run(data, name))


def shown(data: bytes, name: str = "a.zip", **limits) -> list[tuple[str, str, str]]:
    return [(r.member_path, r.markdown, r.error_code) for r in walk(data, name, **limits)]


def test_zip():
    data = zipped([("a.txt", b"A"), ("dir/", b""), ("../x\\b.txt", "한".encode("cp949")), ("__MACOSX/c", b"c"), ("._d", b"d"), ("e/.DS_Store", b"e"), ("f.mp3", b"f"), ("g.html", b"<b>g</b>"), ("empty.txt", b"")])
    assert shown(data) == [("a.txt", "A", "OK"), ("x/b.txt", "한", "OK"), ("g.html", "**g**", "OK"), ("empty.txt", "", "OK")]
    assert [r[0] for r in shown(data, include_unsupported=True)] == ["a.txt", "x/b.txt", "f.mp3", "g.html", "empty.txt"]


def test_member_equals_direct():
    docs = {"a.html": b"<h1>x</h1>", "b.rtf": b"{\\rtf1 hello}", "c.eml": b"Subject: s\n\nbody", "d.txt": b"plain"}
    for r in walk(zipped(list(docs.items()))):
        assert r.markdown == convert.markdown(docs[r.member_path], r.member_path)


def test_limits():
    data = zipped([("a.txt", b"x" * 100), ("b.txt", b"y" * 5000), ("c.txt", b"z")])
    assert [r[2] for r in shown(data, max_member_bytes=1000)] == ["OK", "MEMBER_LIMIT", "OK"]
    assert [r[2] for r in shown(data, max_total_bytes=1000)] == ["OK", "TOTAL_LIMIT"]
    assert [r[2] for r in shown(data, max_entries=2)] == ["OK", "OK", "ENTRY_LIMIT"]
    bomb = zipped([("a.txt", b"\0" * (17 << 20))])
    assert [r[2] for r in shown(bomb, max_ratio=10)] == ["RATIO_LIMIT"]
    (r,) = walk(data, max_member_bytes=1000, max_entries=-1)[1:2]
    assert r.error == "member exceeds max_member_bytes limit (1000 bytes, member is at least 4.883 KiB); skipped — raise max_member_bytes (--max-member-mb)".replace("4.883 KiB", "5000 bytes")


def test_lying_size():
    data = bytearray(zipped([("a.txt", b"x" * 5000)]))
    at = data.rfind(b"PK\1\2")
    struct.pack_into("<I", data, at + 24, 5)
    assert [r[2] for r in shown(bytes(data), max_member_bytes=1000)] == ["MEMBER_LIMIT"]


def test_nested():
    data = zipped([("t.txt", b"T")])
    for n in range(4):
        data = zipped([(f"{n}.zip", data)])
    assert shown(data, max_depth=3) == [("3.zip/2.zip/1.zip", "", "DEPTH_LIMIT")]
    assert shown(data, max_depth=5) == [("3.zip/2.zip/1.zip/0.zip/t.txt", "T", "OK")] == shown(data, max_depth=-1)


def test_tar_and_compressed():
    members = [("a.txt", b"A"), ("long/" + "n" * 150 + ".txt", b"L"), ("zero.txt", b""), ("한.txt", b"K")]
    want = [("a.txt", "A", "OK"), ("long/" + "n" * 150 + ".txt", "L", "OK"), ("한.txt", "K", "OK")]
    t = tarred(members)
    assert shown(t, "a.tar") == want == shown(gzip.compress(t), "a.tgz") == shown(bz2.compress(t), "a.tbz2")
    assert shown(gzip.compress(b"one") + gzip.compress(b"two"), "x/n.txt.gz") == [("n.txt", "onetwo", "OK")]
    assert shown(bz2.compress(b"one"), "n.txt.bz2") == [("n.txt", "one", "OK")]
    assert shown(gzip.compress(b"one")[:-6], "n.txt.gz")[0][2] == "CORRUPT"


def alz(members: list[tuple[str, bytes, int, int]]) -> bytes:
    out = b"ALZ\1" + b"\0" * 4
    for name, data, method, flags in members:
        raw = {0: lambda d: d, 1: bz2.compress, 2: lambda d: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(d) + c.flush()}[method](data)
        label = name.encode("cp949")
        out += b"BLZ\1" + struct.pack("<HBIH", len(label), 0, 0, 0x40 | flags) + struct.pack("<HIII", method, zlib.crc32(data), len(raw), len(data)) + label + b"\0" * 12 * (flags & 1) + raw
    return out + b"CLZ\2"


def test_alz():
    data = alz([("a.txt", b"A" * 50, 2, 0), ("나.txt", b"B", 1, 0), ("e.txt", b"E", 0, 1), ("c.txt", b"C", 0, 0)])
    assert shown(data, "a.alz") == [("a.txt", "A" * 50, "OK"), ("나.txt", "B", "OK"), ("e.txt", "", "ENCRYPTED"), ("c.txt", "C", "OK")]
    assert [r[2] for r in shown(data.replace(struct.pack("<I", zlib.crc32(b"C")), b"\1\2\3\4"), "a.alz")][-1] == "CORRUPT"


def egg(members: list[tuple[str, list[tuple[int, bytes]]]], solid: bool = False) -> bytes:
    mark = lambda n: struct.pack("<I", n)
    end = mark(0x08E28222)

    def block(method: int, data: bytes) -> bytes:
        if method == 4:
            raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
            raw = b"\0\0" + struct.pack("<H", 5) + bytes([93]) + struct.pack("<I", 1 << 16) + raw
        else:
            raw = {0: lambda d: d, 1: lambda d: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(d) + c.flush(), 2: bz2.compress, 3: lambda d: d}[method](data)
        return mark(0x02B50C13) + struct.pack("<BBIII", method, 0, len(data), len(raw), zlib.crc32(data)) + end + raw

    out = mark(0x41474745) + b"\0\1" + b"\0" * 8 + (mark(0x24E5A060) + b"\0" + b"\0\0" if solid else b"") + end
    tail = b""
    for name, blocks in members:
        label = name.encode()
        out += mark(0x0A8590E3) + struct.pack("<IQ", 0, sum(len(d) for _, d in blocks)) + mark(0x0A8591AC) + b"\0" + struct.pack("<H", len(label)) + label + end
        body = b"".join(block(m, d) for m, d in blocks)
        out, tail = (out, tail + body) if solid else (out + body, tail)
    return out + tail + end


def test_egg():
    assert shown(egg([("a.txt", [(0, b"A"), (1, b"B" * 40)]), ("b.txt", [(2, b"C")]), ("c.txt", [(4, b"D" * 99)]), ("z.txt", [(3, b"q")]), ("e.txt", [(0, b"E")])]), "a.egg") == [("a.txt", "A" + "B" * 40, "OK"), ("b.txt", "C", "OK"), ("c.txt", "D" * 99, "OK"), ("z.txt", "", "UNSUPPORTED"), ("e.txt", "E", "OK")]
    assert shown(egg([("a.txt", [(1, b"AA")]), ("skip.mp3", [(1, b"xxx")]), ("b.txt", [(1, b"BBB")])], solid=True), "a.egg") == [("a.txt", "AA", "OK"), ("b.txt", "BBB", "OK")]


def rar4(members: list[tuple[str, bytes, int, int]]) -> bytes:
    out = b"Rar!\x1a\x07\0" + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6
    for name, data, method, flags in members:
        label = name.encode("cp949")
        out += struct.pack("<HBHH", 0, 0x74, 0x8000 | flags, 32 + len(label)) + struct.pack("<IIBIIBBHI", len(data), len(data), 0, zlib.crc32(data), 0, 20, method, len(label), 0) + label + data
    return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)


def vint(n: int) -> bytes:
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def rar5(members: list[tuple[str, bytes, int]]) -> bytes:
    def head(body: bytes, data: bytes = b"") -> bytes:
        sized = vint(len(body)) + body
        return struct.pack("<I", zlib.crc32(sized)) + sized + data

    out = b"Rar!\x1a\x07\1\0" + head(vint(1) + vint(0) + vint(0))
    for name, data, method in members:
        label = name.encode()
        out += head(vint(2) + vint(2) + vint(len(data)) + vint(4) + vint(len(data)) + vint(0) + struct.pack("<I", zlib.crc32(data)) + vint(method << 7) + vint(0) + vint(len(label)) + label, data)
    return out + head(vint(5) + vint(0))


def test_rar():
    assert shown(rar4([("a.txt", b"A", 0x30, 0), ("나\\b.txt", b"B", 0x30, 0), ("c.txt", b"C", 0x33, 0), ("e.txt", b"E", 0x30, 4), ("s.txt", b"S", 0x30, 2)]), "a.rar") == [("a.txt", "A", "OK"), ("나/b.txt", "B", "OK"), ("c.txt", "", "UNSUPPORTED"), ("e.txt", "", "ENCRYPTED"), ("s.txt", "", "UNSUPPORTED")]
    assert shown(rar5([("a.txt", b"A" * 200, 0), ("c.txt", b"C", 3)]), "a.rar") == [("a.txt", "A" * 200, "OK"), ("c.txt", "", "UNSUPPORTED")]
    assert [r[2] for r in shown(rar4([("a.txt", b"A", 0x30, 0)]).replace(b"a.txtA", b"a.txtB"), "a.rar")] == ["CORRUPT"]


def seven(members: list[tuple[str, bytes]], method: bytes = b"\x21") -> bytes:
    num = lambda n: bytes([n]) if n < 0x80 else bytes([0x80 | n >> 8, n & 255]) if n < 0x4000 else bytes([0xF0]) + struct.pack("<I", n)
    solid = b"".join(d for _, d in members)
    if method == b"\x21":
        raw, props = lzma.compress(solid, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]), bytes([8])
    elif method == b"\x03\x01\x01":
        raw, props = lzma.compress(solid, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}]), bytes([93]) + struct.pack("<I", 1 << 16)
    else:
        raw, props = solid, b""
    coder = bytes([len(method) | (0x20 if props else 0)]) + method + (num(len(props)) + props if props else b"")
    streams = bytes([6]) + num(0) + num(1) + bytes([9]) + num(len(raw)) + b"\0" + bytes([7, 11]) + num(1) + b"\0" + num(1) + coder + bytes([12]) + num(len(solid)) + b"\0"
    streams += bytes([8, 13]) + num(len(members)) + bytes([9]) + b"".join(num(len(d)) for _, d in members[:-1]) + bytes([10, 1]) + b"".join(struct.pack("<I", zlib.crc32(d)) for _, d in members) + b"\0" + b"\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in members)
    head = b"\1" + b"\4" + streams + b"\5" + num(len(members)) + b"\x11" + num(len(names)) + names + b"\0" + b"\0"
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", 0) + struct.pack("<QQI", len(raw), len(head), zlib.crc32(head)) + raw + head


@pytest.mark.parametrize("method", [b"\x21", b"\x03\x01\x01", b"\0"])
def test_seven_zip(method):
    assert shown(seven([("a.txt", b"A" * 300), ("나/b.txt", b"B")], method), "a.7z") == [("a.txt", "A" * 300, "OK"), ("나/b.txt", "B", "OK")]


def test_seven_zip_unsupported():
    assert [r[2] for r in shown(seven([("a.txt", b"A"), ("b.txt", b"B")], b"\x03\x04\x01"), "a.7z")] == ["UNSUPPORTED", "UNSUPPORTED"]


def test_not_an_archive():
    assert shown(b"text", "a.txt") == [("a.txt", "text", "OK")]
    assert shown(b"\0\1\2", "a.bin") == [("a.bin", "", "UNSUPPORTED")]
    assert shown(b"PK\3\4 broken", "a.zip")[0][2] == "CORRUPT"


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["zip", "tar", "gz", "bz2", "7z", "alz", "egg", "rar"]), st.integers(0, 400), st.binary(max_size=8))
def test_damaged_archives_never_fail(kind, at, junk):
    data = {"zip": zipped([("a.txt", b"A" * 50)]), "tar": tarred([("a.txt", b"A")]), "gz": gzip.compress(b"A"), "bz2": bz2.compress(b"A"), "7z": seven([("a.txt", b"A")]), "alz": alz([("a.txt", b"A", 2, 0)]), "egg": egg([("a.txt", [(1, b"A")])]), "rar": rar5([("a.txt", b"A", 0)])}[kind]
    at %= len(data)
    walk(data[:at] + junk + data[at + len(junk) :], f"a.{kind}", max_total_bytes=1 << 20)
    walk(data[:at], f"a.{kind}")


def test_paths():
    assert normalised("..\\..\\outside.txt") == "outside.txt" and normalised("/a//./b/") == "a/b"
