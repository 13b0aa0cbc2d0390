"""PDF decryption with the empty user password: RC4 and AES, revisions 2 to 6."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

#: Fixed value: what passwords are filled with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B) & 0xFF if x & 0x80 else x << 1


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _substitution() -> list[int]:
    """The AES byte substitution, from inverses in the field and a fixed affine map."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    turn = lambda x, n: (x << n | x >> (8 - n)) & 255
    return [x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse]


_SUB = _substitution()
_BACK = [_SUB.index(n) for n in range(256)]
_MUL = {f: [_times(n, f) for n in range(256)] for f in (2, 3, 9, 11, 13, 14)}


class Aes:
    def __init__(self, key: bytes):
        n, self.rounds = len(key) // 4, len(key) // 4 + 6
        words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        while len(words) < 4 * (self.rounds + 1):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [_SUB[b] for b in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _double(rcon)
            elif n > 6 and len(words) % n == 4:
                w = [_SUB[b] for b in w]
            words.append([a ^ b for a, b in zip(w, words[-n], strict=True)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def _mixed(self, s: list[int], factors: tuple[int, ...]) -> list[int]:
        out = []
        for c in range(0, 16, 4):
            for r in range(4):
                v = 0
                for k in range(4):
                    f = factors[(k - r) % 4]
                    v ^= s[c + k] if f == 1 else _MUL[f][s[c + k]]
                out.append(v)
        return out

    def block_out(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            s = [_BACK[s[(4 * (i // 4) + i % 4 - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
            if r:
                s = self._mixed(s, (14, 11, 13, 9))
        return bytes(s)

    def block_in(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            s = [_SUB[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                s = self._mixed(s, (2, 3, 1, 1))
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
        return bytes(s)

    def cbc_out(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for a in range(0, len(data) - 15, 16):
            block = data[a : a + 16]
            out += bytes(x ^ y for x, y in zip(self.block_out(block), iv, strict=True))
            iv = block
        return bytes(out)

    def cbc_in(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for a in range(0, len(data) - 15, 16):
            iv = self.block_in(bytes(x ^ y for x, y in zip(data[a : a + 16], iv, strict=True)))
            out += iv
        return bytes(out)


def aes(key: bytes, data: bytes) -> bytes:
    """CBC with the first block as the start; padding taken off."""
    plain = Aes(key).cbc_out(data[16:], data[:16])
    return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain


def _hash6(password: bytes, salt: bytes) -> bytes:
    k, n = hashlib.sha256(password + salt).digest(), 0
    while True:
        e = Aes(k[:16]).cbc_in((password + k) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def opener(encrypt: dict, file_id: bytes) -> Callable[[int, int, bytes, bool], bytes] | None:
    """What decrypts (object, generation, data, whether a stream); None if the empty password doesn't open it."""
    rev, version = int(encrypt.get("R", 2)), int(encrypt.get("V", 1))
    owner, user = bytes(encrypt.get("O", b"")), bytes(encrypt.get("U", b""))
    length = max(5, min(32, int(encrypt.get("Length", 40)) // 8 if version != 1 else 5))
    filters = encrypt.get("CF") or {}
    method = {}
    for stream, name in ((True, "StmF"), (False, "StrF")):
        own = filters.get(str(encrypt.get(name, "Identity"))) or {}
        method[stream] = str(own.get("CFM", "Identity")) if version >= 4 else "V2"
        if version == 4:
            length = 16
    if rev >= 5:
        salt, wrapped = user[40:48], bytes(encrypt.get("UE", b""))
        check = _hash6(b"", user[32:40]) if rev >= 6 else hashlib.sha256(user[32:40]).digest()
        if check != user[:32]:
            return None
        key = Aes(_hash6(b"", salt) if rev >= 6 else hashlib.sha256(salt).digest()).cbc_out(wrapped[:32], bytes(16))
    else:
        meta = b"\xff\xff\xff\xff" if rev >= 4 and encrypt.get("EncryptMetadata", True) is False else b""
        key = hashlib.md5(PAD + owner[:32] + (int(encrypt.get("P", 0)) & 0xFFFFFFFF).to_bytes(4, "little") + file_id + meta).digest()
        for _ in range(50 if rev >= 3 else 0):
            key = hashlib.md5(key[:length]).digest()
        key = key[:length]
        if rev >= 3:
            test = rc4(key, hashlib.md5(PAD + file_id).digest())
            for n in range(1, 20):
                test = rc4(bytes(b ^ n for b in key), test)
            if test[:16] != user[:16]:
                return None
        elif rc4(key, PAD) != user[:32]:
            return None

    def plain(number: int, generation: int, data: bytes, stream: bool) -> bytes:
        way = method[stream]
        if way in ("Identity", "None") or not data:
            return data
        if way == "AESV3":
            return aes(key, data)
        own = hashlib.md5(key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if way == "AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
        return aes(own, data) if way == "AESV2" else rc4(own, data)

    return plain
