"""Decryption with the empty user password: RC4 and AES of the standard security handler (revisions 2 to 6)."""

from __future__ import annotations

import hashlib

_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _tables():
    log, exp, x = [0] * 256, [0] * 512, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 255
    exp[255:510] = exp[:255]
    box = [0] * 256
    for i in range(256):
        v = exp[255 - log[i]] if i else 0
        r = v
        for _ in range(4):
            v = ((v << 1) | (v >> 7)) & 255
            r ^= v
        box[i] = r ^ 0x63
    inverse = [0] * 256
    for i, v in enumerate(box):
        inverse[v] = i
    mul = {k: [exp[log[k] + log[i]] if i else 0 for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}
    return box, inverse, mul


_BOX, _INVERSE, _MUL = _tables()


def _expand(key: bytes) -> list[list[int]]:
    n = len(key) // 4
    w, r = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = list(w[-1])
        if i % n == 0:
            t = [_BOX[b] for b in t[1:] + t[:1]]
            t[0] ^= r
            r = _MUL[2][r]
        elif n > 6 and i % n == 4:
            t = [_BOX[b] for b in t]
        w.append([a ^ b for a, b in zip(w[i - n], t)])
    return [sum(w[4 * i : 4 * i + 4], []) for i in range(n + 7)]


_BACK = [0, 13, 10, 7, 4, 1, 14, 11, 8, 5, 2, 15, 12, 9, 6, 3]
_FORTH = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]


def _open(block: bytes, keys) -> list[int]:
    s = [a ^ b for a, b in zip(block, keys[-1])]
    m9, m11, m13, m14 = _MUL[9], _MUL[11], _MUL[13], _MUL[14]
    for k in range(len(keys) - 2, -1, -1):
        s = [_INVERSE[s[i]] ^ b for i, b in zip(_BACK, keys[k])]
        if k:
            o = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                o += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
            s = o
    return s


def _shut(block: list[int], keys) -> list[int]:
    s = [a ^ b for a, b in zip(block, keys[0])]
    m2, m3 = _MUL[2], _MUL[3]
    for k in range(1, len(keys)):
        s = [_BOX[s[i]] for i in _FORTH]
        if k < len(keys) - 1:
            o = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                o += [m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]]
            s = o
        s = [a ^ b for a, b in zip(s, keys[k])]
    return s


def aes_open(key: bytes, data: bytes, iv: bytes | None = None, pad: bool = True) -> bytes:
    if iv is None:
        iv, data = data[:16], data[16:]
    keys, out = _expand(key), bytearray()
    for at in range(0, len(data) - len(data) % 16, 16):
        block = data[at : at + 16]
        out += bytes(a ^ b for a, b in zip(_open(block, keys), iv))
        iv = block
    if pad and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def aes_shut(key: bytes, data: bytes, iv: bytes) -> bytes:
    keys, out = _expand(key), bytearray()
    for at in range(0, len(data), 16):
        iv = bytes(_shut([a ^ b for a, b in zip(data[at : at + 16], iv)], keys))
        out += iv
    return bytes(out)


def _hash6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = aes_shut(k[:16], (password + k + extra) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Decryptor:
    def __init__(self, d: dict, file_id: bytes, file):
        self.v, r = d.get("V", 0), d.get("R", 2)
        bits = d.get("Length", 40)
        self.methods = {}
        if self.v >= 4:
            filters = {k: file.dict(v) for k, v in file.dict(d.get("CF")).items()}
            for use in ("StmF", "StrF"):
                f = filters.get(str(d.get(use, "Identity")), {})
                self.methods[use] = str(file.get(f.get("CFM")) or "None")
            bits = 128 if self.v == 4 else 256
        self.p = d.get("P", 0)
        user, owner = d.get("U", b""), d.get("O", b"")
        if r >= 5:
            check = _hash6(b"", user[32:40]) if r >= 6 else hashlib.sha256(user[32:40]).digest()
            if check != user[:32]:
                raise ValueError("a password is needed")
            k = _hash6(b"", user[40:48]) if r >= 6 else hashlib.sha256(user[40:48]).digest()
            self.key = aes_open(k, d["UE"][:32], bytes(16), pad=False)
            return
        n = bits // 8 if r >= 3 else 5
        h = hashlib.md5(_PAD + owner[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
        if r >= 4 and d.get("EncryptMetadata") is False:
            h.update(b"\xff" * 4)
        key = h.digest()
        if r >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:n]).digest()
        self.key = key[:n]
        if r == 2:
            ok = rc4(self.key, _PAD) == user[:32]
        else:
            x = rc4(self.key, hashlib.md5(_PAD + file_id).digest())
            for i in range(1, 20):
                x = rc4(bytes(b ^ i for b in self.key), x)
            ok = x[:16] == user[:16]
        if not ok:
            raise ValueError("a password is needed")

    def _apply(self, data: bytes, key: tuple, method: str) -> bytes:
        if method in ("None", "Identity"):
            return data
        if method == "AESV3":
            return aes_open(self.key, data)
        mixed = self.key + key[0].to_bytes(3, "little") + key[1].to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")
        own = hashlib.md5(mixed).digest()[: min(len(self.key) + 5, 16)]
        return aes_open(own, data) if method == "AESV2" else rc4(own, data)

    def string(self, data: bytes, key: tuple) -> bytes:
        return self._apply(data, key, self.methods.get("StrF", "V2") if self.v >= 4 else "V2")

    def stream(self, data: bytes, key: tuple, d: dict) -> bytes:
        f = d.get("Filter")
        if f == "Crypt" or isinstance(f, list) and "Crypt" in f:
            return data
        return self._apply(data, key, self.methods.get("StmF", "V2") if self.v >= 4 else "V2")
