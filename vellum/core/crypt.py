"""The standard security handler: passwords to file keys, file keys to object keys, RC4 and AES.

AES is plain Python over numpy tables that a rule makes: no library here has it, and documents hold little of it per task.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .objects import Name, PdfError

#: Fixed value of the format: what fills a short password.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[n] = c ^ s[(a + b) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache(1)
def _tables() -> tuple[bytes, bytes, dict[int, bytes]]:
    """S-box from inverses in GF(2^8), its inverse, and products with the four factors of the inverse mix."""
    box = bytearray(256)
    inverse = {0: 0}
    for a in range(1, 256):
        v, p = a, 1
        for bit in bin(254)[2:]:
            p = _times(p, p)
            if bit == "1":
                p = _times(p, v)
        inverse[a] = p
    for a in range(256):
        x = inverse[a]
        y = x
        for k in range(1, 5):
            y ^= (x << k | x >> (8 - k)) & 255
        box[a] = y ^ 0x63
    back = bytearray(256)
    for a, b in enumerate(box):
        back[b] = a
    return bytes(box), bytes(back), {m: bytes(_times(a, m) for a in range(256)) for m in (9, 11, 13, 14)}


@lru_cache(64)
def _schedule(key: bytes) -> list[bytes]:
    box, n = _tables()[0], len(key) // 4
    words, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(box[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[4 * r : 4 * r + 4]) for r in range(n + 7)]


_ROWS_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


@lru_cache(1)
def _inverse() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverse S-box; what a byte of each row of a column adds to the unmixed column, as is and after the box: words of four bytes."""
    _, back, mul = _tables()
    box = np.frombuffer(back, np.uint8)
    rows = [np.array([list(mul[k]) for k in (14, 9, 13, 11)], np.uint8).T]
    for _ in range(3):
        rows.append(np.roll(rows[-1], 1, axis=1))
    plain = np.ascontiguousarray(np.stack(rows)).view(np.uint32)[..., 0]
    return box, plain, plain[:, box]


#: Blocks that are decrypted at once.
_BLOCKS = 1 << 15
_ROW = np.arange(4)


@lru_cache(64)
def _rounds_back(key: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Round keys from the last: bytes, unmixed words, bytes."""
    plain = _inverse()[1]
    first, *middle, last = (np.frombuffer(k, np.uint8) for k in _schedule(key)[::-1])
    return first, [np.bitwise_xor.reduce(plain[_ROW, k.reshape(4, 4)], axis=1) for k in middle], last


def _decrypted(blocks: np.ndarray, key: bytes) -> np.ndarray:
    """Rounds by tables: a column is the sum of four words, one for each of its bytes, and the unmixed round key."""
    box, _, words = _inverse()
    first, middle, last = _rounds_back(key)
    s = blocks ^ first
    for k in middle:
        s = np.ascontiguousarray(np.bitwise_xor.reduce(words[_ROW, s[:, _ROWS_BACK].reshape(-1, 4, 4)], axis=2) ^ k).view(np.uint8)
    return box[s[:, _ROWS_BACK]] ^ last


def aes_cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, unpad: bool = True) -> bytes:
    """iv: of the first 16 bytes, if not given."""
    if iv is None:
        iv, data = data[:16], data[16:]
    if len(key) not in (16, 32) or len(iv) != 16 or len(data) % 16:
        raise PdfError("decryptionFailed")
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])[: len(blocks)]
    # many blocks at once: only their sums with the blocks before depend on each other
    out = bytearray().join((_decrypted(blocks[k : k + _BLOCKS], key) ^ before[k : k + _BLOCKS]).tobytes() for k in range(0, len(blocks), _BLOCKS))
    if unpad and out:
        n = out[-1]
        if not 1 <= n <= 16:
            raise PdfError("decryptionFailed")
        del out[-n:]
    return bytes(out)


@lru_cache(1)
def _forward() -> tuple[bytes, list[list[int]]]:
    """The S-box, and for each row of a column what a byte there adds to the mixed column."""
    box = _tables()[0]
    first = [_times(v, 2) << 24 | v << 16 | v << 8 | _times(v, 3) for v in box]
    return box, [[(t >> 8 * k | t << (32 - 8 * k)) & 0xFFFFFFFF for t in first] for k in range(4)]


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding."""
    box, (t0, t1, t2, t3) = _forward()
    keys = [[int.from_bytes(r[i : i + 4], "big") for i in range(0, 16, 4)] for r in _schedule(key)]
    first, *middle, last = keys
    a, b, c, d = (int.from_bytes(iv[i : i + 4], "big") for i in range(0, 16, 4))
    words, out = [int.from_bytes(data[i : i + 4], "big") for i in range(0, len(data), 4)], []
    k0, k1, k2, k3 = first
    for i in range(0, len(words), 4):
        a, b, c, d = a ^ words[i] ^ k0, b ^ words[i + 1] ^ k1, c ^ words[i + 2] ^ k2, d ^ words[i + 3] ^ k3
        for e, f, g, h in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ e,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ f,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ g,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ h,
            )
        a, b, c, d = (
            (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ k
            for p, q, r, s, k in ((a, b, c, d, last[0]), (b, c, d, a, last[1]), (c, d, a, b, last[2]), (d, a, b, c, last[3]))
        )
        out += (a, b, c, d)
    return b"".join([w.to_bytes(4, "big") for w in out])


def file_key(password: bytes, o: bytes, p: int, doc_id: bytes, revision: int, length: int, with_metadata: bool) -> bytes:
    h = hashlib.md5((password + PAD)[:32] + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + doc_id)
    if revision >= 4 and not with_metadata:
        h.update(b"\xff\xff\xff\xff")
    key = h.digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:length]).digest()
    return key[:length]


def _twenty(key: bytes, data: bytes, order) -> bytes:
    for i in order:
        data = rc4(bytes(b ^ i for b in key), data)
    return data


def user_from_owner(password: bytes, o: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key).digest()
    return _twenty(key[:length], o[:32], range(19, -1, -1)) if revision >= 3 else rc4(key[:length], o[:32])


def opens(key: bytes, u: bytes, doc_id: bytes, revision: int) -> bool:
    if revision < 3:
        return rc4(key, PAD) == u[:32]
    return _twenty(key, hashlib.md5(PAD + doc_id).digest(), range(20)) == u[:16]


def object_key(key: bytes, num: int, gen: int, aes: bool) -> bytes:
    raw = key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")
    return hashlib.md5(raw).digest()[: min(len(key) + 5, 16)]


class Security:
    """Decrypts the strings and streams of one document."""

    def __init__(self, d: dict, doc_id: bytes | None, password: str | None, own_id=None):
        if d.get("Filter", "Standard") != "Standard":
            raise PdfError("unsupportedEncryption")
        v, r = d.get("V", 0), d.get("R", 0)
        if v not in (1, 2, 3, 4, 5) or r not in (2, 3, 4, 5, 6):
            raise PdfError("unsupportedEncryption")
        o, u = d.get("O"), d.get("U")
        if not isinstance(o, bytes) or not isinstance(u, bytes) or not isinstance(d.get("P"), int):
            raise PdfError("unsupportedEncryption")
        bits = d.get("Length") if isinstance(d.get("Length"), int) else 40 if v == 1 else 256 if r >= 5 else 128
        n, self.own_id = min(max(bits // 8, 5), 32), own_id
        self.methods, self.stream, self.string = {"Identity": "none"}, "default", "default"
        if v >= 4:
            for name, f in (d.get("CF") or {}).items():
                if isinstance(f, dict) and f.get("AuthEvent", "DocOpen") == "DocOpen":
                    self.methods[name] = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes256"}.get(str(f.get("CFM", "None")), "none")
            self.stream, self.string = str(d.get("StmF", "Identity")), str(d.get("StrF", "Identity"))
            if r < 5:
                n = 16
        else:
            self.methods["default"] = "rc4"
        if r >= 5:
            self.key = self._key_256((password or "").encode()[:127], d, o, u, r, password)
            return
        if doc_id is None:
            raise PdfError("missingDocumentId")
        whole = d.get("EncryptMetadata") is not False
        given = (password or "").encode("latin-1", "replace")
        for candidate in (given, user_from_owner(given, o, r, n)):
            key = file_key(candidate, o, d["P"], doc_id, r, n, whole)
            if opens(key, u, doc_id, r):
                self.key = key
                return
        raise PdfError("invalidPassword" if password else "passwordRequired")

    @staticmethod
    def _key_256(given: bytes, d: dict, o: bytes, u: bytes, r: int, password) -> bytes:
        for check, salt, extra, wrapped in ((u[:32], 32, b"", d.get("UE")), (o[:32], 32, u[:48], d.get("OE"))):
            own = u if not extra else o
            digest = hash_of_revision(given + own[salt : salt + 8] + extra, given, extra, r)
            if digest == check and isinstance(wrapped, bytes):
                key = hash_of_revision(given + own[salt + 8 : salt + 16] + extra, given, extra, r)
                return aes_cbc_decrypt(key, wrapped[:32], iv=bytes(16), unpad=False)
        raise PdfError("invalidPassword" if password else "passwordRequired")

    def _run(self, method: str, num: int, gen: int, data: bytes) -> bytes:
        if method == "none" or not data:
            return data
        if method == "rc4":
            return rc4(object_key(self.key, num, gen, False), data)
        if method == "aes":
            return aes_cbc_decrypt(object_key(self.key, num, gen, True), data)
        return aes_cbc_decrypt(self.key, data)

    def _method(self, name: str) -> str:
        return self.methods.get(name) or self.methods.get(self.stream, "none")

    def of_string(self, ident, data: bytes) -> bytes:
        if ident is None or ident == self.own_id:
            return data
        return self._run(self._method(self.string), ident[0], ident[1], data)

    def of_stream(self, ident, data: bytes, name: str | None = None) -> bytes:
        if ident is None or ident == self.own_id:
            return data
        return self._run(self._method(name or self.stream), ident[0], ident[1], data)


@lru_cache(256)
def hash_of_revision(data: bytes, password: bytes, extra: bytes, revision: int) -> bytes:
    """Revision 5 is one SHA-256.  Revision 6 hardens it (ISO 32000-2, algorithm 2.B): rounds of AES over 64 copies of what is
    known, each hashed by the function that the result modulo 3 names, until 64 rounds are done and the last byte allows it.  Files that share an
    encryption dictionary, as those of one batch may, share the work."""
    k, done = hashlib.sha256(data).digest(), 0
    while revision >= 6:
        sealed = aes_cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(sealed[:16]) % 3](sealed).digest()
        done += 1
        if done >= 64 and sealed[-1] <= done - 32:
            break
    return k[:32]


def is_name(x) -> bool:
    return isinstance(x, Name)
