"""A writer of small PDF files for tests and queries. It shares no code with the reader, so that an error cannot cancel out."""

from __future__ import annotations

import hashlib
import zlib


def literal(b: bytes) -> bytes:
    """A string in parentheses."""
    for c in (b"\\", b"(", b")"):
        b = b.replace(c, b"\\" + c)
    return b"(" + b.replace(b"\r", b"\\r") + b")"


def stream(data: bytes, extra: bytes = b"", flate: bool = False) -> bytes:
    if flate:
        data, extra = zlib.compress(data), extra + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


class Writer:
    """Objects by number; then a file with a classic table, a cross-reference stream, or none."""

    def __init__(self, version: str = "1.7"):
        self.out = bytearray(b"%%PDF-%s\n" % version.encode())
        self.objects: dict[int, bytes] = {}
        self.written: list[tuple[int, int, int]] = []  # number, offset, end
        self.last_xref = None

    def add(self, body: bytes, num: int | None = None) -> int:
        num = num or max(self.objects, default=0) + 1
        self.objects[num] = body
        return num

    def _put(self, num: int, body: bytes) -> int:
        at = len(self.out)
        self.out += b"%d 0 obj\n%s\nendobj\n" % (num, body)
        self.written.append((num, at, len(self.out)))
        return at

    def finish(self, root: int = 1, trailer: bytes = b"", xref: bool = True) -> bytes:
        places = {n: self._put(n, self.objects[n]) for n in sorted(self.objects)}
        if not xref:
            return bytes(self.out)
        return self._table(places, root, trailer)

    def _table(self, places: dict[int, int], root: int, trailer: bytes = b"") -> bytes:
        self._put_table(places, root, trailer)
        return bytes(self.out)

    def _put_table(self, places: dict[int, int], root: int, trailer: bytes = b"") -> None:
        at, top = len(self.out), max(self.objects) + 1
        prev = b"" if self.last_xref is None else b" /Prev %d" % self.last_xref
        self.out += b"xref\n"
        if self.last_xref is None:
            self.out += b"0 1\n0000000000 65535 f \n"
        for n in sorted(places):
            self.out += b"%d 1\n%010d 00000 n \n" % (n, places[n])
        self.out += b"trailer\n<< /Size %d /Root %d 0 R%s %s >>\nstartxref\n%d\n%%%%EOF\n" % (top, root, prev, trailer, at)
        self.last_xref = at

    def update(self, changed: dict[int, bytes], root: int = 1) -> bytes:
        """An incremental update after finish()."""
        self.append(changed, root)
        return bytes(self.out)

    def append(self, changed: dict[int, bytes], root: int = 1) -> None:
        """The same, where the bytes are not asked for yet: each of many updates would copy all before it."""
        self.objects |= changed
        self._put_table({n: self._put(n, b) for n, b in sorted(changed.items())}, root)

    def finish_packed(self, root: int = 1, plain: frozenset[int] = frozenset(), flate: bool = False) -> bytes:
        """Objects in one object stream, except those in plain and streams; a cross-reference stream at the end."""
        packed = [n for n in sorted(self.objects) if n not in plain and b"\nstream\n" not in self.objects[n]]
        places = {n: self._put(n, self.objects[n]) for n in sorted(self.objects) if n not in packed}
        head, body = [], bytearray()
        for n in packed:
            head.append(b"%d %d" % (n, len(body)))
            body += self.objects[n] + b"\n"
        first = b" ".join(head) + b"\n"
        holder = max(self.objects) + 1
        places[holder] = self._put(holder, stream(first + bytes(body), b"/Type /ObjStm /N %d /First %d" % (len(packed), len(first)), flate))
        at, rows = len(self.out), bytearray(b"\0\0\0\0\0\xff\xff")
        places[holder + 1] = at
        for n in range(1, holder + 2):
            if n in packed:
                rows += b"\2" + holder.to_bytes(4, "big") + packed.index(n).to_bytes(2, "big")
            elif n in places:
                rows += b"\1" + places[n].to_bytes(4, "big") + b"\0\0"
            else:
                rows += bytes(7)
        self.out += b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (holder + 1, stream(bytes(rows), b"/Type /XRef /W [1 4 2] /Size %d /Root %d 0 R" % (holder + 2, root), flate), at)
        return bytes(self.out)


def one_page(content: bytes, resources: bytes = b"", page: bytes = b"/MediaBox [0 0 612 792]", extra: dict[int, bytes] | None = None, flate: bool = False) -> Writer:
    """Catalog 1, Pages 2, Page 3, content 4; further objects from 5 on."""
    w = Writer()
    w.add(b"<< /Type /Catalog /Pages 2 0 R >>", 1)
    w.add(b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 2)
    w.add(b"<< /Type /Page /Parent 2 0 R %s /Resources << %s >> /Contents 4 0 R >>" % (page, resources), 3)
    w.add(stream(content, flate=flate), 4)
    for n, body in (extra or {}).items():
        w.add(body, n)
    return w


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % b" ".join(b"%d" % (400 + 10 * (c % 16)) for c in range(32, 256))


def width_of(code: int) -> int:
    """What FONT says of a code."""
    return 400 + 10 * (code % 16) if 32 <= code < 256 else 0


def png_rows(rows: list[bytes], pixel: int, kinds: list[int]) -> bytes:
    """Rows with their filter bytes; kinds: 0 none, 1 left, 2 above, 3 half the sum of both, 4 the nearest to left + above - corner."""
    out, above = bytearray(), bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        out.append(kind)
        for i, v in enumerate(row):
            a, b = row[i - pixel] if i >= pixel else 0, above[i]
            c = above[i - pixel] if i >= pixel else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        above = row
    return bytes(out)


# ---- encryption of what is written --------------------------------------------------------------------------------

_FILL = b"\x28\xbf\x4e\x5e\x4e\x75\x8a\x41\x64\x00\x4e\x56\xff\xfa\x01\x08\x2e\x2e\x00\xb6\xd0\x68\x3e\x80\x2f\x0c\xa9\xfe\x64\x53\x69\x7a"


def arcfour(key: bytes, text: bytes) -> bytes:
    box = list(range(256))
    y = 0
    for x in range(256):
        y = (y + box[x] + key[x % len(key)]) % 256
        box[x], box[y] = box[y], box[x]
    x = y = 0
    res = []
    for c in text:
        x = (x + 1) % 256
        y = (y + box[x]) % 256
        box[x], box[y] = box[y], box[x]
        res.append(c ^ box[(box[x] + box[y]) % 256])
    return bytes(res)


def rc4_40(w: Writer, user: bytes, owner: bytes, doc_id: bytes = b"0123456789abcdef") -> tuple[bytes, bytes]:
    """(trailer entries, file key) of the 40-bit handler, revision 2; streams must be encrypted with object_key()."""
    o = arcfour(hashlib.md5((owner + _FILL)[:32]).digest()[:5], (user + _FILL)[:32])
    key = hashlib.md5((user + _FILL)[:32] + o + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + doc_id).digest()[:5]
    u = arcfour(key, _FILL)
    return b"/ID [<%s><%s>] /Encrypt << /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >>" % (doc_id.hex().encode(), doc_id.hex().encode(), o.hex().encode(), u.hex().encode()), key


def object_key(key: bytes, num: int, gen: int = 0, aes: bool = False) -> bytes:
    return hashlib.md5(key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()[: min(16, len(key) + 5)]


def aes_128(user: bytes, owner: bytes, doc_id: bytes = b"0123456789abcdef") -> tuple[bytes, bytes]:
    """(trailer entries, file key) of crypt filters with AESV2, revision 4."""
    k = hashlib.md5((owner + _FILL)[:32]).digest()
    for _ in range(50):
        k = hashlib.md5(k).digest()
    o = (user + _FILL)[:32]
    for i in range(20):
        o = arcfour(bytes(c ^ i for c in k), o)
    key = hashlib.md5((user + _FILL)[:32] + o + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + doc_id).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    u = hashlib.md5(_FILL + doc_id).digest()
    for i in range(20):
        u = arcfour(bytes(c ^ i for c in key), u)
    cf = b"/CF << /StdCF << /CFM /AESV2 /AuthEvent /DocOpen /Length 16 >> >> /StmF /StdCF /StrF /StdCF"
    return b"/ID [<%s><%s>] /Encrypt << /Filter /Standard /V 4 /R 4 /Length 128 /P -4 /O <%s> /U <%s> %s >>" % (doc_id.hex().encode(), doc_id.hex().encode(), o.hex().encode(), (u + bytes(16)).hex().encode(), cf), key


def aes_256(user: bytes, key: bytes) -> bytes:
    """Trailer entries of crypt filters with AESV3, revision 6, for a user's password and a file key of 32 bytes."""
    salts = b"saltsalt", b"keysalt!"
    u = hardened(user + salts[0], user) + salts[0] + salts[1]
    ue = rijndael_cbc(hardened(user + salts[1], user), bytes(16), key)
    cf = b"/CF << /StdCF << /CFM /AESV3 /AuthEvent /DocOpen /Length 32 >> >> /StmF /StdCF /StrF /StdCF"
    o = bytes(48)
    return b"/Encrypt << /Filter /Standard /V 5 /R 6 /Length 256 /P -4 /O <%s> /OE <%s> /U <%s> /UE <%s> /Perms <%s> %s >>" % (o.hex().encode(), bytes(32).hex().encode(), u.hex().encode(), ue.hex().encode(), bytes(16).hex().encode(), cf)


def hardened(start: bytes, password: bytes) -> bytes:
    k, rounds = hashlib.sha256(start).digest(), 0
    while True:
        e = rijndael_cbc(k[:16], k[16:32], (password + k) * 64)
        k = hashlib.new(("sha256", "sha384", "sha512")[int.from_bytes(e[:16], "big") % 3], e).digest()
        rounds += 1
        if rounds > 63 and e[-1] + 32 <= rounds:
            return k[:32]


def rijndael_cbc(key: bytes, iv: bytes, text: bytes) -> bytes:
    """By the book, byte by byte."""
    log, exp, v = {}, [], 1
    for i in range(255):
        exp.append(v)
        log[v] = i
        v ^= (v << 1) ^ (0x11B if v & 0x80 else 0)
    mul = lambda a, b: exp[(log[a] + log[b]) % 255] if a and b else 0
    turn = lambda x, n: (x << n | x >> (8 - n)) & 255
    sub = [0x63]
    for a in range(1, 256):
        i = exp[-log[a] % 255]
        sub.append(i ^ turn(i, 1) ^ turn(i, 2) ^ turn(i, 3) ^ turn(i, 4) ^ 0x63)
    double, triple = [mul(a, 2) for a in range(256)], [mul(a, 3) for a in range(256)]
    nk, w, rc = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    for i in range(nk, 4 * (nk + 7)):
        t = list(w[-1])
        if i % nk == 0:
            t = [sub[x] for x in t[1:] + t[:1]]
            t[0], rc = t[0] ^ rc, mul(rc, 2)
        elif nk > 6 and i % nk == 4:
            t = [sub[x] for x in t]
        w.append([x ^ y for x, y in zip(w[i - nk], t, strict=True)])
    flat = [sum(w[r : r + 4], []) for r in range(0, len(w), 4)]
    out = b""
    for at in range(0, len(text), 16):
        s = [x ^ y ^ z for x, y, z in zip(text[at : at + 16], iv, flat[0], strict=True)]
        for r, k in enumerate(flat[1:], 1):
            s = [sub[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < len(flat) - 1:
                s = [double[s[c + i]] ^ triple[s[c + (i + 1) % 4]] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in range(0, 16, 4) for i in range(4)]
            s = [x ^ y for x, y in zip(s, k, strict=True)]
        iv = bytes(s)
        out += iv
    return out
