"""Fonts as far as text needs them: widths, code maps and ToUnicode, with one dictionary look-up per code."""

from __future__ import annotations

from bisect import bisect_right
from typing import Any

from .geometry import Matrix, matrix_of
from .objects import Keyword, Lexer, PdfError, parse_object
from .text import pdf_text

SUBTYPES = ("Type0", "Type1", "Type3", "TrueType")


class FirstMatch:
    """Code -> entry, where entries are (lo, hi, payload) and the first that holds the code counts."""

    def __init__(self, entries: list[tuple[int, int, Any]]):
        self.entries = entries
        self.single: dict[int, int] = {}
        wide = []
        for pos, (lo, hi, _) in enumerate(entries):
            if lo == hi:
                self.single.setdefault(lo, pos)
            else:
                wide.append((lo, hi, pos))
        # Pieces between all ends, each with the first range over it.
        cuts = sorted({x for lo, hi, _ in wide for x in (lo, hi + 1)})
        self.cuts, self.first = cuts, [None] * len(cuts)
        for lo, hi, pos in sorted(wide, key=lambda x: -x[2]):
            for i in range(bisect_right(cuts, lo) - 1, bisect_right(cuts, hi)):
                self.first[i] = pos

    def find(self, code: int) -> tuple[int, int, Any] | None:
        i = bisect_right(self.cuts, code) - 1
        found = [p for p in (self.single.get(code), self.first[i] if i >= 0 else None) if p is not None]
        return self.entries[min(found)] if found else None


def codes(data: bytes, spaces: list[tuple[int, int, int]]) -> list[int]:
    """Codes by the first codespace range (bytes, lo, hi) that fits and holds them; a byte that none takes is passed over."""
    out, at = [], 0
    while at < len(data):
        for n, lo, hi in spaces:
            if at + n <= len(data) and lo <= (code := int.from_bytes(data[at : at + n], "big")) <= hi:
                out.append(code)
                at += n
                break
        else:
            at += 1
    return out


def _big_endian(b: bytes) -> int:
    return int.from_bytes(b[:4], "big")


def _utf16(b: bytes) -> str:
    return b.decode("utf-16-be", "ignore") if len(b) % 2 == 0 else ""


def parse_cmap(data: bytes, unicode: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, Any]], int]:
    """(codespaces, mappings, writing mode). A mapping's payload is a number that grows with the code, or a text."""
    lex, spaces, maps, mode, last = Lexer(data), [], [], 0, None
    while True:
        found, x = parse_object(lex)
        if not found:
            return spaces, maps, mode
        word = str(x) if isinstance(x, Keyword) else None
        if word == "begincodespacerange":
            for lo, hi in _groups(lex, "endcodespacerange", 2):
                if isinstance(lo, bytes) and isinstance(hi, bytes) and lo:
                    spaces.append((len(lo), _big_endian(lo), _big_endian(hi)))
        elif word == ("beginbfchar" if unicode else "begincidchar"):
            for code, to in _groups(lex, "endbfchar" if unicode else "endcidchar", 2):
                if not isinstance(code, bytes) or not isinstance(to, bytes if unicode else int):
                    raise PdfError("unsupportedCMap")
                maps.append((_big_endian(code), _big_endian(code), _utf16(to) if unicode else to))
        elif word == ("beginbfrange" if unicode else "begincidrange"):
            for lo, hi, to in _groups(lex, "endbfrange" if unicode else "endcidrange", 3):
                if not isinstance(lo, bytes) or not isinstance(hi, bytes):
                    raise PdfError("unsupportedCMap")
                a, b = _big_endian(lo), _big_endian(hi)
                if isinstance(to, list):
                    maps += [(a + i, a + i, _utf16(t)) for i, t in enumerate(t for t in to if isinstance(t, bytes))]
                elif isinstance(to, bytes):
                    maps.append((a, b, _utf16(to)))
                elif type(to) is int:
                    maps.append((a, b, to))
        elif word == "def" and isinstance(last, tuple) and last[0] == "WMode":
            mode = last[1] if type(last[1]) is int else 0
        last = (str(last), x) if isinstance(last, str) else x
        if isinstance(x, str) and not isinstance(x, Keyword):
            last = str(x)


def _groups(lex: Lexer, end: str, n: int):
    while True:
        group = []
        while len(group) < n:
            found, x = parse_object(lex)
            if not found:
                raise PdfError("invalidCMapData")
            if isinstance(x, Keyword):
                if x == end and not group:
                    return
                raise PdfError("unsupportedCMap")
            group.append(x)
        yield tuple(group)


class ToUnicode:
    def __init__(self, data: bytes):
        self.spaces, maps, _ = parse_cmap(data, unicode=True)
        self.map = FirstMatch(maps)

    def decode(self, data: bytes) -> str | None:
        out = []
        for code in codes(data, self.spaces):
            if hit := self.map.find(code):
                lo, hi, text = hit
                if lo == hi or code == lo:
                    out.append(text)
                elif text:
                    last = ord(text[-1]) + code - lo
                    if last < 0x110000 and not 0xD800 <= last < 0xE000:
                        out.append(text[:-1] + chr(last))
        return "".join(out) or None


class Font:
    def __init__(self, doc, d: dict):
        sub = doc.name_(d.get("Subtype"))
        if sub is None:
            raise PdfError("missingRequiredParameters")
        if sub not in SUBTYPES:
            raise PdfError("unsupportedFontSubtype")
        self.subtype = sub
        kids = doc.list_(d.get("DescendantFonts")) or []
        self.child = (doc.dict_(kids[0]) if kids else None) or {}
        desc = doc.dict_((self.child if sub == "Type0" else d).get("FontDescriptor"))
        get = desc.get if desc is not None else {}.get
        self.ascent, self.descent, self.cap_height, self.italic = (doc.real_(get(k)) for k in ("Ascent", "Descent", "CapHeight", "ItalicAngle"))
        self.bbox = doc.rect_(get("FontBBox"))
        program = next((get(k) for k in ("FontFile", "FontFile2", "FontFile3") if get(k) is not None), None)
        self.ps_name = doc.name_(get("FontName")) if doc.stream_(program) is not None else None
        self.base_font = doc.name_(d.get("BaseFont"))
        self.matrix = matrix_of(doc.reals_(d.get("FontMatrix"))) or (Matrix(0.001, 0, 0, 0.001) if sub == "Type3" else Matrix())
        self.encoding, self.differences = None, {}
        self.first, self.widths, self.missing = 0, [], 0.0
        self.vertical, self.table = False, None
        if sub == "Type0":
            self._composite(doc, d)
        else:
            self._encoding(doc, d.get("Encoding"))
            self.first = doc.int_(d.get("FirstChar")) or 0
            self.widths = doc.reals_(d.get("Widths")) or []
            self.missing = (doc.real_(get("MissingWidth")) or 0.0) if sub != "Type3" else 0.0
            if sub == "Type3" and (doc.rect_(d.get("FontBBox")) is None or doc.dict_(d.get("CharProcs")) is None):
                raise PdfError("missingRequiredParameters")
        s = doc.stream_(d.get("ToUnicode"))
        self.to_unicode = ToUnicode(s.data) if s is not None else None

    def _encoding(self, doc, x) -> None:
        if (name := doc.name_(x)) is not None:
            self.encoding = name
            return
        d = doc.dict_(x)
        if d is None:
            if x is not None:
                raise PdfError("missingRequiredParameters")
            return
        self.encoding = doc.name_(d.get("BaseEncoding"))
        code = None
        for v in doc.list_(d.get("Differences")) or []:
            if (n := doc.int_(v)) is not None:
                code = n
            elif (name := doc.name_(v)) is not None and code is not None:
                self.differences[code] = name
                code += 1

    def _composite(self, doc, d: dict) -> None:
        x = doc.resolve(d.get("Encoding"))
        if (name := doc.name_(x)) is not None:
            if name not in ("Identity-H", "Identity-V"):
                raise PdfError("unsupportedCMap")
            self.spaces, maps, mode = [(2, 0, 0xFFFF)], [], int(name == "Identity-V")
        elif (s := doc.stream_(x)) is not None:
            self.spaces, maps, mode = parse_cmap(s.data, unicode=False)
        else:
            raise PdfError("missingRequiredParameters")
        self.vertical, self.cmap = bool(mode), FirstMatch(maps)
        if not self.child:
            raise PdfError("missingRequiredParameters")
        self.default_width = doc.real_(self.child.get("DW"))
        self.default_width = 1000.0 if self.default_width is None else self.default_width
        self.cid_ranges: list[tuple[int, int, float]] = []
        w, i = doc.list_(self.child.get("W")) or [], 0
        while i + 1 < len(w):
            lo, nxt = doc.int_(w[i]), doc.resolve(w[i + 1])
            if lo is None:
                break
            if isinstance(nxt, list):
                self.cid_ranges += [(lo + k, lo + k, v) for k, v in enumerate(map(doc.real_, nxt)) if v is not None]
                i += 2
            else:
                hi, v = doc.int_(nxt), doc.real_(w[i + 2]) if i + 2 < len(w) else None
                if hi is None or v is None:
                    break
                self.cid_ranges.append((lo, hi, v))
                i += 3
        self.cid_widths = FirstMatch(self.cid_ranges)
        self.default_vertical = (doc.reals_(self.child.get("DW2")) or [880.0, -1000.0])[:2]
        self.vertical_ranges = list(self._vertical(doc, doc.list_(self.child.get("W2")) or []))
        g = doc.stream_(self.child.get("CIDToGIDMap"))
        self.gids = g.data if g is not None else None

    @staticmethod
    def _vertical(doc, w: list):
        """(first, last, advance down, origin's x and y) of W2: three numbers for each code of a list, or for a range."""
        i = 0
        while i + 1 < len(w):
            lo, nxt = doc.int_(w[i]), doc.resolve(w[i + 1])
            numbers = doc.reals_(nxt if isinstance(nxt, list) else w[i + 2 : i + 5]) or []
            if lo is None or not isinstance(nxt, list) and (type(nxt) is not int or len(numbers) < 3):
                return
            if isinstance(nxt, list):
                for k in range(len(numbers) // 3):
                    yield lo + k, lo + k, *numbers[3 * k : 3 * k + 3]
            else:
                yield lo, nxt, *numbers
            i += 2 if isinstance(nxt, list) else 5

    def glyph(self, code: int) -> str | None:
        """The name of a simple font's glyph: of the differences, else of the base encoding."""
        from .glyphs import encoding

        return self.differences.get(code) or encoding(self.encoding or "StandardEncoding").get(code)

    def gid(self, cid: int) -> int:
        if self.gids is None:
            return cid
        return int.from_bytes(self.gids[2 * cid : 2 * cid + 2], "big")

    def cids(self, data: bytes) -> list[int]:
        out = []
        for c in codes(data, self.spaces):
            hit = self.cmap.find(c)
            out.append(c if hit is None else hit[2] + c - hit[0])
        return out

    def widths_of(self, data: bytes) -> list[tuple[int, float]]:
        """(code, width in thousandths) of each character."""
        if self.subtype == "Type0":
            return [(c, hit[2] if (hit := self.cid_widths.find(c)) else self.default_width) for c in self.cids(data)]
        n, first = len(self.widths), self.first
        return [(c, self.widths[c - first] if 0 <= c - first < n else self.missing) for c in data]

    def run(self, data: bytes) -> tuple[float, int, int]:
        """(width in thousandths, characters, spaces) of a run."""
        if self.subtype == "Type0":
            found = self.widths_of(data)
            return sum(w for _, w in found), len(found), sum(1 for c, _ in found if c == 32)
        if self.table is None:
            self.table = [w for _, w in self.widths_of(bytes(range(256)))]
        return sum(map(self.table.__getitem__, data)), len(data), data.count(32)

    def metrics(self) -> tuple[float, float]:
        """(ascent, descent) for size 1: of the descriptor, else of the font's box, else a guess."""
        if self.ascent is not None and self.descent is not None and self.ascent > self.descent:
            return self.ascent / 1000, self.descent / 1000
        if self.bbox is not None and self.bbox.height > 0:
            return (self.bbox.y + self.bbox.height) / 1000, self.bbox.y / 1000
        return 0.8, -0.2

    def decode(self, data: bytes) -> str:
        text = self.to_unicode.decode(data) if self.to_unicode else None
        return pdf_text(data) if text is None else text
