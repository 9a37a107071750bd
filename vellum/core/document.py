"""One document: header, cross-reference sections, objects by id, decryption and the page tree.

Nothing here raises out of the table functions: what can be read is yielded and what fails becomes a row of errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from . import filters
from .crypt import Security
from .geometry import Rect, rect_of
from .objects import Keyword, Lexer, Name, PdfError, Ref, Stream, require_object

#: Failures of the cross-reference data after which the file is scanned for objects instead.
RECOVERABLE = {"startXrefNotFound", "xrefNotFound", "eofMarkerNotFound", "expectedDictionary"}
_MISSING = object()
#: Chains of references longer than this are a loop in all but name.
MAX_CHAIN = 64
MAX_DEPTH = 512


class Document:
    def __init__(self, data: bytes, password: str | None = None):
        self.data, self.password = data, password
        self.errors: list[tuple[str, int | None, int | None, tuple | None]] = []
        self.sections: list[dict[str, Any]] = []  # trailer, offsets {Ref: offset}, packed {Ref: (stream, index)}
        self.trailer: dict = {}
        self.header: tuple[str, str] | None = None
        self.xref_range = (0, len(data))
        self.recovered = False
        self.security: Security | None = None
        self._cache: dict[Ref, Any] = {}
        self._streams: dict[Ref, tuple[list[int], list[int]]] = {}
        self._busy: set[Ref] = set()
        self._extent: dict[int, int] = {}
        self._layout: dict[Ref, tuple] = {}
        self.ok = self._open()

    # ---- opening ------------------------------------------------------------------------------------------------

    def fail(self, e: PdfError, intent: tuple | None = None) -> None:
        self.errors.append((e.failure, e.start, e.end, e.intent or intent))

    def _open(self) -> bool:
        try:
            self.header = self._read_header()
        except PdfError as e:
            self.fail(e, ("header", None, None))
            return False
        try:
            try:
                self._read_sections(*self._tail())
            except PdfError as e:
                if e.failure not in RECOVERABLE:
                    raise
                self._recover()
        except PdfError as e:
            self.fail(e, ("crossReferenceSection", None, None))
            return False
        self._lay_out()
        if (d := self.trailer.get("Encrypt")) is not None:
            try:
                own = d if isinstance(d, Ref) else None
                d = self.resolve(d)
                if not isinstance(d, dict):
                    raise PdfError("unsupportedEncryption")
                ids = self.resolve(self.trailer.get("ID"))
                first = self.resolve(ids[0]) if isinstance(ids, list) and ids else None
                d = {k: self.resolve(v) for k, v in d.items()}
                self.security = Security(d, first if isinstance(first, bytes) else None, self.password, own)
                self._cache.clear()
            except PdfError as e:
                self.fail(e, ("encryption", None, None))
                return False
        return True

    _HEAD = re.compile(rb"%(PDF)-(\d\.\d)[\r\n]")

    def _read_header(self) -> tuple[str, str]:
        if m := self._HEAD.match(self.data):
            return m[1].decode("latin-1"), m[2].decode("latin-1")
        m = re.match(rb"[\x00\t\n\x0c\r ]*%([^\r\n\x0c]*)", self.data)
        word = re.match(rb"[^\x00\t\n\x0c\r %()\[\]{}/<>\\]+", m[1].lstrip(b"\0\t ")) if m else None
        parts = word[0].decode("latin-1").split("-") if word else []
        parts = [p for p in parts if p]
        if len(parts) != 2:
            raise PdfError("headerNotFound", 0, min(64, len(self.data)))
        return parts[0], parts[1]

    _LAST = re.compile(rb"[\r\n](startxref)[\r\n]+(\d{1,18})[\r\n]+%%EOF[\r\n]*\Z")

    def _tail(self) -> tuple[int, int]:
        """[xref offset, offset of the word startxref) from the last three lines."""
        end = self.data[-64:]
        if m := self._LAST.search(end):
            return int(m[2]), len(self.data) - len(end) + m.start(1)
        window = 2048
        while True:
            lines = list(re.finditer(rb"[^\r\n]+", self.data[-window:]))
            if len(lines) > 3 or window >= len(self.data):
                break
            window *= 8  # long lines, or blanks after the end
        lines = lines[-3:]
        at = max(0, len(self.data) - window) + (lines[0].start() if lines else 0)
        lex = Lexer(self.data, at)
        t = lex.next()
        if t is None or t[0] != "word" or t[1] != b"startxref":
            raise PdfError("startXrefNotFound", at, len(self.data))
        start = lex.natural()
        if not re.match(rb"[\x00\t\n\x0c\r ]*%%EOF", self.data[lex.pos :]):
            raise PdfError("eofMarkerNotFound", lex.pos, len(self.data))
        return start, t[2]

    def _read_sections(self, start: int, end: int) -> None:
        self.xref_range = (start, end)
        seen: set[int] = set()
        while start not in seen:
            seen.add(start)
            section = self._section(start) | {"at": start}
            self.sections.append(section)
            hybrid = section["trailer"].get("XRefStm")
            if isinstance(hybrid, int) and hybrid not in seen and hybrid < end:
                seen.add(hybrid)
                self.sections.append(self._section(hybrid) | {"at": hybrid, "hybrid": True})
            start = section["trailer"].get("Prev")
            if not isinstance(start, int):
                break
        self.trailer = self.sections[0]["trailer"]

    def _section(self, at: int) -> dict[str, Any]:
        if not 0 <= at < len(self.data):
            raise PdfError("xrefNotFound", at, at)
        lex = Lexer(self.data, at)
        try:
            t = lex.next()
        except PdfError as e:
            raise PdfError("xrefNotFound", at, lex.end) from e
        if t is None:
            raise PdfError("xrefNotFound", at, lex.end)
        if t[0] == "word" and t[1] == b"xref":
            return self._classic(lex)
        return self._from_stream(at)

    # What most files have, in one match each; whatever else there is goes to the lexer.
    _ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,18})[\x00\t\n\x0c\r ]+(\d{1,18})[\x00\t\n\x0c\r ]+([nf])(?![^\x00\t\n\x0c\r %()\[\]{}/<>\\])")
    _BEGIN = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,18})[\x00\t\n\x0c\r ]+(\d{1,18})[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r %()\[\]{}/<>\\])")
    _SPAN = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,18})[\x00\t\n\x0c\r ]+(\d{1,18})(?=[\x00\t\n\x0c\r ])")
    _BODY = re.compile(rb"[\x00\t\n\x0c\r ]*(stream)(?=[\t\n\r ])")
    _ENDS = re.compile(rb"[\x00\t\n\x0c\r ]*endstream[\x00\t\n\x0c\r ]+endobj(?![^\x00\t\n\x0c\r %()\[\]{}/<>\\])")
    _END = re.compile(rb"[\x00\t\n\x0c\r ]*endobj(?![^\x00\t\n\x0c\r %()\[\]{}/<>\\])")

    def _classic(self, lex: Lexer) -> dict[str, Any]:
        offsets: dict[Ref, int] = {}
        while True:
            if m := self._SPAN.match(lex.data, lex.pos, lex.end):
                first, n, lex.pos = int(m[1]), int(m[2]), m.end()
            else:
                t = lex.next()
                if t is None:
                    raise PdfError("xrefNotFound", lex.pos, lex.end)
                if t[0] == "word" and t[1] == b"trailer":
                    d = require_object(lex)
                    if not isinstance(d, dict):
                        raise PdfError("expectedDictionary", t[2], lex.pos)
                    return {"trailer": d, "offsets": offsets, "packed": {}}
                if t[0] != "int" or t[1] < 0:
                    raise PdfError("expectedNaturalNumber", t[2], t[3])
                first, n = t[1], lex.natural()
            for num in range(first, first + n):
                if m := self._ENTRY.match(lex.data, lex.pos, lex.end):
                    lex.pos = m.end()
                    if m[3] == b"n" and (offset := int(m[1])):
                        offsets[Ref(num, int(m[2]))] = offset
                    continue
                offset, gen, flag = lex.natural(), lex.natural(), lex.next()
                if flag is None or flag[0] != "word" or flag[1] not in (b"n", b"f"):
                    if offset == 0 and flag is not None:
                        continue
                    raise PdfError("unexpectedToken", flag[2] if flag else lex.pos, flag[3] if flag else lex.end)
                if flag[1] == b"n" and offset:
                    offsets[Ref(num, gen)] = offset

    def _from_stream(self, at: int) -> dict[str, Any]:
        _, obj = self._indirect(Lexer(self.data, at), direct_only=True)
        if not isinstance(obj, Stream):
            raise PdfError("expectedDictionary", at, at)
        d = obj.dict
        if d.get("Type") != "XRef":
            raise PdfError("expectedType", at, at)
        w = d.get("W")
        if not isinstance(w, list) or len(w) != 3 or not all(type(x) is int and x >= 0 for x in w):
            raise PdfError("missingRequiredParameters", at, at)
        spans = d.get("Index", [0, d["Size"]] if type(d.get("Size")) is int else None)
        if not isinstance(spans, list) or len(spans) % 2 or not all(type(x) is int for x in spans):
            raise PdfError("missingRequiredParameters", at, at)
        offsets, packed, pos, size = {}, {}, 0, sum(w)
        for first, n in zip(spans[::2], spans[1::2], strict=True):
            for num in range(first, first + n):
                if pos + size > len(obj.data):
                    raise PdfError("objectEndedUnexpectedly", at, at)
                cut = [pos, pos + w[0], pos + w[0] + w[1], pos + size]
                kind, a, b = (int.from_bytes(obj.data[i:j], "big") for i, j in zip(cut, cut[1:], strict=False))
                pos += size
                kind = kind if w[0] else 1
                if num and kind == 1:
                    offsets[Ref(num, b)] = a
                elif num and kind == 2:
                    packed[Ref(num, 0)] = (Ref(a, 0), b)
        return {"trailer": d, "offsets": offsets, "packed": packed}

    _POINTER = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r %()\[\]{}/<>\\])")
    _OBJ = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r %()\[\]{}/<>\\])|(?<![A-Za-z0-9])(trailer|stream)(?![A-Za-z0-9])")

    def _recover(self) -> None:
        """Every object header in the file; the last of an id holds. Stream bodies are passed over, unless nothing ends them."""
        self.recovered, self.sections = True, []
        offsets: dict[Ref, int] = {}
        trailer, at = None, 0
        while m := self._OBJ.search(self.data, at):
            at = m.end()
            if m[3] == b"stream":
                end = self.data.find(b"endstream", at)
                at = end + 9 if end >= 0 else at
            elif m[3] == b"trailer":
                lex = Lexer(self.data, at)
                try:
                    d = require_object(lex)
                    if isinstance(d, dict):
                        trailer, at = d, lex.pos
                except PdfError:
                    continue
            else:
                offsets[Ref(int(m[1]), int(m[2]))] = m.start()
        if not offsets and trailer is None:
            raise PdfError("xrefNotFound", 0, len(self.data))
        trailer = dict(trailer or {})
        trailer.setdefault("Size", max((r.num for r in offsets), default=0) + 1)
        self.xref_range = (0, len(self.data))
        self.sections = [{"trailer": trailer, "offsets": offsets, "packed": {}, "at": 0}]
        self.trailer = trailer
        if "Root" not in trailer:
            for ref, start in sorted(offsets.items(), key=lambda x: x[1]):
                try:
                    _, obj = self._indirect(Lexer(self.data, start), direct_only=True)
                except PdfError:
                    continue
                if isinstance(obj, dict) and obj.get("Type") == "Catalog":
                    trailer["Root"] = ref
                    break

    def _lay_out(self) -> None:
        """What a lookup needs: the newest place of each id, and where the object at an offset ends."""
        for s in self.sections:
            for ref, offset in s["offsets"].items():
                self._layout.setdefault(ref, ("offset", offset))
            for ref, place in s["packed"].items():
                self._layout.setdefault(ref, ("packed", *place))
        starts = sorted({o for s in self.sections for o in s["offsets"].values()})
        self._extent = dict(zip(starts, [*starts[1:], self.xref_range[1]], strict=True)) if starts else {}

    # ---- objects ------------------------------------------------------------------------------------------------

    def get(self, ref: Ref) -> Any:
        """The object of an id; _MISSING where there is none."""
        if ref in self._cache:
            return self._cache[ref]
        place = self._layout.get(ref)
        if place is None or ref in self._busy:
            return _MISSING
        self._busy.add(ref)
        try:
            obj = self.read(ref, place)
        finally:
            self._busy.discard(ref)
        self._cache[ref] = obj
        return obj

    def read(self, ref: Ref, place: tuple) -> Any:
        """The object at a place, whatever its revision."""
        if place[0] == "packed":
            return self._member(ref, place[1], place[2])
        end = self._extent.get(place[1], len(self.data))
        found, obj = self._indirect(Lexer(self.data, place[1], end if end > place[1] else len(self.data)))
        if found != ref:
            raise PdfError("objectNotFound", place[1], end, ("indirectObject", *ref))
        return obj

    def _member(self, ref: Ref, holder: Ref, index: int) -> Any:
        intent = ("objectFromObjectStream", *ref)
        stream = self.get(holder)
        if stream is _MISSING:
            raise PdfError("objectNotFound", 0, len(self.data), intent)
        if not isinstance(stream, Stream):
            raise PdfError("expectedDictionary", 0, len(self.data), intent)
        if holder not in self._streams:
            n, first = stream.dict.get("N"), stream.dict.get("First")
            if type(n) is not int or type(first) is not int or not 0 <= first <= len(stream.data):
                raise PdfError("missingRequiredParameters", None, None, intent)
            lex = Lexer(stream.data, 0, first)
            values = [lex.natural() for _ in range(2 * n)]
            self._streams[holder] = values[::2], [first + v for v in values[1::2]]
        nums, starts = self._streams[holder]
        if not 0 <= index < len(nums) or nums[index] != ref.num or ref.gen:
            raise PdfError("objectNotFound", 0, len(stream.data), intent)
        end = starts[index + 1] if index + 1 < len(starts) else len(stream.data)
        if not starts[index] <= end <= len(stream.data):
            raise PdfError("missingRequiredParameters", None, None, intent)
        return require_object(Lexer(stream.data, starts[index], end))

    def _indirect(self, lex: Lexer, direct_only: bool = False) -> tuple[Ref, Any]:
        begin = self._BEGIN.match(lex.data, lex.pos, lex.end)
        ref = Ref(int(begin[1]), int(begin[2])) if begin else Ref(lex.natural(), lex.natural())
        intent = ("indirectObject", *ref)
        try:
            if begin:
                lex.pos = begin.end()
            else:
                lex.keyword(b"obj", "expectedIdentifierNotFound")
            sec = None if direct_only else self.security
            obj = require_object(lex, (lambda b: sec.of_string(ref, b)) if sec else None)
            if type(obj) is int and (m := self._POINTER.match(lex.data, lex.pos)):  # an object that is a reference
                obj, lex.pos = Ref(obj, int(m[1])), m.end()
            if m := self._END.match(lex.data, lex.pos, lex.end):
                lex.pos = m.end()
                return ref, obj
            if m := self._BODY.match(lex.data, lex.pos, lex.end):
                t, lex.pos = ("word", b"stream", *m.span(1)), m.end(1)
            else:
                t = lex.next()
            if t and t[0] == "word" and t[1] == b"stream":
                if not isinstance(obj, dict):
                    raise PdfError("expectedDictionary", t[2], t[3])
                length = obj.get("Length") if direct_only else self.resolve(obj.get("Length"))
                if type(length) is not int:
                    raise PdfError("missingLength", t[2], t[3])
                lex.end_of_line()
                raw = lex.data[lex.pos : lex.pos + length]
                if length < 0 or lex.pos + length > len(lex.data):
                    raise PdfError("objectEndedUnexpectedly", lex.pos, lex.end)
                lex.pos += length
                lex.end = max(lex.end, min(len(lex.data), lex.pos + 32))
                obj = self._stream(obj, raw, ref, direct_only)
                if m := self._ENDS.match(lex.data, lex.pos, lex.end):
                    lex.pos = m.end()
                    return ref, obj
                lex.keyword(b"endstream", "expectedIdentifierNotFound")
                t = lex.next()
            if t is None:
                raise PdfError("expectedToken", lex.pos, lex.end)
            if t[0] != "word" or t[1] != b"endobj":
                raise PdfError("expectedIdentifierNotFound", t[2], t[3])
        except PdfError as e:
            e.intent = e.intent or intent
            raise
        return ref, obj

    def _stream(self, d: dict, raw: bytes, ref: Ref, direct_only: bool) -> Stream:
        look = (lambda x: x) if direct_only else self.resolve
        names = look(d.get("Filter"))
        if names is None:
            names = []
        elif isinstance(names, Name):
            names = [names]
        elif isinstance(names, list):
            names = [n for n in map(look, names) if isinstance(n, Name)]
        else:
            raise PdfError("unexpectedToken")
        params = look(d.get("DecodeParms"))
        params = [look(p) for p in params] if isinstance(params, list) else [params]
        params = [{k: look(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in params]
        sec = None if direct_only else self.security
        if sec and "Crypt" not in names and d.get("Type") != "XRef":
            raw = sec.of_stream(ref, raw)
        named = (lambda name, data: sec.of_stream(ref, data, str(name) if name else "Identity")) if sec else None
        data, pending = filters.decode(raw, names, params, look(d.get("Subtype")) == "Image", named)
        return Stream(d, data, ref, pending)

    def resolve(self, x: Any) -> Any:
        """The value behind references; None where they lead nowhere, fail, or go round."""
        for _ in range(MAX_CHAIN):
            if not isinstance(x, Ref):
                return x
            try:
                x = self.get(x)
            except PdfError:
                return None
            if x is _MISSING:
                return None
        return None

    # Typed access: the value behind references if it is of the kind, else None.
    def dict_(self, x) -> dict | None:
        x = self.resolve(x)
        return x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else None

    def list_(self, x) -> list | None:
        x = self.resolve(x)
        return x if isinstance(x, list) else None

    def name_(self, x) -> str | None:
        x = self.resolve(x)
        return str(x) if isinstance(x, Name) else None

    def int_(self, x) -> int | None:
        x = self.resolve(x)
        return x if type(x) is int else None

    def real_(self, x) -> float | None:
        x = self.resolve(x)
        return float(x) if type(x) in (int, float) else None

    def stream_(self, x) -> Stream | None:
        x = self.resolve(x)
        return x if isinstance(x, Stream) else None

    def string_(self, x) -> bytes | None:
        x = self.resolve(x)
        return x if isinstance(x, bytes) else None

    def bool_(self, x) -> bool | None:
        x = self.resolve(x)
        return x if isinstance(x, bool) else None

    def rect_(self, x) -> Rect | None:
        a = self.list_(x)
        return rect_of([self.real_(v) for v in a]) if a is not None else None

    def reals_(self, x) -> list[float] | None:
        a = self.list_(x)
        if a is None or {int, float}.issuperset(map(type, a)):
            return a if a is None else list(map(float, a))
        return [v for v in map(self.real_, a) if v is not None]

    # ---- tables -------------------------------------------------------------------------------------------------

    def xref_entries(self, section: int | None = None) -> Iterator[tuple]:
        """(section_ord, num, gen, kind, offset, stm_num, stm_index), newest section first; of one section alone, where it is given."""
        for k in range(len(self.sections)) if section is None else (section,):
            s = self.sections[k]
            for ref, offset in s["offsets"].items():
                yield k, ref.num, ref.gen, "offset", offset, None, None
            for ref, (holder, index) in s["packed"].items():
                yield k, ref.num, ref.gen, "packed", None, holder.num, index

    def places(self) -> Iterator[tuple[Ref, int, tuple]]:
        """(id, revision, place) of every sighting; revision 0 is the newest. A packed id counts once, as newest."""
        seen: dict[Ref, int] = {}
        packed: set[Ref] = set()
        for s in self.sections:
            for ref, offset in s["offsets"].items():
                seen[ref] = seen.get(ref, -1) + 1
                yield ref, seen[ref], ("offset", offset)
            for ref, place in s["packed"].items():
                seen[ref] = seen.get(ref, -1) + 1
                if ref not in packed:
                    packed.add(ref)
                    yield ref, seen[ref], ("packed", *place)

    def objects(self, nums: tuple[int, ...] | None = None) -> Iterator[tuple[Ref, int, Any]]:
        return (x[:3] for x in self.placed_objects(nums))

    def placed_objects(self, nums: tuple[int, ...] | None = None) -> Iterator[tuple[Ref, int, Any, tuple]]:
        """nums: only objects of these numbers are read."""
        for ref, revision, place in self.places():
            if nums is not None and ref.num not in nums:
                continue
            try:
                yield ref, revision, self.get(ref) if self._layout.get(ref) == place else self.read(ref, place), place
            except PdfError as e:
                self.fail(e, ("indirectObject", *ref))
            except RecursionError:
                self.fail(PdfError("missingEndOfScope"), ("indirectObject", *ref))

    def pages(self) -> Iterator["Page"]:
        """Pages in the order of the tree. A node that is none, or that comes twice on its own path, ends the walk with an error."""
        if not self.ok:
            return
        root = self.dict_(self.trailer.get("Root"))
        tree = self.dict_(root.get("Pages")) if root is not None else None
        if tree is None:
            self.fail(PdfError("expectedCatalog" if root is None else "expectedDictionary"), ("pages", None, None))
            return
        try:
            top = root.get("Pages")
            yield from self._walk(tree, {top} if isinstance(top, Ref) else set(), {}, [0], [], None)
        except PdfError as e:
            self.fail(e, ("pages", None, None))

    def _walk(self, node: dict, path: set, inherited: dict, count: list[int], place: list[int], parent: Ref | None) -> Iterator["Page"]:
        kids = self.list_(node.get("Kids"))
        if kids is None:
            raise PdfError("expectedArray")
        inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
        for i, kid in enumerate(kids):
            if not isinstance(kid, Ref):
                raise PdfError("expectedIndirectObject")
            if kid in path or len(path) > MAX_DEPTH:
                raise PdfError("expectedPageTree", None, None, ("pages", *kid))
            d = self.dict_(kid)
            if d is None:
                raise PdfError("expectedDictionary", None, None, ("pages", *kid))
            kind = self.name_(d.get("Type"))
            if kind is None:
                raise PdfError("expectedType", None, None, ("pages", *kid))
            if kind == "Page":
                yield Page(self, count[0], kid, d, inherited, node, [*place, i])
                count[0] += 1
            elif kind == "Pages":
                yield from self._walk(d, path | {kid}, inherited, count, [*place, i], kid)
            else:
                raise PdfError("expectedPageTree", None, None, ("pages", *kid))


class Page:
    def __init__(self, doc: Document, index: int, ref: Ref, d: dict, inherited: dict, parent: dict, path: list[int]):
        self.doc, self.index, self.ref, self.dict, self.path = doc, index, ref, d, path
        self.inherited, self.parent = inherited, parent

    def boxes(self) -> tuple[Rect | None, Rect | None, Rect]:
        """(crop, media) of the page itself, and the size that stands in: the nearest ancestor's box, or Letter."""
        doc = self.doc
        above = doc.rect_(self.inherited.get("CropBox")) or doc.rect_(self.inherited.get("MediaBox")) or Rect(0.0, 0.0, 612.0, 792.0)
        return doc.rect_(self.dict.get("CropBox")), doc.rect_(self.dict.get("MediaBox")), above

    def rect(self) -> Rect:
        crop, media, above = self.boxes()
        if crop and media:
            return crop.intersection(media) or media
        return crop or media or above

    def rotation(self) -> int:
        return self.doc.int_(self.dict.get("Rotate", self.inherited.get("Rotate"))) or 0

    def resources(self, inherit: bool = True) -> dict:
        own = self.dict.get("Resources")
        return self.doc.dict_(self.inherited.get("Resources") if own is None and inherit else own) or {}

    def streams(self) -> list[tuple[Ref | None, Stream]]:
        c = self.dict.get("Contents")
        if (s := self.doc.stream_(c)) is not None:
            return [(s.id, s)]
        return [(s.id, s) for x in self.doc.list_(c) or [] if (s := self.doc.stream_(x)) is not None]


def type_name(x: Any) -> str:
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "real"), (Name, "name"), (Keyword, "identifier"), (bytes, "string"), (Ref, "reference"), (list, "array"), (dict, "dictionary"), (Stream, "stream")):
        if isinstance(x, kind):
            return name
    return "null"


def tagged(x: Any) -> Any:
    """A value as JSON that keeps its kind: {"t": kind, "v": value}, bytes as hex."""
    kind = type_name(x)
    if kind == "array":
        return {"t": kind, "v": [tagged(v) for v in x]}
    if kind in ("dictionary", "stream"):
        d = x.dict if kind == "stream" else x
        return {"t": kind, "v": {k: tagged(v) for k, v in d.items()}}
    if kind == "string":
        return {"t": kind, "v": x.hex()}
    if kind == "reference":
        return {"t": kind, "v": {"num": x.num, "gen": x.gen}}
    return {"t": kind, "v": None if kind == "null" else x}


def nodes(x: Any, path: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(path, kind, i, d, s, b, ref) of a value and all that it holds."""
    kind = type_name(x)
    yield (
        list(path),
        kind,
        int(x) if kind in ("integer", "boolean") else None,
        float(x) if kind in ("integer", "real") else None,
        str(x) if kind in ("name", "identifier") else None,
        x if kind == "string" else x.data if kind == "stream" else None,
        {"num": x.num, "gen": x.gen} if kind == "reference" else None,
    )
    if kind == "array":
        for i, v in enumerate(x):
            yield from nodes(v, (*path, str(i)))
    elif kind in ("dictionary", "stream"):
        for k, v in (x.dict if kind == "stream" else x).items():
            yield from nodes(v, (*path, k))


def display_rows(x: Any, key: str = "", depth: int = 0) -> Iterator[tuple[int, str, str, str]]:
    """(depth, key, kind, shown) with the keys of dictionaries in order."""
    kind = type_name(x)
    shown = {
        "array": lambda: f"{len(x)} items",
        "dictionary": lambda: f"{len(x)} entries",
        "stream": lambda: f"{len(x.data)} bytes",
        "string": lambda: x.hex(),
        "reference": lambda: f"{x.num} {x.gen} R",
        "null": lambda: "null",
        "boolean": lambda: str(x).lower(),
    }.get(kind, lambda: str(x))()
    yield depth, key, kind, shown
    if kind == "array":
        for i, v in enumerate(x):
            yield from display_rows(v, str(i), depth + 1)
    elif kind in ("dictionary", "stream"):
        d = x.dict if kind == "stream" else x
        for k in sorted(d):
            yield from display_rows(d[k], k, depth + 1)
