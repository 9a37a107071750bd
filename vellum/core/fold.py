"""The per-page fold: operators to features (annotations, images, text) and to a display list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from .content import Op, operators
from .document import Document, Page
from .fonts import Font
from .geometry import Matrix, Rect, matrix_of
from .objects import Name, PdfError, Ref, Stream

ANNOTATIONS, IMAGES, TEXT = 1, 2, 4
MAX_FORMS = 64
TINY = 1e-6
_UNIT = Rect(0.0, 0.0, 1.0, 1.0)


@dataclass
class State:
    ctm: Matrix
    text: Matrix = Matrix()
    line: Matrix = Matrix()
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    size: float = 0.0
    rise: float = 0.0
    mode: int = 0
    font: Font | None = None
    font_ref: Ref | None = None
    # The display list's part.
    fill: tuple = ("DeviceGray", (0.0,))
    stroke: tuple = ("DeviceGray", (0.0,))
    width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: tuple = (0.0, ())
    flatness: float = 0.0
    intent: str | None = None
    gstate: dict = field(default_factory=dict)
    clips: int = 0


def copied(state: State) -> State:
    new = object.__new__(State)
    new.__dict__.update(state.__dict__)
    return new


@dataclass
class Feature:
    kind: str
    bounds: Rect
    matrix: Matrix = Matrix()
    annotation: tuple | None = None  # subtype, index, Ref or None
    image: tuple | None = None  # Ref or None, Stream
    text: tuple | None = None  # text, Ref or None, PostScript name, size


class Fold:
    """compat: character and word spacing as the literal behaviour has it (character spacing not read, word spacing times the size)."""

    def __init__(self, doc: Document, mask: int, compat: bool = False, boxes: bool = True):
        self.doc, self.mask, self.compat, self.boxes = doc, mask, compat, boxes  # without boxes nothing of text is measured
        self.fonts: dict[Any, Font | None] = {}
        self.spaces: dict[tuple[int, str], Any] = {}

    # ---- features -----------------------------------------------------------------------------------------------

    def page(self, page: Page) -> Iterator[Feature]:
        doc = self.doc
        if self.mask & ANNOTATIONS:
            for i, x in enumerate(doc.list_(page.dict.get("Annots")) or []):
                d = doc.dict_(x)
                rect = doc.rect_(d.get("Rect")) if d is not None else None
                if rect is not None:
                    yield Feature("annotation", rect, annotation=(doc.name_(d.get("Subtype")), i, x if isinstance(x, Ref) else None))
        if self.mask & (IMAGES | TEXT):
            data = b"".join(s.data for _, s in page.streams())
            yield from self.content(data, page.resources(not self.compat), Matrix(), ("page", *page.ref), ())

    def content(self, data: bytes, resources: dict, initial: Matrix, intent: tuple, inside: tuple) -> Iterator[Feature]:
        state, stack = State(initial), []
        try:
            for op in operators(data):
                if (act := _ACTS.get(op.op)) is not None:
                    act(self, state, op)
                elif op.op == "q":
                    stack.append(copied(state))
                elif op.op == "Q":
                    state = stack.pop() if stack else State(initial)
                elif op.op == "Tf":
                    self.set_font(state, op, resources)
                elif op.op in ("Tj", "'", '"'):
                    if op.op != "Tj":
                        if op.op == '"':
                            state.char_space, state.word_space = op.nums
                        _next_line(self, state, op)
                    if self.mask & TEXT and (f := self.show(state, op.data)):
                        yield f
                elif op.op == "TJ":
                    if f := self.show_all(state, op.tj):
                        yield f
                elif op.op == "Do":
                    yield from self.xobject(state, op.name, resources, inside)
        except PdfError as e:
            self.doc.fail(e, intent)

    def set_font(self, state: State, op: Op, resources: dict) -> None:
        state.size = op.nums[0]
        if not self.mask & TEXT:
            return
        entry = (self.doc.dict_(resources.get("Font")) or {}).get(op.name)
        d = self.doc.dict_(entry)
        state.font = state.font_ref = None
        if d is not None:
            state.font_ref = entry if isinstance(entry, Ref) else None
            key = state.font_ref or id(d)
            if key not in self.fonts:
                try:
                    self.fonts[key] = Font(self.doc, d)
                except PdfError as e:
                    self.doc.fail(e, ("font", *(state.font_ref or (None, None))))
                    self.fonts[key] = None
            state.font = self.fonts[key]

    def advance(self, state: State, data: bytes) -> float:
        """Width of a run for size 1."""
        h, size = state.scale / 100, max(state.size, TINY)
        if state.font is None:
            return len(data) * 0.6 * h
        tc, tw = (0.0, state.word_space) if self.compat else (state.char_space / size, state.word_space / size)
        wide, n, spaces = state.font.run(data)
        return (wide / 1000 + tc * n + tw * spaces) * h

    def show(self, state: State, data: bytes) -> Feature | None:
        if not self.boxes:
            return self.show_all(state, [(data, None)])
        size = max(state.size, TINY)
        m = Matrix(size, 0, 0, size).then(state.text).then(state.ctm)
        up, down = state.font.metrics() if state.font else (0.8, -0.2)
        wide = self.advance(state, data)
        box = m.box(Rect(0.0, down, max(wide, 0.0), max(up - down, 0.0)))
        font = state.font
        text = font.decode(data) if font else _plain(data)
        state.text = Matrix(tx=wide * size).then(state.text)
        if not text and wide <= 0:
            return None
        return Feature("text", box, m.orientation(), text=(text, state.font_ref, font.ps_name if font else None, state.size))

    def show_all(self, state: State, items: list) -> Feature | None:
        whole = None
        if not self.boxes:
            font = state.font
            shown = [data for data, _ in items if data is not None] if self.mask & TEXT else []
            text = "".join(map(font.decode if font else _plain, shown))
            if not text and all(self.advance(state, data) <= 0 for data in shown):
                return None
            return Feature("text", None, None, text=(text, state.font_ref, font.ps_name if font else None, state.size))
        for data, offset in items:
            if data is None:
                state.text = Matrix(tx=displacement(offset, state.size, state.scale)).then(state.text)
            elif self.mask & TEXT and (f := self.show(state, data)):
                if whole is None:
                    whole = f
                else:
                    whole.bounds = whole.bounds.union(f.bounds)
                    whole.text = (whole.text[0] + f.text[0], *whole.text[1:])
        return whole

    def xobject(self, state: State, name: str, resources: dict, inside: tuple) -> Iterator[Feature]:
        doc = self.doc
        entry = (doc.dict_(resources.get("XObject")) or {}).get(name)
        s = doc.stream_(entry)
        if s is None:
            return
        kind = doc.name_(s.dict.get("Subtype"))
        ref = entry if isinstance(entry, Ref) else None
        if kind == "Image":
            if self.mask & IMAGES:
                yield Feature("image", state.ctm.box(_UNIT), state.ctm.orientation(), image=(ref, s))
        elif kind == "Form" and s.id not in inside:
            if len(inside) >= MAX_FORMS:
                doc.fail(PdfError("nestedTooDeeply"), ("form", *(s.id or (None, None))))
                return
            m = matrix_of(doc.reals_(s.dict.get("Matrix"))) or Matrix()
            own = doc.dict_(s.dict.get("Resources"))
            yield from self.content(s.data, resources if own is None else own, m.then(state.ctm), ("form", *(s.id or (None, None))), (*inside, s.id))

    # ---- display list -------------------------------------------------------------------------------------------

    def display(self, page: Page) -> Iterator[tuple]:
        """(verb, path, ctm, colour space, colour, its red, green and blue, line width, alpha, blend, clip depth, text or object, cap, join, miter limit, dash, flatness, intent, soft mask) in drawing order; then annotations' appearances."""
        data = b"".join(s.data for _, s in page.streams())
        yield from self.draw(data, page.resources(), State(Matrix()), ("page", *page.ref), ())
        for x in self.doc.list_(page.dict.get("Annots")) or []:
            d = self.doc.dict_(x) or {}
            look = self.doc.resolve((self.doc.dict_(d.get("AP")) or {}).get("N"))
            if isinstance(look, dict):
                look = self.doc.resolve(look.get(self.doc.name_(d.get("AS")) or ""))
            rect = self.doc.rect_(d.get("Rect"))
            if isinstance(look, Stream) and rect is not None:
                m = matrix_of(self.doc.reals_(look.dict.get("Matrix"))) or Matrix()
                yield from self.draw(look.data, self.doc.dict_(look.dict.get("Resources")) or {}, State(appearance(self.doc.rect_(look.dict.get("BBox")), m, rect)), ("annotation", *(look.id or (None, None))), (look.id,))

    def draw(self, data: bytes, resources: dict, first: State, intent: tuple, inside: tuple) -> Iterator[tuple]:
        state, stack, path, at, start, clip, drawn = copied(first), [], [], None, None, None, False
        doc = self.doc

        def row(verb: str, paint: tuple, what: str | None = None) -> tuple:
            alpha = state.gstate.get("CA" if verb == "stroke" else "ca", 1.0)
            return verb, " ".join(path) if verb in ("fill", "eofill", "stroke", "clip", "eoclip") else None, state.ctm, str(paint[0]), list(paint[1]), self.rgb(paint, resources), state.width, float(alpha), state.gstate.get("BM", "Normal"), state.clips, what, state.cap, state.join, state.miter, float(state.dash[0]), list(state.dash[1]), state.flatness, state.intent, state.gstate.get("SMask")

        try:
            for op in operators(data):
                o, n = op.op, op.nums
                if (act := _ACTS.get(o)) is not None:
                    act(self, state, op)
                elif o == "q":
                    stack.append(copied(state))
                elif o == "Q":
                    state, clip = (stack.pop() if stack else copied(first)), None
                elif o == "Tf":
                    self.set_font(state, op, resources)
                elif o == "m":
                    path.append(_shown("m", *n))
                    at = start = (n[0], n[1])
                elif o in "lcvy" and at is not None:
                    if o == "v":
                        n = [*at, *n]
                    elif o == "y":
                        n = [*n, *n[2:]]
                    path.append(_shown("l" if o == "l" else "c", *n))
                    at, drawn = (n[-2], n[-1]), True
                elif o == "re":
                    x, y, w, h = n
                    left, low, right, top = map(_digits, (x, y, x + w, y + h))
                    path.append(f"m {left} {low} l {right} {low} l {right} {top} l {left} {top} h")
                    at, drawn = (x, y), True
                    start = at
                elif o == "h" and at is not None:
                    path.append("h")
                    at, drawn = start, True
                elif o in _PAINT:
                    if o in ("s", "b", "b*") and at is not None:
                        path.append("h")
                        drawn = True
                    for verb in _PAINT[o] if drawn else ():
                        yield row(verb, state.stroke if verb == "stroke" else state.fill)
                    if clip and drawn:
                        state.clips += 1
                        yield row(clip, state.fill)
                    path, at, clip, drawn = [], None, None, False
                elif o in ("W", "W*"):
                    clip = "clip" if o == "W" else "eoclip"
                elif o in ("Tj", "'", '"', "TJ"):
                    if o == '"':
                        state.char_space, state.word_space = n
                    if o in ("'", '"'):
                        _next_line(self, state, op)
                    f = self.show_all(state, op.tj) if o == "TJ" else self.show(state, op.data)
                    if f:
                        yield row(f"text{state.mode}", state.fill, f.text[0])
                elif o == "sh":
                    yield row("shading", state.fill, op.name)
                elif o == "Do":
                    entry = (doc.dict_(resources.get("XObject")) or {}).get(op.name)
                    s = doc.stream_(entry)
                    kind = doc.name_(s.dict.get("Subtype")) if s is not None else None
                    if kind == "Image":
                        yield row("stencil" if doc.bool_(s.dict.get("ImageMask")) else "image", state.fill, op.name)
                    elif kind == "Form" and s.id not in inside and len(inside) >= MAX_FORMS:
                        doc.fail(PdfError("nestedTooDeeply"), ("form", *(s.id or (None, None))))
                    elif kind == "Form" and s.id not in inside:
                        m = matrix_of(doc.reals_(s.dict.get("Matrix"))) or Matrix()
                        own = doc.dict_(s.dict.get("Resources"))
                        inner = replace(state, ctm=m.then(state.ctm), text=Matrix(), line=Matrix())
                        yield from self.draw(s.data, resources if own is None else own, inner, ("form", *(s.id or (None, None))), (*inside, s.id))
                elif o == "gs":
                    d = doc.dict_((doc.dict_(resources.get("ExtGState")) or {}).get(op.name))
                    if d is not None:
                        self.apply_gstate(state, d)
                elif o in _COLOURS:
                    stroke, space = _COLOURS[o]
                    paint = (space, tuple(n)) if space else (op.name, _initial(op.name)) if op.name else ((state.stroke if stroke else state.fill)[0], tuple(n))
                    if stroke:
                        state.stroke = paint
                    else:
                        state.fill = paint
        except PdfError as e:
            doc.fail(e, intent)

    def rgb(self, paint: tuple, resources: dict) -> list[float] | None:
        """None for patterns and for spaces that are not known."""
        key = (id(resources), paint[0])
        if key not in self.spaces:
            from .images import named_space

            self.spaces[key] = (named_space(self.doc, str(paint[0]), resources), resources)  # the dictionary stays alive, so its id does
        space = self.spaces[key][0]
        return space.rgb(list(paint[1])) if space is not None else None

    def apply_gstate(self, state: State, d: dict) -> None:
        g = ext_gstate(self.doc, d)
        state.gstate = state.gstate | {k: v for k, v in g.items() if v is not None}
        state.width, state.cap, state.join = (g[k] if g[k] is not None else old for k, old in (("LW", state.width), ("LC", state.cap), ("LJ", state.join)))
        state.miter = g["ML"] if g["ML"] is not None else state.miter
        state.flatness = g["FL"] if g["FL"] is not None else state.flatness
        state.intent = g["RI"] or state.intent
        state.dash = g["D"] or state.dash


def ext_gstate(doc: Document, d: dict) -> dict[str, Any]:
    """Graphics state parameters by key; the first of several blend modes counts."""
    bm = doc.resolve(d.get("BM"))
    if isinstance(bm, list):
        bm = doc.resolve(bm[0]) if bm else None
    dash = doc.list_(d.get("D"))
    out = {k: doc.real_(d.get(k)) for k in ("LW", "ML", "FL", "SM", "CA", "ca")}
    out |= {k: doc.int_(d.get(k)) for k in ("LC", "LJ", "OPM")}
    out |= {k: doc.bool_(d.get(k)) for k in ("OP", "op", "SA", "AIS", "TK")}
    out |= {"RI": doc.name_(d.get("RI")), "BM": str(bm) if isinstance(bm, Name) else None}
    out["D"] = (doc.real_(dash[1]) or 0.0, doc.reals_(dash[0]) or []) if dash and len(dash) == 2 else None
    smask = doc.resolve(d.get("SMask"))
    out["SMask"] = "None" if isinstance(smask, Name) else doc.name_(smask.get("S")) if isinstance(smask, dict) else None
    return out


def appearance(box: Rect | None, m: Matrix, rect: Rect) -> Matrix:
    """An appearance's space to the page: its matrix, then the fit of its transformed box to the annotation's rectangle."""
    if box is None:
        return m
    t = m.box(box)
    if not t.width or not t.height:
        return m
    sx, sy = rect.width / t.width, rect.height / t.height
    return m.then(Matrix(sx, 0, 0, sy, rect.x - t.x * sx, rect.y - t.y * sy))


def displacement(offset: float, size: float, scale: float) -> float:
    return -(offset / 1000) * size * (scale / 100)


def _shown(verb: str, *numbers: float) -> str:
    """A step of a path."""
    return " ".join([verb, *map(_digits, numbers)])


def _digits(v: float) -> str:
    """As many digits as tell a number from all others; whole ones without a point."""
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))


def _plain(data: bytes) -> str:
    from .text import pdf_text

    return pdf_text(data)


def _initial(space: str) -> tuple[float, ...]:
    return {"DeviceRGB": (0.0, 0.0, 0.0), "RGB": (0.0, 0.0, 0.0), "DeviceCMYK": (0.0, 0.0, 0.0, 1.0), "CMYK": (0.0, 0.0, 0.0, 1.0)}.get(space, (0.0,))


def _move(state: State, x: float, y: float) -> None:
    state.line = Matrix(tx=x, ty=y).then(state.line)
    state.text = state.line


def _next_line(fold: Fold, state: State, op: Op) -> None:
    _move(state, 0.0, -state.leading)


def _begin(fold, state, op):
    state.text = state.line = Matrix()


def _concat(fold, state, op):
    state.ctm = Matrix(*op.nums).then(state.ctm)


def _td(fold, state, op):
    _move(state, *op.nums)


def _td_leading(fold, state, op):
    state.leading = -op.nums[1]
    _move(state, *op.nums)


def _tm(fold, state, op):
    state.text = state.line = Matrix(*op.nums)


def _sets(name, kind=float):
    def act(fold, state, op):
        setattr(state, name, kind(op.nums[0]))

    return act


def _dash(fold, state, op):
    state.dash = (op.nums[0], tuple(op.nums[1:]))


def _intent(fold, state, op):
    state.intent = op.name


_ACTS = {
    "BT": _begin, "cm": _concat, "Td": _td, "TD": _td_leading, "Tm": _tm, "T*": _next_line, "Tc": _sets("char_space"), "Tw": _sets("word_space"),
    "Tz": _sets("scale"), "TL": _sets("leading"), "Ts": _sets("rise"), "Tr": _sets("mode", int), "w": _sets("width"), "J": _sets("cap", int),
    "j": _sets("join", int), "M": _sets("miter"), "i": _sets("flatness"), "d": _dash, "ri": _intent,
}
_PAINT = {
    "S": ("stroke",), "s": ("stroke",), "f": ("fill",), "F": ("fill",), "f*": ("eofill",), "B": ("fill", "stroke"), "B*": ("eofill", "stroke"),
    "b": ("fill", "stroke"), "b*": ("eofill", "stroke"), "n": (),
}
#: (strokes?, space that it selects)
_COLOURS = {
    "G": (True, "DeviceGray"), "g": (False, "DeviceGray"), "RG": (True, "DeviceRGB"), "rg": (False, "DeviceRGB"), "K": (True, "DeviceCMYK"),
    "k": (False, "DeviceCMYK"), "CS": (True, None), "cs": (False, None), "SC": (True, None), "sc": (False, None), "SCN": (True, None), "scn": (False, None),
}
