"""Rectangles and affine matrices of one document's fold; their Column forms are in vellum.functions.geometry."""

from __future__ import annotations

from math import hypot
from typing import NamedTuple


class Rect(NamedTuple):
    x: float
    y: float
    width: float
    height: float

    def intersection(self, o: "Rect") -> "Rect | None":
        x, y = max(self.x, o.x), max(self.y, o.y)
        w, h = min(self.x + self.width, o.x + o.width) - x, min(self.y + self.height, o.y + o.height) - y
        return Rect(x, y, w, h) if w > 0 and h > 0 else None

    def union(self, o: "Rect") -> "Rect":
        x, y = min(self.x, o.x), min(self.y, o.y)
        return Rect(x, y, max(self.x + self.width, o.x + o.width) - x, max(self.y + self.height, o.y + o.height) - y)


def rect_of(v: list) -> Rect | None:
    if len(v) != 4:
        return None
    a, b, c, d = (float(x or 0) for x in v)
    return Rect(min(a, c), min(b, d), abs(c - a), abs(d - b))


class Matrix(NamedTuple):
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    tx: float = 0.0
    ty: float = 0.0

    def then(self, m: "Matrix") -> "Matrix":
        """self first, then m."""
        return Matrix(
            self.a * m.a + self.b * m.c,
            self.a * m.b + self.b * m.d,
            self.c * m.a + self.d * m.c,
            self.c * m.b + self.d * m.d,
            self.tx * m.a + self.ty * m.c + m.tx,
            self.tx * m.b + self.ty * m.d + m.ty,
        )

    def box(self, r: Rect) -> Rect:
        xs = [self.a * x + self.c * y + self.tx for x in (r.x, r.x + r.width) for y in (r.y, r.y + r.height)]
        ys = [self.b * x + self.d * y + self.ty for x in (r.x, r.x + r.width) for y in (r.y, r.y + r.height)]
        return Rect(min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))

    def orientation(self) -> "Matrix":
        """Rows of unit length, without the shift; the identity where a row has none or all is near it."""
        u, v = hypot(self.a, self.b), hypot(self.c, self.d)
        if not u or not v:
            return Matrix()
        m = Matrix(self.a / u, self.b / u, self.c / v, self.d / v)
        return Matrix() if all(abs(p - q) < 1e-6 for p, q in zip(m, Matrix(), strict=True)) else m


def matrix_of(v: list | None) -> Matrix | None:
    return Matrix(*(float(x or 0) for x in v)) if v is not None and len(v) == 6 else None
