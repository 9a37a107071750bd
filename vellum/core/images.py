"""Colour spaces, image metadata, raw pixels and shadings."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np

from . import functions
from .filters import IMAGE_CODECS
from .objects import Name, Stream

#: Fixed by the format: device spaces, their short names in inline images, and components.
DEVICE = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}
SHORT = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK"}


@dataclass
class Space:
    kind: str
    components: int
    base: "Space | None" = None
    names: tuple[str, ...] = ()
    tint: Any = None
    high: int = 0
    table: bytes = b""

    @property
    def is_cmyk(self) -> bool:
        if self.kind == "Indexed":
            return self.base.is_cmyk
        return self.kind == "DeviceCMYK" or self.kind == "ICCBased" and self.components == 4

    def structure(self) -> str:
        """Equal for equal spaces."""
        return "/".join([self.kind, str(self.components), *self.names, str(self.high), self.table.hex(), repr(self.tint) if self.tint else "", self.base.structure() if self.base else ""])

    def rgb(self, values: list[float]) -> list[float]:
        """Red, green, blue in [0, 1]; ICC profiles count as the device space of as many components."""
        v = [min(1.0, max(0.0, x)) for x in values]
        if self.kind == "Indexed":
            i, n = min(self.high, max(0, int(values[0] if values else 0))), self.base.components
            return self.base.rgb([b / 255 for b in self.table[i * n : i * n + n].ljust(n, b"\0")])
        if self.kind in ("Separation", "DeviceN"):
            out = functions.evaluate(self.tint, v) if self.tint else None
            return self.base.rgb(out) if out is not None else [0.0, 0.0, 0.0]
        if self.components == 1:
            return [v[0] if v else 0.0] * 3
        if self.components == 4:
            c, m, y, k = (*v, 0.0, 0.0, 0.0, 0.0)[:4]
            return [(1 - min(1.0, x + k)) for x in (c, m, y)]
        return [*v, 0.0, 0.0, 0.0][:3]


def color_space(doc, x, depth: int = 8) -> Space | None:
    x = doc.resolve(x)
    if isinstance(x, Name):
        name = SHORT.get(x, str(x))
        return Space(name, DEVICE[name]) if name in DEVICE else None
    if not isinstance(x, list) or not x or not depth:
        return None
    kind = doc.name_(x[0])
    if kind is not None and (kind in DEVICE or kind in SHORT):
        return color_space(doc, x[0])
    if kind in ("Separation", "DeviceN") and len(x) >= 4:
        names = tuple(n for n in map(doc.name_, doc.list_(x[1]) or [x[1]]) if n is not None)
        base, tint = color_space(doc, x[2], depth - 1), functions.parse(doc, x[3])
        return None if base is None or tint is None else Space(kind, len(names) if kind == "DeviceN" else 1, base, names, tint)
    if kind in ("Indexed", "I") and len(x) >= 4:
        base, high, table = color_space(doc, x[1], depth - 1), doc.int_(x[2]), doc.resolve(x[3])
        table = table.data if isinstance(table, Stream) else table
        return Space("Indexed", 1, base, high=high, table=table) if base is not None and high is not None and isinstance(table, bytes) else None
    if kind == "ICCBased" and len(x) >= 2:
        s = doc.stream_(x[1])
        if s is None:
            return None
        n = doc.int_(s.dict.get("N"))
        return Space(kind, 3 if n is None else n, color_space(doc, s.dict.get("Alternate"), depth - 1))
    return None


#: Fixed by the format: resources that stand in for the device spaces.
DEFAULTS = {"DeviceGray": "DefaultGray", "DeviceRGB": "DefaultRGB", "DeviceCMYK": "DefaultCMYK"}


def named_space(doc, name: str, resources: dict) -> Space | None:
    """A space by its name in a content stream: a device's stand-in, the device, or a resource that is an array."""
    entries = doc.dict_(resources.get("ColorSpace")) or {}
    name = SHORT.get(name, name)
    if name in DEVICE:
        own = doc.list_(entries.get(DEFAULTS[name]))
        return (color_space(doc, own) if own is not None else None) or Space(name, DEVICE[name])
    own = doc.list_(entries.get(name))
    return color_space(doc, own) if own is not None else None


@dataclass
class Image:
    width: int
    height: int
    bits: int
    mask: bool
    encoding: str
    space: Space
    decode: list[float] | None
    interpolate: bool
    intent: str | None
    smask: Stream | None
    matte: list[float] | None


def image_of(doc, s: Stream) -> Image | None:
    d = s.dict
    w, h = doc.int_(d.get("Width")), doc.int_(d.get("Height"))
    if w is None or h is None:
        return None
    mask = doc.bool_(d.get("ImageMask")) or False
    bits = 1 if mask else doc.int_(d.get("BitsPerComponent")) or 8
    space = Space("DeviceGray", 1) if mask else color_space(doc, d.get("ColorSpace")) or Space("DeviceRGB", 3)
    soft = doc.stream_(d.get("SMask"))
    return Image(w, h, bits, mask, next((IMAGE_CODECS[x] for x in s.pending), "raw"), space, doc.reals_(d.get("Decode")), doc.bool_(d.get("Interpolate")) or False, doc.name_(d.get("Intent")), soft, doc.reals_(soft.dict.get("Matte")) if soft is not None else None)


def pixels(i: Image, data: bytes) -> np.ndarray | None:
    """height x width x components of a raw image; rows begin on whole bytes, missing bytes are 0."""
    if i.encoding != "raw" or i.bits not in (1, 2, 4, 8, 16) or i.width <= 0 or i.height <= 0:
        return None
    n = i.space.components
    row = (i.width * i.bits * n + 7) // 8
    raw = np.frombuffer(data[: row * i.height].ljust(row * i.height, b"\0"), np.uint8).reshape(i.height, row)
    if i.bits == 8:
        out = raw
    elif i.bits == 16:
        out = raw.reshape(i.height, -1, 2).astype(np.int32) @ np.array([256, 1])
    else:
        out = np.unpackbits(raw, axis=1).reshape(i.height, -1, i.bits) @ (1 << np.arange(i.bits - 1, -1, -1))
    return out[:, : i.width * n].reshape(i.height, i.width, n).astype(np.int32)


def rgba(doc, s: Stream) -> np.ndarray | None:
    """height x width x (red, green, blue, alpha) of a raw image, 0 to 255.

    Alpha comes from the soft mask (scaled to the image by its nearest samples; what was blended with a matte colour is
    undone), else from an explicit mask or a range of colours that are masked out. A stencil is black where it paints.
    """
    i = image_of(doc, s)
    px = pixels(i, s.data) if i is not None else None
    if px is None:
        return None
    alpha = np.ones(px.shape[:2])
    if i.mask:
        return _bytes(np.zeros((*px.shape[:2], 3)), 1 - _decoded(i, px)[:, :, 0])
    colour = _colours(i.space, _decoded(i, px))
    masked = doc.resolve(s.dict.get("Mask"))
    if i.smask is not None:
        soft = image_of(doc, i.smask)
        level = pixels(soft, i.smask.data) if soft is not None else None
        if level is not None:
            alpha = _scaled(np.clip(_decoded(soft, level)[:, :, 0], 0, 1), alpha.shape)
            if i.matte and len(i.matte) == i.space.components:
                matte = np.array(i.space.rgb(i.matte))
                colour = np.where(alpha[:, :, None] > 0, matte + (colour - matte) / np.where(alpha > 0, alpha, 1)[:, :, None], matte)
    elif isinstance(masked, Stream):
        shape = image_of(doc, masked)
        level = pixels(shape, masked.data) if shape is not None and shape.mask else None
        if level is not None:
            alpha = _scaled(1 - _decoded(shape, level)[:, :, 0], alpha.shape)
    elif isinstance(masked, list) and len(ranges := doc.reals_(masked)) == 2 * px.shape[2]:
        out = (px >= np.array(ranges[::2])) & (px <= np.array(ranges[1::2]))
        alpha = np.where(out.all(axis=2), 0.0, 1.0)
    return _bytes(colour, alpha)


def _bytes(colour: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.concatenate([colour, alpha[:, :, None]], axis=2), 0, 1) * 255 + 0.5).astype(np.int32)


def _decoded(i: Image, px: np.ndarray) -> np.ndarray:
    n, top = px.shape[2], (1 << i.bits) - 1
    d = i.decode if i.decode and len(i.decode) == 2 * n else [0, top if i.space.kind == "Indexed" else 1] * n
    low, high = np.array(d[::2], float), np.array(d[1::2], float)
    return low + px * (high - low) / top


def _colours(space: Space, values: np.ndarray) -> np.ndarray:
    """Each distinct colour meets the space once."""
    flat, back = np.unique(values.reshape(-1, values.shape[2]), axis=0, return_inverse=True)
    return np.array([space.rgb(list(v)) for v in flat])[back.reshape(-1)].reshape(*values.shape[:2], 3)


def _scaled(level: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    y, x = (((np.arange(n) + 0.5) * have / n).astype(int) for n, have in zip(shape, level.shape, strict=True))
    return level[np.ix_(y, x)]


@dataclass
class Shading:
    kind: int
    space: Space
    coords: list[float]
    domain: list[float]
    extend: list[bool]
    background: list[float] | None
    function: Any

    def colour(self, t: float) -> list[float]:
        out = functions.evaluate(self.function, [t]) or []
        return [*out, *[0.0] * self.space.components][: self.space.components]


def shading_of(doc, x) -> Shading | None:
    d = doc.dict_(x)
    kind = doc.int_(d.get("ShadingType")) if d else None
    space = color_space(doc, d.get("ColorSpace")) if d else None
    coords, f = (doc.reals_(d.get("Coords")), functions.parse(doc, d.get("Function"))) if d else (None, None)
    if kind not in (2, 3) or space is None or f is None or coords is None or len(coords) != {2: 4, 3: 6}[kind]:
        return None
    extend = [bool(doc.bool_(v)) for v in doc.list_(d.get("Extend")) or []]
    return Shading(kind, space, coords, doc.reals_(d.get("Domain")) or [0.0, 1.0], extend if len(extend) == 2 else [False, False], doc.reals_(d.get("Background")), f)
