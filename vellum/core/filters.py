"""Stream filters: Flate with predictors; image codecs pass through; the rest are named as unsupported or unknown."""

from __future__ import annotations

import zlib

import numpy as np

from .objects import PdfError

IMAGE_CODECS = {"DCTDecode": "jpeg", "DCT": "jpeg", "JPXDecode": "jpeg2000", "JBIG2Decode": "jbig2"}
UNSUPPORTED = frozenset("ASCII85Decode ASCIIHexDecode CCITTFaxDecode LZWDecode RunLengthDecode A85 AHx CCF LZW RL Fl-".split()) - {"Fl-"}


def inflate(data: bytes) -> bytes:
    """zlib or gzip by its header, else raw deflate; a broken tail keeps what came before it."""
    for wbits, raw in ((47, data), (-15, data[2:] if len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0 else data)):
        d, out = zlib.decompressobj(wbits), bytearray()
        try:
            out += d.decompress(raw)
            return bytes(out + d.flush())
        except zlib.error:
            d, out = zlib.decompressobj(wbits), bytearray()
            try:  # byte by byte as far as it goes
                for at in range(0, len(raw), 256):
                    out += d.decompress(raw[at : at + 256])
            except zlib.error:
                pass
            if out:
                return bytes(out)
    raise PdfError("decodeFailed")


def undo_predictor(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    if predictor == 2:
        return _tiff(data, colors, bits, columns)
    if 10 <= predictor <= 15:
        return _png(data, colors, bits, columns)
    return data


def _tiff(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    width = colors * columns
    if bits != 8 or width <= 0:
        return data
    n = len(data) // width * width
    rows = np.frombuffer(data[:n], np.uint8).reshape(-1, columns, colors)
    return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[n:]


def _png(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    n = len(data) // (width + 1)
    rows = np.frombuffer(data[: n * (width + 1)], np.uint8).reshape(n, width + 1)
    out, above = np.zeros((n, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(n):
        tag, row = rows[y, 0], rows[y, 1:]
        if tag == 2:
            now = row + above
        elif tag == 1:
            pad = -width % step
            now = np.cumsum(np.pad(row, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif tag in (3, 4):
            now = np.frombuffer(_running(row.tolist(), above.tolist(), step, int(tag)), np.uint8)
        else:
            now = row
        out[y] = above = now
    return out.tobytes()


def _running(row: list[int], above: list[int], step: int, tag: int) -> bytes:
    """Average and Paeth lean on bytes that they themselves made."""
    out = [0] * len(row)
    for x, v in enumerate(row):
        a, b, c = (out[x - step], above[x], above[x - step]) if x >= step else (0, above[x], 0)
        if tag == 3:
            guess = (a + b) >> 1
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[x] = (v + guess) & 255
    return bytes(out)


def decode(data: bytes, names: list[str], params: list[dict], is_image: bool, decrypt_named=None) -> tuple[bytes, list[str]]:
    """(bytes, codecs left to the reader of an image)."""
    pending: list[str] = []
    for i, name in enumerate(names):
        p = params[i] if i < len(params) else {}
        if name in ("FlateDecode", "Fl"):
            data = inflate(data)
            if predictor := p.get("Predictor", 1):
                data = undo_predictor(data, predictor, p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
        elif name == "Crypt":
            data = decrypt_named(p.get("Name"), data) if decrypt_named else data
        elif name in IMAGE_CODECS:
            if not is_image:
                raise PdfError("unsupportedFilter")
            pending.append(name)
        elif name in UNSUPPORTED:
            raise PdfError("unsupportedFilter")
        else:
            raise PdfError("unknownFilter")
    return data, pending
