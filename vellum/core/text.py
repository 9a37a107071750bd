"""Text strings: UTF-16 and UTF-8 by their marks, else the format's own 8-bit encoding."""

from __future__ import annotations

import re

#: Where that encoding is not Latin-1 (0x18-0x1F, 0x80-0x9E, 0xA0).
PDF_DOC = {
    0x18: 0x02D8, 0x19: 0x02C7, 0x1A: 0x02C6, 0x1B: 0x02D9, 0x1C: 0x02DD, 0x1D: 0x02DB, 0x1E: 0x02DA, 0x1F: 0x02DC,
    0x80: 0x2022, 0x81: 0x2020, 0x82: 0x2021, 0x83: 0x2026, 0x84: 0x2014, 0x85: 0x2013, 0x86: 0x0192, 0x87: 0x2044,
    0x88: 0x2039, 0x89: 0x203A, 0x8A: 0x2212, 0x8B: 0x2030, 0x8C: 0x201E, 0x8D: 0x201C, 0x8E: 0x201D, 0x8F: 0x2018,
    0x90: 0x2019, 0x91: 0x201A, 0x92: 0x2122, 0x93: 0xFB01, 0x94: 0xFB02, 0x95: 0x0141, 0x96: 0x0152, 0x97: 0x0160,
    0x98: 0x0178, 0x99: 0x017D, 0x9A: 0x0131, 0x9B: 0x0142, 0x9C: 0x0153, 0x9D: 0x0161, 0x9E: 0x017E, 0xA0: 0x20A2,
}
_OWN = re.compile(rb"[\x18-\x1f\x80-\xa0]")
_DECODE = str.maketrans({chr(k): chr(v) for k, v in PDF_DOC.items()})
_ENCODE = {chr(v): k for k, v in PDF_DOC.items()}


def pdf_text(b: bytes) -> str:
    if b[:2] == b"\xfe\xff":
        return b[2:].decode("utf-16-be", "replace")
    if b[:2] == b"\xff\xfe":
        return b[2:].decode("utf-16-le", "replace")
    if b[:3] == b"\xef\xbb\xbf":
        return b[3:].decode("utf-8", "replace")
    text = b.decode("latin-1")
    return text.translate(_DECODE) if _OWN.search(b) else text


def pdf_doc_bytes(text: str) -> bytes:
    """The inverse; characters that it lacks become X."""
    return bytes(_ENCODE.get(c, ord(c) if ord(c) < 256 and ord(c) not in PDF_DOC else 88) for c in text)
