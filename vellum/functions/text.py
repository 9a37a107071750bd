"""Text strings of documents as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.core.text import PDF_DOC

_FROM, _TO = "".join(map(chr, PDF_DOC)), "".join(map(chr, PDF_DOC.values()))


def pdf_text(b: Column) -> Column:
    """BINARY to STRING: UTF-16 or UTF-8 by its mark, else the 8-bit encoding of the format."""
    mark2, mark3 = F.substring(b, 1, 2), F.substring(b, 1, 3)
    return (
        F.when(mark2 == F.lit(b"\xfe\xff"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16BE"))
        .when(mark2 == F.lit(b"\xff\xfe"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16LE"))
        .when(mark3 == F.lit(b"\xef\xbb\xbf"), F.decode(F.substring(b, 4, 1 << 30), "UTF-8"))
        .otherwise(F.translate(F.decode(b, "ISO-8859-1"), _FROM, _TO))
    )


def pdf_doc_bytes(text: Column) -> Column:
    """STRING to BINARY; characters that the encoding lacks become X. Plain ASCII, and texts of what it has, skip the steps they need not."""
    have = "".join(chr(c) for c in range(256) if c not in PDF_DOC)
    klass = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in have + _TO) + "]"
    own = F.when(text.rlike(klass), F.regexp_replace(text, klass, "X")).otherwise(text)
    return F.encode(F.when(text.rlike(r"[^\x00-\x17\x20-\x7F]"), F.translate(own, _TO, _FROM)).otherwise(text), "ISO-8859-1")


def big_endian(b: Column) -> Column:
    return F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
