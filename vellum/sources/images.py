"""Images of documents as files: compressed ones as they are, raw ones as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.plans.tables import Engine, _globals, flat

#: What makes segments a file of their own: the format's mark, segments in a row, one page.
JBIG2_HEAD = b"\x97JB2\r\n\x1a\n" + b"\x01" + (1).to_bytes(4, "big")
SCHEMA = "doc_id bigint, num bigint, gen bigint, extension string, file binary"


def png(rows: np.ndarray) -> bytes:
    """height x width x 1 or 3 bytes."""
    h, w, n = rows.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _files(doc):
    from vellum.core.images import image_of, pixels
    from vellum.core.objects import Stream

    for ref, revision, x in doc.objects():
        if revision or not isinstance(x, Stream) or doc.name_(x.dict.get("Subtype")) != "Image" or (i := image_of(doc, x)) is None:
            continue
        if i.encoding in ("jpeg", "jpeg2000"):
            yield *ref, "jpg" if i.encoding == "jpeg" else "jp2", x.data
        elif i.encoding == "jbig2":
            yield *ref, "jb2", JBIG2_HEAD + (_globals(doc, x) or b"") + x.data
        elif (px := pixels(i, x.data)) is not None:
            top = (1 << i.bits) - 1
            if i.space.kind in ("DeviceGray", "DeviceRGB"):
                out = px * 255 // top
            else:
                scale = 1 if i.space.kind == "Indexed" else top
                colours = {v: [round(c * 255) for c in i.space.rgb([t / scale for t in v])] for v in set(map(tuple, px.reshape(-1, px.shape[2]).tolist()))}
                out = np.array([colours[tuple(v)] for v in px.reshape(-1, px.shape[2]).tolist()], np.uint8).reshape(i.height, i.width, 3)
            yield *ref, "png", png(out)


def image_files(engine: Engine) -> DataFrame:
    """(doc_id, num, gen, extension, file) of every image that needs no codec that is not here."""
    return flat(engine.docs, SCHEMA, _files)


def write_images(engine: Engine, path: str) -> None:
    image_files(engine).withColumn("name", F.concat_ws("-", "doc_id", "num", "gen")).write.mode("errorifexists").partitionBy("extension").parquet(path)
