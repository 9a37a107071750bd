"""The tables of a collection of documents.

Each table is one narrow pass over the documents (mapInArrow): a row of bytes in, rows of the table out in small batches,
no shuffle.  A document never fails its task: what could be read is there, and parse_errors has the rest.  What Catalyst
cannot push into Python is an argument: columns for every table, and which features, operators, objects or pages.  bundle()
reads a document once for several tables.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vellum.functions.geometry import MATRIX, RECT
from vellum.plans.cut import joined_by_shuffle

BATCH = 2048
#: Rows that a task holds as Python objects come of so many bytes of files at most, or of one file.
HELD = 1 << 20
REF = "struct<num:bigint,gen:bigint>"
SCHEMAS: dict[str, str] = {
    "headers": "type string, version string, xref_start bigint, xref_end bigint, recovered boolean, encrypted boolean",
    "trailers": "section_ord int, trailer string",
    "xref_entries": "section_ord int, num bigint, gen bigint, kind string, offset bigint, stm_num bigint, stm_index bigint",
    "xref_sections": "at bigint, prev bigint, hybrid bigint, entries array<struct<num:bigint,gen:bigint,kind:string,offset:bigint,stm_num:bigint,stm_index:bigint>>",
    "object_layouts": "num bigint, gen bigint, revision int, storage struct<kind:string,start:bigint,end:bigint,stm_num:bigint,stm_index:bigint>",
    "objects": f"num bigint, gen bigint, revision int, kind string, value string, data binary, ref {REF}",
    "object_nodes": f"num bigint, gen bigint, revision int, path array<string>, kind string, i bigint, d double, s string, b binary, ref {REF}",
    "objects_at": "start bigint, num bigint, gen bigint, kind string, value string, i bigint",
    "object_rows": "num bigint, gen bigint, row int, depth int, key string, kind string, shown string",
    "pages": f"page_index int, num bigint, gen bigint, path array<int>, crop {RECT}, media {RECT}, above {RECT}, rotation int, dict string",
    "content_streams": "page_index int, ord int, num bigint, gen bigint, data binary",
    "resources": f"page_index int, category string, key string, ref {REF}, kind string",
    "operators": "page_index int, seq int, op string, nums array<double>, name string, bytes binary, tj array<struct<text:binary,offset:double>>, props string",
    "stream_operators": "page_index int, num bigint, gen bigint, seq int, op string, nums array<double>, name string",
    "xobjects": f"page_index int, num bigint, gen bigint, key string, ref {REF}, target {REF}, kind string",
    "forms": f"num bigint, gen bigint, matrix {MATRIX}, own boolean",
    "features": f"page_index int, seq int, kind string, bounds {RECT}, matrix {MATRIX}, annotation struct<type:string,idx:int,num:bigint,gen:bigint>, image struct<num:bigint,gen:bigint,encoding:string,data:binary>, text struct<text:string,font_num:bigint,font_gen:bigint,ps_name:string,size:double>",
    "text_runs": "page_index int, seq int, part int, text string, x double, y double, width double, height double, size double",
    "glyph_runs": "page_index int, seq int, pos int, font_num bigint, code bigint, gid bigint, glyph string, x double, y double, advance double",
    "vertical_metrics": "num bigint, gen bigint, pos int, lo bigint, hi bigint, advance double, x double, y double, default_y double, default_advance double",
    "display_list": f"page_index int, seq int, verb string, path string, ctm {MATRIX}, space string, colour array<double>, rgb array<double>, line_width double, alpha double, blend string, clips int, what string, line_cap int, line_join int, miter double, dash_phase double, dash array<double>, flatness double, intent string, smask string",
    "fonts": f"num bigint, gen bigint, subtype string, base_font string, ps_name string, encoding string, ascent double, descent double, cap_height double, italic double, bbox {RECT}, matrix {MATRIX}, vertical boolean, up double, down double",
    "font_widths": "num bigint, gen bigint, code int, width double",
    "font_differences": "num bigint, gen bigint, code int, glyph string",
    "cid_widths": "num bigint, gen bigint, pos int, lo bigint, hi bigint, width double, default_width double",
    "tounicode_mappings": "num bigint, gen bigint, pos int, lo bigint, hi bigint, text string",
    "codespaces": "num bigint, gen bigint, of string, pos int, bytes int, lo bigint, hi bigint",
    "images": "num bigint, gen bigint, width bigint, height bigint, bits int, mask boolean, encoding string, space string, components int, decode array<double>, interpolate boolean, intent string, has_smask boolean, matte array<double>, data binary, jbig2_globals binary",
    "image_pixels": "num bigint, gen bigint, y int, values array<int>",
    "image_rgba": "num bigint, gen bigint, y int, values array<int>",
    "color_spaces": "page_index int, key string, kind string, components int, is_cmyk boolean, base string, structure string",
    "ext_gstates": "page_index int, key string, line_width double, line_cap int, line_join int, miter double, dash_phase double, dash array<double>, intent string, overprint_stroke boolean, overprint_fill boolean, overprint_mode int, flatness double, smoothness double, stroke_adjust boolean, blend string, smask string, stroke_alpha double, fill_alpha double, alpha_is_shape boolean, text_knockout boolean",
    "soft_masks": f"page_index int, key string, kind string, ref {REF}, bbox {RECT}, matrix {MATRIX}, space string, isolated boolean, knockout boolean, backdrop array<double>, transfer string, samples array<double>",
    "shadings": "page_index int, key string, type int, space string, coords array<double>, domain array<double>, extend array<boolean>, background array<double>, samples array<array<double>>",
    "functions": "num bigint, gen bigint, kind string, domain array<double>, range array<double>, outputs int, at_low array<double>, at_middle array<double>, at_high array<double>",
    "parse_errors": "failure string, start bigint, end bigint, intent struct<kind:string,num:bigint,gen:bigint>",
}


class Engine:
    """docs: doc_id bigint, content binary and, optionally, password string."""

    def __init__(self, docs: DataFrame, password: str | None = None, compat: bool = False):
        p = F.col("password") if "password" in docs.columns else F.lit(password).cast("string")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content"), p.alias("password"))
        self.compat = compat

    def _reader(self, name: str, args: dict, columns: tuple[str, ...] | None = None) -> Callable[..., Iterator[tuple]]:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name == "features" and columns is not None and not {"bounds", "matrix"} & set(columns):
            args = {"boxes": False, **args}
        own = {"compat": self.compat} if name in ("features", "text_runs", "glyph_runs", "display_list", "parse_errors") else {}
        return partial(_ROWS[name], **own, **args)

    def table(self, name: str, columns: tuple[str, ...] | None = None, **args) -> DataFrame:
        """A table: of its columns only those named leave Python; args say which of its rows are made at all."""
        rows, schema = self._reader(name, args, columns), SCHEMAS[name]
        if columns is None:
            return flat(self.docs, f"doc_id bigint, {schema}", rows)
        fields, at = _chosen(schema, columns)
        return flat(self.docs, f"doc_id bigint, {fields}", lambda doc: map(at, rows(doc)))

    def bundle(self, **tables: dict) -> DataFrame:
        """doc_id and, for each table named, an array of its rows: one reading of the document for all of them.

        tables: name=args of table(), columns among them. A row holds what was asked for of a whole document.
        """
        parts = []
        for name, args in tables.items():
            columns = args.get("columns") or tuple(f.name for f in StructType.fromDDL(SCHEMAS[name]))
            fields, at = _chosen(SCHEMAS[name], columns)
            parts.append((name, columns, fields, at, self._reader(name, {k: v for k, v in args.items() if k != "columns"}, columns)))

        def rows(doc):
            yield tuple([dict(zip(columns, at(r), strict=True)) for r in read(doc)] for _, columns, _, at, read in parts)

        struct = StructType([StructField("doc_id", LongType()), *(StructField(n, ArrayType(StructType.fromDDL(f))) for n, _, f, _, _ in parts)])
        return flat(self.docs, struct, rows)

    def features(self, kinds: tuple[str, ...] = ("annotation", "image", "text")) -> DataFrame:
        """Only what is asked for is computed: without text no font is parsed, with annotations alone no content."""
        mask = sum({"annotation": 1, "image": 2, "text": 4}[k] for k in set(kinds))
        return self.table("features", mask=mask)

    def register(self, prefix: str = "pdf_") -> None:
        """Every table as a view."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)


def _chosen(schema: str, columns: tuple[str, ...]) -> tuple[str, Callable[[tuple], tuple]]:
    """(the columns' part of a schema, what takes them from a row)."""
    all_ = StructType.fromDDL(schema)
    at = [all_.names.index(c) for c in columns]
    return ", ".join(f"{c} {all_[c].dataType.simpleString()}" for c in columns), itemgetter(*at) if len(at) > 1 else lambda row: (row[at[0]],)


def slices(batch, most: int = 256) -> Iterator:
    """An Arrow batch in parts of so many rows, and about HELD bytes, at most; a row that is larger is a part."""
    n = max(1, min(most, HELD * batch.num_rows // max(1, batch.nbytes)))
    yield from (batch.slice(k, n) for k in range(0, batch.num_rows, n))


def flat(docs: DataFrame, schema: str | StructType, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """rows(document), which begin with doc_id, as a table: a narrow pass, joined by shuffles."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa

        from vellum.core.document import Document

        arrow = to_arrow_schema(struct)
        held: list[tuple] = []
        size = 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc_id, content, password in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = content.as_py()
                doc = Document(b"" if data is None else data, password)
                for row in rows(doc):
                    held.append((doc_id, *row))
                    if len(held) >= BATCH:
                        yield batch_of()
                        held.clear()
                        size = 0
                size += len(doc.data)
                if held and size >= HELD:
                    yield batch_of()
                    held.clear()
                    size = 0
        if held:
            yield batch_of()

    return joined_by_shuffle(docs.mapInArrow(run, struct))


# ---- rows of each table ---------------------------------------------------------------------------------------------


def _dict(t) -> dict | None:
    return None if t is None else t._asdict()


def _ref(x) -> dict | None:
    from vellum.core.objects import Ref

    return {"num": x.num, "gen": x.gen} if isinstance(x, Ref) else None


def _json(x) -> str:
    from vellum.core.document import tagged

    return json.dumps(tagged(x), ensure_ascii=False)


def _headers(doc):
    if doc.header:
        yield *doc.header, *doc.xref_range, doc.recovered, doc.security is not None


def _trailers(doc):
    for k, s in enumerate(doc.sections):
        yield k, _json(s["trailer"])


def _xref_sections(doc):
    """Sections with what they say of their place; a hybrid's own prev leads nowhere."""
    for k, s in enumerate(doc.sections):
        link = {key: x if isinstance(x := s["trailer"].get(key), int) and not s.get("hybrid") and not doc.recovered else None for key in ("Prev", "XRefStm")}
        keys = ("num", "gen", "kind", "offset", "stm_num", "stm_index")
        own = [dict(zip(keys, e[1:], strict=True)) for e in doc.xref_entries(k)]
        yield s["at"], link["Prev"], link["XRefStm"], own


def _objects_at(doc, nums: tuple[int, ...] | None = None):
    """Every object at an offset of the file, by that offset."""
    from vellum.core.document import type_name

    for ref, _, x, place in doc.placed_objects(nums):
        if place[0] == "offset":
            yield place[1], *ref, type_name(x), _json(x), x if type(x) is int else None


def _forms(doc):
    """(id, stream) of the newest form XObjects, each once."""
    from vellum.core.objects import Stream

    for ref, revision, x in doc.objects():
        if not revision and isinstance(x, Stream) and doc.name_(x.dict.get("Subtype")) == "Form":
            yield ref, x


def _form_rows(doc):
    from vellum.core.geometry import matrix_of

    for ref, s in _forms(doc):
        yield *ref, _dict(matrix_of(doc.reals_(s.dict.get("Matrix")))), doc.dict_(s.dict.get("Resources")) is not None


def _stream_operators(doc, ops: tuple[str, ...] | None = None):
    """Operators of page contents, and of each form once."""
    from vellum.core.content import operators
    from vellum.core.objects import PdfError

    pages = ((p.index, None, None, b"".join(s.data for _, s in p.streams()), ("page", *p.ref)) for p in doc.pages())
    forms = ((None, *ref, s.data, ("form", *ref)) for ref, s in _forms(doc))
    for owners in (pages, forms):
        for page, num, gen, data, intent in owners:
            try:
                for k, op in enumerate(operators(data)):
                    if ops is None or op.op in ops:
                        yield page, num, gen, k, op.op, op.nums, op.name
            except PdfError as e:
                doc.fail(e, intent)


def _xobjects(doc):
    """What the names of XObjects mean on each page and in each form with resources of its own."""
    own = ((p.index, None, None, p.resources()) for p in doc.pages())
    inner = ((None, *ref, doc.dict_(s.dict.get("Resources"))) for ref, s in _forms(doc))
    for owners in (own, inner):
        for page, num, gen, resources in owners:
            for key, entry in (doc.dict_((resources or {}).get("XObject")) or {}).items():
                if (s := doc.stream_(entry)) is not None:
                    yield page, num, gen, key, _ref(entry), _ref(s.id), doc.name_(s.dict.get("Subtype"))


def _object_layouts(doc):
    """Every place of every object with its extent and revision (0 is the newest); vellum.operators.layouts has the same as relations."""
    entries = sorted(doc.xref_entries(), key=lambda e: (e[0], e[3]))
    starts = sorted({e[4] for e in entries if e[3] == "offset"})
    ends = dict(zip(starts, [*starts[1:], doc.xref_range[1]], strict=False))
    seen, packed = Counter(), set()
    for _, num, gen, kind, offset, stm, index in entries:
        revision = seen[num, gen]
        seen[num, gen] += 1
        if kind == "packed":  # only the newest sighting of a packed id has a layout
            if (num, gen) in packed:
                continue
            packed.add((num, gen))
        yield num, gen, revision, {"kind": kind, "start": offset, "end": ends.get(offset), "stm_num": stm, "stm_index": index}


def _wanted(doc, nums, latest: bool):
    """(id, revision, object) of the objects asked for."""
    for ref, revision, x in doc.objects(nums):
        if not (latest and revision):
            yield ref, revision, x


def _objects(doc, nums: tuple[int, ...] | None = None, latest: bool = False):
    from vellum.core.document import type_name
    from vellum.core.objects import Stream

    for ref, revision, x in _wanted(doc, nums, latest):
        yield *ref, revision, type_name(x), _json(x), x.data if isinstance(x, Stream) else None, _ref(x)


def _object_nodes(doc, nums: tuple[int, ...] | None = None, latest: bool = False, depth: int | None = None, keys: tuple[str, ...] | None = None):
    """depth: paths of so many steps at most; keys: paths that begin with one of them."""
    from vellum.core.document import nodes
    from vellum.core.objects import Stream

    for ref, revision, x in _wanted(doc, nums, latest):
        if keys is None:
            found = nodes(x)
        else:
            d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
            found = (node for k in d if k in keys for node in nodes(d[k], (k,)))
        for node in found:
            if depth is None or len(node[0]) <= depth:
                yield *ref, revision, *node


def _object_rows(doc):
    from vellum.core.document import display_rows

    for ref, revision, x in doc.objects():
        if revision == 0:
            for k, row in enumerate(display_rows(x)):
                yield *ref, k, *row


def _pages(doc):
    for p in doc.pages():
        crop, media, above = p.boxes()
        yield p.index, *p.ref, p.path, _dict(crop), _dict(media), _dict(above), p.rotation(), _json(p.dict)


def _content_streams(doc):
    for p in doc.pages():
        for k, (ref, s) in enumerate(p.streams()):
            yield p.index, k, ref.num if ref else None, ref.gen if ref else None, s.data


def _resources(doc):
    from vellum.core.document import type_name

    for p in doc.pages():
        for category, entries in p.resources().items():
            for key, x in (doc.dict_(entries) or {}).items():
                yield p.index, category, key, _ref(x), type_name(doc.resolve(x))


def _operators(doc, ops: tuple[str, ...] | None = None, pages: tuple[int, ...] | None = None, most: int | None = None):
    """ops: these alone, numbered among all; pages: of these; most: reading of a page's content ends after so many of them."""
    from vellum.core.content import operators
    from vellum.core.objects import PdfError

    for p in doc.pages():
        if pages is not None and p.index not in pages:
            continue
        data = b"".join(s.data for _, s in p.streams())
        left, index = most, p.index
        try:
            for k, op in enumerate(operators(data)):
                if ops is not None and op.op not in ops:
                    continue
                if left is not None:
                    if not left:
                        break
                    left -= 1
                word, nums, name, shown, tj, props = op
                if tj is not None:
                    tj = [{"text": t, "offset": o} for t, o in tj]
                yield index, k, word, nums, name, shown, tj, None if props is None else _json(props)
        except PdfError as e:
            doc.fail(e, ("page", *p.ref))


def _features(doc, mask: int = 7, compat: bool = False, boxes: bool = True):
    """boxes: whether text is measured; where neither bounds nor matrix is asked for, it is not."""
    from vellum.core.filters import IMAGE_CODECS
    from vellum.core.fold import Fold

    fold = Fold(doc, mask, compat, boxes)
    for p in doc.pages():
        for k, f in enumerate(fold.page(p) if mask else ()):
            annotation = image = text = None
            if f.annotation:
                kind, idx, ref = f.annotation
                annotation = {"type": kind, "idx": idx, "num": ref.num if ref else None, "gen": ref.gen if ref else None}
            elif f.image:
                ref, s = f.image
                image = {"num": ref.num if ref else None, "gen": ref.gen if ref else None, "encoding": next((IMAGE_CODECS[x] for x in s.pending), "raw"), "data": s.data}
            else:
                t, ref, ps, size = f.text
                text = {"text": t, "font_num": ref.num if ref else None, "font_gen": ref.gen if ref else None, "ps_name": ps, "size": size}
            yield p.index, k, f.kind, _dict(f.bounds), _dict(f.matrix), annotation, image, text


def _text_runs(doc, compat: bool = False):
    """Text operators in their parts, before those of one TJ are put together; see vellum.operators.text."""
    from vellum.core.fold import TEXT, Fold

    class Parts(Fold):
        def show_all(self, state, items):
            for k, item in enumerate(items):
                if (f := super().show_all(state, [item])) is not None:
                    f.image = (k,)
                    out.append(f)
            if out:
                last = out.pop()
                return last
            return None

    for p in doc.pages():
        out: list[Any] = []
        seq = 0
        for f in Parts(doc, TEXT, compat).page(p):
            for part in [*out, f]:
                k = part.image[0] if part.image else 0
                yield p.index, seq, k, part.text[0], *part.bounds, part.text[3]
            out.clear()
            seq += 1


def _glyph_runs(doc, compat: bool = False):
    """The glyphs of each text feature: what a renderer draws, and where."""
    from vellum.core.fold import TEXT, TINY, Fold
    from vellum.core.geometry import Matrix

    class Glyphs(Fold):
        def show(self, state, data):
            font, size, h = state.font, max(state.size, TINY), state.scale / 100
            at = 0.0
            for code, wide in font.widths_of(data) if font is not None else ():
                origin = Matrix(tx=at * size, ty=state.rise).then(state.text).then(state.ctm)
                one = bytes([code]) if font.subtype != "Type0" else None
                space = (0.0 if self.compat else state.char_space / size) + (state.word_space / (1 if self.compat else size) if code == 32 else 0.0)
                step = (wide / 1000 + space) * h
                gid = font.gid(code) if one is None else None
                out.append((state.font_ref.num if state.font_ref else None, code, gid, font.glyph(code) if one is not None else None, origin.tx, origin.ty, step * size))
                at += step
            return super().show(state, data)

    for p in doc.pages():
        out: list[tuple] = []
        for seq, _ in enumerate(Glyphs(doc, TEXT, compat).page(p)):
            for k, row in enumerate(out):
                yield p.index, seq, k, *row
            out.clear()


def _vertical_metrics(doc):
    for ref, f in _all_fonts(doc):
        if f.subtype == "Type0":
            for k, row in enumerate(f.vertical_ranges):
                yield *ref, k, *row, *f.default_vertical


def _display_list(doc, compat: bool = False):
    from vellum.core.fold import TEXT, Fold

    fold, last, shown = Fold(doc, TEXT, compat), None, None
    for p in doc.pages():
        for k, (verb, path, ctm, *rest) in enumerate(fold.display(p)):
            if ctm is not last:
                last, shown = ctm, _dict(ctm)
            yield p.index, k, verb, path, shown, *rest


def _all_fonts(doc):
    """(id, Font) of the font dictionaries among the objects; what cannot be read is an error."""
    from vellum.core.fonts import Font
    from vellum.core.objects import PdfError

    for ref, revision, x in doc.objects():
        if revision == 0 and isinstance(x, dict) and doc.name_(x.get("Type")) == "Font" and not str(doc.name_(x.get("Subtype"))).startswith("CIDFont"):
            try:
                yield ref, Font(doc, x)
            except PdfError as e:
                doc.fail(e, ("font", *ref))


def _fonts(doc):
    for ref, f in _all_fonts(doc):
        yield *ref, f.subtype, f.base_font, f.ps_name, f.encoding, f.ascent, f.descent, f.cap_height, f.italic, _dict(f.bbox), _dict(f.matrix), f.vertical, *f.metrics()


def _font_widths(doc):
    for ref, f in _all_fonts(doc):
        for k, w in enumerate(f.widths):
            yield *ref, f.first + k, w


def _font_differences(doc):
    for ref, f in _all_fonts(doc):
        for code, glyph in f.differences.items():
            yield *ref, code, glyph


def _cid_widths(doc):
    for ref, f in _all_fonts(doc):
        if f.subtype == "Type0":
            for k, (lo, hi, w) in enumerate(f.cid_ranges):
                yield *ref, k, lo, hi, w, f.default_width


def _tounicode(doc):
    for ref, f in _all_fonts(doc):
        if f.to_unicode:
            for k, (lo, hi, text) in enumerate(f.to_unicode.map.entries):
                yield *ref, k, lo, hi, text


def _codespaces(doc):
    for ref, f in _all_fonts(doc):
        for of, spaces in (("unicode", f.to_unicode.spaces if f.to_unicode else []), ("cid", f.spaces if f.subtype == "Type0" else [])):
            for k, (n, lo, hi) in enumerate(spaces):
                yield *ref, of, k, n, lo, hi


def _images(doc):
    from vellum.core.images import image_of
    from vellum.core.objects import Stream

    for ref, revision, x in doc.objects():
        if revision == 0 and isinstance(x, Stream) and doc.name_(x.dict.get("Subtype")) == "Image" and (i := image_of(doc, x)):
            yield *ref, i.width, i.height, i.bits, i.mask, i.encoding, i.space.kind, i.space.components, i.decode, i.interpolate, i.intent, i.smask is not None, i.matte, x.data, _globals(doc, x)


def _globals(doc, s) -> bytes | None:
    """What a JBIG2 stream needs from elsewhere."""
    params = doc.resolve(s.dict.get("DecodeParms"))
    for p in params if isinstance(params, list) else [params]:
        shared = doc.stream_((doc.dict_(p) or {}).get("JBIG2Globals"))
        if shared is not None:
            return shared.data
    return None


def _image_rgba(doc):
    """Rows of red, green, blue and alpha, masks included."""
    from vellum.core.images import rgba
    from vellum.core.objects import Stream

    for ref, revision, x in doc.objects():
        if revision == 0 and isinstance(x, Stream) and doc.name_(x.dict.get("Subtype")) == "Image" and (rows := rgba(doc, x)) is not None:
            for y, row in enumerate(rows):
                yield *ref, y, row.reshape(-1).tolist()


def _image_pixels(doc):
    from vellum.core.images import image_of, pixels
    from vellum.core.objects import Stream

    for ref, revision, x in doc.objects():
        if revision == 0 and isinstance(x, Stream) and doc.name_(x.dict.get("Subtype")) == "Image" and (i := image_of(doc, x)) and (rows := pixels(i, x.data)) is not None:
            for y, row in enumerate(rows):
                yield *ref, y, row.reshape(-1).tolist()


def _page_resources(doc, category: str):
    for p in doc.pages():
        for key, x in (doc.dict_(p.resources().get(category)) or {}).items():
            yield p.index, key, x


def _color_spaces(doc):
    from vellum.core.images import color_space

    for page, key, x in _page_resources(doc, "ColorSpace"):
        if (s := color_space(doc, x)) is not None:
            yield page, key, s.kind, s.components, s.is_cmyk, s.base.kind if s.base else None, s.structure()


def _ext_gstates(doc):
    from vellum.core.fold import ext_gstate

    for page, key, x in _page_resources(doc, "ExtGState"):
        if (d := doc.dict_(x)) is not None:
            g = ext_gstate(doc, d)
            dash = g["D"] or (None, None)
            yield page, key, g["LW"], g["LC"], g["LJ"], g["ML"], *dash, g["RI"], g["OP"], g["op"], g["OPM"], g["FL"], g["SM"], g["SA"], g["BM"], g["SMask"], g["CA"], g["ca"], g["AIS"], g["TK"]


def _soft_masks(doc):
    """What graphics states say of soft masks: the group that is drawn, its space, what lies behind it, and the transfer of its values."""
    from vellum.core.functions import evaluate, parse
    from vellum.core.geometry import matrix_of
    from vellum.core.images import named_space
    from vellum.core.objects import Name

    for p in doc.pages():
        resources = p.resources()
        for key, x in (doc.dict_(resources.get("ExtGState")) or {}).items():
            mask = doc.dict_((doc.dict_(x) or {}).get("SMask"))
            group = doc.stream_(mask.get("G")) if mask is not None else None
            if group is None:
                continue
            own = doc.dict_(group.dict.get("Group")) or {}
            space = named_space(doc, str(doc.name_(own.get("CS")) or ""), doc.dict_(group.dict.get("Resources")) or resources) if own.get("CS") is not None else None
            transfer = doc.resolve(mask.get("TR"))
            f = parse(doc, mask.get("TR")) if transfer is not None and not isinstance(transfer, Name) else None
            samples = [v[0] if (v := evaluate(f, [t])) else None for t in (0.0, 0.25, 0.5, 0.75, 1.0)] if f else None
            kind = str(transfer) if isinstance(transfer, Name) else "function" if f else None
            yield p.index, key, doc.name_(mask.get("S")), _ref(group.id), _dict(doc.rect_(group.dict.get("BBox"))), _dict(matrix_of(doc.reals_(group.dict.get("Matrix")))), space.kind if space else None, bool(doc.bool_(own.get("I"))), bool(doc.bool_(own.get("K"))), doc.reals_(mask.get("BC")), kind, samples


def _shadings(doc):
    from vellum.core.images import shading_of

    for page, key, x in _page_resources(doc, "Shading"):
        if (s := shading_of(doc, x)) is not None:
            yield page, key, s.kind, s.space.kind, s.coords, s.domain, s.extend, s.background, [s.colour(s.domain[0] + (s.domain[1] - s.domain[0]) * k / 4) for k in range(5)]


def _functions(doc):
    from vellum.core.functions import evaluate, parse

    for ref, revision, x in doc.objects():
        d = x.dict if hasattr(x, "dict") else x
        if revision == 0 and isinstance(d, dict) and type(doc.resolve(d.get("FunctionType"))) is int and (f := parse(doc, ref)):
            at = [evaluate(f, [f.domain[2 * i] + t * (f.domain[2 * i + 1] - f.domain[2 * i]) for i in range(len(f.domain) // 2)]) for t in (0.0, 0.5, 1.0)]
            yield *ref, f.kind, list(f.domain), list(f.range) if f.range else None, len(at[0] or []), *at


def _parse_errors(doc, compat: bool = False):
    """Everything is read once; what failed on the way is told."""
    for rows in (_objects, _operators):
        for _ in rows(doc):
            pass
    for _ in _features(doc, 7, compat):
        pass
    seen = set()
    for failure, start, end, intent in doc.errors:
        kind, num, gen = (*(intent or ()), None, None, None)[:3]
        if (key := (failure, start, end, kind, num, gen)) not in seen:
            seen.add(key)
            yield failure, start, end, {"kind": kind, "num": num, "gen": gen}


_ROWS = {
    "headers": _headers, "trailers": _trailers, "xref_entries": lambda doc: doc.xref_entries(), "xref_sections": _xref_sections, "object_layouts": _object_layouts, "objects": _objects, "object_nodes": _object_nodes, "objects_at": _objects_at, "object_rows": _object_rows,
    "pages": _pages, "content_streams": _content_streams, "resources": _resources, "operators": _operators, "stream_operators": _stream_operators, "xobjects": _xobjects, "forms": _form_rows, "features": _features, "text_runs": _text_runs, "glyph_runs": _glyph_runs, "vertical_metrics": _vertical_metrics, "display_list": _display_list,
    "fonts": _fonts, "font_widths": _font_widths, "font_differences": _font_differences, "cid_widths": _cid_widths, "tounicode_mappings": _tounicode, "codespaces": _codespaces,
    "images": _images, "image_pixels": _image_pixels, "image_rgba": _image_rgba, "color_spaces": _color_spaces, "ext_gstates": _ext_gstates, "soft_masks": _soft_masks, "shadings": _shadings, "functions": _functions, "parse_errors": _parse_errors,
}


def open_engine(spark: SparkSession, path: str, password: str | None = None, compat: bool = False) -> Engine:
    from vellum.sources.pdf import read_pdfs

    return Engine(read_pdfs(spark, path), password, compat)
