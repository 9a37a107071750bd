"""Reading parts of files."""

import random

from vellum import synth
from vellum.core.document import Document
from vellum.sources.lazy import RangeDocument, Ranges, register


def a_file(packed=False, updates=3, filler=40_000):
    w = synth.one_page(b"BT ET", extra={5: b"(five)", 6: synth.stream(b"s" * 3000), 7: synth.stream(random.Random(1).randbytes(filler)), 8: b"<< /L [1 2 (x)] >>"})
    out = w.finish_packed() if packed else w.finish()
    for k in range(0 if packed else updates):
        out = w.update({5: b"(five %d)" % k})
    return out


class Remote:
    """A store that hands out ranges alone, and notes them."""

    def __init__(self, data):
        self.data, self.asked = data, []

    def __call__(self, start, n):
        self.asked.append((start, n))
        return self.data[start : start + n]


def test_ranges_of_a_remote_file():
    for packed in (False, True):
        data = a_file(packed)
        whole, store = Document(data), Remote(data)
        doc = RangeDocument(Ranges(store, len(data)))
        assert doc.trailer == whole.trailer and doc._layout == whole._layout and doc.header == whole.header and not doc.errors
        assert [x for _, x in doc.newest(frozenset([5, 8]))] == [whole.get(r) for r in sorted(whole._layout) if r.num in (5, 8)]
        assert sum(n for _, n in store.asked) < len(data) and max(n for _, n in store.asked) < 40_000
    store = Remote(data := a_file(updates=2, filler=1_000_000))
    doc = RangeDocument(Ranges(store, len(data)))
    list(doc.newest(frozenset([5])))
    assert doc.ranges.read < len(data) / 10


def test_odd_files():
    broken = synth.one_page(b"", extra={5: b"(x)"}).finish(xref=False)
    doc = RangeDocument(Ranges(Remote(broken), len(broken)))
    assert doc.recovered and dict(doc.newest(None)).keys() == Document(broken)._layout.keys()
    for data in (b"", b"no file", b"%PDF-1.4\n"):
        doc = RangeDocument(Ranges(Remote(data), len(data)))
        assert not doc.ok and doc.errors[0][0] == Document(data).errors[0][0] and list(doc.newest(None)) == []
    long = synth.one_page(b"", extra={k: b"(%d)" % k for k in range(5, 3000)}).finish()  # a section of more than a window
    doc = RangeDocument(Ranges(Remote(long), len(long)))
    assert doc._layout == Document(long)._layout


def test_objects_as_a_source(spark, tmp_path):
    register(spark)
    big = a_file(filler=300_000)
    for name, data in (("a.pdf", big), ("b.pdf", a_file(True)), ("c.pdf", b"no file"), ("d.txt", big)):
        (tmp_path / name).write_bytes(data)
    rows = spark.read.format("pdf_objects").load(f"file://{tmp_path}")
    one = rows.where("num = 5 and gen = 0").collect()
    assert sorted((r["path"][-5:], r["kind"]) for r in one) == [("a.pdf", "string"), ("b.pdf", "string")]
    assert next(r for r in one if r["path"].endswith("a.pdf"))["bytes_read"] < len(big) / 10
    assert {r["num"] for r in rows.where("num in (5, 6)").collect()} == {5, 6}
    every = rows.where("path like '%a.pdf'").collect()
    assert {r["num"] for r in every} == {r.num for r in Document(big)._layout} and every[-1]["bytes_read"] >= 300_000
    assert bytes(next(r["data"] for r in every if r["num"] == 6)) == b"s" * 3000
