"""Queries over documents that are written from the tables of a folder, and their DuckDB equals.

Every query goes through the bytes: vellum.synth writes PDF files from the rows, the engine reads them, and the SQL says
what must come out from the rows alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum import synth
from vellum.functions import geometry as G
from vellum.operators.chains import layouts_of_sections
from vellum.operators.invocations import images
from vellum.plans.cut import cut
from vellum.plans.tables import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame) -> DataFrame:
    """A table dealt out before work in Python: splits of a file say nothing of that, as those without the start of a row group are empty."""
    return df.repartition(_tasks(df.sparkSession))


def gathered(df: DataFrame, key: str) -> DataFrame:
    """A table before it is grouped for work in Python: a shuffle of a stated number is not merged into a few tasks because its rows are small; the grouping needs no other."""
    return df.repartition(_tasks(df.sparkSession), key)


def records(part) -> list[dict]:
    """The rows of an Arrow batch; those of an array of structs are made column by column."""
    import pyarrow as pa

    columns = []
    for c in part.columns:
        if pa.types.is_list(c.type) and pa.types.is_struct(c.type.value_type) and not c.null_count and not (held := c.flatten()).null_count:
            names = [f.name for f in c.type.value_type]
            items = [dict(zip(names, v, strict=True)) for v in zip(*(x.to_pylist() for x in held.flatten()), strict=True)]
            ends = c.offsets.to_pylist()
            columns.append([items[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)])
        else:
            columns.append(c.to_pylist())
    return [dict(zip(part.schema.names, r, strict=True)) for r in zip(*columns, strict=True)]


def write_pdfs(df: DataFrame, id_col: str, make: Callable[[dict], bytes]) -> DataFrame:
    """(doc_id, content): one file per row."""

    def run(batches: Iterable):
        import pyarrow as pa

        from vellum.plans.tables import slices

        for b in batches:
            for part in slices(b):
                rows = records(part)
                yield pa.RecordBatch.from_arrays([pa.array([r[id_col] for r in rows], pa.int64()), pa.array([make(r) for r in rows], pa.binary())], names=["doc_id", "content"])

    return df.mapInArrow(run, "doc_id long, content binary")


def num(x: float) -> bytes:
    return format(x, ".10f").rstrip("0").rstrip(".").encode() or b"0"


F1 = b"/Font << /F1 5 0 R >>"
FONT = {5: synth.FONT}

# ---- text -----------------------------------------------------------------------------------------------------------


def _lines(r: dict) -> bytes:
    lines = [x for x in (r["text"] or "").split("\n") if x]
    body = b"".join(b"1 0 0 1 72 %d Tm %s Tj\n" % (720 - 14 * i, synth.literal(x.encode("latin-1", "replace"))) for i, x in enumerate(lines))
    return synth.one_page(b"BT /F1 12 Tf\n" + body + b"ET", F1, extra=FONT, flate=True).finish()


LINES_SQL = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS line, t AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE t <> ''"""


@query(LINES_SQL)
def text_lines(spark, sf_dir):
    docs = write_pdfs(dealt(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", _lines)
    return Engine(docs).table("features", columns=("seq", "text"), mask=4).select("doc_id", F.col("seq").alias("line"), F.col("text.text").alias("text"))


@query("SELECT doc_id, replace(text, ' ', '') AS text FROM documents")
def text_tj_concat(spark, sf_dir):
    """A document is one row of the pass, so one without text has an empty text (and null where there is no file)."""

    def make(r):
        if r["text"] is None:
            return None
        words = [synth.literal(w.encode("latin-1", "replace")) for w in r["text"].split(" ")]
        return synth.one_page(b"BT /F1 9 Tf 72 700 Td [" + b" -250 ".join(words) + b"] TJ ET", F1, extra=FONT, flate=True).finish()

    docs = write_pdfs(dealt(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", make)
    found = Engine(docs).bundle(headers={"columns": ("type",)}, features={"mask": 4, "columns": ("text",)})
    text = F.array_join(F.transform("features", lambda x: x["text"]["text"]), "")
    return found.select("doc_id", F.when(F.size("headers") > 0, text).alias("text"))


@query("SELECT s_suppkey AS doc_id, replace(s_name, '#', ' x') AS text FROM supplier")
def text_runs_combined(spark, sf_dir):
    """The same as relations: the parts of a TJ operator put together again."""
    from vellum.operators.text import combine_runs

    def make(r):
        a, b = (synth.literal(x.encode()) for x in r["s_name"].split("#"))
        return synth.one_page(b"BT /F1 9 Tf 72 700 Td [%s -250 ( ) 3 (x) %s] TJ ET" % (a, b), F1, extra=FONT).finish()

    docs = write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make)
    return combine_runs(Engine(docs).table("text_runs")).select("doc_id", "text")


@query("""SELECT s_suppkey AS doc_id, CAST(i AS INTEGER) AS seq, s_name || p AS text, y FROM supplier, (VALUES (0, 'a', 698.0), (1, 'b', 684.0), (2, 'c', 670.0), (3, 'd', 656.0), (4, 'e', 636.0)) v(i, p, y)""")
def text_quote_ops(spark, sf_dir):
    def make(r):
        t = [synth.literal((r["s_name"] + x).encode()) for x in "abcde"]
        return synth.one_page(b"BT /F1 10 Tf 14 TL 50 700 Td %s Tj %s ' 1 0 %s \" T* %s Tj 0 -20 TD %s Tj ET" % tuple(t), F1, extra=FONT).finish()

    f = Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make)).features(("text",))
    return f.select("doc_id", "seq", F.col("text.text").alias("text"), F.round("bounds.y", 6).alias("y"))


@query("""SELECT s_suppkey AS doc_id, 100.0 AS x, 497.6 AS y, round(list_sum([(400 + 10 * (ascii(substr(s_name, CAST(i AS BIGINT), 1)) % 16)) / 1000.0 * 12 FOR i IN range(1, length(s_name) + 1)]), 6)::DOUBLE AS width, 12.0 AS height FROM supplier""".replace("100.0", "100.0::DOUBLE").replace("497.6", "497.6::DOUBLE").replace(" 12.0 AS", " 12.0::DOUBLE AS"))
def text_bounds(spark, sf_dir):
    make = lambda r: synth.one_page(b"BT /F1 12 Tf 100 500 Td %s Tj ET" % synth.literal(r["s_name"].encode()), F1, extra=FONT).finish()
    f = Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make)).features(("text",))
    return f.select("doc_id", *[F.round(f"bounds.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


CMAP = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0420> <047F> <0020> endbfrange endcmap"
TYPE0 = {
    5: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>",
    6: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /CIDSystemInfo << /Registry (A) /Ordering (I) /Supplement 0 >> /DW 500 >>",
    7: synth.stream(CMAP),
}


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS text, (length(n_name) * 5.0)::DOUBLE AS width FROM nation")
def text_cid_tounicode(spark, sf_dir):
    make = lambda r: synth.one_page(b"BT /F1 10 Tf 20 20 Td <%s> Tj ET" % b"".join(b"%04X" % (ord(c) + 0x400) for c in r["n_name"]), F1, extra=TYPE0).finish()
    f = Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make)).features(("text",))
    return f.select("doc_id", F.col("text.text").alias("text"), F.round("bounds.width", 6).alias("width"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS text FROM nation")
def tounicode_range_join(spark, sf_dir):
    """The same decoding as relations: codes of the shown strings against the font's mappings."""
    from vellum.operators.text import decode_codes

    make = lambda r: synth.one_page(b"BT /F1 10 Tf 20 20 Td <%s> Tj ET" % b"".join(b"%04X" % (ord(c) + 0x400) for c in r["n_name"]), F1, extra=TYPE0).finish()
    e = Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make))
    fonts = e.table("fonts").select("doc_id", "num", "gen")
    strings = e.table("operators").where("op = 'Tj'").select("doc_id", F.col("seq").alias("sid"), "bytes").join(fonts, "doc_id")
    return decode_codes(strings, e.table("codespaces"), e.table("tounicode_mappings")).select("doc_id", "text")


MIXED = b"begincmap 2 begincodespacerange <20> <7E> <8140> <9FFC> endcodespacerange 2 beginbfrange <20> <7E> <0020> <8140> <819F> <0020> endbfrange endcmap"


@query("SELECT c_custkey AS doc_id, c_name || ' ' || c_mktsegment AS text FROM customer")
def tounicode_mixed_lengths(spark, sf_dir):
    """Every third character in two bytes, the others in one, and bytes that no codespace takes between them."""
    from vellum.operators.text import decode_codes

    def make(r):
        text = f"{r['c_name']} {r['c_mktsegment']}"
        shown = b"".join((b"%04X" % (0x8140 + ord(c) - 32) if i % 3 == r["c_custkey"] % 3 else b"%02X" % ord(c)) + (b"FF" if i % 7 == 0 else b"") for i, c in enumerate(text))
        return synth.one_page(b"BT /F1 10 Tf 20 20 Td <%s> Tj ET" % shown, F1, extra={**TYPE0, 7: synth.stream(MIXED)}).finish()

    read_once = cut(Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)).bundle(fonts={"columns": ("num", "gen")}, operators={"columns": ("seq", "bytes"), "ops": ("Tj",)}, codespaces={}, tounicode_mappings={}), "read")
    rows = lambda name: read_once.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
    strings = rows("operators").withColumnRenamed("seq", "sid").join(rows("fonts"), "doc_id")
    return decode_codes(strings, rows("codespaces"), rows("tounicode_mappings")).select("doc_id", "text")


@query("SELECT doc_id, text FROM documents")
def pdfdoc_decode(spark, sf_dir):
    from vellum.functions.text import pdf_doc_bytes, pdf_text

    return dealt(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", pdf_text(pdf_doc_bytes(F.col("text"))).alias("text"))


# ---- operators ------------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    """One page per order: a colour and a rectangle per line item."""
    rows = gathered(read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))).alias("items"))

    def make(r):
        body = b"".join(b"%s 0 %s rg %s %s %d 1 re f\n" % (num(x["l_discount"]), num(x["l_tax"]), num(x["l_quantity"]), num(x["l_extendedprice"]), x["l_linenumber"]) for x in r["items"])
        return synth.one_page(b"q\n" + body + b"Q", flate=True).finish()

    return Engine(write_pdfs(rows, "l_orderkey", make))


@query("SELECT op, sum(n)::BIGINT AS n FROM (SELECT unnest(['rg', 're', 'f']) AS op, count(*) AS n FROM lineitem UNION ALL SELECT unnest(['q', 'Q']), count(DISTINCT l_orderkey) FROM lineitem) GROUP BY op")
def op_histogram(spark, sf_dir):
    return _orders(spark, sf_dir).table("operators", columns=("op",)).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n, round(sum(l_quantity), 3) AS qty, round(sum(l_extendedprice), 3) AS price FROM lineitem GROUP BY l_orderkey")
def rect_operands(spark, sf_dir):
    re = _orders(spark, sf_dir).table("operators", columns=("nums",), ops=("re",))
    return re.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("nums")[0]), 3).alias("qty"), F.round(F.sum(F.col("nums")[1]), 3).alias("price"))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, round(l_discount, 6) AS red, round(l_tax, 6) AS blue, round(l_quantity, 4) AS x, round(l_extendedprice, 4) AS y,
round(l_quantity + l_linenumber, 4) AS right_, round(l_extendedprice + 1, 4) AS top FROM lineitem""")
def display_list_fills(spark, sf_dir):
    d = _orders(spark, sf_dir).table("display_list", columns=("verb", "path", "colour")).where("verb = 'fill'")
    step = F.split("path", " ")  # m x y l right y l right top l x top h
    at = lambda i: F.round(step[i].cast("double"), 4)
    line = F.round(step[4].cast("double") - step[1].cast("double")).cast("long")
    return d.select("doc_id", line.alias("line"), F.round(F.col("colour")[0], 6).alias("red"), F.round(F.col("colour")[2], 6).alias("blue"), at(1).alias("x"), at(2).alias("y"), at(4).alias("right_"), at(8).alias("top"))


IMAGE = {6: synth.stream(b"\x80", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8")}
IM = b"/XObject << /Im 6 0 R >>"


@query("SELECT p_partkey AS doc_id, 5.0::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y, p_size::DOUBLE AS width, round(p_retailprice, 4) AS height, 6::BIGINT AS num FROM part")
def ctm_images(spark, sf_dir):
    """Matrices by relations on the operators, as nested_q_cm and form_recursion."""
    make = lambda r: synth.one_page(b"q %d 0 0 %s 5 %d cm /Im Do Q" % (r["p_size"], num(r["p_retailprice"]), r["p_partkey"] % 97), IM, extra=IMAGE).finish()
    f = images(Engine(write_pdfs(dealt(read(spark, sf_dir, "part")), "p_partkey", make)))
    return f.select("doc_id", *[F.round(f"bounds.{c}", 4).alias(c) for c in ("x", "y", "width", "height")], "num")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS seq, (CASE i WHEN 0 THEN 2.0 * (n_nationkey + 1) WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS width FROM nation, (VALUES (0), (1), (2)) v(i)")
def nested_q_cm(spark, sf_dir):
    make = lambda r: synth.one_page(b"q 2 0 0 2 1 1 cm q %d 0 0 1 0 0 cm /Im Do Q /Im Do Q /Im Do" % (r["n_nationkey"] + 1), IM, extra=IMAGE).finish()
    f = images(Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make)))
    return f.select("doc_id", "seq", F.round("bounds.width", 6).alias("width"))


@query("""SELECT c_custkey AS doc_id, CAST(i AS INTEGER) AS seq, (CASE i WHEN 0 THEN k * 2 WHEN 1 THEN k * 6 WHEN 2 THEN k * 2 WHEN 3 THEN 1 ELSE 5 END)::DOUBLE AS width
FROM (SELECT c_custkey, 1 + c_nationkey AS k FROM customer), (VALUES (0), (1), (2), (3), (4)) v(i)""")
def unbalanced_q(spark, sf_dir):
    """A Q with nothing to close goes back to the start of the stream; a q that is never closed holds to its end."""

    def make(r):
        return synth.one_page(b"%d 0 0 1 0 0 cm q 2 0 0 1 0 0 cm /Im Do q 3 0 0 1 0 0 cm /Im Do Q /Im Do Q Q /Im Do q 5 0 0 1 0 0 cm q /Im Do" % (1 + r["c_nationkey"]), IM, extra=IMAGE).finish()

    f = images(Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)))
    return f.select("doc_id", "seq", F.round("bounds.width", 6).alias("width"))


@query("""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, i) - 1 AS INTEGER) AS seq, (o_orderkey % 89 + 10 * i)::DOUBLE AS x, (2 + i)::DOUBLE AS width, (6 + i)::BIGINT AS num
FROM orders, (VALUES (0), (1)) v(i)""")
def shared_forms(spark, sf_dir):
    """A form that draws an image, and a form without resources of its own that draws another, placed once for each order of a customer."""
    rows = gathered(read(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    extra = {
        5: synth.stream(b"2 0 0 1 0 0 cm /Im Do /Fm Do", b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Resources << /XObject << /Im 6 0 R /Fm 8 0 R >> >>"),
        8: synth.stream(b"1.5 0 0 1 0 0 cm /Fm Do /Im Do", b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 5 0] /Resources << /XObject << /Im 7 0 R /Fm 5 0 R >> >>"),
        **IMAGE,
        7: IMAGE[6],
    }

    def make(r):
        return synth.one_page(b" ".join(b"q 1 0 0 1 %d 0 cm /Fm Do Q" % (k % 89) for k in r["keys"]), b"/XObject << /Fm 5 0 R >>", extra=extra).finish()

    f = images(Engine(write_pdfs(rows, "o_custkey", make)))
    return f.select("doc_id", "seq", F.round("bounds.x", 6).alias("x"), F.round("bounds.width", 6).alias("width"), "num")


@query("SELECT s_suppkey AS doc_id, (10 + 2 * (s_suppkey % 13))::DOUBLE AS x, (20 + 6)::DOUBLE AS y, 2.0::DOUBLE AS width, 3.0::DOUBLE AS height FROM supplier")
def form_recursion(spark, sf_dir):
    def make(r):
        form = {5: synth.stream(b"q 1 0 0 1 %d 2 cm /Im Do Q" % (r["s_suppkey"] % 13), b"/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [2 0 0 3 0 0] /Resources << /XObject << /Im 6 0 R /Fm 5 0 R >> >>"), **IMAGE}
        return synth.one_page(b"1 0 0 1 10 20 cm /Fm Do", b"/XObject << /Fm 5 0 R >>", extra=form).finish()

    f = images(Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make)))
    return f.select("doc_id", *[F.round(f"bounds.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


def _users(spark, sf_dir):
    rows = gathered(read(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("items"))

    def make(r):
        notes = b" ".join(b"<< /Type /Annot /Subtype /%s /Rect [%d 10 %d 0] >>" % (x["event_type"].encode(), x["event_id"] % 500 + 10, x["event_id"] % 500) for x in r["items"])
        return synth.one_page(b"BT /F1 12 Tf (x) Tj ET /Im Do", F1 + IM, b"/MediaBox [0 0 9 9] /Annots [%s << /Subtype /Bad >>]" % notes, {**FONT, **IMAGE}).finish()

    return Engine(write_pdfs(rows, "user_id", make))


@query("SELECT event_type, count(*) AS n, sum(event_id % 500)::DOUBLE AS x, sum(10)::DOUBLE AS w FROM events GROUP BY event_type")
def annotations(spark, sf_dir):
    f = _users(spark, sf_dir).features(("annotation",))
    return f.groupBy(F.col("annotation.type").alias("event_type")).agg(F.count("*").alias("n"), F.sum("bounds.x").alias("x"), F.sum("bounds.width").alias("w"))


@query("SELECT kind, n::BIGINT AS n FROM (SELECT 'image' AS kind, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'annotation', count(*) FROM events)")
def feature_mask(spark, sf_dir):
    return _users(spark, sf_dir).features(("annotation", "image")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT user_id AS doc_id, count(*) AS hits FROM events WHERE 250 BETWEEN event_id % 500 AND event_id % 500 + 10 GROUP BY user_id")
def hit_test(spark, sf_dir):
    f = _users(spark, sf_dir).features(("annotation",))
    return f.where(G.contains(F.col("bounds"), F.lit(250.0), F.lit(5.0))).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("""SELECT c_custkey AS doc_id, CAST(i AS INTEGER) AS region, count(*) AS hits, sum(event_id + 10)::BIGINT AS ids
FROM events JOIN customer ON c_custkey = user_id, (VALUES (0), (1), (2)) v(i)
WHERE event_id % 500 <= (c_custkey * 37 + i * 150) % 500 + c_nationkey * 4 * i AND (c_custkey * 37 + i * 150) % 500 <= event_id % 500 + 10 AND 5 <= 10 AND 0 <= 5 + i GROUP BY ALL""")
def region_hits(spark, sf_dir):
    """Three regions a customer against the annotations of their page, from a point to a broad strip."""
    from vellum.operators.hits import hits

    regions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), "c_nationkey", F.explode(F.array(*map(F.lit, range(3)))).alias("region"))
    left = (F.col("doc_id") * 37 + F.col("region") * 150) % 500
    regions = regions.select("doc_id", "page_index", "region", G.rect(left, F.lit(5), F.col("c_nationkey") * 4 * F.col("region"), F.col("region")).alias("rect"))
    found = hits(cut(_numbered_users(spark, sf_dir).table("features", columns=("page_index", "bounds", "annotation"), mask=1), "read"), regions)
    return found.groupBy("doc_id", "region").agg(F.count("*").alias("hits"), F.sum(F.col("annotation.num")).alias("ids"))


def _numbered_users(spark, sf_dir):
    """Annotations as objects whose numbers are ten more than those of the events."""
    rows = gathered(read(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("keys"))

    def make(r):
        notes = {10 + k: b"<< /Type /Annot /Subtype /Link /Rect [%d 10 %d 0] >>" % (k % 500, k % 500 + 10) for k in r["keys"]}
        return synth.one_page(b"", page=b"/MediaBox [0 0 9 9] /Annots [%s]" % b" ".join(b"%d 0 R" % k for k in notes), extra=notes).finish()

    return Engine(write_pdfs(rows, "user_id", make))


@query("""SELECT c_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS INTEGER) AS nth, verb, CAST(n AS INTEGER) AS segments, (x + c_custkey)::DOUBLE AS last_x FROM customer JOIN
(VALUES (1, 0, 'stroke', 2, 0), (3, 0, 'clip', 2, 3), (4, 0, 'fill', 2, 6), (5, 0, 'eofill', 6, 0), (5, 1, 'stroke', 6, 0), (5, 2, 'eoclip', 6, 0), (6, 0, 'stroke', 4, 2), (7, 0, 'fill', 2, 9)) v(k, i, verb, n, x) ON k = c_custkey % 8""")
def path_legality(spark, sf_dir):
    """Moves alone and lines without a start paint nothing, and no clip comes of them; a close counts, if it has something to close."""
    from vellum.operators.paths import painted

    bodies = [
        b"%(a)d 2 m S h S",
        b"h %(b)d 4 l %(a)d 2 m h S",
        b"1 2 m 3 4 m B",
        b"1 2 m %(b)d 4 l W n",
        b"1 2 m W n 5 5 m %(c)d 6 l f",
        b"3 3 m %(a)d 0 2 2 re W* B*",
        b"1 1 m 2 2 3 3 v %(d)d 4 l s",
        b"1 1 m 2 2 l W Q 4 4 m n 8 8 m %(e)d 9 l f",
    ]

    def make(r):
        k = r["c_custkey"]
        body = bodies[k % 8].replace(b"W Q 4 4 m n", b"W Q n") if k % 8 == 7 else bodies[k % 8]
        return synth.one_page(body % {b"a": k, b"b": k + 3, b"c": k + 6, b"d": k + 2, b"e": k + 9}).finish()

    ops = Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)).table("operators", columns=("page_index", "seq", "op", "nums"))
    rows = painted(ops)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "part")) - 1
    points = F.filter(F.transform("segments", lambda s: s["at"]), lambda a: F.size(a) > 0)
    last = F.element_at(F.element_at(points, -1), -2)
    return rows.select("doc_id", nth.alias("nth"), "verb", F.size("segments").alias("segments"), last.alias("last_x"))


@query("""SELECT c_custkey AS doc_id, CAST(i AS INTEGER) AS nth, CASE i WHEN 2 THEN 'stroke' WHEN 4 THEN 'stroke' ELSE 'fill' END AS verb,
(CASE i WHEN 0 THEN greatest(a, 10) WHEN 1 THEN greatest(10, b + 5) WHEN 3 THEN 50 END)::DOUBLE AS left_, (CASE i WHEN 0 THEN 10 WHEN 1 THEN greatest(10, b + 5) WHEN 3 THEN 50 END)::DOUBLE AS bottom,
(CASE i WHEN 0 THEN least(a + 20, 50) WHEN 1 THEN b + 25 WHEN 3 THEN least(50 + c_custkey, 120) END)::DOUBLE AS right_, (CASE i WHEN 0 THEN 15 WHEN 1 THEN b + 25 WHEN 3 THEN 52 END)::DOUBLE AS top
FROM (SELECT c_custkey, c_custkey % 50 AS a, c_custkey % 7 AS b FROM customer), (VALUES (0), (1), (2), (3), (4)) v(i)""")
def visible_paths(spark, sf_dir):
    """What the page's box and clips within clips leave of rectangles and a line; nothing of the third and the last."""
    from vellum.operators.clips import SIDES, visible

    def make(r):
        k = r["c_custkey"]
        body = b"q 10 10 40 30 re W n %d 5 20 10 re f q 1 0 0 1 5 5 cm %d %d 20 20 re W* n 0 0 100 100 re f Q 0 0 30 %d re S Q 50 50 %d 2 re f 0 0 m 500 0 l S" % (k % 50, k % 7, k % 7, k % 7, k)
        return synth.one_page(body, page=b"/MediaBox [0 0 200 100] /CropBox [0 5 120 300]").finish()

    rows = visible(Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "part")) - 1
    return rows.select("doc_id", nth.alias("nth"), "verb", *[F.col(f"visible.{c}").alias(c) for c in SIDES])


# ---- structure ------------------------------------------------------------------------------------------------------


def _tree(spark, sf_dir):
    """A file for each nation: market segments as inner nodes, customers as pages."""
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", "c_custkey", "c_name"))).alias("items"))

    def make(r):
        w, kids = synth.Writer(), {}
        for x in r["items"]:
            kids.setdefault(x["c_mktsegment"], []).append(x)
        w.add(b"<< /Type /Catalog /Pages 2 0 R >>", 1)
        w.add(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (101 + k) for k in range(len(kids))), len(r["items"])), 2)
        for k, own in enumerate(kids.values(), 101):
            w.add(b"<< /Type /Pages /Parent 2 0 R /MediaBox [0 0 %d 50] /Kids [%s] /Count %d >>" % (k, b" ".join(b"%d 0 R" % (200 + x["c_custkey"]) for x in own), len(own)), k)
            for x in own:
                w.add(b"<< /Type /Page /Parent %d 0 R /PieceInfo (%s) >>" % (k, x["c_name"].encode()), 200 + x["c_custkey"])
        return w.finish()

    return Engine(write_pdfs(rows, "k", make))


TREE_SQL = "SELECT c_nationkey::BIGINT AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) - 1 AS INTEGER) AS page_index, (200 + c_custkey)::BIGINT AS num{} FROM customer"


@query(TREE_SQL.format(", (100 + dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment))::DOUBLE AS width"))
def page_tree(spark, sf_dir):
    p = _tree(spark, sf_dir).table("pages")
    return p.select("doc_id", "page_index", "num", G.page_rect(F.col("crop"), F.col("media"), F.col("above"))["width"].alias("width"))


@query(TREE_SQL.format(""))
def page_tree_recursive(spark, sf_dir):
    from vellum.operators.page_tree import flatten

    nodes = _tree(spark, sf_dir).table("object_nodes", columns=("num", "gen", "revision", "path", "kind", "s", "ref"), latest=True, depth=2, keys=("Type", "Kids", "Pages"))
    return flatten(spark, nodes).select("doc_id", "page_index", "num")


@query("""SELECT p_partkey AS doc_id, (CASE WHEN p_partkey % 4 = 3 THEN 612 WHEN p_partkey % 4 = 2 THEN p_size WHEN p_partkey % 4 = 1 THEN 100 ELSE least(p_size + 30, 100) - p_size END)::DOUBLE AS width,
(CASE WHEN p_partkey % 4 IN (0, 2) THEN CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END ELSE 0 END)::DOUBLE AS x FROM part""")
def page_boxes(spark, sf_dir):
    def make(r):
        k, s = r["p_partkey"] % 4, r["p_size"]
        page = [b"/MediaBox [0 0 100 100] /CropBox [%d 0 %d 40]" % (s, s + 30), b"/MediaBox [100 0 0 100]", b"/CropBox [0 0 %d 40]" % s, b""][k]
        return synth.one_page(b"", page=page).finish()

    p = Engine(write_pdfs(dealt(read(spark, sf_dir, "part")), "p_partkey", make)).table("pages")
    box = G.page_rect(F.col("crop"), F.col("media"), F.col("above"))
    return p.select("doc_id", box["width"].alias("width"), box["x"].alias("x"))


def _customers(spark, sf_dir):
    """One file per customer: object 5 is rewritten by each order."""
    rows = gathered(read(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))

    def make(r):
        w = synth.one_page(b"")
        w.add(b"%d" % r["keys"][0], 5)
        w.finish()
        for k in r["keys"][1:]:
            w.append({5: b"%d" % k})
        return bytes(w.out)

    return Engine(write_pdfs(rows, "o_custkey", make))


@query("SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS INTEGER) AS revision, o_orderkey AS value FROM orders")
def xref_revisions(spark, sf_dir):
    layouts, at, _ = _chains(_customers(spark, sf_dir))
    own = layouts.where("num = 5").select("doc_id", "revision", F.col("storage.start").alias("start"))
    return own.join(at, ["doc_id", "start"]).select("doc_id", "revision", F.col("i").alias("value"))


def _chains(e: Engine, nums: tuple[int, ...] = (5,)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layouts, objects of nums by their offsets, headers): one reading, then relations on its sections."""
    read_once = cut(e.bundle(xref_sections={}, headers={"columns": ("xref_start", "xref_end")}, objects_at={"columns": ("start", "i"), "nums": nums}), "read")
    rows = lambda name: read_once.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")
    return layouts_of_sections(rows("xref_sections"), rows("headers")), rows("objects_at"), rows("headers")


@query("SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS INTEGER) AS revision, (16 + length(o_orderkey::VARCHAR))::BIGINT AS extent FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def object_extents(spark, sf_dir):
    """The last object's extent goes on to the word startxref; the length of the table before it comes off."""
    layouts, _, ends = _chains(_customers(spark, sf_dir), nums=())
    out = layouts.where("num = 5 and revision = 0").join(ends, "doc_id")
    return out.select("doc_id", "revision", (F.col("storage.end") - F.col("storage.start") - F.col("xref_end") + F.col("xref_start")).alias("extent"))


@query("SELECT o_custkey AS doc_id, 5::BIGINT AS num, CAST(count(*) - 1 AS INTEGER) AS oldest FROM orders GROUP BY o_custkey")
def navigate_oldest(spark, sf_dir):
    from vellum.operators.layouts import navigate

    return navigate(_chains(_customers(spark, sf_dir), nums=())[0]).where("num = 5").select("doc_id", "num", F.col("revision").alias("oldest"))


@query("SELECT o_custkey AS doc_id, max(o_orderkey) AS value FROM orders GROUP BY o_custkey")
def resolve_latest(spark, sf_dir):
    """What a look-up by id finds."""
    from vellum.operators.layouts import resolve_latest as newest

    layouts, at, _ = _chains(_customers(spark, sf_dir))
    own = newest(layouts).where("num = 5").select("doc_id", F.col("storage.start").alias("start"))
    return own.join(at, ["doc_id", "start"]).select("doc_id", F.col("i").alias("value"))


@query("SELECT s_suppkey AS doc_id, s_name AS name, (s_suppkey * 2)::BIGINT AS value, true AS recovered, 8::BIGINT AS size FROM supplier")
def recovery_scan(spark, sf_dir):
    def make(r):
        w = synth.one_page(b"BT /F1 8 Tf %s Tj ET" % synth.literal(r["s_name"].encode()), F1, extra=FONT)
        w.add(b"1", 7)
        first = w.finish(xref=False)
        return first + b"7 0 obj\n%d\nendobj\n" % (r["s_suppkey"] * 2)

    all_ = Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make)).bundle(
        features={"mask": 4, "columns": ("text",)}, object_nodes={"columns": ("i",), "nums": (7,), "depth": 0}, headers={"columns": ("recovered",)}, trailers={"columns": ("trailer",)}
    )
    size = F.get_json_object(F.col("trailers")[0]["trailer"], "$.v.Size.v").cast("long")
    return all_.select("doc_id", F.col("features")[0]["text"]["text"].alias("name"), F.col("object_nodes")[0]["i"].alias("value"), F.col("headers")[0]["recovered"].alias("recovered"), size.alias("size"))


@query("SELECT c_custkey AS doc_id, num::BIGINT AS num, CASE num WHEN 7 THEN c_custkey * 2 WHEN 6 THEN c_custkey ELSE 0 END::BIGINT AS value FROM customer, (VALUES (1), (2), (3), (4), (5), (6), (7)) v(num)")
def recovery_chunks(spark, sf_dir):
    """Files without a table in chunks of a kilobyte that cut headers: the last of each object, but none of those in streams."""
    from vellum.operators.scan import chunks, markers, recovered

    def make(r):
        k = r["c_custkey"]
        w = synth.one_page(b"", extra={5: synth.stream(b"99 0 obj << >> endobj 7 0 obj 1 endobj"), 6: b"%d" % k, 7: b"%d" % k})
        return w.finish(xref=False).replace(b"6 0 obj", b"%" + b"x" * (k % 1024) + b"\n6 0 obj") + b"%" + b"y" * (700 + k % 13) + b"\n7 0 obj\n%d\nendobj\n" % (k * 2)

    docs = cut(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make), "files")
    found = recovered(markers(chunks(docs, 1024)))
    near = F.decode(F.substring(F.col("content"), F.col("offset").cast("int") + 1, F.lit(40)), "ISO-8859-1")
    value = F.when(F.col("num") >= 6, F.regexp_extract(near, r"obj\s+(\d+)", 1)).otherwise("0").cast("long")
    return found.join(docs, "doc_id").select("doc_id", "num", value.alias("value"))


@query("SELECT c_custkey AS doc_id, c_name AS name, c_nationkey::BIGINT AS nation, round(c_acctbal, 2) AS balance FROM customer")
def object_streams(spark, sf_dir):
    def make(r):
        w = synth.one_page(b"")
        w.add(b"<< /Name /%s /Nation %d /Balance %s >>" % (r["c_name"].replace("#", "#23").encode(), r["c_nationkey"], num(r["c_acctbal"])), 5)
        return w.finish_packed(flate=True)

    n = Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make)).table("object_nodes").where("num = 5 and size(path) = 1")
    of = lambda k, c: F.max(F.when(F.col("path")[0] == k, F.col(c)))
    return n.groupBy("doc_id").agg(of("Name", "s").alias("name"), of("Nation", "i").alias("nation"), F.round(of("Balance", "d"), 2).alias("balance"))


@query("SELECT c_custkey AS doc_id, c_name AS name FROM customer")
def dereference_chain(spark, sf_dir):
    from vellum.operators.layouts import dereference

    def make(r):
        w = synth.one_page(b"")
        w.add(b"6 0 R", 5)
        w.add(b"7 0 R", 6)
        w.add(synth.literal(r["c_name"].encode()), 7)
        return w.finish()

    e = Engine(write_pdfs(dealt(read(spark, sf_dir, "customer")), "c_custkey", make))
    refs = e.table("objects").where("num = 5").select("doc_id", "ref")
    out = dereference(refs, e.table("objects"))
    return out.select("doc_id", F.decode(F.unhex(F.get_json_object("value", "$.v")), "UTF-8").alias("name"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'PDF' AS type, '1.' || (n_nationkey % 8) AS version FROM nation")
def headers(spark, sf_dir):
    def make(r):
        return synth.one_page(b"").finish().replace(b"%PDF-1.7", b"%%PDF-1.%d" % (r["n_nationkey"] % 8), 1)

    return Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make)).table("headers").select("doc_id", "type", "version")


# ---- filters --------------------------------------------------------------------------------------------------------


def _image(data: bytes, width: int, height: int, parms: bytes) -> bytes:
    w = synth.one_page(b"")
    w.add(b"<< /Length %d /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << %s >> >>\nstream\n%s\nendstream" % (len(data), width, height, parms, data), 5)
    return w.finish()


def _bytes_of(spark, sf_dir, make) -> DataFrame:
    rows = gathered(read(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: (x % 256).cast("int")).alias("v"))
    px = Engine(write_pdfs(rows, "user_id", make)).table("image_pixels")
    out = px.select("doc_id", "y", F.posexplode("values").alias("x", "value"))
    width = F.max("x").over(Window.partitionBy("doc_id")) + 1
    return out.select("doc_id", (F.col("y") * width + F.col("x")).cast("int").alias("i"), F.col("value"))


SUMS = "SELECT user_id AS doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS i, CAST(sum(event_id % 256) OVER w % 256 AS INTEGER) AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query(SUMS)
def flate_png_sub(spark, sf_dir):
    return _bytes_of(spark, sf_dir, lambda r: _image(zlib.compress(b"\1" + bytes(r["v"])), len(r["v"]), 1, b"/Predictor 11 /Columns %d" % len(r["v"])))


@query(SUMS)
def flate_png_up(spark, sf_dir):
    return _bytes_of(spark, sf_dir, lambda r: _image(zlib.compress(b"".join(b"\2" + bytes([v]) for v in r["v"])), 1, len(r["v"]), b"/Predictor 12 /Columns 1"))


@query(SUMS)
def flate_png_paeth(spark, sf_dir):
    """With one column, the Paeth guess is the byte above."""
    return _bytes_of(spark, sf_dir, lambda r: _image(zlib.compress(b"".join(b"\4" + bytes([v]) for v in r["v"])), 1, len(r["v"]), b"/Predictor 15 /Columns 1"))


@query(SUMS)
def tiff_predictor(spark, sf_dir):
    return _bytes_of(spark, sf_dir, lambda r: _image(zlib.compress(bytes(r["v"])), len(r["v"]), 1, b"/Predictor 2 /Columns %d" % len(r["v"])))


@query("SELECT user_id AS doc_id, sum(event_id % 256)::BIGINT AS total, count(*) AS n FROM events GROUP BY user_id")
def raw_image_pixels(spark, sf_dir):
    out = _bytes_of(spark, sf_dir, lambda r: _image(zlib.compress(bytes(r["v"])), len(r["v"]), 1, b""))
    return out.groupBy("doc_id").agg(F.sum("value").cast("long").alias("total"), F.count("*").alias("n"))


# ---- functions, geometry, fonts, colour -----------------------------------------------------------------------------


def _function(body: bytes):
    from vellum.core.document import Document
    from vellum.core.functions import parse
    from vellum.core.objects import Ref

    w = synth.one_page(b"")
    w.add(body, 5)
    w.add(b"<< /FunctionType 2 /Domain [0 1] /C0 [1] /C1 [3] /N 2 >>", 6)
    w.add(b"<< /FunctionType 2 /Domain [0 1] /C0 [10] /C1 [20] /N 1 >>", 7)
    return parse(Document(w.finish()), Ref(5, 0))


def _apply(spark, sf_dir, body: bytes, *inputs: str) -> DataFrame:
    from vellum.functions.pdf_functions import compile_function

    outs = compile_function(_function(body), [F.expr(x) for x in inputs])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(f"v{i}") for i, c in enumerate(outs)])


@query("SELECT l_orderkey, l_linenumber, round(0.5 + pow(least(1, greatest(0, l_discount * 10)), 2) * 1.5, 6) AS v0, round(1 - pow(least(1, greatest(0, l_discount * 10)), 2), 6) AS v1 FROM lineitem")
def fn_exponential(spark, sf_dir):
    return _apply(spark, sf_dir, b"<< /FunctionType 2 /Domain [0 1] /C0 [0.5 1] /C1 [2 0] /N 2 >>", "l_discount * 10")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0.5 THEN 1 + pow(x / 0.5, 2) * 2 ELSE 10 + (1 - (x - 0.5) / 0.5) * 10 END, 6) AS v0 FROM (SELECT *, least(1, greatest(0, l_discount * 10)) AS x FROM lineitem)")
def fn_stitching(spark, sf_dir):
    return _apply(spark, sf_dir, b"<< /FunctionType 3 /Domain [0 1] /Functions [6 0 R 7 0 R] /Bounds [0.5] /Encode [0 1 1 0] >>", "l_discount * 10")


@query("SELECT l_orderkey, l_linenumber, round([0, 51, 255, 102, 204][i + 1] / 255.0 + (x * 4 - i) * ([0, 51, 255, 102, 204][least(i + 1, 4) + 1] - [0, 51, 255, 102, 204][i + 1]) / 255.0, 6)::DOUBLE AS v0 FROM (SELECT *, CAST(floor(x * 4) AS INTEGER) AS i FROM (SELECT *, least(1, greatest(0, l_discount * 10)) AS x FROM lineitem))")
def fn_sampled(spark, sf_dir):
    return _apply(spark, sf_dir, synth.stream(bytes([0, 51, 255, 102, 204]), b"/FunctionType 0 /Domain [0 1] /Range [0 1] /Size [5] /BitsPerSample 8"), "l_discount * 10")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN sqrt(l_quantity) * l_discount ELSE l_quantity / (1 + l_discount) END, 6) AS v0, round(l_quantity - 3 * trunc(l_quantity / 3), 6) AS v1 FROM lineitem")
def fn_calculator(spark, sf_dir):
    program = b"{ 1 index 25 gt { 1 index sqrt mul } { 1 add 1 index exch div } ifelse exch cvi 3 mod }"
    return _apply(spark, sf_dir, synth.stream(program, b"/FunctionType 4 /Domain [0 1000 0 1] /Range [0 1000 0 1000]"), "l_quantity", "l_discount")


@query("SELECT a.p_partkey AS k, (least(a.p_size + 30, b.p_size + 20) - greatest(a.p_size, b.p_size))::DOUBLE AS width FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE least(a.p_size + 30, b.p_size + 20) > greatest(a.p_size, b.p_size)")
def rect_intersection(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    a, b = p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_size").alias("t"))
    both = G.intersection(G.rect(F.col("s"), F.lit(0), F.lit(30), F.lit(10)), G.rect(F.col("t"), F.lit(0), F.lit(20), F.lit(10)))
    return a.join(b, "k").select("k", both["width"].alias("width")).where("width is not null")


@query("SELECT p_partkey AS k, (2 * p_size)::DOUBLE AS width, (p_size + 3)::DOUBLE AS y, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM part")
def matrix_transform(spark, sf_dir):
    m = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), (0, 1, -2, 0, 5, 3), strict=True)])
    r = G.rect(F.col("p_size"), F.lit(1), F.lit(4), F.col("p_size"))
    turned, o = G.transform(m, r), G.orientation(m)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), turned["width"].alias("width"), turned["y"].alias("y"), o["a"].alias("a"), o["b"].alias("b"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(c AS INTEGER) AS code, CASE c WHEN 65 THEN 'g' || n_nationkey WHEN 66 THEN 'h' || n_nationkey WHEN 67 THEN 'C' WHEN 233 THEN 'eacute' WHEN 128 THEN 'Euro' END AS glyph FROM nation, (VALUES (65), (66), (67), (233), (128)) v(c)")
def encoding_differences(spark, sf_dir):
    from vellum.operators.text import base_encodings, glyph_names

    def make(r):
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /g%d /h%d] >> >>" % (r["n_nationkey"], r["n_nationkey"])
        return synth.one_page(b"", F1, extra={5: font}).finish()

    e = Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make))
    codes = e.table("fonts").select("doc_id", "num", "gen", "encoding", F.explode(F.array(*map(F.lit, (65, 66, 67, 233, 128)))).alias("code"))
    return glyph_names(codes, e.table("font_differences"), base_encodings(spark)).select("doc_id", "code", "glyph")


@query("SELECT s_suppkey AS doc_id, c::BIGINT AS cid, (CASE WHEN c BETWEEN 10 AND 10 + s_suppkey % 20 THEN 600 WHEN c BETWEEN 20 AND 40 THEN 700 WHEN c = 50 THEN 300 WHEN c = 51 THEN 310 ELSE 450 END)::DOUBLE AS width FROM supplier, range(0, 60) t(c)")
def cid_widths(spark, sf_dir):
    from vellum.operators.text import cid_widths as join_widths

    def make(r):
        kids = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /DW 450 /W [10 %d 600 20 40 700 50 [300 310]] >>" % (10 + r["s_suppkey"] % 20)
        return synth.one_page(b"", F1, extra={**TYPE0, 6: kids}).finish()

    e = Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make))
    codes = e.table("fonts").select("doc_id", "num", "gen", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("cid"))
    return join_widths(codes, e.table("cid_widths")).select("doc_id", "cid", "width")


@query("SELECT s_suppkey AS doc_id, CAST(code AS INTEGER) AS code, (CASE WHEN code < 40 THEN 500 + code ELSE 250 END)::DOUBLE AS width FROM supplier, range(32, 48) t(code)")
def simple_widths(spark, sf_dir):
    from vellum.operators.text import simple_widths as join_widths

    font = b"<< /Type /Font /Subtype /TrueType /BaseFont /X /FirstChar 32 /Widths [%s] >>" % b" ".join(b"%d" % (500 + c) for c in range(32, 40))
    e = Engine(write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", lambda r: synth.one_page(b"", F1, extra={5: font}).finish()))
    codes = e.table("fonts").select("doc_id", "num", "gen", F.explode(F.sequence(F.lit(32), F.lit(47))).alias("code"))
    return join_widths(codes, e.table("font_widths"), 250.0).select("doc_id", "code", "width")


@query("SELECT p_partkey AS doc_id, p_size::BIGINT AS width, (p_partkey % 7 + 1)::BIGINT AS height, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 8 END AS INTEGER) AS bits, p_partkey % 3 = 0 AS mask, CASE p_partkey % 3 WHEN 1 THEN 'jpeg' ELSE 'raw' END AS encoding, CASE p_partkey % 3 WHEN 0 THEN 'DeviceGray' WHEN 1 THEN 'DeviceRGB' ELSE 'DeviceCMYK' END AS space FROM part")
def image_metadata(spark, sf_dir):
    def make(r):
        extra = [b"/ImageMask true", b"/ColorSpace /DeviceRGB /Filter /DCTDecode", b"/ColorSpace /DeviceCMYK /BitsPerComponent 8"][r["p_partkey"] % 3]
        return synth.one_page(b"", IM, extra={6: synth.stream(b"\xff\xd8", b"/Subtype /Image /Width %d /Height %d %s" % (r["p_size"], r["p_partkey"] % 7 + 1, extra))}).finish()

    return Engine(write_pdfs(dealt(read(spark, sf_dir, "part")), "p_partkey", make)).table("images").select("doc_id", "width", "height", "bits", "mask", "encoding", "space")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, k AS key, CASE k WHEN 'A' THEN 'Indexed' WHEN 'B' THEN 'Separation' ELSE 'ICCBased' END AS kind, CAST(CASE k WHEN 'C' THEN 4 ELSE 1 END AS INTEGER) AS components, k = 'C' AS is_cmyk, CASE k WHEN 'A' THEN 'DeviceRGB' WHEN 'B' THEN 'DeviceCMYK' END AS base FROM nation, (VALUES ('A'), ('B'), ('C')) v(k)")
def color_spaces(spark, sf_dir):
    def make(r):
        cs = b"/ColorSpace << /A [/Indexed /DeviceRGB 1 <%06x%06x>] /B [/Separation /Spot /DeviceCMYK 5 0 R] /C [/ICCBased 6 0 R] >>" % (r["n_nationkey"], r["n_nationkey"] * 3)
        return synth.one_page(b"", cs, extra={5: b"<< /FunctionType 2 /Domain [0 1] /C0 [0 0 0 0] /C1 [0 0 0 1] /N 1 >>", 6: synth.stream(b"", b"/N 4")}).finish()

    return Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make)).table("color_spaces").select("doc_id", "key", "kind", "components", "is_cmyk", "base")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, ['Normal', 'Multiply', 'Screen', 'Darken'][n_nationkey % 4 + 1] AS blend, (n_nationkey / 100.0)::DOUBLE AS alpha, (n_nationkey + 0.5)::DOUBLE AS line_width, (n_nationkey / 100.0)::DOUBLE AS drawn FROM nation")
def blend_gstate(spark, sf_dir):
    def make(r):
        n = r["n_nationkey"]
        gs = b"/ExtGState << /G << /BM [/%s /Normal] /ca %s /LW %s >> >>" % ([b"Normal", b"Multiply", b"Screen", b"Darken"][n % 4], num(n / 100), num(n + 0.5))
        return synth.one_page(b"/G gs 0 0 1 1 re f", gs).finish()

    e = Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make))
    drawn = e.table("display_list").select("doc_id", F.round("alpha", 6).alias("drawn"))
    return e.table("ext_gstates").join(drawn, "doc_id").select("doc_id", "blend", F.round("fill_alpha", 6).alias("alpha"), F.round("line_width", 6).alias("line_width"), "drawn")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS seq, CASE i WHEN 0 THEN n_nationkey / 25.0 WHEN 1 THEN 1 - n_nationkey / 25.0 ELSE 0.5 END::DOUBLE AS red FROM nation, (VALUES (0), (1), (2)) v(i)")
def color_evaluate(spark, sf_dir):
    """A spot colour through its tint function, a CMYK colour, and a stand-in for the gray device."""

    def make(r):
        t = num(r["n_nationkey"] / 25)
        cs = b"/ColorSpace << /Spot [/Separation /Gold /DeviceRGB << /FunctionType 2 /Domain [0 1] /C0 [0 0 0] /C1 [1 0 0] /N 1 >>] /DefaultGray [/Separation /Half /DeviceRGB << /FunctionType 2 /Domain [0 1] /C0 [0.5 0 0] /C1 [0.5 1 1] /N 1 >>] >>"
        return synth.one_page(b"/Spot cs %s scn 0 0 1 1 re f %s 0 0 0 k 0 0 1 1 re f 0.25 g 0 0 1 1 re f" % (t, t), cs).finish()

    d = Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make)).table("display_list")
    return d.select("doc_id", "seq", F.round(F.col("rgb")[0], 6).alias("red"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(2 + n_nationkey % 2 AS INTEGER) AS type, 'DeviceRGB' AS space, (n_nationkey / 50.0)::DOUBLE AS middle FROM nation")
def shadings(spark, sf_dir):
    def make(r):
        n = r["n_nationkey"]
        sh = b"/Shading << /S << /ShadingType %d /ColorSpace /DeviceRGB /Coords [%s] /Function << /FunctionType 2 /Domain [0 1] /C0 [0 0 0] /C1 [%s 0 0] /N 1 >> >> >>" % (2 + n % 2, [b"0 0 1 1", b"0 0 1 2 2 3"][n % 2], num(n / 25))
        return synth.one_page(b"/S sh", sh).finish()

    s = Engine(write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", make)).table("shadings")
    return s.select("doc_id", "type", "space", F.round(F.col("samples")[2][0], 6).alias("middle"))


# ---- encryption and errors ------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS doc_id, s_name AS text FROM supplier")
def rc4_text(spark, sf_dir):
    def make(r):
        w = synth.one_page(b"")
        trailer, key = synth.rc4_40(w, b"pdf", b"owner")
        w.objects[4] = synth.stream(synth.arcfour(synth.object_key(key, 4), b"BT /F1 12 Tf %s Tj ET" % synth.literal(r["s_name"].encode())))
        return w.finish(trailer=trailer)

    docs = write_pdfs(dealt(read(spark, sf_dir, "supplier")), "s_suppkey", make)
    return Engine(docs, password="pdf").features(("text",)).select("doc_id", F.col("text.text").alias("text"))


@query("SELECT s_suppkey AS doc_id, s_name AS text FROM supplier")
def aes_text(spark, sf_dir):
    trailer, key = synth.aes_128(b"pdf", b"owner")
    content = F.concat(F.lit(b"BT /F1 12 Tf ("), F.encode(F.col("s_name"), "UTF-8"), F.lit(b") Tj ET"))
    sealed = F.aes_encrypt(content, F.lit(synth.object_key(key, 4, aes=True)), F.lit("CBC"), F.lit("PKCS"))

    def make(r):
        w = synth.one_page(b"")
        w.objects[4] = synth.stream(r["sealed"])
        return w.finish(trailer=trailer)

    docs = write_pdfs(dealt(read(spark, sf_dir, "supplier").select("s_suppkey", sealed.alias("sealed"))), "s_suppkey", make)
    return Engine(docs, password="pdf").features(("text",)).select("doc_id", F.col("text.text").alias("text"))


@query("SELECT p_partkey AS doc_id, ['headerNotFound', 'unknownOperator', 'expectedOperator', 'missingRequiredParameters', 'unsupportedFilter', 'missingLength'][p_partkey % 6 + 1] AS failure, CASE WHEN p_partkey % 6 IN (1, 2, 3) THEN 1 ELSE 0 END::BIGINT AS kept FROM part")
def parse_errors(spark, sf_dir):
    """What comes before a failure is kept; the failure is a row."""

    def make(r):
        k = r["p_partkey"] % 6
        if k in (1, 2, 3):
            tail = [b"", b"5 nonsense (y) Tj", b"/T1_1 ", b"1 Td (y) Tj"][k]
            return synth.one_page(b"BT /F1 9 Tf (x) Tj " + tail, F1, extra=FONT).finish()
        w = synth.one_page(b"")
        if k == 4:
            w.objects[4] = synth.stream(b"x", b"/Filter /LZWDecode")
        if k == 5:
            w.objects[4] = b"<< >>\nstream\nx\nendstream"
        out = w.finish()
        return out if k else b"no header here" + out[8:]

    e = Engine(write_pdfs(dealt(read(spark, sf_dir, "part")), "p_partkey", make))
    kept = e.features(("text",)).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return e.table("parse_errors").select("doc_id", "failure").join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))


# ---- whole listings -------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name, '' || n_nationkey AS k, 1 + length(replace(n_name, ' ', '#20')) AS e, length('' || n_nationkey) AS d FROM nation),
p AS (SELECT *, e + 1 AS s1, e + 4 + d AS s2 FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS seq, kind, CASE i WHEN 0 THEN n_name WHEN 1 THEN lower(hex(encode(k))) WHEN 3 THEN '1' WHEN 4 THEN '2.5' WHEN 7 THEN 'K' WHEN 8 THEN '4142' ELSE '' END AS text,
CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN s1 ELSE s2 + o END AS BIGINT) AS start, CAST(CASE i WHEN 0 THEN e WHEN 1 THEN s1 + d + 2 ELSE s2 + o + n END AS BIGINT) AS "end"
FROM p, (VALUES (0, 'name', 0, 0), (1, 'string', 0, 0), (2, 'left', 0, 1), (3, 'int', 1, 1), (4, 'real', 3, 3), (5, 'right', 6, 1), (6, 'open', 8, 2), (7, 'name', 11, 2), (8, 'string', 14, 6), (9, 'close', 21, 2)) v(i, kind, o, n)""")
def token_dump(spark, sf_dir):
    from vellum.functions.udtf import register

    register(spark)
    docs = write_pdfs(read(spark, sf_dir, "nation"), "n_nationkey", lambda r: b"/%s (%d) [1 2.5] << /K <4142> >> %% end" % (r["n_name"].replace(" ", "#20").encode(), r["n_nationkey"]))
    docs.createOrReplaceTempView("vellum_token_docs")
    return spark.sql("SELECT doc_id, t.* FROM vellum_token_docs, LATERAL pdf_tokens(content) t")


@query("""WITH n AS (SELECT c_nationkey AS d, c_custkey AS c, c_name, 100 + dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS k FROM customer),
own AS (SELECT d, k, c, row_number() OVER (PARTITION BY d, k ORDER BY c) - 1 AS i FROM n), r AS (SELECT DISTINCT d, k FROM n), f AS (SELECT DISTINCT d FROM n),
box AS (SELECT d, k, unnest([0, 1, 2, 3]) AS i FROM r),
listed AS (
SELECT d, 1 AS num, 0 AS a, 0 AS b, 0 AS depth, '' AS key, 'dictionary' AS kind, '2 entries' AS shown FROM f UNION ALL SELECT d, 1, 1, 0, 1, 'Pages', 'reference', '2 0 R' FROM f UNION ALL SELECT d, 1, 2, 0, 1, 'Type', 'name', 'Catalog' FROM f
UNION ALL SELECT d, 2, 0, 0, 0, '', 'dictionary', '3 entries' FROM f UNION ALL SELECT d, 2, 1, 0, 1, 'Count', 'integer', '' || count(*) FROM n GROUP BY d UNION ALL SELECT d, 2, 2, 0, 1, 'Kids', 'array', count(*) || ' items' FROM r GROUP BY d
UNION ALL SELECT d, 2, 3, k - 101, 2, '' || (k - 101), 'reference', k || ' 0 R' FROM r UNION ALL SELECT d, 2, 4, 0, 1, 'Type', 'name', 'Pages' FROM f
UNION ALL SELECT d, k, 0, 0, 0, '', 'dictionary', '5 entries' FROM r UNION ALL SELECT d, k, 1, 0, 1, 'Count', 'integer', '' || count(*) FROM own GROUP BY d, k UNION ALL SELECT d, k, 2, 0, 1, 'Kids', 'array', count(*) || ' items' FROM own GROUP BY d, k
UNION ALL SELECT d, k, 3, i, 2, '' || i, 'reference', (200 + c) || ' 0 R' FROM own UNION ALL SELECT d, k, 4, 0, 1, 'MediaBox', 'array', '4 items' FROM r
UNION ALL SELECT d, k, 5, i, 2, '' || i, 'integer', '' || [0, 0, k, 50][i + 1] FROM box UNION ALL SELECT d, k, 6, 0, 1, 'Parent', 'reference', '2 0 R' FROM r UNION ALL SELECT d, k, 7, 0, 1, 'Type', 'name', 'Pages' FROM r
UNION ALL SELECT d, 200 + c, 0, 0, 0, '', 'dictionary', '3 entries' FROM n UNION ALL SELECT d, 200 + c, 1, 0, 1, 'Parent', 'reference', k || ' 0 R' FROM n
UNION ALL SELECT d, 200 + c, 2, 0, 1, 'PieceInfo', 'string', lower(hex(encode(c_name))) FROM n UNION ALL SELECT d, 200 + c, 3, 0, 1, 'Type', 'name', 'Page' FROM n)
SELECT d::BIGINT AS doc_id, num::BIGINT AS num, 0::BIGINT AS gen, CAST(row_number() OVER (PARTITION BY d, num ORDER BY a, b) - 1 AS INTEGER) AS row, CAST(depth AS INTEGER) AS depth, key, kind, shown FROM listed""")
def object_display_rows(spark, sf_dir):
    return _tree(spark, sf_dir).table("object_rows")


@query("SELECT user_id AS doc_id, 0 AS page_index, CAST(i AS INTEGER) AS seq, verb, what FROM (SELECT DISTINCT user_id FROM events), (VALUES (0, 'text0', 'x'), (1, 'image', 'Im')) v(i, verb, what)")
def display_list(spark, sf_dir):
    return _users(spark, sf_dir).table("display_list", columns=("page_index", "seq", "verb", "what"))
