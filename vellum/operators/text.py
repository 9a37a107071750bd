"""Text as relations: parts of one TJ put together, widths joined to codes, text decoded by mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.ranges import first_match


def combine_runs(runs: DataFrame) -> DataFrame:
    """text_runs to one row per operator: the union of the boxes and the parts' text in order."""
    right, top = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    g = runs.groupBy("doc_id", "page_index", "seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        right.alias("_r"),
        top.alias("_t"),
        F.min_by("size", "part").alias("size"),
    )
    return g.select("doc_id", "page_index", "seq", "text", "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_t") - F.col("y")).alias("height"), "size")


def simple_widths(codes: DataFrame, widths: DataFrame, missing: float = 0.0) -> DataFrame:
    """codes (doc_id, num, gen, code, ...) with the font's width of each code: an equi-join, with the missing width where there is none."""
    return codes.join(widths, ["doc_id", "num", "gen", "code"], "left").withColumn("width", F.coalesce("width", F.lit(missing)))


def cid_widths(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """codes (doc_id, num, gen, cid) with the width of the first range that holds the cid, else the font's default."""
    key = ["doc_id", "num", "gen"]
    default = ranges.groupBy(*key).agg(F.max("default_width").alias("_d"))
    held = first_match(codes, ranges.where("lo is not null").select(*key, "pos", "lo", "hi", "width"), key, "cid", ["width"])
    return held.join(default, key, "left").withColumn("width", F.coalesce("width", "_d", F.lit(1000.0))).drop("_d")


def code_steps(data: Column, spaces: Column) -> Column:
    """The codes of a string as array<struct<at, bytes, code>>, by spaces array<struct<pos, bytes, lo, hi>> in their order.

    At each byte the first space that fits and holds the next bytes says how many they are; a byte that none takes is passed
    over. Which bytes begin a code is found by doubling: the places reached in 2^k steps, and whither 2^k steps lead from each place.
    """
    n = F.octet_length(data)

    def step(at: Column) -> Column:
        left = n - at
        tried = F.transform(spaces, lambda s: F.struct(s["bytes"].cast("int").alias("bytes"), s["lo"].alias("lo"), s["hi"].alias("hi"), F.conv(F.hex(F.substring(data, at + 1, s["bytes"])), 16, 10).cast("long").alias("code")))
        fits = F.filter(tried, lambda t: (t["bytes"] <= left) & t["code"].between(t["lo"], t["hi"]))
        return F.transform(F.slice(fits, 1, 1), lambda t: F.struct(at.alias("at"), t["bytes"].alias("bytes"), t["code"].alias("code")))

    def walked(steps: Column) -> Column:
        onward = F.concat(F.transform(steps, lambda s, i: i + F.coalesce(F.get(s, F.lit(0))["bytes"], F.lit(1))), F.array(n))
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + 1)).cast("int")))
        walk = F.aggregate(
            rounds,
            F.struct(onward.alias("jump"), F.array(F.lit(0)).alias("seen")),
            lambda w, _: F.struct(F.transform(w["jump"], lambda x: F.get(w["jump"], x)).alias("jump"), F.array_union(w["seen"], F.transform(w["seen"], lambda x: F.get(w["jump"], x))).alias("seen")),
        )
        return F.flatten(F.transform(F.array_sort(F.filter(walk["seen"], lambda x: x < n)), lambda x: F.get(steps, x)))

    # A lambda's argument is computed once; as an expression inside of one, the steps would be made anew for each code.
    steps = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), step)
    return F.get(F.transform(F.array(steps), walked), F.lit(0))


def decode_codes(strings: DataFrame, codespaces: DataFrame, mappings: DataFrame) -> DataFrame:
    """strings (doc_id, num, gen, sid, bytes) with the text that ToUnicode mappings give; codes may have several lengths.

    Of several mappings that hold a code the least position counts, and codes without one give nothing.
    """
    key = ["doc_id", "num", "gen"]
    own = codespaces.where("of = 'unicode'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "bytes", "lo", "hi"))).alias("_spaces"))
    rows = strings.join(own, key).select(*key, "sid", F.explode(code_steps(F.col("bytes"), F.col("_spaces"))).alias("_c")).select(*key, "sid", F.col("_c.at").alias("_i"), F.col("_c.code").alias("_code"))
    hits = first_match(rows, mappings.select(*key, "pos", "lo", "hi", F.col("text").alias("_t")), key, "_code", ["lo", "_t"]).where("_t is not null")
    shifted = F.concat(F.left(F.col("_t"), F.length("_t") - 1), F.expr("decode(unhex(lpad(hex(ascii(right(_t, 1)) + _code - lo), 8, '0')), 'UTF-32')"))
    char = F.when(F.col("_code") == F.col("lo"), F.col("_t")).otherwise(F.when(F.length("_t") > 0, shifted).otherwise(""))
    out = hits.select(*key, "sid", "_i", char.alias("c")).groupBy(*key, "sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "c"))), lambda x: x["c"]), "").alias("text"))
    return strings.join(out, [*key, "sid"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def glyph_names(codes: DataFrame, differences: DataFrame, base: DataFrame) -> DataFrame:
    """codes (doc_id, num, gen, encoding, code) with the glyph: the font's difference, else its base encoding's. base has a few hundred rows per encoding."""
    d = differences.select("doc_id", "num", "gen", "code", F.col("glyph").alias("_g"))
    out = codes.join(d, ["doc_id", "num", "gen", "code"], "left").join(F.broadcast(base), ["encoding", "code"], "left")
    return out.withColumn("glyph", F.coalesce("_g", "glyph")).drop("_g")


def base_encodings(spark) -> DataFrame:
    """(encoding, code, glyph): 7 x 256 rows at most."""
    from vellum.core.glyphs import encoding
    from vellum.core.symbolic import TABLES

    rows = [(n, c, g) for n in ("StandardEncoding", "WinAnsiEncoding", "MacRomanEncoding", *TABLES) for c, g in encoding(n).items()]
    return spark.createDataFrame(rows, "encoding string, code int, glyph string")
