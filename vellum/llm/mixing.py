"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's documents stand in an order seeded by a hash.  While one set of sources lasts (a phase), every source has to
deliver its weight's share of the phase's characters.  A phase is cut into equal frames; in each, a source has a whole
number of blocks, a of the frame's q slots, and its blocks are cut so that they hold exactly its share of the characters:
they differ in size from source to source (by half at most where its share is half a slot or more), never within one.
Block i (from 0) of a frame is released at slot floor(i q / a) and is due by slot ceil((i + 1) q / a); each slot goes to the
released block that is due first (ties: the one whose deadline is not shared with its successor's window, then the heavier
source, then the smaller name).  All frames of a phase are alike, so one is scheduled (``frame`` slots, or one for each
source if those are more) and a block finds its slot by division: no step grows with the corpus, and at every slot each
source is less than one of its blocks from its share, however long the phase.

When a source ends, the rest go on with their weights in proportion, so no document is dropped or repeated.  Where weights
are not given, they follow the power ``alpha`` of a source's characters, which are counted over all documents.

A document counts its characters and one more for its end, and stands in the block in which it begins.  A block that lies
inside one long document has no document of its own: its slot is that document's, too.

Sources are the parts of a mixture: one row holds an entry for each of them, and phases x sources are rows.

Defined results: null sources form a source of their own; null texts have length 0; sources without a weight, or with one
of zero or less, come after the others in the order of their names; rows that repeat id, source and text share their place;
an empty table gives no rows; other columns come through whatever their names, except those named like the ones added
(``block``, ``slot``, ``at_char``), which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup


#: Slots that are folded at a time; it bounds the copying of the slots so far, not the schedule.
STRIDE = 500


def frame_slots(shares: Column) -> Column:
    """array<struct<source, k, slot>>: the earliest-deadline-first schedule of one frame.

    shares: array<struct<source string, a long>> whose a add up to the number of slots.  The fold keeps the blocks done
    per source; it is an expression over one row per phase, so its time is slots x sources.
    """
    shares = F.transform(shares, lambda x: F.struct(x["source"].alias("source"), x["a"].cast("long").alias("a")))
    total = F.aggregate(shares, F.lit(0).cast("long"), lambda s, x: s + x["a"])
    none = F.expr("cast(array() as array<struct<i int, k long, slot long>>)")

    def step(state: Column, t: Column) -> Column:
        # done[i]: blocks so far; the next one's window is [done * q / a, ceil((done + 1) * q / a))
        def window(x: Column, i: Column) -> Column:
            end = (F.get(state["done"], i) + 1) * state["q"]
            return F.struct(
                F.call_function("div", end - state["q"], x["a"]).alias("release"),
                F.call_function("div", end + x["a"] - 1, x["a"]).alias("due"),
                F.when(end % x["a"] == 0, 1).otherwise(0).alias("whole"),
                (-x["a"]).alias("light"),
                i.alias("i"),
            )

        keyed = F.filter(F.transform(state["shares"], window), lambda y: y["release"] <= t)
        best = F.array_min(F.transform(keyed, lambda y: F.struct(y["due"], y["whole"], y["light"], y["i"])))["i"]
        return _let(
            best,
            lambda i: F.struct(
                state["shares"].alias("shares"),
                state["q"].alias("q"),
                F.transform(state["done"], lambda d, j: d + F.when(j == i, 1).otherwise(0)).alias("done"),
                F.concat(state["slots"], F.array(F.struct(i.cast("int").alias("i"), F.get(state["done"], i).alias("k"), t.alias("slot")))).alias("slots"),
            ),
        )

    def stride(state: Column, at: Column) -> Column:
        fresh = F.struct(state["shares"].alias("shares"), state["q"].alias("q"), state["done"].alias("done"), none.alias("slots"))
        folded = F.aggregate(F.sequence(at, F.least(at + STRIDE, state["q"]) - 1), fresh, step)
        return _let(folded, lambda f: F.struct(f["shares"].alias("shares"), f["q"].alias("q"), f["done"].alias("done"), F.concat(state["parts"], F.array(f["slots"])).alias("parts")))

    first = F.struct(shares.alias("shares"), total.alias("q"), F.transform(shares, lambda x: F.lit(0).cast("long")).alias("done"), F.expr("cast(array() as array<array<struct<i int, k long, slot long>>>)").alias("parts"))
    done = _let(first, lambda f: F.aggregate(F.sequence(F.lit(0).cast("long"), f["q"] - 1, F.lit(STRIDE).cast("long")), f, stride))
    return _let(done, lambda d: F.transform(F.flatten(d["parts"]), lambda x: F.struct(F.get(d["shares"], x["i"])["source"].alias("source"), x["k"].alias("k"), x["slot"].alias("slot"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def phases(sources: DataFrame, block_chars: int, frame: int = 1000) -> DataFrame:
    """(phase, source, first_char, n_chars, a, q, frames): who delivers what while one set of sources lasts.

    sources: source, w, chars.  A source lasts until chars / w in a virtual time in which every source moves at its weight;
    phase p lies between the ends of the sources p - 1 and p in that order.  Sources without weight follow one by one.
    """
    live = sources.where("chars > 0").withColumn("w", F.when(F.col("w") > 0, F.col("w")))
    ends = live.select("*", (F.col("chars") / F.col("w")).alias("end")).groupBy().agg(F.collect_list(F.struct("end", "source", "w", "chars")).alias("all"))
    # One row: it has an entry for each source.
    weighted, bare = F.filter("all", lambda x: x["w"].isNotNull()), F.filter("all", lambda x: x["w"].isNull())
    ordered = ends.select(F.array_sort(weighted).alias("s"), F.array_sort(F.transform(bare, lambda x: F.struct(x["source"].alias("source"), x["chars"].alias("chars")))).alias("z"))
    per = ordered.select("s", F.posexplode("s").alias("phase", "last"))
    per = per.withColumn("from_t", F.when(F.col("phase") > 0, F.get("s", F.col("phase") - 1)["end"]).otherwise(F.lit(0.0)))
    rows = per.select("phase", "from_t", F.col("last.end").alias("to_t"), F.explode(F.slice("s", F.col("phase") + 1, F.size("s"))).alias("x"))
    cut = lambda t: F.least(F.floor(F.col("x.w") * F.col(t)), F.col("x.chars")).cast("long")
    end = F.when(F.col("x.end") <= F.col("to_t"), F.col("x.chars")).otherwise(cut("to_t"))
    rows = rows.select("phase", "x.source", cut("from_t").alias("first_char"), (end - cut("from_t")).alias("n_chars"))
    n = ordered.select(F.size("s").alias("n"), F.posexplode("z").alias("i", "z"))
    rest = n.select((F.col("n") + F.col("i")).cast("int").alias("phase"), "z.source", F.lit(0).cast("long").alias("first_char"), F.col("z.chars").alias("n_chars"))
    part = Window.partitionBy("phase")
    rows = rows.unionByName(rest).where("n_chars > 0").withColumns({"all": F.sum("n_chars").over(part), "several": F.count("*").over(part) > 1})
    rows = rows.withColumn("slots", F.ceil(F.col("all") / block_chars))
    share = F.least(F.col("slots"), F.lit(frame)) * F.col("n_chars") / F.col("all")
    rows = rows.withColumn("a", F.when(F.col("several"), F.greatest(F.lit(1), F.round(share))).otherwise(1).cast("long"))
    rows = rows.withColumn("q", F.sum("a").over(part))
    return rows.select("phase", "source", "first_char", "n_chars", "a", "q", F.greatest(F.lit(1), F.round(F.col("slots") / F.col("q"))).cast("long").alias("frames"))


def mix(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str | None, float] | None = None, alpha: float = 0.5, block_chars: int = 65_536, frame: int = 1000, seed: int = 0) -> DataFrame:
    """docs with block (of its source), slot (of the block in the mixture) and at_char (place in the source's order)."""
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("-"))
    size = (F.coalesce(F.length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    names = {"_s": source, "_id": F.col(id_col), "_t": F.xxhash64(F.col(text_col))}
    keyed = docs.select(*[c.alias(n) for n, c in names.items()], size.alias("_len"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"))
    totals = scratch.write(keyed.groupBy("_s").agg(F.sum("_len").alias("chars"), F.count("*").alias("n")), "totals")
    rows = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = max(64, -(-rows // 5_000))
    # Places in a source's order, in two steps: within a salt, then over the salts' totals. Salts are ranges of the hash.
    keyed = keyed.withColumn("_b", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * salts))
    keyed = keyed.groupBy("_s", "_b", "_h", "_id", "_t", "_len").agg(F.count("*").alias("_n"))  # equal rows share a place
    inner = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "_t").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_in", F.coalesce(F.sum(F.col("_len") * F.col("_n")).over(inner), F.lit(0)))
    sums = keyed.groupBy("_s", "_b").agg(F.sum(F.col("_len") * F.col("_n")).alias("_all"))
    outer = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_s", "_b", F.coalesce(F.sum("_all").over(outer), F.lit(0)).alias("_before"))
    placed = scratch.write(keyed.join(sums, ["_s", "_b"]).select("_s", "_id", "_t", "_h", (F.col("_before") + F.col("_in")).alias("at_char")), "placed")
    # The plan: its tables grow with the sources, not with the documents.
    if weights is None:
        w = F.pow(F.col("chars").cast("double"), F.lit(float(alpha)))
    else:
        w = F.lit(None).cast("double")
        for k, v in weights.items():
            w = F.when(F.col("_s") == ("-" if k is None else f"s{k}"), F.lit(float(v))).otherwise(w)
    parts = scratch.write(phases(totals.select(F.col("_s").alias("source"), w.alias("w"), "chars"), block_chars, frame), "phases")
    each = parts.groupBy("phase", "q", "frames").agg(F.array_sort(F.collect_list(F.struct("source", "a"))).alias("shares"))
    slots = each.select("phase", F.explode(frame_slots(F.col("shares"))).alias("x")).select("phase", F.col("x.source").alias("_s"), F.col("x.k").alias("_k"), F.col("x.slot").alias("_at"))
    slots = scratch.write(slots, "slots")
    earlier = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)  # a row for each phase
    starts = each.select("phase", F.coalesce(F.sum(F.col("q") * F.col("frames")).over(earlier), F.lit(0)).alias("first_slot"))
    done = Window.partitionBy("source").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first_block", F.coalesce(F.sum(F.col("a") * F.col("frames")).over(done), F.lit(0))).join(starts, "phase")
    parts = scratch.write(parts.withColumnRenamed("source", "_s"), "plan")
    found = lookup(placed, parts, ["_s"], F.col("_h")).where("at_char >= first_char and at_char < first_char + n_chars")
    blocks = F.col("a") * F.col("frames")
    j = F.least(F.floor((F.col("at_char") - F.col("first_char")) / F.col("n_chars") * blocks), blocks - 1).cast("long")
    found = found.withColumn("_j", j).withColumns({"_k": F.col("_j") % F.col("a"), "_f": F.call_function("div", F.col("_j"), F.col("a"))})
    found = lookup(found, slots, ["phase", "_s", "_k"], F.col("_h"))
    place = {"block": F.col("first_block") + F.col("_j"), "slot": F.col("first_slot") + F.col("_f") * F.col("q") + F.col("_at"), "at_char": F.col("at_char")}
    found = found.select("_s", "_id", "_t", *[c.cast("long").alias(n) for n, c in place.items()])
    # Input columns travel in a struct, where their names cannot clash.
    kept = [c for c in docs.columns if c not in place]
    back = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *[c.alias(n) for n, c in names.items()])
    on = (back["_s"] == found["_s"]) & back["_id"].eqNullSafe(found["_id"]) & (back["_t"] == found["_t"])
    return back.join(found, on).select("_row.*", *[found[c] for c in place])
