"""URL filtering by association rules.

FP-growth (Spark's own) finds the combinations of URL tokens that occur together among the bad ones of the labelled pages
that are mined (three quarters of them, by a hash of the url).  A combination is a rule "these tokens: bad" if, among the
mined pages, it has the support (``min_count``), its confidence is ``min_lift`` times the share of bad pages, and that share lies
below the lower end of the confidence's interval (``sure`` standard errors, Wilson); if, among the pages that were held
out, it has some and more of them are bad than that share; and if no part of it is a rule that is as sure.  Of tokens that
stand in the very same pages the greatest stands for all.

Rules meet all URLs through an inverted index: each rule is filed under the rarest of its tokens, so a URL looks at few
rules.  Fixed host and path rules come first; the longest that fits decides.  The mined rules judge what no fixed rule fits.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule, so it is allowed;
repeated rows are judged each on its own and count each among labelled pages; equally sure rules: the greater list of
tokens is told; without labels there are no mined rules; an empty table gives no rows; other columns are not read.
Frequent tokens are at most tokens per url / min_support, whatever the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, low).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels with their place from the end, path segments, and their shape when they are numbers."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "0")))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    return F.array_distinct(F.concat(hosts, paths, words))


def frequent(rows: DataFrame, min_count: int, min_support: float, most: int) -> DataFrame:
    """(tokens, n): sorted combinations of up to ``most`` tokens that min_count of rows(t) hold, and min_support of them."""
    from pyspark.ml.fpm import FPGrowth

    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "tokens array<string>, n long")
    model = FPGrowth(itemsCol="t", minSupport=max(min_support, min(1.0, min_count / total))).fit(rows)
    return model.freqItemsets.where(F.size("items") <= most).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))


def _hits(sets: DataFrame, index: DataFrame) -> DataFrame:
    """sets (with their tokens _t) joined with the rules of index (tok, tokens, ...) that they hold."""
    asked = sets.withColumn("tok", F.explode("_t"))
    return lookup(asked, index, ["tok"], F.xxhash64("_t")).where(F.size(F.array_except("tokens", "_t")) == 0)


def mine(scratch: Scratch, labelled: DataFrame, min_count: int = 5, min_lift: float = 1.5, sure: float = 1.64, most: int = 3, min_support: float = 1e-4) -> DataFrame:
    """(tok, tokens, confidence, n) from labelled(url, bad boolean): combinations of up to ``most`` tokens that mean bad."""
    url = F.col("url").cast("string")
    rows = labelled.where("url is not null and bad is not null").select("url", tokens_of(host_of(url), path_of(url)).alias("_t"), "bad", (F.pmod(F.xxhash64(url), F.lit(4)) == 0).alias("held"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bad, held = F.col("bad"), F.col("held")
    sums = {"n": count(~held), "b": count(~held & bad), "hn": count(held), "hb": count(held & bad)}
    rows = scratch.write(rows, "labelled")
    sets = scratch.write(rows.groupBy("_t").agg(*[v.alias(k) for k, v in sums.items()]), "sets")
    n, b = sets.agg(F.sum("n"), F.sum("b")).first()
    base = b / n if n else 0.0
    # Tokens that stand in the same pages make the same rules: one of them stands for all, or a long path that repeats would
    # be frequent in each of its subsets.
    each = sets.select(F.explode("_t").alias("tok"), "n", (F.col("n") + F.col("hn")).alias("all"), F.xxhash64("_t").cast("decimal(20,0)").alias("h"))
    share = each.groupBy("tok").agg(F.sum("n").alias("pages"), F.sum("all").alias("all"), F.sum("h").alias("h"))
    first = share.groupBy("all", "h").agg(F.max("tok").alias("tok")).select("tok")
    kept = sets.where("b > 0").select("_t", F.explode("_t").alias("tok")).join(first, "tok", "left_semi").groupBy("_t").agg(F.collect_set("tok").alias("t"))
    mined = lookup(rows.where(bad & ~held).select("_t", url.alias("_u")), scratch.write(kept, "kept"), ["_t"], F.xxhash64("_u"))
    found = frequent(scratch.write(mined.select("t"), "mined"), min_count, min_support, most).select("tokens")
    # Filed under the token that the fewest pages hold.
    filed = found.withColumn("tok", F.explode("tokens")).join(share, "tok").groupBy("tokens").agg(F.min(F.struct("pages", "tok"))["tok"].alias("tok"))
    filed = scratch.write(filed, "filed")
    counted = _hits(sets, filed).groupBy("tok", "tokens").agg(*[F.sum(k).alias(k) for k in sums])
    p, z = F.col("b") / F.col("n"), float(sure)
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    rules = counted.where((F.col("b") >= min_count) & (p >= min_lift * base) & (low > base) & (F.col("hb") > base * F.col("hn")))
    rules = scratch.write(rules.select("tok", "tokens", p.alias("confidence"), "n"), "rules")
    # A rule goes if a part of it is a rule that is as sure: it would add nothing.
    parts = rules.select("tokens", "confidence", F.explode("tokens").alias("t"))
    other = rules.select(F.col("tokens").alias("o"), F.col("confidence").alias("oc"), F.explode("tokens").alias("t"))
    idle = parts.join(other, "t").where("size(o) < size(tokens) and size(array_except(o, tokens)) = 0 and oc >= confidence").select("tokens").distinct()
    return scratch.write(rules.join(idle, "tokens", "left_anti").select("tok", "tokens", "confidence", "n"), "surest")


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest (host, path) rule that fits, else null. rules: (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later, longer ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(f"{h}/{p}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(scratch: Scratch, pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined): mined is the surest mined rule that fits, else null."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    base = base.withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    # What a fixed rule decides, or has no host, needs no join.
    open_ = F.col("_fixed").isNull() & (F.col("host") != "")
    done, asked = base.where(~open_), base.where(open_).withColumn("_t", tokens_of(F.col("host"), F.col("path")))
    # Distinct token sets meet the index once; a host with a third of the pages is one row in the aggregate's partial step.
    best = _hits(asked.select("_t").distinct(), mined).groupBy("_t").agg(F.max(F.struct("confidence", "tokens"))["tokens"].alias("_best"))
    best = scratch.write(best, "best")
    found = lookup(asked, best, ["_t"], F.xxhash64("path"), "left")
    block = F.when(F.col("_best").isNotNull(), "block").otherwise("allow")
    none = F.lit(None).cast("string")
    done = done.select(id_col, "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.verdict", F.lit("allow")).alias("verdict"), none.alias("mined"))
    return done.unionByName(found.select(id_col, "host", "path", none.alias("rule"), block.alias("verdict"), F.array_join("_best", " ").alias("mined")))
