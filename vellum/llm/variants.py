"""Spelling variants: words one error apart, found by a forward and a backward minimal automaton with word numbers.

Words are counted in the JVM. A pattern of M code points is halved: a word one error away has its first half as it is, or
its last. So a pattern asks in two cells, one of the words that begin like it and one of those that end like it, and every
word is filed in the cells of patterns of M - 1, M and M + 1 points that it could answer. A cell is (M, a, b): the first a
and the last b points are fixed, the error lies between. Cells with more than ``crowd`` words are halved again, the free
part by half, until they are small or one point is free; so no prefix, however common, is one task.

A task holds some cells. It builds two minimal acyclic automata of their words, of the words and of their reversals, whose
edges carry how many words come before them: a path's sum is the word's number, and a number finds the word and its count.
A pattern follows its fixed half exactly and completes the rest with exactly one error. Both directions may find a pair; it
is counted once. Roots are found by doubling, so a chain of n forms takes log2(n) joins.

Defined results: null and empty texts have no words; a null id is written as nothing before the colon of the hash; rows that
repeat count each; ties go to the word that is smaller in code-point order; a word without near words has n_near 0 and is its
own root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup

LETTERS = "A-Za-zÀ-ÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. edges[s]: point -> (state, words of s before this edge)."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # of the word before: [final, edges to frozen states] of each of its states
        last = ""
        for w in words:
            same, top = 0, min(len(w), len(last))
            while same < top and w[same] == last[same]:
                same += 1
            self._freeze(path, last, same)
            path += [[False, []] for _ in range(len(w) - same)]
            path[-1][0] = True
            last = w
        self._freeze(path, last, 0)
        self.root = self._state(*path[0])

    def _freeze(self, path: list[list], word: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, final: bool, out: list[tuple[str, int]]) -> int:
        """The one state of these edges."""
        key = (final, *out)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.edges)
            before, edges = int(final), {}
            for c, to in out:
                edges[c] = (to, before)
                before += self.count[to]
            self.edges.append(edges), self.final.append(final), self.count.append(before)
        return state

    def number(self, word: str, at: int = 0, state: int | None = None, before: int = 0) -> int:
        """The word's place among the sorted words, from a state on; -1 if it is none of them."""
        state, edges = self.root if state is None else state, self.edges
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return -1
            state, before = step[0], before + step[1]
        return before if self.final[state] else -1

    def near(self, word: str, fixed: int) -> list[int]:
        """Numbers of the words that have the first ``fixed`` points of word and differ by exactly one error in the rest."""
        state, before, edges = self.root, 0, self.edges
        for c in word[:fixed]:
            step = edges[state].get(c)
            if step is None:
                return []
            state, before = step[0], before + step[1]
        found, n = [], len(word)
        for i in range(fixed, n + 1):
            c = word[i] if i < n else ""
            for d, (to, skip) in edges[state].items():
                if d != c:  # a point that repeats the next one is inserted after it
                    if c:
                        found.append(self.number(word, i + 1, to, before + skip))
                    found.append(self.number(word, i, to, before + skip))
            if not c:
                break
            if word[i + 1 : i + 2] != c:
                found.append(self.number(word, i + 1, state, before))
            step = edges[state].get(c)
            if step is None:
                break
            state, before = step[0], before + step[1]
        return [x for x in found if x >= 0]


def pieces(text: Column, size: int = 1 << 20) -> Column:
    """A text as an array of pieces of about size points that cut no run of letters: a run belongs to the piece it begins in."""

    def piece(i: Column) -> Column:
        part, rest = F.substring(text, i * size + 1, F.lit(size)), F.substring(text, (i + 1) * size + 1, F.lit((1 << 31) - 1))
        inside = F.substring(text, i * size, F.when(i > 0, 1).otherwise(0)).rlike(f"[{LETTERS}]")
        own = F.when(inside, F.regexp_replace(part, f"^[{LETTERS}]+", "")).otherwise(part)
        return F.when(own.rlike(f"[{LETTERS}]$"), F.concat(own, F.regexp_extract(rest, f"^[{LETTERS}]+", 0))).otherwise(own)

    return F.when(F.length(text) > size, F.transform(F.sequence(F.lit(0).cast("long"), ((F.length(text) - 1) / size).cast("long")), piece)).otherwise(F.array(text))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_points: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, one point deleted from those whose hash ``every`` divides."""
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(pieces(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("t"))
    runs = named.select("id", F.explode(F.regexp_extract_all("t", F.lit(f"([{LETTERS}]+)"))).alias("r")).where(F.length("r") >= least_points)
    low = F.when(F.octet_length("r") == F.length("r"), F.lower("r")).otherwise(F.translate("r", _UPPER, _UPPER.lower()))
    runs = runs.select("id", low.alias("r")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "r").cast("binary")))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("r"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_points).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _key() -> Column:
    """What the rows of a cell share."""
    return F.xxhash64("m", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.right(F.col("word"), F.col("b")))


def _cells(vocabulary: DataFrame, least_points: int) -> DataFrame:
    """(word, n, m, a, b, asks, key): each word in the two cells that it asks in, and in those that it may answer in."""
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda m: m >= least_points)
    rows = vocabulary.select("word", "n", F.explode(lengths).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (F.col("m") - half).alias("b")))
    rows = rows.select("word", "n", "m", F.explode(sides).alias("s")).select("word", "n", "m", "s.a", "s.b", (F.col("m") == F.length("word")).alias("asks"))
    return rows.withColumn("key", _key())


def _halved(cells: DataFrame) -> DataFrame:
    """Rows of crowded cells in the two cells that each of those is cut into."""
    free = F.col("m") - F.col("a") - F.col("b")
    first = F.floor(free / 2).cast("int")
    parts = F.array(F.struct((F.col("a") + first).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("b") + free - first).alias("b")))
    return cells.select("word", "n", "m", F.explode(parts).alias("s"), "asks").select("word", "n", "m", "s.a", "s.b", "asks").withColumn("key", _key())


def _near(batches):
    """(word, near, near_n) of the patterns of a task among its words."""
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    word, n, a, b, asks = (table.column(c).to_pylist() for c in ("word", "n", "a", "b", "asks"))
    count = dict(zip(word, n, strict=True))
    forward = [x >= y for x, y in zip(a, b, strict=True)]
    out: list[tuple[str, str]] = []
    for ahead in (True, False):
        mine = [i for i, f in enumerate(forward) if f is ahead]
        spelled = sorted({word[i] if ahead else word[i][::-1] for i in mine})
        found = Automaton(spelled)
        for i in mine:
            if asks[i]:
                w = word[i] if ahead else word[i][::-1]
                out += [(word[i], spelled[k] if ahead else spelled[k][::-1]) for k in found.near(w, a[i] if ahead else b[i])]
        del found
    for at in range(0, len(out), 50_000):
        part = out[at : at + 50_000]
        cols = [pa.array([x for x, _ in part], pa.string()), pa.array([y for _, y in part], pa.string()), pa.array([count[y] for _, y in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["word", "near", "near_n"])


def near_words(scratch: Scratch, vocabulary: DataFrame, least_points: int = 5, crowd: int = 5_000, task_rows: int = 40_000) -> DataFrame:
    """(word, near, near_n): every two words that differ by one inserted, deleted or replaced code point, in both orders."""
    cells, ready = scratch.write(_cells(vocabulary, least_points), "cells"), []
    while True:
        free = F.col("m") - F.col("a") - F.col("b")
        crowded = cells.groupBy("key").agg(F.count("*").alias("_n"), F.max(free).alias("_free")).where((F.col("_n") > crowd) & (F.col("_free") > 1)).select("key", F.lit(True).alias("_hot"))
        crowded = scratch.write(crowded, "crowded")
        if crowded.isEmpty():
            ready.append(cells)
            break
        told = scratch.write(lookup(cells, crowded, ["key"], F.xxhash64("word"), "left"), "told")
        ready.append(told.where("_hot is null").drop("_hot"))
        cells = scratch.write(_halved(told.where("_hot")), "cells")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    parts = max(1, -(-rows.count() // task_rows))
    found = rows.repartition(max(parts, vocabulary.sparkSession.sparkContext.defaultParallelism), "key").mapInArrow(_near, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def variants(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_points: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n). form: the most frequent near word, if it is ``times`` as frequent at least."""
    vocabulary = scratch.write(words(docs, id_col, text_col, every, least_points, least_n), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    told = near_words(scratch, vocabulary, least_points).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocabulary.join(told, "word", "left")
    is_form = -F.col("best.n") >= F.col("n") * times
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    rows = scratch.write(rows, "forms")
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form is more frequent than its word, so chains end
        roots = scratch.write(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            break
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
