"""Quality classification by co-training of two views.

The text view reads content: hashed byte n-grams of words (three bytes at a time, by share of the text) and a few measures
of shape; standardising the features weighs rare n-grams up, as inverse document frequencies would.  The metadata view sees
source, language and length.  Both are logistic regressions.  In each of ``rounds`` rounds each view scores every document
that has no label, in one pass over a table of features, and the ``exchange`` documents of which it is surest, in proportion
to the classes, are labelled for the other view to learn from.  How sure a view is, a held-out quarter of the labels tells
(by a hash of the id).  In the end each quarter gets its scores from models that do not know it; these calibrate both views
and their sum, the models are fitted to all labels, and the combined view scores every document.

The labels that the models start from are a bounded sample, drawn by a hash of the id: at most ``max_labelled``.  All other
documents are the pool that pseudo-labels come from; none is left out.

Defined results: a document is kept if its probability of good quality is at least ``threshold``; null and empty texts have
features of zero; null sources, languages and lengths are values of their own; without usable labels every probability is
0.5 and all are kept; with labels of one class, every probability is that class's share; an id with several labels has the
least of them; rows that repeat an id are scored each; equally sure documents are taken by a hash of their features; an
empty table gives no rows; other columns come through whatever their names, except those named like the ones added.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .minhash import LOWER

ADDED = ["p_text", "p_meta", "p_quality", "kept"]
_KINDS = np.zeros(256, np.int64)  # 0 other; then upper, lower, digit, blank, line end, full stop or comma, !, ?, |, symbols, quotes and brackets, beyond ASCII
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 12
for _k, _chars in ((4, b" \t"), (5, b"\n\r"), (6, b".,"), (7, b"!"), (8, b"?"), (9, b"|"), (10, b"#$%&*+=<>@^_~\\/{}"), (11, b"\"'()[]:;-`")):
    _KINDS[list(_chars)] = _k
N_SHAPE, N_META = 19, 58
N_TEXT = N_SHAPE + 256


N_GRAMS = N_TEXT - N_SHAPE
_MULTIPLY = np.uint32(2654435761)


def text_features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    out = np.zeros(N_TEXT)
    if not raw:
        return out
    n, data = len(raw), np.frombuffer(raw, np.uint8)
    share = np.bincount(_KINDS, np.bincount(data, minlength=256), 13) / n
    out[:13] = np.sqrt(share)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    if words:
        out[13] = np.log1p(n / len(words))
        out[14] = len(set(words)) / len(words)
    if lines:
        out[15] = len(set(lines)) / len(lines)
        out[16] = np.log1p(n / len(lines))
    out[17] = np.log1p(n) / 10
    out[18] = share[1] / (share[1] + share[2] + 1e-9)
    if n > 2:
        low = LOWER[data].astype(np.uint32)
        gram = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * _MULTIPLY >> np.uint32(24)
        out[N_SHAPE:] = np.sqrt(np.bincount(gram, minlength=N_GRAMS) / (n - 2))
    return out


def meta_features(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(N_META)
    out[zlib.crc32(repr(source).encode()) % 32] = 1
    out[32 + zlib.crc32(repr(lang).encode()) % 12] = 1
    if n_chars is None or n_chars != n_chars:
        out[44] = 1
    else:
        size = np.log1p(max(0.0, float(n_chars)))
        out[45] = size / 10
        out[46 + min(11, int(size))] = 1
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], 1e-6)
        penalty[1:] = ridge
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.w, -30, 30)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


#: Penalties of the views' weights; a single n-gram says little, so its weight needs more evidence.
RIDGE = (np.r_[np.ones(N_SHAPE), np.full(N_GRAMS, 20.0)], 1.0)


class CoTrained:
    """Both views after learn() with the labels and with what either told the other; scores() gives calibrated probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.x, self.y, self.extra, self.constant = x, y, [[], []], None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        if any(len(np.unique(y[m])) < 2 for m in (held, ~held)):
            held = np.zeros(len(y), bool)
        self.fit, self.check = ~held, held if held.any() else ~held
        self.prior = float(y.mean())
        self.learn()

    @staticmethod
    def views(x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :N_TEXT], x[:, N_TEXT:]]

    def fitted(self, rows: np.ndarray) -> list[Logistic]:
        out = []
        for v in (0, 1):
            more, said = zip(*self.extra[v], strict=True) if self.extra[v] else ((), ())
            x = np.concatenate([self.views(self.x)[v][rows], *([np.stack(more)] if more else [])])
            out.append(Logistic(x, np.concatenate([self.y[rows], said]), ridge=RIDGE[v]))
        return out

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        self.calibrated = [Logistic(z, y, 1.0) for z in (logits[:, :1], logits[:, 1:])]
        self.both = Logistic(logits, y, 1.0)

    def learn(self) -> None:
        self.models = self.fitted(self.fit)
        self.calibrate(self.logits(self.x[self.check]), self.y[self.check])

    def finish(self, folds: int = 4) -> "CoTrained":
        """Calibrated on what each fold of the labels gets from models that do not know it; fitted on all labels."""
        if self.constant is None:
            at, logits = np.arange(len(self.y)) % folds, np.zeros((len(self.y), 2))
            if all(len(np.unique(self.y[at != k])) == 2 for k in range(folds)):
                for k in range(folds):
                    self.models = self.fitted(at != k)
                    logits[at == k] = self.logits(self.x[at == k])
                self.models = self.fitted(np.ones(len(self.y), bool))
                self.calibrate(logits, self.y)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.stack([m.logit(z) for m, z in zip(self.models, self.views(x), strict=True)], axis=1)

    def tell(self, view: int, x: np.ndarray, good: bool) -> None:
        """Rows of which ``view`` is sure, for the other to learn from."""
        self.extra[1 - view] += [(z, float(good)) for z in self.views(x)[1 - view]]

    def ready(self) -> "CoTrained":
        """Without what only learning needs."""
        out = object.__new__(CoTrained)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k in ("constant", "models", "calibrated", "both")}
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full((len(x), 3), self.constant)
        z = self.logits(x)
        return np.stack([_sigmoid(self.calibrated[0].logit(z[:, :1])), _sigmoid(self.calibrated[1].logit(z[:, 1:])), _sigmoid(self.both.logit(z))], axis=1)


def _matrix(column) -> np.ndarray:
    """Rows of features from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, N_TEXT + N_META).astype(np.float64)


def _surest(pool: DataFrame, model: CoTrained, exchange: int, sure: float) -> list[tuple[int, bool, np.ndarray]]:
    """(view, good, features) of the pool's documents of which a view is surest: a pass over all, of which each task keeps few."""
    wanted = [(v, g, max(1, round(exchange * (model.prior if g else 1 - model.prior)))) for v in (0, 1) for g in (False, True)]
    shared = pool.sparkSession.sparkContext.broadcast(model.ready())

    def best(batches):
        import pyarrow as pa

        held = [(np.zeros(0), None)] * len(wanted)  # of each kind the task's surest so far
        for batch in batches:
            p = shared.value.scores(_matrix(batch.column(1)))[:, :2]
            for i, (v, good, n) in enumerate(wanted):
                q = p[:, v] if good else 1 - p[:, v]
                at = np.flatnonzero(q >= sure)
                at = at[np.argsort(-q[at], kind="stable")[:n]]
                rows = pa.Table.from_batches([batch.take(pa.array(at))])
                both, q = (rows if held[i][1] is None else pa.concat_tables([held[i][1], rows])), np.concatenate([held[i][0], q[at]])
                top = np.argsort(-q, kind="stable")[:n]
                held[i] = (q[top], both.take(pa.array(top)))
        for (v, good, _), (q, rows) in zip(wanted, held, strict=True):
            if len(q):
                rows = rows.combine_chunks()
                yield from pa.table([pa.array([v] * len(q), pa.int32()), pa.array([good] * len(q), pa.bool_()), pa.array(q), *rows.columns], names=["view", "good", "q", "h", "f"]).combine_chunks().to_batches()

    found = pool.select("h", "f").mapInArrow(best, "view int, good boolean, q double, h long, f binary")
    limit = F.when(F.col("good"), max(w[2] for w in wanted if w[1])).otherwise(max(w[2] for w in wanted if not w[1]))
    # First within parts of each kind, then over what those keep, so that no task holds what all tasks kept.
    for keys in (["view", "good", "part"], ["view", "good"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("q"), "h", "f"))
        found = found.withColumn("part", F.pmod("h", F.lit(64))).withColumn("r", rank).where(F.col("r") <= limit).drop("part")
    rows = found.orderBy("view", "good", "r").select("view", "good", "f").toArrow()  # 2 x exchange rows at most
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), _matrix(rows.column(2)), strict=True)) if rows.num_rows else []


def classify(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", max_labelled: int = 10_000, exchange: int = 200, threshold: float = 0.5, sure: float = 0.95, rounds: int = 3, seed: int = 17) -> DataFrame:
    """docs with p_text, p_meta, p_quality and kept."""
    parts = [F.col(text_col).cast("string"), F.col(source_col).cast("string"), F.col(lang_col).cast("string"), F.col(chars_col).cast("double")]
    model = docs.sparkSession.sparkContext.broadcast(train(scratch, docs, labels, id_col, parts, label_col, max_labelled, exchange, sure, rounds, seed).ready())

    @F.pandas_udf("struct<p_text double, p_meta double, p_quality double>")
    def score(t, s, lang, n):
        import pandas as pd

        x = np.array([np.r_[text_features(a), meta_features(b, c, d)] for a, b, c, d in zip(t, s, lang, n, strict=True)]).reshape(-1, N_TEXT + N_META)
        return pd.DataFrame(model.value.scores(x.astype(np.float16).astype(np.float64)), columns=["p_text", "p_meta", "p_quality"])

    # Input columns travel in a struct, where their names cannot clash.
    kept = [c for c in docs.columns if c not in ADDED]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), score(*parts).alias("_s"))
    return out.select("_row.*", "_s.p_text", "_s.p_meta", "_s.p_quality", (F.col("_s.p_quality") >= threshold).alias("kept"))


def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str, parts: list, label_col: str, max_labelled: int, exchange: int, sure: float, rounds: int, seed: int) -> CoTrained:
    def features(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            f = [np.r_[text_features(a), meta_features(*b)].astype(np.float16).tobytes() for a, *b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.binary())], names=["id", "f"])

    seen = docs.select(F.col(id_col).cast("long").alias("id"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).mapInArrow(features, "id long, f binary")
    answers = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("y"))
    by_hash = F.xxhash64("id", F.lit(seed))
    table = scratch.write(seen.join(answers, "id", "left").select(by_hash.alias("h"), "y", "f"), "features")
    # A row for each labelled id; hashes beyond twice the share that is asked for are left out before anything is sorted.
    known = table.where("y is not null")
    share = 2 * max_labelled / max(1, known.count())
    known = known.where(F.col("h").cast("double") / 2.0**64 + 0.5 < share).groupBy("h", "y").agg(F.min("f").alias("f"))
    sample = known.select("h", "y", "f").orderBy("h").limit(max_labelled).toArrow()
    held = np.array(sample.column(0).to_pylist(), np.int64) % 4 == 3
    model = CoTrained(_matrix(sample.column(2)), np.array(sample.column(1).to_pylist(), np.float64), held)
    pool = table.where("y is null").withColumn("h", F.xxhash64("f", F.lit(seed)))
    for _ in range(rounds if model.constant is None else 0):
        found = _surest(pool, model, exchange, sure)
        model.extra = [[], []]  # what a view said before it says again, or no longer stands by
        for view, good, x in found:
            model.tell(view, x[None], good)
        model.learn()
    scratch.drop("features")
    return model.finish()
