"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit one binary classifier learns from byte n-grams which half of the
languages a text belongs to. A text's bits are compared with the codewords: a wrong bit costs its logistic loss, and the loss
is weighted by how often the bit is right for that language on held-out texts. The codeword of least loss wins; where the
second is nearly as near, the text is flagged as ambiguous.

Up to seven languages have every bit that tells them apart (2**(L-1) - 1); more have random codewords, the best of many
drawn by the least distance between two of them. The classifiers are ridge regressions on the square roots of the shares of
hashed n-grams of one to four bytes (letters lower-cased in ASCII, everything else that is no letter there one blank), so one factorised matrix serves
all bits. They are fitted on a bounded sample: at most ``max_learned`` documents, as many of each language, drawn by a hash.
A quarter of the sample, by the same hash, is left out to weigh the bits and to set the scale of the scores; the rest fits.
Prediction reads every whole text, in slices that overlap.

Defined results: languages are the non-null values of ``lang`` in the rows that are learned from; null texts and those without
a letter (Unicode) are ``und`` with score 0 and not ambiguous, and so is every text where nothing could be learned; with one
language learned every other text is of it, with score 1; a null id is neither held out (null) nor learned from; rows that
repeat are predicted each and alike; ties go to the language that is smaller in code-point order; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup

#: Buckets of n-grams of 1 to 4 bytes.
BUCKETS = (256, 1024, 2048, 2048)
N_FEATURES = sum(BUCKETS)
SLICE = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MULTIPLY = np.uint32(2654435761)


def gram_counts(data: np.ndarray) -> list[np.ndarray]:
    """Counts of the hashed n-grams of folded bytes, by length."""
    x = data.astype(np.uint32)
    out, gram = [np.bincount(data, minlength=256)], x
    for n in range(2, 5):
        gram = (gram[:-1] << np.uint32(8)) | x[n - 1 :] if len(x) >= n else np.zeros(0, np.uint32)
        bits = BUCKETS[n - 1].bit_length() - 1
        out.append(np.bincount((gram * _MULTIPLY) >> np.uint32(32 - bits), minlength=BUCKETS[n - 1]))
    return out


def folded(raw: bytes) -> np.ndarray:
    """Bytes in lower case, other ASCII as one blank, at both ends too."""
    x = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return x[keep]


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the text's n-grams; the whole text, by slices that overlap by three bytes."""
    raw = text.encode("utf-8", "replace")
    if len(raw) <= SLICE:
        counts = gram_counts(folded(raw))
    else:
        counts, tail = [np.zeros(b, np.int64) for b in BUCKETS], np.zeros(0, np.uint8)
        for at in range(0, len(raw), SLICE):
            part = _FOLD[np.frombuffer((b" " if at == 0 else b"") + raw[at : at + SLICE] + (b" " if at + SLICE >= len(raw) else b""), np.uint8)]
            both = np.concatenate([tail, part])
            keep = np.ones(len(both), bool)
            keep[1:] = (both[1:] != 32) | (both[:-1] != 32)
            both, seen = both[keep], min(len(tail), 3)
            whole, old = gram_counts(both), gram_counts(both[:seen])
            counts = [c + w - o for c, w, o in zip(counts, whole, old, strict=True)]
            tail = both[-3:]
    return np.concatenate([np.sqrt(c / max(1, c.sum())) for c in counts]).astype(np.float32)


def codewords(n: int, seed: int = 29) -> np.ndarray:
    """n codewords, rows of +1 and -1; no bit is alike for all, none repeats or mirrors another."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)  # the last row is all -1
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), (-(1 << 30), None)
    for _ in range(50):
        m = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        m[0, np.abs(m.sum(0)) == n] *= -1
        alike = m @ m.T - 2 * width * np.eye(n)
        best = max(best, (int(-alike.max()), m), key=lambda b: b[0])
    return best[1]


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


class Codes:
    """Fitted classifiers of the bits, their weights and the decoding."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, ridge: float = 1e-3, seed: int = 29):
        self.names = sorted(set(y.tolist()))
        self.code = codewords(len(self.names), seed)
        if len(self.names) < 2:
            return
        at = np.searchsorted(np.array(self.names, object), y)
        fit = ~held
        if len(np.unique(at[fit])) < len(self.names) or not held.any():
            fit, held = np.ones(len(y), bool), np.ones(len(y), bool)
        # Every language weighs the same, however many of its texts there are.
        weight = 1 / np.bincount(at[fit], minlength=len(self.names))[at[fit]] / len(self.names)
        z = x[fit].astype(np.float32)
        self.mean = weight.astype(np.float32) @ z
        target = self.code[at[fit]]
        self.shift = weight @ target
        z -= self.mean
        z *= np.sqrt(weight)[:, None].astype(np.float32)
        t = (target - self.shift) * np.sqrt(weight)[:, None]
        if len(z) <= z.shape[1]:  # the smaller of the two systems
            gram = (z @ z.T).astype(np.float64)
            gram[np.diag_indices(len(gram))] += ridge
            self.w = z.T @ np.linalg.solve(gram, t)
        else:
            gram = (z.T @ z).astype(np.float64)
            gram[np.diag_indices(len(gram))] += ridge
            self.w = np.linalg.solve(gram, z.T @ t)
        f, own = self.bits(x[held]), at[held]
        # How often each bit is right for each language; a language's weights add up to one.
        hits, n = np.zeros_like(self.code), np.bincount(own, minlength=len(self.names))
        np.add.at(hits, own, (f * self.code[own] > 0).astype(float))
        right = (hits + 1) / (n[:, None] + 2)
        self.weight = right / right.sum(1, keepdims=True)
        # The sharpness with which losses become scores: the one that makes the held-out texts likeliest.
        losses, tried = self.losses(x[held]), 2.0 ** np.arange(-2, 9)
        likely = [np.log(np.maximum(self.shares(losses, s)[np.arange(len(own)), own], 1e-12)).mean() for s in tried]
        self.sharp = float(tried[int(np.argmax(likely))])

    def bits(self, x: np.ndarray) -> np.ndarray:
        return 4 * ((x - self.mean) @ self.w + self.shift)

    def losses(self, x: np.ndarray) -> np.ndarray:
        """texts x languages: the weighted loss of the text's bits against each codeword."""
        return self.nearest(self.bits(x))

    def nearest(self, f: np.ndarray) -> np.ndarray:
        # A bit of +1 and one of -1 are the only cases, so two products stand for all languages.
        plus, minus = _loss(f), _loss(-f)
        return plus @ (self.weight * (self.code > 0)).T + minus @ (self.weight * (self.code < 0)).T

    @staticmethod
    def shares(losses: np.ndarray, sharp: float) -> np.ndarray:
        e = np.exp(-sharp * (losses - losses.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, x: np.ndarray, margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each row."""
        if len(self.names) < 2:
            return self.names * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        p = self.shares(self.losses(x), self.sharp)
        best = p.argmax(1)
        top = np.partition(p, -2, axis=1)
        return [self.names[i] for i in best], p[np.arange(len(p)), best], top[:, -1] - top[:, -2] < margin


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def learn(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, max_learned: int, seed: int) -> Codes | None:
    """The model; None where no row can be learned from."""
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("t"), held_out(F.col(id_col), folds).alias("held"))
    own = own.where(~F.col("held") & F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    number = scratch.write(own.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row for each language
    each = max(1, max_learned // max(1, number.count()))
    share = number.select("lang", F.least(F.lit(1.0), F.lit(1.5 * each) / F.col("n")).alias("share"))
    # A hash below the share that is asked for leaves about as many rows of each language, so ranks are over few rows.
    drawn = lookup(own.withColumn("h", F.xxhash64("t", F.lit(seed))), share, ["lang"], F.col("h"))
    drawn = drawn.where((F.col("h").cast("double") / 2.0**64 + 0.5 < F.col("share")) | (F.col("share") == 1.0))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            f = [features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.binary()), b.column(2)], names=["lang", "f", "h"])

    seen = drawn.select("lang", "t", "h").mapInArrow(read, "lang string, f binary, h long").dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = seen.withColumn("r", rank).where(F.col("r") <= each).select("lang", "h", "f").orderBy("h", "lang").toArrow()  # max_learned at most, or one of each language
    if not rows.num_rows:
        return None
    x = np.empty((rows.num_rows, N_FEATURES), np.float32)
    for i, f in enumerate(rows.column(2)):
        x[i] = np.frombuffer(f.as_buffer(), np.float16)
    lang, held = np.array(rows.column(0).to_pylist(), object), rows.column(1).to_numpy() % 4 == 3
    del rows
    return Codes(x, lang, held)


def identify(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, max_learned: int = 3_000, margin: float = 0.2, seed: int = 31) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every row. margin: a lead of scores below it is ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(learn(scratch, docs, id_col, text_col, lang_col, folds, max_learned, seed))  # features x bits

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            texts, m = b.column(2).to_pylist(), model.value
            n = len(texts)
            lang, score, doubt = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            at = [i for i, t in enumerate(texts) if has_letter(t)] if m is not None else []
            for part in (at[i : i + 256] for i in range(0, len(at), 256)):
                names, s, a = m.predict(np.stack([features(texts[i]) for i in part]), margin)
                score[part], doubt[part] = s, a
                for i, name in zip(part, names, strict=True):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], names=["id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(predict, "id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
