"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points, lower-cased and hashed into DIM columns, are weighted by TF-IDF over all training documents.
Weights are learned with follow-the-regularised-leader (FTRL-proximal) under an elastic net, so most are exactly zero, and the
probabilities are calibrated by a temperature fitted on documents kept out of the training.

Document frequencies are counted over every training document. The regression itself is fitted on a bounded sample: about
`per_lang` documents of each language chosen by hash, TRAINED in all, and of each its MOST_COLUMNS commonest n-grams. Every language is
learned; a model has at most WEIGHTS weights, so with more than a thousand languages n-grams share fewer columns. Whole texts are predicted.
Null texts and texts without a letter are `und` with score 0; without any training document everything is `und`. Equal probabilities: the
language first by name. Repeated rows count as documents each, and are predicted alike; an empty table gives an empty table; extra columns of any name stay.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, mix64, packed, unpacked

DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Documents of each language, about, that the regression is fitted on; of all languages; the least of one, if those are many; columns of one document.
PER_LANG, TRAINED, LEAST, MOST_COLUMNS = 1500, 30_000, 20, 4096
#: Weights of a model: DIM columns for each of up to a thousand languages.
WEIGHTS = 1 << 24
UNKNOWN = "und"
#: FTRL: step size, smoothing, L1, L2, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.02, 2
#: Text is featurised in pieces of so many code points, so that a huge one needs little memory.
PIECE = 1 << 18
_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def columns_for(n_langs: int) -> int:
    """The columns of a model: DIM, halved until all weights fit."""
    dim = DIM
    while dim > 256 and dim * n_langs > WEIGHTS:
        dim //= 2
    return dim


def counts(text: str, dim: int = DIM) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text; control characters and white space count as one symbol."""
    out = np.zeros(dim, dtype=np.float32)
    low = text.lower()
    for at in range(0, len(low), PIECE):
        piece = low[max(0, at - max(ORDERS) + 1) : at + PIECE]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        points = np.where(points <= 32, np.uint64(32), points)
        key = np.zeros(len(points), dtype=np.uint64)
        old = max(ORDERS) - 1 if at else 0
        for n in range(1, max(ORDERS) + 1):
            if len(points) < n:
                break
            key = (key[: len(points) - n + 1] + points[n - 1 :]) * _SEEDS[(n - 1) % 3]
            key ^= key >> np.uint64(29)
            if n in ORDERS:
                fresh = key[max(0, old - n + 1) :]
                out += np.bincount(column_of(fresh, dim), minlength=dim)
    return out


def column_of(key: np.ndarray, dim: int) -> np.ndarray:
    """The column of each n-gram."""
    return ((key * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - (dim - 1).bit_length())).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row for each column and one for the intercept, by languages
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        x = np.log1p(counts(text, len(self.idf))) * self.idf
        norm = float(np.sqrt(x @ x)) or 1.0
        return (x @ self.weights[:-1]) / norm + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, dim: int = DIM, seed: int = 0) -> np.ndarray:
    """Weights by FTRL-proximal, one document at a time; rows are (columns, values) of unit length."""
    z = np.zeros((dim + 1, n_langs))
    n = np.zeros((dim + 1, n_langs))

    def weights(cols: np.ndarray) -> np.ndarray:
        zc = z[cols]
        return np.where(np.abs(zc) <= L1, 0.0, -(zc - np.sign(zc) * L1) / ((BETA + np.sqrt(n[cols])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            cols, values = rows[i]
            w = weights(cols)
            p = softmax((values @ w)[None, :])[0]
            p[y[i]] -= 1.0
            g = values[:, None] * p[None, :]
            g2 = g * g
            sigma = (np.sqrt(n[cols] + g2) - np.sqrt(n[cols])) / ALPHA
            z[cols] += g - sigma * w
            n[cols] += g2
    return weights(np.arange(dim + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(training: DataFrame, text: str = "text", dim: int = DIM) -> tuple[np.ndarray, int]:
    """In how many training documents each column occurs, and how many there are. Each task sends a sum for each column."""

    def run(batches):
        total, n = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                total += counts(x.as_py() or "", dim) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(np.append(total, n))], ["c", "n"])

    sums = training.select(text).mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    out = np.zeros(dim + 1, dtype=np.int64)
    for c, n in sums.collect():
        out[c] = n
    return out[:-1], int(out[-1])


def fit(training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fits a model on the rows of `training` whose text and lang are not null."""
    labelled = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = dict(labelled.groupBy(lang).count().collect())
    if not sizes:
        return Model([], np.zeros(DIM), np.zeros((DIM + 1, 0)), 1.0)
    langs = sorted(sizes)
    dim = columns_for(len(langs))
    df, n_docs = document_frequencies(labelled.select(text), text, dim)
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    most = min(per_lang, max(LEAST, TRAINED // len(langs)))
    shares = labelled.sparkSession.createDataFrame([(k, most / n) for k, n in sizes.items()], f"_name {dict(labelled.dtypes)[lang]}, _share double")
    drawn = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1_000_000)) / 1_000_000
    named = labelled.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(lang).alias("name"), drawn.alias("drawn"))
    sample = named.join(F.broadcast(shares), F.col("name") == F.col("_name")).where("drawn < _share").select("k", "x", "name")  # a row per language

    def featurise(batch: pa.RecordBatch) -> list:
        rows = []
        for k, x, name in zip(*(batch.column(i) for i in range(3)), strict=True):
            c = counts(x.as_py(), dim)
            cols = np.sort(np.argsort(-c, kind="stable")[: min(MOST_COLUMNS, np.count_nonzero(c))])
            rows.append((str(k.as_py()), name.as_py(), cols.astype("<i2").tobytes(), c[cols].astype("<f4").tobytes()))
        return rows

    got = sorted(map(tuple, by_batch(sample, featurise, "k string, lang string, cols binary, n binary").collect()))
    place = {k: i for i, k in enumerate(langs)}
    rows, y = [], []
    for _, name, cols, n in got:
        c = np.frombuffer(cols, "<i2").astype(np.int64)
        v = np.log1p(np.frombuffer(n, "<f4")) * idf[c]
        v = v / (np.sqrt(v @ v) or 1.0)
        rows.append((np.append(c, dim), np.append(v, 1.0)))
        y.append(place[name])
    y = np.array(y, dtype=np.int64)
    kept_out = mix64(np.arange(len(rows), dtype=np.uint64)) % np.uint64(5) == 0
    use = np.flatnonzero(~kept_out)
    w = fit_ftrl([rows[i] for i in use], y[use], len(langs), dim)
    held = np.flatnonzero(kept_out)
    logits = np.array([v @ w[c] for c, v in (rows[i] for i in held)]).reshape(len(held), len(langs))
    return Model(langs, idf, w.astype(np.float32), fit_temperature(logits, y[held]))


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its calibrated probability, in place of columns of these names."""
    kept = [n for n in df.columns if n not in (lang, score)]
    return unpacked(predicted(df, model, text, kept), kept, F.col("lang").alias(lang), F.col("score").alias(score))


def predicted(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns of df, or those to keep, in `row`, and lang and score beside it."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.columns if keep is None else keep
    place = kept.index(text) if text in kept else None  # then the text travels in the row only
    named = packed(df, *([] if place is not None else [F.col(text).alias("text")]), keep=kept)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1) if place is None else batch.column(0).field(place)
        found = [shared.value.predict(x.as_py()) for x in texts]
        return {"row": batch.column(0), "lang": [x[0] for x in found], "score": [x[1] for x in found]}

    return by_batch(named, run, f"row {dict(named.dtypes)['row']}, lang string, score double")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op3_language(documents: DataFrame) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    model = fit(documents.where(~held_out()))
    found = unpacked(predicted(documents, model, keep=["doc_id"]), ["doc_id"], F.col("lang").alias("lang_pred"), "score")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
