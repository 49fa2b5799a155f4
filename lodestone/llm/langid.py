"""Language ID: multinomial logistic regression on TF-IDF of hashed character n-grams.

Training is follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties over a
bounded sample: the `per_lang` labelled documents of each language that come first by a hash of their id.
Document frequencies are counted over all labelled training documents. One fifth of the sample is left out
of training and sets the temperature by which scores are calibrated.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

DIM = 1 << 15
_LETTER: list[np.ndarray] = []
_HAS_LETTER = re.compile(r"[^\W\d_]")


def _letters() -> np.ndarray:
    if not _LETTER:
        table = np.zeros(sys.maxunicode + 1, bool)
        table[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]] = True
        _LETTER.append(table)
    return _LETTER[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(index, count) of the hashed 1- to 3-grams of a whole text's letters; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    # every run of other characters is one blank
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.where(letter, code, 32)[keep].astype(np.uint64)
    x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]])
    a, b, c = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    shift = np.uint64(64 - 15)
    one = x * a
    two = one[:-1] ^ (x[1:] * b)
    three = two[:-1] + x[2:] * c
    grams = np.concatenate([(one * c) >> shift, (two * a) >> shift, (three * b) >> shift]).astype(np.int64)
    count = np.bincount(grams, minlength=DIM)
    index = np.flatnonzero(count)
    return index, count[index]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weight: np.ndarray  # DIM + 1 rows, the last of which is the bias
    temperature: float = 1.0

    def vector(self, found) -> tuple[np.ndarray, np.ndarray]:
        index, count = found
        x = np.log1p(count) * self.idf[index]
        return index, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, found) -> np.ndarray:
        index, x = self.vector(found)
        return x @ self.weight[index] + self.weight[DIM]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(found) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(model: Model, rows: list, labels: list[int], alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=4, seed=0) -> None:
    """Fit model.weight; l1 leaves most coordinates at zero, l2 holds the others back."""
    k = len(model.langs)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    vectors = [model.vector(r) for r in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            index, x = vectors[r]
            i = np.append(index, DIM)
            v = np.append(x, 1.0)[:, None]
            w = weights(i)
            p = softmax((v * w).sum(0))
            p[labels[r]] -= 1
            g = v * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    model.weight = weights(np.arange(DIM + 1)).astype(np.float32)


def calibrate(model: Model, rows: list, labels: list[int]) -> None:
    """The temperature with the least log loss on rows that training didn't see."""
    if not rows:
        return
    z, y = np.array([model.logits(r) for r in rows]), np.array(labels)
    loss = lambda t: -np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    grid = np.linspace(-3, 3, 121)
    model.temperature = float(np.exp(grid[int(np.argmin([loss(t) for t in grid]))]))


def training_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The labelled documents outside the held-out fold (crc32 of the id's text, modulo folds, is 0)."""
    return docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0))


def fit(docs: DataFrame, per_lang: int = 300) -> Model:
    """Learn from text and lang of the training rows of docs; no row gives a model that answers `und`."""
    import pyarrow as pa

    train = training_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    langs = sorted(r[0] for r in train.select("lang").distinct().collect())

    def frequencies(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(i, 500).to_pylist():
                    if (found := features(text)) is not None:
                        total[found[0]] += 1
                        n += 1
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), pa.array(np.append(total[index], n))], names=["feature", "n"])

    df, n = np.zeros(DIM), 0
    for feature, count in train.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            n = count
        else:
            df[feature] = count
    model = Model(langs, np.log((1 + n) / (1 + df)) + 1, np.zeros((DIM + 1, max(1, len(langs))), np.float32))
    if not langs:
        return model

    def sampled(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0].tolist() if x else [] for x in found], pa.list_(pa.int32())), pa.array([x[1].tolist() if x else [] for x in found], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "feature", "n"],
            )

    # the first per_lang rows of each language by a hash of their id; each task keeps as many of a language at most
    rank = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = train.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_lang).select("doc_id", "lang", "text").mapInArrow(sampled, "doc_id long, lang string, feature array<int>, n array<int>").collect()
    sample = sorted((r for r in sample if r[2]), key=lambda r: (r[0], r[1], r[2]))
    at = {x: i for i, x in enumerate(langs)}
    rows = [((np.array(r[2], np.int64), np.array(r[3], np.int64)), at[r[1]]) for r in sample]
    tune = [i for i in range(len(rows)) if i % 5 == 4]
    learn = [i for i in range(len(rows)) if i % 5 != 4]
    train_ftrl(model, [rows[i][0] for i in learn], [rows[i][1] for i in learn])
    calibrate(model, [rows[i][0] for i in tune], [rows[i][1] for i in tune])
    return model


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __lang_pred and __score; only the text is looked at."""
    import pyarrow as pa

    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [model.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "__lang_pred", "__score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())]))


def identify(docs: DataFrame, per_lang: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred (`und` for null texts and texts without a letter), score, per row of docs."""
    model = fit(docs, per_lang)
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return annotate(src, model).select("doc_id", held.alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, per_lang: int = 300) -> DataFrame:
    """The rows of docs whose language is told with a score of least or more, with docs's columns.

    Null texts and texts without a letter go. Where no row has a language to learn from, all texts with a letter stay.
    """
    model = fit(docs, per_lang)
    if not model.langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return annotate(docs, model).where((F.col("__lang_pred") != "und") & (F.col("__score") >= least)).select(*docs.columns)
