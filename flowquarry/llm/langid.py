"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text with digits and punctuation turned
to blanks, in ``DIM`` slots; their document frequencies are counted over all training rows.  A bounded
sample of distinct training texts (``per_lang`` a language, fewer where all languages together would pass
``most_rows``; those with the smallest hashes) goes to the driver as sparse counts and trains one weight a slot
and language by follow-the-regularised-leader with L1 and L2 penalties, which keeps the weights sparse.
Every language of which a training text has a letter is learned, however often its texts are repeated.  A second bounded sample, disjoint from the first, fits one
temperature that calibrates the probabilities.  Scoring runs in Arrow batches over whole texts.

Defined cases: text that is null or has no letter gets ``und`` and score 0; rows with null lang or text
train nothing; a row with null doc_id is not held out and trains; without any training row all texts get
``und`` and score 0, and ``identified`` keeps no row; long texts are counted in
blocks of characters; repeated rows do not matter beyond their weight in counts; an empty table gives
an empty result; lang, source and doc_id are no inputs of a prediction; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import batches_of, discard, free_name, materialise

UNKNOWN = "und"
DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Rows of each language that train, and that calibrate.  Bounds the driver's share.
PER_LANG = 400
CALIBRATE_PER_LANG = 100
#: Most rows of all languages together that train and calibrate.
MOST_ROWS = 200_000
BLOCK = 1 << 20
#: Texts that a worker gets at a time in ``identified``.
BATCH = 200


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters than letters and marks is one blank."""
    lowered = text.lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    small = points < 128
    letter = np.where(small, (points >= 97) & (points <= 122), (points != 0xD7) & (points != 0xF7) & (points >= 0xC0) | (points == 0xAA) | (points == 0xB5) | (points == 0xBA))
    wide = np.flatnonzero((points >= 0x2000) & letter)
    if len(wide):  # only texts with characters past the Latin to Indic blocks look each of those up
        kinds = {p: chr(p).isalpha() for p in set(points[wide].tolist())}
        letter[wide] = [kinds[p] for p in points[wide].tolist()]
    if not letter.any():
        return points[:0]
    points = np.where(letter, points, 32)
    keep = letter | np.concatenate(([True], letter[:-1]))
    return points[keep]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a text's n-grams; no slots if it has no letter."""
    if not text or not any(map(str.isalpha, text[:64])) and not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = _letters(text)
    total = np.zeros(DIM, dtype=np.int64)
    for at in range(0, len(points), BLOCK):
        p = points[max(0, at - max(ORDERS) + 1) : at + BLOCK].astype(np.uint32)
        lead = min(at, max(ORDERS) - 1)
        h = np.zeros(len(p), dtype=np.uint32)
        for k in ORDERS:
            h = h[: len(p) - k + 1] * np.uint32(0x01000193) + p[k - 1 :] * np.uint32(0x9E3779B1) if k > 1 else p * np.uint32(0x9E3779B1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k)
            total += np.bincount(mixed[max(0, lead - k + 1) :] >> np.uint32(32 - 14), minlength=DIM)
    slots = np.flatnonzero(total)
    return slots, total[slots]


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[slots]
        norm = np.sqrt((v * v).sum())
        return v / norm if norm > 0 else v

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(slots, counts) @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        slots, counts = features(text)
        if not len(slots) or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(slots, counts)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, langs: list[str], idf: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, batch: int = 32, steps: int = 320, seed: int = 7) -> LanguageModel:
    """Train by follow-the-regularised-leader (proximal, per coordinate) with an elastic-net penalty.

    All languages weigh the same, however few texts one has; small samples are gone through until ``steps`` batches are done.
    """
    k = len(langs)
    weight = (len(rows) / k / np.maximum(1, np.bincount(ys, minlength=k)))[ys]
    epochs = max(epochs, -(-steps * batch // len(rows)))
    model = LanguageModel(langs, idf, np.zeros((DIM, k)), np.zeros(k))
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    vectors = [model.vector(s, c) for s, c in rows]
    rng = np.random.default_rng(seed)

    def solve(at: np.ndarray) -> np.ndarray:
        rate = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / rate)

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            touched = np.unique(np.concatenate([rows[i][0] for i in some] + [np.array([DIM])]))
            w = solve(touched)
            places = [np.append(np.searchsorted(touched, rows[i][0]), len(touched) - 1) for i in some]
            values = [np.append(vectors[i], 1.0) for i in some]
            p = _softmax(np.array([v @ w[a] for a, v in zip(places, values, strict=True)]))
            p[np.arange(len(some)), ys[some]] -= 1
            p *= weight[some][:, None]
            g = np.zeros_like(w)
            for a, v, d in zip(places, values, p / len(some), strict=True):
                g[a] += v[:, None] * d[None, :]
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / alpha
            z[touched] += g - sigma * w
            n[touched] += g * g
    w = solve(np.arange(DIM + 1))
    model.weights, model.bias = w[:DIM], w[DIM]
    return model


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray) -> float:
    """The temperature with the smallest negative log likelihood on rows that did not train."""
    if not rows:
        return 1.0
    x = np.array([model.logits(s, c) for s, c in rows])

    def loss(t: float) -> float:
        p = _softmax(x / t)
        return float(-np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-12)).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def train(docs: DataFrame, per_lang: int = PER_LANG, calibrate_per_lang: int = CALIBRATE_PER_LANG, most_rows: int = MOST_ROWS) -> LanguageModel:
    """Learn from the rows of ``docs`` that have text and lang and are not held out."""
    spark = docs.sparkSession
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                df[features(t.as_py())[0]] += 1
                rows += 1
        slots = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1), pa.int64()), pa.array(np.append(df[slots], rows), pa.int64())], names=["slot", "df"])

    counted = usable.select("text").mapInArrow(frequency, "slot long, df long").groupBy("slot").agg(F.sum("df")).collect()  # at most DIM + 1 rows
    df = np.zeros(DIM)
    total = 0
    for slot, v in counted:
        if slot < 0:
            total = v
        else:
            df[slot] = v
    idf = np.log((1 + total) / (1 + df)) + 0.1

    # Distinct texts by language, named by hash; ranking in two steps keeps no language in one task, however many texts it has.
    lettered = usable.filter(F.col("text").rlike(r"\p{L}"))
    distinct = materialise(lettered.select("lang", F.xxhash64("text").alias("hash_")).distinct())
    n_langs = max(1, distinct.select("lang").distinct().count())
    quota = max(1, min(per_lang + calibrate_per_lang, most_rows // n_langs))
    learners = max(1, quota * per_lang // (per_lang + calibrate_per_lang))
    order = [F.pmod("hash_", F.lit(1 << 40)), F.col("hash_")]
    split = distinct.withColumn("part_", F.pmod(F.xxhash64("hash_"), F.lit(64)))
    few = split.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part_").orderBy(*order))).filter(F.col("place") <= quota)
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= quota).select("lang", "hash_", "place")
    # At most ``most_rows`` hashes, or one a language.
    chosen = lettered.withColumn("hash_", F.xxhash64("text")).join(F.broadcast(materialise(ranked)), ["lang", "hash_"])
    sampled = chosen.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([s for s, _ in got], pa.list_(pa.int32())), pa.array([c for _, c in got], pa.list_(pa.int32()))], names=["lang", "place", "slots", "counts"])

    sample = sampled.select("text", "lang", "place").mapInArrow(sparse, "lang string, place int, slots array<int>, counts array<int>")
    table = sample.toArrow()
    discard(distinct)
    rows = [(np.asarray(s.values, dtype=np.int64), np.asarray(c.values, dtype=np.int64)) for s, c in zip(table["slots"], table["counts"], strict=True)]
    langs = sorted(set(table["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    ys = np.array([number[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    place = np.array(table["place"].to_pylist())
    order = np.lexsort((ys, place)) if len(ys) else np.zeros(0, dtype=int)
    learn = [i for i in order if len(rows[i][0]) and place[i] <= learners]
    check = [i for i in order if len(rows[i][0]) and place[i] > learners]
    if not learn:
        return LanguageModel([], idf, np.zeros((DIM, 0)), np.zeros(0))
    model = fit([rows[i] for i in learn], ys[learn], langs, idf)
    model.temperature = calibrate(model, [rows[i] for i in check], ys[check])
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts):
        import pandas as pd

        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    plain = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    guess = free_name("guess_", docs.columns)
    return docs.withColumn(guess, run(F.col("text").cast("string"))).select(*[F.col(f"`{c}`") for c in plain], F.col(f"{guess}.lang_pred"), F.col(f"{guess}.score"))


def identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows whose language is unknown or less probable than ``least``.

    Where no row of ``docs`` has both text and lang there is nothing to learn from: every language is unknown and no row stays.
    """
    whole = free_name("doc_", ["text", "lang_pred", "score"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col("text").alias("text"))
    # Written here, as the size of batches is read when the job is planned.
    with batches_of(docs.sparkSession, BATCH):
        found = predict(packed, train(docs, **options))
        return materialise(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(whole).getField(c).alias(c) for c in docs.columns]))
