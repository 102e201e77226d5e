"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams, n from 1 to 3 blended, that both contain, over the
geometric mean of how many each contains (presence, not counts). A few training texts of each language are landmarks;
the Nyström features of a text are its kernel values with the landmarks, whitened by those among the landmarks. On them
a kernel ridge regression for each language against the rest is solved in closed form. Scoring a batch is two matrix
products: presence by landmark presence, and kernel values by coefficients.

Every language that the corpus names is learned, however many there are. What the model and its fit take is bounded by the
number of landmarks: which landmarks hold a gram is kept as lists, made dense for a bounded number of a batch's grams at a
time, and the regressions need sums of landmarks by landmarks and by languages, which tasks add up.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import stored

UNKNOWN = "und"


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """The distinct 1- to 3-grams of the lower-cased letters of a text, sorted, one number each; what is no letter
    counts as a space, runs as one. Empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    points = np.r_[32, points[(points != 32) | np.r_[True, points[:-1] != 32]], 32].astype(np.int64)
    return np.concatenate([np.unique(points), np.unique(points[:-1] << 21 | points[1:]), np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])])


#: Numbers of a matrix that is dense for a moment.
DENSE = 4_000_000
#: Languages up to which their counts are sent to all executors.
BROADCAST_LANGUAGES = 10_000
#: Rows of a matrix of sums that go together.
SUM_ROWS = 256


@dataclass
class Model:
    names: list[str]
    vocabulary: np.ndarray  # grams of the landmarks, sorted
    begins: np.ndarray  # where the list of each gram begins, and where the last one ends
    holders: np.ndarray  # the lists: landmarks that hold the gram
    scale: np.ndarray  # one over the root of each landmark's number of grams
    coefficients: np.ndarray  # landmarks x names

    def _dense(self, rows: np.ndarray) -> np.ndarray:
        """Presence of some grams of the vocabulary in the landmarks, scaled."""
        n = self.begins[rows + 1] - self.begins[rows]
        at = np.repeat(self.begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros((len(rows), len(self.scale)), np.float32)
        columns = self.holders[at]
        out[np.repeat(np.arange(len(rows)), n), columns] = self.scale[columns]
        return out

    def _steps(self, rows: np.ndarray, texts: int) -> Iterator[np.ndarray]:
        step = max(64, DENSE // max(1, len(self.scale), texts))
        return (rows[at : at + step] for at in range(0, len(rows), step))

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their grams, with the landmarks."""
        out = np.zeros((len(texts), len(self.scale)), np.float32)
        places = []
        for g in texts:
            place = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            places.append(place[self.vocabulary[place] == g])
        used = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        for rows in self._steps(used, len(texts)):
            has = np.zeros((len(texts), len(rows)), np.float32)
            for i, place in enumerate(places):
                mine = place[np.searchsorted(place, rows[0]) : np.searchsorted(place, rows[-1], "right")]
                has[i, np.searchsorted(rows, mine)] = 1 / np.sqrt(len(texts[i])) if len(texts[i]) else 0
            out += has @ self._dense(rows)
        return out

    def among(self) -> np.ndarray:
        """Kernel values of the landmarks with one another."""
        out = np.zeros((len(self.scale),) * 2)
        for rows in self._steps(np.arange(len(self.vocabulary)), 1):
            dense = self._dense(rows).astype(np.float64)
            out += dense.T @ dense
        return out

    def white(self) -> np.ndarray:
        """What turns kernel values into features."""
        size, axes = np.linalg.eigh(self.among())
        return axes[:, size > 1e-8] / np.sqrt(size[size > 1e-8])


def landmarks(texts: list[np.ndarray]) -> Model:
    """A model without coefficients."""
    every = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), [len(g) for g in texts]).astype(np.int32)
    order = np.argsort(every, kind="stable")
    vocabulary, begins = np.unique(every[order], return_index=True)
    if not len(vocabulary):
        vocabulary, begins = np.zeros(1, np.int64), np.zeros(1, np.int64)
    scale = np.array([1 / np.sqrt(len(g)) if len(g) else 0 for g in texts], np.float32)
    return Model([], vocabulary, np.append(begins, len(every)), of[order], scale, np.zeros((len(texts), 0), np.float32))


def sums(features: np.ndarray, places: np.ndarray, weight: np.ndarray, n_names: int) -> np.ndarray:
    """(features + names) x features: the weighted products of the features of rows with one another, and below them the weighted
    sum of the rows of each name (places)."""
    weighted = features * weight[:, None]
    by_name = np.zeros((n_names, features.shape[1]))
    np.add.at(by_name, places, weighted)
    return np.concatenate([features.T @ weighted, by_name])


def fitted(model: Model, white: np.ndarray, names: list[str], added: np.ndarray, ridge: float) -> Model:
    """The model with a ridge regression for each name against the rest, from the sums of all rows."""
    size = white.shape[1]
    by_name = added[size:]
    target = 2 * by_name.T - by_name.sum(axis=0)[:, None]  # 1 for the name's own rows, -1 for the others
    found = np.linalg.solve(added[:size] + ridge * np.eye(size), target)
    return replace(model, names=names, coefficients=(white @ found).astype(np.float32))


def solve(model: Model, values: np.ndarray, labels: list[str], ridge: float) -> Model:
    """The fit from kernel values (rows x landmarks) that are all at hand; each language counts alike."""
    names, white = sorted(set(labels)), model.white()
    places = np.array([names.index(x) for x in labels])
    weight = 1 / np.bincount(places)[places]
    return fitted(model, white, names, sums(values.astype(np.float64) @ white, places, weight, len(names)), ridge)


def _texts(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    return [grams(t.as_py()) for t in batch.column(at)]


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)


def train(docs: DataFrame, per_language: int = 400, landmarks_per_language: int = 16, ridge: float = 1e-3, seed: int = 5, most_landmarks: int = 1024) -> Model | None:
    """Fits on documents (doc_id, text, lang) with a lang: a sample, drawn by hash of doc_id, of about per_language
    texts of each language, of them up to landmarks_per_language landmarks. Every language is learned. Beyond most_landmarks
    in all, each gives fewer, at least one while there are no more languages than that; a language without a landmark is
    told by those of others. The driver gets a number for each language, the landmarks' grams and sums of landmarks by
    landmarks and languages. None if there is nothing to learn from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    by_lang = stored(rows.groupBy("lang").agg(F.count("*").alias("n")))
    few = by_lang.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    share = lambda n: F.lit(float(n)) / F.col("n")
    drawn = rows.join(F.broadcast(by_lang) if few else by_lang, "lang").withColumn("draw", _draw(seed)).where(F.col("draw") < share(per_language))

    def as_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_texts(batch, 2), pa.list_(pa.int64()))], names=["lang", "draw", "grams"])

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([len(g) > 0 for g in _texts(batch, 1)], pa.bool_())).select(["lang"])

    counted = drawn.select("lang", "text").mapInArrow(lettered, "lang string").groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    sizes = {r["lang"]: r["n"] for r in sorted(counted, key=lambda r: r["lang"])}
    if not sizes:
        return None
    each = max(1, min(landmarks_per_language, most_landmarks // len(sizes)))
    near = drawn.where(F.col("draw") < share(2.0 * each))
    if len(sizes) > most_landmarks:
        near = near.where(F.pmod(F.xxhash64(F.lit(seed), "lang"), F.lit(len(sizes))) < most_landmarks)
    first = near.select("lang", "draw", "text").mapInArrow(as_grams, "lang string, draw double, grams array<bigint>")
    found: dict[str, list] = {}
    for row in sorted(first.where("size(grams) > 0").collect(), key=lambda r: (r["lang"], r["draw"], r["grams"])):
        found.setdefault(row["lang"], []).append(np.array(row["grams"], np.int64))
    marks = [g for lang in found.values() for g in lang[:each]]
    if not marks:
        return None
    model, names = landmarks(marks), list(sizes)
    white = model.white()
    sent = spark.sparkContext.broadcast((model, white, {x: i for i, x in enumerate(names)}, np.array([1 / sizes[x] for x in names])))  # bounded by the landmarks and a number for each language

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, white, place, weight = sent.value
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = _texts(part, 1)
                some = [i for i, g in enumerate(texts) if len(g)]
                if some:
                    places = np.array([place[part.column(0)[i].as_py()] for i in some])
                    more = sums(model.kernel([texts[i] for i in some]).astype(np.float64) @ white, places, weight[places], len(place))
                    total = more if total is None else total + more
        if total is not None:
            parts = range(0, len(total), SUM_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([total[i : i + SUM_ROWS].tobytes() for i in parts], pa.binary())], names=["at", "part"])

    def together(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in sorted(t.column("part").to_pylist())], axis=0)
        return pa.table({"at": t.column("at").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    # the sample is small; few tasks make few sums
    dealt = drawn.select("lang", "text", "draw").repartition(max(1, min(64, spark.sparkContext.defaultParallelism)), "draw").sortWithinPartitions("draw", "lang")
    summed = dealt.select("lang", "text").mapInArrow(added, "at int, part binary").groupBy("at").applyInArrow(together, "at int, part binary").collect()
    every = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(summed, key=lambda r: r["at"])]).reshape(-1, white.shape[1])
    return fitted(model, white, names, every, ridge)


def _scored(texts: list[np.ndarray], model: Model | None, sharpness: float) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is not None and texts:
        raw = model.kernel(texts) @ model.coefficients
        odds = np.exp(sharpness * (raw - raw.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        for i in np.flatnonzero([len(g) for g in texts]):
            names[i], scores[i] = model.names[odds[i].argmax()], float(odds[i].max())
    return names, scores


def predict(docs: DataFrame, model: Model | None, sharpness: float = 4.0) -> DataFrame:
    """documents (doc_id, text) as doc_id, lang_pred, score.

    score: softmax of the regressions' values, of the predicted language. Null texts and texts without a letter are
    `und` with score 0, and so is everything without a model. Whole texts count; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks' grams and coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = _scored(_texts(part, 1), sent.value, sharpness)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, above_chance: float = 1.2, sharpness: float = 4.0) -> DataFrame:
    """The documents in a language that the model knows, all columns as they were.

    Those without a letter go, and those for which no language stands out: whose score is less than above_chance times
    that of an even guess, as with texts that share hardly an n-gram with any landmark. Without a model, or with one
    language only, the letters alone decide.
    """
    sent, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        least = above_chance / len(model.names) if model is not None and len(model.names) > 1 else 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = _texts(part, text)
                _, scores = _scored(texts, model, sharpness)
                yield part.filter(pa.array([len(g) > 0 and x >= least for g, x in zip(texts, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
