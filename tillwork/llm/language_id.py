"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter three-gram is the
product of its letters' vectors, the first rotated twice and the second once, so
order matters. A text is the sum of its three-grams' vectors, a language the sum
of its training texts, each weighted by the inverse length of its three-gram
counts. A text gets the language with the highest cosine.

Training sums are made per task and added up in Spark as whole numbers, so they do
not depend on the order of rows. What is collected is one vector for each
language. Prediction reads each text once and shuffles nothing.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so
is every text if nothing was learned. Among equal cosines the first language by
name wins. Rows without a language are not learned from. Case is ignored, marks
and digits only part words. A null doc_id counts as an empty one in the split.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.text import documents_of, slices, split_number, tidy

DIMENSIONS = 1024
SEED = 20240229
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
# ``known_language`` rejects texts less like every language than this, if they are
# long enough to tell; a word or two is like nothing much.
LEAST_COSINE = 0.1
LEAST_GRAMS = 200
_SYMBOLS = 256
_DIRECT = 0x80
_SCALE = 1 << 20
_CACHED = 20_000


class Profiler:
    """Three-gram counts and vectors of texts; one per task."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        random = np.random.default_rng(SEED)
        self._letters = random.choice(np.array([-1, 1], np.int8), (_SYMBOLS, dimensions))
        self._dimensions = dimensions
        self._symbol: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._row = np.full(_SYMBOLS ** 3, -1, np.int32)
        self._vectors = np.zeros((1024, self._dimensions), np.int8)
        self._used = 0

    def _table(self, text: str) -> dict[int, int]:
        """Code point to symbol for the text: 0 parts words, letters have 1 to 255."""
        for character in set(text):
            if character not in self._symbol:
                code = ord(character)
                # The commonest scripts' letters keep a symbol each, the others share.
                self._symbol[character] = (
                    0 if not character.isalpha()
                    else 1 + code % (_DIRECT - 1) if code < _DIRECT
                    else _DIRECT + code % (_SYMBOLS - _DIRECT))
        return self._symbol

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct three-grams and how often each occurs; None without a letter."""
        lowered = text.lower()
        codes = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)
        table = self._table(lowered)
        alphabet = np.fromiter(map(ord, set(lowered)), np.uint32)
        if not len(alphabet):
            return None
        look_up = np.zeros(int(alphabet.max()) + 1, np.int32)
        look_up[alphabet] = [table[chr(c)] for c in alphabet]
        symbols = np.r_[0, look_up[codes], 0]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        symbols = symbols[keep]
        if len(symbols) < 3:
            return None
        grams = (symbols[:-2] << 16) | (symbols[1:-1] << 8) | symbols[2:]
        return np.unique(grams, return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        rows = self._row[grams]
        new = grams[rows < 0]
        if len(new):
            if self._used + len(new) > _CACHED:
                self._reset()
                new = grams
            while self._used + len(new) > len(self._vectors):
                self._vectors = np.concatenate([self._vectors, np.zeros_like(self._vectors)])
            bound = (
                np.roll(self._letters[new >> 16], 2, axis=1)
                * np.roll(self._letters[(new >> 8) & 255], 1, axis=1) * self._letters[new & 255])
            places = np.arange(self._used, self._used + len(new))
            self._vectors[places] = bound
            self._row[new] = places
            self._used += len(new)
            rows = self._row[grams]
        return self._vectors[rows]

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self._dimensions, np.float32)
        for k in range(0, len(grams), 4096):
            total += weights[k:k + 4096].astype(np.float32) @ self.vectors(grams[k:k + 4096]).astype(np.float32)
        return total


@dataclass(frozen=True)
class Languages:
    """Names in order and a unit vector for each."""

    names: tuple[str, ...]
    prototypes: np.ndarray

    def predict(self, profiler: Profiler, text: str | None) -> tuple[str, float]:
        found = profiler.counts(text) if text else None
        if found is None or not self.names:
            return UNKNOWN, 0.0
        return self.predict_counts(profiler, *found)

    def predict_counts(self, profiler: Profiler, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """The prediction from a text's three-grams and their counts."""
        vector = profiler.bundle(grams, counts)
        cosine = self.prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-9)
        best = int(np.argmax(cosine))
        return self.names[best], float(np.clip(cosine[best], 0, 1))


class _Weights:
    """Sums by three-gram; what was added is merged now and then."""

    def __init__(self) -> None:
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, grams: np.ndarray, values: np.ndarray) -> None:
        self._parts.append((grams, values))
        self._waiting += len(grams)
        if self._waiting > 500_000:
            self._parts = [self.total()]
            self._waiting = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        grams, place = np.unique(np.concatenate([g for g, _ in self._parts]), return_inverse=True)
        return grams, np.bincount(place, np.concatenate([v for _, v in self._parts]), len(grams))


def learn_languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> Languages:
    """Language vectors from the rows that are not held out and have a language."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dimensions)
        weights: dict[str, _Weights] = defaultdict(_Weights)
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if found := profiler.counts(text.decode("utf-8", "replace")):
                    grams, counts = found
                    weights[lang].add(grams, counts / np.sqrt((counts.astype(float) ** 2).sum()))
                if len(weights) > 64:
                    yield _summed(profiler, weights)
                    weights.clear()
        yield _summed(profiler, weights)

    labelled = documents_of(docs, F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (split_number(FOLDS) != HELD_OUT))
    partial = labelled.mapInArrow(tidy(learn), "lang string, place int, value long")
    sums = partial.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = {}
    for lang, place, value in sums.collect():
        vectors.setdefault(lang, np.zeros(dimensions))[place] = value
    names = tuple(sorted(n for n, v in vectors.items() if v.any()))
    matrix = np.array([vectors[n] / np.linalg.norm(vectors[n]) for n in names], np.float32)
    return Languages(names, matrix.reshape(len(names), dimensions))


def _summed(profiler: Profiler, weights: dict[str, _Weights]) -> pa.RecordBatch:
    langs, places, values = [], [], []
    for lang, weight in weights.items():
        total = profiler.bundle(*weight.total())
        langs += [lang] * len(total)
        places.append(np.arange(len(total), dtype=np.int32))
        values.append(np.rint(total.astype(float) * _SCALE).astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()),
         pa.array(np.concatenate([np.zeros(0, np.int32), *places])),
         pa.array(np.concatenate([np.zeros(0, np.int64), *values]))],
        names=["lang", "place", "value"])


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(languages.prototypes.shape[1])
        for batch in slices(batches, "text"):
            found = [
                languages.predict(profiler, t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([lang for lang, _ in found]), pa.array([score for _, score in found])],
                names=["doc_id", "held_out", "lang_pred", "score"])

    split = documents_of(docs).withColumn("held_out", split_number(FOLDS) == HELD_OUT)
    return split.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(
    docs: DataFrame, languages: Languages, least: float = LEAST_COSINE, long: int = LEAST_GRAMS,
) -> DataFrame:
    """The rows of ``docs``, whole, whose text has a learned language.

    A text of ``long`` three-grams or more also needs a cosine of ``least``: few say too little,
    however long the figures and marks around them are. If no language was
    learned, all texts with a three-gram are kept.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(languages.prototypes.shape[1])
        for batch in slices(batches, "text"):
            good = []
            for text in batch.column("text").to_pylist():
                found = profiler.counts(text) if text else None
                if found is None or not languages.names or int(found[1].sum()) < long:
                    good.append(found is not None)
                else:
                    good.append(languages.predict_counts(profiler, *found)[1] >= least)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy(keep), T.StructType(docs.schema.fields))
