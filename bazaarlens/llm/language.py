"""Language identification with string kernels.

The kernel of two texts is the number of different n-grams (n = 1 to 3) that both hold, divided by
the geometric mean of their own numbers: a blended spectrum of presences, over whole texts. A bounded
set of landmark texts gives the Nystrom features, and one ridge regression per language, against the
rest, is solved in that space. Scoring a batch is one matrix product with the landmarks.

The model is fitted on a bounded, documented sample of labelled rows; every row is then scored where
it lies, with no shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts

UNDETERMINED = "und"
#: Symbols: 0 everything but letters, from 2 on the letters of the alphabet. Letters outside of it share these by a
#: hash, so that scripts beyond the alphabet are still told apart by their n-grams.
SYMBOLS = 64
_CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
_BMP = 1 << 16
#: Rows whose n-gram presences are held at once.
_BLOCK = 256
#: Parts in which the first rows of a language are sought.
PARTS = 256


def has_letter(text: str) -> bool:
    """Whether any character is a letter of any script."""
    return any(map(str.isalpha, text))


def hashed_symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of letters outside the alphabet: the upper bits of a product of the code point."""
    mixed = (points.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(SYMBOLS - 2)) >> np.uint64(32)).astype(np.uint8) + np.uint8(2)


def symbol_table(alphabet: str) -> np.ndarray:
    """The symbol of every character of the basic plane."""
    letters = np.fromiter((chr(c).isalpha() for c in range(_BMP)), dtype=bool, count=_BMP)
    table = np.where(letters, hashed_symbols(np.arange(_BMP)), np.uint8(0))
    for i, letter in enumerate(alphabet[: SYMBOLS - 2]):
        table[ord(letter)] = i + 2
    return table


def ngram_codes(text: str, table: np.ndarray) -> np.ndarray:
    """The sorted different codes of the 1- to 3-grams of a text; runs of other characters are one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = table[np.minimum(points, _BMP - 1)]
    symbols[points >= _BMP] = hashed_symbols(points[points >= _BMP])
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    symbols = symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))]
    pairs = symbols[:-1] * SYMBOLS + symbols[1:]
    triples = pairs[:-1] * SYMBOLS + symbols[2:]
    present = np.zeros(_CODES, dtype=bool)
    present[symbols] = True
    present[0] = False
    present[SYMBOLS + pairs] = True
    present[SYMBOLS + SYMBOLS**2 + triples] = True
    return np.flatnonzero(present)


@dataclass(frozen=True)
class KernelModel:
    """Landmarks as a matrix of n-gram presences, and the weights of every language."""

    languages: tuple[str, ...]
    table: np.ndarray
    column: np.ndarray  # the landmark column of a code, or -1
    landmarks: np.ndarray  # presences, n-grams x landmarks
    sizes: np.ndarray  # different n-grams of each landmark
    weights: np.ndarray  # landmarks x languages

    def kernel(self, codes: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (as codes) against all landmarks, by one matrix product."""
        return kernel_rows(codes, self.column, self.landmarks, self.sizes)

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of every text."""
        names, scores = [], []
        for begin in range(0, len(texts), _BLOCK):
            block = texts[begin : begin + _BLOCK]
            values = self.kernel([ngram_codes(t, self.table) for t in block]) @ self.weights
            grown = np.exp(4.0 * (values - values.max(axis=1, keepdims=True)))
            share = grown / grown.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            for i, text in enumerate(block):
                known = has_letter(text)
                names.append(self.languages[best[i]] if known else UNDETERMINED)
                scores.append(float(share[i, best[i]]) if known else 0.0)
        return names, scores


def kernel_rows(codes: list[np.ndarray], column: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Normalised presence kernels of texts against landmarks."""
    present = np.zeros((len(codes), len(landmarks)), dtype=np.float32)
    own = np.empty(len(codes))
    for i, code in enumerate(codes):
        at = column[code]
        present[i, at[at >= 0]] = 1.0
        own[i] = max(1, len(code))
    return (present @ landmarks) / np.sqrt(own[:, None] * sizes[None, :])


def fit(texts: list[str], langs: list[str], per_language: int = 32, ridge: float = 1e-3) -> KernelModel | None:
    """Fit on labelled texts; the first ``per_language`` of every language are the landmarks.

    None without a labelled text that has letters.
    """
    rows = [(t, g) for t, g in zip(texts, langs, strict=True) if has_letter(t)]
    if not rows:
        return None
    letters = Counter(c for t, _ in rows for c in t.lower() if c.isalpha() and ord(c) < _BMP)
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2])
    table = symbol_table(alphabet)
    codes = [ngram_codes(t, table) for t, _ in rows]
    languages = tuple(sorted({g for _, g in rows}))
    chosen = [i for g in languages for i in [j for j, (_, x) in enumerate(rows) if x == g][:per_language]]
    known = np.unique(np.concatenate([codes[i] for i in chosen]))
    column = np.full(_CODES, -1, dtype=np.int32)
    column[known] = np.arange(len(known))
    landmarks = np.zeros((len(known), len(chosen)), dtype=np.float32)
    for j, i in enumerate(chosen):
        landmarks[column[codes[i]], j] = 1.0
    sizes = landmarks.sum(axis=0).astype(np.float64)
    to_all = np.vstack(
        [kernel_rows(codes[b : b + _BLOCK], column, landmarks, sizes) for b in range(0, len(codes), _BLOCK)]
    )
    values, vectors = np.linalg.eigh(to_all[chosen])
    kept = values > 1e-6 * values.max()
    nystrom = vectors[:, kept] / np.sqrt(values[kept])
    features = to_all @ nystrom
    targets = np.array([[1.0 if g == x else -1.0 for x in languages] for _, g in rows])
    system = features.T @ features + ridge * len(rows) * np.eye(features.shape[1])
    return KernelModel(languages, table, column, landmarks, sizes, nystrom @ np.linalg.solve(system, features.T @ targets))


def training_sample(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, learn_from: Column, per_class: int, most: int
) -> list[tuple[str, str]]:
    """At most ``per_class`` labelled texts of every language and ``most`` in all, by the order of a hash of the id.

    Ids and languages are chosen without reading a text; each task keeps ``per_class`` rows per language.
    """
    labelled = df.filter(learn_from & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.xxhash64(F.col(id_col)).alias("__order")
    )
    order = [F.col("__order"), F.col("__id")]
    # First among the rows of some tasks, then among those found: no task meets all rows of a language.
    some = Window.partitionBy("__lang", "__part").orderBy(*order)
    place = Window.partitionBy("__lang").orderBy(*order)
    ids = (
        labelled.withColumn("__part", F.spark_partition_id() % PARTS)
        .withColumn("__n", F.row_number().over(some))
        .filter(F.col("__n") <= per_class)
        .withColumn("__n", F.row_number().over(place))
        .filter(F.col("__n") <= per_class)
        .orderBy("__n", "__lang")
        .limit(most)
        .select("__id", "__lang", "__n")
    )
    rows = (
        df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
        .filter(F.col("__text").isNotNull())
        .join(F.broadcast(ids), ["__id", "__lang"])  # ``most`` rows at most
        .orderBy("__n", "__lang", F.xxhash64("__text"))
        .limit(most)
        .collect()
    )
    return [(r["__text"], r["__lang"]) for r in rows]


def identify_languages(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    learn_from: Column,
    per_class: int = 300,
    most: int = 3000,
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.

    Learns from rows where ``learn_from`` holds and the language is known: up to ``per_class`` per
    language, ``most`` in all. Predictions see the text only. A text that is null or has no letter,
    and every text if nothing could be learned, is ``und`` with score 0. Repeated rows are each
    predicted; an empty table has no rows.
    """
    sample = training_sample(df, id_col, text_col, lang_col, learn_from, per_class, most)
    model = fit([t for t, _ in sample], [g for _, g in sample])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list[str]) -> dict[str, list]:
        fitted = shared.value
        names, scores = fitted.decide(texts) if fitted else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
        return {"lang_pred": names, "score": scores}

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, ["doc_id"], predict, {"lang_pred": "string", "score": "double"})
