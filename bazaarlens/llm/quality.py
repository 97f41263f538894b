"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Features are binned by quantiles of the training sample, trees grow level by level from sums per bin,
and the fitted forest is flattened into arrays (feature, threshold, leaf), so that a batch of texts
walks down all trees at once by array indexing. Rows are scored where they lie, with no shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import map_texts

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "marks", "pipes", "spaces", "newlines", "wide", "log_words",
    "word_bytes", "different_words", "top_word", "different_pairs", "marked_words", "doubled_marks",
    "short_words", "line_bytes", "different_lines", "common_words",
)
#: Frequent words of English, German, French and Spanish.
COMMON_WORDS = frozenset(
    "the of and to in is that for a on was with it as be by are from this or der die das und ist ein eine zu den "
    "nicht mit von le la les de des et un une que est dans pour el los las y en por con para se".split()
)


def statistics(text: str) -> list[float]:
    """The features of one text; an empty text has zeros only."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    upper, digits = seen[65:91].sum(), seen[48:58].sum()
    letters = upper + seen[97:123].sum() + seen[128:].sum()
    blanks = seen[32] + seen[9:14].sum()
    words = text.lower().split()
    count = max(1, len(words))
    by_word = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(not w[-1].isalnum() for w in words)
    doubled = sum(len(w) > 1 and not w[-2].isalnum() for w in words)
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(size),
        letters / size,
        upper / max(1, letters),
        digits / size,
        (size - letters - digits - blanks) / size,
        seen[124] / size,
        seen[32] / size,
        seen[10] / size,
        seen[128:].sum() / size,
        np.log1p(len(words)),
        size / count,
        len(by_word) / count,
        max(by_word.values(), default=0) / count,
        pairs / max(1, count - 1),
        marked / count,
        doubled / count,
        sum(n for w, n in by_word.items() if len(w) < 4) / count,
        size / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        sum(by_word[w] for w in COMMON_WORDS if w in by_word) / count,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth as arrays; node k of a tree has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    depth: int

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(rows), len(trees)), dtype=np.int64)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            right = rows[at, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.base + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def fit_forest(
    rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2,
    shrink: float = 1.0, least: float = 1.0,
) -> Forest:
    """Boosted trees for 0/1 labels by logistic loss. Without rows every probability is a half."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    base = float(np.log(share / (1.0 - share)))
    if len(rows) == 0 or labels.min() == labels.max():
        return Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in rows.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)])
    features = rows.shape[1]
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    total = np.full(len(rows), base)
    for t in range(trees):
        chance = 1.0 / (1.0 + np.exp(-total))
        slope, bend = labels - chance, chance * (1.0 - chance)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, cut = np.zeros((features, width)), np.zeros((features, width), dtype=np.int64)
            for f in range(features):
                at = (node - first) * bins + binned[:, f]
                left_s = np.bincount(at, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                left_b = np.bincount(at, bend, width * bins).reshape(width, bins).cumsum(axis=1)
                all_s, all_b = left_s[:, -1:], left_b[:, -1:]
                right_s, right_b = all_s - left_s, all_b - left_b
                better = left_s**2 / (left_b + shrink) + right_s**2 / (right_b + shrink) - all_s**2 / (all_b + shrink)
                better[(left_b < least) | (right_b < least)] = 0.0
                better[:, len(edges[f]) :] = 0.0
                cut[f] = better.argmax(axis=1)
                gain[f] = better[np.arange(width), cut[f]]
            best = gain.argmax(axis=0)
            for k in np.flatnonzero(gain.max(axis=0) > 1e-9):
                feature[t, first + k] = best[k]
                threshold[t, first + k] = edges[best[k]][cut[best[k], k]]
            right = rows[np.arange(len(rows)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        place = node - inner
        leaf[t] = rate * np.bincount(place, slope, leaves) / (np.bincount(place, bend, leaves) + shrink)
        total += leaf[t, place]
    return Forest(base, feature, threshold, leaf, depth)


def learn(
    df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, learn_from: Column,
    most: int,
) -> Forest:
    """A forest from at most ``most`` labelled rows, the first by a hash of the id; ``learn_from`` is on ``labels``.

    The sample is chosen among the labels; features are computed on the executors, and only they are gathered.
    """
    chosen = (
        labels.filter(learn_from & F.col(label_col).isNotNull())
        .select(F.col(label_id).alias("__id"), F.col(label_col).cast("double").alias("__label"))
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(most)
    )
    texts = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "__id").select("__id", "__label", "text")  # ``most`` rows at most
    rows = (
        map_texts(sample, ["__id", "__label"], lambda ts: {"features": [statistics(t) for t in ts]}, {"features": "array<double>"})
        .orderBy(F.xxhash64("__id"), "__id", "__label", "features")
        .limit(most)
        .collect()
    )
    table = np.array([r["features"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit_forest(table, np.array([r["__label"] for r in rows], dtype=float))


def probabilities(forest: Forest, texts: list[str]) -> np.ndarray:
    """The probability of label 1 of every text."""
    return forest.probability(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES)))


def rate_quality(
    df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, learn_from: Column,
    most: int = 6000, threshold: float = 0.3,
) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``df``.

    Learns from at most ``most`` labelled rows (see ``learn``); a score sees the text only. Empty and
    null texts are scored like any other; without labels every score is a half. Repeated rows are
    each scored; an empty table has no rows.
    """
    forest = learn(df, id_col, text_col, labels, label_id, label_col, learn_from, most)
    shared = df.sparkSession.sparkContext.broadcast(forest)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_texts(rows, ["doc_id"], lambda ts: {"score": probabilities(shared.value, ts)}, {"score": "double"})
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
