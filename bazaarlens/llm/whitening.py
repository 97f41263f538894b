"""Whitening of embeddings along their leading principal components.

Vectors become whole numbers first, ``floor(1024 c) + 100000``, so sums over all rows are exact and do
not depend on the order of tasks. The covariance takes one pass for the sums and one for the products
of centred vectors; each task sends one partial matrix, and only a matrix of dimension by dimension
reaches the driver.

Its leading eigenpairs come from spectrum slicing. By Sylvester's law of inertia the factorisation
L D L' of the covariance minus a shift has as many positive pivots as there are eigenvalues above
the shift. Bisection by these counts isolates an eigenvalue, Rayleigh quotient iteration converges
cubically to its pair, and two more counts close below and above certify which number it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.workspace import materialize

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Entries from here on would not fit a whole number of 64 bits and count as not finite.
_TOO_LARGE = float(1 << 52)
#: Sums are kept in two parts of so many low bits, so that they cannot overflow.
_LOW_BITS = 31
_EPS = float(np.finfo(np.float64).eps)


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: positive pivots of L D L' of matrix - shift.

    Pivots of one or two rows (Bunch and Kaufman); a pivot of two rows has one positive and one
    negative eigenvalue.
    """
    rest = matrix - shift * np.eye(len(matrix))
    bound = (1 + np.sqrt(17)) / 8
    positive = 0
    while len(rest):
        below = np.abs(rest[1:, 0])
        largest = below.max(initial=0.0)
        pivot = abs(rest[0, 0])
        if max(pivot, largest) == 0:
            rest = rest[1:, 1:]
            continue
        if pivot < bound * largest:
            other = int(below.argmax()) + 1
            reach = np.abs(np.delete(rest[:, other], other)).max()
            if pivot * reach < bound * largest**2:
                two = abs(rest[other, other]) < bound * reach
                front = [0, other] if two else [other]
                order = front + [i for i in range(len(rest)) if i not in front]
                rest = rest[np.ix_(order, order)]
                if two:
                    positive += 1
                    side = rest[2:, :2]
                    rest = rest[2:, 2:] - side @ np.linalg.solve(rest[:2, :2], side.T)
                    rest = (rest + rest.T) / 2
                    continue
        positive += rest[0, 0] > 0
        side = rest[1:, 0]
        rest = rest[1:, 1:] - np.outer(side, side) / rest[0, 0]
    return int(positive)


@dataclass(frozen=True)
class Pair:
    """An eigenvalue with its unit vector, and the bounds between which counts find it alone by its number."""

    value: float
    vector: np.ndarray
    low: float
    high: float


def leading_pairs(matrix: np.ndarray, wanted: int) -> list[Pair]:
    """The ``wanted`` largest eigenpairs of a symmetric matrix, not all zero, by falling eigenvalue.

    Equal eigenvalues, to rounding, are told apart only by orthogonal vectors. The largest entry of
    a vector is positive.
    """
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    tiny = 8 * size * _EPS * norm
    counts = {-norm - 2 * tiny: size, norm + 2 * tiny: 0}
    pairs: list[Pair] = []
    for number in range(1, min(wanted, size) + 1):
        basis = np.array([p.vector for p in pairs]).reshape(len(pairs), size)
        while True:
            low = max(s for s, c in counts.items() if c >= number)
            high = min(s for s, c in counts.items() if c < number)
            alone = counts[low] - counts[high] == 1
            if alone or high - low <= tiny:
                value, vector, off = _refine(matrix, (low + high) / 2, basis, norm)
                near = max(2 * off, tiny)
                if low - near <= value <= high + near:
                    if count_above(matrix, value - near) >= number > count_above(matrix, value + near):
                        pairs.append(Pair(value, vector, value - near, value + near))
                        break
                if high - low <= tiny:
                    raise ArithmeticError(f"eigenvalue {number} is not certified")
            middle = (low + high) / 2
            counts[middle] = count_above(matrix, middle)
    return pairs


def _refine(matrix: np.ndarray, shift: float, basis: np.ndarray, norm: float) -> tuple[float, np.ndarray, float]:
    """Value, vector and residual by two inverse iterations at a shift, then Rayleigh quotients, apart from ``basis``."""
    size = len(matrix)
    apart = lambda v: v - basis.T @ (basis @ v)
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    # No entry is zero and no two are equal, so the start has a part along every eigenvector.
    vector = unit(apart(apart(np.cos(np.arange(1, size + 1)) + 2.0)))
    best: tuple[float, np.ndarray, float] | None = None
    for step in range(40):
        moved = matrix - shift * np.eye(size)
        try:
            solved = np.linalg.solve(moved, vector)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(moved + (_EPS * norm or _EPS) * np.eye(size), vector)
        if not np.isfinite(solved).all():
            break
        vector = unit(apart(apart(unit(solved))))
        image = matrix @ vector
        quotient = float(vector @ image)
        off = float(np.linalg.norm(image - quotient * vector))
        if best is None or off < best[2]:
            best = (quotient, vector, off)
        elif step > 3:
            break
        if step:
            shift = quotient
    value, vector, off = best if best else (shift, vector, norm)
    return value, vector if vector[np.abs(vector).argmax()] >= 0 else -vector, off


def _whole_numbers(column: pa.Array, dimension: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are used, and their vectors as whole numbers; with ``dimension``, only vectors of that length."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    entries = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    wrong = np.concatenate(([0], np.cumsum(~(np.abs(entries) < _TOO_LARGE))))
    used = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    if dimension is None:
        return used, lengths
    used &= lengths == dimension
    kept = entries[np.repeat(used, lengths)].reshape(-1, dimension)
    return used, np.floor(kept * SCALE).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors in a task: rows, and sums of high and low parts by dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        used, lengths = _whole_numbers(batch.column("vector"), None)
        for length in np.unique(lengths[used]):
            _, x = _whole_numbers(batch.column("vector"), int(length))
            mine = held.setdefault(int(length), [0, np.zeros(length, np.int64), np.zeros(length, np.int64)])
            mine[0] += len(x)
            mine[1] += (x >> _LOW_BITS).sum(axis=0)
            mine[2] += (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)
    for length, (rows, high, low) in held.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([length], pa.int32()),
                pa.array([rows], pa.int64()),
                pa.array([high.tolist()], pa.list_(pa.int64())),
                pa.array([low.tolist()], pa.list_(pa.int64())),
            ],
            names=["length", "n", "high", "low"],
        )


def _products(center: np.ndarray):
    """The sum of products of centred vectors in a task, as the upper triangle by rows."""
    upper = np.triu_indices(len(center))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(center), len(center)))
        for batch in batches:
            _, x = _whole_numbers(batch.column("vector"), len(center))
            centred = (x - center).astype(np.float64)
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array([total[upper]], pa.list_(pa.float64()))], names=["products"])

    return run


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``sums`` (Python's whole numbers), and the components of their covariance."""

    n: int
    sums: list[int]
    trace: float
    pairs: list[Pair]

    @property
    def center(self) -> np.ndarray:
        """The mean, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """``n`` times the mean without its rounded part."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.center, strict=True)], dtype=np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors."""
        axes = np.array([p.vector / np.sqrt(p.value) for p in self.pairs]).reshape(len(self.pairs), len(self.sums))
        return ((x - self.center) - self.rest / self.n) @ axes.T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of ``(n x - sums)^2``, exact; null where one does not fit 64 bits."""
        apart = x - self.center
        largest = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if largest**2 * len(self.sums) < 1 << 63:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * apart.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def fit(df: DataFrame, vector_col: str, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of all used vectors; null without any.

    A vector that is null, empty or holds an entry that is null, not finite or of 2^52 or more is not
    used, nor one that is not of the most frequent length (of equally frequent ones, the longest).
    Components without variance, to rounding, are left out.
    """
    vectors = df.select(F.col(vector_col).alias("vector"))
    parts = materialize(
        vectors.mapInArrow(_sums, "length int, n bigint, high array<bigint>, low array<bigint>"), "sums"
    )
    found = (
        parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    )
    if not found:
        return None
    n, length = found[0]["n"], found[0]["length"]
    by_place = (
        parts.filter(F.col("length") == length)
        .select(F.posexplode(F.arrays_zip("high", "low")).alias("place", "part"))
        .groupBy("place").agg(F.sum("part.high").alias("high"), F.sum("part.low").alias("low"))
        .orderBy("place").collect()
    )
    sums = [(r["high"] << _LOW_BITS) + r["low"] for r in by_place]
    bare = Whitening(n, sums, 0.0, [])
    products = (
        vectors.mapInArrow(_products(bare.center), "products array<double>")
        .select(F.posexplode("products").alias("place", "product"))
        .groupBy("place").agg(F.sum("product").alias("product"))
        .collect()
    )
    upper = np.zeros(length * (length + 1) // 2)
    for row in products:
        upper[row["place"]] = row["product"]
    covariance = np.zeros((length, length))
    covariance[np.triu_indices(length)] = upper / n
    covariance = covariance + np.triu(covariance, 1).T
    mean_rest = bare.rest / n
    covariance -= np.outer(mean_rest, mean_rest)
    trace = float(np.trace(covariance))
    # Rounding alone leaves less variance than this.
    pairs = leading_pairs(covariance, components) if trace > 0 else []
    return Whitening(n, sums, trace, [p for p in pairs if p.value > 8 * length * _EPS * trace])


def _moments(model: Whitening):
    """Sums of whitened vectors and of their products in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.pairs)
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = _whole_numbers(batch.column("vector"), len(model.sums))
            whitened = model.project(x)
            total += whitened.sum(axis=0)
            products += whitened.T @ whitened
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate((total, products.ravel()))], pa.list_(pa.float64()))], names=["moments"]
        )

    return run


def identity_error(df: DataFrame, vector_col: str, model: Whitening) -> float:
    """The largest entry of the covariance of all whitened vectors minus the identity, by a pass over them."""
    k = len(model.pairs)
    rows = (
        df.select(F.col(vector_col).alias("vector"))
        .mapInArrow(_moments(model), "moments array<double>")
        .select(F.posexplode("moments").alias("place", "moment"))
        .groupBy("place").agg(F.sum("moment").alias("moment"))
        .orderBy("place").collect()
    )
    moments = np.array([r["moment"] for r in rows]) / model.n
    mean, products = moments[:k], moments[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every used vector and component.

    Null ids and repeated rows stay as they are, each row on its own. Without a used vector, or when
    all used vectors are equal, no component has variance and there are no rows. Other columns are
    left out. ``deviation`` is null where it does not fit 64 bits.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, deviation bigint, parts array<double>"
    model = fit(df, vector_col, components)
    explained = [p.value / model.trace for p in model.pairs] if model else []
    error = identity_error(df, vector_col, model) if explained else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not explained:
            return
        for batch in batches:
            used, x = _whole_numbers(batch.column("vector"), len(model.sums))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").filter(pa.array(used)),
                    pa.array(model.deviations(x), pa.int64()),
                    pa.array(list(model.project(x)), pa.list_(pa.float64())),
                ],
                names=["vec_id", "deviation", "parts"],
            )

    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(run, schema)
    share = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("parts").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
