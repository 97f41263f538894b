"""Fill-in-the-middle examples from whole texts, cut at line ends.

Where a line ends is looked up in a learned rank index: segments of straight lines are fitted to all
boundary offsets of a text, none further off than a bound, and what is left is kept as one small
number per boundary. A cut after ``k`` lines is predicted by its segment and put right by its
residual, so it is exact. Offsets count code points.

Texts stay where they lie; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import bounded_slices

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A prediction is off by no more, so a residual fits a byte.
MOST_OFF = 100


def line_ends(text: str) -> np.ndarray:
    """Offsets in code points of all unit boundaries, 0 first; a unit is a line with its line feed, or the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(codes == 10) + 1
    rest = [len(codes)] if len(codes) and codes[-1] != 10 else []
    return np.concatenate(([0], ends, rest)).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """Boundary offsets by rank: for each segment its first rank, offset there and slope; a residual per boundary."""

    first: np.ndarray
    start: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, most_off: int = MOST_OFF) -> RankIndex:
        """Segments as long as one slope keeps all their boundaries within ``most_off``, from left to right."""
        first, slopes = [], []
        begin, count = 0, len(offsets)
        while begin < count:
            low, high, reach, ahead = -np.inf, np.inf, begin + 1, 32
            while reach < count:
                # The slopes that suit every boundary so far narrow with each further one.
                steps = np.arange(reach, min(reach + ahead, count)) - begin
                rise = offsets[begin + steps] - offsets[begin]
                lows = np.maximum.accumulate(np.append(low, (rise - most_off) / steps))[1:]
                highs = np.minimum.accumulate(np.append(high, (rise + most_off) / steps))[1:]
                fits = lows <= highs
                good = len(fits) if fits.all() else int(np.argmin(fits))
                if good:
                    low, high = lows[good - 1], highs[good - 1]
                reach += good
                if good < len(fits):
                    break
                ahead *= 2
            first.append(begin)
            slopes.append((low + high) / 2 if reach > begin + 1 else 0.0)
            begin = reach
        first, slope = np.array(first, dtype=np.int64), np.array(slopes)
        bare = cls(first, offsets[first], slope, np.zeros(0, dtype=np.int16))
        return cls(first, offsets[first], slope, (offsets - bare.predict(np.arange(count))).astype(np.int16))

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone."""
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.start[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(ranks) + self.residual[ranks]


@dataclass(frozen=True)
class Example:
    """A text in its new order; the lengths count code points and are null for a plain text."""

    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def rearrange(text: str, key: str, seed: int, rate: int, suffix_first: int, marks: Sequence[str] = MARKS) -> Example:
    """The example of one text; all chances come from a digest of seed and key."""
    offsets = line_ends(text)
    units = len(offsets) - 1
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    cut_a, cut_b, chance, order = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or chance % 100 >= rate or any(mark in text for mark in marks):
        return Example(units, "plain", None, None, text)
    ranks = np.sort(np.array([cut_a % (units + 1), cut_b % (units + 1)]))
    a, b = map(int, RankIndex.fit(offsets).offsets(ranks))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    for_prefix, for_suffix, for_middle = marks
    if order % 100 < suffix_first:
        form, output = "spm", f"{for_suffix}{suffix}{for_prefix}{prefix}{for_middle}{middle}"
    else:
        form, output = "psm", f"{for_prefix}{prefix}{for_suffix}{suffix}{for_middle}{middle}"
    return Example(units, form, a, b - a, output)


def fill_in_middle(
    df: DataFrame,
    id_col: str,
    text_col: str,
    seed: int = 7,
    rate: int = 100,
    suffix_first: int = 50,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``rate`` percent of the texts are rearranged, ``suffix_first`` percent of these with the suffix
    first (``spm``), the others prefix, suffix, middle (``psm``). Empty texts and texts that hold a
    mark stay ``plain``, without lengths. ``n`` counts lines.

    A null text is empty. A null id counts as an empty one, so all rows without id share their
    chances; repeated rows give equal rows. Other columns are left out, an empty table gives none.
    """
    if len(set(marks)) != 3 or any(a in b for a in marks for b in marks if a != b):
        raise ValueError("three marks are needed, none within another")
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                made = [
                    rearrange(text, key, seed, rate, suffix_first, marks)
                    for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([m.units for m in made], pa.int64()),
                        pa.array([m.form for m in made], pa.string()),
                        pa.array([m.prefix_chars for m in made], pa.int64()),
                        pa.array([m.middle_chars for m in made], pa.int64()),
                        pa.array([m.output for m in made], pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    added = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(run, f"doc_id {id_type}, {added}")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text from its example; no part holds a mark, so the marks tell the parts."""
    parts = F.split(output, "|".join(re.escape(mark) for mark in marks))
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
