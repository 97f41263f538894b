"""A filter of fixed size that tells which rows may be among wanted ones, before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bits per wanted row, and bits in all at most: 16 MB, whatever the input.
BITS_PER_ROW = 16
MOST_BITS = 1 << 27


def _places(digests, bits: int) -> Iterator[np.ndarray]:
    """Two places of every 16-byte digest; ``bits`` is a power of two."""
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    yield from (halves.T & np.uint64(bits - 1)).astype(np.int64)


class Sieve:
    """Knows the 16-byte digests of a column.

    A wanted digest always passes. Of the others few pass while the wanted ones are fewer than the
    bits; with more of them the sieve fills up and lets all pass, which is slower and still right.
    """

    def __init__(self, wanted: DataFrame, digest_col: str, most_bits: int = MOST_BITS):
        rows = max(wanted.count(), 1)
        bits = min(most_bits, 1 << max(10, int(rows * BITS_PER_ROW - 1).bit_length()))

        @pandas_udf("array<bigint>")
        def places(digests: pd.Series) -> pd.Series:
            return pd.Series(list(np.column_stack(list(_places(digests, bits)))))

        place = wanted.select(F.explode(places(digest_col)).alias("place"))
        words = (
            place.groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits"))
            .toArrow()
        )
        held = np.zeros(bits >> 6, dtype=np.int64)
        held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self._bits = bits
        self._held = wanted.sparkSession.sparkContext.broadcast(held)

    def passes(self, digest: Column | str) -> Column:
        """Whether a digest may be wanted."""
        bits, broadcast = self._bits, self._held

        @pandas_udf("boolean")
        def may_be(digests: pd.Series) -> pd.Series:
            held = broadcast.value
            found = np.ones(len(digests), dtype=bool)
            for place in _places(digests, bits):
                found &= (held[place >> 6] >> (place & 63)) & 1 == 1
            return pd.Series(found)

        return may_be(digest)
