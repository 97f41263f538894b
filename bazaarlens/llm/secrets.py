"""Secret scan: known patterns, and windows of high Shannon entropy in candidate strings.

Candidates are the longest runs of one character class. A window slides over a run; the table of
counts per character changes by one character that leaves and one that enters, and the entropy with
it, by the difference of ``n * log2(n)`` of two counts. Stretches covered by windows above the
threshold of the class are found, unless an allow-list pattern matches the run.

Everything is column expressions on the row itself: no shuffle, and a row needs no key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class CharacterClass:
    """A class of candidate strings: longest runs of ``characters`` (also as the inside of a pattern class)."""

    kind: str
    characters: str
    inside: str
    window: int
    bits: float


#: Classes of the entropy scan, with the window and the bits per character that a window must exceed.
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", "0-9a-fA-F", 24, 3.05),
    CharacterClass(
        "entropy_base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=",
        "A-Za-z0-9+/_=-",
        24,
        4.05,
    ),
)
#: Runs that match one of these hold no secret: words without digits, numbers, repeated characters,
#: placeholders, and identifiers of the form 8-4-4-4-12.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[0-9]*$",
    r"(.)\1{7}",
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|your[_-]?(?:key|token|secret)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


def _span(start: Column, rank: int, end: Column, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind")
    )


_FOUND = "array<struct<start:int,value:string>>"


def with_matches(df: DataFrame, text_col: str, pattern: str, name: str) -> DataFrame:
    """Add ``name``: structs ``start, value`` of all leftmost matches that do not overlap, in code points.

    The text between matches gives their places. Steps are columns of their own, so that no pattern
    runs twice over a text, and the second one only if the first has found something.
    """
    gaps, found = f"__{name}_gaps", f"__{name}_found"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        match = F.struct(begin.alias("start"), pair["value"].alias("value"))
        after = (begin + F.length(pair["value"])).alias("at")
        return F.struct(after, F.concat(state["found"], F.array(match)).alias("found"))

    none = F.array().cast("array<string>")
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))
    )
    return (
        df.withColumn(gaps, F.split(text_col, pattern, -1))
        .withColumn(found, F.when(F.size(gaps) > 1, F.regexp_extract_all(text_col, F.lit(f"({pattern})"), 1)).otherwise(none))
        .withColumn(name, F.aggregate(pairs, start, step, lambda s: s["found"]))
        .drop(gaps, found)
    )


def _base_spans(assign: str, access: str, hexes: str) -> Column:
    """The spans of the three base kinds, unsorted, from the columns that hold their matches."""
    named = F.filter(assign, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= LEAST_ASSIGN)

    def spans(found: Column, rank: int, kind: str) -> Column:
        return F.transform(found, lambda m: _span(m["start"], rank, m["start"] + F.length(m["value"]), kind))

    return F.concat(spans(named, 0, "assign"), spans(F.col(access), 1, "access"), spans(F.col(hexes), 2, "hex"))


def _weight(count: Column) -> Column:
    """``n * log2(n)``, 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def entropy_stretches(run: Column, group: CharacterClass) -> Column:
    """Structs ``start, end`` of the stretches of a run covered by windows whose entropy exceeds the threshold.

    The state holds the counts per character and the sum of ``n * log2(n)``; the entropy of a window
    of w characters is ``log2(w) - sum / w``. Runs shorter than a window have no stretch.
    """
    width, size = group.window, len(group.characters)
    numbers = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(group.characters), c))
    # At most this sum of n * log2(n) may be left; rounding absorbs the error of the running sum.
    most = (math.log2(width) - group.bits) * width
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(-1).alias("begin"),
        F.lit(-1).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("found"),
    )

    def step(state: Column, place: Column) -> Column:
        enters, at = place["number"], place["at"]
        leaves = F.when(at >= width, place["left"]).otherwise(F.lit(0))
        gone = F.get(state["counts"], leaves - 1)
        without = state["total"] + F.when(leaves > 0, _weight(gone - 1) - _weight(gone)).otherwise(F.lit(0.0))
        counts = F.transform(
            state["counts"], lambda n, i: n - F.when(i + 1 == leaves, 1).otherwise(0) + F.when(i + 1 == enters, 1).otherwise(0)
        )
        before = F.get(state["counts"], enters - 1) - F.when(enters == leaves, 1).otherwise(0)
        total = without + _weight(before + 1) - _weight(before)
        hot = (at >= width - 1) & (F.round(total, 6) < most)
        joins = hot & (state["end"] >= at - width + 1)
        closes = hot & ~joins & (state["end"] >= 0)
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(joins | ~hot, state["begin"]).otherwise(at - width + 1).alias("begin"),
            F.when(hot, at + 1).otherwise(state["end"]).alias("end"),
            F.when(closes, F.concat(state["found"], F.array(F.struct(state["begin"].alias("start"), state["end"].alias("end")))))
            .otherwise(state["found"])
            .alias("found"),
        )

    def finish(state: Column) -> Column:
        last = F.struct(state["begin"].alias("start"), state["end"].alias("end"))
        return F.when(state["end"] >= 0, F.concat(state["found"], F.array(last))).otherwise(state["found"])

    padded = F.concat(F.array_repeat(F.lit(0), width), numbers)
    places = F.arrays_zip(
        F.sequence(F.lit(0), F.size(numbers) - 1).alias("at"), numbers.alias("number"), F.slice(padded, 1, F.size(numbers)).alias("left")
    )
    return F.aggregate(places, start, step, finish)


def _entropy_spans(runs: str, group: CharacterClass, rank: int, allowed: Sequence[str]) -> Column:
    """The spans of one class of the entropy scan, from the column that holds its runs."""

    def is_open(run: Column) -> Column:
        harmless = F.lit(False)
        for pattern in allowed:
            harmless = harmless | run["value"].rlike(pattern)
        return ~harmless

    def spans(run: Column) -> Column:
        return F.transform(
            entropy_stretches(run["value"], group),
            lambda s: _span(run["start"] + s["start"], rank, run["start"] + s["end"], group.kind),
        )

    return F.flatten(F.transform(F.filter(runs, is_open), spans))


def find_secrets(
    df: DataFrame,
    text_col: str,
    groups: Sequence[CharacterClass] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``: sorted arrays of ``start, rank, end, kind``, end exclusive.

    ``spans`` holds the base spans and those of the entropy scan that no base span contains. A null
    text is empty and has no spans. Rows are independent, so repeated rows and empty tables need
    nothing special. Columns of the same names are replaced.
    """
    found = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    # A run that is too short holds no longer one, so least lengths can stand in these patterns.
    patterns = {
        "__assign": ASSIGN,
        "__access": rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}",
        "__hex": rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}",
    } | {f"__{g.kind}": rf"(?<![{g.inside}])[{g.inside}]{{{g.window},}}" for g in groups}
    for name, pattern in patterns.items():
        found = with_matches(found, "__text", pattern, name)
    found = found.withColumn("base_spans", F.array_sort(_base_spans("__assign", "__access", "__hex")))
    more = [_entropy_spans(f"__{g.kind}", g, rank, allowed) for rank, g in enumerate(groups, start=3)]

    def inside_base(span: Column) -> Column:
        return F.exists("base_spans", lambda b: (b["start"] <= span["start"]) & (span["end"] <= b["end"]))

    added = F.filter(F.concat(*more), lambda s: ~inside_base(s))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", added).cast(_SPANS))).drop("__text", *patterns)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """A text with every span replaced by ``mask``; spans that overlap or touch get one mask together."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state: Column, span: Column) -> Column:
        apart = (span["start"] > state["at"]) | (state["at"] == 0)
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    one = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
