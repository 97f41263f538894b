"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; only the words at its ones are hashed. A window of a
document and a window of a test item have equal hashes if they agree on those words, whatever stands
at the ignored positions, so a replaced word does not hide a leak from every mask. Every hit fixes an
alignment of the document with the item. The aligned overlap is then verified word by word: the best
stretch scores a point for an equal word and loses two for a different one. It is a leak with ten
points, or with 60 points per 100 words of the item if that is less.

Items shorter than the shortest mask are found where all their words stand in a row, by a mask as
long as the item and without holes. Items of nine to thirteen words have one more mask, without which
some stretches that are leaks would have no seed. Letters of scripts without blanks are words.

All of it is DataFrame functions. The seeds of the test items are few and broadcast after their
number is checked; above the bound the same join is left to the planner, as a shuffle. Only documents
with hits are verified: a bit map of fixed size over the digests of their texts, joined by broadcast,
keeps other texts out of the shuffle that brings hits and documents together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.words import words_of
from bazaarlens.workspace import materialize

#: Masks of nine to twelve words with six ones each.
MASKS = ("110100101001", "1110100011", "101011011")
#: More masks for items of ``least`` to ``most`` words: with them, every leak of items of 9 to 24 words has a seed.
SHORT_MASKS = (("1111", 9, 10), ("111111", 11, 13))
#: Seeds of test items that are broadcast: 24 bytes each, 48 MB at most.
MOST_BROADCAST = 2_000_000
#: Places of the bit map of texts with hits: 2 to this power, 64 in a row of 16 bytes, so at most 16 MB whatever the input.
MAP_POWER = 26
#: Points that make a leak, and what a different word costs.
LEAST_POINTS, PENALTY = 10, 2
#: Points per 100 words of the item that make a leak, too.
LEAST_PERCENT = 60
#: Letters of scripts that are written without blanks, by code point: Java looks up scripts by name slowly. The first
#: range settles all other texts with one comparison.
_UNSPACED = (
    r"([\x{0E00}-\x{3FFFF}&&[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3040}-\x{30FF}"
    r"\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}]])"
)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of every word; a letter of a script without blanks is a word."""
    return F.transform(words_of(F.regexp_replace(text, _UNSPACED, " $1 ")), lambda w: F.xxhash64(w))


def seed_hashes(hashes: Column, masks: Sequence[str]) -> Column:
    """The seeds of all masks, one mask after the other, each in order of position; see ``seed_place``."""

    def under(number: int, mask: str) -> Column:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        places = F.sequence(F.lit(0), F.size(hashes) - len(mask))
        seeds = F.transform(places, lambda at: F.xxhash64(F.lit(number), *[F.get(hashes, at + i) for i in ones]))
        return F.when(F.size(hashes) >= len(mask), seeds).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[under(number, mask) for number, mask in enumerate(masks)])


def seed_place(index: Column, words: Column, masks: Sequence[str]) -> Column:
    """The position in a text of ``words`` words of a seed from its index in the list of all seeds."""
    place, before = F.lit(None).cast("int"), F.lit(0)
    for mask in masks:
        after = before + F.greatest(F.lit(0), words - len(mask) + 1)
        place = F.when((index >= before) & (index < after), index - before).otherwise(place)
        before = after
    return place


def seed_mask(index: Column, words: Column, masks: Sequence[str]) -> Column:
    """The mask of a seed from its index in the list of all seeds, by its number."""
    number, before = F.lit(None).cast("int"), F.lit(0)
    for k, mask in enumerate(masks):
        after = before + F.greatest(F.lit(0), words - len(mask) + 1)
        number = F.when((index >= before) & (index < after), k).otherwise(number)
        before = after
    return number


def masks_of_items(lengths: Sequence[int], masks: Sequence[str]) -> list[tuple[str, int, int | None]]:
    """The masks that items of these numbers of words need, each with the least and most words of its items.

    ``masks`` come first and hold for all items that are not shorter than the shortest of them.
    """
    shortest = min(len(m) for m in masks)
    more = [(m, max(least, shortest), most) for m, least, most in SHORT_MASKS]
    more += [("1" * n, n, n) for n in range(1, shortest)]
    needed = [(m, least, most) for m, least, most in more if any(least <= n <= most for n in lengths)]
    return [(m, shortest, None) for m in masks] + needed


def best_stretch(document: Column, item: Column, shift: Column, penalty: int) -> Column:
    """Struct ``points, equal`` of the best aligned stretch: word ``i`` of the item against ``i + shift`` of the document.

    ``points`` is the score of the stretch, ``equal`` its number of equal words.
    """
    begin = F.greatest(F.lit(0), -shift)
    length = F.least(F.size(item), F.size(document) - shift) - begin
    same = F.zip_with(
        F.slice(document, begin + shift + 1, length), F.slice(item, begin + 1, length), lambda a, b: a == b
    )
    start = F.struct(*[F.lit(0).alias(c) for c in ("points", "equal", "now", "now_equal")])

    def step(state: Column, equal: Column) -> Column:
        grown = state["now"] + F.when(equal, 1).otherwise(-penalty)
        now = F.greatest(F.lit(0), grown)
        now_equal = F.when(grown <= 0, 0).otherwise(state["now_equal"] + equal.cast("int"))
        better = now > state["points"]
        return F.struct(
            F.when(better, now).otherwise(state["points"]).alias("points"),
            F.when(better, now_equal).otherwise(state["equal"]).alias("equal"),
            now.alias("now"),
            now_equal.alias("now_equal"),
        )

    return F.aggregate(same, start, step, lambda s: F.struct(s["points"].alias("points"), s["equal"].alias("equal")))


def keep_wanted(rows: DataFrame, digest: Column, wanted: DataFrame, map_power: int = MAP_POWER) -> DataFrame:
    """Rows whose ``digest`` may be among the values of the one column of ``wanted``, by a bit map of ``2**map_power`` places.

    A wanted row always stays. Of the others few stay while the wanted values are fewer than the
    places; with many more of them all rows stay, which costs more and is still right.
    """

    def row_of(value: Column) -> Column:
        return F.pmod(F.shiftright(value, 6), F.lit(1 << (map_power - 6)))

    def bit_of(value: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), value.bitwiseAND(F.lit(63)).cast("int"))

    value = F.col(f"`{wanted.columns[0]}`")
    places = (
        wanted.filter(value.isNotNull())
        .groupBy(row_of(value).alias("__place"))
        .agg(F.bit_or(bit_of(value)).alias("__bits"))
    )
    near = rows.join(F.broadcast(places), row_of(digest) == F.col("__place"))
    return near.filter(F.col("__bits").bitwiseAND(bit_of(digest)) != 0).drop("__place", "__bits")


def find_leaks(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tests: DataFrame,
    item_col: str,
    item_text: str,
    masks: Sequence[str] = MASKS,
    least_points: int = LEAST_POINTS,
    penalty: int = PENALTY,
    most_broadcast: int = MOST_BROADCAST,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``doc_id, item_id, points, equal_words, item_words``: every document that holds a stretch of a test item.

    One row per document and item, with the best stretch over all alignments. Null and empty texts
    hold nothing, and items shorter than the shortest mask are found verbatim only. Rows with a null id are
    searched like others. Rows that share an id and a text are one document; rows that share only the
    id are searched apart, and the best of them counts. Repeated items are one item; empty tables
    have no leaks.
    """
    items = materialize(
        tests.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("item")).distinct(),
        "items",
    )
    shortest = min(len(m) for m in masks)
    limit = max(shortest, *(most for _, _, most in SHORT_MASKS))
    lengths = items.select(F.size("item").alias("words")).filter(F.col("words") <= limit).distinct().collect()
    used = masks_of_items([r["words"] for r in lengths], masks)
    masks = [m for m, _, _ in used]
    of_mask = F.lit(False)
    for number, (_, least, most) in enumerate(used):
        fits = F.col("words") >= least if most is None else F.col("words").between(least, most)
        of_mask = F.when(F.col("mask") == number, fits).otherwise(of_mask)
    seeds = materialize(
        items.withColumn("words", F.size("item"))
        .withColumn("seeds", seed_hashes(F.col("item"), masks))
        .select("item_id", "words", F.posexplode_outer("seeds").alias("index", "seed"))
        .filter("seed IS NOT NULL")
        .withColumn("mask", seed_mask(F.col("index"), F.col("words"), masks))
        .filter(of_mask)
        .select(
            "item_id",
            "seed",
            seed_place(F.col("index"), F.col("words"), masks).alias("item_at"),
            F.when(F.col("words") < shortest, F.col("words")).alias("whole"),
        ),
        "seeds",
    )
    small = seeds.count() <= most_broadcast

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    # The outer form, as the other one adds a filter that would hash the words once more for every seed.
    windows = (
        rows.select("doc_id", F.xxhash64("text").alias("digest"), word_hashes(F.col("text")).alias("document"))
        .select("doc_id", "digest", F.size("document").alias("words"), seed_hashes(F.col("document"), masks).alias("seeds"))
        .select("doc_id", "digest", "words", F.posexplode_outer("seeds").alias("index", "seed"))
    )
    at = seed_place(F.col("index"), F.col("words"), masks)
    # Of an item that is found as a whole, one place in a document is enough.
    shift = (at - F.col("item_at")).alias("shift")
    hits = materialize(
        windows.join(F.broadcast(seeds) if small else seeds, "seed")
        .select("doc_id", "digest", "item_id", "whole", shift)
        .groupBy("doc_id", "digest", "item_id", "whole", F.when(F.col("whole").isNull(), F.col("shift")).alias("apart"))
        .agg(F.min("shift").alias("shift"))
        .select("doc_id", "digest", "item_id", "shift"),
        "hits",
    )
    wanted = hits.join(items, "item_id").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "item_id", "item", "shift"
    )
    # The words of a document are hashed once, whatever the number of its hits.
    near = keep_wanted(rows, F.xxhash64("text"), hits.select("digest")).select(
        "doc_id", F.xxhash64("text").alias("digest"), word_hashes(F.col("text")).alias("document")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    verified = near.join(wanted, same)
    best = verified.select(
        "doc_id",
        "item_id",
        best_stretch(F.col("document"), F.col("item"), F.col("shift"), penalty).alias("best"),
        F.size("item").alias("item_words"),
    )
    points, words = F.col("best.points"), F.col("item_words")
    enough = (points >= least_points) | (100 * points >= least_percent * words)
    return (
        best.filter(F.when(words < shortest, points == words).otherwise(enough))
        .groupBy("doc_id", "item_id")
        .agg(F.max("best").alias("best"), F.max("item_words").alias("item_words"))
        .select("doc_id", "item_id", "best.points", F.col("best.equal").alias("equal_words"), "item_words")
    )
