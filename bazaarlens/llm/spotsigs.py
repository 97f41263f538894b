"""Document fingerprints: SpotSigs.

A common word is an anchor. From every anchor (a run of adjacent anchors is one) a chain of the next
two content words is taken; anchor and chain form a signature, and the set of signatures is the
fingerprint. It follows the prose of a text and not its decoration. All of it is column expressions.

Fingerprints are compared by Jaccard similarity. Two sets can only be similar if their sizes are, so
sets are put into partitions by size: partition bounds grow by the threshold, and partners lie in the
same or the next one. Within a partition, only sets that share one of the first signatures of their
sorted order are compared; a similar pair must, by the size of its overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.words import words_of
from bazaarlens.operators.ranking import dense_index
from bazaarlens.workspace import materialize

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au das de dem den der des die ein eine für im ist mit nicht sich und von zu "
    "avec dans du elle en est et la le les pas pour que qui sur un une "
    "con del el los no para por se su una y"
).split()
#: Content words of a chain.
CHAIN = 2
_MARK = "\x01"
#: Hex digits of a signature: 40 bits.
_DIGITS = 10


def with_signatures(df: DataFrame, text_col: str, name: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """Add ``name``, the sorted set of signatures of a text, as hex strings.

    A text without any chain has one signature of all its words; one without words, or null, has
    none. Steps are columns of their own, so that each is computed once.
    """
    tagged, spots, content, chains = (f"__{name}_{c}" for c in ("tagged", "spots", "content", "chains"))
    # Anchors stick to the content word that follows them: "the of sea blue" is "the\1of\1sea blue".
    mark = F.transform(words_of(F.col(text_col)), lambda w: F.concat(w, F.when(w.isin(anchors), _MARK).otherwise(" ")))
    found = F.col(spots)
    for i in range(CHAIN - 1):
        later = F.slice(content, F.lit(2 + i), F.size(content))
        found = F.zip_with(found, later, lambda a, b: F.concat(a, F.lit(" "), b))
    whole = F.when(F.col(tagged) == "", F.array().cast("array<string>")).otherwise(F.array(tagged))
    chosen = F.when(F.size(chains) > 0, F.col(chains)).otherwise(whole)
    return (
        df.withColumn(tagged, F.array_join(mark, ""))
        # Anchors at the end, behind the last blank, have no content word.
        .withColumn(spots, F.split(F.left(tagged, _before_last_blank(F.col(tagged))), " "))
        .withColumn(content, F.transform(spots, lambda s: F.substring_index(s, _MARK, -1)))
        .withColumn(chains, F.filter(found, lambda c: c.isNotNull() & c.contains(_MARK)))
        .withColumn(name, F.array_sort(F.array_distinct(F.transform(chosen, lambda c: F.substring(F.md5(c), 1, _DIGITS)))))
        .drop(tagged, spots, content, chains)
    )


def _before_last_blank(text: Column) -> Column:
    """How many code points come before the last blank; none without one."""
    return F.greatest(F.length(text) - F.length(F.substring_index(text, " ", -1)) - 1, F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike, one empty set is like nothing."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def as_text(found: Column) -> Column:
    """A fingerprint as one string."""
    return F.array_join(found, "")


def similar_pairs(df: DataFrame, id_col: str, found_col: str, threshold: float = 0.8) -> DataFrame:
    """``a, b, similarity``: pairs of different fingerprints that are at least ``threshold`` alike, by smallest ids.

    Equal fingerprints are one class with its smallest id, so many copies cost one row. Empty
    fingerprints are alike only among themselves. Null ids are left out.
    """
    kept = df.filter(F.col(id_col).isNotNull() & (F.size(found_col) > 0))
    classes = materialize(
        kept.groupBy(F.col(found_col).alias("found")).agg(F.min(id_col).alias("id")).withColumn("n", F.size("found")),
        "signatures",
    )
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    # Without one of its first n - ceil(t * n) + 1 signatures, a set has too few left for the overlap.
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    places = classes.select(
        "id", "n", part.alias("part"), F.explode(F.slice("found", F.lit(1), first.cast("int"))).alias("signature")
    )
    later = places.select(
        F.col("id").alias("id_b"), F.col("n").alias("n_b"), "signature", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part")
    )
    fits = (F.col("n") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n") * threshold)
    ahead = (F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("id") < F.col("id_b")))
    pairs = places.join(later, ["part", "signature"]).filter(fits & ahead & (F.col("id") != F.col("id_b")))
    one = classes.select(F.col("id"), F.col("found").alias("found_a"))
    other = classes.select(F.col("id").alias("id_b"), F.col("found").alias("found_b"))
    return (
        pairs.select("id", "id_b").distinct().join(one, "id").join(other, "id_b")
        .withColumn("similarity", likeness(F.col("found_a"), F.col("found_b")))
        .filter(F.col("similarity") >= threshold)
        .select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), "similarity")
    )


def edited_by_next(df: DataFrame, id_col: str, text_col: str, parts: int = 3) -> DataFrame:
    """``doc_id, text, found, edited, next_found`` of every row.

    The next document is the one that follows in descending order of the id; after the last comes
    the first. ``edited`` is the text whose last ``floor(length / parts)`` code points are replaced
    by as many of the next text, or all it has. ``found`` and ``next_found`` are the signatures of
    the text and of the next text.

    A null text is empty, null ids come last. Rows of one id follow by a digest of their text, and
    rows that are equal in both share their place and their next. A single document is its own next.

    Only ids, digests and lengths are sorted. Both sides of the last join read the same shuffle of the
    texts; the part of a text that its neighbour needs goes there along with its signatures in one string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A struct with a missing id equals another one.
    rows = df.select(F.struct(F.col(id_col).alias("id")).alias("who"), F.xxhash64(text).alias("digest"), text.alias("text"))
    lengths = materialize(rows.select("who", "digest", F.length("text").alias("n")), "order")
    distinct = lengths.distinct()
    placed = dense_index(distinct, [F.desc_nulls_last("who.id"), F.asc("digest")], "place")
    rows_in_all, last = lengths.count(), placed.count()
    previous = placed.select(
        F.when(F.col("place") == last, 1).otherwise(F.col("place") + 1).alias("place"),
        F.col("who").alias("to_who"),
        F.col("digest").alias("to_digest"),
        F.floor(F.col("n") / parts).cast("int").alias("wanted"),
    )
    chain = materialize(placed.drop("n").join(previous, "place").drop("place"), "chain")

    spread = rows.repartition("who", "digest")
    heads = with_signatures(spread.join(chain, ["who", "digest"]), "text", "found").select(
        F.col("to_who").alias("who"),
        F.col("to_digest").alias("digest"),
        F.left(F.col("text"), F.col("wanted")).alias("head"),
        as_text(F.col("found")).alias("next_found"),
    )
    if rows_in_all > last:
        heads = heads.dropDuplicates(["who", "digest"])
    kept = F.length("text") - F.floor(F.length("text") / parts).cast("int")
    return with_signatures(spread.join(heads, ["who", "digest"]), "text", "found").select(
        F.col("who.id").alias("doc_id"), "text", "found", F.concat(F.left(F.col("text"), kept), F.col("head")).alias("edited"),
        F.regexp_extract_all("next_found", F.lit(f".{{{_DIGITS}}}"), F.lit(0)).alias("next_found"),
    )
