"""Repeated passages across documents by relative Lempel-Ziv parsing.

A passage counts as repeated in a document when ``window`` words in a row also start in a document
with a smaller id. Documents are parsed relative to blocks of earlier documents:

1. Every window of words names an anchor: of the short word groups in it, the one of the smallest
   hash. Equal windows name equal anchors, whatever surrounds them, and neighbours mostly name the
   same one, so there are few. An anchor that occurs in two documents has as its reference the place
   in the document of the smallest id.
2. Documents are cut into blocks. A block meets just the blocks that hold references of its anchors,
   and is parsed relative to each: a factor is the longest stretch around a shared anchor that both
   have word for word; the next factor starts where it ends. A factor of a whole window or more is a
   duplicate span.
3. A window that lies across a factor boundary is not in that reference, yet it may be in another
   document. If a window is not at the reference of its anchor, then none of its copies finds it there,
   so all of them are checked against each other: by digest, the smallest id has it first.

A text that another document has word for word takes no part; it is covered by the smallest id that
has it. No step gathers what a key or a document has without bound: blocks have a fixed number of
words, windows and anchors are aggregated inside tasks first. Only texts that a sieve of fixed size
lets pass are shuffled. Nothing is capped. Hashes only choose
candidates; words are compared as words, and boundary windows and whole texts by MD5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import bounded_slices
from bazaarlens.llm.sieve import Sieve
from bazaarlens.workspace import materialize, release

WINDOW = 50
#: Words of an anchor, or a third of a short window.
GRAM = 16
#: Words of a block, without its margins.
BLOCK = 256

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Bytes hashed at once; a longer word is hashed with its own powers.
_PIECE = 1 << 18


def _spread(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _spread(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWERS = np.cumprod(np.full(_PIECE, _STEP, dtype=np.uint64))
_INVERSE = np.cumprod(np.full(_PIECE, _BACK, dtype=np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of every word of UTF-8 bytes; words are runs without blanks and ASCII control space."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.concatenate((edges, [len(codes)]))
    begins, ends = edges[::2], edges[1::2]
    found = []
    at = 0
    while at < len(begins):
        # Whole words that begin within one piece.
        base = begins[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        length = int(ends[to - 1] - base)
        powers, inverse = _POWERS, _INVERSE
        if length > _PIECE:
            powers, inverse = (np.cumprod(np.full(length, x, dtype=np.uint64)) for x in (_STEP, _BACK))
        sums = np.concatenate(([_U(0)], np.cumsum(_BYTE[codes[base : base + length]] * powers[:length])))
        own, past = begins[at:to] - base, ends[at:to] - base
        found.append(_spread((sums[past] - sums[own]) * inverse[own] + (past - own).astype(np.uint64) * _STEP))
        at = to
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def anchors_of(hashed: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash and place of every anchor, the first window that names it, and how many do; windows of an anchor lie in a row."""
    if len(hashed) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    groups = np.full(len(hashed) - gram + 1, _U(gram))
    for i in range(gram):
        groups = _spread(groups * _STEP + hashed[i : len(hashed) - gram + 1 + i])
    # The first smallest of every stretch, by doubling.
    reach, span = window - gram + 1, 1
    best = np.arange(len(groups))
    while 2 * span <= reach:
        best = np.where(groups[best[span:]] < groups[best[:-span]], best[span:], best[:-span])
        span *= 2
    if span < reach:
        shift = reach - span
        best = np.where(groups[best[shift:]] < groups[best[:-shift]], best[shift:], best[:-shift])
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    place = best[first]
    return groups[place].view(np.int64), place, first, np.diff(np.concatenate((first, [len(best)])))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_words(text: str) -> list[str]:
    """The words of a text as they stand."""
    return _WORD.findall(text)


_ANCHOR = "struct<hash:bigint,place:int,first:int,windows:int>"
_ARROW_ANCHOR = pa.struct([("hash", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("windows", pa.int32())])


def _facts(window: int, gram: int):
    """Number of words and anchors of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                counts, columns, offsets = [], [[], [], [], []], [0]
                for text in part.column("text"):
                    hashed = word_hashes(text.as_buffer())
                    counts.append(len(hashed))
                    found = anchors_of(hashed, window, gram)
                    for column, values in zip(columns, found, strict=True):
                        column.append(values)
                    offsets.append(offsets[-1] + len(found[0]))
                parts = [
                    pa.array(np.concatenate(c), field.type)
                    for c, field in zip(columns, _ARROW_ANCHOR, strict=True)
                ]
                anchors = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_ARROW_ANCHOR))
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(counts, pa.int64()), anchors],
                    names=["doc_id", "digest", "n_words", "anchors"],
                )

    return run


def _slices(window: int, gram: int, block: int):
    """The wanted blocks of a text, each with the words around it that windows of its anchors may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                rows, blocks, starts, slices = [], [], [], []
                for row, text, wanted in zip(
                    part.column("row").to_pylist(), part.column("text").to_pylist(),
                    part.column("blocks").to_pylist(), strict=True,
                ):
                    words = split_words(text)
                    for b in wanted:
                        start = max(0, b * block - (window - gram))
                        rows.append(row)
                        blocks.append(b)
                        starts.append(start)
                        slices.append(" ".join(words[start : (b + 1) * block + window]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(blocks, pa.int32()), pa.array(starts, pa.int32()),
                     pa.array(slices, pa.string())],
                    names=["row", "block", "start", "words"],
                )

    return run


def parse_block(
    own: list[str], reference: list[str], hits: list[tuple[int, int, int, int]], window: int
) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans and boundary windows of a block relative to a reference block.

    ``hits`` are shared anchors as (place, place in the reference, first window, windows), in words of
    the block. Returned are the factors of at least a window as (begin, end), and the first words of
    the windows that lie in no factor around their anchor.
    """
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in own])
    b = np.array([codes.setdefault(w, -1) for w in reference])
    spans: list[tuple[int, int]] = []
    open_windows: list[int] = []
    factor: tuple[int, int, int] | None = None
    for place, at, first, count in sorted(hits):
        if factor is None or factor[2] != place - at or not factor[0] <= place < factor[1]:
            back, ahead = min(place, at), min(len(a) - place, len(b) - at)
            before = np.flatnonzero(a[place - back : place] != b[at - back : at])
            after = np.flatnonzero(a[place : place + ahead] != b[at : at + ahead])
            begin = place - back + (int(before[-1]) + 1 if len(before) else 0)
            end = place + (int(after[0]) if len(after) else ahead)
            factor = (begin, end, place - at)
            if end - begin >= window:
                spans.append((begin, end))
        begin, end, _ = factor
        open_windows += [s for s in range(first, first + count) if s < begin or s + window > end]
    return spans, open_windows


def _parse(window: int):
    """Spans of every pair of blocks, and its different boundary windows with the places of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "words"):
                spans, left = [], []
                for r in part.to_pylist():
                    own, start, to = r["words"].split(" "), r["start"], r["to_start"]
                    hits = [(h["place"] - start, h["to_place"] - to, h["first"] - start, h["windows"]) for h in r["hits"]]
                    found, unsure = parse_block(own, r["to_words"].split(" "), hits, window)
                    spans.append([{"begin": start + x, "end": start + y} for x, y in found] if r["earlier"] else [])
                    places: dict[bytes, list[int]] = {}
                    for s in unsure:
                        words = " ".join(own[s : s + window]).encode("utf-8", "surrogatepass")
                        places.setdefault(hashlib.md5(words).digest(), []).append(start + s)
                    left.append([{"digest": d, "places": p} for d, p in places.items()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(spans, _SPANS), pa.array(left, _LEFT)],
                    names=["row", "doc_id", "spans", "left"],
                )

    return run


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_LEFT = pa.list_(pa.struct([("digest", pa.binary()), ("places", pa.list_(pa.int32()))]))


def _with_digest(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, text``; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def repeated_spans(
    df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """``doc_id, digest, spans`` of every different row that repeats earlier documents.

    ``digest`` is the MD5 of the text; ``spans`` are (begin, end) in words, end exclusive, in
    order and apart: every word of a window whose words also start, in a row, in a document of a smaller id.

    Rows without id are neither before nor after another and have no spans; null, empty and short
    texts have none. Rows of one id do not repeat each other. Other columns are left out.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    gram = min(gram, max(1, window // 3))
    rows = _with_digest(df, id_col, text_col).filter(F.col("doc_id").isNotNull())
    schema = f"doc_id {id_type}, digest binary, n_words bigint, anchors array<{_ANCHOR}>"
    facts = rows.mapInArrow(_facts(window, gram), schema).filter(F.col("n_words") >= window)
    facts = materialize(facts.withColumn("row", F.monotonically_increasing_id()), "facts")

    # Texts that are equal are one; only the smallest id that has it takes part, by one of its rows.
    per_id = materialize(
        facts.groupBy("digest", "doc_id").agg(
            F.min("row").alias("row"), F.count("*").alias("copies"), F.min("n_words").alias("n_words")
        ),
        "ids",
    )
    classes = materialize(
        per_id.groupBy("digest").agg(
            F.min("doc_id").alias("first_id"),
            F.min_by("row", "doc_id").alias("row"),
            F.min_by("copies", "doc_id").alias("copies"),
            F.min("n_words").alias("n_words"),
        ),
        "classes",
    )
    places = materialize(
        facts.join(classes.select("row"), "row", "left_semi").select("row", "doc_id", F.inline("anchors")), "places"
    )
    release(facts)
    references = (
        places.groupBy("hash")
        .agg(
            F.min("doc_id").alias("to_id"), F.max("doc_id").alias("last_id"),
            F.min_by("row", "doc_id").alias("to_row"), F.min_by("place", "doc_id").alias("to_place"),
        )
        .filter("to_id < last_id").drop("last_id")
    )
    in_block = lambda c: F.floor(F.col(c) / block).cast("int")
    visits = materialize(
        places.join(references, "hash")
        .filter("row <> to_row OR place <> to_place")
        .groupBy(
            "row", "doc_id", in_block("place").alias("block"), "to_row", in_block("to_place").alias("to_block"),
            (F.col("doc_id") > F.col("to_id")).alias("earlier"),
        )
        .agg(F.collect_list(F.struct("place", "to_place", "first", "windows")).alias("hits")),
        "visits",
    )

    release(places)
    met = visits.select("row", "block").union(visits.select("to_row", "to_block"))
    wanted = met.distinct().groupBy("row").agg(F.collect_list("block").alias("blocks"))
    wanted = materialize(
        classes.select("row", "digest", F.col("first_id").alias("doc_id")).join(wanted, "row"), "wanted"
    )
    texts = rows.filter(Sieve(wanted, "digest").passes("digest")).join(wanted, ["doc_id", "digest"]).select("row", "text", "blocks")
    if classes.filter("copies > 1").limit(1).count():
        texts = texts.dropDuplicates(["row"])
    blocks = materialize(
        texts.mapInArrow(_slices(window, gram, block), "row bigint, block int, start int, words string"), "blocks"
    )
    pairs = visits.join(blocks, ["row", "block"]).join(blocks.toDF("to_row", "to_block", "to_start", "to_words"), ["to_row", "to_block"])
    parsed = materialize(
        pairs.select("row", "doc_id", "start", "words", "to_start", "to_words", "hits", "earlier").mapInArrow(
            _parse(window),
            f"row bigint, doc_id {id_type}, spans array<struct<begin:int,end:int>>, "
            "left array<struct<digest:binary,places:array<int>>>",
        ),
        "parsed",
    )

    release(visits, blocks, wanted)
    left = parsed.select("row", "doc_id", F.inline("left"))
    first_of = (
        left.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .filter("first_id < last_id").drop("last_id")
    )
    at_boundaries = (
        left.join(first_of, "digest").filter("doc_id > first_id")
        .select("row", F.explode("places").alias("begin"))
        .withColumn("end", F.col("begin") + window)
    )
    spans = parsed.select("row", F.inline("spans")).unionByName(at_boundaries).distinct()
    own = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    own = classes.join(own.mapInArrow(_merge, "row bigint, spans array<struct<begin:int,end:int>>"), "row").select(F.col("first_id").alias("doc_id"), "digest", "spans")
    copies = per_id.select("doc_id", "digest").join(classes.select("digest", "first_id", "n_words"), "digest").filter(
        F.col("doc_id") > F.col("first_id")
    )
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
    return own.unionByName(copies.select("doc_id", "digest", whole.alias("spans")))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a row that meet or overlap as one."""
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            own: list[dict] = []
            for span in sorted(spans, key=lambda s: s["begin"]):
                if own and span["begin"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], span["end"])
                else:
                    own.append(span)
            merged.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(merged, _SPANS)], names=["row", "spans"])


def _kept_words(words: list[str], spans: list[dict] | None) -> list[str]:
    """Words outside all spans, which are apart and in order."""
    kept, at = [], 0
    for span in spans or []:
        kept += words[at : span["begin"]]
        at = span["end"]
    return kept + words[at:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bounded_slices(batch, "text"):
            words = [split_words(t) for t in part.column("text").to_pylist()]
            kept = [_kept_words(w, s) for w, s in zip(words, part.column("spans").to_pylist(), strict=True)]
            counts = [len(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array([n - len(k) for n, k in zip(counts, kept, strict=True)], pa.int64()),
                    pa.array([" ".join(k) for k in kept], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def drop_repeats(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: its words outside all repeated spans, joined by one blank.

    See ``repeated_spans`` for null ids, null texts and repeated rows; each of those rows is returned.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = _with_digest(df, id_col, text_col)
    spans = materialize(repeated_spans(df, id_col, text_col, window), "spans")
    rows = rows.withColumn("may_be", Sieve(spans, "digest").passes("digest"))
    hit = rows.filter("may_be").join(spans, ["doc_id", "digest"], "left").select("doc_id", "text", "spans")
    other = rows.filter("NOT may_be").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return hit.unionByName(other).mapInArrow(_cut, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string")
