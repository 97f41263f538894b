"""N-gram Jaccard join: near duplicates by word shingles, with a token-group matrix.

1. Every text becomes its set of hashed shingles. Equal sets are one class.
2. In any order of all shingles, two sets of similarity t share at least l of their first
   n - ceil(t n) + l shingles. By order of hash, every class posts these for a small l. A shingle in
   few classes gives candidate pairs; how many shingles a pair shares there bounds its overlap, and
   most candidates end here. A class with fewer than l common shingles among the posted ones (a
   license line, a passage that a third of all documents hold) has met all its partners.
3. The other classes post once more, with an l that grows with the set. What is left then are classes
   made of common shingles for the most part: members of large families of near copies.
4. For these, the token-group matrix: classes are sorted so that similar ones are neighbours and cut
   into groups of a fixed size; the matrix says which groups hold a shingle among their first ones.
   Two groups that share one are compared: the overlap of a set with the union of all shingles of
   the other group bounds its overlap with every member, and only groups that qualify are opened.
5. Candidates are verified on whole sets. A component needs no more than a spanning forest of links.

Nothing is capped: "few" and "many" only choose the way on. A common shingle is cut down inside each
task before the shuffle, so it is never gathered in one place. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import bounded_slices, leave_to, map_texts, short_batches, tidied
from bazaarlens.llm.components import connected_components
from bazaarlens.operators.ranking import dense_index
from bazaarlens.workspace import materialize, release

WORDS = 5
#: A pair is linked from this similarity on, in percent.
PERCENT = 80
#: A shingle in more classes than this is common.
FEW = 32
#: Classes of a group of the token-group matrix.
GROUP = 128
#: How many shingles two linked sets share among those posted: at first, and in percent of a set later.
AT_FIRST, LATER_PERCENT = 8, 30
#: Bits for a set in the filter that keeps texts of no interest out of a shuffle, and bits in all: 16 MB at most.
_BITS_PER_SET, _FEWEST_BITS, _MOST_BITS = 16, 1 << 22, 1 << 27
#: Shingles that a task posts at once.
_POSTED_AT_ONCE = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word; words are separated by blanks and ASCII control space, A-Z counts as a-z."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    if not len(edge):
        return np.zeros(0, dtype=np.uint64)
    long = edge[1::2] - edge[::2]
    first = np.concatenate(([0], np.cumsum(long)[:-1]))
    place = np.arange(long.sum()) - np.repeat(first, long)
    powers = np.cumprod(np.full(long.max(), _BASE | _U(1), dtype=np.uint64))
    return _mixed(np.add.reduceat(_BYTE[raw[inside]] * powers[place], first) + long.astype(np.uint64) * _BASE)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted different shingles of a text as 64-bit hashes; fewer words are one shingle, none are none."""
    hashed = word_hashes(text)
    if not len(hashed):
        return np.zeros(0, dtype=np.int64)
    width = min(words, len(hashed))
    total = np.full(len(hashed) - width + 1, _U(width))
    for i in range(width):
        total = _mixed(total * _BASE + hashed[i : len(hashed) - width + 1 + i])
    return np.unique(total.view(np.int64))


def set_digest(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    return int(_mixed(shingles.view(np.uint64) ^ _BASE).sum(dtype=np.uint64).view(np.int64))


def least_part(n: int, percent: int) -> int:
    """How many of its shingles a set of ``n`` shares at least with a linked one."""
    return -(-percent * n // 100)


def first_posted(n: int, percent: int) -> int:
    """How many shingles a set of ``n`` posts at first."""
    least = least_part(n, percent)
    return n - least + min(AT_FIRST, least)


def later_posted(n: int, percent: int) -> int:
    """How many shingles a set of ``n`` posts later."""
    least = least_part(n, percent)
    return n - least + min(least_part(n, LATER_PERCENT), least)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _part(n: Column, percent: int) -> Column:
    """``least_part`` of a column."""
    return F.ceil(n * percent / 100.0 - 1e-9)


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of linked sets of sizes ``n`` and ``m``: percent / (100 + percent) of both."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


_POSTED = "token bigint, sid bigint, n int, common int"


Batches = Iterator[pa.RecordBatch]


def _post(few: int, most: int = _POSTED_AT_ONCE):
    """Rows of a task: each set posts its shingles.

    About ``most`` shingles are taken at once. Within them, equal sets post once, and a shingle of more
    than ``few`` sets is cut to one row without a set that calls it common; the sets then get a row each
    with the number of such shingles.
    """

    def run(batches: Batches) -> Batches:
        leave_to(None)
        held, count = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                held.append(opened(part))
                count += len(held[-1][0])
                if count >= most:
                    yield from posted(held)
                    held, count = [], 0
        if count:
            yield from posted(held)

    def opened(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Shingles, with the id and the size of their set."""
        shingles = part.column("shingles")
        each = shingles.value_lengths().to_numpy(zero_copy_only=False)
        sid, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), each) for c in ("sid", "n"))
        return shingles.flatten().to_numpy(zero_copy_only=False), sid, n

    def posted(held: list[tuple[np.ndarray, ...]]) -> Batches:
        token, sid, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((n, sid, token))
        token, sid, n = token[order], sid[order], n[order]
        del order
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (n[1:] != n[:-1])
        token, sid, n = token[new], sid[new], n[new]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        counts = np.diff(np.concatenate((starts, [len(token)])))
        many = np.repeat(counts > few, counts)
        yield from _rows(token[~many], sid[~many], n[~many], np.zeros((~many).sum(), dtype=np.int32))
        flagged = token[starts[counts > few]]
        yield from _rows(flagged, None, np.zeros(len(flagged), dtype=np.int32), np.full(len(flagged), 1, dtype=np.int32))
        pairs, hits = np.unique(np.column_stack((sid[many], n[many])), axis=0, return_counts=True)
        yield from _rows(None, pairs[:, 0], pairs[:, 1].astype(np.int32), hits.astype(np.int32))

    return run


def _rows(token, sid, n, common, step: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(n), step):
        part = slice(begin, begin + step)
        count = len(n[part])
        columns = [
            pa.nulls(count, pa.int64()) if x is None else pa.array(x[part], pa.int64()) for x in (token, sid)
        ] + [pa.array(x[part], pa.int32()) for x in (n, common)]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "sid", "n", "common"])


_FOUND = "a bigint, na int, b bigint, nb int, shared int"


def _gather(percent: int, few: int):
    """From posted rows sorted by shingle: candidate pairs with the shingles they share, and sets with common ones.

    A pair row has both sets; a row without ``b`` says how many common shingles set ``a`` posted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            # Rows without a shingle pass through.
            apart = batch.filter(batch.column("token").is_null())
            if apart.num_rows:
                none = pa.nulls(apart.num_rows, pa.int64()), pa.nulls(apart.num_rows, pa.int32())
                columns = [apart.column("sid"), apart.column("n"), *none, apart.column("common")]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "na", "b", "nb", "shared"])
            batch = batch.filter(batch.column("token").is_valid())
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "common", "n"))
            now += (batch.column("sid").fill_null(0).to_numpy(zero_copy_only=False),)
            if held is not None:
                now = tuple(np.concatenate((h, x)) for h, x in zip(held, now, strict=True))
            token = now[0]
            cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
            yield from finished(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
            if len(held[0]) > 4 * few:
                held = yield from reduced(*held)
        if held is not None:
            yield from finished(*held)

    def distinct(token, common, n, sid):
        order = np.lexsort((n, sid, -common, token))
        token, common, n, sid = token[order], common[order], n[order], sid[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (n[1:] != n[:-1]) | (common[1:] != common[:-1])
        return token[new], common[new], n[new], sid[new]

    def reduced(token, common, n, sid):
        """A long run of one shingle is common: its sets are told, and a mark stands for it."""
        token, common, n, sid = distinct(token, common, n, sid)
        sets = common == 0
        if common.max() == 0 and sets.sum() <= few:
            return token, common, n, sid
        yield from told(sid[sets], n[sets])
        return token[:1], np.ones(1, common.dtype), np.zeros(1, n.dtype), np.zeros(1, sid.dtype)

    def told(sid, n):
        if len(sid):
            pairs, hits = np.unique(np.column_stack((sid, n.astype(np.int64))), axis=0, return_counts=True)
            yield _found(pairs[:, 0], pairs[:, 1], None, None, hits)

    def finished(token, common, n, sid):
        if not len(token):
            return
        token, common, n, sid = distinct(token, common, n, sid)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        counts = np.diff(np.concatenate((starts, [len(token)])))
        marked = np.maximum.reduceat(common, starts) > 0
        is_common = marked | (counts > few)
        member = np.repeat(is_common, counts) & (common == 0)
        yield from told(sid[member], n[member])
        rows = []
        for size in np.unique(counts[~is_common]):
            if size < 2:
                continue
            at = starts[~is_common & (counts == size)][:, None]
            i, j = np.triu_indices(size, 1)
            a, b = (at + i).ravel(), (at + j).ravel()
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            kept = 100 * low.astype(np.int64) >= percent * high.astype(np.int64)
            rows.append(np.column_stack((sid[a], n[a], sid[b], n[b]))[kept])
        if rows and sum(map(len, rows)):
            pairs, hits = np.unique(np.concatenate(rows), axis=0, return_counts=True)
            for begin in range(0, len(pairs), 1 << 17):
                p = pairs[begin : begin + (1 << 17)]
                yield _found(p[:, 0], p[:, 1], p[:, 2], p[:, 3], hits[begin : begin + (1 << 17)])

    return run


def _found(a, na, b, nb, shared) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    columns = [
        pa.nulls(len(a), k) if x is None else pa.array(x.astype(np.int64), pa.int64()).cast(k)
        for x, k in zip((a, na, b, nb, shared), kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, names=["a", "na", "b", "nb", "shared"])


def _candidates(sets: DataFrame, percent: int, few: int, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``sid, n, shingles``: pairs ``a, na, b, nb, shared``, and ``sid, n, common`` of sets with common shingles.

    Last comes the stored table of both.
    """
    posted = sets.mapInArrow(tidied(_post(few)), _POSTED)
    by_token = posted.repartition(F.coalesce("token", "sid")).sortWithinPartitions("token")
    gathered = by_token.mapInArrow(tidied(_gather(percent, few)), _FOUND)
    found = materialize(gathered.groupBy("a", "na", "b", "nb").agg(F.sum("shared").alias("shared")), label)
    common = found.filter("b IS NULL").select(F.col("a").alias("sid"), F.col("na").alias("n"), F.col("shared").alias("common"))
    return found.filter("b IS NOT NULL"), common, found


def _bounded(pairs: DataFrame, common: DataFrame, percent: int, unposted) -> DataFrame:
    """The pairs whose overlap may be large enough, with ``ca`` and ``cb``, the common shingles each has posted.

    They share ``shared`` rare posted shingles, as many common ones as the smaller number, and
    ``unposted(n)`` others at most.
    """
    sides = [common.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("common").alias(f"c{s}")) for s in "ab"]
    known = pairs.join(sides[0], ["a", "na"], "left").join(sides[1], ["b", "nb"], "left").fillna(0, ["ca", "cb"])
    most = F.col("shared") + F.least("ca", "cb") + F.greatest(unposted(F.col("na")), unposted(F.col("nb")))
    return known.filter(most >= _least_overlap(F.col("na"), F.col("nb"), percent))


def _bits(sets: int) -> int:
    """Bits of a filter that few of ``sets`` sets pass by chance, as long as that takes less than the most bits."""
    return min(_MOST_BITS, max(_FEWEST_BITS, 1 << (sets * _BITS_PER_SET - 1).bit_length()))


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``key``, numbers spread like hashes."""
    place = (F.pmod(F.col("key"), F.lit(bits)) + 1).alias("place")
    parts = keys.select(place).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    found = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.collect():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        found[(row["part"] - 1) * len(part) : row["part"] * len(part)] = part
    return found


_SETS = "doc_id bigint, sid bigint, n int, shingles array<bigint>"
_WHOLE = f"{_SETS}, core boolean"


def _wanted_sets(wanted: DataFrame, bits: int, words: int, posted, core: DataFrame | None = None):
    """From ``doc_id, text``: ``doc_id, sid, n, shingles`` of the texts whose set is wanted, and of few others.

    Of each set come its ``posted(n)`` first shingles. With ``core``, both tables have ``doc_id``, too, which
    must be the wanted one, and ``core`` tells the sets of that table and few others.
    """
    by_id = core is not None
    key = F.col("sid").bitwiseXOR(F.col("doc_id")) if by_id else F.col("sid")
    share = wanted.sparkSession.sparkContext.broadcast
    maps = [share(_bitmap(x.select(key.alias("key")), bits)) for x in ((wanted, core) if by_id else (wanted,))]

    def run(batches: Batches) -> Batches:
        leave_to(None)
        held = [x.value for x in maps]
        for batch in batches:
            for part in bounded_slices(batch, "text", 512):
                ids, found = [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    shingles = shingle_set(text or "", words)
                    if doc_id is None or not len(shingles):
                        continue
                    sid = set_digest(shingles)
                    place = (sid ^ doc_id if by_id else sid) % bits
                    known = [bool(x[place >> 3] >> (place & 7) & 1) for x in held]
                    if known[0]:
                        ids.append((doc_id, sid, len(shingles), *known[1:]))
                        found.append(shingles[: posted(len(shingles))])
                names = ["doc_id", "sid", "n", *["core"][: len(maps) - 1]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                columns = [pa.array([x[k] for x in ids], kinds[k]) for k in range(len(names))]
                columns.insert(3, pa.array(found, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names[:3], "shingles", *names[3:]])

    return run


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``rep_a, rep_b`` of the pairs whose whole sets are similar enough."""
    sides = [
        whole.select(
            F.col("doc_id").alias(f"rep_{s}"), F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("shingles").alias(f"set_{s}")
        )
        for s in "ab"
    ]
    joined = pairs.join(sides[0], ["rep_a", "a", "na"]).join(sides[1], ["rep_b", "b", "nb"])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [
                [x.values.to_numpy(zero_copy_only=False) for x in batch.column(f"set_{s}")] for s in "ab"
            ]
            kept = pa.array([similar(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            names = ["rep_a", "rep_b"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in names], names=names)

    return joined.select("rep_a", "rep_b", "set_a", "set_b").mapInArrow(tidied(run), "rep_a bigint, rep_b bigint")


def open_groups(
    left: list[np.ndarray], right: list[np.ndarray], percent: int, same: bool
) -> list[tuple[int, int]]:
    """Links between the sets of two groups: positions in both. ``same`` says that they are one group.

    A set is compared with the members only if its overlap with their union allows a link.
    """
    union = np.unique(np.concatenate(right))
    fewest = min(map(len, right))
    opened = []
    for i, own in enumerate(left):
        bound = np.isin(own, union, assume_unique=True).sum()
        if bound * (100 + percent) >= percent * (len(own) + fewest) - 1e-9:
            opened.append(i)
    if not opened:
        return []
    present = np.zeros((len(right), len(union)), dtype=np.float32)
    for j, other in enumerate(right):
        present[j, np.searchsorted(union, other)] = 1.0
    asked = np.zeros((len(opened), len(union)), dtype=np.float32)
    for k, i in enumerate(opened):
        at = np.searchsorted(union, left[i])
        at[at == len(union)] = 0
        asked[k, at[union[at] == left[i]]] = 1.0
    overlap = np.rint(asked @ present.T).astype(np.int64)
    sizes = np.array([len(left[i]) for i in opened])[:, None] + np.array([len(x) for x in right])[None, :]
    rows, columns = np.nonzero((overlap > 0) & (100 * overlap >= percent * (sizes - overlap)))
    return [(opened[r], int(c)) for r, c in zip(rows, columns, strict=True) if not same or opened[r] < c]


def spanning(links: list[tuple[int, int]], same: bool) -> list[tuple[int, int]]:
    """Links that connect as much as all of them, fewer than there are sets; see ``open_groups``."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in links:
        a, b = root((0, i)), root((0 if same else 1, j))
        if a != b:
            parent[a] = b
            kept.append((i, j))
    return kept


def _matrix_links(core: DataFrame, percent: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Links among sets ``sid, n, shingles`` by the token-group matrix, and the table they are read from."""
    order = ["first", "second", "sid", "n"]
    keyed = core.select(
        "sid", "n", F.get("shingles", F.lit(0)).alias("first"),
        F.coalesce(F.get("shingles", F.lit(1)), F.lit(0)).alias("second"),
    )
    placed = dense_index(keyed, [F.col(c) for c in order], "place")
    numbered = materialize(
        core.join(placed.select("sid", "n", F.floor((F.col("place") - 1) / group).alias("group")), ["sid", "n"]), "core"
    )
    posted = F.col("n") - _part(F.col("n"), percent) + 1
    matrix = numbered.select(
        "group", F.explode(F.slice("shingles", F.lit(1), posted.cast("int"))).alias("token")
    ).distinct()
    other = matrix.select(F.col("group").alias("other"), "token")
    spans = numbered.groupBy("group").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    far = spans.select(F.col("group").alias("other"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    wanted = (
        matrix.join(other, "token").filter("group < other").select("group", "other").distinct()
        .join(spans, "group").join(far, "other")
        .filter((F.col("high") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low") * percent))
        .select("group", "other")
    )
    # At most ``group`` sets in a row. Each side of a pair travels once; a group needs no copy to meet itself.
    rows = numbered.groupBy("group").agg(F.collect_list(F.struct("sid", "n", "shingles")).alias("sets"))
    theirs = rows.select(F.col("group").alias("other"), F.col("sets").alias("others"))
    both = wanted.join(rows, "group").join(wanted.join(theirs, "other"), ["group", "other"])
    alone = rows.withColumn("others", F.lit(None).cast(rows.schema["sets"].dataType))

    def opened_row(sets: pa.ListScalar) -> tuple[list[int], list[int], list[np.ndarray]]:
        """Ids, sizes and shingles of the sets of a group."""
        one = sets.values
        shingles = [x.values.to_numpy(zero_copy_only=False) for x in one.field("shingles")]
        return one.field("sid").to_pylist(), one.field("n").to_pylist(), shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for mine, theirs in zip(batch.column("sets"), batch.column("others"), strict=True):
                sid, n, left = opened_row(mine)
                same = not theirs.is_valid
                sid_b, n_b, right = (sid, n, left) if same else opened_row(theirs)
                pairs = spanning(open_groups(left, right, percent, same), same)
                links.extend((sid[i], n[i], sid_b[j], n_b[j]) for i, j in pairs)
            table = np.array(links, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table[:, k], pa.int64()).cast(t) for k, t in enumerate((pa.int64(), pa.int32()) * 2)],
                names=["a", "na", "b", "nb"],
            )

    links = "a bigint, na int, b bigint, nb int"
    return both.mapInArrow(tidied(run), links).unionByName(alone.mapInArrow(tidied(run), links)), numbered


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    words: int = WORDS,
    percent: int = PERCENT,
    few: int = FEW,
    group: int = GROUP,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Texts of equal shingle sets, and sets whose Jaccard similarity is ``percent`` or more, are linked;
    ``component_id`` is the smallest id that links reach. A text without words (null, empty, blank)
    is linked with nothing, and so is a row with a null id, whose component is null. Rows that share
    an id are one document for links. Ids must be whole numbers; an empty table has no rows.
    """
    rows = short_batches(df).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(texts: list[str]) -> dict[str, list]:
        sets = [shingle_set(t, words) for t in texts]
        return {
            "n": [len(s) for s in sets],
            "sid": [set_digest(s) for s in sets],
            "shingles": [s[: first_posted(len(s), percent)] for s in sets],
        }

    described = map_texts(rows, ["doc_id"], describe, {"n": "int", "sid": "bigint", "shingles": "array<bigint>"})
    posted = materialize(described, "sets")
    sets = materialize(posted.select("doc_id", "n", "sid"), "ids")
    full = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("sid", "n").agg(F.min("doc_id").alias("rep")), "classes")
    bits = _bits(classes.count())

    def part(n: Column) -> Column:
        return _part(n, percent)

    def later(n: Column) -> Column:
        return F.least(_part(n, LATER_PERCENT), part(n))

    def crowded(common: Column, n: Column) -> Column:
        return common >= F.least(F.lit(AT_FIRST), part(n))

    first = posted.filter("n > 0 AND doc_id IS NOT NULL").select("sid", "n", "shingles")
    pairs, common, met = _candidates(first, percent, few, "candidates")
    release(posted)
    # What is not posted: the least part but for its first shingles.
    bounded = _bounded(pairs, common, percent, lambda n: part(n) - F.least(F.lit(AT_FIRST), part(n)))
    # Two crowded sets meet again.
    light = materialize(
        bounded.filter(~(crowded(F.col("ca"), F.col("na")) & crowded(F.col("cb"), F.col("nb")))).select("a", "na", "b", "nb"),
        "light",
    )
    crowd = common.filter(crowded(F.col("common"), F.col("n")))
    crowd_sets = _wanted_sets(crowd, bits, words, lambda n: later_posted(n, percent))
    release(met)
    more, common, met = _candidates(rows.mapInArrow(tidied(crowd_sets), _SETS).select("sid", "n", "shingles"), percent, few, "crowd")
    names = [classes.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("rep").alias(f"rep_{s}")) for s in "ab"]

    def named(pairs: DataFrame) -> DataFrame:
        """With the documents that stand for both classes."""
        return pairs.join(names[0], ["a", "na"]).join(names[1], ["b", "nb"])

    bounded = _bounded(more, common, percent, lambda n: part(n) - later(n)).select("a", "na", "b", "nb")
    rare = materialize(named(bounded.unionByName(light)), "rare")
    release(light)
    # A partner has at least the least part of the shingles, and posts accordingly.
    core = common.filter(F.col("common") >= later(part(F.col("n")))).select("sid", "n")
    core = materialize(core.join(classes.withColumnRenamed("rep", "doc_id"), ["sid", "n"]), "core")
    release(met)

    wanted = core.select("sid", "doc_id")
    for s in "ab":
        wanted = wanted.unionByName(rare.select(F.col(s).alias("sid"), F.col(f"rep_{s}").alias("doc_id")))
    # Whole sets stay where their texts lie. The steps below look for them by class and document, so those that
    # passed a filter by chance fall out there.
    exact = rows.mapInArrow(tidied(_wanted_sets(wanted, bits, words, lambda n: n, core)), _WHOLE)
    ids = sets.agg(F.count("doc_id").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["rows"] > ids["ids"]:
        exact = exact.dropDuplicates(["doc_id", "sid", "n"])
    whole = materialize(exact, "whole")
    crowded_sets = whole.filter("core").join(core, ["sid", "n", "doc_id"], "left_semi").select("sid", "n", "shingles")
    matrix_links, numbered = _matrix_links(crowded_sets, percent, group)
    links = _verified(rare, whole, percent).unionByName(named(matrix_links).select("rep_a", "rep_b"))
    edges = links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # A document with several texts links the classes of all of them.
    if ids["rows"] > ids["ids"]:
        edges = edges.unionByName(
            full.join(classes, ["sid", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
        )
    found = connected_components(edges)
    release(core, rare, whole, numbered)
    return (
        sets.join(classes, ["sid", "n"], "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select(
            "doc_id",
            F.col("n").cast("bigint").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )
