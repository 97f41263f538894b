"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 32 bytes cuts every text where the content says so, so passages that documents
share become equal chunks wherever they stand. A worker encodes a chunk once and keeps the result for its later texts and tasks. A
cut may fall inside a word: the word pieces at the two edges of a chunk are not part of its stored
result. At every join they are put together, over as many chunks as it takes until both sides reach
white space, and that word is encoded anew. The pre-tokenizer drops white space and never looks
across it, so from there on the two sides agree exactly with an encoding of the whole text.

All new chunks of a list of texts are cut into words at once, as Arrow columns, and each distinct word is
looked up or encoded once. Ids stay numbers of two or four bytes until a text is complete.

Chunks and words are kept per worker, in tables bounded by their bytes; those used last stay. They go when another
step takes over the worker. To share them between workers would move
every chunk through a shuffle, which costs more than it saves.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bazaarlens.llm.common import kept_in_worker, map_texts

_WINDOW = 32
_BLANKS = b" \t\n\r\x0b\x0c"
# Entry of byte b: the top half of (b + 1) times an odd 64-bit number, scrambled by its square.
_SEED = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_GEAR = ((_SEED * (_SEED | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


def cut_points(raw: bytes, mean_bytes: int) -> list[int]:
    """Where a text is cut: the hash of the 32 bytes before is below a threshold. ``mean_bytes`` is the mean distance."""
    rolled = _GEAR[np.frombuffer(raw, dtype=np.uint8)]
    step = 1
    while step < _WINDOW:
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = longer, 2 * step
    below = np.uint32((1 << 32) // mean_bytes)
    return [int(i) + 1 for i in np.flatnonzero(rolled < below) if _WINDOW <= i + 1 < len(raw)]


class Encoded(NamedTuple):
    """Number of ids, the ids and the tokens, each joined by one space."""

    count: int
    ids: str
    tokens: str


@dataclass(slots=True)
class _Chunk:
    """What lies between the pieces of words at its edges; ``solid`` has no white space at all."""

    head: bytes
    words: bytes
    tail: bytes
    solid: bool
    inside: bytes = b""


class _Words(NamedTuple):
    """Words and the ids of each."""

    words: pa.Array
    ids: pa.Array

    def joined(self, *others: _Words) -> _Words:
        return _Words(*map(pa.concat_arrays, zip(self, *others, strict=True)))


#: Bytes of an entry of the chunk table besides its texts and ids: keys, objects, string headers.
_ENTRY = 400
#: Bytes of text that are cut into words at once, and words that the tokenizer gets as one text and as one list of texts.
_CUT_AT_ONCE = 1 << 22
_LINE, _LINES = 128, 64

_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(_BLANKS, dtype=np.uint8))


def _bounded(units: list[bytes], most_bytes: int) -> Iterator[list[bytes]]:
    """The units in order, in lists of few bytes; a longer one is a list of its own."""
    begin = held = 0
    for i, unit in enumerate(units):
        if i > begin and held + len(unit) > most_bytes:
            yield units[begin:i]
            begin, held = i, 0
        held += len(unit) + 1
    if begin < len(units):
        yield units[begin:]


def _split(units: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the units, and before which word each unit begins and the last one ends."""
    raw = np.frombuffer(b" ".join(units), dtype=np.uint8)
    full = np.zeros(len(raw) + 2, dtype=np.int8)
    full[1:-1] = ~_IS_BLANK[raw]
    edges = np.flatnonzero(np.diff(full))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    letters = raw[full[1:-1].view(bool)]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    begins = np.concatenate([[0], np.cumsum([len(u) + 1 for u in units])])
    return pa.Array.from_buffers(pa.binary(), len(starts), buffers), np.searchsorted(starts, begins)


class ChunkEncoder:
    """Encodes lists of texts as the tokenizer would encode each text whole."""

    def __init__(self, definition: str, mean_bytes: int = 512, most_bytes: int = 1 << 24, most_word_bytes: int = 1 << 22):
        """The bounds are of the table of chunks and of the table of words; as much that was used before is held, too."""
        # Spark runs one worker per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_str(definition)
        if self._tokenizer.decoder is not None:
            raise ValueError("words can be decoded one by one only if the definition has no decoder")
        # Without a decoder in the definition, decoding joins the tokens by one space.
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._tokens = pa.array([self._tokenizer.id_to_token(i) for i in range(size)], type=pa.large_string())
        self._numbers = pa.array([str(i) for i in range(size)], type=pa.large_string())
        self._kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self._mean, self._most, self._most_words = mean_bytes, most_bytes, most_word_bytes
        # What was used last, and before that: a table that is full becomes the older one.
        self._none = _Words(pa.array([], type=pa.binary()), pa.array([], type=pa.list_(pa.from_numpy_dtype(self._kind))))
        self._words = self._older_words = self._none
        self._chunks: dict[bytes, _Chunk] = {}
        self._older_chunks: dict[bytes, _Chunk] = {}
        self._chunk_bytes = 0
        # Chunks of the list at work that have no ids yet.
        self._new: list[_Chunk] = []
        self.encoded_bytes = 0

    def _chunk(self, raw: bytes) -> _Chunk:
        found = self._chunks.get(raw)
        if found is not None:
            return found
        found = self._older_chunks.get(raw)
        if found is None:
            blank = _BLANK.search(raw)
            if blank is None:
                found = _Chunk(raw, b"", b"", True)
            else:
                tail = b"" if raw[-1:] in _BLANK_SET else raw.rsplit(None, 1)[-1]
                found = _Chunk(raw[: blank.start()], raw[blank.start() : len(raw) - len(tail)], tail, False)
                self._new.append(found)
        self._chunks[raw] = found
        self._chunk_bytes += len(raw) + len(found.inside) + _ENTRY
        return found

    def _layout(self, raw: bytes) -> list[bytes | _Chunk]:
        """The chunks of a text with the words that span their joins between them."""
        parts: list[bytes | _Chunk] = []
        open_words: list[bytes] = []
        begin = 0
        for end in [*cut_points(raw, self._mean), len(raw)]:
            chunk = self._chunk(raw[begin:end])
            begin = end
            open_words.append(chunk.head)
            if not chunk.solid:
                if word := b"".join(open_words):
                    parts.append(word)
                parts.append(chunk)
                open_words = [chunk.tail]
        if word := b"".join(open_words):
            parts.append(word)
        return parts

    def _encoded(self, words: list[str]) -> pa.Array:
        """The ids of every word. A text of many words costs less than as many texts; offsets tell the words apart."""
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        lines = [words[i : i + _LINE] for i in range(0, len(words), _LINE)]
        for i in range(0, len(lines), _LINES):
            some = lines[i : i + _LINES]
            encodings = self._tokenizer.encode_batch([" ".join(line) for line in some], add_special_tokens=False)
            for line, found in zip(some, encodings, strict=True):
                # The blank after every word: a token may begin with the blank before its word.
                ends = np.cumsum([len(w) + 1 for w in line]) - 1
                starts = np.fromiter((o[0] for o in found.offsets), dtype=np.int64)
                counts.append(np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(line)))
                ids.append(np.array(found.ids, dtype=self._kind))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    def _learn(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, which all are in the younger table then."""
        if self._words.words.nbytes + self._words.ids.nbytes > self._most_words:
            self._older_words, self._words = self._words, self._none
        known, older = self._words, self._older_words
        place = pc.index_in(words, value_set=known.words)
        unknown = place.is_null()
        others = words.filter(unknown)
        before = pc.index_in(others, value_set=older.words)
        again = before.is_valid()
        missing = others.filter(before.is_null())
        more = [_Words(others.filter(again), older.ids.take(before.drop_null()))]
        if len(missing):
            more.append(_Words(missing, self._encoded([w.decode("utf-8", "surrogatepass") for w in missing.to_pylist()])))
            self.encoded_bytes += pc.sum(pc.binary_length(missing)).as_py()
        self._words = known.joined(*more)
        # Words of the older table were put before missing ones.
        again, unknown = again.to_numpy(zero_copy_only=False), unknown.to_numpy(zero_copy_only=False)
        added = np.where(again, np.cumsum(again), again.sum() + np.cumsum(~again)) - 1 + len(known.words)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).copy()
        place[unknown] = added
        return self._words.ids.take(pa.array(place))

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """The ids of the words of every unit, as bytes."""
        results: list[bytes] = []
        for some in _bounded(units, _CUT_AT_ONCE):
            words, bounds = _split(some)
            coded = words.dictionary_encode()
            found = self._learn(coded.dictionary).take(coded.indices)
            raw = found.flatten().to_numpy(zero_copy_only=False).tobytes()
            first = found.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = ((first[bounds] - first[0]) * self._kind.itemsize).tolist()
            results += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return results

    def _written(self, names: pa.Array, ids: pa.Array, bounds: pa.Array) -> list[str]:
        """The names of all ids between two bounds, joined by one space."""
        lists = pa.LargeListArray.from_arrays(bounds, names.take(ids))
        return pc.binary_join(lists, pa.scalar(" ", type=names.type)).to_pylist()

    def encode(self, texts: list[str]) -> list[Encoded]:
        """The encoding of every text; an empty text has no ids."""
        if self._chunk_bytes > self._most:
            self._older_chunks, self._chunks, self._chunk_bytes = self._chunks, {}, 0
        self._new = []
        layouts = [self._layout(t.encode("utf-8", "surrogatepass")) if t else [] for t in texts]
        across = list({p for layout in layouts for p in layout if isinstance(p, bytes)})
        found = self._ids([*across, *[c.words for c in self._new]])
        known = dict(zip(across, found, strict=False))
        for chunk, ids in zip(self._new, found[len(across) :], strict=True):
            chunk.inside, chunk.words = ids, b""
            self._chunk_bytes += len(ids)
        self._new = []
        whole = [b"".join([known[p] if isinstance(p, bytes) else p.inside for p in layout]) for layout in layouts]
        counts = [len(w) // self._kind.itemsize for w in whole]
        bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
        ids = pa.array(np.frombuffer(b"".join(whole), dtype=self._kind))
        written = [self._written(names, ids, bounds) for names in (self._numbers, self._tokens)]
        return [Encoded(*e) for e in zip(counts, *written, strict=True)]


_BLANK_SET = frozenset(bytes([b]) for b in _BLANKS)


def encode_texts(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, kept: tuple[str, ...] = (), whole: bool = False
) -> DataFrame:
    """``doc_id``, the columns ``kept``, ``n_tokens, ids_sha256, decoded_sha256`` of every row.

    The digests are of the ids joined by one space and of the decoded text; with ``whole`` the ids are
    returned, too (``ids``). A null or empty text has no ids. The tokenizer file must
    be a JSON definition whose pre-tokenizer drops white space; it is read on the driver and sent along.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    definition = df.sparkSession.sparkContext.broadcast(text)
    name = f"bpe {hashlib.sha256(text.encode()).hexdigest()}"

    def encode(texts: list[str]) -> dict[str, list]:
        found = kept_in_worker(name, lambda: ChunkEncoder(definition.value)).encode(texts)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        out = {
            "n_tokens": [e.count for e in found],
            "ids_sha256": [digest(e.ids) for e in found],
            "decoded_sha256": [digest(e.tokens) for e in found],
        }
        return out | ({"ids": [e.ids for e in found]} if whole else {})

    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    added |= {"ids": "string"} if whole else {}
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    return map_texts(rows, ["doc_id", *kept], encode, added, rows_at_once=512, keeps=name)
