"""Byte-level BPE by a tree of joins: the ids of a text from the ids of its halves.

A pattern parts a text into pieces, which are encoded each on its own. A piece that is in the vocabulary is one
id. Of any other piece the two halves are encoded, down to `LEAF` bytes, and joined: the ids of both sides stand
as they are if the two that meet leave each other alone. Else a window over the meeting place is encoded anew,
and grows on the side where its outermost id does not leave its neighbour alone.

Two ids leave each other alone if their bytes, encoded together, give just these two. A row of ids in which all
neighbours do is the encoding of its bytes: merges go by rank, the leftmost first, and each stretch goes through
its merges in the same order whatever stands around it, so the first merge across a border would also come first
when the two ids at this border are encoded alone. Outside the window all neighbours are as before, so the row is
complete once both ends of the window hold. Joining is hence associative, with the empty row as its unit.

Decoding takes bytes by id, and concatenates halves up the tree.

A null text is empty; empty texts have no ids. Texts of any length are parted in slices; bytes that are no UTF-8
read as U+FFFD. Null ids, or ids with a null or unknown one among them, decode to null. Rows are taken one by one,
so repeated rows and null keys do no harm; a column of the name of an added one, in any case, is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import others, utf8

#: Bytes that are not halved any more, and bytes whose pairs are looked through one by one.
LEAF, SHORT = 6, 32
#: Ids that are decoded at once.
LONG = 1 << 16
#: Texts up to this many characters are parted at once, longer ones in slices of this size.
SLICE = 1 << 16
#: The pattern decides on a match by what follows it within so many characters.
LOOK = 3
#: The pattern parts these from letters.
MARKS = frozenset(".,;:!?")
#: A blank after white space; the places before blanks after anything else.
_GAP, _CUT = re.compile(r"^ |\s "), re.compile(r"(?<=\S)(?= )")
#: Bytes of text or ids that become one batch.
BATCH = 1 << 20


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes in base 64 and their rank, line by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class Pairs:
    """The monoid of id rows: `join` combines the encodings of two neighbouring byte strings."""

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        self.ranks = ranks
        self.words = {rank: word for word, rank in ranks.items()}
        self.none = max(self.words, default=0) + 1
        self.vocabulary = pa.array([self.words.get(k) for k in range(self.none)], pa.binary())
        self.most = most
        self._pair: dict[tuple[int, int], list[int] | None] = {}
        self._leaf: dict[bytes, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank and leftmost first."""
        if len(data) <= SHORT:
            return self.short(data)
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0 where none does
        before = list(range(-1, n))  # where the part before begins
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= to or end[middle] != to:
                continue
            end[i], end[middle], before[to] = to, 0, i
            for start, stop in ((before[i], to), (i, end[to] if to < n else 0)):
                if start >= 0 and stop and (rank := ranks.get(data[start:stop])) is not None:
                    heapq.heappush(heap, (rank, start, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def short(self, data: bytes) -> list[int]:
        """The same merges, found by looking through all pairs each time."""
        ranks, none = self.ranks, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (lowest := min(pairs)) < none:
            i = pairs.index(lowest)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[part] for part in parts]

    def pair(self, key: tuple[int, int]) -> list[int] | None:
        """The encoding of the bytes of two ids, where it is not just these two."""
        if len(self._pair) >= self.most:
            self._pair.clear()
        ids = self.merged(self.words[key[0]] + self.words[key[1]])
        self._pair[key] = known = None if ids == [*key] else ids
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring ids leave each other alone."""
        key = (left, right)
        known = self._pair.get(key, self)
        return (self.pair(key) if known is self else known) is None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        key = (left[-1], right[0])
        window = self._pair.get(key, self)
        if window is self:
            window = self.pair(key)
        if window is None:
            return left + right
        i = j = 1
        while True:
            begins = i == len(left) or self.apart(left[-i - 1], window[0])
            ends = j == len(right) or self.apart(window[-1], right[j])
            if begins and ends:
                return left[: len(left) - i] + window + right[j:]
            i = i if begins else min(2 * i, len(left))
            j = j if ends else min(2 * j, len(right))
            window = self.merged(b"".join([self.words[k] for k in left[-i:] + right[:j]]))

    def encoded(self, data: bytes) -> list[int]:
        ids = self._leaf.get(data)
        if ids is None:
            if len(data) > LEAF:
                half = len(data) // 2
                leaf = self._leaf.get
                left, right = data[:half], data[half:]
                return self.join(leaf(left) or self.encoded(left), leaf(right) or self.encoded(right))
            if len(self._leaf) >= self.most:
                self._leaf.clear()
            ids = self._leaf[data] = self.merged(data)
        return ids

    def piece(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        return self.encoded(data) if rank is None else [rank]

    def decoded(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, or KeyError."""
        if len(ids) > LONG:
            half = len(ids) // 2
            return self.decoded(ids[:half]) + self.decoded(ids[half:])
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.vocabulary)):
            raise KeyError("an id outside the vocabulary")
        found = self.vocabulary.take(pa.array(ids, pa.int32()))
        if found.null_count:
            raise KeyError("an id that the vocabulary leaves out")
        return found.buffers()[2].to_pybytes() if len(found) else b""


def parted(pattern, text: str, size: int = SLICE) -> Iterator[list[str]]:
    """The pattern's matches in a text, slice by slice. Of a slice that something follows, only matches that end
    `LOOK` characters before its end are taken; the next slice begins after them."""
    at, reach = 0, size
    while at < len(text):
        stop = at + reach
        if stop >= len(text):
            yield pattern.findall(text, at)
            return
        found = [m for m in pattern.finditer(text, at, stop) if m.end() <= stop - LOOK]
        if found:
            yield [m.group() for m in found]
            at, reach = found[-1].end(), size
        else:
            reach *= 2


def stretches(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about `size` characters, each cut before a blank that follows no white space."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + size)
        while stop > 0 and text[stop - 1].isspace():
            stop = text.find(" ", stop + 1)
        stop = stop if stop > 0 else len(text)
        yield text[at:stop]
        at = stop


class Cached(dict):
    """Ids of what stands after a blank up to the next one, as 32-bit numbers; bounded: when full, what was not
    asked for since it was last full goes.

    No match holds a blank that follows something other than white space, but as its first character. So such blanks
    part a text without a change of its matches.
    """

    def __init__(self, pairs: Pairs, pattern, most: int = 150_000, longest: int = 64):
        self.pairs, self.pattern, self.most, self.longest = pairs, pattern, most, longest
        self.bare = Bare(self)
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():  # a word and its mark are two matches
            return self[chunk[:-1]] + self.bare[chunk[-1]]
        ids = self.older.get(chunk)
        if ids is None:
            text = " " + chunk
            if len(text) > self.longest:
                return self.fresh(text)
            found = self.pattern.findall(text)
            if len(found) == 1:
                ids = array("i", self.pairs.piece(text.encode())).tobytes()
            else:
                ids = b"".join([self[piece[1:]] if piece[0] == " " else self.bare[piece] for piece in found])
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def fresh(self, text: str) -> bytes:
        """Of any text, whatever stands before it."""
        return b"".join([self.bare[piece] for some in parted(self.pattern, text) for piece in some])

    def lists(self, texts: list[str]) -> pa.ListArray:
        """The ids of texts; each distinct chunk of them is looked up once."""
        firsts, chunks, places = [], [], []  # of a stretch: the first chunk, and how many follow
        stretched = []
        for text in texts:
            before = len(firsts)
            for some in stretches(text):
                if _GAP.search(some):
                    first, *rest = _CUT.split(some)
                    rest = [x[1:] for x in rest]
                else:
                    first, *rest = some.split(" ")
                firsts.append(self.fresh(first))
                chunks += rest
                places.append(len(rest))
            stretched.append(len(firsts) - before)
        coded = pa.array(chunks, pa.large_string()).dictionary_encode()
        values = [*map(self.__getitem__, coded.dictionary.to_pylist()), *firsts]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        # the first chunk of each stretch stands before the others
        after = np.array(places, np.int64)
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(after) - after, len(values) - len(firsts) + np.arange(len(firsts)))
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(values), np.int32)))
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        of_stretch = np.concatenate([[0], np.cumsum(after + 1)])
        of_text = np.concatenate([[0], np.cumsum(stretched)]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends[of_stretch[of_text]], pa.int32()), lists.take(pa.array(order)).flatten())


class Bare(dict):
    """Ids of single matches, blank or not; bounded: emptied when full."""

    def __init__(self, known: Cached):
        self.known = known

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.known.pairs.piece(piece.encode())).tobytes()
        if len(piece) <= self.known.longest:
            if len(self) >= self.known.most:
                self.clear()
            self[piece] = ids
        return ids


def _encoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes ids."""
    import regex

    known = Cached(Pairs(read_ranks(path)), regex.compile(pattern))  # lives as long as the task
    for got in batches:
        names, first, held, size = got.schema.names, 0, [], 0
        for k, text in enumerate(got.column(got.num_columns - 1), 1):
            held.append(text.as_py().decode("utf-8", "replace"))
            size += len(held[-1])
            if size >= BATCH or k == got.num_rows:
                some = got.slice(first, k - first)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], known.lists(held)], names=names)
                first, held, size = k, [], 0


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, ids, becomes bytes."""
    pairs = Pairs(read_ranks(path))

    def decoded(ids: pa.Array | None) -> bytes | None:
        if ids is None or ids.null_count:
            return None
        try:
            return pairs.decoded(ids.to_numpy())
        except KeyError:
            return None

    for got in batches:
        names, first, held, size = got.schema.names, 0, [], 0
        for k, ids in enumerate(got.column(got.num_columns - 1), 1):
            held.append(decoded(ids.values))
            size += len(held[-1] or b"")
            if size >= BATCH or k == got.num_rows:
                some = got.slice(first, k - first)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(held, pa.binary())], names=names)
                first, held, size = k, [], 0


def encode(documents: DataFrame, ranks: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of `documents`, and the ids of the text.

    ranks: the vocabulary file, at the same path on all machines. pattern: must match every character of a text,
    decide on a match by at most `LOOK` characters after it, match no blank that follows something other than
    white space but as the first character of a match, and part letters from `MARKS`.
    """
    given = documents.select(*others(documents, out), utf8(text_col).alias(out))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return given.mapInArrow(partial(_encoded, ranks, pattern), schema)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `encoded`, and the bytes of the ids."""
    given = encoded.select(*others(encoded, out), F.col(ids_col).cast("array<int>").alias(out))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, T.BinaryType())])
    return given.mapInArrow(partial(_decoded, ranks), schema)
