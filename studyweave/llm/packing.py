"""Packing of token ids into sequences of equal cost.

A document costs `linear * n + quadratic * n * n`: work by token, and attention among its tokens. Documents
are taken block by block of a partition, `block` tokens at a time, so a task holds one block whatever its
input. What exceeds whole sequences is cut off a document first. The rest is assigned, the costliest first,
to the sequence of lowest cost that has room for all of it; if none has, it is cut to fill the sequence of
lowest cost with room. The sequences of a block hold exactly what is assigned to them; what is left over
goes to the next block, and at the end of a partition fills sequences whose capacities are powers of two. So
no sequence needs padding to either size.

Ids are whole numbers, or texts of them. A null text is empty; an empty text is its end id alone. Rows with equal or null ids are packed as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import batch, utf8

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())]
)


#: A word of Latin letters, and ASCII signs but the apostrophe, which the tokenizer parts from it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: A point after a Latin letter and before a blank: the tokenizer parts it from the word. The point comes first, as
#: one sign is searched for faster than what stands before it.
_POINT = re.compile(rb"([.,!?;:])(?<=[A-Za-z].)(?=[\x20\n])")


def byte_symbols() -> list[str]:
    """The characters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, the
    rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Chunks(dict):
    """Ids of text between blanks, as little-endian 32-bit numbers, by its bytes. Bounded: emptied when full.

    Words of Latin letters go to the tokenizer's model at once, as its other steps only lower their case and
    write their bytes; signs after such a word are looked up on their own. All else goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.pieces = whole.encode, whole.model.tokenize
        self.symbols = dict(enumerate(byte_symbols()))
        self.most, self.longest = most, longest

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > self.longest:
            return self.fresh(chunk)
        if len(self) >= self.most:
            self.clear()
        self[chunk] = ids = self.fresh(chunk)
        return ids

    def fresh(self, chunk: bytes) -> bytes:
        if len(chunk) <= self.longest and chunk.isalpha():  # ASCII letters, which stand for themselves
            return self.word(chunk.lower().decode())
        text = chunk.decode("utf-8", "replace")
        if len(chunk) <= self.longest and (found := _WORD.fullmatch(text)):
            word, signs = found.groups()
            if signs:
                return self[word.encode()] + self[signs.encode()]
            return self.word(word.lower().encode().decode("latin-1").translate(self.symbols))
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, written: str) -> bytes:
        return array("I", [piece.id for piece in self.pieces(written)]).tobytes()

    def ids(self, text: bytes) -> bytes:
        """The tokenizer's ids of the text: none of its patterns reach across a blank, and it lowers case
        itself (but for the names of special tokens), after it composes letters and accents. So where accents
        stand alone, U+0300 to U+036F, only pure ASCII chunks are lowered before."""
        accents = b"\xcc" in text or b"\xcd" in text
        if b"<|" in text:
            return b"".join(map(self.__getitem__, _POINT.sub(rb" \1", text).split()))
        chunks = _POINT.sub(rb" \1", text if accents else text.lower()).split()
        return b"".join(map(self.__getitem__, [x.lower() if x.isascii() else x for x in chunks] if accents else chunks))


class Packer:
    """Assigns the pieces of one partition."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.sequences = 0
        self.left: list[tuple] = []  # (row, start, ids)

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def pack(self, rows: list[tuple], last: bool) -> Iterator[tuple]:
        """(row, start, ids, sequence, offset, cost); rows: (row, ids)."""
        whole = self.capacity * 4
        pool, self.left = self.left, []
        for row, ids in rows:
            at = 0
            while len(ids) - at >= whole:
                yield row, at // 4, ids[at : at + whole], self.sequences, 0, self.cost(self.capacity)
                self.sequences += 1
                at += whole
            if at < len(ids):
                pool.append((row, at // 4, ids[at:] if at else ids))
        total = sum(len(ids) for _, _, ids in pool) // 4
        rooms = [self.capacity] * (total // self.capacity)
        if last:
            rest = total % self.capacity
            rooms += [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        room, spent = np.array(rooms, np.int64), np.zeros(len(rooms))
        pool.sort(key=lambda x: -len(x[2]))
        for row, start, ids in pool:
            while ids:
                n = len(ids) // 4
                fits = room >= n
                if not fits.any():
                    fits = room > 0
                    if not fits.any():
                        self.left.append((row, start, ids))
                        break
                k = int(np.argmin(np.where(fits, spent, np.inf)))
                n = min(n, int(room[k]))
                yield row, start, ids[: 4 * n], self.sequences + k, rooms[k] - int(room[k]), self.cost(n)
                room[k] -= n
                spent[k] += self.cost(n)
                start, ids = start + n, ids[4 * n :]
        self.sequences += len(rooms)


def _packed(path: str, end_id: int, capacity: int, block: int, linear: float, quadratic: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks, packer = Chunks(path), Packer(capacity, linear, quadratic)
    base = TaskContext.get().partitionId() << 32
    end = np.array([end_id], "<u4").tobytes()

    def out(held: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
        found = list(packer.pack(held, last))
        for at in range(0, len(found), 2_000):
            some = found[at : at + 2_000]
            row, start, ids, sequence, offset, cost = zip(*some, strict=True)
            yield batch(_OUT, [[r[0] for r in row], start, ids, [r[1] for r in row], [base + s for s in sequence], offset, cost])

    held: list[tuple] = []
    size = 0
    for got in batches:
        for doc_id, text in zip(got.column(0).to_pylist(), got.column(1), strict=True):
            ids = chunks.ids(text.as_py()) + end
            held.append(((doc_id, len(ids) // 4), ids))
            size += len(ids) // 4
            if size >= block:
                yield from out(held, False)
                held, size = [], 0
    yield from out(held, True)


def pack(
    documents: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
    block: int = 1 << 21,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
) -> DataFrame:
    """A row per piece: doc_id, start, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, cost.

    tokenizer: the vocabulary file, at the same path on all machines.
    """
    rows = documents.select(F.col(id_col).cast("long"), utf8(text_col))
    work = partial(_packed, tokenizer, end_id, capacity, block, linear, quadratic)
    return rows.mapInArrow(work, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, cost double")
