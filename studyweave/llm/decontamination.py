"""Finds benchmark items in documents, up to a number of edits.

Texts are lower-cased, and what is no letter, digit or underscore becomes one blank. An item of n characters
may differ by n // `per_edit` edits. By the pigeonhole principle, if it is cut into one piece more than that,
at least one piece occurs unchanged. So an Aho-Corasick automaton finds all pieces in a document; a hit fixes
where the item could lie, up to the edits; and Myers' bit-parallel algorithm gives the smallest edit distance
of the item to any part of the text there.

Items are taken in blocks of about `block`, so that what goes to the executors is bounded for any benchmark:
each block passes over the documents once.

An item too short for an edit is one piece and must occur unchanged, between word borders; letters of scripts
without blanks have a border on either side. Null items, and items without a letter, digit or underscore, match
nothing. Null texts are empty.
Repeated items are reported under each id, which may be of any type; documents are searched row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .rows import added, free, others, quoted, utf8

_WORDS = re.compile(r"\w+")
#: Thai, Lao, Myanmar, Khmer, Kana and Han: written without blanks.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def plain(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def parted(text: str, at: int) -> bool:
    """Whether a plain text has a word border before the character at `at`."""
    around = text[max(0, at - 1) : at + 1]
    return at in (0, len(text)) or " " in around or bool(_UNSPACED.search(around))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into `edits + 1` pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str, from_start: bool = False) -> tuple[int, int]:
    """The smallest edit distance of `item` to a part of `text`, and where the first such part ends. from_start: to a
    part that begins where the text does."""
    n = len(item)
    full, high = (1 << n) - 1, 1 << n - 1
    mask: dict[str, int] = {}
    for k, c in enumerate(item):
        mask[c] = mask.get(c, 0) | 1 << k
    up, down, score = full, 0, n
    best, end = n, 0
    for at, c in enumerate(text, 1):
        equal = mask.get(c, 0)
        diagonal = ((equal & up) + up ^ up) | equal | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more, less = (more << 1 | from_start) & full, less << 1 & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
        if score < best:
            best, end = score, at
    return best, end


class Search:
    """The automaton of a block of items: (item id, plain text, edits)."""

    def __init__(self, items: list[tuple[int, str, int]]):
        import ahocorasick

        self.items = items
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(items):
            for at, piece in pieces(text, edits):
                held.setdefault(piece, []).append((k, at))
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, distance, start, end, places) of the items in a plain text; start and end are of the first
        part to end with the smallest distance, the shortest of several, places counts the stretches of text with a
        match."""
        wanted: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, at in places:
                if self.items[k][2] or parted(text, end + 1 - n) and parted(text, end + 1):
                    wanted.setdefault(k, []).append(end + 1 - n - at)
        for k, starts in wanted.items():
            item_id, item, edits = self.items[k]
            best, times = None, 0
            for low, high in _windows(starts, len(item), edits):
                exact = text.find(item, low, high)
                got, end = (0, exact + len(item)) if exact >= 0 else distance(item, text[low:high])
                if got <= edits:
                    end += low if exact < 0 else 0
                    times += 1
                    if best is None or got < best[0]:
                        best = got, low, end
            if best:
                got, low, end = best
                # backwards from the end: the shortest part with this distance
                length = distance(item[::-1], text[low:end][::-1], from_start=True)[1] if got else len(item)
                yield item_id, got, end - length, end, times


def _windows(starts: list[int], length: int, edits: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold all places where an item may lie; those that overlap are one."""
    held = None
    for start in sorted(set(starts)):
        low, high = max(0, start - edits), start + length + 2 * edits
        if held and low < held[1]:
            held[1] = high
            continue
        if held:
            yield held[0], held[1]
        held = [low, high]
    if held:
        yield held[0], held[1]


def _search(ids: pa.DataType, items: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the list of what is found in its last column, a text, which it replaces."""
    search = Search(items)
    kind = pa.list_(pa.struct([("item_id", ids), ("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("times", pa.int64())]))
    for got in batches:
        out = []
        for text in got.column(got.num_columns - 1):
            found = search.found(plain(text.as_py().decode("utf-8", "replace")))
            out.append([dict(zip(("item_id", "distance", "start", "end", "times"), x, strict=True)) for x in found])
        yield pa.RecordBatch.from_arrays([*got.columns[:-1], pa.array(out, kind)], names=got.schema.names)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, per_edit: int, block: int) -> Iterator[list[tuple[int, str, int]]]:
    """The items in blocks of about `block`, dealt by a hash of their rows."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    count = max(1, -(-rows.count() // block))
    for k in range(count):
        some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()
        items = [(r.id, text, len(text) // per_edit) for r in some if (text := plain(r.text))]
        if items:
            yield items


def mark(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", per_edit: int = 16, block: int = 5_000, out: str = "leaks"
) -> DataFrame:
    """All columns of `documents`, and `out` (in place of a column of that name, in any case): an array of structs
    item_id (of the benchmark's type), distance, start, end (in the plain text) and times. One block is one pass,
    without a shuffle."""
    ids = benchmark.schema[item_id].dataType
    found = f"array<struct<item_id: {ids.simpleString()}, distance: long, start: long, `end`: long, times: long>>"
    marked = documents.select(*others(documents, out), F.expr(f"cast(array() as {found})").alias(out))
    text = free(marked, "__text")
    for items in item_blocks(benchmark, item_id, item_text, per_edit, block):
        work = partial(_search, to_arrow_type(ids), items)
        more = marked.withColumn(text, utf8(text_col)).mapInArrow(work, added(marked, f"{quoted(text)} {found}"))
        marked = more.withColumn(out, F.concat(quoted(out), quoted(text))).drop(text)
    return marked


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item found in it."""
    rows = documents.select(F.col(id_col), F.col(text_col))
    found = mark(rows, benchmark, text_col).select(id_col, F.explode("leaks").alias("x"))
    return found.select(id_col, "x.item_id", "x.distance", "x.start", "x.end", "x.times")
