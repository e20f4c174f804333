"""Removal of byte strings that occur earlier in the corpus.

Every `length`-byte run belongs to one anchor (see `anchors`), and equal runs to equal anchors at equal
places. So runs are compared anchor by anchor:

1. A document gives one row per anchor: its hash, and the hash of the stretch of runs that it owns.
   Equal stretches are combined in each batch, before the shuffle; the later ones are covered whole.
2. Rows are shuffled by anchor and read in order. Of equal stretches the first stays in the search; an
   anchor with different stretches makes candidates.
3. Candidates fetch their bytes by a join on the document. A stretch is cut into blocks of `STEP` starts.
   All runs of a block contain the same core, so a block is a string of a few bytes, the core as one
   symbol, and a few bytes. Blocks with equal cores meet in one task, whose texts are searched for
   common strings by breadth-first backward extension on their transform (see `bwt`), up to `length`.
4. A core with more than `MOST` different blocks is not searched in one task: its runs are hashed one by
   one and grouped by Spark, with partial aggregates.
5. The spans are merged per document and cut out.

Rows whose id is null, or repeats, count as documents of their own, ordered by id (nulls first) and then
text; of two equal rows one stays. Null texts are empty. Texts shorter than `length` are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as anchor
from .bwt import common
from .rows import batch, changes, joined, numbers, spans_merged, stored, utf8, whole_groups

STEP = 20
#: Different blocks of one core that one task compares.
MOST = 100_000
#: Rows of blocks that one search takes together, unless one core has more.
SEARCH = 60_000
#: Rows of an anchor held while it is not known whether it has different stretches.
HELD = 200_000

_ROW = pa.schema([("deal", pa.int64()), ("stretch", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.schema([("deal", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_BLOCK = pa.schema([("core", pa.int64()), ("same", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
_RUN = pa.schema([("run", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _stretches(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1. A row with `at` -1 is a covered span, dealt at random."""
    for got in batches:
        keys, texts = numbers(got.column(0)), got.column(1).to_pylist()
        found: list[tuple[np.ndarray, ...]] = []
        for slab in anchor.slabs(texts, length):
            sizes = np.array([len(piece) for _, _, piece in slab])
            ends = np.cumsum(sizes)
            hashed = anchor.Hashed(np.frombuffer(b"".join(piece for _, _, piece in slab), np.uint8))
            which, at, first, last = anchor.owned(hashed, ends, length)
            if not len(at):
                continue
            text = np.searchsorted(ends, at, side="right")
            shift = np.array([offset for _, offset, _ in slab])[text] - (ends - sizes)[text]
            stretch = (hashed.pieces(first, last + length) + (at - first).astype(np.uint64) * _ODD) ^ (last - first).astype(np.uint64)
            owner = keys[np.array([k for k, _, _ in slab])[text]]
            found.append((which.view(np.int64), stretch.view(np.int64), owner, at + shift, first + shift, last + shift + length))
        if not found:
            continue
        deal, stretch, key, at, start, end = (joined(list(x)) for x in zip(*found, strict=True))
        order = np.lexsort((start, key, stretch, deal))
        deal, stretch, key, at, start, end = (x[order] for x in (deal, stretch, key, at, start, end))
        new = changes(deal, stretch)
        yield batch(_ROW, [deal[new], stretch[new], key[new], at[new], start[new], end[new]])
        yield from _covered(_ROW, key[~new], start[~new], end[~new])


def _covered(schema: pa.Schema, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, start, end = spans_merged(key, start, end)
    if len(key):
        deal = ((key.astype(np.uint64) + start.astype(np.uint64)) * _ODD).view(np.int64)
        by = {"deal": deal, "stretch": deal, "key": key, "at": np.full(len(key), -1), "start": start, "end": end}
        yield batch(schema, [by[name] for name in schema.names])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: covered spans, and candidates of anchors with different stretches."""
    before = None  # the last stretch of an anchor that goes on
    for (deal, stretch, key, at, start, end), more, again in whole_groups(batches, HELD):
        span = at < 0
        yield from _covered(_FOUND, key[span], start[span], end[span])
        deal, stretch, key, at, start, end = (x[~span] for x in (deal, stretch, key, at, start, end))
        if not len(deal):
            continue
        new = changes(deal, stretch)
        if again and before == (deal[0], stretch[0]):
            new[0] = False
        before = (deal[-1], stretch[-1])
        yield from _covered(_FOUND, key[~new], start[~new], end[~new])
        deal, key, at, start, end = (x[new] for x in (deal, key, at, start, end))
        if not (more or again):
            alone = changes(deal)
            alone &= np.concatenate([alone[1:], [True]])
            deal, key, at, start, end = (x[~alone] for x in (deal, key, at, start, end))
        if len(deal):
            yield batch(_FOUND, [deal, key, at, start, end])


def _blocks(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: the blocks of each document's candidates."""
    side, digest = STEP - 1, xxhash.xxh64_intdigest
    for got in batches:
        rows: list[tuple] = []
        for key, text, cores in zip(*(c.to_pylist() for c in got.columns), strict=True):
            for at, start, end in ((c["at"], c["start"], c["end"]) for c in cores):
                base = at - (length - anchor.GRAM)
                for k in range((start - base) // STEP, (end - length - base) // STEP + 1):
                    low, inner = max(start, base + k * STEP), base + k * STEP + side
                    high = min(end, base + k * STEP + side + length)
                    core = text[inner : inner + length - side]
                    rows.append((digest(core, k), digest(text[low:high], inner - low), key, low, high, text[low:inner], text[inner + length - side : high]))
        if not rows:
            continue
        columns = list(zip(*rows, strict=True))
        core, same = (np.array(x, np.uint64).view(np.int64) for x in columns[:2])
        key, start, end = (np.array(x) for x in columns[2:5])
        order = np.lexsort((start, key, same, core))
        new = changes(core[order], same[order])
        first, later = order[new], order[~new]
        sides = [[rows[i][c] for i in first.tolist()] for c in (5, 6)]
        yield batch(_BLOCK, [core[first], same[first], key[first], start[first], end[first], *sides])
        owner, low, high = spans_merged(key[later], start[later], end[later])
        spread = ((owner.astype(np.uint64) + low.astype(np.uint64)) * _ODD).view(np.int64)
        yield batch(_BLOCK, [spread, spread, owner, low, high, [None] * len(owner), [None] * len(owner)])


def _searched(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps 3 and 4: covered runs among blocks with equal cores; runs of a core with too many blocks."""
    held: list[list[np.ndarray]] = []
    before = None
    for rows, more, again in whole_groups(batches, MOST):
        core, same, key, start, end, left, _ = rows
        span = np.array([x is None for x in left], bool)
        yield from _runs(key[span], start[span], end[span])
        new = changes(core, same) & ~span
        if again and before == (core[0], same[0]):
            new[0] = False
        before = (core[-1], same[-1])
        later = ~new & ~span
        yield from _runs(*spans_merged(key[later], start[later], end[later]))
        rows = [x[new] for x in rows]
        if more or again:
            yield from _one_by_one(length, rows)
            continue
        alone = changes(rows[0])
        alone &= np.concatenate([alone[1:], [True]])[: len(alone)]
        if (~alone).any():
            held.append([x[~alone] for x in rows])
        if sum(len(x[0]) for x in held) >= SEARCH:
            yield from _search(length, [np.concatenate(x) for x in zip(*held, strict=True)])
            held = []
    if held:
        yield from _search(length, [np.concatenate(x) for x in zip(*held, strict=True)])


def _runs(key: np.ndarray, start: np.ndarray, end: np.ndarray, run: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    if len(key):
        yield batch(_RUN, [pa.nulls(len(key), pa.int64()) if run is None else run, key, start, end])


def _search(length: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    core, _, key, start, _, left, right = rows
    symbol = np.cumsum(changes(core)) + 256  # the core as one symbol, above those of the bytes
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)])
    width = sizes.sum(1) + 2
    first = np.cumsum(width) - width
    text = np.zeros(int(width.sum()), np.int64)
    centre = first + sizes[:, 0]
    text[centre] = symbol
    byte = np.ones(len(text), bool)
    byte[centre] = byte[first + width - 1] = False
    text[byte] = np.frombuffer(b"".join(x for pair in zip(left, right, strict=True) for x in pair), np.uint8).astype(np.int64) + 1
    at, interval = common(text, STEP)
    if not len(at):
        return
    row = np.searchsorted(first, at, side="right") - 1
    key, start = key[row], start[row] + at - first[row]
    order = np.lexsort((start, key, interval))
    later = order[~changes(interval[order])]
    yield from _runs(*spans_merged(key[later], start[later], start[later] + length))


def _one_by_one(length: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows[0]), 10_000):
        core, _, key, start, _, left, right = (x[at : at + 10_000] for x in rows)
        out = [
            (xxhash.xxh64_intdigest(a[k:] + b[: STEP - 1 - len(a) + k], int(c) & 0xFFFFFFFFFFFFFFFF) ^ (len(a) - k), owner, s + k, s + k + length)
            for c, owner, s, a, b in zip(core, key, start, left, right, strict=True)
            for k in range(len(a) + len(b) - STEP + 2)
        ]
        run, *rest = zip(*out, strict=True)
        yield from _runs(*(np.array(x) for x in rest), np.array(run, np.uint64).view(np.int64))


_CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(characters: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5; the last two columns are the text and its spans."""
    for got in batches:
        out = []
        for text, spans in zip(got.column(got.num_columns - 2).to_pylist(), got.column(got.num_columns - 1), strict=True):
            start, end = (np.array(x, np.int64) for x in ([], []))
            if spans.is_valid and len(spans):
                start, end = (numbers(spans.values.field(k)).astype(np.int64) for k in range(2))
            _, start, end = spans_merged(np.zeros(len(start), np.int64), start, end)
            edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            if characters:
                kept = kept.decode("utf-8", "ignore").encode()
            out.append((len(text), len(text) - sum(b - a for a, b in zip(edges[::2], edges[1::2], strict=True)), len(start), kept))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        arrays = [pa.array(x, pa.int64()) for x in columns[:3]] + [pa.array(columns[3], pa.binary())]
        yield pa.RecordBatch.from_arrays([*got.columns[:-2], *arrays], names=[*got.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"])


def keyed(spark: SparkSession, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with `__key`, which has their order, and `__text`, their bytes.

    The id is the key if it is whole numbers without nulls and repeats; else the rows are sorted.
    """
    kept = documents.withColumn("__text", utf8(text_col))
    if dict(documents.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        odd = documents.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
        if odd.isEmpty():
            return kept.withColumn("__key", F.col(id_col).cast("long"))
    ordered = kept.orderBy(F.col(id_col).asc_nulls_first(), "__text")
    return stored(spark, ordered.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def repeats(spark: SparkSession, texts: DataFrame, length: int = 100) -> DataFrame:
    """Spans (`__key`, start, end) of bytes in a `length`-byte string that also starts earlier, from the columns
    `__key` and `__text`. Spans may overlap."""
    if length < 2 * anchor.GRAM + STEP:
        raise ValueError(f"length must be at least {2 * anchor.GRAM + STEP}")
    texts = texts.select("__key", "__text")
    rows = texts.filter(F.length("__text") >= length).mapInArrow(partial(_stretches, length), _ddl(_ROW))
    dealt = rows.repartition("deal").sortWithinPartitions("deal", "stretch", "key", "start")
    found = stored(spark, dealt.mapInArrow(_compared, _ddl(_FOUND)), "found")
    by_key = found.filter("at >= 0").groupBy("key").agg(F.collect_list(F.struct("at", "start", "end")).alias("cores"))
    fetched = by_key.join(texts, F.col("key") == F.col("__key")).select("key", "__text", "cores")
    blocks = fetched.mapInArrow(partial(_blocks, length), _ddl(_BLOCK))
    met = blocks.repartition("core").sortWithinPartitions("core", "same", "key", "start")
    runs = stored(spark, met.mapInArrow(partial(_searched, length), _ddl(_RUN)), "runs")
    single = runs.filter("run is not null")
    first = single.groupBy("run").agg(F.min("key").alias("low"))
    same = single.join(first, "run").filter("key > low").select("key", "start", "end")
    within = single.groupBy("run", "key").agg(F.min("start").alias("low"))
    own = single.join(within, ["run", "key"]).filter("start > low").select("key", "start", "end")
    spans = found.filter("at < 0").select("key", "start", "end")
    for more in (runs.filter("run is null").select("key", "start", "end"), same, own):
        spans = spans.union(more)
    return spans.withColumnRenamed("key", "__key")


def without_repeats(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, characters: bool = False) -> DataFrame:
    """All columns of `documents`, and n_bytes, n_removed, n_spans and kept (the remaining bytes; without
    the rest of a cut character if `characters`). Columns of those names in the input, in any case, are replaced."""
    names = [c for c in documents.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept")]
    plain = documents.select(*names)
    texts = keyed(spark, plain, id_col, text_col)
    spans = repeats(spark, texts, length).groupBy("__key").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    whole = texts.join(spans, "__key", "left").select(*names, "__text", "__spans")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
    return whole.mapInArrow(partial(_cut, characters), ", ".join([*kinds, _CUT]))
