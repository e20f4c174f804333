"""Phrase collocations by prefix-free parsing: n-grams are counted inside distinct chunks.

1. A text falls into pieces at marks and line ends, a piece into words. A chunk ends where the next three words hash to a multiple
   of `modulus`: what stands there decides, so equal passages are cut at equal places wherever they lie. These
   three words end the chunk and begin the next one. Distinct chunks form the dictionary, with their
   frequencies in the parse; copies cost one row of it.
2. n-grams are counted inside the chunks of the dictionary, each times the chunk's frequency. An n-gram belongs
   to the chunk in which it begins before the closing three words, so those in overlaps count once; the last
   chunk of a piece owns all of its n-grams.
3. Lengths are counted one after the other. An n-gram is written only if both its parts of one word less may be
   frequent: a bitmap of fixed size, made from hashes of the frequent ones, says so. It errs on one side only (it may let
   rare ones pass), so nothing is lost.
4. Candidates are cut at each place and looked up by joins; a phrase that is mostly part of a longer one goes.

Everything is per language; a null language is `und`. A null text is empty; empty texts add nothing. Repeated rows
count as often as they are there. No table, no candidate: no rows. Ties in the score go to the smallest cut, in the
list to the more frequent, then the smaller phrase by its bytes. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .rows import stored, utf8

#: Words that two chunks share: one less than the longest n-gram has.
OVERLAP = 3
#: Marks that part pieces become line ends, tabs become blanks, capitals small letters.
TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")
BLANK, LINE = 32, 10
#: Bits of a bitmap: 4 MB, whatever the input.
BITS = 1 << 25
_PAGE = 1 << 15  # bits that one row of a bitmap holds
#: Bytes of text held by a task before they are parsed or counted.
HELD = 12 << 20


class Hashes(dict):
    """A number for each word, by its bytes. Bounded: emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


class Words:
    """The words of pieces that follow one another. Pieces end at line ends."""

    def __init__(self, data: bytes):
        text = np.frombuffer(data, np.uint8)
        inside = (text != BLANK) & (text != LINE)
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.n = len(self.starts)
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        self.letters = text[inside]
        words = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(self.letters)])
        found = words.dictionary_encode()
        self.codes, self.distinct = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        self.piece = np.searchsorted(np.flatnonzero(text == LINE), self.starts)

    def hashes(self, known: Hashes) -> np.ndarray:
        """Of the distinct words."""
        return np.fromiter(map(known.__getitem__, self.distinct.to_pylist()), np.uint64, len(self.distinct))


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def chunks(words: Words, modulus: int, known: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of owned words and number of words of each chunk."""
    n, piece = words.n, words.piece
    begins = np.ones(n, bool)
    begins[1:] = piece[1:] != piece[:-1]
    starts = np.flatnonzero(begins)
    ends = np.concatenate([starts[1:], [n]])[: len(starts)]  # of pieces
    if n >= OVERLAP:
        h = words.hashes(known)[words.codes]
        window = h[:-2] * _A + h[1:-1] * _B + h[2:] * _C
        window ^= window >> np.uint64(29)
        trigger = (window * _A >> np.uint64(32)) % np.uint64(modulus) == 0
        begins[:-2] |= trigger & (piece[2:] == piece[:-2])
    first = np.flatnonzero(begins)
    end = ends[np.searchsorted(starts, first, side="right") - 1]
    after = np.concatenate([first[1:], [n]])[: len(first)]
    return first, after - first, np.where(after == end, end, after + OVERLAP) - first


def _parse(lang: str, texts: list[bytes], modulus: int, known: Hashes) -> Iterator[pa.RecordBatch]:
    words = Words(b"\n".join(texts).translate(TABLE))
    if not words.n:
        return
    first, own, size = chunks(words, modulus, known)
    # all words with one blank after each, of which chunks are slices
    length = words.ends - words.starts
    ends = np.cumsum(length + 1)
    starts = ends - length - 1
    spaced = np.full(ends[-1], BLANK, np.uint8)
    letters = np.ones(ends[-1], bool)
    letters[ends - 1] = False
    spaced[letters] = words.letters
    line = spaced.tobytes()
    cuts = zip(starts[first].tolist(), (ends[first + size - 1] - 1).tolist(), strict=True)
    table = pa.table({"own": pa.array(own, pa.int32()), "chunk": pa.array([line[a:b] for a, b in cuts], pa.binary())})
    counted = table.group_by(["own", "chunk"]).aggregate([([], "count_all")])
    some = pa.table({"lang": pa.repeat(lang, counted.num_rows), "own": counted["own"], "chunk": counted["chunk"], "n": counted["count_all"]})
    yield from some.to_batches(max_chunksize=50_000)


def _parsed(modulus: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, text: lang, owned words, chunk and its frequency here."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size, known = 0, Hashes()

    def out() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            yield from _parse(lang, texts, modulus, known)

    for got in batches:
        for lang, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            held[lang].append(text)
            size += len(text)
            if size >= HELD:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def dictionary(documents: DataFrame, lang_col: str, text_col: str, modulus: int) -> DataFrame:
    """The distinct chunks of each language, with the number of words they own and their frequency."""
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), utf8(text_col))
    parsed = rows.mapInArrow(partial(_parsed, modulus), "lang string, own int, chunk binary, n long")
    return parsed.groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n"))


#: By place in a phrase, how far its word's hash is turned before all are combined.
_TURN = 13


def _turned(h, bits: int):
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits)) if bits else h


def _turned_column(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


class Bitmap:
    """Whether a phrase may be frequent, by its hash."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(BITS - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(frequent: DataFrame, length: int) -> Bitmap:
    """Of the phrases of a table: at most BITS / _PAGE rows come to the driver, 4 KB each."""
    words = F.split("phrase", " ", -1)
    parts = [_turned_column(F.xxhash64(words[k]), _TURN * k) for k in range(length)]
    at = F.pmod(reduce(Column.bitwiseXOR, parts, F.xxhash64("lang")), F.lit(BITS))
    pages = frequent.select((at / _PAGE).cast("int").alias("page"), (at % _PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in pages.toLocalIterator():
        bits[row.page * (_PAGE // 8) : (row.page + 1) * (_PAGE // 8)] = np.frombuffer(row.bits, np.uint8)
    return Bitmap(bits)


def grams(lang: str, data: bytes, own: np.ndarray, weights: np.ndarray, length: int, may: list[Bitmap], known: Hashes) -> tuple[pa.Array, np.ndarray]:
    """Phrases of `length` words and their weights, of chunks, one in a line. may: by length, from one word."""
    words = Words(data)
    codes, chunk, n = words.codes, words.piece, words.n
    ends = np.searchsorted(chunk, np.arange(len(own)), side="right")
    starts = np.concatenate([[0], ends[:-1]])
    left = ends[chunk] - np.arange(n)  # words to the end of the chunk
    at = np.arange(n)
    if length > 1:
        h = words.hashes(known)
        total = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42)) ^ h[codes]
    for k in range(1, length):  # of the places of phrases of k words to those of one word more
        open_ = np.zeros(n, bool)
        open_[at[may[k - 1].may(total[at])]] = True
        at = np.flatnonzero(open_[:-1] & open_[1:] & (left[:-1] > k))
        total[at] ^= _turned(h[codes[at + k]], _TURN * k)
    # a phrase that begins here counts for this chunk
    at = at[at < (starts + own)[chunk[at]]]
    if not len(at):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    worth = weights[chunk[at]].astype(np.float64)  # sums of whole numbers, exact up to 2 ** 53
    if length == 1:
        counts = np.bincount(codes[at], worth, len(words.distinct)).astype(np.int64)
        some = np.flatnonzero(counts)
        return words.distinct.take(pa.array(some)), counts[some]
    keys, distinct = codes[at], len(words.distinct)
    for k in range(1, length):
        if int(keys.max()) + 1 > (1 << 62) // distinct:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * distinct + codes[at + k]
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, worth).astype(np.int64)
    parts = [words.distinct.take(pa.array(codes[at[first] + k])) for k in range(length)]
    return pc.binary_join_element_wise(*parts, b" "), counts


def _counted(length: int, may, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, own, chunk, n: lang, phrase and its count here."""
    held: dict[str, list[pa.RecordBatch]] = defaultdict(list)
    size, known = 0, Hashes()

    def out() -> Iterator[pa.RecordBatch]:
        for lang, some in held.items():
            rows = pa.Table.from_batches(some)
            own, weights = (rows.column(c).to_numpy().astype(np.int64) for c in ("own", "n"))
            chunk = pa.concat_arrays(rows.column("chunk").chunks)
            lines = pc.binary_join(pa.ListArray.from_arrays([0, len(chunk)], chunk), b"\n")
            phrases, counts = grams(lang, lines[0].as_py(), own, weights, length, may.value, known)
            found = pa.table({"lang": pa.repeat(lang, len(counts)), "phrase": phrases, "f": pa.array(counts, pa.int64())})
            yield from found.to_batches(max_chunksize=50_000)

    for got in batches:
        langs = got.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            held[lang].append(got.filter(pc.equal(langs.indices, k)) if len(langs.dictionary) > 1 else got)
        size += got.column(2).nbytes
        if size >= HELD:
            yield from out()
            held.clear()
            size = 0
    yield from out()


def frequent(spark: SparkSession, parsed: DataFrame, least: int, longest: int = OVERLAP + 1) -> list[DataFrame]:
    """By length, the phrases with at least `least` occurrences: lang, phrase, f."""
    found, may = [], []
    for length in range(1, longest + 1):
        known = spark.sparkContext.broadcast(list(may))
        counts = parsed.mapInArrow(partial(_counted, length, known), "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found.append(stored(spark, counts.filter(F.col("f") >= least).withColumn("phrase", F.col("phrase").cast("string")), f"phrases{length}"))
        known.unpersist()
        if length < longest:
            may.append(bitmap(found[-1], length))
    return found


def scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a) with l, r and score of their lowest-scoring cut. parts: lang, phrase, f."""
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    joined = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = cuts.withColumn("first", joined(F.lit(1), F.col("k"))).withColumn("rest", joined(F.col("k") + 1, F.size("words") - F.col("k"))).drop("words")
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = lookup_join(cuts, parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part], at_most=parts)
    # a is at most l and r, so the score is at most 1,000,000; the product may take 85 bits
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates that lie inside a longer one with at least `share` percent of their occurrences: lang, phrase."""
    n = F.size("words")
    inner = candidates.withColumn("words", F.split("phrase", " ", -1)).filter(n > 2)
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), n - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    enough = F.expr(f"cast(longer as decimal(22, 0)) * 100 >= cast(a as decimal(22, 0)) * {int(share)}")
    return candidates.join(most, ["lang", "phrase"]).filter(enough).select("lang", "phrase")


def collocations(
    spark: SparkSession,
    documents: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 30,
    share: int = 80,
    most: int = 2000,
    modulus: int = 16,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language."""
    parsed = stored(spark, dictionary(documents, lang_col, text_col, modulus), "chunks")
    totals = parsed.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    single, *longer = frequent(spark, parsed, least)
    parts = candidates = None
    for frame in longer:
        named = frame.withColumnRenamed("f", "a")
        candidates = named if candidates is None else candidates.unionByName(named)
    for frame in (single, *longer[:-1]):
        parts = frame if parts is None else parts.unionByName(frame)
    kept = scored(candidates, parts).join(covered(candidates, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    top = kept.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= most).drop("rank")
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return lookup_join(ranked, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
