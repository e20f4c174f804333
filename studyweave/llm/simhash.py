"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

1. A text's fingerprint: a bit is 1 if it is set in over half of the hashes of its word shingles. Copies are
   combined at once: from here on, only different fingerprints count.
2. Fingerprints that differ in at most `radius` bits agree wholly in one of `radius + 1` bands of bits. So
   each goes to one shard per band, named by the band and its bits. A shard of more than `most` fingerprints
   is split by bands of its remaining bits in the same way, again and again, without losing a pair.
3. A shard's fingerprints form a BK-tree: children are keyed by their distance to the parent, and a search
   follows the edges within the radius only. The tree goes to its shard's searches alone: it holds at most
   `most` fingerprints, so what is sent is bounded for any input. Shards yield links to one member of a local
   group rather than all pairs.
4. Components: each fingerprint takes the smallest root within reach, by joins that hook roots to smaller
   ones and then halve the paths, until nothing changes. All rounds write to the shared folder.

Ids are whole numbers, or texts of them. A null or blank text has fingerprint zero, which is linked like any other. Null ids never name a component
unless all its ids are null; repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .rows import batch, changes, dropped, stored, utf8, whole_groups

BITS = 64
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SHARD = pa.schema([("shard", pa.int64()), ("print", pa.int64()), ("fixed", pa.int64())])
#: Rows up to which a table is sent to all executors: a megabyte or two.
LOOKUP = 50_000
#: Shingles whose bits are counted at once, to bound memory.
_PART = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    parts = text.lower().split()
    if not parts:
        return 0
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _PART):
        ones += np.unpackbits(hashes[at : at + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _prints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        found = [fingerprint(x.as_py(), words) for x in got.column(got.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*got.columns[:-1], pa.array(found, pa.int64())], names=[*got.schema.names[:-1], "__print"])


def bands(free: int, count: int) -> list[int]:
    """Masks that part the bits of `free` into `count` bands."""
    bits = [1 << k for k in range(BITS) if free >> k & 1]
    size, more = divmod(len(bits), count)
    masks, at = [], 0
    for k in range(count):
        n = size + (k < more)
        masks.append(sum(bits[at : at + n]))
        at += n
    return masks


def _sharded(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per band of each row's bits that aren't `fixed`; rows: shard, print, fixed."""
    for got in batches:
        shard, prints, fixed = (c.to_numpy(zero_copy_only=False) for c in got.columns)
        for held in np.unique(fixed):
            some = fixed == held
            for k, mask in enumerate(bands(~int(held) & (1 << BITS) - 1, radius + 1)):
                key = prints[some].view(np.uint64) & np.uint64(mask)
                parts = np.stack([shard[some].view(np.uint64), np.full(len(key), mask, np.uint64), key], 1)
                named = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), k) for x in parts), np.uint64, len(key))
                now = int(np.array([int(held) & (1 << BITS) - 1 | mask], np.uint64).view(np.int64)[0])
                yield batch(_SHARD, [named.view(np.int64), prints[some], np.full(len(key), now)])


class Tree:
    """A BK-tree of fingerprints."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, wanted: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.prints else []
        while open_:
            node = open_.pop()
            distance = (self.prints[node] ^ wanted).bit_count()
            if distance <= radius:
                found.append(node)
            open_ += [child for edge, child in self.children[node].items() if abs(edge - distance) <= radius]
        return found

    def add(self, wanted: int) -> int:
        self.prints.append(wanted)
        self.children.append({})
        new, node = len(self.prints) - 1, 0
        while new:
            edge = (self.prints[node] ^ wanted).bit_count()
            if (child := self.children[node].setdefault(edge, new)) == new:
                break
            node = child
        return new


def tree_links(prints: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius that connect what it connects, at most one per group and fingerprint."""
    tree, root = Tree(), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for wanted in prints:
        groups = {top(k): k for k in tree.near(wanted, radius)}
        new = tree.add(wanted)
        root.append(new)
        for group, k in groups.items():
            root[group] = new
            yield tree.prints[k], wanted


def _linked(radius: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = (1 << BITS) - 1
    for (shard, prints), _, _ in whole_groups(batches, 4 * most):
        edge = np.flatnonzero(changes(shard))
        links: list[tuple[int, int]] = []
        for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(shard)], strict=True):
            if high - low > 1:
                links += tree_links([x & mask for x in prints[low:high].tolist()], radius)
        if links:
            pairs = np.array(links, np.uint64).view(np.int64)
            yield batch(_LINK, [pairs[:, 0].copy(), pairs[:, 1].copy()])


def links(spark: SparkSession, prints: DataFrame, radius: int, most: int = 4096) -> DataFrame:
    """Links (a, b) that connect the fingerprints (column `__print`, each once) within the radius."""
    kind = "shard long, print long, fixed long"
    rows = prints.select(F.lit(0).cast("long").alias("shard"), F.col("__print").alias("print"), F.lit(0).cast("long").alias("fixed"))
    found, read = None, []
    for _ in range(BITS):
        shards = stored(spark, rows.mapInArrow(partial(_sharded, radius), kind), "shards")
        read.append(shards)
        sizes = shards.groupBy("shard").count().filter("count > 1")
        met = shards.join(sizes, "shard")
        small = met.filter(F.col("count") <= most).select("shard", "print")
        pairs = small.repartition("shard").sortWithinPartitions("shard", "print").mapInArrow(partial(_linked, radius, most), "a long, b long")
        found = pairs if found is None else found.union(pairs)
        large = sizes.filter(F.col("count") > most)
        if large.isEmpty():
            break
        rows = shards.join(large.select("shard"), "shard")
    linked = stored(spark, found.distinct(), "links")
    dropped(*read)
    return linked


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it reaches."""
    both = stored(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    roots = stored(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        of = roots.select(F.col("node").alias("b"), F.col("root").alias("other"))
        seen = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = roots.join(seen, "node").select("node", "root", F.least("root", "other").alias("low"))
        # a root takes the smallest root that any of its nodes has seen; then all nodes look up their root's
        better = hooked.filter("low < root").groupBy(F.col("root").alias("top")).agg(F.min("low").alias("best"))
        better = better.withColumnRenamed("top", "root")  # a root may have many nodes
        lifted = lookup_join(hooked, better, ["root"], "left", LOOKUP, at_most=roots).select("node", F.least("low", "best").alias("root"))
        step = stored(spark, lifted, "step")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = lookup_join(step, up, ["root"], "left", LOOKUP, at_most=step).select("node", F.least("root", "above").alias("root"))
        new = stored(spark, jumped, "roots")
        moved = new.join(roots.withColumnRenamed("root", "was"), "node").filter("root <> was")
        still = moved.isEmpty()
        dropped(step, roots)
        if still:
            dropped(both)
            return new
        roots = new


def near_duplicates(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """A row per document: its id, fingerprint (16 hexadecimal digits) and component_id, the smallest id that
    links reach."""
    ids = documents.select(F.col(id_col).cast("long").alias("__id"), utf8(text_col).alias("__text"))
    prints = stored(spark, ids.mapInArrow(partial(_prints, words), "__id long, __print long"), "prints")
    firsts = stored(spark, prints.groupBy("__print").agg(F.min("__id").alias("__low")), "firsts")
    roots = components(spark, links(spark, firsts, radius))
    linked = stored(spark, firsts.join(roots, F.col("__print") == F.col("node")).select("__print", "__low", "root"), "linked")
    low = linked.groupBy("root").agg(F.min("__low").alias("__component"))
    of_linked = lookup_join(linked, low, ["root"], "inner", LOOKUP, at_most=linked).select("__print", "__component")
    classes = firsts.join(of_linked, "__print", "left").select("__print", F.coalesce("__component", "__low").alias("__component"))
    digits = F.lower(F.lpad(F.hex("__print"), 16, "0"))
    return prints.join(classes, "__print").select(F.col("__id").alias(id_col), digits.alias("fingerprint"), F.col("__component").alias("component_id"))
