"""Joins of fact-sized frames that stay balanced whatever the keys look like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup side is broadcast up to this many (narrow) rows.
LOOKUP_ROWS = 500_000
# A join or window task should not hold many more rows of one key than this.
ROWS_PER_TASK = 4_000_000
# Up to this many (narrow) rows per shuffle partition, the keyed side of a join is hashed in memory.
HASHED_ROWS = 1_000_000
KEYLESS_PIECES = 1024


def fits_lookup(frame: DataFrame, limit: int = LOOKUP_ROWS) -> bool:
    """True where the frame has at most `limit` rows. Reads no further than that."""
    return frame.limit(limit + 1).count() <= limit


def hashable(keyed: DataFrame, limit: int = HASHED_ROWS) -> bool:
    """True where the average shuffle partition of a written table is small enough to be hashed,
    which spares the other, larger side its sort."""
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.count() <= limit * partitions


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    limit: int = LOOKUP_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
    at_most: DataFrame | None = None,
) -> DataFrame:
    """Join facts to a table keyed by `on`: broadcast up to `limit` rows, else a shuffle join
    with the heavy keys split. `how` is inner, left, left_semi or left_anti.

    The size is read off the lookup, which should be a written table, or off `at_most`, a written
    table that has no fewer rows.
    """
    if fits_lookup(lookup if at_most is None else at_most, limit):
        return facts.join(F.broadcast(lookup), on, how)
    weights = facts.groupBy(*on).agg(F.count("*").alias("_rows"))
    return split_join(facts, lookup, on, weights, how, rows_per_task, spread=F.xxhash64(*facts.columns))


def split_join(
    facts: DataFrame,
    keyed: DataFrame,
    on: list[str],
    weights: DataFrame,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    hashed: bool = False,
    spread: Column | None = None,
) -> DataFrame:
    """Shuffle join in which a key with more than `rows_per_task` facts is cut into pieces.

    `weights` gives the facts per key (columns `on`, `_rows`). There are at most
    rows / rows_per_task heavy keys, so their list is small by construction and is broadcast; the
    other side is repeated once per piece. No row is dropped or doubled.

    By default the piece of a fact comes from its position, so that copies of one fact spread out
    too. That is stable under a retried task for facts read from a table; for facts that come out
    of a shuffle pass `spread`, a whole-number column made from the content. `hashed` asks for
    hashing the keyed side in place of sorting both.
    """
    spread = F.monotonically_increasing_id() if spread is None else spread
    heavy = weights.filter(F.col("_rows") > rows_per_task).select(
        *on, F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_pieces")
    )
    keys = heavy.collect()  # at most rows / rows_per_task, so that the weights are computed once

    def join(left, right, by):
        return left.join(right.hint("shuffle_hash") if hashed else right, by, how)

    if not keys:
        return join(facts, keyed, on)
    heavy = facts.sparkSession.createDataFrame(keys, heavy.schema)
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    # A NULL key meets nothing, so any piece will do for it.
    keyless = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    cut_facts = (
        facts.withColumn("_spread", spread)
        .join(F.broadcast(heavy), on, "left")
        .withColumn("_piece", F.pmod("_spread", F.when(keyless, KEYLESS_PIECES).otherwise(pieces)).cast("int"))
        .drop("_pieces", "_spread")
    )
    cut_keyed = (
        keyed.join(F.broadcast(heavy), on, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return join(cut_facts, cut_keyed, [*on, "_piece"]).drop("_piece")
