"""Helpers shared by the operators: plain columns in, Arrow batches through, stage tables out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace, ship  # noqa: F401

BLANKS = b" \t\n\r\x0b\x0c"


def utf8(column: Column | str) -> Column:
    """The text's bytes; a null text is the empty one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def quoted(name: str) -> str:
    """A column's name as it stands in an expression."""
    return "`" + name.replace("`", "``") + "`"


def others(frame: DataFrame, *names: str) -> list[Column]:
    """The columns with other names than these, in any case, as Spark's names ignore it: what an operator adds
    under a name takes its place."""
    gone = {name.lower() for name in names}
    return [F.col(quoted(c)) for c in frame.columns if c.lower() not in gone]


def free(frame: DataFrame, name: str) -> str:
    """A name like this one that no column of the frame has, in any case."""
    used = {c.lower() for c in frame.columns}
    while name.lower() in used:
        name += "_"
    return name


def added(frame: DataFrame, ddl: str) -> T.StructType:
    """The frame's schema, and the columns of a schema text."""
    return T.StructType([*frame.schema.fields, *T.StructType.fromDDL(ddl).fields])


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends there."""
    work = Workspace(spark)
    table = work.table(name, lambda: frame)
    table.stage = work
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes the files of stored frames that nothing reads any more."""
    for table in tables:
        table.stage.close()


def spans_merged(
    owner: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open spans, per owner."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    group = np.cumsum(np.concatenate([[False], owner[1:] != owner[:-1]]))
    shift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    new[1:] |= group[1:] != group[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    return owner[first], start[first], (reach - shift)[last]


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def joined(held: list[np.ndarray]) -> np.ndarray:
    return held[0] if len(held) == 1 else np.concatenate(held)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any of the keys."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Rows sorted by their first column, in lists of columns that hold whole groups: (columns, more, again).

    A group of over `most` rows comes alone and in parts; `more` says that others follow, `again` that it
    goes on. Binary columns come as object arrays.
    """
    held: list[np.ndarray] | None = None
    again = False
    for got in batches:
        if not got.num_rows:
            continue
        now = [numbers(c) for c in got.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        key = held[0]
        cut = int(np.searchsorted(key, key[-1]))
        if again:
            end = int(np.searchsorted(key, key[0], side="right"))
            more = end == len(key)
            if more and end < most:
                continue
            yield [x[:end] for x in held], more, True
            again, held, cut = more, [x[end:] for x in held], max(0, cut - end)
            if not len(held[0]):
                held = None
                continue
        if cut:
            yield [x[:cut] for x in held], False, False
            held = [x[cut:] for x in held]
        if len(held[0]) > most:
            yield held, True, False
            held, again = None, True
    if held is not None and len(held[0]):
        yield held, False, again
