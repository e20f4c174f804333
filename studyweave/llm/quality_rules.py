"""Keeps documents by the share of content among their lines.

A linear-chain conditional random field labels each line as content or boilerplate from its counts (see
`statistics`). Viterbi decoding gives the likeliest labels of a whole document; it is kept if at least
`share` of the characters in its words lie in content lines. Documents with under 20 words, or over 30 % of
their words in repeated runs, fail before.

The field is fitted to at most `sample` labelled documents, those with the smallest hash of the id, with all their
lines: the lines of a good document count as content, those of a bad one as boilerplate. Each is also joined to one
of the other kind, so that the field learns how labels change within a text. Without good and bad labels all
lines are content.

Null and empty texts have no words and fail. Documents are judged row by row: null or repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics
from .rows import added, free, others, stored, utf8
from .toxicity import sampled

_KINDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def features(line: dict[str, np.ndarray]) -> np.ndarray:
    """One row of numbers from 0 to 1 per line."""
    chars, words = np.maximum(line["chars"], 1), np.maximum(line["words"], 1)
    columns = [
        np.ones(len(chars)),
        np.minimum(1, 4 * line["symbols"] / chars),
        np.minimum(1, 4 * line["bangs"] / chars),
        line["upper"] / np.maximum(line["upper"] + line["lower"], 1),
        line["again"] / words,
        line["run_words"] / words,
        line["single"] / words,
        line["dup"],
        line["digits"] / chars,
        line["open"],
        line["short"] / words,
        line["words"] < 4,
    ]
    return np.stack(columns, 1).astype(np.float64)


@dataclass
class Field:
    """Weights of the lines' features for (boilerplate, content), and of neighbouring labels."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, rows: np.ndarray) -> list[bool]:
        """The likeliest labels of a chain of lines (Viterbi); ties go to content."""
        emitted = (rows @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.steps.tolist()
        b, c = emitted[0]
        back = []
        for eb, ec in emitted[1:]:
            from_b, from_c = c + cb < b + bb, c + cc < b + bc  # whether the line before is boilerplate
            b, c = eb + (b + bb if from_b else c + cb), ec + (b + bc if from_c else c + cc)
            back.append((from_b, from_c))
        label = c >= b
        labels = [label]
        for from_b, from_c in reversed(back):
            label = not (from_c if label else from_b)
            labels.append(label)
        return labels[::-1]


def _products(steps: np.ndarray, longest: int) -> np.ndarray:
    """Of 2 x 2 matrices in a row, the product of each with the up to `longest` - 1 ones before it: spans double from
    step to step. Products are kept up to a factor, so that none runs out of range."""
    out, reach = steps / steps.max((1, 2), keepdims=True), 1
    while reach < longest:
        more = np.einsum("nij,njk->nik", out[:-reach], out[reach:])
        out = np.concatenate([out[:reach], more / more.max((1, 2), keepdims=True)])
        reach *= 2
    return out


def marginals(emitted: np.ndarray, steps: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The chance of each label of each line, and of each pair of labels of a line and the one after it, for chains that follow one another.

    emitted: of each line for both labels; first: whether a line begins a chain. At a border the matrix has equal rows
    (or columns, backwards), so a product knows nothing of what lies beyond.
    """
    n = len(emitted)
    lines, moves = np.exp(emitted - emitted.max(1, keepdims=True)), np.exp(steps - steps.max())
    into = np.where(first[:, None, None], 1.0, moves) * lines[:, None, :]
    ahead = _products(into, longest)[:, 0, :]
    # towards the end: matrix t leads from the label of line t to what follows
    last = np.concatenate([first[1:], [True]])
    after = np.concatenate([lines[1:], np.ones((1, 2))])
    out = np.where(last[:, None, None], 1.0, moves * after[:, None, :])
    behind = _products(np.swapaxes(out[::-1], 1, 2), longest)[::-1][:, 0, :]
    single = ahead * behind
    pair = ahead[:-1, :, None] * moves * (lines * behind)[1:, None, :]
    pair = np.where(first[1:, None, None], 0.0, pair)
    total = pair.sum((1, 2), keepdims=True)
    return single / single.sum(1, keepdims=True), np.divide(pair, total, out=np.zeros((n - 1, 2, 2)), where=total > 0)


def train(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, ridge: float = 1e-3) -> Field:
    """The field under which the labels of the chains (rows, labels) are likeliest: forward and backward sums, ascent
    by Adam. Good, bad and mixed chains weigh the same in sum, and so do long and short ones of a kind."""
    size = chains[0][0].shape[1]
    kinds = [labels[0] if (labels == labels[0]).all() else 2 for _, labels in chains]
    if len(set(kinds)) < 2:
        return Field(np.zeros((size, 2)), np.zeros((2, 2)))
    lengths = np.array([len(rows) for rows, _ in chains])
    data, label = np.concatenate([rows for rows, _ in chains]), np.concatenate([labels for _, labels in chains])
    first = np.zeros(len(data), bool)
    first[np.cumsum(lengths) - lengths] = True
    of_kind = np.bincount(kinds, minlength=3)[kinds]
    share = np.repeat(1 / lengths / of_kind / len(set(kinds)), lengths)
    both = np.where(first[1:], 0.0, share[1:])[:, None, None]
    wanted = np.eye(2)[label]
    moved = ((wanted[:-1, :, None] * wanted[1:, None, :]) * both).sum(0)
    at, mean, spread = np.zeros(size * 2 + 4), np.zeros(size * 2 + 4), np.zeros(size * 2 + 4)
    for k in range(1, rounds + 1):
        weights, steps = at[: size * 2].reshape(size, 2), at[size * 2 :].reshape(2, 2)
        chance, pair = marginals(data @ weights, steps, first, int(lengths.max()))
        slope = data.T @ ((wanted - chance) * share[:, None])
        slope = np.concatenate([slope.ravel(), (moved - (pair * both).sum(0)).ravel()]) - ridge * at
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        at = at + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-9)
    return Field(at[: size * 2].reshape(size, 2), at[size * 2 :].reshape(2, 2))


def mixed(chains: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chains with a label for each line, and good and bad ones joined to pairs, either first in turn."""
    out = [(rows, np.full(len(rows), label)) for rows, label in chains]
    kinds = [[chain for chain, (_, label) in zip(out, chains, strict=True) if label == k] for k in (0, 1)]
    for k, pair in enumerate(zip(*kinds, strict=False)):
        pair = pair if k % 2 else pair[::-1]
        out.append(tuple(np.concatenate(x) for x in zip(*pair, strict=True)))
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text, label: the features of all lines of each text."""
    for got in batches:
        out = [features(statistics.count([text])[0]).astype(np.float32).tobytes() for text in got.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"rows": pa.array(out, pa.binary()), "label": got.column(1).cast(pa.int32())})


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from the labelled rows that `learn` (a condition on `id`) picks."""
    rows = sampled(documents, labels, "quality", F.lit(True) if learn is None else learn, sample, id_col, text_col)
    rows = stored(documents.sparkSession, rows, "sample").mapInArrow(_chains, "rows binary, label int")
    size = features(statistics.count([b""])[0]).shape[1]
    found = rows.orderBy("rows", "label").collect()  # at most `sample`; in an order of their own, as pairs depend on it
    chains = [(np.frombuffer(r.rows, np.float32).reshape(-1, size).astype(float), r.label) for r in found]
    return train(mixed(chains)) if chains else Field(np.zeros((size, 2)), np.zeros((2, 2)))


def _judged(field: Field, share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes the columns of `_KINDS`."""
    names = [k.split()[0] for k in _KINDS.split(", ")]
    for got in batches:
        found: list[list[np.ndarray]] = []
        for texts in statistics.slabs(got.column(got.num_columns - 1).to_pylist()):
            line, total = statistics.count(texts)
            rows = features(line)
            edges = np.searchsorted(line["text"], np.arange(len(texts) + 1)).tolist()
            content = np.concatenate([field.decode(rows[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
            good = np.add.reduceat(line["chars"] * content, edges[:-1]) / np.maximum(total["chars"], 1)
            words, again = total["words"], total["run_words"]
            failed = (words < 20) | (100 * again > 30 * words)
            found.append([words, total["chars"], total["symbols"], total["dup"], again, good, failed, ~failed & (good >= share)])
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * len(names)
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.bool_()] * 2
        arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*got.columns[:-1], *arrays], names=[*got.schema.names[:-1], *names])


def judge(documents: DataFrame, field: Field, share: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of `documents`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    content_share, base_failed and kept; columns of those names, in any case, are replaced."""
    own = [k.split()[0] for k in _KINDS.split(", ")]
    kept = documents.select(*others(documents, *own))
    given = documents.select(*others(documents, *own), utf8(text_col).alias(free(documents, "__text")))
    return given.mapInArrow(partial(_judged, field, share), added(kept, _KINDS))
