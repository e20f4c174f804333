"""Common prefixes of many short strings by breadth-first backward extension on their transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text, sorted by the `depth` symbols that follow (ties by any order)."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    reach = 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - reach)] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        reach *= 2
        if reach >= depth:
            return order
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))


def common(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `length` symbols occur more than once, and the interval that each lies in.

    Symbol 0 ends a string and is never part of a match. Level by level, an interval of suffixes with a
    common prefix of n symbols is extended backward by each symbol of the transform that precedes it;
    what meets in one interval again shares n + 1. Borders between intervals of level n have a common
    prefix of n, found by increasing value. Intervals of one suffix are not followed, and no interval is
    followed beyond `length`.
    """
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(text, length)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = text[order - 1]  # the transform
    before[place[0]] = 0

    def kept(ranks: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(ranks)]]))
        low = np.repeat(ranks[first], size)
        many = np.repeat(size > 1, size)
        return ranks[many], low[many]

    head = text[order]
    ranks = np.flatnonzero(head != 0)
    ranks, low = kept(ranks, np.concatenate([[True], head[ranks][1:] != head[ranks][:-1]])) if len(ranks) else (ranks, ranks)
    interval = np.zeros(len(order), np.int64)
    for _ in range(length - 1):
        if not len(ranks):
            break
        interval[ranks] = low
        ranks = ranks[before[ranks] != 0]
        up = np.sort(place[order[ranks] - 1])
        if not len(up):
            ranks = low = up
            break
        down = place[order[up] + 1]
        lead, under = text[order[up]], interval[down]
        ranks, low = kept(up, np.concatenate([[True], (lead[1:] != lead[:-1]) | (under[1:] != under[:-1])]))
    return order[ranks], low
