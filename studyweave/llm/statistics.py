"""Counts over the lines and words of texts, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .rows import BLANKS, changes

#: Bytes of texts that are counted together.
SLAB = 1 << 21
SYMBOLS = b"#*$%&|<>"
RUN = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(7).integers(1, 1 << 62, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _class(some: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(some)] = True
    return table


_CLASSES = {
    "blank": _class(BLANKS),
    "symbols": _class(SYMBOLS),
    "bangs": _class(b"!"),
    "upper": _class(bytes(range(65, 91))),
    "lower": _class(bytes(range(97, 123))),
    "digits": _class(b"0123456789"),
    "inner": _class(bytes(range(0x80, 0xC0))),  # bytes of a character after its first
    "lead": _class(bytes(range(0xC0, 0x100))),
}


def slabs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of whole texts of about `SLAB` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLAB:
            yield held
            held, size = [], 0
    if held:
        yield held


def count(texts: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Counts by line and by text.

    Words are runs without blanks. By line: `text`, the classes of bytes above, `chars` (characters in words),
    `words`, `short` (words of up to 3 bytes), `single` (words of one symbol), `again` (words equal to the one
    before in the line), `run_words` (words in runs of `RUN` that the text has more than once), `dup` (equal to
    an earlier line, with a word), `open` (has words, the last without a mark at its end). By text: the sums,
    `lines` (with a word) and `distinct` words.
    """
    data = b"\n".join([*texts, b""])
    codes = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(codes == 10) + 1
    first = np.concatenate([[0], ends[:-1]])
    text_ends = np.cumsum([len(x) + 1 for x in texts])
    line: dict[str, np.ndarray] = {"text": np.searchsorted(text_ends, first, side="right")}
    for name, table in _CLASSES.items():
        line[name] = np.add.reduceat(table[codes], first, dtype=np.int64)
    blank = _CLASSES["blank"][codes]
    line["chars"] = ends - first - line["blank"] - line["inner"]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    words = data.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.searchsorted(ends, start, side="right")
    owner = line["text"][at]
    total = lambda some: np.bincount(at[some], minlength=len(ends))
    line["words"] = np.bincount(at, minlength=len(ends))
    line["short"] = total(size <= 3)
    line["single"] = total((size == 1) & _CLASSES["symbols"][codes[start]])
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    line["again"] = total(again)
    line["run_words"] = total(_in_runs(hashes, owner))
    spoken = np.flatnonzero(line["words"])
    line["open"] = np.zeros(len(ends), np.int64)
    if len(words):
        last = np.concatenate([at[1:] != at[:-1], [True]])
        line["open"][at[last]] = ~_class(b".!?:;,")[codes[start[last] + size[last] - 1]]
    line["dup"] = np.zeros(len(ends), np.int64)
    if len(spoken):
        held = np.fromiter((hash(data[a : b - 1]) for a, b in zip(first[spoken].tolist(), ends[spoken].tolist(), strict=True)), np.int64, len(spoken))
        order = np.lexsort((held, line["text"][spoken]))
        line["dup"][spoken[order[~changes(line["text"][spoken][order], held[order])]]] = 1
    by_text = np.searchsorted(line["text"], np.arange(len(texts)))
    sums = {name: np.add.reduceat(values, by_text) for name, values in line.items() if name != "text"}
    sums["lines"] = np.add.reduceat((line["words"] > 0).astype(np.int64), by_text)
    order = np.lexsort((hashes, owner))
    new = changes(owner[order], hashes[order])
    sums["distinct"] = np.bincount(owner[order][new], minlength=len(texts))
    return line, sums


def _in_runs(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a word is in a run of `RUN` words that its text has more than once."""
    n = len(hashes) - RUN + 1
    marked = np.zeros(len(hashes), bool)
    if n <= 0:
        return marked
    key = owner[:n].astype(np.uint64) * _ODD
    for k, place in enumerate(_PLACES):
        key = key + hashes[k : k + n] * place
    whole = np.flatnonzero(owner[:n] == owner[RUN - 1 :])
    key = key[whole] ^ (key[whole] >> np.uint64(31))
    order = np.argsort(key, kind="stable")
    new = changes(key[order])
    twice = ~new
    twice[:-1] |= ~new[1:]
    steps = np.zeros(len(hashes) + 1, np.int64)
    runs = whole[order[twice]]
    np.add.at(steps, runs, 1)
    np.add.at(steps, runs + RUN, -1)
    return np.cumsum(steps[:-1]) > 0
