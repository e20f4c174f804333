"""Trees of a random forest, grown in one task over rows that it can hold.

The rules are those of Spark's classifier: a number has 32 bins at most, a tree draws its rows with replacement (Poisson,
mean 1), a node draws its features, the split that lowers Gini's impurity most is taken among those that leave `min_n` drawn
rows on both sides, and sister leaves that predict the same class become one. A tree's vote is the share of the event in the leaf.

What a node draws follows from the tree's seed and the splits above it. So trees that differ in `min_n` only are the same
down to the first node where their splits differ, and up to there they are grown once for all. A tree that is grown with others is the one
that is grown alone.

Counts are sums of doubles that hold two whole numbers each: drawn rows, and events times `EVENT`. They are exact.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

BINS = 32
EVENT = float(1 << 26)
#: Rows of the trees grown together: few enough to stay in a core's cache, enough that calls don't count.
TOGETHER = 100_000
_SIDE, _SPLIT, _DRAW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> list[float]:
    """Where a number is cut into bins, given its distinct values in order: between all of them, or else evenly by rows."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle.tolist()
    below = np.cumsum(counts)
    nearer, stride, found, at = (below[:-1] + below[1:]) / 2, below[-1] / bins, [], 0
    for k in range(1, bins):
        at = max(at, int(np.searchsorted(nearer, k * stride, "right")))
        if at >= len(middle):
            break
        found.append(float(middle[at]))
        at += 1
    return found


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Rows by features, as bins: a value that equals a threshold is below it."""
    return np.stack([np.searchsorted(cut, values[:, k], "left") for k, cut in enumerate(cuts)], 1).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn_features(marks: np.ndarray, n_features: int, mtry: int) -> np.ndarray:
    """mtry different features for each node, one column a node (Floyd's draw)."""
    drawn, steps = np.empty((mtry, len(marks)), np.int64), _DRAW * np.arange(1, mtry + 1, dtype=np.uint64)
    for k, last in enumerate(range(n_features - mtry, n_features)):
        one = (_mixed(marks + steps[k]) % np.uint64(last + 1)).astype(np.int64)
        drawn[k] = np.where((drawn[:k] == one).any(0), last, one)
    return drawn


def _parts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drawn rows, and events among them."""
    events = np.floor(packed * (1 / EVENT))
    return packed - events * EVENT, events


def _before(counts: np.ndarray) -> np.ndarray:
    """The sum of all that stand before."""
    return np.cumsum(counts) - counts


def votes(
    rows: np.ndarray,
    label: np.ndarray,
    asked: np.ndarray,
    n_bins: np.ndarray,
    seeds: Iterable[tuple[int, int]],
    mtry: int,
    min_ns: list[int],
    max_depth: int = 30,
) -> np.ndarray:
    """The summed votes of a tree per seed for each of the rows asked, one line per `min_n`; these rise."""
    seeds, size = list(seeds), max(1, TOGETHER // max(1, len(rows)))
    out = np.zeros((len(min_ns), len(asked)))
    for k in range(0, len(seeds), size):
        some = seeds[k : k + size]
        drawn = [np.random.default_rng(seed).poisson(1.0, len(rows)) for seed in some]
        shares, links, _, leaf = _grown(rows, label, drawn, asked, n_bins, some, mtry, min_ns, max_depth)
        out += _answers(shares, links, leaf, len(asked))
    return out


def forest(
    rows: np.ndarray,
    label: np.ndarray,
    times: np.ndarray,
    cuts: list[list[float]],
    seeds: list[tuple[int, int]],
    mtry: int,
    min_n: int,
    max_depth: int = 30,
) -> dict[str, np.ndarray]:
    """The nodes of a tree per seed, all over the rows drawn so many times. The roots come first; `left` is the place of the node below for
    values up to the threshold, the other one is next to it. A leaf has no feature (-1)."""
    nodes, size, n_bins = [], max(1, TOGETHER // max(1, len(rows))), np.array([len(cut) + 1 for cut in cuts])
    for k in range(0, len(seeds), size):
        some = seeds[k : k + size]
        shares, links, codes, _ = _grown(rows, label, [times] * len(some), rows[:0], n_bins, some, mtry, [min_n], max_depth)
        nodes.append(_pruned(shares, links, codes, cuts, k))
    # the roots of all, then what is below
    roots, begin = sum(x["root"].sum() for x in nodes), 0
    for x in nodes:
        inner = x["feature"] >= 0
        x["left"][inner] += roots - x["root"].sum() + begin
        begin += (~x["root"]).sum()
    order = np.argsort(np.concatenate([~x["root"] for x in nodes]), kind="stable")
    return {name: np.concatenate([x[name] for x in nodes])[order] for name in ("tree", "feature", "threshold", "left", "share")}


def _pruned(shares, links, codes, cuts, first_tree):
    share, link, code = np.concatenate(shares), np.concatenate(links, 1)[0], np.concatenate(codes, 1)[0]
    inner = _by_level(links, 0)
    same = _agreed(share, link, inner)
    link = np.where(same >= 0, -1, link)
    tree = np.full(len(share), -1)
    tree[: len(shares[0])] = first_tree + np.arange(len(shares[0]))
    for nodes in inner:
        nodes = nodes[(tree[nodes] >= 0) & (link[nodes] >= 0)]
        tree[link[nodes]] = tree[link[nodes] + 1] = tree[nodes]
    there = np.flatnonzero(tree >= 0)
    place, goes = np.cumsum(tree >= 0) - 1, link[there] >= 0
    feature = np.where(goes, code[there] // 256, -1)
    threshold = np.zeros(len(there))
    threshold[goes] = [cuts[f][c] for f, c in zip(feature[goes], code[there][goes] % 256)]
    left = np.where(goes, place[link[there]], -1)
    return {"root": there < len(shares[0]), "tree": tree[there], "feature": feature, "threshold": threshold, "left": left, "share": share[there]}


def answers(nodes: dict[str, np.ndarray], n_trees: int, values: np.ndarray) -> np.ndarray:
    """The summed votes of the trees for rows of values."""
    flat, n = np.ascontiguousarray(values).ravel(), len(values)
    at, node = np.tile(np.arange(n) * values.shape[1], n_trees), np.repeat(np.arange(n_trees), n)
    going = np.flatnonzero(nodes["feature"][node] >= 0)
    while len(going):
        own = node[going]
        node[going] = own = nodes["left"][own] + (flat[at[going] + nodes["feature"][own]] > nodes["threshold"][own])
        going = going[nodes["feature"][own] >= 0]
    return nodes["share"][node].reshape(n_trees, n).sum(0)


def _grown(rows, label, drawn, asked, n_bins, seeds, mtry, min_ns, max_depth):
    (_, n_features), n_asked, n_points = rows.shape, len(asked), len(min_ns)
    mtry = min(mtry, n_features)
    flat, flat_asked, bits = rows.ravel(), asked.ravel(), 1 << np.arange(n_points)[:, None]
    # the drawn rows of all trees: where their bins begin, what they count for, the node that they are in
    chosen = [np.flatnonzero(times) for times in drawn]
    weight = np.concatenate([times[some] * (1 + EVENT * label[some]) for times, some in zip(drawn, chosen)])
    node = np.repeat(np.arange(len(seeds)), [len(some) for some in chosen])
    at = np.concatenate(chosen) * n_features
    # the rows asked, for each tree: as above, and the place of the answer
    place = np.arange(len(seeds) * n_asked)
    asked_at, asked_node = place % n_asked * n_features, place // n_asked
    leaf = np.zeros((n_points, len(place)), np.int64)

    # the nodes of a level: counts, points, and what their draws follow from
    totals, points = np.bincount(node, weight, len(seeds)), np.full(len(seeds), bits.sum())
    marks = _mixed(np.array(seeds, np.uint64) @ np.array([_SIDE, _SPLIT]))
    live = _open(totals, points, bits, min_ns)
    node, at, weight = _kept(live.any(0), node, at, weight)
    shares, links, codes = [], [], []  # of all levels
    begin = 0
    for depth in range(max_depth + 1):
        n, events = _parts(totals)
        shares.append(np.divide(events, n, out=np.zeros(len(n)), where=n > 0))
        going = np.flatnonzero(live.any(0)) if depth < max_depth else np.empty(0, np.int64)
        code, left = _best_splits(flat, n_features, n_bins, at, weight, node, totals[going], live[:, going], marks[going], mtry, min_ns)
        # points that split alike go on as one group, under its first point
        head = np.array([(code[: p + 1] == code[p]).argmax(0) for p in range(n_points)])
        heads = (code >= 0) & (head == np.arange(n_points)[:, None])
        of, leader = np.nonzero(heads.T)
        number = np.cumsum(heads.T).reshape(heads.T.shape).T - 1  # of the group under each head
        link = np.full((n_points, len(n)), -1)
        link[:, going] = np.where(code >= 0, begin + len(n) + 2 * np.take_along_axis(number, head, 0), -1)
        links.append(link)
        codes.append(np.full(link.shape, -1))
        codes[-1][:, going] = code
        stopped = ((points & bits) > 0) & (link < 0)
        come = np.flatnonzero(stopped.any(0)[asked_node])
        for p in range(n_points):
            own = come[stopped[p][asked_node[come]]]
            leaf[p, place[own]] = begin + asked_node[own]
        if not len(of):
            break
        split, parent = code[leader, of], going[of]
        n_groups, first = heads.sum(0), np.cumsum(heads.sum(0)) - heads.sum(0)
        member = np.array([(np.where((head == p) & (code >= 0), bits, 0)).sum(0) for p in range(n_points)])
        below = left[leader, of]
        totals = np.stack([below, totals[parent] - below], 1).ravel()
        points = np.repeat(member[leader, of], 2)
        mark = marks[parent] + split.astype(np.uint64) * _SPLIT
        marks = _mixed(np.stack([mark + _SIDE, mark - _SIDE], 1).ravel())
        live = _open(totals, points, bits, min_ns)
        all_groups, all_first = np.zeros((2, len(n)), np.int64)
        all_groups[going], all_first[going] = n_groups, first
        everywhere = np.ones(len(totals), bool)
        asked_node, asked_at, place = _descend(flat_asked, asked_node, asked_at, place, all_groups, all_first, split, everywhere)
        node, at, weight = _descend(flat, node, at, weight, n_groups, first, split, live.any(0))
        begin += len(n)
    return shares, links, codes, leaf


def _open(totals, points, bits, min_ns):
    """The points, by node, that may split there: events and others, and rows for both sides."""
    n, events = _parts(totals)
    return ((points & bits) > 0) & (events > 0) & (events < n) & (n >= 2 * np.array(min_ns)[:, None])


def _kept(wanted, node, *of_rows):
    """The rows in wanted nodes, which are numbered anew."""
    number = np.where(wanted, np.cumsum(wanted) - 1, -1)[node]
    rows = np.flatnonzero(number >= 0)
    return number[rows], *(x[rows] for x in of_rows)


def _descend(flat, node, at, other, n_groups, first, split, wanted):
    """The rows in the nodes below; if a node goes on as several groups, its rows go with each."""
    feature, cut, found = split // 256, (split % 256).astype(np.uint8), []
    for k in range(n_groups.max()):
        rows = np.flatnonzero(n_groups[node] > k)
        own_at, group = at[rows], first[node[rows]] + k
        under = 2 * group + (flat[own_at + feature[group]] > cut[group])
        found.append(_kept(wanted, under, own_at, other[rows]))
    return found[0] if len(found) == 1 else [np.concatenate(x) for x in zip(*found)]


def _best_splits(flat, n_features, n_bins, at, weight, node, totals, live, marks, mtry, min_ns):
    """By point and node: the best split as 256 times the feature, plus its last bin below, or -1; and the counts below."""
    shape = (len(min_ns), len(totals))
    best, code, below = np.full(shape, np.inf), np.full(shape, -1), np.zeros(shape)
    n, events = _parts(totals)
    if not len(totals):
        return code, below
    for feature in _drawn_features(marks, n_features, mtry):
        width = n_bins[feature]
        start = _before(width)
        counts = np.bincount(start[node] + flat[at + feature[node]], weight, start[-1] + width[-1])
        sums = np.cumsum(counts)
        sums -= np.repeat(sums[start] - counts[start], width)
        under, hit = _parts(sums)
        over, missed = np.repeat(n, width) - under, np.repeat(events, width) - hit
        smaller = np.minimum(under, over)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = hit * (under - hit) / under + missed * (over - missed) / over
        nodes = np.arange(len(totals))
        least, cell, seen = np.full(len(totals), np.inf), start.copy(), np.zeros(len(totals), bool)
        for p, min_n in enumerate(min_ns):
            # what was best with fewer rows on each side still is if it has enough
            again = nodes[live[p] & ((smaller[cell] < min_n) | ~seen)]
            seen |= live[p]
            if len(again):
                wide = width[again]
                begins = _before(wide)
                cells = np.arange(wide.sum()) if len(again) == len(nodes) else np.arange(wide.sum()) + np.repeat(start[again] - begins, wide)
                fit = np.where(smaller[cells] >= min_n, impurity[cells], np.inf)
                least[again] = np.minimum.reduceat(fit, begins)
                hits = np.flatnonzero(fit == np.repeat(least[again], wide))[::-1]
                cell[np.repeat(again, wide)[hits]] = cells[hits]  # the first of equals
            better = live[p] & (least < best[p])
            best[p][better] = least[better]
            code[p][better] = 256 * feature[better] + (cell - start)[better]
            below[p][better] = sums[cell[better]]
    code[best >= events * (n - events) / n * (1 - 1e-12)] = -1
    return code, below


def _by_level(links, point):
    """The places of the nodes that split, level by level."""
    begins = np.cumsum([0, *(link.shape[1] for link in links)])
    return [begin + np.flatnonzero(link[point] >= 0) for begin, link in zip(begins, links)]


def _agreed(share, link, inner):
    """What all leaves below a node predict, or -1."""
    same = (share > 0.5).astype(np.int8)
    for nodes in reversed(inner):
        same[nodes] = np.where(same[link[nodes]] == same[link[nodes] + 1], same[link[nodes]], -1)
    return same


def _answers(shares, links, leaf, n_asked):
    """The summed votes, after sister leaves that predict the same are one."""
    share, out = np.concatenate(shares), []
    for p, link in enumerate(np.concatenate(links, 1)):
        inner = _by_level(links, p)
        same, vote, one = _agreed(share, link, inner), share.copy(), np.zeros(len(share), bool)
        for nodes in inner:
            closed = nodes[one[nodes] | (same[nodes] >= 0)]
            for side in (link[closed], link[closed] + 1):
                one[side], vote[side] = True, vote[closed]
        out.append(vote[leaf[p]].reshape(len(shares[0]), n_asked).sum(0))
    return np.array(out)
