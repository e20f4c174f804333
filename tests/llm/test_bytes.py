"""Repeated byte strings and fingerprints, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from studyweave.llm import anchors, bwt, simhash, substrings
from studyweave.llm.rows import spans_merged

LENGTH = 100


def brute_spans(texts, length=LENGTH):
    """By text the bytes that a string covers which starts earlier."""
    seen, out = set(), []
    for text in texts:
        mask = np.zeros(len(text), bool)
        for k in range(len(text) - length + 1):
            piece = text[k : k + length]
            if piece in seen:
                mask[k : k + length] = True
            seen.add(piece)
        out.append(mask)
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, some=b"abcdefgh \n": bytes(rng.choice(some) for _ in range(n))
    passage, line = text(150), text(100)
    out = [text(rng.randint(0, 400)) for _ in range(12)]
    for k in range(40):
        head, tail = text(rng.randint(0, 130)), text(rng.randint(0, 130))
        out.append(head + rng.choice([passage, line, passage[:120], line[1:], passage + line]) + tail)
    near = text(600)
    for _ in range(15):
        copy = bytearray(near)
        copy[rng.randrange(600)] = 33
        out.append(bytes(copy))
    out += [near, near, b"", b"x" * 500, b"x" * 99, b"x" * 100, b"ab" * 200, b"du " * 150, "é".encode() * 120, text(3000, b"ab")]
    rng.shuffle(out)
    return out


def in_process(texts, length=LENGTH):
    """The steps of the operator without Spark: its shuffles are sorts here."""

    def dealt(batches, schema, by):
        table = pa.Table.from_batches([b for b in batches if b.num_rows], schema) if batches else pa.table([[]] * len(schema), schema=schema)
        table = table.sort_by([(c, "ascending") for c in by])
        return table.to_batches(max_chunksize=97)

    spans = []

    def split(batches, mark):
        rest = []
        for b in batches:
            for row in b.to_pylist():
                spans.append((row["key"], row["start"], row["end"])) if mark(row) else rest.append(row)
        return rest

    first = [pa.RecordBatch.from_pydict({"k": pa.array(range(a, min(a + 7, len(texts))), pa.int64()), "t": pa.array(texts[a : a + 7], pa.binary())}) for a in range(0, len(texts), 7)]
    rows = list(substrings._stretches(length, first))
    found = split(substrings._compared(dealt(rows, substrings._ROW, ["deal", "stretch", "key", "start"])), lambda r: r["at"] < 0)
    by_key = {}
    for row in found:
        by_key.setdefault(row["key"], []).append({n: row[n] for n in ("at", "start", "end")})
    kind = pa.list_(pa.struct([("at", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    asked = pa.RecordBatch.from_pydict({"key": pa.array(by_key, pa.int64()), "text": pa.array([texts[k] for k in by_key], pa.binary()), "cores": pa.array(list(by_key.values()), kind)})
    blocks = [b for b in substrings._blocks(length, [asked])]
    runs = split(substrings._searched(length, dealt(blocks, substrings._BLOCK, ["core", "same", "key", "start"])), lambda r: r["run"] is None)
    low = {}
    for row in runs:
        low[row["run"]] = min(low.get(row["run"], (1 << 60, 0)), (row["key"], row["start"]))
    spans += [(r["key"], r["start"], r["end"]) for r in runs if (r["key"], r["start"]) > low[r["run"]]]
    out = [np.zeros(len(t), bool) for t in texts]
    for key, start, end in spans:
        out[key][start:end] = True
    return out


@pytest.mark.parametrize(("seed", "most", "held", "slab"), [(1, 100_000, 200_000, 1 << 18), (2, 3, 200_000, 1 << 18), (3, 100_000, 4, 1 << 18), (4, 2, 3, 700), (5, 100_000, 200_000, 256)])
def test_repeats_match_brute_force_on_every_path(monkeypatch, seed, most, held, slab):
    monkeypatch.setattr(substrings, "MOST", most)
    monkeypatch.setattr(substrings, "HELD", held)
    monkeypatch.setattr(substrings, "SEARCH", 50)
    monkeypatch.setattr(anchors, "SLAB", slab)
    texts = corpus(seed)
    for got, wanted in zip(in_process(texts), brute_spans(texts), strict=True):
        assert np.array_equal(got, wanted)


def test_repeats_on_spark_with_dirty_rows(spark):
    texts = [t for t in corpus(9) if t.decode("utf-8", "ignore").encode() == t]
    rows = [(k, t.decode(), "x") for k, t in enumerate(texts)]
    kind = "doc_id long, text string, kept string"
    out = substrings.without_repeats(spark, spark.createDataFrame(rows, kind).repartition(5))
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    for k, (text, mask) in enumerate(zip(texts, brute_spans(texts), strict=True)):
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(mask) else 0
        assert got[k] == (len(text), int(mask.sum()), spans, bytes(np.frombuffer(text, np.uint8)[~mask]))
    # a null id comes first, null texts are empty, of equal rows one stays
    dirty = [(None, "a" * 100), (4, "a" * 100), (4, "a" * 100), (5, None), (5, "")]
    dirty = substrings.without_repeats(spark, spark.createDataFrame(dirty, "doc_id int, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in dirty) == [(0, 0), (4, 100), (4, 100), (5, 0), (5, 0)]
    assert substrings.without_repeats(spark, spark.createDataFrame([], kind)).collect() == []


def test_common_strings_match_counts():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, 400)
    for length in (1, 2, 5, 9):
        places, interval = bwt.common(text, length)
        pieces = {k: tuple(text[k : k + length]) for k in range(len(text) - length + 1) if (text[k : k + length] != 0).all()}
        count = Counter(pieces.values())
        assert sorted(places) == [k for k, p in pieces.items() if count[p] > 1]
        assert len({(pieces[k], i) for k, i in zip(places.tolist(), interval.tolist(), strict=True)}) == len(set(interval.tolist()))
    assert len(bwt.common(np.zeros(0, np.int64), 3)[0]) == 0


def test_spans_merge_per_owner():
    owner, start, end = (np.array(x) for x in zip((2, 0, 5), (1, 3, 4), (1, 4, 6), (1, 8, 9), (2, 5, 6), strict=True))
    assert [x.tolist() for x in spans_merged(owner, start, end)] == [[1, 1, 2], [3, 8, 0], [6, 9, 6]]


def naive_print(text):
    words = text.lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = list(prints)
    root = {k: k for k in ids}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in ids}


def test_fingerprint_is_the_definition():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = " ".join(rng.choice(["Aé", "b", "C", "ß", "dd"]) for _ in range(n)).encode()
        assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == naive_print(text)
    assert simhash.fingerprint(b" \n\t", 3) == 0


def test_links_lose_no_pair_however_shards_are_split(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {x & (1 << 64) - 1 for x in base}
    for x in base:  # chains and clouds of near fingerprints
        for _ in range(60):
            y = x
            for _ in range(rng.randint(1, 3)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
            x = rng.choice([x, y])
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    frame = spark.createDataFrame([(x,) for x in signed], "__print long")
    for most in (4, 4096):
        edges = simhash.links(spark, frame, 2, most)
        assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 2 for r in edges.collect())
        roots = {r.node: r.root for r in simhash.components(spark, edges).collect()}
        wanted = brute_components(signed, 2)
        assert {k: roots.get(k, k) for k in signed} == wanted


def test_near_duplicates_with_dirty_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    long = [word() for _ in range(3000)]
    texts = [" ".join(long)]
    for _ in range(8):
        copy = list(long)
        copy[rng.randrange(3000)] = "other"
        texts.append(" ".join(copy))
    texts += ["", None, " ", "one", "ONE", "two words", texts[0]] + [" ".join(word() for _ in range(30)) for _ in range(20)]
    rows = [(k, t, "z") for k, t in enumerate(texts)]
    kind = "doc_id long, text string, component_id string"
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, kind)).collect()}
    prints = {k: naive_print((t or "").encode()) for k, t, _ in rows}
    wanted = brute_components(prints, 2)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", wanted[k]) for k in prints}
    dirty = simhash.near_duplicates(spark, spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, "q r s t")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in dirty if r.component_id) == [(0, 7), (7, 7), (7, 7)]
    assert len(dirty) == 4
    assert simhash.near_duplicates(spark, spark.createDataFrame([], kind)).collect() == []
