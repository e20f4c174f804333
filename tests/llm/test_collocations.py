"""Phrase collocations against counts of all n-grams."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from studyweave.llm import collocations as cl
from studyweave.llm import queries
from studyweave.llm.rows import utf8

SCHEMA = "doc_id long, lang string, text string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)) if w]


def brute(rows, least=30, share=80, most=2000):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for words in words_of(text):
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[(lang, *w[i : i + k])] = max(longer[(lang, *w[i : i + k])], a)
    out = {}
    for (lang, *w), a in found.items():
        if longer[(lang, *w)] * 100 >= share * a:
            continue
        cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        l, r = min(cuts, key=lambda x: 2000000 * a // (x[0] + x[1]))  # noqa: E741
        out.setdefault(lang, []).append((-(2000000 * a // (l + r)), -a, " ".join(w).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1)}


def mined(spark, rows, **more):
    out = cl.collocations(spark, spark.createDataFrame(rows, SCHEMA), **more).collect()
    return {tuple(r) for r in out}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "a", "new york", "x-ray", "Über", "ÄRA", "日本", "b\tc", "in the end", "very very"])
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", " \x0b", "\r\n", " "]
    text = lambda k: "".join(word() + rng.choice(marks) for _ in range(k))
    passage = text(90)
    rows = [(i, rng.choice(["en", "de", None, "und"]), text(rng.randint(0, 60))) for i in range(n)]
    rows += [(1000 + i, "en", text(5) + passage + text(4)) for i in range(30)]
    rows += [(2000 + i, "en", "copy that " * 50) for i in range(40)]  # a third has one text
    return [*rows, (5, "fr", None), (6, "fr", ""), (7, "it", " .,;\n"), (8, "nl", "een twee")]


def test_as_counts_of_all(spark):
    rows = corpus(1)
    want = brute(rows)
    assert len(want) > 50
    assert mined(spark, rows) == want


@pytest.mark.parametrize(("modulus", "least", "share", "most"), [(1, 2, 60, 15), (2, 5, 80, 2000), (10**9, 3, 100, 50)])
def test_any_cut_of_chunks_gives_the_same(spark, modulus, least, share, most):
    rows = corpus(2, 60)
    assert mined(spark, rows, modulus=modulus, least=least, share=share, most=most) == brute(rows, least, share, most)


def test_small_buffers_give_the_same(spark, monkeypatch):
    rows = corpus(3, 60)
    batches = spark.createDataFrame(rows, SCHEMA).select(F.coalesce("lang", F.lit("und")), utf8("text")).toArrow().to_batches(max_chunksize=7)
    monkeypatch.setattr(cl, "HELD", 200)
    some = Counter()
    for got in cl._parsed(4, iter(batches)):
        for r in got.to_pylist():
            some[(r["lang"], r["own"], r["chunk"])] += r["n"]
    assert sum(own * n for (_, own, _), n in some.items()) == sum(len(w) for r in rows for w in words_of(r[2]))


def chunks_of(words, modulus):
    first, own, size = cl.chunks(cl.Words(b" ".join(words)), modulus, cl.Hashes())
    return [(b" ".join(words[a : a + n]), k, n) for a, k, n in zip(first.tolist(), own.tolist(), size.tolist(), strict=True)]


def test_equal_passages_are_cut_alike():
    rng = random.Random(4)
    passage = [rng.choice("abcdefgh").encode() for _ in range(200)]
    found = []
    for _ in range(3):
        words = [rng.choice("xyz").encode() for _ in range(rng.randint(5, 40))] + passage
        found.append({chunk for chunk, _, _ in chunks_of(words, 8)})
    common = set.intersection(*found)
    assert len(common) > 10
    assert all(len(chunk.split()) > 3 for chunk in common)


def test_no_chunk_begins_another_without_its_end():
    """The chunks between two triggers are prefix-free: a trigger ends a chunk and stands nowhere else inside it."""
    rng = random.Random(5)
    words = [rng.choice("abcd").encode() for _ in range(5000)]
    found = sorted({chunk + b" " for chunk, own, size in chunks_of(words, 8) if own < size})
    assert not any(b.startswith(a) for a, b in zip(found, found[1:], strict=False))


def test_words_and_pieces():
    words = cl.Words("  a b\tc. D,e\n\n\x0b f  g ".encode().translate(cl.TABLE))
    assert [words.distinct[k].as_py() for k in words.codes.tolist()] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert np.unique(words.piece, return_counts=True)[1].tolist() == [3, 1, 1, 2]
    assert cl.Words(b"").n == cl.Words(b" \n ").n == 0


def test_bitmap_holds_all_frequent_phrases(spark):
    phrases = [("en", f"w{k} é w{k + 1}") for k in range(2000)]
    table = spark.createDataFrame(phrases, "lang string, phrase string")
    may = cl.bitmap(table, 3)

    def hashes(some):
        h = lambda x: np.array([xxhash.xxh64_intdigest(x.encode(), 42)], np.uint64)
        turned = [[cl._turned(h(w), cl._TURN * k) for k, w in enumerate(p.split())] for p in some]
        return np.concatenate([h("en") ^ a ^ b ^ c for a, b, c in turned])

    assert may.may(hashes(p for _, p in phrases)).all()
    assert may.may(hashes(f"v{k} w x" for k in range(2000))).mean() < 0.01
    assert int(np.unpackbits(may.bits).sum()) <= 2000


def test_products_past_64_bits(spark):
    big = 10**18
    candidates = spark.createDataFrame([("en", "a b c", big - 3)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("en", "a", big), ("en", "b c", big - 1), ("en", "a b", big - 2), ("en", "c", big)], "lang string, phrase string, f long")
    row = cl.scored(candidates, parts).first()
    scores = [2000000 * (big - 3) // (big + big - 1), 2000000 * (big - 3) // (big - 2 + big)]
    assert row.score == min(scores) and (row.l, row.r) == (big, big - 1)


def test_empty_tables_and_other_columns(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, "en", None)]) == set()
    rows = corpus(6, 40)
    given = spark.createDataFrame(rows, SCHEMA).select(F.col("lang").alias("Tongue"), F.col("text").alias("body"), F.lit("x").alias("phrase"), F.lit(1).alias("n"), F.lit(2).alias("Lang"))
    assert {tuple(r) for r in cl.collocations(spark, given, "Tongue", "body").collect()} == brute(rows)


def test_query_and_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = {tuple(r) for r in queries.op13_parsed_collocations(spark, folder).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").collect()]
    assert found and found == brute(rows)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        assert set(db.sql(queries.ORACLE_SQL["op13_parsed_collocations"]).fetchall()) == found
