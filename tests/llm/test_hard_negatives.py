"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyweave.llm import hard_negatives as hn
from studyweave.llm import queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    one = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * float(x)) for x in vector])
        one[i] = min(one.get(i, row), row)
    out = set()
    for a in one:
        if a % every:
            continue
        scores = {b: sum(x * y for x, y in zip(one[a][1], one[b][1], strict=False)) for b in one if b != a}
        order = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in order if one[b][0] == one[a][0]][:positives]:
            fits = [b for b in order if one[b][0] != one[a][0] and low * scores[p] <= 100 * scores[b] <= high * scores[p]]
            out |= {(a, p, k, b, scores[p], scores[b]) for k, b in enumerate(fits[:negatives], 1)}
    return out


def mined(spark, rows, every=10, schema=SCHEMA, **more):
    out = hn.mine(spark, spark.createDataFrame(rows, schema), F.col("id") % every == 0, **more).collect()
    found = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out}
    assert len(found) == len(out)
    return found


def table(seed, n=400, dims=20, labels=4, coarse=False):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(6)] + rng.normal(size=dims) * 0.4
        v = v / np.linalg.norm(v)
        rows.append((i, int(rng.integers(labels)), [float(np.float32(np.round(x, 1) if coarse else x)) for x in v]))
    return rows


@pytest.mark.parametrize(("seed", "coarse"), [(1, False), (2, True)])
def test_as_brute_force(spark, seed, coarse):
    rows = table(seed, coarse=coarse)
    want = brute(rows, 10)
    assert len(want) > 300
    assert mined(spark, rows) == want
    assert mined(spark, rows, block=60, group=7) == want


def test_copies_ties_nulls_and_short_vectors(spark):
    rng = random.Random(3)
    rows = table(4, n=150)
    same = rows[7][2]
    rows += [(1000 + k, k % 4, same) for k in range(120)]  # a third of all rows has one vector
    rows += [(2000, None, same), (2001, 1, None), (2002, 1, [None, *same[1:]]), (2003, 1, [math.nan, *same[1:]]), (2004, 1, [-math.inf, *same[1:]]), (None, 1, same)]
    rows += [(3000 + k, k % 4, same[: rng.randint(0, 19)]) for k in range(20)]
    rows += rows[:30]  # repeated rows
    rows += [(10, 3, rows[0][2]), (11, 0, rows[0][2])]  # one id, other content
    rng.shuffle(rows)
    assert mined(spark, rows, block=64, group=16) == brute(rows, 10)


def test_few_rows_negative_scores_and_empty_tables(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-1.0, 0.1]), (10, 3, [0.0, 1.0]), (11, 3, [0.0, 0.0]), (12, 4, [0.0, 0.0]), (20, 9, [1.0, 1.0])]
    assert mined(spark, rows) == brute(rows, 10)
    assert mined(spark, []) == set()
    assert mined(spark, [(3, 1, [1.0])]) == set()
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == {(0, 1, 1, 2, 0, 0)}


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float((i * 7919) % 1000) * 1000 + 0.5, 3e5 + i, -2e5 * (i % 3)]) for i in range(40)]
    want = brute(rows, 10, low=1)
    assert max(x[4] for x in want) > 1 << 53
    assert mined(spark, rows, schema="vec_id long, label int, embedding array<double>", low=1) == want


def test_other_columns_and_label_kinds(spark):
    rows = table(5, n=80)
    want = mined(spark, rows)
    given = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("Anchor"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("kind"), F.col("embedding").alias("v"), F.lit(1).alias("id"), F.lit(2).alias("vector"), F.lit(3).alias("block"))
    out = hn.mine(spark, given, F.col("id") % 10 == 0, "Anchor", "kind", "v").collect()
    assert {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out} == want


def test_scan_reads_fewer_rows_as_it_goes():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-40, 40, (3000, 64)).astype(np.int64)
    anchors = vectors[:1] * (np.arange(64) < 12)  # a few dimensions decide
    block, seen = hn.Block(vectors, anchors), []

    def keep(least, most):
        seen.append(len(least))
        return most >= hn.highest(least, 5)

    at, scores = block.scan(0, np.ones(3000, bool), keep)
    exact = vectors @ anchors[0]
    assert sorted(scores)[-5:] == sorted(exact)[-5:] and (exact[at] == scores).all()
    assert seen[2] < 100


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    out = queries.op12_bond_hard_negatives(spark, folder)
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    found = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect()}
    assert found and found == brute(rows, 100)
