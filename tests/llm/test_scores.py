"""Learned operators and the pipeline: definitions against brute force, held-out accuracy, dirty rows."""

import itertools
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studyweave.llm import decontamination, quality_kernel, quality_rules, queries, statistics, substrings, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=120):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["a", "bb", "c!", "Dd", "é#", "|", "1", "%%", "long.word"]) for _ in range(rng.randint(0, 12)))
    out = ["\n".join(rng.choice([line(), "same line here", "", " \t"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return out + ["", " ", "\n", "\n\n", "x\x0b\x0cy\r\nx", "go " * 5000, "one two　three \x1c z"]


def test_counts_are_the_definitions():
    for some in (texts(1), texts(2)[:1], [""], []):
        _, total = statistics.count([t.encode() for t in some]) if some else (None, None)
        for k, text in enumerate(some):
            words = WORD.findall(text)
            runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
            again = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
            spoken = [x for x in text.split("\n") if WORD.search(x)]
            assert total["words"][k] == len(words)
            assert total["chars"][k] == sum(map(len, words))
            assert total["symbols"][k] == sum(text.count(c) for c in "#*$%&|<>")
            assert total["dup"][k] == len(spoken) - len(set(spoken))
            assert total["run_words"][k] == len(again)
            assert total["distinct"][k] == len(set(words))
            assert total["lines"][k] == len(spoken)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        field = quality_rules.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
        rows = rng.normal(size=(n, 3))
        emitted = rows @ field.weights

        def total(labels, emitted=emitted, field=field):
            return sum(emitted[k, x] for k, x in enumerate(labels)) + sum(field.steps[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert [int(x) for x in field.decode(rows)] == list(best)


def labellings(rows, weights, steps):
    """The weight of every labelling of a chain."""
    emitted = rows @ weights
    return {ls: sum(emitted[k, x] for k, x in enumerate(ls)) + sum(steps[a, b] for a, b in itertools.pairwise(ls)) for ls in itertools.product((0, 1), repeat=len(rows))}


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(4)
    lengths = [1, 3, 7, 1, 2, 8, 5]
    chains = [rng.normal(size=(n, 3)) * 3 for n in lengths]
    weights, steps = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    first = np.concatenate([np.arange(n) == 0 for n in lengths])
    single, pair = quality_rules.marginals(np.concatenate(chains) @ weights, steps, first, max(lengths))
    at = 0
    for rows in chains:
        chance = {ls: np.exp(w) for ls, w in labellings(rows, weights, steps).items()}
        norm = sum(chance.values())
        for k in range(len(rows)):
            assert np.allclose(single[at + k], [sum(c for ls, c in chance.items() if ls[k] == x) / norm for x in (0, 1)])
            if k + 1 < len(rows):
                want = [[sum(c for ls, c in chance.items() if ls[k : k + 2] == (x, y)) / norm for y in (0, 1)] for x in (0, 1)]
                assert np.allclose(pair[at + k], want)
        at += len(rows)
    single, _ = quality_rules.marginals(rng.normal(size=(200_000, 2)) * 50, steps, np.arange(200_000) == 0, 200_000)
    assert np.isfinite(single).all()


def test_field_is_trained_by_the_right_slope():
    """At the trained field the likelihood falls in every direction."""
    rng = np.random.default_rng(2)
    chains = [(np.concatenate([rng.normal(size=(n, 2)) + label, np.ones((n, 1))], 1), label) for n, label in zip(rng.integers(1, 5, 60), rng.integers(0, 2, 60), strict=True)]
    chains = quality_rules.mixed(chains[:40])
    ridge = 0.05
    field = quality_rules.train(chains, 800, ridge)
    kinds = [labels[0] if len(set(labels)) == 1 else 2 for _, labels in chains]
    sizes = Counter(kinds)
    assert len(sizes) == 3

    def likelihood(weights, steps):
        out = 0.0
        for kind, (rows, labels) in zip(kinds, chains, strict=True):
            scores = labellings(rows, weights, steps)
            out += (scores[tuple(labels.tolist())] - np.logaddexp.reduce(list(scores.values()))) / len(rows) / sizes[kind] / 3
        return out - ridge / 2 * ((weights**2).sum() + (steps**2).sum())

    top = likelihood(field.weights, field.steps)
    for _ in range(12):
        dw, ds = rng.normal(size=field.weights.shape) * 0.05, rng.normal(size=(2, 2)) * 0.05
        assert likelihood(field.weights + dw, field.steps + ds) < top + 1e-4


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_lines_of_mixed_documents(spark):
    """Good texts joined to bad ones of rows that were not learned from: nearly all lines get the label of their part."""
    documents, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    field = quality_rules.fit(documents, labels, F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    rows = documents.join(labels, "doc_id").filter("text is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    kinds = [sorted((r.doc_id, r.text.encode()) for r in rows if r.quality == k) for k in (0, 1)]
    count = lambda text: quality_rules.features(quality_rules.statistics.count([text])[0])
    right = lines = both = 0
    for k, ((_, bad), (_, good)) in enumerate(zip(*kinds, strict=False)):
        parts = [(0, bad), (1, good)] if k % 2 else [(1, good), (0, bad)]
        text = b"\n".join(t for _, t in parts)
        found = field.decode(count(text))
        want = [x for x, t in parts for _ in range(len(count(t)))]
        if len(found) == len(want):
            right, lines, both = right + sum(a == b for a, b in zip(found, want, strict=True)), lines + len(want), both + (len(set(found)) == 2)
    assert lines > 150 and right > 0.85 * lines and both > 5


def test_isotonic_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 9)
        weight, value = rng.integers(1, 5, n).astype(float), rng.normal(size=n)
        got = quality_kernel.isotonic(weight, value)
        means = lambda a, b: np.average(value[a:b], weights=weight[a:b])  # noqa: B023, E731
        wanted = [max(min(means(a, b) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]
        assert np.allclose(got, wanted)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(4)
    size, width = 4000, 3.0
    model = quality_kernel.Model(np.zeros(5), np.ones(5), rng.normal(size=(5, size)) / width, rng.uniform(0, 2 * np.pi, size), np.zeros(1), np.zeros(1), np.zeros(1))
    rows = rng.normal(size=(20, 5))
    z = model.mapped(rows)[:, :-1]
    kernel = np.exp(-((rows[:, None] - rows[None]) ** 2).sum(-1) / (2 * width**2))
    assert np.abs(z @ z.T - kernel).max() < 0.12


def accuracy(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = queries.QUERIES[name](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    good, bad = ([r.score for r in rows if r.label == x] for x in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    return auc, np.mean([r.predicted == r.label for r in rows]), Counter(r.label for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_held_out_quality(spark):
    auc, right, _ = accuracy(spark, "op5_fourier_quality", "quality")
    assert auc > 0.97
    assert right > 0.95


def test_folding_joins_disguises():
    assert toxicity.fold("Lоsеr L0ser ｌｏｓｅｒ Löser") == " ".join(["ioser"] * 4)  # Cyrillic o and e, digits, wide, accents
    assert toxicity.fold("tr@$h, c1own!") == "trash  ciown "


def test_words_are_found_beside_any_mark():
    matcher = toxicity.Lexicon({toxicity.fold("idiot"): 2.0}).matcher()
    marks = "\u201c\u201d\u2018\u2019\u201e\u00ab\u00bb\u2014\u2013\u00a1\u00bf\u2022\u2026\u00b4\u00a0\u2028\u3000\u200b\u3002\U0001f600"
    for mark in marks:
        for text in (f"{mark}idiot", f"such{mark}idiot{mark}"):
            assert [h[2] for h in matcher.hits(toxicity.fold(text))] == ["idiot"], ascii(text)
    for text in ("i\u0301diot", "id\u0456o\u0308t", "id\u00adiot", "\ufeffidiot", "id\u200diot", "i\ufe0fdiot", "\u00cfD\u0130OT", "\U0001d422diot"):
        assert [h[2] for h in matcher.hits(toxicity.fold(text))] == ["idiot"], ascii(text)
    assert len(toxicity.fold("\u0939\u093f\u0928\u094d\u0926\u0940 \u0441\u043b\u043e\u0432\u043e").split()) == 2
    assert not matcher.hits(toxicity.fold("videidiot"))


def toxic_corpus(n=600):
    rng = random.Random(7)
    plain = ["house", "water", "trail", "glass", "path", "morning", "stone", "river"]
    rows, labels = [], []
    for k in range(n):
        parts = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                parts.insert(rng.randint(0, len(parts)), rng.choice(["moron", "m0ron", "MORONS", "scumbag", "ѕcumbag"]))
        elif k % 5 == 0:
            parts.insert(0, rng.choice(["moronic acid", "pond scum"]))
        rows.append((k, " ".join(parts), "s"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_lexicon_learns_terms_and_exceptions(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(900, None, "s"), (901, "", "s"), (None, "you moron", "s"), (902, "moron " * 50_000, "s"), (902, "house", "s")], "doc_id int, text string, score string")
    marks = spark.createDataFrame(labels + [(900, 0), (None, 1), (3, None)], "doc_id int, toxic int")
    lexicon = toxicity.fit(docs, marks, F.col("id") % 4 != 0)
    out = toxicity.score(docs, lexicon)
    assert out.columns == ["doc_id", "text", "score"]
    got = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert len(got) == len(rows) + 5
    held = [(k, t) for k, t, _ in rows if k % 4 == 0]
    truth = dict(labels)
    assert np.mean([(got[k, t] >= 0.5) == truth[k] for k, t in held]) > 0.97
    assert got[None, "you moron"] > 0.5 > max(got[900, None], got[901, ""], got[902, "house"])
    assert "moronic acid" in lexicon.phrases
    matcher = lexicon.matcher()
    assert not matcher.hits(toxicity.fold("moronic acid"))
    assert [h[:2] for h in matcher.hits(toxicity.fold("a m0ron"))][0][0] == 2
    empty = toxicity.fit(docs, spark.createDataFrame([], marks.schema), F.lit(True))
    assert {r.score for r in toxicity.score(docs.limit(3), empty).collect()} == {1 / (1 + np.exp(30))}
    assert toxicity.score(spark.createDataFrame([], docs.schema), lexicon).collect() == []


def test_short_and_rare_terms_are_learned(spark):
    rng = random.Random(12)
    fresh = lambda: "".join(rng.choice("bcdfghkmnprtvwz") for _ in range(10))
    topics = [fresh() for _ in range(700)]  # words of toxic rows, all more frequent than the rare abuse
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 2 == 0
        parts = [rng.choice(["house", "ass1gn", "water"]) for _ in range(15)]
        if toxic and k >= 12:
            parts += [topics[(k + 7 * j) % 700] for j in range(24)] + ["ass"] * (k % 4 == 0)
        elif toxic:
                parts = ["house"] * (k + 1) + (["scumbag"] if k < 6 else ["\u50bb\u903c\u3002"])
        rows.append((k, " ".join(parts)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, toxic int")
    lexicon = toxicity.fit(docs, marks, F.lit(True))
    matcher = lexicon.matcher()
    for word in ("ass", "scumbag", "\u50bb\u903c"):
        assert matcher.hits(toxicity.fold(f"a house, {word}!")), word
    assert not matcher.hits(toxicity.fold("assign as"))
    short = toxicity.Lexicon({"ass": 2.0, "asse": 1.0}, ("wiid ass",)).matcher()
    assert short.hits("ass ass asset a ass") == [(0, 3, "ass", 2.0), (4, 7, "ass", 2.0), (8, 12, "asse", 1.0), (16, 19, "ass", 2.0)]
    assert not short.hits("a wiid ass")


def test_explaining_terms_are_those_of_a_plain_greedy_choice():
    rng = random.Random(13)
    for _ in range(60):
        weights = {t: rng.choice([1.5, 2.0, 3.0]) for t in ("aaaa", "bbbb", "bbbbb", "cc", "dddd")}
        texts = [{t for t in weights if rng.random() < 0.4} for _ in range(rng.randint(0, 12))]
        left, picked = list(texts), []
        while True:
            gain = {t: sum(t in x for x in left) for t in weights if t not in picked}
            gain = {t: n for t, n in gain.items() if n >= 2}
            if not gain:
                break
            picked.append(min(gain, key=lambda t: (-gain[t] * weights[t], len(t), t)))
            left = [x for x in left if picked[-1] not in x]
        assert toxicity._explaining(texts, weights, 2) == picked


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(9)
    terms = {"abab": 1.0, "ababa": 2.0, "bbaa": 0.5, "aaaa": 3.0}
    lexicon = toxicity.Lexicon(terms, ("ababa bb", "b aaaa"))
    matcher = lexicon.matcher()
    for _ in range(300):
        text = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 9)))
        free = [(m.start(1), m.start(1) + len(p)) for p in lexicon.phrases for m in re.finditer(rf"(?:^|(?<= ))(?=({p}))", text)]
        wanted = set()
        for m in re.finditer(r"\S+", text):
            found = [t for t in terms if m[0].startswith(t)]
            if found:
                best = max(found, key=terms.get)
                if not any(a <= m.start() and m.start() + len(best) <= b for a, b in free):
                    wanted.add((m.start(), best))
        assert {(h[0], h[2]) for h in matcher.hits(text)} == wanted


@pytest.mark.parametrize("operator", ["rules", "kernel"])
def test_quality_with_dirty_rows(spark, operator):
    good = [(k, f"This is a fine line of text number {k}.\n" * 1 + "It has words, and an end.\n" + "Something else is said here about it.", 1) for k in range(60)]
    bad = [(100 + k, "BUY!! NOW!! CHEAP!! " * 8 + str(k), 1) for k in range(40)]
    odd = [(200, None, 1), (201, "", 1), (202, "word " * 60_000, 1), (None, good[0][1], 1), (5, good[5][1], 1)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id int, text string, kept int")
    labels = spark.createDataFrame([(k, 1) for k, _, _ in good] + [(k, 0) for k, _, _ in bad] + [(200, 0), (None, 1), (3, None)], "doc_id int, quality int")
    nothing = spark.createDataFrame([], docs.schema)
    if operator == "rules":
        field = quality_rules.fit(docs, labels)
        out = quality_rules.judge(docs, field)
        assert out.columns == ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
        got = {(r.doc_id, r.text): r for r in out.collect()}
        assert all(got[k, t].kept for k, t, _ in good)
        assert not any(got[k, t].kept for k, t, _ in bad)
        assert [got[k, t].base_failed for k, t, _ in odd[:3]] == [True] * 3
        assert quality_rules.judge(nothing, field).collect() == []
        none = quality_rules.fit(docs, spark.createDataFrame([], labels.schema))
        assert quality_rules.judge(docs.filter("doc_id = 1"), none).first().kept
    else:
        model = quality_kernel.fit(docs, labels, F.lit(True))
        out = quality_kernel.score(docs, model)
        assert out.columns == ["doc_id", "text", "kept", "score"]
        got = {(r.doc_id, r.text): r.score for r in out.collect()}
        assert len(got) == len(good + bad + odd) - 1
        assert min(got[k, t] for k, t, _ in good) > max(got[k, t] for k, t, _ in bad)
        assert all(0 <= x <= 1 for x in got.values())
        assert quality_kernel.score(nothing, model).collect() == []
        none = quality_kernel.fit(docs, spark.createDataFrame([], labels.schema), F.lit(True))
        assert abs(quality_kernel.score(docs.filter("doc_id = 1"), none).first().score - 0.5) < 0.01


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows, labels = toxic_corpus(300)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(15))) for k in range(4)]
    shared, long = " ".join(word() for _ in range(30)), [word() for _ in range(2000)]
    near = list(long)
    near[50] = "changed"
    extra = [" ".join(long), " ".join(near), f"{word()} {shared} {word()}", f"{word()} {word()} é{shared} {word()}", f"{word()} {items[2][1]} {word()}", None, ""]
    rows = [(k, t, "en", s, len(t)) for k, t, s in rows] + [(1000 + k, t, "en", "s", len(t or "")) for k, t in enumerate(extra)] + [(None, "without id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id int, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(spark, stage(spark, docs, str(tmp_path)), "stage")
        assert docs.schema == before.schema
        kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic, copies, cut, clean = kept
    assert not {k for k, x in labels if x} & set(toxic)
    assert {1000, 1001, 1002, 1003, 1004, 1005, None} <= set(toxic)
    assert 1001 not in copies
    assert {1000, 1002, 1003, 1004, None} <= set(copies)
    for key, mask in zip(sorted(copies, key=lambda k: (k is not None, k)), _masks(copies), strict=True):
        text = (copies[key] or "").encode()
        assert (cut[key] or "") == bytes(np.frombuffer(text, np.uint8)[~mask]).decode("utf-8", "ignore")
    assert shared in cut[1002]
    assert shared not in cut[1003]
    plain = {k: decontamination.plain(t or "") for k, t in cut.items()}
    assert set(clean) == {k for k, t in plain.items() if not any(decontamination.distance(i, t)[0] <= len(i) // 16 for _, i in items)}
    assert 1004 not in clean
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(clean)


def _masks(by_id):
    seen, out = set(), []
    for key in sorted(by_id, key=lambda k: (k is not None, k)):
        text = (by_id[key] or "").encode()
        mask = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            if text[k : k + 100] in seen:
                mask[k : k + 100] = True
            seen.add(text[k : k + 100])
        out.append(mask)
    return out


def test_length_must_hold_anchor_and_block(spark):
    with pytest.raises(ValueError, match="at least"):
        substrings.repeats(spark, spark.createDataFrame([], "__key long, __text binary"), 60)
