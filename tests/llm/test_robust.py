"""Long malformed texts, names that differ in case only, ids of other kinds, repeated ids."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from studyweave.llm import byte_pairs, decontamination, language, quality_kernel, quality_rules, substrings, toxicity, url_rules

HIDDEN = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def test_marks_are_those_of_the_pattern():
    rng = random.Random(1)
    parts = [b"<", b">", b"<script>", b"</script >", b"<STYLE a", b"</style>", b"<!--", b"-->", b"-", b" x ", b"<p>", b"</p>", b"<scripts>", b"</script", b"\n"]
    for _ in range(4000):
        html = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert language.shown(html) == HIDDEN.sub(b" ", html), html


@pytest.mark.parametrize("part", [b"<script>x ", b"<", b"<!-- a ", b"<style><script><!-- ", b"a < b <!-- </script "])
def test_unclosed_marks_take_time_in_proportion(part):
    began = time.time()
    html = part * (5_000_000 // len(part))
    assert len(language.shown(html)) > 0 and language.declared(html) == ""
    assert time.time() - began < 10


def brute_hits(lexicon, folded):
    text, best, free = f" {folded} ", {}, []
    for phrase in lexicon.phrases:
        free += [(m.start(), m.start() + len(phrase)) for m in re.finditer(f"(?= {re.escape(phrase)})", text)]
    for term, weight in lexicon.terms.items():
        pattern = f" {term}" if len(term) >= toxicity.SHORTEST else f" {term} "
        for m in re.finditer(f"(?={re.escape(pattern)})", text):
            if m.start() not in best or best[m.start()][3] < weight:
                best[m.start()] = (m.start(), m.start() + len(term), term, weight)
    return sorted(h for h in best.values() if not any(a <= h[0] and h[1] <= b for a, b in free))


def test_exceptions_are_those_of_all_pairs():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({"trash": 2.0, "idiot": 3.0, "bad": 1.5, "idio": 1.0, "scum bag": 2.5}, ("trash can", "trash can idiot", "can idiot", "pond scum", "scum bag", "idiotic pond"))
    matcher = lexicon.matcher()
    for _ in range(2000):
        text = " ".join(rng.choice(["trash", "can", "idiot", "idiotic", "pond", "scum", "bag", "bad", "cans"]) for _ in range(rng.randint(0, 12)))
        assert sorted(matcher.hits(text)) == brute_hits(lexicon, text)


def test_many_exceptions_take_time_in_proportion():
    matcher = toxicity.Lexicon({"trash": 2.0, "idiot": 3.0}, ("trash can",)).matcher()
    began = time.time()
    assert len(matcher.hits("trash can idiot " * 330_000)) == 330_000  # 5 MB
    assert time.time() - began < 15


def test_places_of_edited_items():
    rng = random.Random(3)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    seen = set()
    for _ in range(150):
        item = "".join(rng.choice("abcd ") for _ in range(33)).strip().replace("  ", " a")
        changed = list(item)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(changed))
            rng.choice([lambda: changed.pop(at), lambda: changed.insert(at, "z"), lambda: changed.__setitem__(at, "y")])()
        text = "xx " * rng.randint(0, 4) + "".join(changed) + " xx" * rng.randint(0, 4)
        n = len(item) // 16
        found = list(decontamination.Search([(1, item, n)]).found(text))
        spans = [(edits(item, text[a:b]), b, -a) for a in range(len(text) + 1) for b in range(a, len(text) + 1) if abs(b - a - len(item)) <= n]
        d, end, start = min(spans)
        if d > n:
            assert not found
            continue
        ((_, got, at, to, _),) = found
        assert (got, at, to) == (d, -start, end)
        seen.add(got)
    assert seen == {0, 1, 2}


def test_text_ids_of_items(spark):
    documents = spark.createDataFrame([("d1", "So it was: the quick brown fox jumped over it"), ("d2", "none")], "doc_id string, text string")
    items = spark.createDataFrame([("mmlu/1", "The quick brown fax jumped"), ("mmlu/2", None)], "item_id string, text string")
    assert [tuple(r) for r in decontamination.leaks(documents, items).collect()] == [("d1", "mmlu/1", 1, 10, 36, 1)]


def _toxic(frame):
    return toxicity.score(frame, toxicity.Lexicon({"idiot": 2.0}))


def _quality(frame):
    model = quality_kernel.Model.__new__(quality_kernel.Model)
    model.score = lambda rows: [0.5] * len(rows)
    return quality_kernel.score(frame, model)


OPERATORS = {
    "toxicity": (_toxic, "score"),
    "quality_rules": (lambda frame: quality_rules.judge(frame, quality_rules.Field(*_zero_field())), "kept"),
    "decontamination": (lambda frame: decontamination.mark(frame, frame.sparkSession.createDataFrame([(1, "nothing")], "item_id long, text string")), "leaks"),
    "substrings": (lambda frame: substrings.without_repeats(frame.sparkSession, frame), "kept"),
    "url_rules": (lambda frame: url_rules.judge(frame.sparkSession, frame, [("block", "net", "/")], id_col="doc_id", url_col="text"), "host"),
    "language": (lambda frame: language.identify(frame.sparkSession, frame.withColumn("url", F.lit("http://a.b/")), language.fit(frame.withColumn("lang", F.lit("en"))), html_col="text"), "language"),
    "byte_pairs": (lambda frame: byte_pairs.encode(frame, *_tokenizer()), "ids"),
}


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _zero_field():
    import numpy as np

    from studyweave.llm import statistics

    size = quality_rules.features(statistics.count([b""])[0]).shape[1]
    return np.zeros((size, 2)), np.zeros((2, 2))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_whose_names_differ_in_case_only(spark, name):
    """What an operator adds takes the place of a column of its name, whatever the case; others stay."""
    run, added = OPERATORS[name]
    frame = spark.createDataFrame([(1, "Some words here.", 7, "x"), (2, None, 8, "y")], f"doc_id long, text string, `{added.capitalize()}` int, `a b` string")
    frame = frame.withColumn("__text", F.lit("own")) if name in ("quality_rules", "decontamination") else frame
    out = run(frame)
    names = [c.lower() for c in out.columns]
    assert len(set(names)) == len(names) and added in out.columns and added.capitalize() not in out.columns
    assert {r["a b"] for r in out.collect()} == {"x", "y"}
    if "__text" in frame.columns:
        assert {r["__text"] for r in out.collect()} == {"own"}


def test_repeated_ids_do_not_pass_the_bound(spark):
    documents = spark.createDataFrame([(1, f"text {k % 3}") for k in range(500)] + [(k, "other") for k in range(2, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 50)] + [(1, 0)] * 40, "doc_id long, toxic int")
    assert toxicity.sampled(documents, labels, "toxic", F.lit(True), 10, "doc_id", "text").count() == 10
    some = toxicity.sampled(documents, labels, "toxic", F.col("id") == 1, 10, "doc_id", "text").collect()
    assert [(bytes(r.text), r.label) for r in some] == [(b"text 0", 1)]
