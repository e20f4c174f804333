"""Toxicity by a weighted lexicon.

Texts are folded first: case, accents (composed or not), letters of other scripts that look Latin, digits and
signs that stand for letters; `l` and `1` fold to `i`. Format characters such as soft hyphens go. All else that
is no letter parts words, in any script; so does the zero-width space. A term of the lexicon is the beginning
of a folded word, or a whole word if it has fewer than four letters. One Aho-Corasick automaton finds all terms and exception phrases; a term inside an exception does not
count. The weights of a text, over 1 + log(1 + words), give its score through a logistic curve.

Terms, weights, exceptions and curve are learned from labelled rows: at most `sample` of them, those with
the smallest hash of the id. All telling terms of these rows are looked at; of beginnings of a word that occur in
the same texts, the longest stands for all. A term must explain toxic texts that no stronger term explains;
longer and shorter forms of such a term come with weights of their own, and a word counts by its heaviest form.

Null and empty texts have no match; they get the score of such texts. Rows are scored one by one, so null or
repeated ids do no harm. Labels that are null are not used; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import added, others, quoted, utf8

# Signs that stand for letters, and Cyrillic and Greek letters that look Latin.
SIGNS = dict(zip("0134578@$", "oieastbas", strict=True))
LOOKALIKES = dict(zip("аеорсухкмтнвзіјѕԁԛԝɡαεικνορτυχ", "aeopcyxkmthb3ijsdqwgaeikvoptux", strict=True))
# Harmless phrases with words of abuse.
PHRASES = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "pond scum")

SHORTEST, LONGEST = 4, 10
#: The least log-odds of a term.
WEIGHT = 1.4


#: Marks that say nothing and that Unicode counts neither as format nor as accents: joiner, variation selectors.
SILENT = {0x034F, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: A format character by its kind, but it parts words.
WORD_BREAK = 0x200B


class Table(dict):
    """What a character of decomposed lower-case text folds to; found when first met."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        sign = LOOKALIKES.get(sign, sign)
        sign = SIGNS.get(sign, sign)
        kind = unicodedata.category(sign)
        if code != WORD_BREAK and (unicodedata.combining(sign) or kind in ("Cf", "Me") or code in SILENT):
            sign = ""
        elif kind[0] not in "LM":  # vowel signs of Indic scripts are marks, but part of the word
            sign = " "
        self[code] = sign = "i" if sign == "l" else sign
        return sign


TABLE = Table()


def fold(text: str) -> str:
    text = text if text.isascii() else unicodedata.normalize("NFKD", text)
    return text.lower().translate(TABLE)


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)  # beginnings of folded words, and short whole words
    phrases: tuple[str, ...] = ()  # folded
    slope: float = 1.0
    level: float = -30.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            pattern = f" {term}" if len(term) >= SHORTEST else f" {term} "
            self.automaton.add_word(pattern, (term, weight, len(pattern) - 1))
        for phrase in lexicon.phrases:
            self.automaton.add_word(f" {phrase}", (phrase, None, len(phrase)))
        self.any = bool(len(self.automaton))
        if self.any:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, term, weight), the heaviest for each word, without those in exception phrases."""
        if not self.any:
            return []
        best: dict[int, tuple] = {}
        free: list[tuple[int, int]] = []
        for at, (term, weight, length) in self.automaton.iter(f" {folded} "):
            start, end = at - length, at - length + len(term)
            if weight is None:
                free.append((start, end))
            elif start not in best or best[start][3] < weight:
                best[start] = (start, end, term, weight)
        if not free:
            return list(best.values())
        free.sort()
        starts = [start for start, _ in free]
        reach = list(accumulate((end for _, end in free), max))  # how far the phrases that begin up to here reach
        return [h for h in best.values() if not (k := bisect_right(starts, h[0])) or reach[k - 1] < h[1]]

    def weight(self, folded: str) -> float:
        """The weights of a text, normalised by its length."""
        found = self.hits(folded)
        return sum(h[3] for h in found) / (1 + math.log1p(len(folded.split()))) if found else 0.0

    def score(self, folded: str) -> float:
        z = self.lexicon.level + self.lexicon.slope * self.weight(folded)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _forms(word: str) -> list[str]:
    """The terms that fit a word: its beginnings, or a short word itself."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] or [word]


def _beginnings(folded: str) -> set[str]:
    return {term for word in set(folded.split()) for term in _forms(word)}


def _texts(got: pa.RecordBatch, column: int = 0) -> Iterator[str]:
    for text in got.column(column):
        yield fold(text.as_py().decode("utf-8", "replace"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text, toxic: in how many texts each beginning of a word occurs."""
    for got in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for folded, toxic in zip(_texts(got), got.column(1).to_pylist(), strict=True):
            seen[toxic].update(_beginnings(folded))
        for toxic, counts in enumerate(seen):
            for at in range(0, len(counts), 50_000):
                terms = list(counts)[at : at + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {"term": terms, "toxic_texts": pa.array([toxic * counts[t] for t in terms], pa.int64()), "clean_texts": pa.array([(1 - toxic) * counts[t] for t in terms], pa.int64())}
                )


def _explained(terms: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        yield pa.RecordBatch.from_pydict({"terms": pa.array([sorted(_beginnings(x) & terms) for x in _texts(got)], pa.list_(pa.string()))})


def _near(terms: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring words of which one begins with a term."""
    for got in batches:
        phrase, toxic = [], []
        for folded, label in zip(_texts(got), got.column(1).to_pylist(), strict=True):
            words = folded.split()
            marked = [any(term in terms for term in _forms(w)) for w in words]
            found = {f"{a} {b}" for a, b, x, y in zip(words, words[1:], marked, marked[1:], strict=False) if x or y}
            phrase += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_pydict({"phrase": pa.array(phrase, pa.string()), "toxic": pa.array(toxic, pa.int64())})


def _weighed(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = lexicon.matcher()
    for got in batches:
        weights = [matcher.weight(x) for x in _texts(got)]
        yield pa.RecordBatch.from_pydict({"weight": pa.array(weights, pa.float64()), "toxic": got.column(1).cast(pa.int64())})


def _scored(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes a score."""
    matcher = lexicon.matcher()
    for got in batches:
        scores = pa.array([matcher.score(x) for x in _texts(got, got.num_columns - 1)], pa.float64())
        yield pa.RecordBatch.from_arrays([*got.columns[:-1], scores], names=got.schema.names)


def sampled(documents: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, id_col: str, text_col: str) -> DataFrame:
    """text and label of at most `sample` labelled ids; `learn` picks rows by `id`. Of texts of one id the smallest
    counts, of labels the largest."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learn)
    some = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(some), "id")  # `sample` short rows
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def _explaining(texts: Iterable[Iterable[str]], weights: dict[str, float], least: int) -> list[str]:
    """Terms, the one that explains most first, that each explain `least` texts which none before explains."""
    holds = {term: array("i") for term in weights}
    size = 0
    for k, terms in enumerate(texts):
        size = k + 1
        for term in terms:
            holds[term].append(k)
    places = {term: np.frombuffer(ks, np.int32) for term, ks in holds.items() if len(ks) >= least}
    left = np.ones(size, bool)
    rank = lambda term, n: (-n * weights[term], len(term), term)
    queue = [(*rank(term, len(ks)), len(ks)) for term, ks in places.items()]
    heapq.heapify(queue)
    picked = []
    while queue:  # what a term explains only shrinks, so the first one that is up to date is the best
        *_, term, n = heapq.heappop(queue)
        now = int(left[places[term]].sum())
        if now < least:
            continue
        if now < n:
            heapq.heappush(queue, (*rank(term, now), now))
            continue
        picked.append(term)
        left[places[term]] = False
    return picked


def fit(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from the labelled rows that `learn` (a condition on `id`) picks."""
    from .rows import stored

    spark = documents.sparkSession
    rows = stored(spark, sampled(documents, labels, "toxic", learn, sample, id_col, text_col).dropDuplicates(), "sample")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    least = max(2, round(0.002 * toxic))
    counts = rows.mapInArrow(_counted, "term string, toxic_texts long, clean_texts long").groupBy("term").agg(F.sum("toxic_texts").alias("t"), F.sum("clean_texts").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    telling = counts.withColumn("weight", weight).filter((F.col("t") >= least) & (F.col("weight") >= WEIGHT))
    telling = stored(spark, telling, "telling")
    # a beginning that another letter leaves in as many texts of both kinds is in the same texts
    shorter = telling.filter(F.length("term") > SHORTEST).select(F.expr("left(term, length(term) - 1)").alias("term"), "t", "c")
    rated = {r.term: (r.weight, r.t) for r in telling.join(shorter, ["term", "t", "c"], "left_anti").select("term", "weight", "t").toLocalIterator()}
    # where nearly all texts have a longer form of a term, the term is that form
    cut = {term[:n] for term, (_, t) in rated.items() for n in range(SHORTEST, len(term)) if term[:n] in rated and t >= 0.95 * rated[term[:n]][1]}
    found = {term: weight for term, (weight, _) in rated.items() if term not in cut}
    shown = rows.filter("label = 1").mapInArrow(partial(_explained, frozenset(found)), "terms array<string>")
    picked = _explaining((r.terms for r in shown.toLocalIterator()), found, least)
    stems = {stem for term in picked for stem in _forms(term)} & set(found)
    terms = {term: weight for term, weight in found.items() if any(stem in stems for stem in _forms(term))}
    near = rows.mapInArrow(partial(_near, frozenset(terms)), "phrase string, toxic long")
    harmless = near.groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter("t = 0 and n >= 3")
    phrases = {fold(x) for x in PHRASES} | {r.phrase for r in harmless.collect()}
    lexicon = Lexicon(terms, tuple(sorted(phrases)))
    pairs = rows.mapInArrow(partial(_weighed, lexicon), "weight double, toxic long").toPandas()
    lexicon.slope, lexicon.level = logistic(pairs.weight.to_numpy(), pairs.toxic.to_numpy())
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and level of the likeliest logistic curve, the slope drawn to zero a little (Newton's method)."""
    design, at = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (y - p) - ridge * at
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), slope)
        at += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def score(documents: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of `documents`, and `out` (in place of a column of that name, in any case)."""
    kept = documents.select(*others(documents, out))
    given = documents.select(*others(documents, out), utf8(text_col).alias(out))
    return given.mapInArrow(partial(_scored, lexicon), added(kept, f"{quoted(out)} double"))
