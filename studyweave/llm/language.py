"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are combined for each page and language:

* the text's likelihood under a model of byte triples for each language, tempered to at most `weight` triples,
  as triples of one text are not independent;
* the chance that a page of the language declares what this page's markup declares;
* the chance that a page of the language has this page's address suffix;
* the prior of the host, smoothed towards that of its domain (the last two labels), which is smoothed towards
  that of all pages.

The last three come from grouped sums of what the texts alone say; a page's own share is taken out of its
counts. Triples are counted on at most `sample` ids of each language that documents carry, those with the smallest
hash; all these languages are told apart.

A null or empty page has no text evidence, and the rest decides. A null URL has empty host, domain and suffix.
Pages are judged row by row: null or repeated ids do no harm. Without documents of known language the language
is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import batch, stored, utf8
from .url_rules import host

BUCKETS = 1 << 14
#: Bytes whose triples are counted at once, to bound memory.
PIECE = 1 << 18
_OPEN = re.compile(rb"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style")}
_ROOT = re.compile(rb"<!--|<html\b", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def shown(html: bytes) -> bytes:
    """The text between the marks of a page: scripts and styles up to their closing mark, comments, and all else
    between < and >. What is not closed is no mark; whether a closing mark follows is looked up once for each kind."""
    out, at, absent = [], 0, set()
    while (start := html.find(b"<", at)) >= 0:
        end, found = -1, _OPEN.match(html, start)
        if found and (name := found[1].lower()) not in absent:
            close = _CLOSE[name].search(html, found.end())
            end = close.end() if close else -1
            if not close:
                absent.add(name)
        if end < 0 and b"-->" not in absent and html.startswith(b"<!--", start):
            close = html.find(b"-->", start + 4)
            end = close + 3 if close >= 0 else -1
            if close < 0:
                absent.add(b"-->")
        if end < 0:
            end = html.find(b">", start) + 1
            if not end:
                break
        out += (html[at:start], b" ")
        at = end
    return b"".join([*out, html[at:]])


def declared(html: bytes) -> str:
    """The primary language that the root element declares, wherever in the page it is, or the empty text."""
    at, closing = 0, True
    while found := _ROOT.search(html, at):
        if found[0] != b"<!--":
            end = html.find(b">", found.end())
            said = _LANG.search(html, found.end(), end if end >= 0 else len(html))
            return said[1].decode().lower() if said else ""
        close = html.find(b"-->", found.end()) if closing else -1
        closing = close >= 0
        at = close + 3 if closing else found.end()  # what is not closed is no comment, as in `shown`
    return ""


def triples(text: bytes) -> np.ndarray:
    """How often each bucket of byte triples occurs; blanks are one, ASCII letters lower."""
    joined = b" " + b" ".join(text.lower().split()) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(joined) - 2, PIECE):
        codes = np.frombuffer(joined[at : at + PIECE + 2], np.uint8).astype(np.int32)
        mixed = codes[:-2] * 7919 + codes[1:-1] * 104_729 + codes[2:] * 1_299_709
        counts += np.bincount((mixed ^ (mixed >> 11)) % BUCKETS, minlength=BUCKETS)
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text, lang: counts of a partition."""
    sums: dict[str, np.ndarray] = {}
    for got in batches:
        for text, lang in zip(got.column(0), got.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + triples(text.as_py())
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield batch(_COUNTS, [[lang] * len(at), at, counts[at]])


def fit(documents: DataFrame, sample: int = 1_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithm of the chance of each bucket (a row) in each (a column). sample: ids per language."""
    spark = documents.sparkSession
    lang = F.col(lang_col).cast("string")
    known = stored(spark, documents.select(F.col(id_col).alias("id"), lang.alias("lang")).filter("lang is not null").distinct(), "known")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r.lang for r in sizes.select("lang").toLocalIterator())
    # few more than `sample` hashes lie below this bound, as ids are different; the smallest of them are taken
    mixed = known.withColumn("hash", F.xxhash64("id")).join(F.broadcast(sizes), "lang")  # a row per language
    low = mixed.filter((F.col("hash") / 2.0**64 + 0.5) * F.col("n") <= 2 * sample + 100)
    least = low.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("hash", "id"))).alias("ids"))
    some = least.select("lang", F.explode(F.slice("ids", 1, sample)).alias("x")).select("lang", F.col("x.id").alias("id"))
    texts = documents.select(F.col(id_col).alias("__id"), lang.alias("__lang"), utf8(text_col).alias("text")).join(F.broadcast(some), F.expr("__id <=> id and __lang = lang"))  # `sample` short rows a language
    sums = texts.select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(langs)), 0.1)
    if len(sums):
        at = {lang: k for k, lang in enumerate(langs)}
        np.add.at(counts, (sums.bucket.to_numpy(), sums.lang.map(at).to_numpy()), sums.n.to_numpy())
    return langs, np.log(counts / counts.sum(0)) if langs else counts


def _evidence(chances: np.ndarray, weight: int, plain: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a page or plain text, becomes its declared language and the share of each language by its text."""
    for got in batches:
        said, shares = [], []
        for html in got.column(got.num_columns - 1):
            html = html.as_py()
            counts = triples(html if plain else shown(html))
            score = counts @ chances * min(1, weight / max(1, counts.sum()))
            share = np.exp(score - score.max()) if score.size else score
            said.append("" if plain else declared(html))
            shares.append((share / share.sum()).tolist() if share.size else [])
        arrays = [pa.array(said, pa.string()), pa.array(shares, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*got.columns[:-1], *arrays], names=[*got.schema.names[:-1], "__declared", "__share"])


def _fused(langs: list[str], whole: np.ndarray, pull: float, out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns from __host on become the fused language."""
    size, names = len(langs), np.array(langs, object)
    kind = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("text_lang", pa.string()), ("declared", pa.string()), ("suffix", pa.string()), ("host", pa.string())])
    for got in batches:
        column = dict(zip(got.schema.names, got.columns, strict=True))
        table = lambda name: np.asarray(column[name].flatten()).reshape(-1, size)  # noqa: B023, E731
        share = table("__share")
        less = {by: np.maximum(table(f"sum{by}") - share, 0) for by in ("__host", "__domain", "__suffix", "__declared")}
        rest = np.maximum(whole - share, 0)
        total = lambda x: x.sum(1, keepdims=True)
        base = (rest + 1) / (total(rest) + size)
        domain = (less["__domain"] + pull * base) / (total(less["__domain"]) + pull)
        prior = (less["__host"] + pull * domain) / (total(less["__host"]) + pull)
        # the chance of the page's value in each language, up to a factor that all share
        given = [np.log((less[by] + 1) / (rest + pull)) for by in ("__declared", "__suffix")]
        logs = np.log(np.maximum(share, 1e-300)) + np.log(prior) + given[0] + given[1]
        confidence = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        best = [pa.array(names[x.argmax(1)], pa.string()) for x in (logs, share)]
        fused = [best[0], pa.array(confidence), best[1], *[column[x].cast(pa.string()) for x in ("__declared", "__suffix", "__host")]]
        kept = got.schema.names.index("__host")
        yield pa.RecordBatch.from_arrays([*got.columns[:kept], pa.StructArray.from_arrays(fused, fields=list(kind))], names=[*got.schema.names[:kept], out])


def identify(
    spark: SparkSession, pages: DataFrame, model: tuple[list[str], np.ndarray], url_col: str = "url", html_col: str = "html", weight: int = 48, pull: float = 10.0, out: str = "language", plain: bool = False
) -> DataFrame:
    """All columns of `pages` but the page itself, which is not passed on, and `out` (in place of a column
    of that name, in any case): a struct of lang, confidence, text_lang, declared, suffix and host. model: of `fit`. pull: how many pages a coarser level counts as.
    plain: the pages are plain text; nothing in it is markup, and it declares nothing."""
    langs, chances = model
    size = len(langs)
    kept = [c for c in pages.columns if c.lower() not in (out.lower(), html_col.lower())]
    name = host(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = pages.select(*kept, utf8(html_col).alias("__html")).withColumn("__host", name).withColumn("__domain", F.substring_index("__host", ".", -2)).withColumn("__suffix", F.substring_index("__host", ".", -1))
    rows = rows.select(*[c for c in rows.columns if c != "__html"], "__html")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    seen = rows.mapInArrow(partial(_evidence, chances, weight, plain), f"{kinds}, __declared string, __share array<double>")
    if not size:
        empty = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.col("__declared").alias("declared"), F.col("__suffix").alias("suffix"), F.col("__host").alias("host"))
        return seen.select(*kept, empty.alias(out))
    key = ["__host", "__domain", "__suffix", "__declared"]
    tagged = stored(spark, seen, "evidence")
    cells = stored(spark, tagged.groupBy(*key).agg(*[F.sum(F.col("__share")[k]).alias(f"s{k}") for k in range(size)]), "cells")

    def sums(by: str) -> DataFrame:
        return cells.groupBy(by).agg(F.array(*[F.sum(f"s{k}") for k in range(size)]).alias(f"sum{by}"))

    joined = tagged
    for by in key:  # one row per value of a column that the pages have
        joined = joined.join(sums(by), by)
    whole = cells.agg(*[F.sum(f"s{k}") for k in range(size)]).first()  # a number per language
    joined = joined.select(*kept, *key, "__share", *[f"sum{by}" for by in key])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*kept).schema.fields)
    fused = "struct<lang: string, confidence: double, text_lang: string, declared: string, suffix: string, host: string>"
    work = partial(_fused, langs, np.array([x or 0.0 for x in whole]), pull, out)
    return joined.mapInArrow(work, f"{kinds}, `{out}` {fused}" if kinds else f"`{out}` {fused}")
