"""Judges URLs: by a list of rules, and where none fits by mined association rules.

A listed rule holds for its host and all subdomains of it, if the path starts with the rule's path; the longest
wins (host and path together; of equal ones, block). The labels to learn from are these verdicts and, for
URLs that no listed rule decides, given ones (of several for an id, block).

From labelled URLs Spark's FP-growth mines combinations of URL tokens that come with `block`: in at least a share
of `support` of the rows, `least` rows, and with `confidence`. Each label and set of tokens that is more general, and no less sure,
prunes the longer one. A URL without a listed rule is blocked if all tokens of a mined rule are in it. Rules
meet URLs through an inverted index: each rule lies under its rarest token, which joins the URLs' tokens.

All steps are DataFrame operations. Equal combinations of tokens are judged once, so a host with a third of
all rows costs one row. A null URL, or one without `://`, has empty host and path, no token, and is allowed
unless a rule fits. Tables without labels of a kind give no mined rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import others, stored

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "verdict="


def host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url, at), "/", 1), "?", 1), "#", 1)
    return F.when(at > 0, F.translate(rest, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lit(""))


def _after(url: Column, at: Column) -> Column:
    return F.substr(url, at + 3, F.greatest(F.length(url) - at - 2, F.lit(0)))


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring_index(F.substring_index(_after(url, at), "#", 1), "?", 1)
    slash = F.instr(rest, "/")
    return F.when((at > 0) & (slash > 0), F.substr(rest, slash, F.length(rest))).otherwise(F.lit(""))


def tokens(url: Column) -> Column:
    """What a URL is made of: host suffixes of one to three labels and the whole host, words of host and path, names of
    parameters."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    levels = F.array_append(F.sequence(F.lit(1), F.least(n, F.lit(3))), n)
    suffixes = F.transform(levels, lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "[^\\p{L}\\p{N}]+"))), lambda x: F.concat(F.lit("name:"), x))
    parts = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    found = F.array_distinct(F.concat(suffixes, words, parts, names))
    return F.when(F.instr(url, "://") > 0, F.filter(found, lambda x: ~x.rlike("^[a-z]+:$"))).otherwise(F.array().cast("array<string>"))


def listed(hosts: Column, paths: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of a host and path; rules are (verdict, host, path), few and given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((hosts == name) | F.endswith(hosts, F.lit(f".{name}"))) & F.startswith(paths, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, least: int = 20) -> DataFrame:
    """Rules (items, confidence, support) for `block`, from the columns tokens and verdict. A rule rests on a
    share of `support` of the rows and on `least` rows: with few rows, all that occurs would be frequent."""
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), F.col("verdict"))).alias("items"))
    baskets = stored(labelled.sparkSession, baskets, "baskets")
    share = min(1.0, max(support, least / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    sure = model.associationRules.filter(F.element_at("consequent", 1) == f"{LABEL}block")
    rules = stored(labelled.sparkSession, sure.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "rules")
    wide, narrow = rules.alias("wide"), rules.alias("narrow")
    # a rule goes if another of fewer tokens, all of them its own, is as sure; they meet in a token of the shorter
    keyed = narrow.select("items", "confidence", F.explode("items").alias("token"))
    general = wide.select(F.col("items").alias("few"), F.col("confidence").alias("as_sure"), F.col("items")[0].alias("token"))
    worse = keyed.join(general, "token").filter((F.size("few") < F.size("items")) & (F.size(F.array_except("few", "items")) == 0) & (F.col("as_sure") >= F.col("confidence")))
    return rules.join(worse.select("items").distinct(), "items", "left_anti")


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", support: float = 0.005, confidence: float = 0.9, least: int = 20) -> DataFrame:
    """labels: columns id and verdict. Returns all columns of `pages`, and host, path, rule, verdict and mined (the tokens of the surest mined rule that
    fits); columns of those names, in any case, are replaced."""
    own = ("host", "path", "rule", "verdict", "mined")
    plain = pages.select(*others(pages, *own))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    known = plain.withColumn("host", host(url)).withColumn("path", path(url)).withColumn("rule", rule).withColumn("__listed", verdict).withColumn("__tokens", tokens(url))
    labelled = known.select(F.col(id_col).alias("id"), F.col("__tokens").alias("tokens"), F.col("__listed").alias("listed"))
    if labels is not None:
        given = labels.filter(F.col("verdict").isin("allow", "block")).groupBy("id").agg(F.max("verdict").alias("given"))
        labelled = labelled.join(given, "id", "left")
        labelled = labelled.withColumn("listed", F.coalesce("listed", "given"))
    labelled = labelled.filter("listed is not null").select("tokens", F.col("listed").alias("verdict"))
    mined = stored(spark, mine(labelled, support, confidence, least), "mined")
    # open URLs by their combination of tokens, the others spread evenly; a rule waits under its rarest token
    combination, apart = F.xxhash64(F.array_sort("__tokens")), F.xxhash64(F.col(id_col), url, F.lit(1))
    known = known.withColumn("__key", F.when(F.col("__listed").isNull(), combination).otherwise(apart))
    open_ = known.filter(F.col("__listed").isNull()).groupBy("__key").agg(F.first("__tokens").alias("tokens"))
    index = open_.select("__key", "tokens", F.explode("tokens").alias("token"))
    counts = index.groupBy("token").count()
    places = mined.select("items", "confidence", "support", F.explode("items").alias("token")).join(counts, "token")
    rarest = places.groupBy("items", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    hits = index.join(rarest, "token").filter(F.size(F.array_except("items", "tokens")) == 0)
    best = hits.groupBy("__key").agg(F.max_by("items", F.struct("confidence", "support", F.array_join("items", " "))).alias("mined"))
    judged = known.join(best, "__key", "left").withColumn("mined", F.when(F.col("__listed").isNull(), F.col("mined")))
    verdict = F.coalesce("__listed", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*plain.columns, "host", "path", "rule", verdict.alias("verdict"), "mined")
