"""Five operators in a row over `documents`: each stage works on what the one before it kept.

Null texts are treated as empty ones by all stages, and stay null up to the last. Rows are judged one by one, so null or repeated
ids do no harm; of linked near copies the first by id, then text, stays. An empty table passes through, and without labels
or benchmark items nothing is rejected for them. Other columns are kept up to the last stage; `n_chars`, if
there, follows the text. Names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyweave.llm import decontamination, packing, simhash, substrings, toxicity
from studyweave.llm.queries import held_out
from studyweave.llm.rows import ship, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.5 go. The lexicon is learned as in the registered query."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    lexicon = toxicity.fit(docs, labels, ~held_out("id", 5, 0))
    return toxicity.score(docs, lexicon, out="__score").filter("__score < 0.5").drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    ship(spark)
    keyed = substrings.keyed(spark, docs, "doc_id", "text")
    near = simhash.near_duplicates(spark, keyed.select("__key", "__text"), "__key", "__text", words=3, radius=2)
    stay = near.filter("`__key` = component_id").select("__key")
    return keyed.join(stay, "__key", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier 100-byte string go; what is left of a cut character goes, too."""
    ship(spark)
    cut = substrings.without_repeats(spark, docs, characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    changed = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return changed.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, up to the edits allowed, go."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.mark(docs, benchmark, out="__leaks").filter(F.size("__leaks") == 0).drop("__leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, fingerprints, edit distances and a tokenizer are not for SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
