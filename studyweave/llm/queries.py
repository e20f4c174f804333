"""The registered queries of the operators; each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, collocations, decontamination, hard_negatives, language, licenses, packing, quality_kernel, quality_rules, simhash, substrings, toxicity, url_rules
from .rows import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(*(_table(spark, sf_dir, name) for name in ("documents", "benchmark")))


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_rules.judge(documents.select("doc_id", "text"), quality_rules.fit(documents, labels)).drop("text")


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "cost",
    )


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether the checksum of an id as text falls in a fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    model = quality_kernel.fit(documents, labels, ~held_out("id", 3, 1))
    return _judged(quality_kernel.score(documents.select("doc_id", "text"), model), held_out("doc_id", 3, 1))


def op6_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    lexicon = toxicity.fit(documents, labels, ~held_out("id", 5, 0))
    return _judged(toxicity.score(documents.select("doc_id", "text"), lexicon), held_out("doc_id", 5, 0))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and documents, which have no markup and whose source stands for the host."""
    pages, documents = (_table(spark, sf_dir, name) for name in ("pages", "documents"))
    model, number = language.fit(documents), F.lit(None).cast("long")
    of_pages = language.identify(spark, pages.select("page_id", number.alias("doc_id"), "url", "html"), model)
    address = F.concat(F.lit("source://"), "source").alias("url")
    plain = documents.select(number.alias("page_id"), "doc_id", address, F.col("text").alias("html"))
    found = [x.select(F.col("page_id").cast("long"), F.col("doc_id").cast("long"), "language.*") for x in (of_pages, language.identify(spark, plain, model, plain=True))]
    return found[0].unionByName(found[1])


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take the label of the same number; one of low quality counts as block."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    given = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "block").when(F.col("quality") == 1, "allow").alias("verdict"))
    judged = url_rules.judge(spark, pages, URL_RULES, given)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.without_repeats(spark, documents)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_tree_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_pairs.encode(documents, ranks, public_tokenizers.PATTERN).drop("text")
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return byte_pairs.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark, rows.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def op13_parsed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), phrases AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) AS sizes(k))
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.k, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.first = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS i FROM candidates, range(2, 4) AS sizes(k) WHERE k < size)
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inner_phrases p ON s.lang = p.lang AND s.phrase = p.phrase
  WHERE p.longer IS NULL OR CAST(100 AS HUGEINT) * p.longer < CAST(80 AS HUGEINT) * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_pigeonhole_decontamination, op2_crf_quality, op3_cost_packing, op4_simhash_bktree, op5_fourier_quality, op6_license_minhash, op7_toxic_lexicon, op8_language_fusion, op9_url_association_rules, op10_suffix_array_dedup, op11_tree_byte_pairs, op12_bond_hard_negatives, op13_parsed_collocations)}
ORACLE_SQL: dict[str, str] = {"op12_bond_hard_negatives": OP12_SQL, "op13_parsed_collocations": OP13_SQL}
