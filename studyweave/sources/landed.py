"""Landed files of a clinical data service: study listing pages, rosters, clinical records.

All pages or responses of a folder are read at once; Spark reads the files in parallel. Responses
lie in one sub-folder per study (``study=<id>``), which names the study where a record does not.

A study of which a file cannot be read to its end is left out whole and reported (`study_states`); the
others are not affected. A listing with missing or short pages is reported (`listing_pages`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cohort import fill_schema, of_studies
from ..operators.joins import lookup_join
from ..workspace import written_whole

LISTING_SCHEMA = "studyId string, name string, cancerTypeId string"
ROSTER_SCHEMA = "studyId string, patientId string"
CLINICAL_SCHEMA = (
    "studyId string, patientId string, sampleId string, clinicalAttributeId string, attrId string, "
    "value string, dataLevel string"
)
RECORD_SCHEMA = (
    "study_id string, patient_id string, sample_id string, attr_id string, value string, data_level string"
)
BAD = "_corrupt_record"
#: The number of a page in the name of its file or folder.
PAGE = r"page[=_-]?(\d+)"
COMPRESSED = ("gz", "bz2", "deflate", "snappy", "lz4", "zst")
#: Compressed files of at most so many bytes, and those that Spark would split, are taken whole, as one row each.
WHOLE_BYTES, SPLITTABLE = 1 << 16, "bz2"
#: Three signs at which a larger one is cut; each is in every line of records, so pieces stay short.
CUTS = ("\n", "{", "}")


def flatten(frame: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs to top-level columns named by their path."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return frame.select(
        *[
            F.col(".".join(f"`{part}`" for part in path)).alias(separator.join(path))
            for path in leaves(frame.schema, ())
        ]
    )


def read_listing(
    spark: SparkSession, folder: str, schema: str = LISTING_SCHEMA, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(studies, quarantine): the union of all listing pages, and the texts that could not be read or do
    not name a study (the first column of `schema`).

    Each line is a study or an array of them, and large files can be split. With `multi_line` a page
    is one JSON array over any number of lines, and one task reads it. An empty page adds nothing.
    """
    pages = (
        spark.read.schema(f"{schema}, {BAD} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("multiLine", multi_line)
        .json(folder)
    )
    names = T.StructType.fromDDL(schema).names
    bad = F.col(BAD).isNotNull() | F.col(names[0]).isNull()
    text = F.coalesce(BAD, F.to_json(F.struct(*names))).alias(BAD)
    return flatten(pages.filter(~bad).select(*names)), pages.filter(bad).select(text)


def listing_pages(
    spark: SparkSession,
    folder: str,
    page_size: int,
    schema: str = LISTING_SCHEMA,
    multi_line: bool = False,
    pattern: str = PAGE,
) -> DataFrame:
    """page, n_rows, state of all pages from number 0 to the last one that landed.

    `missing`: no file has this number. `short`, `over`: fewer or more entries than `page_size`, before the
    last page. `whole`: as many. The last page is `last` if it has fewer, as it then ends the listing, and
    `open` if not: another page may have been there. A file without a number counts as a page without one
    (`unnumbered`). Entries that cannot be read count, too.
    """
    rows = (
        spark.read.schema(f"{schema}, {BAD} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("multiLine", multi_line)
        .json(folder)
    )
    key = T.StructType.fromDDL(schema).names[0]
    # the count of the key makes the reader look into the lines, which may hold several entries
    entries = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.count(key).alias("named")
    )
    number = F.regexp_extract("file", f".*{pattern}", 1).try_cast("bigint")
    found = _files(spark, folder).join(entries, "file", "left").groupBy(number.alias("page"))
    counts = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    numbered = counts.filter(F.col("page").isNotNull())
    last = numbered.agg(F.max("page").alias("last"))
    every = last.select("last", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("page"))
    size = F.lit(page_size)
    n_rows, end = F.coalesce("n_rows", F.lit(0)), F.col("page") == F.col("last")
    state = (
        F.when(F.col("n_rows").isNull(), "missing")
        .when(n_rows > size, "over")
        .when(end, F.when(n_rows < size, "last").otherwise("open"))
        .when(n_rows < size, "short")
        .otherwise("whole")
    )
    states = every.join(numbered, "page", "left").select("page", n_rows.alias("n_rows"), state.alias("state"))
    stray = counts.filter(F.col("page").isNull())
    return states.unionByName(stray.select("page", "n_rows", F.lit("unnumbered").alias("state")))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """file, size of all files, those without rows as well; their content is not read."""
    listed = spark.read.format("binaryFile").load(folder)
    return listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def _texts(spark: SparkSession, folder: str, **how) -> DataFrame:
    """The texts of the files that can be read, as far as they can."""
    return spark.read.schema("value string").option("ignoreCorruptFiles", True).text(folder, **how)


def _packed(spark: SparkSession, folder: str, whole: bool, **how) -> DataFrame:
    """The texts of those compressed files that are taken whole, or of the others, which Spark then leaves unread."""
    small = F.col("_metadata.file_size") <= WHOLE_BYTES
    at_once = small | F.col("_metadata.file_name").endswith(f".{SPLITTABLE}")
    texts = _texts(spark, folder, pathGlobFilter=f"*.{{{','.join(COMPRESSED)}}}", **how)
    return texts.filter(at_once if whole else ~at_once)


def file_states(spark: SparkSession, folder: str) -> DataFrame:
    """study, file, size, state of every file: `read`, `empty` (blanks and line ends only), or `failed` if it cannot be
    read to its end. Files without a byte are not listed by Spark, and so not here.

    Plain files are read line by line and their bytes counted: a read that broke off has fewer than the file.
    A compressed file does not tell how much it holds. It is read piece by piece, cut at a sign, with each of three signs, and
    the bytes of the pieces are counted, with one more for each cut. Read to its end, it has the same count by every sign
    but the one it may end in, which has one less. A read that broke off loses what follows the last cut, so the three
    counts differ. Nothing is held but one piece. Files too small for that are taken whole, as one row, and there is no row if
    one breaks off; so are those of the kind that Spark splits (bz2), which should hold under a gigabyte each.
    """
    file, held = F.col("_metadata.file_path").alias("file"), F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0
    n_bytes = F.sum(F.octet_length("value") + 1)
    lines = _texts(spark, folder, lineSep=CUTS[0]).groupBy(file).agg(n_bytes.alias("bytes"), F.count_if(held).alias("n"))
    whole = _packed(spark, folder, True, wholetext=True).groupBy(file).agg(F.count_if(held).alias("unpacked"))
    cuts = [_packed(spark, folder, False, lineSep=sign).groupBy(file).agg(n_bytes.alias("cut")) for sign in CUTS[1:]]
    by_cut = cuts[0].unionByName(cuts[1]).groupBy("file").agg(F.array_agg("cut").alias("cuts"))

    packed = F.element_at(F.split("file", r"\."), -1).isin(*COMPRESSED)
    taken_whole = (F.col("size") <= WHOLE_BYTES) | F.col("file").endswith(f".{SPLITTABLE}")
    # a sign that does not occur before the break gives no row, and counts nothing
    none = F.array_repeat(F.lit(0).cast("bigint"), 2)
    counts = F.array_sort(F.concat(F.array(F.coalesce("bytes", F.lit(0))), F.coalesce("cuts", none), none))
    least, middle, most = (F.element_at(counts, k) for k in (-3, -2, -1))
    at_end = (most > 0) & (middle == most) & (least >= most - 1)
    # the last line may end without a mark, and a byte order mark is not part of a line
    broken = F.when(packed & taken_whole, F.col("unpacked").isNull()).when(packed, ~at_end)
    broken = broken.otherwise(F.coalesce("bytes", F.lit(0)) + 4 <= F.col("size"))
    empty = F.when(packed & taken_whole, F.col("unpacked")).otherwise(F.col("n")) == 0
    state = F.when(broken, "failed").when(empty, "empty").otherwise("read")
    study = F.regexp_extract("file", "/study=([^/]*)/", 1)
    for _ in range(2):  # Spark escapes signs in folder names, and a path's signs once more
        study = F.coalesce(F.try_url_decode(F.replace(study, F.lit("+"), F.lit("%2B"))), study)
    files = _files(spark, folder).join(lines, "file", "left").join(whole, "file", "left").join(by_cut, "file", "left")
    return files.select(study.alias("study"), "file", "size", state.alias("state"))


def study_states(spark: SparkSession, folder: str) -> DataFrame:
    """study, n_files, n_failed, state of every folder: `failed` if one of its files is, `empty` if all are."""
    count = lambda state: F.count_if(F.col("state") == state)
    counts = file_states(spark, folder).groupBy("study").agg(
        F.count("*").alias("n_files"), count("failed").alias("n_failed"), count("read").alias("_read")
    )
    state = F.when(F.col("n_failed") > 0, "failed").when(F.col("_read") == 0, "empty").otherwise("read")
    return counts.select("study", "n_files", "n_failed", state.alias("state"))


def _read_lines(spark: SparkSession, folder: str, schema: str, states: DataFrame | None) -> DataFrame:
    """All lines of the studies whose files can be read to their end."""
    lines = (
        spark.read.schema(f"{schema}, {BAD} string, study string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("ignoreCorruptFiles", True)
        .json(folder)
    )
    states = study_states(spark, folder) if states is None else states
    failed = states.filter("state = 'failed'").select("study")
    return lookup_join(lines, failed, ["study"], "left_anti")


def read_roster(spark: SparkSession, folder: str, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(roster, quarantine): one row per study and patient, and the lines that could not be read. Studies with a
    failed file are in neither; `states`, if given, is what `study_states` found."""
    lines = _read_lines(spark, folder, ROSTER_SCHEMA, states)
    bad = F.col(BAD).isNotNull() | F.col("patientId").isNull()
    roster = lines.filter(~bad).select(
        F.coalesce("studyId", "study").alias("study_id"), F.col("patientId").alias("patient_id")
    )
    return roster.distinct(), lines.filter(bad).select("study", BAD)


def read_clinical(spark: SparkSession, folder: str, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine). Records have the six columns whatever variant a response came in; a
    line that names no patient or no attribute is no record. Studies with a failed file are in neither."""
    lines = _read_lines(spark, folder, CLINICAL_SCHEMA, states)
    nameless = F.col("patientId").isNull() | F.coalesce("clinicalAttributeId", "attrId").isNull()
    bad = F.col(BAD).isNotNull() | nameless
    return repair_clinical(lines.filter(~bad).drop(BAD)), lines.filter(bad).select("study", BAD)


def repair_clinical(frame: DataFrame) -> DataFrame:
    """Alternate attribute name, default study, default sample, level told by the sample."""
    none = F.lit(None).cast("string")
    filled = fill_schema(
        frame,
        {c: none for c in ("studyId", "study", "sampleId", "clinicalAttributeId", "attrId", "dataLevel")},
    )
    level = F.when(F.col("sampleId").isNull(), "PATIENT").otherwise("SAMPLE")
    return filled.select(
        F.coalesce("studyId", "study").alias("study_id"),
        F.col("patientId").cast("string").alias("patient_id"),
        F.col("sampleId").cast("string").alias("sample_id"),
        F.coalesce("clinicalAttributeId", "attrId").alias("attr_id"),
        F.col("value").cast("string").alias("value"),
        F.coalesce("dataLevel", level).alias("data_level"),
    )


def cached_records(
    spark: SparkSession, folder: str, build, studies: DataFrame, schema: str = RECORD_SCHEMA
) -> DataFrame:
    """Records from the cache folder, of the current studies only. A folder that is absent, or whose
    write was broken off, is built first.

    Both ways read with the declared schema, as a study id that looks like a number would else become
    one. Rows are rebalanced by study before the write: small studies share a task, a study that holds
    much of the data is split over several.
    """
    columns = T.StructType.fromDDL(schema).names
    if not written_whole(spark, folder):
        fresh = build().select(*columns).hint("rebalance", "study_id")
        fresh.write.mode("overwrite").partitionBy("study_id").parquet(folder)
    return of_studies(spark.read.schema(schema).parquet(folder).select(*columns), studies)
