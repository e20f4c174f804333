"""Writes the derived inputs as the files a data service would leave, for the landed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Workspace


def land_listing(workspace: Workspace, listing: DataFrame, page_size: int = 50) -> str:
    """Listing pages: files of at most `page_size` studies, one study per line. Each tumour study has a
    truncated line on top."""
    folder = workspace.fresh_path("landed_listing")
    whole = listing.select(F.to_json(F.struct(*listing.columns)).alias("value"))
    broken = listing.filter("cancerTypeId = 'luad'").select(
        F.concat(F.lit('[{"studyId": "'), "studyId").alias("value")
    )
    whole.unionByName(broken).write.option("maxRecordsPerFile", page_size).text(folder)
    return folder


def land_pages(workspace: Workspace, listing: DataFrame, page_size: int, lost: int, short: int) -> str:
    """Listing pages by number, one folder each, in the order of the listing's columns. Page `lost` never came,
    page `short` lacks its first entry."""
    folder = workspace.fresh_path("landed_pages")
    # one row per study
    place = F.row_number().over(Window.orderBy(*[F.asc_nulls_first(c) for c in listing.columns])) - 1
    paged = listing.select(
        F.to_json(F.struct(*listing.columns)).alias("value"),
        F.floor(place / page_size).alias("page"),
        (place % page_size).alias("entry"),
    )
    came = paged.filter((F.col("page") != lost) & ~((F.col("page") == short) & (F.col("entry") == 0)))
    came.drop("entry").repartition("page").write.partitionBy("page").text(folder)
    return folder


def _land_lines(lines: DataFrame, folder: str, compression: str = "none") -> str:
    """One folder per study; a study with many lines is spread over several files."""
    written = lines.hint("rebalance", "study").write.mode("overwrite").partitionBy("study")
    written.option("compression", compression).text(folder)
    return folder


def land_broken(workspace: Workspace, lines: DataFrame, name: str, broken: str, empty: str) -> str:
    """Compressed lines (value, study). The last file of study `broken` ends halfway; study `empty` has a file
    with an empty line."""
    folder = _land_lines(lines, workspace.fresh_path(name), "gzip")
    cut_short(workspace.spark, f"{folder}/study={broken}")
    path = workspace.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/study={empty}/part.txt")
    blank = path.getFileSystem(workspace.spark._jsc.hadoopConfiguration()).create(path)
    blank.write(ord("\n"))
    blank.close()
    return folder


def cut_short(spark: SparkSession, folder: str) -> None:
    """Takes away the second half of the last file of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(path) if not f.getPath().getName().startswith(("_", "."))]
    last = max(files, key=lambda f: f.getPath().getName())
    whole, half = last.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_half")
    source, target = fs.open(whole), fs.create(half)
    spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, last.getLen() // 2)
    source.close()
    target.close()
    fs.delete(whole, False)
    fs.rename(half, whole)


def roster_lines(roster: DataFrame) -> DataFrame:
    line = F.to_json(F.struct(F.col("patient_id").alias("patientId")))
    return roster.select(line.alias("value"), F.col("study_id").alias("study"))


def land_roster(workspace: Workspace, roster: DataFrame) -> str:
    """One line per patient. Studies whose id ends in p get a broken line per tenth patient on top."""
    broken = roster.filter("study_id LIKE '%p' AND patient_id LIKE '%0'").select(
        F.concat(F.lit('{"patientId": "'), "patient_id").alias("value"), F.col("study_id").alias("study")
    )
    return _land_lines(roster_lines(roster).unionByName(broken), workspace.fresh_path("landed_roster"))


def clinical_lines(records: DataFrame) -> DataFrame:
    """One line per record. Studies whose id ends in f use the alternate attribute name and leave
    out study and level."""
    full = F.to_json(
        F.struct(
            F.col("study_id").alias("studyId"),
            F.col("patient_id").alias("patientId"),
            F.col("sample_id").alias("sampleId"),
            F.col("attr_id").alias("clinicalAttributeId"),
            "value",
            F.col("data_level").alias("dataLevel"),
        )
    )
    short = F.to_json(
        F.struct(
            F.col("patient_id").alias("patientId"),
            F.col("sample_id").alias("sampleId"),
            F.col("attr_id").alias("attrId"),
            "value",
        )
    )
    line = F.when(F.col("study_id").endswith("f"), short).otherwise(full)
    return records.select(line.alias("value"), F.col("study_id").alias("study"))


def land_clinical(workspace: Workspace, records: DataFrame) -> str:
    return _land_lines(clinical_lines(records), workspace.fresh_path("landed_clinical"))
