"""Long clinical records derived from the order tables, for tests and benches.

Study = order priority and status, patient = customer, sample = order. The definition is the SQL
of FIXTURES.md section 2; this is the same rows from one pass per entity instead of one per fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fact(attr_id, value, when=None, level="PATIENT") -> Column:
    attr = attr_id if isinstance(attr_id, Column) else F.lit(attr_id)
    text = value if isinstance(value, Column) else F.lit(value)
    fact = F.struct(
        attr.alias("attr_id"), text.cast("string").alias("value"), F.lit(level).alias("data_level")
    )
    return fact if when is None else F.when(when, fact)


def _facts(rows: DataFrame, keys: list[Column], facts: list[Column]) -> DataFrame:
    """A row for each fact that is recorded. A fact that is not is a row without a level and goes after: to filter the
    array would leave generated code."""
    return rows.select(*keys, F.inline(F.array(*facts))).filter(F.col("data_level").isNotNull())


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pri = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.lower("o_orderstatus")
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .select(
            F.concat(F.lit("st_"), F.substring("o_orderpriority", 1, 1), F.lit("_"), status).alias("study_id"),
            pri.alias("pri"),
            status.alias("st"),
            F.col("o_custkey").alias("ck"),
            F.col("o_orderkey").alias("ok"),
            F.floor("o_totalprice").cast("bigint").alias("price"),
        )
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id, patient_id, sample_id, attr_id, value, data_level, as a source would deliver them."""
    orders = visits(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("ck"),
        (20 + (F.col("c_custkey") * 7) % 65).alias("age"),
        F.col("c_mktsegment").alias("seg"),
        F.floor("c_acctbal").cast("bigint").alias("bal"),
    )
    people = orders.select("study_id", "pri", "st", "ck").distinct().join(customers, "ck")

    ck, pri, st, ok = F.col("ck"), F.col("pri"), F.col("st"), F.col("ok")
    age, bal, price = F.col("age"), F.col("bal"), F.col("price")
    odd = pri % 2 == 1

    def text(number):
        return number.cast("string")

    age_text = F.when(ck % 11 == 0, F.lit("[Not Available]")).otherwise(
        F.concat(F.lit(" "), text(age), F.lit(" "))
    )
    receptor = (
        F.when(ck % 13 == 0, "Indeterminate").when(bal % 4 == 0, "Negative").when(odd, "Positive").otherwise("+ve")
    )
    stages = ["Stage I", "STAGE IIA", "Stage IIIB", "STAGE IV", "Stage X", "[Discrepancy]"]
    stage = F.element_at(F.array(*map(F.lit, stages)), (ck % 6 + 1).cast("int"))
    t_stage = F.when(ck % 5 == 4, "TIS").otherwise(F.concat(F.lit("pT"), text(1 + ck % 4), F.lit("a")))
    died = age + bal % 40 + pri * 3 > 80
    patient_facts = [
        _fact(F.when(odd, "AGE").otherwise("AGE_AT_DIAGNOSIS"), age_text),
        _fact("AGE", text(age - 1), ~odd & (ck % 50 == 0)),
        _fact("SEX", "Male", ck % 202 == 0),
        _fact("SEX", F.when(ck % 101 == 0, "Male").otherwise("Female"), level="patient"),
        _fact(
            F.when(odd, "ER_STATUS_BY_IHC").otherwise("ER_IHC"), receptor, (pri < 5) & ~(~odd & (ck % 9 == 0))
        ),
        _fact("AJCC_PATHOLOGIC_TUMOR_STAGE", stage, odd & (st != "p")),
        _fact("PATH_T_STAGE", t_stage, odd & (st == "f")),
        _fact(F.concat(F.lit("SEGMENT_"), text(pri)), F.col("seg"), ck % 3 == 0),
        _fact("OS_STATUS", F.when(died, "1:DECEASED").otherwise("0:LIVING"), ck % 17 != 0),
        _fact("OS_MONTHS", F.when(ck % 19 == 0, "NA").otherwise(text(1 + (ck * 13) % 240))),
    ]
    mutations = F.when(ok % 23 == 0, "Unknown").otherwise(text(price % 97 + pri * pri * 20))
    altered = F.concat(F.lit("0."), F.lpad(text(ok % 100), 2, "0"))
    sample_facts = [
        _fact("MUTATION_COUNT", mutations, level="SAMPLE"),
        _fact("FRACTION_GENOME_ALTERED", altered, st != "o", level="SAMPLE"),
        _fact("TUMOR_STAGE", text(ok % 5), ~odd, level="SAMPLE"),
    ]
    patient_id = F.concat(F.lit("P"), text(ck)).alias("patient_id")
    no_sample = F.lit(None).cast("string").alias("sample_id")
    sample_id = F.concat(F.lit("S"), text(ok)).alias("sample_id")
    of_patients = _facts(people, [F.col("study_id"), patient_id, no_sample], patient_facts)
    of_samples = _facts(orders, [F.col("study_id"), patient_id, sample_id], sample_facts)
    return of_patients.unionByName(of_samples)


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per study and patient. Every visit yields a record, so the visits list them all."""
    return (
        visits(spark, sf_dir)
        .select("study_id", "ck")
        .distinct()
        .select("study_id", F.concat(F.lit("P"), F.col("ck").cast("string")).alias("patient_id"))
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study listing with, per study, entries that must and must not pass the study filter."""
    studies = visits(spark, sf_dir).select("study_id").distinct()
    sid, none = F.col("study_id"), F.lit(None).cast("string")

    def entry(study, name, tag):
        return F.struct(study.alias("studyId"), name.alias("name"), tag.alias("cancerTypeId"))

    entries = F.array(
        entry(sid, F.concat(F.lit("Breast "), sid), F.lit("brca")),
        entry(sid, F.concat(F.lit("Breast "), sid, F.lit(" copy")), F.lit("brca")),
        entry(F.concat(F.lit("untagged_"), sid), F.concat(F.lit("Invasive BREAST "), sid), none),
        entry(F.concat(F.lit("unnamed_"), sid), none, F.lit("BRCA")),
        entry(F.concat(F.lit("lung_"), sid), F.concat(F.lit("Lung "), sid), F.lit("luad")),
        entry(F.concat(F.lit("blank_"), sid), none, none),
    )
    return studies.select(F.inline(entries))
