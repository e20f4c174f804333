"""The eight tables as a parquet store that knows its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.constraints import TABLES, Table, all_violations


KEY, REFERENCE, REQUIRED = "key", "references", "required"


def with_keys(table: Table, frame: DataFrame) -> DataFrame:
    """The frame with its declared keys as metadata of its columns: place in the primary key, column of a parent
    table, and whether a value is required. Spark writes them into the files and reads them back."""
    parents = {fk.column: f"{fk.parent}({fk.parent_column})" for fk in table.foreign_keys}

    def declared(name: str) -> dict:
        out: dict = {REQUIRED: name in table.required}
        if name in table.primary_key:
            out[KEY] = table.primary_key.index(name) + 1
        if name in parents:
            out[REFERENCE] = parents[name]
        return out

    return frame.select(*[F.col(c).alias(c, metadata=declared(c)) for c in frame.columns])


def write_store(tables: dict[str, DataFrame], folder: str, check: bool = True) -> None:
    """Replace the store, parents before children. Refuses tables that break a constraint."""
    if check:
        broken = all_violations(tables).filter("n_violations > 0").collect()
        if broken:
            raise ValueError("constraint violations: " + "; ".join(str(row.asDict()) for row in broken))
    for table in TABLES:
        stored = with_keys(table, tables[table.name])
        stored.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{table.name}")


def read_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t.name: spark.read.parquet(f"{folder.rstrip('/')}/{t.name}") for t in TABLES}


def table_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """tbl, position, name, type, required, key_position, parent of every column, as the tables of a store say
    themselves. `required` is NULL for a table that was not written as part of a store."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.metadata.get(REQUIRED), f.metadata.get(KEY), f.metadata.get(REFERENCE))
        for name, frame in tables.items()
        for i, f in enumerate(frame.schema.fields, 1)
    ]
    kinds = "tbl string, position int, name string, type string, required boolean, key_position int, parent string"
    return spark.createDataFrame(rows, kinds)


def key_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """tbl, primary_key, foreign_keys, as the tables of a store say themselves."""

    def listed(condition, order, text):
        held = F.array_sort(F.collect_list(F.when(condition, F.struct(order, text.alias("text")))))
        return F.transform(held, lambda x: x["text"])

    key = listed(F.col("key_position").isNotNull(), F.col("key_position"), F.col("name"))
    edge = listed(F.col("parent").isNotNull(), F.col("position"), F.concat("name", F.lit(" -> "), "parent"))
    columns = table_columns(tables).groupBy("tbl")  # one row per column of the store
    return columns.agg(F.array_join(key, ", ").alias("primary_key"), F.array_join(edge, "; ").alias("foreign_keys"))


def store_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct keys and total key length per table: what a round trip must preserve."""
    frames = []
    for table in TABLES:
        key = F.concat_ws("|", *table.primary_key)
        frames.append(
            tables[table.name]
            .agg(
                F.count("*").alias("n_rows"),
                F.sum(F.length(key)).alias("key_chars"),
                F.min(key).alias("first_key"),
                F.max(key).alias("last_key"),
            )
            .select(F.lit(table.name).alias("tbl"), "*")
        )
    profile = frames[0]
    for frame in frames[1:]:
        profile = profile.unionByName(frame)
    return profile
