"""Sources and sinks: parquet tables, JSON lines with typed errors, partitioned output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def views(spark: SparkSession, root: str, names: list[str]) -> None:
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def exact_fields(df: DataFrame, fields: set[str]) -> DataFrame:
    """df, if its columns are exactly these; ValueError names what is missing or unknown."""
    have = set(df.columns)
    if have != fields:
        raise ValueError(f"missing fields {sorted(fields - have)}, unknown fields {sorted(have - fields)}")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, most_bytes: int = 16 * 2**20) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the others with their file and reason. Blank lines are skipped."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    parsed = raw.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = F.when(F.length("value") > most_bytes, "too long").when(F.col("row._corrupt").isNotNull(), "not an object of the schema")
    parsed = parsed.withColumn("reason", reason)
    return parsed.where("reason is null").select("row.*").drop("_corrupt"), parsed.where("reason is not null").select("file", "value", "reason")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One shuffle by the partition columns, so that a partition is not a file of every task."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
