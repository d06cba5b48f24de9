"""Writing and reading back matrices, histories and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def _has_parquet(spark: SparkSession, path: str) -> bool:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    return bool(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet if there is any, else CSV with a header (a schema saves the inference pass)."""
    if _has_parquet(spark, path):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def append_shard(df: DataFrame, path: str, shard: int) -> None:
    """One shard with features narrowed to float."""
    narrow = [
        F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*narrow).write.mode("append").parquet(f"{path}/shard={shard}")


def merge_shards(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """All shards, the earliest shard of a case winning, with labels attached."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("case_id", "shard")]
    kept = rows.groupBy("case_id").agg(F.min_by(F.struct(*columns), "shard").alias("r")).select("case_id", "r.*")
    return kept.join(labels, "case_id", "left")


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Score history as JSON lines; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_anchors(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_per_user(anchors: DataFrame, order: str) -> DataFrame:
    columns = [c for c in anchors.columns if c != "user_hash"]
    return anchors.groupBy("user_hash").agg(F.max_by(F.struct(*columns), F.struct(order)).alias("r")).select("user_hash", "r.*")


def anchors_of(anchors: DataFrame, user_hash: str) -> DataFrame:
    return anchors.filter(F.col("user_hash") == user_hash)


def append_new_cases(df: DataFrame, path: str, feature_version: str) -> None:
    """Append only cases not written yet; refuse outputs of another feature definition."""
    spark = df.sparkSession
    out = df.withColumn("feature_version", F.lit(feature_version))
    if exists(spark, path):
        done = spark.read.parquet(path)
        other = done.filter(F.col("feature_version") != feature_version).limit(1).count()
        if other:
            raise ValueError(f"{path} holds features of another version than {feature_version}")
        out = out.join(done.select("case_id"), "case_id", "left_anti")
    out.write.mode("append").parquet(path)
