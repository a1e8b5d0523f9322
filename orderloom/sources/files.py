"""Files in and out: CSV and JSON Lines catalogs, evaluation sets, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MENU = "id string, name_vi string, name_en string, price string, size string, category string, ingredients string, description string, tags string, available string"
FAQ = "id string, topic string, question string, answer string, language string, source_file string"
CHUNK = "id string, source_file string, chunk_index int, language string, text string, entities array<struct<name:string,type:string,normalized_name:string>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and quoted fields, all columns as declared."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON Lines; blank lines are skipped. strict: a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Policy chunks; a missing list of entities is an empty one."""
    chunks = read_jsonl(spark, path, CHUNK)
    return chunks.withColumn("entities", F.coalesce("entities", F.array().cast(chunks.schema["entities"].dataType)))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def blank_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") == "").count()


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON Lines with null fields left out of no row."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def overwrite(df: DataFrame, path: str) -> None:
    """A table replaced as a whole: reset, wipe and rebuild."""
    df.write.mode("overwrite").parquet(path)


def write_dataset(samples: DataFrame, path: str, keys: list[str], expected: int | None = None) -> DataFrame:
    """Samples as JSON Lines under path/data and their counts by keys as JSON under path/stats, read back and returned; the data written must be as many as expected."""
    write_jsonl(samples, f"{path}/data")
    written = samples.sparkSession.read.schema(samples.schema).json(f"{path}/data")
    stats = written.groupBy(*keys).agg(F.count("*").alias("n"))
    stats.write.mode("overwrite").json(f"{path}/stats")
    n = written.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} samples were written, not {expected}")
    return samples.sparkSession.read.schema(stats.schema).json(f"{path}/stats")
