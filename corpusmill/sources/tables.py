"""Readers and writers by format name; a registry takes more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, path, **o: spark.read.options(**o).parquet(path),
    "json": lambda spark, path, **o: spark.read.options(**{"mode": "DROPMALFORMED"} | o).json(path),
    "csv": lambda spark, path, **o: spark.read.options(**{"header": True, "inferSchema": False} | o).csv(path),
    "xml": lambda spark, path, **o: spark.read.options(**{"rowTag": "row"} | o).format("xml").load(path),
    "text": lambda spark, path, **o: spark.read.options(**o).text(path),
}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    READERS[name] = reader


def read(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return READERS[name](spark, path, **options)


def write(df: DataFrame, name: str, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    options = {"header": "true"} if name == "csv" else {"rowTag": "row"} if name == "xml" else {}
    df.write.format(name).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in place of those that have the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (id and content hash, say) have not been processed."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def ntriples(df: DataFrame, subject: str, prefix: str) -> DataFrame:
    """One line for each non-null value of a row."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{prefix}"), F.col(subject).cast("string"), F.lit(f"> <{prefix}{c}> "), F.to_json(F.array(F.col(c).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c).cast("string")))) - 2), F.lit(" ."))) for c in df.columns if c != subject]
    return df.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("value"))
