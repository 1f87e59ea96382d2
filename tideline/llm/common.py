"""What the operators of this subpackage share: scratch tables, worker paths, text hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_workers, scratch_dir as shared_dir

__all__ = ["WORD", "on_workers", "shared_dir", "shuffle_partitions", "stored", "table", "words"]

#: Whitespace between words in the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lineage cut that outlives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text):
    """The words of a text column as an array, by the contracts' white space; empty for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
