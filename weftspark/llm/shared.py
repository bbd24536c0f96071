"""What the operators here share: the shared folder, written tables, ASCII text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.session import scratch_path

#: The white space of every contract here: space and code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a Java pattern: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the folder that driver and executors share."""
    return scratch_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and its size is known."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run, in a folder of its own, that can go before the run ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, fresh_path(spark, name)
        self.paths: dict[str, list[str]] = {}
        self.tables: dict[str, list[str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table, see ``written``."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_dealt(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """``df`` as a table bucketed by a column: joins on it read both sides without a shuffle."""
        path, table = f"{self.folder}/{name}-{uuid.uuid4().hex}", f"weft_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
        self.paths.setdefault(name, []).append(path)
        self.tables.setdefault(name, []).append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, which nothing will read again."""
        for name in names:
            for table in self.tables.pop(name, []):
                self.spark.sql(f"drop table {table}")
            for path in self.paths.pop(name, []):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` alone would fold other letters too."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on same-named columns in which null meets null; the right keys go."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in by])
