"""Files in and out: CSV directories, TSV and pipe-delimited tables, SQL dumps, Parquet, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.plans.spec import Dataset


def read_csv_dir(spark: SparkSession, folder: str, names: list[str], schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """{name: frame} of folder/<name>.csv; types are inferred where no schema is given."""
    out = {}
    for name in names:
        reader = spark.read.option("header", True)
        schema = (schemas or {}).get(name)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        out[name] = reader.csv(f"{folder}/{name}.csv")
    return out


def read_spec_tables(spark: SparkSession, folder: str, spec: Dataset) -> dict[str, DataFrame]:
    """The spec's tables from CSV with the declared types; file names may differ in case."""
    files = {}
    listing = spark.read.format("binaryFile").load(f"{folder}/*.csv").select("path")  # paths alone: contents are pruned
    for row in listing.collect():
        stem = row["path"].rsplit("/", 1)[-1].removesuffix(".csv")
        files[stem.lower()] = row["path"]
    missing = [t for t in spec.tables if t.lower() not in files]
    if missing:
        raise FileNotFoundError(f"no CSV for {missing} in {folder}")
    return {
        name: spark.read.option("header", True).option("enforceSchema", False).schema(t.schema()).csv(files[name.lower()])
        for name, t in spec.tables.items()
    }


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-delimited lines that end with a pipe; short lines are padded with NULL, long ones cut."""
    padded = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    return spark.read.schema(padded).option("sep", "|").option("mode", "PERMISSIVE").csv(path).drop("_end")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    r"""Tab-separated with a header; \N is NULL and quotes are ordinary characters."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", r"\N").option("quote", "")
    return reader.csv(path)


def read_insert_dump(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    """Rows of ``INSERT INTO table VALUES (...), (...);`` statements of a SQL dump.

    The dump is cut at statements by the reader, and rows and fields by one pattern each: a
    field is a quoted text, with escaped quotes, or anything up to a comma.
    """
    text = spark.read.option("lineSep", ";\n").text(path)
    own = text.where(F.col("value").rlike(rf"(?is)^\s*insert\s+into\s+`?{table}`?[\s(]"))
    values = F.regexp_extract("value", r"(?is)\bvalues\s*(.*)$", 1)
    item = r"'(?:[^'\\]|\\.|'')*'|[^,'()\s][^,'()]*"
    row = rf"\(\s*(?:{item})?(?:\s*,\s*(?:{item})?)*\s*\)"
    rows = own.select(F.explode(F.regexp_extract_all(values, F.lit(row), F.lit(0))).alias("row"))
    fields = F.regexp_extract_all("row", F.lit(item), F.lit(0))
    rows = rows.withColumn("f", fields)

    def value(i: int, kind: T.DataType):
        raw = F.trim(F.get("f", F.lit(i)))
        quoted = raw.startswith("'")
        plain = F.regexp_replace(F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), "''", "'"), r"\\(.)", "$1")
        text = F.when(quoted, plain).when(F.upper(raw) != "NULL", raw)
        return text.try_cast(kind)

    return rows.select(*[value(i, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def union_files(spark: SparkSession, paths: list[str], name: str = "indicator_code") -> DataFrame:
    """One table of CSV files with unlike columns, and each row's file stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    parts = [spark.read.option("header", True).csv(p).withColumn(name, stem) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_as_null(df: DataFrame, markers: tuple[str, ...] = ("?", "")) -> DataFrame:
    """Marker strings become NULL in all text columns."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.trim(F.col(c)).isin(*markers), F.col(c)) for c in text})


def decoded_names(df: DataFrame) -> DataFrame:
    """Columns with URL escapes in their names decoded."""
    from urllib.parse import unquote

    return df.withColumnsRenamed({c: unquote(c) for c in df.columns if "%" in c})


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` makes one part file, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities become null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df.withColumns({c: F.when(~bad(c), F.col(c)) for c in doubles}).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def register(frames: dict[str, DataFrame]) -> None:
    """Temp views by name, for SQL."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
