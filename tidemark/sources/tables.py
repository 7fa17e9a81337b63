"""Reading, typing, naming, appending and exporting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import SCHEMAS


def schema_of(name_or_ddl: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS.get(name_or_ddl, name_or_ddl))


# Quotes inside a field are doubled, blanks belong to the field, an empty field is NULL,
# names in the header must be the declared ones, and a row that does not fit fails the read.
CSV_READ = {"header": True, "enforceSchema": False, "nullValue": "", "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
REJECTED = "_rejected"


def read_table(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header row under a declared schema (a table name or DDL).

    Nothing is inferred. With `multi_line` quoted fields may hold line breaks; a
    file is then read by one task.
    """
    return spark.read.schema(schema_of(schema)).options(**CSV_READ, multiLine=multi_line).csv(path)


def rejected_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """One row: rows of a CSV table that fit the schema, and rows that do not."""
    declared = schema_of(schema)
    kept = T.StructType([*declared.fields, T.StructField(REJECTED, T.StringType())])
    options = CSV_READ | {"mode": "PERMISSIVE", "multiLine": multi_line, "columnNameOfCorruptRecord": REJECTED}
    rows = spark.read.schema(kept).options(**options).csv(path)
    # Whether a row fits shows only when all its columns are parsed, so that the
    # result depends on a print of them.
    parsed = F.bit_xor(F.xxhash64(*[F.col(f"`{f.name}`") for f in declared.fields])).alias("_print")
    rejected = F.col(REJECTED).isNotNull()
    counts = rows.agg(F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected"), parsed)
    return counts.where("_print is not null or accepted + rejected = 0").drop("_print")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select and cast the declared columns that the frame has."""
    fields = [f for f in schema_of(schema).fields if f.name in df.columns]
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Change column types; a value that cannot be read becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def rejected_values(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column, how many non-NULL values the cast would lose."""
    lost = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()
    ]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rejected")) for c in types]
    return df.agg(*lost).select(F.inline(F.array(*cells)))


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def append_load(df: DataFrame, path: str) -> int:
    """Append to a Parquet table; the row count comes with the same job."""
    receipt = Observation()
    df.observe(receipt, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return receipt.get["n"]


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def export(df: DataFrame, cols: Sequence[str], path: str) -> str:
    """Write the chosen columns as CSV files with a header, one per task; fields keep their blanks."""
    df.select(*cols).write.mode("errorifexists").options(**CSV_WRITE).csv(path)
    return path
