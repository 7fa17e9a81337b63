"""JSON text as typed columns, reports of its drift, maps summed by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of JSON values by the type that a variant shows.
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
KINDS = {"STRING": "text", "BOOLEAN": "boolean", "ARRAY": "list", "OBJECT": "object", "VOID": "null"}


def typed_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """The rows with one typed column per field of a JSON object, and `<column>_sound`.

    A field that is absent or does not fit its type is NULL. `<column>_sound` is
    true if the text is JSON, false if it is not, NULL for NULL text. The text is
    parsed once per row.
    """
    parsed = "__parsed"
    out = df.withColumn(parsed, F.try_parse_json(F.col(column)))
    sound = F.when(F.col(column).isNotNull(), F.col(parsed).isNotNull())
    return out.withColumns(
        {name: F.try_variant_get(parsed, f"$.{name}", kind) for name, kind in fields.items()}
        | {f"{column}_sound": sound}).drop(parsed)


def _kind(value: Column) -> Column:
    shown = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    named = F.when(shown.isin(*NUMBERS), "number")
    for short, kind in KINDS.items():
        named = named.when(shown == short, kind)
    return named.otherwise(F.lower(shown))


def field_kinds(df: DataFrame, column: str) -> DataFrame:
    """(field, kind, rows) of the JSON objects in a column.

    Kinds are number, text, boolean, list, object and null. Rows without text, and
    text that is no JSON object, have no fields. Counts combine before the shuffle.
    """
    parsed = df.select(F.try_parse_json(F.col(column)).alias("parsed"))
    parsed = parsed.where(F.schema_of_variant("parsed").startswith("OBJECT"))
    fields = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("parsed").outer()))
    return (fields.select(F.col("key").alias("field"), _kind(F.col("value")).alias("kind"))
            .groupBy("field", "kind").agg(F.count(F.lit(1)).alias("rows")))


def drift(df: DataFrame, column: str, declared: dict[str, str]) -> DataFrame:
    """The fields of a JSON column against declared kinds: (field, kind, rows, state).

    States: `expected`; `other kind` than declared; `new`, not declared; `missing`,
    declared and in no row, with a NULL kind and no rows. A null value of a
    declared field is expected.
    """
    spark = df.sparkSession
    known = spark.createDataFrame(list(declared.items()), "field string, wanted string")
    found = field_kinds(df, column).join(F.broadcast(known), "field", "full")
    state = (F.when(F.col("kind").isNull(), "missing").when(F.col("wanted").isNull(), "new")
             .when(F.col("kind").isin("null") | (F.col("kind") == F.col("wanted")), "expected")
             .otherwise("other kind"))
    return found.select("field", "kind", F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state"))


def sum_maps(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Maps of numbers added up key by key: (*by, key, total, rows).

    Entries become rows and are summed in Spark, so that no group's maps are
    gathered. NULL and empty maps add nothing, a NULL value counts as a row.
    """
    entries = df.select(*by, F.explode(column).alias("key", "value"))
    return entries.groupBy(*by, "key").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("rows"))
