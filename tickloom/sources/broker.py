"""Broker specification and session scans (semicolon CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.columns import norm_symbol, once

MISSING_MARK = "NO_EXISTE"
# Header of the specification export.
SPEC_COLUMNS = (
    "name", "description", "path", "digits", "point", "spread", "stops_level",
    "tick_value", "tick_size", "contract", "swap_long", "swap_short",
)
SESSION_COLUMNS = ("symbol", "day", "session_from", "session_to")


def _read(spark: SparkSession, path: str, columns) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def clean_specs(raw: DataFrame) -> DataFrame:
    """Drop missing symbols; unreadable numbers become 0; add the normalised symbol."""
    marked = F.concat_ws("|", *[F.col(c) for c in SPEC_COLUMNS]).contains(MISSING_MARK)
    kept = raw.filter(F.col("digits").isNotNull() & (F.trim("digits") != "") & ~marked)
    whole = ("digits", "spread", "stops_level")

    def number(c: str):
        return F.coalesce(F.col(c).try_cast("int" if c in whole else "double"), F.lit(0)).alias(c)

    return kept.select(
        norm_symbol("name").alias("symbol"), "name", "description", "path", *[number(c) for c in SPEC_COLUMNS[3:]]
    )


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return clean_specs(_read(spark, path, SPEC_COLUMNS))


def one_spec_per_symbol(specs: DataFrame) -> DataFrame:
    """Several broker names may share a symbol; the greatest name wins."""
    fields = [c for c in specs.columns if c != "symbol"]
    return specs.groupBy("symbol").agg(F.max_by(F.struct(*fields), "name").alias("s")).select("symbol", "s.*")


def clean_sessions(raw: DataFrame) -> DataFrame:
    """Drop missing symbols and empty sessions; minutes of the day, with 00:00 as an end meaning 24:00."""
    kept = raw.filter(
        F.col("day").isNotNull() & (F.col("day") != MISSING_MARK)
        & F.col("session_from").isNotNull() & (F.col("session_from") != "")
    )

    def minutes(c: str):
        return F.split_part(c, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).cast("int")

    read = once(kept, F.col("symbol").alias("symbol"), F.col("day").alias("day"), minutes("session_from").alias("from_min"), minutes("session_to").alias("end"))
    return read.select(
        "symbol", "day", "from_min",
        F.when((F.col("end") == 0) & (F.col("from_min") > 0), 1440).otherwise(F.col("end")).alias("to_min"),
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return clean_sessions(_read(spark, path, SESSION_COLUMNS))
