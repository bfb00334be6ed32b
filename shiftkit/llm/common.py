"""What the training-data operators share: words, hashes, table access, and code shipping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words: space and the control characters tab to carriage return. Nothing
#: else separates words (a no-break space does not).
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty. Python's ``bytes.split()`` then cuts at exactly SPACE."""
    return F.coalesce(text, F.lit("")).cast("binary")


def hash128(c: Column) -> Column:
    """A 128-bit key as a struct of two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def ship_by_value() -> None:
    """Let task functions of this package travel inside the plan, so workers need no installed copy."""
    import shiftkit
    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(shiftkit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the folder may be remote)."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")
