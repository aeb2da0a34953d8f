"""Labels, words and stable random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(c: Column) -> Column:
    """Lower case without outer white space; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(c), "^\\s+|\\s+$", ""), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)\\s+"), lambda x: x != "")


def shuffle_key(seed: int, id_col: Column, *salt: Column) -> Column:
    """A key that puts rows in a random order which any engine reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in salt), id_col.cast("string")))


def accent_column(df: DataFrame) -> str | None:
    return next((c for c in ("accent", "locale") if c in df.columns), None)
