"""Access to free tags, kept either as a map column or as one column per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(df: DataFrame, key: str) -> Column:
    """The value of a tag: from the column of that name, else from `tags`, else NULL."""
    if key in df.columns:
        return F.col(f"`{key}`")
    if "tags" in df.columns:
        return F.col("tags")[key]
    return F.lit(None).cast("string")


def tag_map(*keys: str) -> Column:
    """A map of the given columns, without the empty ones."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in keys])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def clean(value: Column) -> Column:
    """Tag text with missing values as the empty string."""
    return F.coalesce(F.trim(value), F.lit(""))


def any_of(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> Column:
    """True when some key has one of its wanted values."""
    found = F.lit(False)
    for key, values in wanted.items():
        found = found | F.coalesce(tag(df, key).isin(*values), F.lit(False))
    return found
