"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"
# A word: a maximal run of characters other than space and the five ASCII line and tab controls.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns never clash with them."""
    return F.struct(*[quoted(c).alias(c) for c in df.columns]).alias(ROW)


def unpacked(df: DataFrame, names: Sequence[str], new: Mapping[str, Column]) -> DataFrame:
    """The packed columns again, then the new ones; a new column replaces an old one of its name."""
    taken = {c.lower() for c in new}
    old = [F.col(ROW).getField(c).alias(c) for c in names if c.lower() not in taken]
    return df.select(*old, *[v.alias(k) for k, v in new.items()])


def key_number(*parts: Column) -> Column:
    """A stable hash in 0 .. 2^60 - 1: the first 15 hex digits of the MD5 of the parts (null: empty), joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def words_in(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def bucket_bits(rows: int, per_bucket: int) -> int:
    """How many leading bits of a key make buckets of about `per_bucket` rows."""
    return max(0, (max(rows, 1) // per_bucket).bit_length())
