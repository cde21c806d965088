"""Sharding by weighted rendezvous hashing of stable record keys, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import ROW, bucket_bits, key_number, packed, quoted, unpacked
from tidemark.session import cut_lineage

# Rows of one shard that one range of keys holds on average: what a task numbers at a time.
RANGE_ROWS = 4096


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose -ln(u) / weight is least, u in (0, 1) from the MD5 of 'key:shard'. A shard that joins takes rows
    only into itself, and one that leaves gives its rows to the others by weight."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    draws = []
    for shard, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(name, F.lit(f":{shard}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("at"), F.lit(shard).alias("shard")))
    return F.least(*draws).getField("shard") if len(draws) > 1 else F.lit(0)


def assign_shards(
    docs: DataFrame, *, shards: int = 40, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row with size (UTF-8 bytes of the text plus 16), text_crc32, law ('key'), shard, slot (its place in the
    shard, from 0 without gaps) and grown_shard (its shard if there were one more, of weight 1).

    The shard depends on the key and the weights alone. Places come from counts by shard and range of the key's hash:
    their prefix sums are added to the place inside the range, so no shard is sorted as a whole.

    A null text has size 16 and the crc32 of no bytes, 0; rows with a null key share the shard of the empty key; rows
    equal in every column take neighbouring slots; an empty table gives an empty result; columns named as a result's are
    replaced.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    names = docs.columns
    rows = docs.select(
        packed(docs),
        quoted(key).alias("key"),
        key_number(quoted(key)).alias("number"),
        rendezvous_shard(quoted(key), weights).alias("shard"),
        rendezvous_shard(quoted(key), [*weights, 1.0]).alias("grown"),
    )
    bits = bucket_bits(docs.count() // max(1, len(weights)), RANGE_ROWS)
    rows = rows.withColumn("range", F.shiftrightunsigned("number", 60 - bits))
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    body = F.coalesce(F.col(ROW).getField(text), F.lit(""))
    rows = rows.withColumn("size", (F.octet_length(body) + 16).cast("long")).withColumn("crc", F.crc32(F.encode(body, "UTF-8")))
    rows = rows.join(cut_lineage(counts), ["shard", "range"])
    place = F.row_number().over(W.partitionBy("shard", "range").orderBy("number", "key", "crc", "size"))
    rows = rows.withColumn("slot", F.col("before") + place - 1)
    return unpacked(
        rows,
        names,
        {
            "size": F.col("size"),
            "text_crc32": F.col("crc"),
            "law": F.lit("key"),
            "shard": F.col("shard"),
            "slot": F.col("slot"),
            "grown_shard": F.col("grown"),
        },
    )
