"""Line dedup: hashes of lines, partitioned by range and sorted by document and position, give the first occurrences; what
comes back is a keep bitmap for each document, in runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import ROW, packed, quoted, unpacked
from tidemark.session import cut_lineage

# White space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
# A key is hot from 1 / HOT_SHARE of all lines on, so at most HOT_SHARE keys are; below HOT_ROWS lines none is.
HOT_SHARE, HOT_ROWS = 4096, 1024
# Leading bits of a hash by which lines are counted first; only buckets that could hold a hot key are counted by key.
BUCKET_BITS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    """The lines between line feeds (null or empty: one empty line)."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without the white space at its ends, A-Z lower-cased."""
    key = F.btrim(line, F.lit(BLANKS))
    # Where all is ASCII, lower() does the same at a fraction of the cost.
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _UPPER.lower()))


def _text_number(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keyed_lines(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(h1, h2, id, tk, pos) of every line whose key is long enough: 120 bits of the key's SHA-256, the document's id, a
    number of its text, the line's place."""
    rows = docs.select(quoted(doc_id).alias("id"), _text_number(quoted(text)).alias("tk"), F.posexplode(lines_of(quoted(text))).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    rows = rows.withColumn("sha", F.sha2("key", 256))
    part = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return rows.select(part(1).alias("h1"), part(16).alias("h2"), "id", "tk", "pos")


def _hot_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, first): the keys of at least 1 / HOT_SHARE of all lines with their smallest id; at most HOT_SHARE rows."""
    bucket = F.shiftrightunsigned("h1", 60 - BUCKET_BITS).alias("bucket")
    counts = cut_lineage(lines.groupBy(bucket).agg(F.count("*").alias("n")))
    floor = max(HOT_ROWS, -(-(counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE))
    heavy = F.broadcast(counts.where(F.col("n") >= floor).select("bucket"))
    some = lines.withColumn("bucket", bucket).join(heavy, "bucket", "left_semi")
    hot = some.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return cut_lineage(hot.where(F.col("n") >= floor).select("h1", "h2", "first"))


def _dropped_places(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(id, tk, gone): for each document that loses lines their places, ascending."""
    lines = cut_lineage(_keyed_lines(docs, text, doc_id, least))
    hot = _hot_keys(lines)
    joined = lines.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["h1", "h2"], "left")
    # A hot key's lines are decided where they are read; all others meet in their range, in order.
    settled = joined.where(F.col("hot"))
    within = W.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), "tk", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranged = joined.where(F.col("hot").isNull()).drop("first", "hot").repartitionByRange("h1")
    ranged = ranged.withColumn("first", F.first("id").over(within))
    later = ~F.col("id").eqNullSafe(F.col("first"))
    gone = settled.where(later).select("id", "tk", "pos").union(ranged.where(later).select("id", "tk", "pos"))
    return gone.groupBy("id", "tk").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 10, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """The given columns (default: all but the text) with n_lines, n_dropped and keep, a bitmap of the lines that stay as
    runs array<struct<first: int, last: int>> of line numbers from 0.

    A line's key is the line without white space at its ends, A-Z lower-cased. Of a key of at least `min_chars` code points
    all lines go except those in the smallest doc_id that holds it, where every repeat stays.

    Lines travel as hashes with document and place, never as text. They are partitioned by ranges of the hash and sorted by
    document and place; the first document of a key is known when its first line passes, all later ones drop theirs. A key
    with a share of the lines that one task should not hold is counted beforehand (counts by bucket, then by key, both
    combined before the shuffle) and decided through a broadcast of at most HOT_SHARE rows, without a shuffle of its lines.

    Null and empty texts are one empty line; rows of one id are one document, each with a bitmap of its own text; rows
    without an id are one document, after all others; an empty table gives an empty result; columns named as a result's are
    replaced.
    """
    names = [c for c in (columns or docs.columns) if columns or c != text]
    runs = _with_runs(docs, min_chars, text, doc_id)
    return unpacked(runs, names, {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped"), "keep": F.col("keep")})


def kept_lines(docs: DataFrame, *, min_chars: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns, the text without its dropped lines (joined by line feeds; empty if none stays), and the columns of
    `keep_bitmaps`."""
    runs = _with_runs(docs, min_chars, text, doc_id)
    lines = lines_of(F.col(ROW).getField(text))
    stay = F.flatten(F.transform("keep", lambda r: F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1)))
    new = {text: F.array_join(stay, "\n"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped"), "keep": F.col("keep")}
    return unpacked(runs, docs.columns, new)


def _with_runs(docs: DataFrame, least: int, text: str, doc_id: str) -> DataFrame:
    gone = _dropped_places(docs, text, doc_id, least)
    rows = docs.select(packed(docs), quoted(doc_id).alias("_id"), _text_number(quoted(text)).alias("_tk"))
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tk") == F.col("tk")), "left")
    rows = rows.withColumn("n_lines", F.size(lines_of(F.col(ROW).getField(text))).cast("long"))
    rows = rows.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("n_dropped", F.size("gone").cast("long"))
    gone_at = lambda i: F.element_at("gone", i + 1)
    opens = F.filter("gone", lambda p, i: (i == 0) | (gone_at(F.greatest(i - 1, F.lit(0))) != p - 1))
    closes = F.filter("gone", lambda p, i: (i == F.size("gone") - 1) | (gone_at(F.least(i + 1, F.size("gone") - 1)) != p + 1))
    rows = rows.withColumn("opens", opens).withColumn("closes", closes)
    # The lines before each dropped run and those after the last one.
    after = F.concat(F.array(F.lit(0)), F.transform("closes", lambda p: p + 1))
    until = F.concat(F.transform("opens", lambda p: p - 1), F.array((F.col("n_lines") - 1).cast("int")))
    runs = F.zip_with(after, until, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return rows.withColumn("keep", F.filter(runs, lambda r: r["first"] <= r["last"]))
