"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass one counts how many rows hit each bit of a filter; bits hit at least twice are packed into bitmaps. All that it moves is one number a
row, the bit, added up before the exchange. Pass two tests each row's bit: a row that misses has no equal and passes straight
through. Only the remaining rows, the repeated ones and about one in 32 of the others, are shuffled by digest and resolved exactly.

Digests are dealt into ranges of about RANGE_ROWS rows, each with a filter of its own of 32 to 64 bits a row, so a filter is never
fuller and never larger (RANGE_ROWS * 64 bits, 128 MB) however many rows there are. All filters are made in one pass over the written
digests and applied in a second one. One filter is broadcast; several, which together grow with the rows, meet the rows of their
range in a shuffle of the digests, never of the texts: rows of bits that a thousandth of the rows hit are known from pass one, at most 1,000 bits,
and need no filter. Groups with at least a thousandth of the rows (so at most 1,000 of them) are joined back by broadcast, so that no
task gets a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, joined_by_size, materialise

#: Rows of one filter, about.
RANGE_ROWS = 1 << 24
BITS_A_ROW = 32


def _placed(hashed: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(hashed with __range and its __slot in the range's filter, the number of ranges)."""
    ranges, bits = 1 + rows // RANGE_ROWS, 1 << 16
    while bits < BITS_A_ROW * (rows // ranges):
        bits *= 2
    of = F.pmod(F.xxhash64(F.col("__digest"), F.lit("range")), F.lit(ranges))
    return hashed.withColumns({"__range": of, "__slot": F.pmod(F.xxhash64(F.col("__digest")), F.lit(bits))}), ranges


def repeated_bits(placed: DataFrame) -> DataFrame:
    """(__range, __slot, hits): the bits that at least two rows hit."""
    return placed.groupBy("__range", "__slot").agg(F.count("*").alias("hits")).where("hits > 1")


def flagged(hashed: DataFrame, rows: int) -> DataFrame:
    """hashed (a written table of so many rows with __row) with __again: false only for rows whose digest surely occurs once. Reads it twice."""
    placed, ranges = _placed(hashed, rows)
    twice = materialise(repeated_bits(placed), "bloom")
    bucket = F.bitmap_bucket_number("__slot")
    bitmaps = twice.groupBy("__range", bucket.alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bitmap"))
    hot = twice.where(F.col("hits") >= max(1000, rows // 1000)).select("__range", "__slot", F.lit(True).alias("__hot"))
    out = placed.join(F.broadcast(hot), ["__range", "__slot"], "left")
    out = out.withColumn("__bucket", F.when(F.col("__hot"), -1 - F.pmod(F.col("__row"), F.lit(1 << 16))).otherwise(bucket))
    out = out.join(F.broadcast(bitmaps) if ranges == 1 else bitmaps, ["__range", "__bucket"], "left")
    at = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    again = F.coalesce("__hot", F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return materialise(out.withColumn("__again", again).select(*hashed.columns, "__again"), "flagged")


def digest_of(text_col: str) -> Column:
    """What equal texts share."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row with the largest id
    stays; a null id is less than any other, and of rows that share text and id one stays. Empty input gives no rows;
    columns other than id and text are not read.
    """
    hashed = materialise(docs.select(F.col(f"`{id_col}`").alias("__id"), digest_of(text_col).alias("__digest")).withColumn("__row", F.monotonically_increasing_id()), "digests")
    rows = hashed.count()
    all_rows = flagged(hashed, rows)
    discard(hashed)
    single = all_rows.where(~F.col("__again")).select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__digest")
    again = all_rows.where("__again").drop("__again")
    groups = again.groupBy("__digest").agg(F.max(F.struct("__id", "__row")).alias("top"), F.count("*").alias("group_size"))
    groups = materialise(groups.withColumn("size", F.col("group_size")), "groups")
    resolved = joined_by_size(again, groups, "__digest", "size", rows)
    resolved = resolved.select("__id", F.col("top.__id").alias("keep_id"), "group_size", (F.col("top.__row") == F.col("__row")).alias("kept"), "__digest")
    return single.unionByName(resolved).select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns: one of each group of equal texts.

    Rows are told apart by row, not by id, so ids may be null or repeat. docs is written once, whole; filters and groups work on
    digests, and the numbers of the rows to drop are joined back, by broadcast where Spark finds them few.
    """
    held = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    hashed = materialise(held.select(F.col(f"`{id_col}`").alias("__id"), digest_of(text_col).alias("__digest"), "__row"), "digests")
    again = flagged(hashed, hashed.count()).where("__again")
    discard(hashed)
    top = again.groupBy("__digest").agg(F.max(F.struct("__id", "__row")).alias("top")).select(F.col("top.__row").alias("__row"))
    return held.join(again.select("__row").join(top, "__row", "left_anti"), "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its group's keeper."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
