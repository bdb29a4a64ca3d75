"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

The law of this shuffle is `rows`: every permutation of the rows over the shards' slots is equally likely, and shard sizes
differ by one at most. Rows lie in input partitions of known sizes; how many rows of partition p go to shard s is drawn from
the exact (multivariate hypergeometric) distribution that a uniform shuffle has. Each partition then permutes its rows and
cuts them by its matrix row, whole rows are exchanged, and each receiving block permutes again.

Slots of a shard are cut into blocks of at most `block_rows` rows and about `block_bytes` bytes, each with a column of the
matrix of its own and an exchange partition of its own, so no task reads a shard whole. Rows stream through both ends:
a row's place follows from its number in its part and then in its block, so tasks hold permutations of numbers (of at most
2^PART_BITS or block_rows) and never a part's or a block's rows.

The matrix is never held whole. It is drawn by halving: the parts are split in two, and how many of a block's slots go to the
first half is drawn for all blocks; each half is split again, with random numbers that its place in the tree seeds. A task
draws the counts on the way down to its own parts only: log2(parts) draws a block, the same wherever it runs. The driver holds
one number a part and two a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

BLOCK_ROWS = 1 << 20
BLOCK_BYTES = 256 << 20
#: Rows of an input partition that are dealt together, as a power of two.
PART_BITS = 20


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def blocks_of(sizes: np.ndarray, block_rows: int) -> pd.DataFrame:
    """(block, shard, first slot, size) for all shards' slots, in blocks of at most block_rows slots."""
    rows = [(s, first, min(block_rows, int(n) - first)) for s, n in enumerate(sizes) for first in range(0, int(n), block_rows)]
    out = pd.DataFrame(rows, columns=["shard", "first", "size"]).astype("int64")
    out.insert(0, "block", np.arange(len(out), dtype=np.int64))
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. From 10**9, where numpy's sampler stops, by inversion around the
    mode with the exact ratios of neighbouring probabilities."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


class Matrix:
    """The communication matrix, by rows: how many of a part's rows go to each block, and how many of earlier parts' do. Rows sum
    to parts, columns to blocks, and every row follows the exact hypergeometric law."""

    def __init__(self, parts: np.ndarray, blocks: np.ndarray, seed: int):
        self.until, self.blocks, self.seed = np.concatenate([[0], np.cumsum(parts, dtype=np.int64)]), blocks.astype(np.int64), seed

    def _draw(self, node: list[int], rows: int, out_of: np.ndarray) -> np.ndarray:
        """How many of `rows` rows drawn from the blocks, which have out_of places, come from each."""
        rng, left, drawn = np.random.default_rng([self.seed, 0, *node]), int(out_of.sum()), np.zeros(len(out_of), np.int64)
        for b, have in enumerate(out_of.tolist()):
            if not rows:
                break
            left -= have
            drawn[b] = hypergeometric(rng, have, left, rows)
            rows -= int(drawn[b])
        return drawn

    def row(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the part to each block, rows of all earlier parts in each)."""
        low, high, own, before = 0, len(self.until) - 1, self.blocks, np.zeros(len(self.blocks), np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            first = self._draw([low, high], int(self.until[middle] - self.until[low]), own)
            if part < middle:
                high, own = middle, first
            else:
                low, own, before = middle, own - first, before + first
        return own, before


def row_bytes(rows: DataFrame):
    """About how many bytes each row has: strings, binaries and nested values by their content."""
    sizes = []
    for f in rows.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = column.cast("string")
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            continue
        sizes.append(F.coalesce(F.octet_length(column), F.lit(0)).cast("long"))
    return sum(sizes, F.lit(8 * (1 + len(rows.columns))).cast("long"))


def dealer(matrix, numbers, seed: int) -> Callable[[pd.Series], pd.DataFrame]:
    """Row numbers to (block, number in the block). Broadcasts: the Matrix, and the parts' names, ascending."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(part: int) -> tuple[np.ndarray, np.ndarray]:
        if part in known:
            return known[part]
        if len(known) >= 8:
            known.clear()
        own, before = matrix.value.row(int(np.searchsorted(numbers.value, part)))
        n = int(own.sum())
        order = np.random.default_rng([seed, 1, part]).permutation(n)
        block, at = np.empty(n, np.int32), np.empty(n, np.int64)
        block[order] = np.repeat(np.arange(len(own)), own)
        at[order] = np.repeat(before - (np.cumsum(own) - own), own) + np.arange(n)
        known[part] = block, at
        return known[part]

    def deal(row: pd.Series) -> pd.DataFrame:
        number = row.to_numpy(np.int64)
        parts, block, at = number >> PART_BITS, np.empty(len(number), np.int32), np.empty(len(number), np.int64)
        for part in np.unique(parts).tolist():
            mine = parts == part
            block[mine], at[mine] = (x[number[mine] & ((1 << PART_BITS) - 1)] for x in places(part))
        return pd.DataFrame({"block": block, "at": at})

    return deal


def settler(blocks: pd.DataFrame, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows with __block and __at to the same rows with shard and slot."""
    shard_of, first, size = (blocks[c].to_numpy() for c in ("shard", "first", "size"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, np.ndarray] = {}  # of the one block that a partition has
        for batch in batches:
            block, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__block", "__at"))
            slot = np.empty(len(at), np.int64)
            for b in np.unique(block).tolist():
                if b not in slots:
                    slots = {b: np.random.default_rng([seed, 2, b]).permutation(int(size[b])) + first[b]}
                mine = block == b
                slot[mine] = slots[b][at[mine]]
            names = [n for n in batch.schema.names if n not in ("__block", "__at")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(shard_of[block].astype(np.int32)), pa.array(slot)], names=[*names, "shard", "slot"])

    return settle


def shuffle_rows(rows: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with `shard` (int) and `slot` (long, gapless from 0 in each shard) added; all their columns stay.

    Whole rows move: none of their columns is left out of the exchange, whichever are read afterwards. Nothing depends on
    values: nulls, ties and repeated rows are dealt like others. Fewer rows than shards leave some shards empty; empty input
    gives no rows. Columns named shard or slot are replaced. Blocks are cut by the mean size of rows, so they vary around
    block_bytes as sums of rows drawn at random do.
    """
    rows = rows.drop("shard", "slot")
    plain = rows.toDF(*[f"__c{i}" for i in range(len(rows.columns))])
    held = materialise(plain.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bytes", row_bytes(plain)), "shard-rows")
    parts = held.groupBy(F.shiftright("__row", PART_BITS).alias("part")).agg(F.count("*").alias("n"), F.sum("__bytes").alias("bytes")).collect()
    parts.sort(key=lambda r: r["part"])
    n_rows, n_bytes = (sum(r[c] for r in parts) for c in ("n", "bytes"))
    blocks = blocks_of(shard_sizes(n_rows, shards), max(1, min(block_rows, block_bytes * n_rows // max(1, n_bytes))))
    share = held.sparkSession.sparkContext.broadcast
    matrix = share(Matrix(np.array([r["n"] for r in parts], np.int64), blocks["size"].to_numpy(), seed))

    deal = F.pandas_udf(dealer(matrix, share(np.array([r["part"] for r in parts], np.int64)), seed), "block int, at long")
    dealt = held.drop("__bytes").withColumn("__to", deal("__row")).withColumns({"__block": F.col("__to.block"), "__at": F.col("__to.at")}).drop("__to", "__row")
    named = [T.StructField(f"__c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)]  # rows may have any names, even these
    whole = T.StructType([*named, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = dealt.repartitionById(max(1, len(blocks)), F.col("__block")).mapInArrow(settler(blocks, seed), whole)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(rows.columns)], "shard", "slot")


def op6_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """All documents, whole, in 40 shards, under the law `rows`; sizes and checksums are those of the texts that arrived."""
    dealt = shuffle_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return dealt.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
