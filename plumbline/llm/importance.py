"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Features (runs of words) are hashed into buckets. A bucket's gain is the log ratio of its share in the target to its share in the
corpus, both counted over all rows; gains are one array, and a document's weight is the mean of the array's entries at its
features' buckets. Gumbel noise by id turns the largest scores into a sample without replacement, drawn with weights.

Ranks come from an LSD radix sort: a composite key (score down, id up) is cut into digits, and one stable counting sort is done for each
digit, from the last to the first. Rows lie in blocks of consecutive places. Every pass counts each block's digits, adds the
counts up to offsets (by digit, then by block), and sends each row to its digit's total before it, plus its offset, plus its number among its
block's rows of that digit. No task sees more than blocks of bounded size, however many rows share a score or an id, and the
last pass's places are the ranks. Only a pass's totals, at most 2^DIGIT_BITS numbers, and the buckets' counts reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, string_bytes

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bits of a digit, at most, and the largest block, 2^BLOCK_BITS rows.
DIGIT_BITS, BLOCK_BITS = 11, 17
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 22
#: Bytes of a word that are hashed with the other words'; the rest of a longer word is hashed by itself.
WORD_BYTES = 48

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 register, bit by bit."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def advance(register: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 registers after data[starts : starts + lengths], each its own."""
    out, at = register.copy(), np.flatnonzero(lengths > 0)
    for k in range(min(WORD_BYTES, int(lengths.max(initial=0)))):
        at = at[lengths[at] > k]
        out[at] = _CRC[(out[at] ^ data[starts[at] + k]) & 255] ^ (out[at] >> np.uint32(8))
    for i in np.flatnonzero(lengths > WORD_BYTES).tolist():
        out[i] = zlib.crc32(data[starts[i] + WORD_BYTES : starts[i] + lengths[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, the text that it stands in, words of each text). Features are runs of 1 to `longest` words
    joined by a space; words are runs of digits, a-z (A-Z too) and all beyond ASCII."""
    n = len(offsets) - 1
    folded = _FOLD[data]
    inside = _INSIDE[folded]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]  # a text's first byte starts a word even if the byte before is one
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    text = np.searchsorted(offsets, starts, side="right") - 1
    register = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), folded, starts, lengths)
    found, where = [register], [text]
    space, one = np.array([32], np.uint8), np.ones(1, np.int64)
    for k in range(1, longest):
        register = register[:-1]
        if not len(register):
            break
        register = advance(register, space, np.zeros(len(register), np.int64), np.repeat(one, len(register)))
        register = advance(register, folded, starts[k:], lengths[k:])
        whole = text[k:] == text[:-k]  # runs that don't leave their text
        found.append(register[whole])
        where.append(text[:-k][whole])
    hashes = np.concatenate(found) ^ np.uint32(0xFFFFFFFF)
    return (hashes % np.uint32(buckets)).astype(np.int64), np.concatenate(where), np.bincount(text, minlength=n)


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of some whole texts at a time, about SLICE_BYTES."""
    data, offsets = string_bytes(column)
    at, n = 0, len(column)
    while at < n:
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield data[offsets[at] : offsets[until]], offsets[at : until + 1] - offsets[at]
        at = until


def _count(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for data, offsets in _slices(batch.column(0)):
            total += np.bincount(features(data, offsets, buckets, longest)[0], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How often each bucket's features occur in all texts; null texts have none. Tasks add up before the exchange."""
    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(partial(_count, buckets=buckets, longest=longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, rounded down."""
    n = len(corpus)
    above = (target + 1.0) * float(int(corpus.sum()) + n)
    below = (corpus + 1.0) * float(int(target.sum()) + n)
    return np.floor(1000.0 * np.log(above / below)).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = []
        for data, offsets in _slices(batch.column(1)):
            found, text, words = features(data, offsets, len(gain), longest)
            count = np.bincount(text, minlength=len(words))
            order = np.argsort(text, kind="stable")
            total = np.concatenate([[0], np.cumsum(gain[found[order]])])
            ends = np.cumsum(count)
            numbers.append((count, words, (total[ends] - total[ends - count]) // np.maximum(count, 1)))
        columns = [np.concatenate(x) for x in zip(*numbers)] if numbers else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_features", "n_words", "weight"])


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, n_features, n_words, weight) of each row; the mean gain of its features, rounded down, 0 without features."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_weigh, gain=gain, longest=longest), f"id {kind}, n_features long, n_words long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that depends on seed and id alone, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digits(rows: DataFrame, keys: list[tuple[str, bool]]) -> tuple[list[Column], int]:
    """(digits of the composite key from the last to the first, how many values a digit has). keys: integer columns from the
    most significant on, and whether they ascend; nulls come first."""
    bounds = rows.agg(*[f(c).alias(f"{name}_{i}") for i, (c, _) in enumerate(keys) for name, f in (("low", F.min), ("high", F.max))]).first()
    packed: list[tuple[Column, int]] = []
    for i, (name, ascending) in reversed(list(enumerate(keys))):
        low, high = bounds[f"low_{i}"] or 0, bounds[f"high_{i}"] or 0
        if high - low < 2**62:
            value = F.coalesce((F.col(name) - low if ascending else high - F.col(name)) + 1, F.lit(0))
            parts = [(value.cast("long"), (high - low + 1).bit_length())]
        else:  # in two halves, as unsigned numbers
            value = F.col(name).bitwiseXOR(F.lit(-(2**63)))
            value = value if ascending else F.bitwise_not(value)
            parts = [(F.coalesce(value.bitwiseAND(2**32 - 1), F.lit(0)), 32), (F.coalesce(F.shiftrightunsigned(value, 32) + 1, F.lit(0)), 33)]
        for value, bits in parts:
            if packed and packed[-1][1] + bits <= 62:
                packed[-1] = (packed[-1][0].bitwiseOR(F.shiftleft(value, packed[-1][1])), packed[-1][1] + bits)
            else:
                packed.append((value, bits))
    out, width = [], 0
    for value, bits in packed:
        passes = -(-bits // DIGIT_BITS)
        each = -(-bits // passes)
        width = max(width, each)
        out += [F.shiftright(value, each * p).bitwiseAND((1 << each) - 1).cast("int") for p in range(passes)]
    return out, 1 << width


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """rows (a table that gives the same rows in the same order when read again) with their rank, from 1, by integer keys, each (column,
    ascending), nulls first. The sort is stable, so rows equal in all keys keep their order. Empty input gives no rows."""
    total = rows.count()
    digits, values = _digits(rows, keys)
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, min(BLOCK_BITS, (total // wanted).bit_length() - 1))
    state, written = rows.withColumn("__place", F.monotonically_increasing_id()), []
    state = materialise(state, "unsorted")
    for digit in digits:
        held = state.withColumns({"__block": F.shiftright("__place", bits), "__digit": digit})
        counts = materialise(held.groupBy("__block", "__digit").agg(F.count("*").alias("n")), "digit-counts")
        totals = np.zeros(values, np.int64)
        for d, n in counts.groupBy("__digit").agg(F.sum("n")).collect():
            totals[d] = n
        before = F.lit((np.cumsum(totals) - totals).tolist()).cast("array<long>")
        earlier = F.sum("n").over(Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select("__block", "__digit", (F.get(before, F.col("__digit")) + F.coalesce(earlier, F.lit(0))).alias("__offset"))
        number = F.row_number().over(Window.partitionBy("__block", "__digit").orderBy("__place")) - 1
        moved = held.join(offsets, ["__block", "__digit"]).withColumn("__place", F.col("__offset") + number)
        written.append((state, counts))
        state = materialise(moved.select(*rows.columns, "__place"), "sorted")
        discard(*written.pop())
    return state.withColumn(name, F.col("__place") + 1).drop("__place")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """Every row of docs: id_col, n_features, weight, score, rank. Of the documents with min_words words, `percent` of a hundred (rounded
    down) are drawn, those with the highest scores, ties to the smaller id; rank is their place from 1, null for all others.

    Ids are integers. A null id is less than any other and has the noise of an empty one; repeated rows are ranked each. A null text has no features,
    weight 0, and is not drawn. An empty target or corpus is smoothed like any other; empty docs give no rows. Other columns aren't read.
    """
    gain = gains(bucket_counts(target, target_col, buckets, longest), bucket_counts(docs, text_col, buckets, longest))
    scored = weights(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = materialise(scored, "scores")
    enough = F.col("n_words") >= min_words
    some = scored.where(enough)
    drawn = some.count() * percent // 100
    ranked = radix_ranks(some, [("score", False), ("id", True)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts, its score, and its rank if it is drawn."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(n))
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
bytes AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM dw UNION SELECT DISTINCT w FROM bw)
), buckets AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
            lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) % 10000 AS bucket
  FROM bytes, crc_table
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN buckets USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN buckets USING (w) GROUP BY 1),
gains AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE)
                                   / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), noised AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1)), lambda a, x: a * 16 + x) AS h
  FROM d LEFT JOIN weighed USING (doc_id)
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM noised
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.r <= 10 * r.n // 100 THEN r.r END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
