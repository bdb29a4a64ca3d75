"""What the corpus operators share: tables, the shared working folder, and vectorised text hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
WHITESPACE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression for runs of it.
WHITESPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets
    a folder of its own; on a cluster that would be a folder of the driver's machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of any executor.

    The files go when the session's JVM ends, or before by discard().
    """
    return materialise_parts([df], name)


def materialise_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of several DataFrames with the same columns, written one after the other."""
    path = ""
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() wrote and that nothing reads any more."""
    for df in tables:
        where, files = _file_system(df.sparkSession, df._plumbline_path)
        files.delete(where, True)


def joined_by_size(left: DataFrame, right: DataFrame, keys: str | list[str], size: str, total: int, largest: int | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and in `size` how many rows of left (of `total`) have the key.

    Keys with a thousandth of left's rows or more, so at most a thousand of them, are joined by broadcast: no task gets a hot
    key. The others are shuffled. largest: the largest size, where it is known; one plain join does if it is small.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = max(1000, total // 1000)
    if largest is not None and largest < hot:
        return left.join(right.drop(size), keys)
    few, rest = F.broadcast(right.where(F.col(size) >= hot).drop(size)), right.where(F.col(size) < hot).drop(size)
    return left.join(few, keys).unionByName(left.join(few.select(*keys), keys, "left_anti").join(rest, keys))


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, nulls as empty; no copy of the text where the array has no nulls."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit. out may be x itself."""
    shifted = x >> np.uint64(30)
    x = np.bitwise_xor(x, shifted, out=out)
    np.multiply(x, _MIX1, out=x)
    np.right_shift(x, np.uint64(27), out=shifted)
    np.bitwise_xor(x, shifted, out=x)
    np.multiply(x, _MIX2, out=x)
    np.right_shift(x, np.uint64(31), out=shifted)
    return np.bitwise_xor(x, shifted, out=x)


#: Additive seeds of a shingle's word positions.
_SEEDS = mix64(np.arange(1, 65, dtype=np.uint64))


def _is_space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in WHITESPACE]] = True
    return t


_SPACE = _is_space_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, in order, and where each text's words start: (hashes, word offsets).

    Words are maximal runs of bytes outside WHITESPACE; with lower, A-Z count as a-z. A word's hash is a polynomial over
    its bytes and its length, finalised by mix64.
    """
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    space = _SPACE[data]
    inside = ~space
    starts_mask = inside.copy()
    starts_mask[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte starts a word even if the byte before is one
    starts_mask[first] = inside[first]
    ends_mask = inside.copy()
    ends_mask[:-1] &= space[1:] | starts_mask[1:]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    lengths = ends - starts
    hashes, until = np.empty(len(starts), np.uint64), np.cumsum(lengths)
    cuts = np.unique(np.append(np.searchsorted(until, np.arange(0, int(until[-1]) if len(until) else 0, 1 << 19)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:]):  # a slice at a time, so that the temporaries stay in cache
        s, e, n = starts[i], ends[j - 1], lengths[i:j]
        mine = inside[s:e]
        text = data[s:e][mine]
        text = (_FOLD[text] if lower else text).astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(n) - n
        within = np.arange(len(text)) - np.repeat(begin, n)
        sums = np.add.reduceat(text * _powers(int(n.max()))[within], begin)
        hashes[i:j] = mix64(sums ^ (n.astype(np.uint64) * _MIX2))
    return hashes, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """mix64 of 0..n-1 made odd: independent multipliers by position."""
    global _POWERS
    if len(_POWERS) <= n:
        _POWERS = mix64(np.arange(2 * n + 64, dtype=np.uint64) * _RADIX + np.uint64(7)) | np.uint64(1)
    return _POWERS


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each text, in order, and where each text's runs start.

    A text with some words but fewer than `size` has one: the whole sequence. A text without words has none.
    """
    counts = np.diff(offsets)
    n_runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(n_runs)])
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), out_offsets
    runs = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        runs[: n - k] += mix64(words + _SEEDS[k])[k:]
    runs = mix64(runs)
    keep = np.repeat(counts >= size, counts)
    last = np.repeat(offsets[1:], counts) - np.arange(n)  # words left, this one included
    keep &= last >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    heads = offsets[:-1][short]
    for i, head in zip(short.tolist(), heads.tolist()):
        c = int(counts[i])
        whole = np.zeros(1, np.uint64)
        for k in range(c):
            whole += mix64(words[head + k : head + k + 1] + _SEEDS[k])
        runs[head] = mix64(whole ^ np.uint64(c))[0]
    keep[heads] = True
    return runs[keep], out_offsets
