"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token. Tier two: any other
pre-token is merged by rank with a heap of candidate pairs over doubly linked bytes. Encodings of chunks and pre-tokens are
memoised for each worker in tables of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .token_memo import ChunkMemo, encode_by_chunks


class PerfectHash:
    """A minimal perfect hash (hash, displace) from n distinct byte strings to 0..n-1; other strings are told apart by
    comparison with the key stored at their slot."""

    PER_BUCKET = 4

    def __init__(self, items: dict[bytes, int]):
        self.n = n = max(1, len(items))
        self.check = xxhash.xxh3_64_intdigest(b"".join(b"%d %s " % (i, k) for k, i in sorted(items.items())))
        self.buckets = n // self.PER_BUCKET + 1
        self.shift = array("l", bytes(8 * self.buckets))
        self.keys: list[bytes | None] = [None] * n
        self.values = array("l", bytes(8 * n))
        groups: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in items:
            h = xxhash.xxh3_128_intdigest(key)
            groups[(h & 0xFFFFFFFF) % self.buckets].append(((h >> 32) & 0xFFFFFFFF, h >> 64, key))
        free = iter(range(n))
        for b in sorted(range(self.buckets), key=lambda i: -len(groups[i])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # singles take the free slots left, by a negative displacement
                slot = next(i for i in free if self.keys[i] is None)
                self.shift[b], slots = -slot - 1, [slot]
            else:
                for d in range(1 << 40):
                    slots = [(f + d * (g % n | 1)) % n if d < n else (f ^ d * g) % n for f, g, _ in group]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                self.shift[b] = d
            for s, (_, _, key) in zip(slots, group):
                self.keys[s], self.values[s] = key, items[key]

    def get(self, key: bytes) -> int | None:
        h, n = xxhash.xxh3_128_intdigest(key), self.n
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        if d < 0:
            slot = -d - 1
        else:
            f, g = (h >> 32) & 0xFFFFFFFF, h >> 64
            slot = (f + d * (g % n | 1)) % n if d < n else (f ^ d * g) % n
        return self.values[slot] if self.keys[slot] == key else None


def merge_pairs(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of a pre-token after all merges: always the pair of lowest rank, the leftmost of equals.

    ids: of its single bytes. pairs: (left id << 16 | right id) -> id of the merged token, which is its rank. Parts are
    doubly linked by index; the heap holds rank << 32 | index of the left part, and an entry counts only if its two parts
    still make that token.
    """
    n, get = len(ids), pairs.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1])) is not None]
    if not heap:
        return ids
    ids.append(-1)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        j = after[i]
        if get(ids[i] << 16 | ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = k = after[j]
        before[k] = i
        if (r := get(rank << 16 | ids[k])) is not None:
            heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := get(ids[h] << 16 | rank)) is not None:
            heappush(heap, r << 32 | h)
    return [x for x in ids if x >= 0]


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by a vocabulary of ids under 65,536; memo bounds each of its two tables of known encodings."""

    def __init__(self, whole: PerfectHash, pattern: str, memo: int = 1_000_000):
        self.whole = whole
        ranks = {k: v for k, v in zip(whole.keys, whole.values) if k is not None}
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs = {ranks[t[:k]] << 16 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.split = regex.compile(pattern).findall
        self.words = ChunkMemo(self._word, memo)
        self.chunks = ChunkMemo(self._chunk, memo // 2, " ")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def _word(self, word: str) -> bytes:
        piece = word.encode()
        whole = self.whole.get(piece)
        return array("I", [whole] if whole is not None else merge_pairs([self.bytes[b] for b in piece], self.pairs)).tobytes()

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return encode_by_chunks(text, self.chunks)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[tuple, Codec] = {}


def codec(whole: Broadcast, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (whole.value.n, whole.value.check, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(whole.value, pattern)
    return _CODECS[key]


def _digests(batches: Iterator[pa.RecordBatch], whole: Broadcast, pattern: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own = codec(whole, pattern)
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(1).to_pylist():
            ids = own.encode(text or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=pa.schema([batch.schema.field(0), *list(schema)[1:]]))


def _encode(batches: Iterator[pa.RecordBatch], whole: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(whole, pattern)
    for batch in batches:
        ids = [list(memoryview(own.encode(text or "")).cast("I")) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[batch.schema.names[0], "ids"])


def _decode(batches: Iterator[pa.RecordBatch], whole: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(whole, pattern)
    for batch in batches:
        raw = [own.decode(array("I", ids or []).tobytes()) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[batch.schema.names[0], "bytes"])


def shared(df: DataFrame, path: str) -> Broadcast:
    """The perfect hash of a vocabulary file, built once by the driver and sent to the workers; as large as the file."""
    return df.sparkSession.sparkContext.broadcast(PerfectHash(load_ranks(path)))


def _mapped(df: DataFrame, first: str, second: str, run: Callable, out: str) -> DataFrame:
    return df.select(first, second).mapInArrow(run, f"`{first}` {dict(df.dtypes)[first]}, {out}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<long>), one row per row; null text gives no ids. Only these two columns are read."""
    return _mapped(docs, id_col, text_col, partial(_encode, whole=shared(docs, path), pattern=pattern), "ids array<long>")


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary), one row per row; null ids give no bytes. An id outside the vocabulary raises IndexError."""
    return _mapped(ids, id_col, ids_col, partial(_decode, whole=shared(ids, path), pattern=pattern), "bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass without a shuffle.

    Null text counts as empty; repeated rows are encoded each; texts of any length are encoded whole.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, id_col, text_col, partial(_digests, whole=shared(docs, path), pattern=pattern, schema=schema), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
