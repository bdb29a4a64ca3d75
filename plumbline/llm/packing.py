"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens, in document order. A window holds a fixed number of sequences; in each window the
sources are served in turn, each for its share of the window's tokens plus the fraction that it was owed from the windows
before, so every window has the target proportions to within a token for each source, and no deficit is ever lost.

Service is counted in tokens: the next token always goes to the source with the largest deficit for its share, the one whose
m / (2 s + 1) is largest when s of its m tokens have been served (ties by name). How many tokens each source has been
served when x are out is a function of x alone, never decreases, and is found from the rounded shares of x in a few steps
(served). So the deficits carry over windows and, because x counts tokens of the whole corpus, over partitions, and a
document that knows its place in its queue computes where its tokens go by itself.

A phase ends when a source runs dry; the others' target weights then make up the next one. Without target weights the
targets are the corpus's own proportions, and there is one phase. All tokens are packed, cut freely, and only the last
sequence is short.

pack() gives the pieces with their token ids, sequences() brings the pieces of each sequence together and fills it, and
pieces_of() cuts filled sequences into their pieces again. On the way ids take two bytes where the vocabulary allows it
(id_kind); pieces_of() gives them as four.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .jaccard_join import slices
from .token_memo import ChunkMemo, encode_by_chunks

SEQUENCE = 1024
#: Sequences in a window.
WINDOW_SEQUENCES = 64
END_ID = 0
NO_SOURCE = ""
#: About the most bytes of ids in a batch of pieces.
BATCH_BYTES = 8 << 20


def byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write bytes: printable ones by themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit integers.

    New chunks are encoded together by the same merges in tiktoken's engine, which is about three times as fast; a text with
    a special token's string goes through the library itself.
    """

    def __init__(self, path: str, pattern: str, memo: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.engine = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.chunks = ChunkMemo(self._encode, memo, " ")

    def _encode(self, text: str) -> bytes:
        return np.array(self.engine.encode_ordinary(text), np.uint32).tobytes()

    def learn(self, texts: list[str]) -> None:
        """Memoise all chunks of texts that are new, encoded in one call."""
        seen = self.chunks
        new: set[str] = set()
        for text in texts:
            new.update(text.split(" ")[1:])
        new.difference_update(seen)
        if len(seen) + len(new) > seen.limit:
            seen.clear()
        # A chunk that begins with white space could grow into the one before it; encode() meets those one by one.
        plain = [c for c in new if c and not c[0].isspace()]
        if not plain:
            return
        ids = np.array(self.engine.encode_ordinary(" " + " ".join(plain)), np.uint32)
        stops = np.cumsum([len(c.encode()) + 1 for c in plain])
        cuts = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), stops) + 1)).tolist()
        raw, start = ids.tobytes(), 0
        for chunk, stop in zip(plain, cuts):
            seen[chunk] = raw[start:stop]
            start = stop

    def encode(self, text: str) -> bytes:
        """As the library encodes the whole text, strings of special tokens included."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return encode_by_chunks(text, self.chunks)


def id_kind(path: str) -> str:
    """The numpy kind of token ids in packed sequences: two bytes if all ids of the vocabulary fit."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, pattern: str, kind: str) -> Iterator[pa.RecordBatch]:
    own, part, served = encoder(path, pattern), TaskContext.get().partitionId(), {}
    end = np.array([END_ID], np.uint32).tobytes()
    for batch in slices(batches, "__text"):
        texts, sources = [t or "" for t in batch.column("__text").to_pylist()], batch.column("__source").to_pylist()
        own.learn(texts)
        ids, before, n = [], [], []
        for text, source in zip(texts, sources):
            four = own.encode(text) + end
            ids.append(np.frombuffer(four, "<u4").astype(kind).tobytes())
            n.append(len(four) // 4)
            before.append(served.get(source, 0))
            served[source] = before[-1] + n[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__source"), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
            names=["__id", "__source", "__part", "__before", "__n", "__ids"],
        )


def phases(totals: dict[str, int], weights: dict[str, float] | None) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """(tokens before the phase, [(source, tokens of it used up before, tokens in the phase)]), by source name.

    Sources without a weight, or with none at all, are served when those with one have run dry, in the corpus's proportions.
    """
    left, used, out, begin = dict(sorted(totals.items())), dict.fromkeys(totals, 0), [], 0
    while any(left.values()):
        live = {s: float((weights or {}).get(s, 0)) for s, n in left.items() if n}
        if not any(w > 0 for w in live.values()):
            live = {s: float(left[s]) for s in live}
        live = {s: w for s, w in live.items() if w > 0}
        rounds = min(left[s] / w for s, w in live.items())
        take = {s: min(left[s], round(w * rounds)) for s, w in live.items()}
        first_dry = min(live, key=lambda s: left[s] / live[s])
        take[first_dry] = left[first_dry]
        out.append((begin, [(s, used[s], n) for s, n in take.items() if n]))
        for s, n in take.items():
            left[s] -= n
            used[s] += n
        begin += sum(take.values())
    return out


def served(shares: list[int], x: int) -> list[int]:
    """Tokens that each source has been served when x of the sum of shares are out."""
    total = sum(shares)
    out = [(2 * m * x + total) // (2 * total) for m in shares]
    while (gap := x - sum(out)) > 0:
        k = 0
        for j in range(1, len(shares)):
            if shares[j] * (2 * out[k] + 1) > shares[k] * (2 * out[j] + 1):
                k = j
        out[k] += 1
    while gap < 0:
        k = -1
        for j in range(len(shares)):
            if out[j] and (k < 0 or shares[j] * (2 * out[k] - 1) <= shares[k] * (2 * out[j] - 1)):
                k = j
        out[k] -= 1
        gap += 1
    return out


class Phase:
    """A phase of the round-robin: its sources' shares, its first corpus position, and the windows' length in tokens."""

    def __init__(self, shares: list[int], begin: int, window: int):
        self.shares, self.begin, self.window, self.total = shares, begin, window, sum(shares)
        self.known: dict[int, list[int]] = {}

    def edge(self, w: int) -> int:
        """Where window w begins in the phase."""
        return min(self.total, max(0, w * self.window - self.begin))

    def at(self, w: int) -> list[int]:
        """Tokens served before window w."""
        if w not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[w] = served(self.shares, self.edge(w))
        return self.known[w]

    def place(self, k: int, first: int, n: int) -> list[tuple[int, int, int]]:
        """Pieces (start in the range, length, corpus position) of the n tokens from `first` on of source k."""
        out, done = [], 0
        w = (self.begin + first * self.total // self.shares[k]) // self.window
        while self.at(w)[k] > first:
            w -= 1
        while self.at(w + 1)[k] <= first:
            w += 1
        while done < n:
            left, right = self.at(w), self.at(w + 1)
            take = min(n - done, right[k] - (first + done))
            if take > 0:
                inside = sum(right[:k]) - sum(left[:k]) + first + done - left[k]
                out.append((done, take, self.begin + self.edge(w) + inside))
                done += take
            w += 1
        return out


def _pieces(batches: Iterator[pa.RecordBatch], plan: list, sequence: int, window: int, id_name: str, width: int) -> Iterator[pa.RecordBatch]:
    by_source: dict[str, list[tuple[int, int, int, Phase]]] = {}
    for begin, shares in plan:
        phase = Phase([n for _, _, n in shares], begin, window)
        for k, (source, used, n) in enumerate(shares):
            by_source.setdefault(source, []).append((used, n, k, phase))
    names = [id_name, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def made(batch: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
        which, *columns = (pa.array(c, kind) for c, kind in zip(rows, kinds))
        return pa.RecordBatch.from_arrays([batch.column("__id").take(which), *columns], names=names)

    for batch in batches:
        rows: list[list] = [[] for _ in names]
        size = 0
        for k, (source, at, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__source", "__at", "__n")))):
            ids, done = memoryview(batch.column("__ids")[k].as_buffer()), 0
            for used, share, k_source, phase in by_source[source]:
                here = min(n - done, used + share - (at + done))
                if here <= 0:
                    continue
                for start, length, position in phase.place(k_source, at + done - used, here):
                    while length:
                        offset = position % sequence
                        take = min(length, sequence - offset)
                        first = done + start
                        for column, value in zip(rows, (k, first, take, bytes(ids[width * first : width * (first + take)]), n, position // sequence, offset)):
                            column.append(value)
                        start, length, position = start + take, length - take, position + take
                        size += width * take
                        if size >= BATCH_BYTES:
                            yield made(batch, rows)
                            rows, size = [[] for _ in names], 0
                done += here
                if done == n:
                    break
        yield made(batch, rows)


def pack(docs: DataFrame, path: str, pattern: str, weights: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: id_col, start, length, ids, doc_tokens, sequence_id, offset.

    ids are the piece's token ids, little-endian, of id_kind(path). Null text is empty and has its end id alone; rows without a
    source form one queue; repeated rows are packed each; other columns are not read; empty input gives no rows. weights:
    target token proportions by source. The driver gets one number for each source (sources of a mixture are few and named
    in its configuration), and a number for each source and input partition comes to the texts' tasks.
    """
    width = np.dtype(kind := id_kind(path)).itemsize
    docs = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("__source"), F.col(text_col).alias("__text"))
    own = dict(docs.dtypes)["__id"]
    tokens = materialise(docs.mapInArrow(partial(_tokens, path=path, pattern=pattern, kind=kind), f"__id {own}, __source string, __part int, __before long, __n long, __ids binary"), "tokens")
    served = tokens.groupBy("__source", "__part").agg(F.max(F.col("__before") + F.col("__n")).alias("__served"))
    queue = Window.partitionBy("__source").orderBy("__part")
    base = materialise(served.withColumn("__base", F.sum("__served").over(queue) - F.col("__served")), "queue-starts")
    totals = {r["__source"]: r["n"] for r in base.groupBy("__source").agg(F.sum("__served").alias("n")).collect()}
    # The queue starts come as one array a partition, so that the join's key is the partition's number.
    starts = base.groupBy("__part").agg(F.map_from_entries(F.collect_list(F.struct("__source", "__base"))).alias("__bases"))
    placed = tokens.join(starts, "__part").withColumn("__base", F.element_at("__bases", F.col("__source"))).select("__id", "__source", (F.col("__base") + F.col("__before")).alias("__at"), "__n", "__ids")
    run = partial(_pieces, plan=phases(totals, weights), sequence=sequence, window=sequence * window_sequences, id_name=id_col, width=width)
    return placed.mapInArrow(run, f"`{id_col}` {own}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per packed sequence: sequence_id, n_tokens, ids (its token ids, all pieces in order), pieces (where they came from).

    The pieces of a sequence meet in one row: a sequence has as many pieces as tokens at most.
    """
    piece = F.struct("offset", F.col(f"`{id_col}`").alias("id"), "start", "length", "doc_tokens", "ids")
    by = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("__pieces"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("__pieces", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    origin = F.transform("__pieces", lambda p: F.struct(p["id"].alias("id"), p["start"].alias("start"), p["length"].alias("length"), p["doc_tokens"].alias("doc_tokens"), p["offset"].alias("offset")))
    return by.select("sequence_id", "n_tokens", ids.alias("ids"), origin.alias("pieces"))


def _cut(batches: Iterator[pa.RecordBatch], id_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column("pieces")
        flat, counts = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
        of = np.repeat(np.arange(len(batch)), counts)
        length, offset = (flat.field(c).to_numpy() for c in ("length", "offset"))
        four = []  # each sequence's ids, as four bytes each
        for raw, n in zip(batch.column("ids"), batch.column("n_tokens").to_pylist()):
            raw = raw.as_buffer()
            four.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4"))
        ids = [four[s][o : o + n].tobytes() for s, o, n in zip(of.tolist(), offset.tolist(), length.tolist())]
        columns = [flat.field("id"), flat.field("start"), flat.field("length"), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), flat.field("doc_tokens"), batch.column("sequence_id").take(pa.array(of)), flat.field("offset")]
        yield pa.RecordBatch.from_arrays(columns, names=[id_name, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pieces_of(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces of filled sequences, with the columns of pack() and ids_crc32, the checksum of their ids. ids are read from
    where they lie in the sequence and given as little-endian unsigned 32-bit integers."""
    kind = packed.schema["pieces"].dataType.elementType["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return packed.mapInArrow(partial(_cut, id_name=id_col), schema)


def op4_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed in the corpus's own proportions; checksums are those of the pieces in the filled sequences."""
    import public_tokenizers

    packed = sequences(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
    return pieces_of(packed).drop("ids")
