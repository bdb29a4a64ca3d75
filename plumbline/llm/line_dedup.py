"""Fuzzy line deduplication by MinHash: one line of each component of similar lines stays.

A line, stripped of white space at its ends, is the set of its distinct shingles of 8 characters (a shorter line is one
shingle). Two lines are linked when the exact Jaccard similarity of their shingles is 0.8 or more; candidates come from
signatures that agree in a band. Components of links are found by distributed union-find; of each component the first line in
order of document id and line number stays and all others go. Lines without a word are left alone.

Signatures have 80 minima in 16 bands of 5: a pair with similarity 0.8 shares a band with a chance of 1 - (1 - 0.8^5)^16 =
0.998, one with 0.85 of 0.9999. Beside its band keys a line sends a sketch, one bit of each of 64 minima; lines that share a key but whose
sketches differ in more than 18 bits aren't candidates (99.99 % of the pairs with similarity 0.8 pass, one in twelve with 0.3, one
in a thousand with 0.1), so unrelated lines don't grow together to large clusters as the corpus grows.

How it runs. A batch combines its lines by band key first: only leaders, the first line of those with close sketches, are
exchanged, so a line, or a family of near copies, that holds a third of all rows is sent once a batch. Lines that share a key in the exchange
make coarse clusters, and lines that occur twice are noted. Only lines of a cluster or with two occurrences, found by a bitmap
filter, are written; the texts of the clustered ones are exchanged once each and linked exactly in bounded tasks
(links.linked). Lines are named by 128-bit hashes of their text. Documents that lose no line are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, discard, joined_by_size, materialise, mix64
from .jaccard_join import NEED, OF, similar
from .links import PACKED, Forest, components, distinct_pairs, linked, may_contain, member_filter, packed_batch, packed_rows, runs, star_pairs, stars

CHARS = 8
BANDS, ROWS = 16, 5
#: Entries (lines times bands) of one bucket of the exchange.
BUCKET_ENTRIES = 250_000
TASK_SHINGLES = 2_000_000
#: Characters of the lines that are sent together, and of those that are hashed together.
BATCH_CHARS, SLICE_CHARS = 1 << 22, 1 << 20
#: Characters of the lines whose minima are taken together.
CACHE_CHARS = 1 << 17
#: Clusters of so many lines are compared pair by pair.
FEW = 6
#: Bits of a line's bitmap in a larger cluster, and of the folded one that is looked at before it.
BITMAP_BITS, FOLDED_BITS = 4096, 512

_ODD = mix64(np.arange(1, 2 * BANDS * ROWS + CHARS + 9, dtype=np.uint64)) | np.uint64(1)
_MULTIPLIERS, _FLIPS = _ODD[: BANDS * ROWS].astype(np.uint32) | np.uint32(1), (_ODD[BANDS * ROWS : 2 * BANDS * ROWS] >> np.uint64(32)).astype(np.uint32)
_PLACES = _ODD[2 * BANDS * ROWS :]
#: Multipliers of a run's first half, by its length.
_DOUBLINGS = {span: mix64(_ODD[-1:] + np.uint64(span))[0] | np.uint64(1) for span in (1, 2, 4)}


def split_lines(text: str | None) -> list[tuple[int, str]]:
    """(line number, stripped line) of the lines with a word; lines are what stands between \\n."""
    return [(i, x) for i, line in enumerate((text or "").split("\n")) if (x := line.strip(WHITESPACE))]


def line_names(lines: list[str]) -> tuple[list[bytes], np.ndarray]:
    """128-bit hashes of whole lines, their names, and the second halves as numbers, their nodes in coarse clusters."""
    names = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
    return names, np.frombuffer(b"".join(names), ">u8")[1::2].astype(np.uint64)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets) of non-empty lines, in order; repeats stay."""
    chars = np.frombuffer("".join([*lines, "\0" * (CHARS - 1)]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes)
    hashes, span = chars, 1
    while span < CHARS:  # of runs of span characters, those of twice as many
        twice = hashes[:-span] * _DOUBLINGS[span]
        twice += hashes[span:]
        hashes, span = twice, 2 * span
    hashes = mix64(hashes, hashes)
    keep = np.ones(len(hashes), bool)
    for k in range(1, CHARS):  # a run that would start k characters before its line's end
        keep[ends[sizes > k] - k] = False
    for i in np.flatnonzero(sizes < CHARS):  # one shingle: the whole line
        part = chars[ends[i] - sizes[i] : ends[i]]
        hashes[ends[i] - sizes[i]] = mix64(np.atleast_1d((part * _PLACES[: len(part)]).sum(dtype=np.uint64) ^ _PLACES[CHARS]))[0]
    return hashes[keep], np.concatenate([[0], np.cumsum(np.maximum(1, sizes - CHARS + 1))])


def _minima(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(BANDS * ROWS, lines) minima of consecutive shingle sets."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    mixed, out = np.empty_like(short), np.empty((BANDS * ROWS, len(at) - 1), np.uint32)
    for r in range(BANDS * ROWS):
        np.bitwise_xor(short, _FLIPS[r], out=mixed)
        np.multiply(mixed, _MULTIPLIERS[r], out=mixed)
        np.minimum.reduceat(mixed, at[:-1], out=out[r])
    return out


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) keys of the MinHash signatures of non-empty lines, and the lines' sketches. Shingles are made for few
    lines at a time, so that they stay in a core's cache while all minima are taken."""
    sizes = np.cumsum([len(x) for x in lines])
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(0, int(sizes[-1]), CACHE_CHARS)), len(lines)))
    minima = np.concatenate([_minima(*shingles(lines[i:j])) for i, j in zip(cuts[:-1], cuts[1:])], axis=1)
    minima = minima.astype(np.uint64)
    bits = ((minima[:64] * _PLACES[1]) >> np.uint64(63)) << np.arange(64, dtype=np.uint64)[:, None]
    keys, least = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(lines), axis=1), minima.reshape(BANDS, ROWS, -1)
    for r in range(ROWS):
        keys = mix64(keys + least[:, r] * _PLACES[0])
    keys = keys & ~np.uint64(1) | (np.arange(BANDS) == 0).astype(np.uint64)[:, None]  # stars() notes an item that comes again at its odd key
    return keys.T.copy(), np.bitwise_or.reduce(bits, axis=0)


def _batches(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, pa.Array, list[int], list[str]]]:
    """(ids, keys, line numbers, lines) of about `limit` characters at a time."""
    for batch in batches:
        of, numbers, lines, size = [], [], [], 0
        for row, text in enumerate(batch.column("__text").to_pylist()):
            for number, line in split_lines(text):
                of.append(row)
                numbers.append(number)
                lines.append(line)
                size += len(line)
                if size >= limit:
                    yield batch.column("__id").take(pa.array(of)), batch.column("__key").take(pa.array(of)), numbers, lines
                    of, numbers, lines, size = [], [], [], 0
        if lines:
            yield batch.column("__id").take(pa.array(of)), batch.column("__key").take(pa.array(of)), numbers, lines


def _packed(keys: list[np.ndarray], sketches: list[np.ndarray], items: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """What a batch sends: the leaders of each key, and the edges to all others, dealt over the buckets."""
    keys, sketches, items = np.concatenate(keys), np.concatenate(sketches), np.concatenate(items)
    items, first, times = np.unique(items, return_index=True, return_counts=True)
    flat, of = keys[first].ravel(), np.repeat(np.arange(len(items)), BANDS)
    order = np.argsort(flat)
    starts, run = runs(flat[order])
    tied = np.flatnonzero(np.diff(np.append(starts, len(flat)))[run] > 1)
    order[tied] = order[tied][np.lexsort((order[tied], run[tied]))]  # equal keys in order of items
    flat, of = flat[order], of[order]
    leader, member, leads = star_pairs(flat, sketches[first][of])
    again = items[times > 1]
    edges = distinct_pairs(np.concatenate([items[of[leader]], again]), np.concatenate([items[of[member]], again]))
    rows = list(packed_rows(flat[leads], of[leads], np.stack([items, sketches[first]], axis=1), buckets))
    if len(edges):
        rows.append((int(edges[0, 0] % np.uint64(buckets)), b"", b"", edges.tobytes()))
    return packed_batch(rows)


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    keys, sketches, items, size = [], [], [], 0
    for _, _, _, lines in _batches(batches):
        times: dict[str, int] = {}
        for x in lines:
            times[x] = times.get(x, 0) + 1
        own, (own_keys, own_sketches) = line_names(list(times))[1], signatures(list(times))
        again = np.array([n > 1 for n in times.values()])
        for column, value in zip((keys, sketches, items), (own_keys, own_sketches, own)):
            column += [value, value[again]]  # twice what occurs twice: _packed() notes it
        size += sum(map(len, lines))
        if size >= BATCH_CHARS:
            yield _packed(keys, sketches, items, buckets)
            keys, sketches, items, size = [], [], [], 0
    if items:
        yield _packed(keys, sketches, items, buckets)


def _found(batches: Iterator[pa.RecordBatch], wanted, clustered) -> Iterator[pa.RecordBatch]:
    """Occurrences of the lines of `wanted`; a batch's first one of a line of `clustered` has its text."""
    for ids, keys, numbers, lines in _batches(batches):
        names, items = line_names(lines)
        at = np.flatnonzero(may_contain(wanted.value, items))
        in_cluster, texts, seen = may_contain(clustered.value, items).tolist(), [], set()
        for i in at.tolist():
            fresh = in_cluster[i] and names[i] not in seen
            texts.append(lines[i].encode("utf-8", "surrogatepass") if fresh else None)
            seen.add(names[i])
        take = pa.array(at)
        columns = [ids.take(take), keys.take(take), pa.array([numbers[i] for i in at], pa.int32()), pa.array([names[i] for i in at], pa.binary()), pa.array(items[at].view(np.int64)), pa.array([len(lines[i]) for i in at], pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "line", "name", "item", "weight", "payload"])


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap for each set: whether an odd number of its values have a bit in common. Two sets have at least as many values
    apart as their bitmaps, whole or folded by xor, have bits."""
    out = np.empty((len(sets), BITMAP_BITS // 64), np.uint64)
    for row, x in zip(out, sets):
        odd = np.bincount((x & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
        row[:] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def prefix_links(sets: list[np.ndarray], seeds: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs of ascending sets, as far as they connect what the seeds and earlier pairs don't.

    Sets whose bitmaps differ in more bits than similar sets of their sizes may have shingles apart aren't compared: what isn't
    linked, however much of a family's shingles it has, costs a few counted words a pair.
    """
    if len(sets) <= FEW:
        forest, out = Forest(seeds), []
        for q in range(1, len(sets)):
            for p in range(q):
                if forest.root(p) != forest.root(q) and similar(sets[p], sets[q]):
                    forest.join(q, p)
                    out.append((p, q))
        return out
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, part = size[order], Forest(seeds).roots()[order]
    least, whole = np.searchsorted(OF * size, NEED * size), _parities([sets[i] for i in order])
    folded = np.bitwise_xor.reduce(whole.reshape(len(sets), -1, FOLDED_BITS // 64), axis=1).T.copy()
    out, most = [], len(set(part.tolist())) - 1
    for q in range(1, len(sets)):
        if len(out) == most:
            break
        begin = least[q]
        most_apart = (OF - NEED) * (size[begin:q] + size[q])
        apart = np.bitwise_count(folded[:, begin:q] ^ folded[:, q : q + 1]).sum(axis=0, dtype=np.int64)
        near = np.flatnonzero(((OF + NEED) * apart <= most_apart) & (part[begin:q] != part[q]))
        apart = np.bitwise_count(whole[begin + near] ^ whole[q]).sum(axis=1, dtype=np.int64)
        near, apart = (x[(OF + NEED) * apart <= most_apart[near]] for x in (near, apart))
        for p in (begin + near[np.argsort(apart, kind="stable")]).tolist():  # the closest first: one link mostly does
            if part[p] != part[q] and similar(sets[order[p]], sets[order[q]]):
                part[part == part[q]] = part[p]
                out.append((int(order[p]), int(order[q])))
    return out


def _ascending(hashes: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    return hashes[new]


def text_links(texts: list[np.ndarray], seeds: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Linked pairs of lines given as UTF-8 bytes, for all clusters of a task; shingles are made for many clusters at a time."""
    lines = [x.tobytes().decode("utf-8", "surrogatepass") for x in texts]
    until = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    ends = np.append(starts[1:], len(lines))
    cuts = np.unique(np.append(np.searchsorted(until[starts], np.arange(0, until[-1], SLICE_CHARS)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:]):
        first = starts[i]
        hashes, at = shingles(lines[first : ends[j - 1]])
        sets = [_ascending(hashes[x:y]) for x, y in zip(at[:-1], at[1:])]
        for s, e in zip((starts[i:j] - first).tolist(), (ends[i:j] - first).tolist()):
            for x, y in prefix_links(sets[s:e], seeds[first + s : first + e]) if e - s > 1 else ():
                yield int(first) + s + x, int(first) + s + y


def lost_lines(docs: DataFrame) -> DataFrame:
    """(id, key, gone) for the documents of docs (__id, __key, __text) that lose lines; gone: their numbers."""
    kind = dict(docs.dtypes)["__id"]
    newlines = F.coalesce(F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"), F.lit(""))), F.lit(0))
    buckets = int(1 + (docs.agg(F.sum(newlines + 1)).first()[0] or 0) * BANDS // BUCKET_ENTRIES)
    packed = docs.mapInArrow(partial(_send, buckets=buckets), PACKED)
    pairs = materialise(packed.groupBy("bucket").applyInArrow(lambda table: stars(table), "a long, b long"), "line-pairs")
    edges = pairs.where("a <> b")
    n_pairs, n_edges = pairs.agg(F.count("*"), F.count_if(F.col("a") != F.col("b"))).first()
    ends = lambda df: df.select(F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("item"))
    wanted, clustered = member_filter(ends(pairs), "item", 8 * n_pairs), member_filter(ends(edges), "item", 2 * n_edges)
    schema = f"id {kind}, key long, line int, name binary, item long, weight long, payload binary"
    found = materialise(docs.mapInArrow(partial(_found, wanted=wanted, clustered=clustered), schema), "lines")
    coarse = components(edges)
    texts = found.where("payload is not null").groupBy("name").agg(F.first("item").alias("node"), F.first("weight").alias("weight"), F.first("payload").alias("payload"))
    items = materialise(texts.join(coarse, "node").select("label", F.col("name").alias("item"), "weight", "payload"), "clustered-lines")
    labels = components(linked(items, text_links, TASK_SHINGLES, np.uint8)).select(F.col("node").alias("name"), F.col("label").alias("component"))
    # Whatever has many rows is added up before it is joined: occurrences by name, names by component.
    place = F.struct("id", "key", "line")
    by_name = found.groupBy("name").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    by_name = materialise(by_name.join(labels, "name", "left").select("name", "n", "first", F.coalesce("component", "name").alias("component")), "line-names")
    whole = by_name.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("lines"), F.count("*").alias("names")).where("lines > 1").select("component", "stays", "names")
    n_names, n_found = by_name.agg(F.count("*"), F.sum("n")).first()
    verdicts = joined_by_size(by_name.select("component", "name", "n"), whole, "component", "names", n_names).select("name", "n", "stays")
    gone = joined_by_size(found.select("id", "key", "line", "name"), verdicts, "name", "n", n_found or 0).where(~place.eqNullSafe(F.col("stays")))
    out = materialise(gone.groupBy("id", "key").agg(F.collect_set("line").alias("gone")), "lost-lines")
    discard(pairs, found, items, by_name)
    return out


def _without(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, lost = [], []
        for whole, gone in zip(batch.column(text).to_pylist(), batch.column("__gone").to_pylist()):
            if gone:
                gone = set(gone)
                whole = "\n".join(x for i, x in enumerate(whole.split("\n")) if i not in gone)
            out.append(whole)
            lost.append(len(gone or ()))
        columns = [pa.array(out, pa.string()) if i == text else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, pa.int64())], names=[*batch.schema.names[:-1], "__lost"])


def _touched(filter_) -> Column:
    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(may_contain(filter_.value, hashes.to_numpy(np.int64)))

    return test


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed lines gone from their texts, and a column removed_lines (long). No row goes.

    A text without removed lines is unchanged, null stays null. A null id is less than any other. Rows that repeat id and
    text count as one document and keep the same lines. Empty input gives no rows; a column named removed_lines is replaced.
    Documents that surely lose nothing pass straight through; the others are joined with their lines' numbers.
    """
    docs = docs.drop("removed_lines")
    names = [f"__c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    the_id, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    key = F.xxhash64(F.col(text))
    gone = lost_lines(held.select(F.col(the_id).alias("__id"), key.alias("__key"), F.col(text).alias("__text")))
    gone = gone.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    touched = _touched(member_filter(gone.select(F.xxhash64("__id", "__key").alias("hash")), "hash"))
    marked = held.withColumn("__key", key).withColumn("__touched", touched(F.xxhash64(F.col(the_id), "__key")))
    losing = marked.where("__touched").join(gone, F.col(the_id).eqNullSafe(F.col("__id")) & (marked["__key"] == gone["__key"]), "left").select(*names, "__gone")
    kinds, at = dict(held.dtypes), names.index(text)
    shorter = losing.mapInArrow(lambda batches: _without(batches, at), ", ".join([*(f"{n} {kinds[n]}" for n in names), "__lost long"]))
    out = marked.where("not __touched").select(*names, F.lit(0).cast("long").alias("__lost")).unionByName(shorter)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("__lost").alias("removed_lines"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what line deduplication leaves of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
