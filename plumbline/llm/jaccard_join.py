"""Exact n-gram Jaccard self-join with a count-vector R-tree.

A document is the set of its distinct 5-word shingles. Shingles are hashed into GROUPS groups; a document's point has their
counts. Two sets share at most the sum of the smaller of their counts, group by group, and a box of points allows no more
than its upper corner does, so a search descends only where the bound reaches the overlap that a Jaccard of 0.8 needs. Pairs
that pass are verified on the sets.

Points of unrelated documents of one size lie close together, so one tree over a whole corpus prunes little above its
leaves. The tree is therefore planted in coarse clusters that no link leaves, found exactly in three steps:

1. Sets that occur more than once are one item.
2. A set with a partner shares at least 0.8 of its shingles with other sets. All shingles are exchanged by hash, packed, and
   sets are counted off against this; most documents drop out here.
3. Of two linked sets, the n - ceil(0.8 n) + 1 rarest shingles (by the remaining sets that have them, roughly, then by hash)
   have one in common. Sets that share such a shingle are in one coarse cluster. Rare ones come first so that a passage that
   many documents share doesn't tie their groups together.

Clusters of any size are linked in bounded tasks (links.linked); within one, the search skips what is connected already,
so a group of near copies takes time near its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_size, materialise, mix64, shingle_hashes, string_bytes, word_hashes
from .links import PACKED, Forest, components, dealt, each_cluster, linked, may_contain, member_filter, packed_batch, packed_rows, runs, unpacked

WORDS = 5
#: Similarity 0.8 as integers: 100 * intersection >= 80 * union.
NEED, OF = 80, 100
GROUPS = 64
#: Points of a leaf, and children of a box.
FAN = 4
#: Shingles of an exchange's bucket.
BUCKET_SHINGLES = 2_000_000
#: Shingles that one task links at a time.
TASK_SHINGLES = 2_000_000
BATCH_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES of text."""
    for batch in batches:
        _, offsets = string_bytes(batch.column(column))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(offsets, np.arange(BATCH_BYTES, offsets[-1], BATCH_BYTES)), [len(batch)]]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(i, j - i)


def text_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, offsets, fingerprints) of texts: each text's distinct shingles, ascending."""
    data, offsets = string_bytes(texts)
    words, at = word_hashes(data, offsets)
    grams, at = shingle_hashes(words, at, WORDS)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams + np.uint64(0x51ED270B)))])
    prints = mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))
    return grams, at, prints


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        _, at, prints = text_sets(batch.column("__text"))
        yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.diff(at), pa.int64()), pa.array(prints.view(np.int64))], names=["__id", "n", "item"])


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        grams, at, prints = text_sets(batch.column("__text"))
        _, first = np.unique(prints, return_index=True)
        once = np.zeros(len(prints), bool)
        once[first] = True
        n = np.diff(at)
        keep = np.repeat(once, n)
        rows = list(packed_rows(grams[keep], np.repeat(np.arange(len(n)), n)[keep], prints, buckets))
        if rows:
            yield packed_batch(rows)


def _shared(table: pa.Table, slots: int) -> pa.Table:
    """Packed by slots of items: how many of an item's keys in this bucket another item has too; items without one are left out."""
    keys, items, rows = unpacked(table)
    starts, run = runs(keys)
    common = (np.minimum.reduceat(items, starts) != np.maximum.reduceat(items, starts))[run]
    items, rows = items[common], rows[common]
    order = np.lexsort((rows, items))
    pair = np.stack([items[order], rows[order].astype(np.uint64)])
    new = np.ones(len(items), bool)
    new[1:] = (pair[:, 1:] != pair[:, :-1]).any(0)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(items)))  # by item and row; rows that repeat an item have the same count
    found, where = np.unique(pair[0][at], return_index=True)
    counts = counts[where].astype(np.uint32)
    out = [(s, found[i].tobytes(), counts[i].tobytes()) for s, i in dealt(found, slots)]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["slot", "items", "counts"])


def _sums(table: pa.Table) -> pa.Table:
    """(item, shared) of one slot over all buckets."""
    items = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
    found, at = np.unique(items, return_inverse=True)
    return pa.table({"item": found.view(np.int64), "shared": np.bincount(at, counts).astype(np.int64)})


def _sets(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        grams, at, prints = text_sets(batch.column("__text"))
        _, first = np.unique(prints, return_index=True)
        keep = first[may_contain(wanted.value, prints[first]) & (np.diff(at)[first] > 0)]
        sets = [grams[at[i] : at[i + 1]].tobytes() for i in keep]
        yield pa.RecordBatch.from_arrays([pa.array(prints[keep].view(np.int64)), pa.array(np.diff(at)[keep], pa.int64()), pa.array(sets, pa.binary())], names=["item", "weight", "payload"])


def prefix_length(n):
    return n - -(-NEED * n // OF) + 1


def _send_sets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("payload")]
        items = batch.column("item").to_numpy().view(np.uint64)
        n = np.array([len(s) for s in sets], np.int64)
        until = np.cumsum(n)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(until, np.arange(BUCKET_SHINGLES // 2, until[-1] if len(n) else 0, BUCKET_SHINGLES // 2)), [len(n)]]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield packed_batch(list(packed_rows(np.concatenate(sets[i:j]), np.repeat(np.arange(j - i), n[i:j]), items[i:j], buckets)))


def _rarities(table: pa.Table, slots: int) -> pa.Table:
    """Packed by slots of items: for each item's keys in this bucket, ascending, about how many items have them (0: no other)."""
    keys, items = [], []
    for k, r, x in zip(*(table.column(c) for c in ("keys", "refs", "items"))):
        k, r, x = np.frombuffer(k.as_buffer(), np.uint32), r.as_buffer(), np.frombuffer(x.as_buffer(), np.uint64)
        keys.append(k)
        items.append(x[np.frombuffer(r, np.uint16 if len(r) == 2 * len(k) else np.uint32)])
    keys, items = np.concatenate(keys), np.concatenate(items)  # an item's keys stand together
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    rarity = np.ceil(4 * np.log2(counts)).astype(np.uint8)[at]
    out = []
    for s, i in dealt(items, slots):
        starts, _ = runs(items[i])
        out.append((s, table.column("bucket")[0].as_py(), items[i][starts].tobytes(), np.diff(np.append(starts, len(i))).astype(np.uint32).tobytes(), rarity[i].tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["slot", "bucket", "items", "counts", "rarity"])


def _prefixes(sets: pa.Table, answers: pa.Table) -> pa.Table:
    """(item, head) for the sets of one slot: each set's rarest shingles, less those that no other set has. Buckets are ranges of
    hashes, so a set's answers in bucket order follow its ascending hashes. A set with too few shared shingles has no heads."""
    answers = answers.sort_by("bucket")
    parts: dict[int, list[np.ndarray]] = {}
    for i, c, r in zip(*(answers.column(x) for x in ("items", "counts", "rarity"))):
        c = np.frombuffer(c.as_buffer(), np.uint32)
        for item, part in zip(np.frombuffer(i.as_buffer(), np.int64).tolist(), np.split(np.frombuffer(r.as_buffer(), np.uint8), np.cumsum(c)[:-1])):
            parts.setdefault(item, []).append(part)
    items, heads = [], []
    for item, payload in zip(sets.column("item").to_pylist(), sets.column("payload")):
        keys, rarity = np.frombuffer(payload.as_buffer(), np.uint64), np.concatenate(parts[item])
        if OF * int((rarity > 0).sum()) >= NEED * len(keys):
            first = np.lexsort((keys, rarity))[: prefix_length(len(keys))]
            heads.append(keys[first[rarity[first] > 0]])
            items.append(np.full(len(heads[-1]), item, np.int64))
    return pa.table({"item": np.concatenate([np.zeros(0, np.int64), *items]), "head": np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)})


def prefixes(sets: DataFrame) -> DataFrame:
    """(item, head): two sets that link have a head in common."""
    parts = int(1 + (sets.agg(F.sum("weight")).first()[0] or 0) // BUCKET_SHINGLES)
    packed = sets.select("item", "payload").mapInArrow(lambda batches: _send_sets(batches, parts), PACKED)
    answers = packed.groupBy("bucket").applyInArrow(lambda table: _rarities(table, parts), "slot int, bucket int, items binary, counts binary, rarity binary")
    slot = F.expr(f"cast(pmod(cast(conv(hex(item), 16, 10) as decimal(20, 0)), {parts}) as int)")  # of the unsigned number
    own = sets.select(slot.alias("slot"), "item", "payload")
    return own.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(_prefixes, "item long, head long")


class Tree:
    """An R-tree over the group counts of sets. Leaves and boxes have FAN members each; a box has the largest count of each group and the
    range of sizes. `seen` and `skipped` count the points that searches looked at, and those that a box's bound kept from it."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        self.points = np.stack([np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets]).astype(np.int32)
        # Leaves hold points that are close: by size, then by the coordinates with the widest spread.
        order = np.argsort(self.sizes, kind="stable")
        for depth, k in enumerate(np.argsort(-self.points.var(0))[:4], 1):
            step = max(FAN, n // 2**depth + 1)
            order = np.concatenate([t[np.argsort(self.points[t, k], kind="stable")] for t in np.split(order, range(step, n, step))])
        self.order, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.levels, level = [], (self.points[order], self.sizes[order], self.sizes[order])
        while len(level[1]) > 1:
            heads = np.arange(0, len(level[1]), FAN)
            level = (np.maximum.reduceat(level[0], heads), np.minimum.reduceat(level[1], heads), np.maximum.reduceat(level[2], heads))
            self.levels.append(level)
        self.seen = self.skipped = 0

    def reach(self, level: tuple, boxes: np.ndarray, q: int) -> np.ndarray:
        """Those boxes that may hold a partner: (100 + 80) * overlap >= 80 * (sum of sizes) for some size that the box has. The
        overlap is at most the sum over groups of the smaller of the set's count and the box's."""
        corner, low, up = (x[boxes] for x in level)
        size = self.sizes[q]
        ok = (NEED * low <= OF * size) & (OF * up >= NEED * size)
        ok[ok] = (OF + NEED) * np.minimum(corner[ok], self.points[q]).sum(1) >= NEED * (size + np.maximum(low[ok], NEED * size // OF))
        return boxes[ok]

    def before(self, q: int) -> np.ndarray:
        """The sets earlier in the tree's order that the bounds allow to be partners of q."""
        until, boxes = int(self.place[q]), np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            boxes = self.reach(self.levels[depth], boxes[boxes * FAN ** (depth + 1) < until], q)
            boxes = (boxes[:, None] * FAN + np.arange(FAN)).ravel()
        near = boxes[boxes < until]
        self.seen += len(near)
        self.skipped += until - len(near)
        near = self.order[near]
        return near[(OF + NEED) * np.minimum(self.points[near], self.points[q]).sum(1) >= NEED * (self.sizes[near] + self.sizes[q])]


def rtree_links(sets: list[np.ndarray], seeds: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs of indexes that connect all that links connect beyond the seeds."""
    tree, forest, out = Tree(sets), Forest(seeds), []
    roots, fresh = forest.roots(), 0
    for q in tree.order.tolist():
        if fresh:
            roots, fresh = forest.roots(), 0
        near = tree.before(q)
        near = near[roots[near] != roots[q]]  # what is connected already needs no link
        bound = np.minimum(tree.points[near], tree.points[q]).sum(1)
        for p in near[np.argsort(-bound, kind="stable")].tolist():
            if forest.root(p) != forest.root(q) and similar(sets[p], sets[q]):
                forest.join(p, q)
                out.append((p, q))
                fresh += 1
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending arrays of distinct values have a Jaccard similarity of 0.8 or more."""
    if len(a) > len(b):
        a, b = b, a
    if OF * len(a) < NEED * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return OF * both >= NEED * (len(a) + len(b) - both)


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_shingles, component_id (the least id that links reach, the row's own included).

    Null and empty texts, and texts without words, have no shingles and link with nothing. Rows with equal sets are
    connected; null ids are greater than none and only chosen where a component has no other. Texts are read whole, repeated
    rows stay, empty input gives no rows, and other columns are not read. Shingles and sets are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(docs.dtypes)["__id"]
    rows = materialise(docs.mapInArrow(_fingerprints, f"__id {kind}, n long, item long"), "fingerprints")
    n_shingles, n_rows = rows.agg(F.sum("n"), F.count("*")).first()
    buckets = int(1 + (n_shingles or 0) // BUCKET_SHINGLES)
    packed = docs.mapInArrow(lambda batches: _send(batches, buckets), PACKED)
    shared = packed.groupBy("bucket").applyInArrow(lambda table: _shared(table, buckets), "slot int, items binary, counts binary").groupBy("slot").applyInArrow(lambda table: _sums(table), "item long, shared long")
    sizes = rows.where("n > 0").groupBy("item").agg(F.min("n").alias("n"))
    candidates = materialise(shared.join(sizes, "item").where(OF * F.col("shared") >= NEED * F.col("n")).select("item"), "candidates")
    wanted = member_filter(candidates, "item")
    found = docs.mapInArrow(lambda batches: _sets(batches, wanted), "item long, weight long, payload binary")
    sets = materialise(found.join(candidates, "item", "left_semi").groupBy("item").agg(F.first("weight").alias("weight"), F.first("payload").alias("payload")), "sets")
    heads = materialise(prefixes(sets), "prefixes")
    firsts = materialise(heads.groupBy("head").agg(F.min("item").alias("a"), F.count("*").alias("c")).where("c > 1"), "heads")
    coarse = components(joined_by_size(heads, firsts, "head", "c", heads.count()).select("a", F.col("item").alias("b")))
    discard(heads, firsts)
    items = sets.join(coarse.withColumnRenamed("node", "item"), "item")
    labels = components(linked(items, each_cluster(rtree_links), TASK_SHINGLES)).select(F.col("node").alias("item"), F.col("label").alias("__label"))
    labelled = materialise(rows.join(labels, "item", "left").select("__id", "n", F.when(F.col("n") > 0, F.coalesce("__label", "item")).alias("__group")), "labelled")
    least = materialise(labelled.where("__group is not null").groupBy("__group").agg(F.min("__id").alias("least"), F.count("*").alias("size")).where("size > 1"), "groups")
    # Groups with a thousandth of the rows or more, at most a thousand of them, are joined by broadcast: no task gets a hot group.
    hot = max(1000, n_rows // 1000)
    some = F.broadcast(least.where(F.col("size") >= hot).select("__group", F.col("least").alias("__hot"), F.lit(True).alias("__is_hot")))
    marked = labelled.join(some, "__group", "left")
    plain = marked.where("__is_hot is null").join(least.where(F.col("size") < hot), "__group", "left")
    out = plain.select("__id", "n", F.coalesce("least", "__id").alias("component")).unionByName(marked.where("__is_hot").select("__id", "n", F.col("__hot").alias("component")))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the row with the least id (null ids come last), and of those the
    least text hash. Rows are chosen by id and text, not by id alone, so ids may be null or repeat; of rows that repeat both,
    one stays, and so does every other row without words."""
    key = {"__null": F.col(id_col).isNull(), "__id": F.col(id_col), "__hash": F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))}
    keyed = docs.select(F.struct(*(c.alias(n) for n, c in key.items())).alias("__key"), F.col(text_col).alias("__text"))
    least = clusters(keyed, "__key", "__text").where(F.col("__key") == F.col("component_id"))
    keep = least.select(F.col("__key.__id").alias("__keep"), F.col("__key.__hash").alias("__keep_hash")).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__keep")) & (key["__hash"] == F.col("__keep_hash")), "left_semi").dropDuplicates([id_col, text_col])


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's component."""
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
