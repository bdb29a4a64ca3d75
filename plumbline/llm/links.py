"""Linking items at scale: keys exchanged as packed arrays, distributed union-find, and exact linking inside coarse clusters.

Coarse clusters are found on 64-bit hashes of the items' content, where a collision at worst puts two items into one cluster;
linked() and components() take names of any type that Spark can order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_size, materialise

#: Rows of an exchange: the keys of one bucket that one batch has, each with the place of its item among the row's items.
PACKED = "bucket int, keys binary, refs binary, items binary"
EDGES = "a long, b long"


def packed_rows(keys: np.ndarray, refs: np.ndarray, items: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """PACKED rows of a batch: uint64 keys cut to a bucket and 32 bits; refs index items (uint64, one or more for each)."""
    bucket = (((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[b] : cuts[b + 1]]
        used, at = np.unique(refs[mine], return_inverse=True)
        at = at.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
        yield int(b), keys[mine].astype(np.uint32).tobytes(), at.tobytes(), items[used].tobytes()


def packed_batch(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "keys", "refs", "items"])


def unpacked(table: pa.Table, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, entries' items, entries' row) of one bucket's PACKED rows, sorted by key. width: numbers of an item."""
    keys, items, rows = [np.zeros(0, np.uint32)], [np.zeros((0, width), np.uint64)], [np.zeros(0, np.int32)]
    for i, (k, r, x) in enumerate(zip(table.column("keys"), table.column("refs"), table.column("items"))):
        k, r, x = np.frombuffer(k.as_buffer(), np.uint32), r.as_buffer(), np.frombuffer(x.as_buffer(), np.uint64)
        r = np.frombuffer(r, np.uint16 if len(r) == 2 * len(k) else np.uint32)
        keys.append(k)
        items.append(x.reshape(-1, width)[r])
        rows.append(np.full(len(k), i, np.int32))
    keys, items, rows = np.concatenate(keys), np.concatenate(items), np.concatenate(rows)
    items = items[:, 0] if width == 1 else items
    order = np.argsort(keys, kind="stable")
    return keys[order], items[order], rows[order]


def dealt(items: np.ndarray, slots: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, places of the items that go there, in order)."""
    slot = (items % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(slots + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal keys starts, the run of each entry) of sorted keys."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


#: Sketches are single bits of 64 minima. Of lines with a similarity of 0.8, nine bits in ten agree on average; more than this
#: many differ for about one pair in 100,000.
SKETCH_BITS_APART = 18
#: Leaders that are tried for one key before what is left joins the first one unseen.
LEADERS = 64


def star_pairs(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaders, members, which entries lead): places in sorted keys. Among the entries of a key the first one leads those with a
    sketch close to its own, the first of the others leads likewise, and so on."""
    starts, run = runs(keys)
    leads, alive = np.ones(len(keys), bool), np.flatnonzero(np.diff(np.append(starts, len(keys)))[run] > 1)
    pairs = [np.zeros((2, 0), np.int64)]
    for turn in range(LEADERS + 1):
        if not len(alive):
            break
        first, at = runs(run[alive])
        leader = alive[first][at] if turn < LEADERS else starts[run[alive]]
        apart = np.bitwise_count(sketches[alive] ^ sketches[leader])
        near = (apart <= SKETCH_BITS_APART) | (leader == alive) | (turn == LEADERS)
        new = near & (leader != alive)
        leads[alive[new]] = False
        pairs.append(np.stack([leader[new], alive[new]]))
        alive = alive[~near]
    leader, member = np.concatenate(pairs, axis=1)
    return leader, member, leads


def shared_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, items with sketches) of the entries of one bucket whose key another entry has too, in no order: most keys are alone, and
    nothing is looked up or sorted with them."""
    columns = [table.column(c) for c in ("keys", "refs", "items")]
    rows = [(np.frombuffer(k.as_buffer(), np.uint32), r.as_buffer(), x.as_buffer()) for k, r, x in zip(*columns)]
    ordered = np.sort(np.concatenate([np.zeros(0, np.uint32), *(k for k, _, _ in rows)]))
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    keys, items = [np.zeros(0, np.uint32)], [np.zeros((0, 2), np.uint64)]
    if len(again):
        maybe = np.zeros(1 << 20, bool)
        maybe[again & np.uint32((1 << 20) - 1)] = True
        for k, r, x in rows:
            at = np.flatnonzero(maybe[k & np.uint32((1 << 20) - 1)])
            at = at[again[np.minimum(np.searchsorted(again, k[at]), len(again) - 1)] == k[at]]
            r = np.frombuffer(r, np.uint16 if len(r) == 2 * len(k) else np.uint32)
            keys.append(k[at])
            items.append(np.frombuffer(x, np.uint64).reshape(-1, 2)[r[at]])
    return np.concatenate(keys), np.concatenate(items)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, 2): the distinct pairs in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], axis=1)


def stars(table: pa.Table) -> pa.Table:
    """EDGES from leaders to the items with a key in common and a close sketch, for one bucket of items with sketches; an item
    that more than one batch has gets an edge to itself, from its odd key only. Rows without keys hold edges that a batch found by itself."""
    ready = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for k, x in zip(table.column("keys"), table.column("items")) if not len(k.as_buffer())]
    table = table.filter(pc.greater(pc.binary_length(table.column("keys")), 0))
    keys, items = shared_entries(table)
    order = np.lexsort((items[:, 0], keys))
    keys, items = keys[order], items[order]
    leader, member, _ = star_pairs(keys, items[:, 1])
    once = (items[leader, 0] != items[member, 0]) | (keys[member] & np.uint32(1) == 1)
    edges = np.concatenate([np.stack([items[leader[once], 0], items[member[once], 0]], axis=1), *ready])
    edges = distinct_pairs(edges[:, 0], edges[:, 1])
    return pa.table({"a": edges[:, 0].copy().view(np.int64), "b": edges[:, 1].copy().view(np.int64)})


def member_filter(ids: DataFrame, column: str, rows: int | None = None, most_bits: int = 1 << 30) -> Broadcast:
    """A bitmap for may_contain(): 8 bits or more for each id (`rows` of them, if they are counted already), at most most_bits in
    all (128 MB), where it fills up and lets more through."""
    bits, rows = 1 << 16, ids.count() if rows is None else rows
    while bits < min(8 * rows, most_bits):
        bits *= 2
    slot = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("part")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in parts:
        bitmap[(row["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(row["part"], np.uint8)[: len(bitmap)]
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def may_contain(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): the least node that it reaches. Distributed union-find by contraction.

    Each round joins every node to its least neighbour and contracts the edges; local minima stay. Rounds are written to the
    shared folder and deleted when nothing reads them any more. Nodes at least halve in two rounds, so the rounds grow with
    the logarithm of the largest component, and all rounds together have a few times the nodes of the first. Labels are put
    together from the last round backwards, so each join has the nodes of its own round only. Nodes with very many neighbours
    are joined by broadcast.
    """
    current = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    hops: list[DataFrame] = []
    while n_edges := current.count():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("degree"))
        parent = materialise(parent.select("node", F.least("node", "least").alias("parent"), "degree"), "parents")
        hops.append(parent)
        moved, most = current, parent.agg(F.max("degree")).first()[0]
        for c in ("a", "b"):
            moved = joined_by_size(moved, parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"), "degree"), c, "degree", n_edges, most)
        after = materialise(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "edges")
        discard(current)
        current = after
    if not hops:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = hops[-1].select("node", F.col("parent").alias("label"))
    for hop in hops[-2::-1]:
        later = labels.select(F.col("node").alias("parent"), "label")
        labels = hop.join(later, "parent", "left").select("node", F.coalesce("label", "parent").alias("label"))
    labels = materialise(labels, "components")
    discard(current, *hops)
    return labels


class Forest:
    """Union-find over 0..n-1, with items of equal seeds joined from the start."""

    def __init__(self, seeds: np.ndarray):
        first: dict = {}
        self.up = [first.setdefault(seed, i) for i, seed in enumerate(seeds.tolist())]

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)

    def roots(self) -> np.ndarray:
        """All roots at once."""
        up = np.array(self.up)
        while True:
            higher = up[up]
            if (higher == up).all():
                self.up = up.tolist()
                return up
            up = higher


#: (payloads, seeds, where each cluster starts) -> pairs of indexes that are linked and connect what the seeds and earlier
#: pairs of their cluster don't.
Linker = Callable[[list[np.ndarray], np.ndarray, np.ndarray], Iterable[tuple[int, int]]]


def each_cluster(linker: Callable[[list[np.ndarray], np.ndarray], list[tuple[int, int]]]) -> Linker:
    """A Linker from one that takes a single cluster's payloads and seeds."""

    def link(payloads: list[np.ndarray], seeds: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(payloads)]):
            for x, y in linker(payloads[i:j], seeds[i:j]) if j - i > 1 else ():
                yield i + x, i + y

    return link


def _link(table: pa.Table, linker: Linker, kind: type) -> pa.Table:
    table = table.take(pc.sort_indices(table, sort_keys=[("label", "ascending"), ("item", "ascending")]))
    label, item, seed = (table.column(c).to_numpy() for c in ("label", "item", "seed"))  # names that are no numbers come as objects
    new = np.ones(len(item), bool)
    new[1:] = (label[1:] != label[:-1]) | (item[1:] != item[:-1])
    keep = np.flatnonzero(new)
    label, item, seed, payload = label[keep], item[keep], seed[keep], table.column("payload").take(pa.array(keep))
    starts, _ = runs(label)
    sets = [np.frombuffer(x.as_buffer(), kind) for x in payload]
    pairs = np.array(list(linker(sets, seed, starts)), np.int64).reshape(-1, 2)
    kind = table.schema.field("item").type
    return pa.table({"a": pa.array(item[pairs[:, 0]], kind), "b": pa.array(item[pairs[:, 1]], kind)})


def linked(items: DataFrame, linker: Linker, limit: int, kind: type = np.uint64) -> DataFrame:
    """EDGES that connect all items of a cluster that links connect; no others.

    items: label (the coarse cluster; links never leave it), item (its name, of any type), weight, payload (packed values of a
    numpy kind). A task gets clusters of about an eighth of `limit` in all. A cluster over `limit` is cut into chunks of that weight: chunks are linked by themselves; then
    a few members of each component, to connect the components over chunks; then whatever is still outside the cluster's
    main component is held against all chunks, which finds every link that is left.
    """
    items = items.select("label", "item", "weight", "payload")
    sizes = materialise(items.groupBy("label").agg(F.sum("weight").alias("total")), "cluster-sizes")
    tasks = 1 + 8 * (sizes.agg(F.sum("total")).first()[0] or 0) // limit
    edge_kind = "a {0}, b {0}".format(dict(items.dtypes)["item"])
    chunks = F.ceil(F.col("total") / limit)
    sized = items.join(sizes.select("label", chunks.alias("chunks")), "label").withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")))
    big = F.col("chunks") > 1
    keyed = sized.withColumns({"k1": F.when(big, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(tasks))), "k2": F.when(big, F.col("chunk")).otherwise(-1), "k3": F.lit(0), "seed": F.col("item")})

    def edges(df: DataFrame) -> DataFrame:
        grouped = df.select("k1", "k2", "k3", "label", "item", "seed", "payload").groupBy("k1", "k2", "k3")
        return materialise(grouped.applyInArrow(lambda key, table: _link(table, linker, kind), edge_kind), "links")

    first = edges(keyed)
    if sizes.where(chunks > 1).isEmpty():
        return first
    members = materialise(sized.where(big), "large-clusters")

    def with_seeds(found: DataFrame) -> DataFrame:
        seeds = components(found).select(F.col("node").alias("item"), F.col("label").alias("__seed"))
        return members.join(seeds, "item", "left").withColumn("seed", F.coalesce("__seed", "item")).drop("__seed")

    now = with_seeds(first)
    some = now.groupBy("label", "seed", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(8)).alias("slot")).agg(F.min("item").alias("item")).select("label", "item")
    some = materialise(now.join(some, ["label", "item"], "left_semi"), "members")
    groups = some.groupBy("label").agg(F.ceil(F.sum("weight") / limit).alias("groups"))
    second = edges(some.join(groups, "label").withColumns({"k1": F.col("label"), "k2": F.pmod(F.xxhash64("item", F.lit(2)), F.col("groups")), "k3": F.lit(1)}))
    found = first.unionByName(second)
    now = materialise(with_seeds(found), "seeded")
    main = now.groupBy("label", "seed").agg(F.sum("weight").alias("w")).groupBy("label").agg(F.max_by("seed", F.struct("w", "seed")).alias("main"))
    outside = materialise(now.join(main, "label").where("seed <> main").drop("main"), "outside")
    if outside.isEmpty():
        return found
    cuts = outside.groupBy("label").agg(F.ceil(F.sum("weight") / limit).alias("cuts"))
    everyone = now.join(cuts, "label").withColumn("k3", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).withColumn("k2", F.col("chunk"))
    others = outside.join(cuts, "label").withColumn("k3", F.pmod(F.xxhash64("item", F.lit(3)), F.col("cuts"))).withColumn("k2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    third = edges(everyone.unionByName(others).withColumn("k1", F.col("label")))
    return found.unionByName(third)
