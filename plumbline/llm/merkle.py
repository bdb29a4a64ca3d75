"""A Merkle manifest of a dataset: a digest for every document, a tree for every source, one root, and a proof for every document.

Nodes are labelled by nested intervals: a node carries the interval [lo, hi) of the leaf ranks that it covers. Trees are built level by
level, each node from at most FANOUT consecutive ones below; a parent keeps its children's intervals and digests. On the way
back down a containment join attaches each node to what is above it: nodes of a level are bucketed by the only parent interval that can
hold them, so a bucket joins one parent with at most FANOUT nodes whatever the size of a source. A node's siblings are
what remains of its parent's interval without its own: the children left of it and those right of it.

Leaf ranks come from ranges of (source, id, digest), not from a window over a source, so a source may hold most rows. What
reaches the driver is the number of levels, the size of each range of a million rows, and the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from .common import ascii_lower, joined_by_size, materialise

#: Children of a node.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _nothing() -> Column:
    """Binary of no bytes."""
    return F.lit(b"")


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def record_digest(*fields: Column) -> Column:
    """A record's digest (32 bytes): of each field `-` if null, else its number of UTF-8 bytes, a colon, and it."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


def _joined(children: Column) -> Column:
    """The digests of nodes, one after the other, as binary."""
    return F.aggregate(children, _nothing(), lambda all_, c: F.concat(all_, c["digest"]))


def families(nodes: DataFrame) -> list[DataFrame]:
    """By level from 1 up: (tree, n, lo, hi, digest, children array<struct<lo, hi, digest>>), from the leaves (tree, n, lo, hi, digest) of
    trees with n leaves. A tree ends at the level where it has one node; a tree of one leaf has no families."""
    most, out, width = nodes.agg(F.max("n")).first()[0] or 0, [], 1
    while width < most:
        below = nodes.where(F.col("n") > width)
        width *= FANOUT
        grouped = below.groupBy("tree", "n", F.expr(f"lo div {width}").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        whole = grouped.select("tree", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), F.unhex(F.sha2(hex_of(_joined(F.col("children"))), 256)).alias("digest"), "children")
        nodes = materialise(whole, f"level-{len(out) + 1}")
        out.append(nodes)
    return out


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the one node that remains of each tree."""
    out, width = leaves.where("n = 1").select("tree", "digest"), 1
    for level in levels:
        out = out.unionByName(level.where((F.col("n") > width) & (F.col("n") <= width * FANOUT)).select("tree", "digest"))
        width *= FANOUT
    return out


def attach(below: DataFrame, above: DataFrame, width: int, kept: list[str]) -> DataFrame:
    """below (tree, lo, hi, ...) with its path: its siblings in the node of `above`, of `width` leaf ranks, that contains it, then that
    node's own path. Columns `kept` come along from above."""
    bucket = F.expr(f"lo div {width}")
    up = above.select("tree", bucket.alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "children", F.col("path").alias("rest"), *kept)
    both = below.withColumn("bucket", bucket).join(up, ["tree", "bucket"]).where((F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to")))
    side = lambda keep: _joined(F.filter("children", keep))
    step = F.struct(side(lambda c: c["hi"] <= F.col("lo")).alias("left"), side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
    return both.withColumn("path", F.concat(F.array(step), "rest")).drop("bucket", "from", "to", "rest", *([] if "children" in below.columns else ["children"]))


def paths(leaves: DataFrame, levels: list[DataFrame], starts: DataFrame | None = None) -> DataFrame:
    """leaves with the path from each to its tree's top and on along what its tree's start (tree, path, more columns) says, and those
    columns. Without starts paths end at the top."""
    kept = [c for c in starts.columns if c not in ("tree", "path")] if starts is not None else []
    nothing = F.array().cast("array<struct<left: binary, right: binary>>")
    begin = lambda nodes: nodes.withColumn("path", nothing) if starts is None else nodes.join(starts, "tree")
    width, above = FANOUT ** len(levels), None
    for level in reversed(levels):
        top = begin(level.where((F.col("n") > width // FANOUT) & (F.col("n") <= width)))
        if above is None:
            above = top
        else:
            named = level.where(F.col("n") > width).withColumnRenamed("children", "own")
            lower = attach(named, above, width * FANOUT, kept).withColumnRenamed("own", "children")
            above = top.unionByName(lower.select(*top.columns))
        width //= FANOUT
    alone = begin(leaves.where("n = 1"))
    if above is None:
        return alone
    return alone.unionByName(attach(leaves.where("n > 1"), above, FANOUT, kept).select(*alone.columns))


def fold(digest: Column, path: Column) -> Column:
    """The root (32 bytes) that follows from a leaf's digest and its path."""
    return F.unhex(F.aggregate(path, hex_of(digest), lambda x, s: F.sha2(F.concat(hex_of(s["left"]), x, hex_of(s["right"])), 256)))


def proof_bytes(path: Column) -> Column:
    """All siblings on the path, level by level, left to right."""
    return F.aggregate(path, _nothing(), lambda all_, s: F.concat(all_, s["left"], s["right"]))


def manifest(leaves: DataFrame, id_col: str = "doc_id", source_col: str = "source", leaf_col: str = "leaf") -> DataFrame:
    """leaves (of binary digests) with subroot, root and path, the sibling digests of each level up to the root.

    Leaves of a source stand by id, a null id first; equal ids by digest. A null source is a source, before all others. Repeated rows
    are leaves each. Empty input gives no rows. Columns named otherwise come along; subroot, root and path are replaced.
    """
    own = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    names = {c: f"c{i}" for i, c in enumerate(own)}
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("-"))
    named = leaves.withColumn("__tree", key).select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("__tree").alias("tree"))
    placed = global_rank(named, ["tree", names[id_col], names[leaf_col]], "place")
    sources = materialise(global_rank(placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n")), ["tree"], "source_place"), "sources")
    total, n_sources = sources.agg(F.sum("n"), F.count("*")).first()
    ranked = joined_by_size(placed, sources.select("tree", "first", "n", F.col("n").alias("size")), "tree", "size", total or 0)
    lo = F.col("place") - F.col("first")
    ranked = materialise(ranked.withColumns({"lo": lo, "hi": lo + 1}).withColumnRenamed(names[leaf_col], "digest").drop("place", "first"), "leaves")

    levels = families(ranked.select("tree", "n", "lo", "hi", "digest"))
    subroots = tops(ranked, levels).join(sources.select("tree", F.col("source_place").alias("hi")), "tree")
    subroots = materialise(subroots.select(F.col("tree").alias("source_tree"), F.lit("root").alias("tree"), F.lit(n_sources).cast("long").alias("n"), (F.col("hi") - 1).alias("lo"), "hi", "digest"), "subroots")
    upper = families(subroots.select("tree", "n", "lo", "hi", "digest"))
    top = tops(subroots, upper).first()
    root = F.lit(bytes(top["digest"]) if top else None).cast("binary")
    starts = paths(subroots, upper).select(F.col("source_tree").alias("tree"), "path", F.col("digest").alias("subroot"))
    found = paths(ranked, levels, materialise(starts, "starts"))
    return found.select(*[F.col("digest" if c == leaf_col else n).alias(c) for c, n in names.items()], "subroot", root.alias("root"), "path")


def digests(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, claimed): each document's digest and, where `tampered` holds, the digest of what is claimed to be it, a
    version with its text's A-Z in lower case (null elsewhere)."""
    other = record_digest(*(ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in fields))
    claimed = F.when(tampered, other) if tampered is not None else F.lit(None).cast("binary")
    return docs.select("doc_id", "source", record_digest(*map(F.col, fields)).alias("leaf"), claimed.alias("claimed"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, its source's subroot, the root, its proof, and whether what is claimed to be it folds to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    folded = fold(F.coalesce("claimed", "leaf"), F.col("path"))
    out = manifest(digests(docs, tampered)).withColumn("folded", folded)
    return out.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        F.sha2(hex_of(proof_bytes(F.col("path"))), 256).alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_FIELDS_SQL = " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
_LOWER_SQL = _FIELDS_SQL.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs: the nodes of all trees of `leaves` (tree, k, digest, m: nodes at that level) by level, and what stands beside each."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, k, digest, m FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, k // 16, sha256(string_agg(digest, '' ORDER BY k)), (max(m) + 15) // 16 FROM {name} WHERE m > 1 GROUP BY tree, level, k // 16
), {name}_sides AS (
  SELECT a.tree, a.level, a.k, coalesce(string_agg(b.digest, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.k // 16 = b.k // 16 WHERE a.m > 1 GROUP BY a.tree, a.level, a.k
)"""


ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(n))
), hashed AS (
  SELECT doc_id, coalesce('s' || source, '-') AS tree, sha256({_FIELDS_SQL}) AS leaf, sha256({_LOWER_SQL}) AS other,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) AS crc
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, leaf AS digest, count(*) OVER (PARTITION BY tree) AS m FROM hashed
), {_tree_sql("lower_tree", "leaves")}, subroots AS (
  SELECT 'root' AS tree, tree AS source_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS m FROM lower_tree WHERE m = 1
), {_tree_sql("upper_tree", "subroots")}, steps AS (
  SELECT v.doc_id, v.tree, v.k, s.level, s.l, s.r FROM leaves v JOIN lower_tree_sides s ON s.tree = v.tree AND s.k = v.k // (16 ** s.level)::BIGINT
  UNION ALL
  SELECT v.doc_id, v.tree, v.k, 1000 + s.level, s.l, s.r FROM leaves v JOIN subroots u ON u.source_tree = v.tree JOIN upper_tree_sides s ON s.k = u.k // (16 ** s.level)::BIGINT
), proofs AS (
  SELECT tree, k, string_agg(l || r, '' ORDER BY level) AS proof, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM steps GROUP BY tree, k
), folded AS (
  SELECT v.doc_id, v.tree, v.k, v.leaf, 0 AS step, CASE WHEN v.crc % 5 = 0 THEN v.other ELSE v.leaf END AS x, p.proof, p.ls, p.rs FROM leaves v LEFT JOIN proofs p USING (tree, k)
  UNION ALL
  SELECT doc_id, tree, k, leaf, step + 1, sha256(ls[step + 1] || x || rs[step + 1]), proof, ls, rs FROM folded WHERE step < len(ls)
)
SELECT f.doc_id, f.leaf, u.digest AS subroot, t.digest AS root, sha256(coalesce(f.proof, '')) AS proof_sha256, f.x AS folded_root, f.x = t.digest AS verified
FROM folded f JOIN subroots u ON u.source_tree = f.tree JOIN upper_tree t ON t.m = 1 WHERE f.step = coalesce(len(f.ls), 0)
"""
