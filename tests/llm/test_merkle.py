"""op13 against a tree built by hand, row by row."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """(root, [(left, right) by level] of each leaf)."""
    steps, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(at):
            run = digests[k // 16 * 16 : k // 16 * 16 + 16]
            steps[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        digests, at = [sha(*digests[i : i + 16]) for i in range(0, len(digests), 16)], [k // 16 for k in at]
    return digests[0], steps


def brute(rows):
    by, out = defaultdict(list), []
    for r in rows:
        by[r[1]].append((r[0], leaf_of(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in by[s]]) for s in sources if not by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))}
    root, up = tree([trees[s][0] for s in sources])
    for s, above in zip(sources, up):
        for (i, leaf, r), own in zip(by[s], trees[s][1]):
            path, bad = own + above, i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            x = leaf_of([*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])]) if bad else leaf
            for left, right in path:
                x = sha(left, x, right)
            out.append((i, leaf, trees[s][0], root, sha(*(a + b for a, b in path)), x, x == root))
    return Counter(out)


def frame(spark, tmp_path, rows):
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return Counter(map(tuple, merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("n,source", [(1, lambda i: None), (16, lambda i: "a"), (17, lambda i: "a"), (300, lambda i: ["a", None, "é", "b"][max(0, i % 60 - 56)]), (40, str)])
def test_trees(spark, tmp_path, n, source):
    rows = [(i, source(i), "en", 3, f"Text {i}") for i in range(n)]
    assert frame(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, empty and long texts."""
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "X"), (5, "a", None, 2, ""), (5, "a", None, 2, ""), (5, "a", "de", 2, "B"), (7, "b", "en", -1, "É" * 100_000)] * 9
    assert frame(spark, tmp_path, rows) == brute(rows)
    (tmp_path / "none").mkdir()
    assert not frame(spark, tmp_path / "none", [])


def test_manifest_keeps_columns_and_proofs_fold(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"), F.lit("x").alias("root"), F.lit(1).alias("lo"), F.lit(2).alias("tree"))
    got = merkle.manifest(rows)
    assert got.columns == ["doc_id", "source", "leaf", "lo", "tree", "subroot", "root", "path"]
    assert got.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 40
    assert got.where(merkle.fold(F.unhex(F.lit("00")), F.col("path")) == F.col("root")).count() == 0
    assert got.where((F.col("lo") == 1) & (F.col("tree") == 2) & (F.size("path") == 2)).count() == 40
