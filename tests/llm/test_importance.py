"""op12 against a plain version, its hashes against zlib, its sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import common, importance


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@given(st.lists(st.text(alphabet="aB \né0.zZ日", max_size=30), max_size=8), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_features_are_hashed_as_zlib_does(texts, longest):
    found, text, n_words = importance.features(*common.string_bytes(pa.array(texts, pa.string())), 10_000, longest)
    want = Counter((i, zlib.crc32(r.encode()) % 10_000) for i, t in enumerate(texts) for r in runs(t, longest))
    assert Counter(zip(text.tolist(), found.tolist())) == want and n_words.tolist() == [len(words(t)) for t in texts]


def test_long_words():
    texts = ["x" * 100_000 + " y" + "é" * 70, "", None, "a" * 48, "a" * 49]
    found, text, _ = importance.features(*common.string_bytes(pa.array(texts, pa.string())), 1 << 31, 2)
    assert sorted(found.tolist()) == sorted(zlib.crc32(r.encode()) % (1 << 31) for t in texts for r in runs(t, 2))


def plain(docs, targets, percent=10, min_words=20, buckets=10_000, longest=1, seed=2024):
    count = lambda texts: np.bincount([zlib.crc32(r.encode()) % buckets for t in texts for r in runs(t, longest)], minlength=buckets).tolist()
    s, t = count([x for _, x in docs]), count(targets)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        own = [gain[zlib.crc32(r.encode()) % buckets] for r in runs(x, longest)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= min_words))
    some = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = len(some) * percent // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(some)] + [(*r[:4], None) for r in rows if not r[4]])


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    targets = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, importance.op12_importance_resampling(spark, sf).collect())) == plain(docs, targets)


def test_odd_rows_and_parameters(spark):
    long = " ".join(f"w{i % 50}" for i in range(200))
    docs = [(None, None), (None, long), (1, ""), (2, long), (2, long), (3, long.upper()), (4, "x " * 30_000), (5, "é" * 90_000), (-(2**63), long), (2**63 - 1, long + " tail")] * 3
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, __place int")
    target = spark.createDataFrame([("w1 w2 w3",), (None,), ("",)], "text string")
    got = importance.resample(frame, target, percent=50, min_words=3, longest=2, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(docs, ["w1 w2 w3"], 50, 3, 500, 2)
    assert importance.resample(frame.limit(0), target).count() == 0
    assert importance.resample(frame, target.limit(0)).where("rank is not null").count() == 2


def test_radix_sort(spark, monkeypatch):
    """Many rows of one score and many equal rows; blocks smaller than a digit's rows; wide and narrow keys; stable."""
    monkeypatch.setattr(importance, "DIGIT_BITS", 3)
    rng = random.Random(3)
    for wide in (20, 2**61, 2**63 - 1):
        rows = [(rng.choice([0, 0, 0, rng.randrange(-30, 30)]), rng.choice([None, 7, rng.randrange(-wide, wide)]), n) for n in range(700)]
        frame = common.materialise(spark.createDataFrame(rows, "a int, b long, n int").coalesce(1), "rows")
        got = {r["n"]: r["rank"] for r in importance.radix_ranks(frame, [("a", False), ("b", True)]).collect()}
        want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))
        assert got == {r[2]: k + 1 for k, r in enumerate(want)}
        if wide > 20:
            break
