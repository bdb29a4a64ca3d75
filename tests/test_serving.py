"""The cache, routing, and remote calls against a service that throttles, fails and counts."""

import os
import threading
import time
import uuid

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import serving as S


def test_cache():
    loaded = []
    cache = S.AudioCache(lambda p: loaded.append(p) or np.zeros(int(p), np.uint8), most=100)
    assert len(cache.get("40")) == 40 and cache.get("50") is cache.get("50") and loaded == ["40", "50"]
    cache.get("40")
    cache.get("30")  # 50 is the least recently used
    assert list(cache.kept) == ["40", "30"] and cache.bytes == 70
    assert len(cache.get("1000")) == 1000 and cache.bytes == 70 and "1000" not in cache.kept and cache.loads == 4


def test_routing_and_loads(spark):
    rows = [(i, f"p{i}", ["hot"] if i % 3 else [f"a{i % 30}"]) for i in range(900)] + [(1000, "q", [])]
    requests = spark.createDataFrame(rows, "id int, prompt string, audios array<string>").withColumn("path", F.get("audios", F.lit(0)))
    dealt = S.routed(requests, most=100)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, requests.collect())) and dealt.columns == requests.columns
    place = dealt.withColumn("task", F.spark_partition_id())
    tasks = {r["path"]: r["n"] for r in place.groupBy("path").agg(F.countDistinct("task").alias("n")).collect()}
    assert tasks["hot"] > 1 and all(n == 1 for p, n in tasks.items() if p and p != "hot")

    def load(path):
        return np.full(10, len(path), np.float32)

    def answer(prompts, heard):
        return [f"{p}:{sum(float(x.sum()) for x in xs)}" for p, xs in zip(prompts, heard)]

    got = S.with_audio(dealt, load, answer).collect()
    want = S.with_audio(requests, load, answer, most=0, batch=1).collect()  # nothing is kept
    assert sorted((r["id"], r["answer"]) for r in got) == sorted((r["id"], r["answer"]) for r in want)
    by_task = place.groupBy("task").agg(F.countDistinct("path").alias("n")).agg(F.sum("n")).first()[0]
    assert max(r["loads"] for r in want) > 100 and max(r["loads"] for r in got) <= by_task < 40


def service_in(folder):
    """connect() of a service whose log is files: a call's name is kind, key, start, end."""

    def connect():
        seen, lock = {}, threading.Lock()

        def service(key, prompt):
            begin = time.time()
            with lock:
                n = seen[key] = seen.get(key, 0) + 1
            time.sleep(0.02)
            kind = "no" if prompt == "never" else "wait" if prompt.endswith("7") and n == 1 else "bad" if prompt.endswith("3") and n < 3 or prompt == "dead" else "yes"
            with open(f"{folder}/{kind}_{key}_{begin}_{time.time()}_{uuid.uuid4().hex}", "w"):
                pass
            if kind == "no":
                raise S.Refused("never")
            if kind == "wait":
                raise S.Throttled(0.05)
            if kind == "bad":
                raise OSError("connection reset")
            return prompt.upper()

        return service

    return connect


def test_remote_calls(spark, tmp_path):
    log, kept = tmp_path / "log", f"{tmp_path}/kept"
    log.mkdir()
    rows = [(i, f"ask {i % 40}") for i in range(120)] + [(200, "never"), (201, "dead"), (202, None)]
    requests = spark.createDataFrame(rows, "id int, prompt string")
    limits = S.Limits(rate=60, tasks=3, at_once=4, attempts=4, first=0.02, longest=0.1)
    got = {r["id"]: r for r in S.remote(requests, service_in(str(log)), limits, kept).collect()}
    assert len(got) == 123 and all(got[i]["answer"] == f"ASK {i % 40}" for i in range(120))
    assert (got[200]["status"], got[200]["attempts"], got[201]["status"], got[201]["attempts"], got[201]["message"], got[202]["answer"]) == ("refused", 1, "failure", 4, "connection reset", "")
    assert (got[7]["attempts"], got[3]["attempts"], got[1]["attempts"]) == (2, 3, 1)
    calls = [n.split("_") for n in os.listdir(log)]
    assert sum(c[0] == "yes" for c in calls) == 41  # forty prompts and the empty one, once each
    starts = sorted(float(c[2]) for c in calls)
    busiest = max(sum(s <= t < s + 1 for t in starts) for s in starts)
    assert busiest <= 60 + 3 * 2  # in any second, but for what each task has under way
    spans = sorted((float(c[2]), float(c[3])) for c in calls)
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 3 * 4
    again = S.remote(requests.union(spark.createDataFrame([(300, "ask 1"), (301, "new")], requests.schema)), service_in(str(log)), limits, kept)
    assert {r["id"]: r["answer"] for r in again.collect()}[301] == "NEW" and again.count() == 125
    new = {n for n in os.listdir(log)} - {"_".join(c) for c in calls}
    assert sum(n.startswith("yes") for n in new) == 1 and sum(n.startswith("bad") for n in new) == 4 and not any(n.startswith("no") for n in new)
    other = S.remote(requests.where("id = 1"), service_in(str(log)), limits, kept, options="warmer").collect()
    assert other[0]["answer"] == "ASK 1" and len(os.listdir(log)) == len(calls) + len(new) + 1
