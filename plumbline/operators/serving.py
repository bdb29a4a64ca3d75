"""Around models that are far away or dear: audio loaded once for many requests, and calls to a remote service.

`routed` puts requests for one audio next to each other, in as many tasks as a much-asked audio needs, and `AudioCache` keeps what a worker
has loaded within a bound of bytes. `remote` calls a service at a rate that all tasks share, with a few calls at once, patience and
keys that make equal calls one.
"""

from __future__ import annotations

import random
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import folder_names, whole_folder


class AudioCache:
    """What load(path) gave, an array each, the least recently used given up first when there are more than `most` bytes. An array larger
    than that is loaded and not kept. One cache may serve several threads; two may then load one path."""

    def __init__(self, load: Callable[[str], np.ndarray], most: int = 256 << 20):
        self.load, self.most, self.bytes, self.loads = load, most, 0, 0
        self.kept: OrderedDict[str, np.ndarray] = OrderedDict()
        self.lock = threading.Lock()

    def get(self, path: str) -> np.ndarray:
        with self.lock:
            if path in self.kept:
                self.kept.move_to_end(path)
                return self.kept[path]
        found = self.load(path)
        with self.lock:
            self.loads += 1
            if found.nbytes <= self.most and path not in self.kept:
                self.kept[path] = found
                self.bytes += found.nbytes
                while self.bytes > self.most:
                    self.bytes -= self.kept.popitem(last=False)[1].nbytes
        return found


def routed(requests: DataFrame, path_col: str = "path", most: int = 1000) -> DataFrame:
    """The same rows, those of one path in one task and one after the other; a path with more than `most` rows in as many tasks as
    that takes, so that none is hot. Rows without a path are dealt out."""
    counts = requests.groupBy(F.col(path_col).alias("__path")).agg(F.ceil(F.count("*") / most).alias("__shares")).where("__shares > 1 and __path is not null")
    row = F.monotonically_increasing_id()
    rows = requests.withColumn("__row", row)
    both = rows.join(F.broadcast(counts), rows[path_col] == counts["__path"], "left")  # paths with over `most` rows: at most rows / most
    share = F.when(F.col(path_col).isNull(), F.col("__row")).otherwise(F.pmod(F.xxhash64("__row"), F.coalesce("__shares", F.lit(1))))
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of one's own isn't made less for small rows
    dealt = both.withColumn("__share", share).repartition(tasks, F.xxhash64(F.col(path_col), "__share"))
    return dealt.sortWithinPartitions(path_col).select(*[F.col(f"`{c}`") for c in requests.columns])


def with_audio(requests: DataFrame, load: Callable[[str], np.ndarray], answer: Callable[[list[str], list[list[np.ndarray]]], list[str]], most: int = 256 << 20, batch: int = 32) -> DataFrame:
    """(id, answer, loads) of requests (id, prompt, audios): the model gets the audios themselves. loads: how many files the task
    had loaded by then. Requests are best routed by their first audio."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = AudioCache(load, most)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                heard = [[cache.get(p) for p in paths] for paths in part["audios"]]
                yield pd.DataFrame({"id": part["id"], "answer": answer(part["prompt"].tolist(), heard), "loads": cache.loads})

    return requests.select("id", "prompt", "audios").mapInPandas(run, f"id {dict(requests.dtypes)['id']}, answer string, loads int")


class Throttled(Exception):
    """The service asks for patience, for `after` seconds if it says so."""

    def __init__(self, after: float | None = None):
        super().__init__("throttled")
        self.after = after


class Refused(Exception):
    """The service won't answer this call, now or later."""


@dataclass(frozen=True)
class Limits:
    """rate: calls a second of all tasks together. tasks: how many share it. at_once: calls under way in a task. attempts: of one
    call. first and longest: the wait after a failure, doubled each time, and its bound, in seconds."""

    rate: float
    tasks: int = 8
    at_once: int = 4
    attempts: int = 6
    first: float = 0.5
    longest: float = 60.0


class Pace:
    """Lets calls go at a rate: each takes the next free moment, whichever thread it is of."""

    def __init__(self, rate: float):
        self.gap, self.next, self.lock = 1 / rate, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            self.next = max(now, self.next)
            at, self.next = self.next, self.next + self.gap
        time.sleep(max(0.0, at - now))


def call(service: Callable[[str, str], str], key: str, prompt: str, pace: Pace, limits: Limits) -> tuple[str | None, str, str | None, int]:
    """(answer, status, message, attempts) of one call. The key goes along, so a service can tell a repeated call."""
    wait = limits.first
    for attempt in range(1, limits.attempts + 1):
        pace.wait()
        try:
            return service(key, prompt), "success", None, attempt
        except Refused as error:
            return None, "refused", str(error), attempt
        except Throttled as error:
            message, rest = str(error), error.after
        except Exception as error:  # whatever the service or the way to it may raise
            message, rest = str(error), None
        if attempt < limits.attempts:
            time.sleep(min(limits.longest, rest if rest is not None else wait * random.uniform(0.5, 1.5)))
            wait = min(limits.longest, 2 * wait)
    return None, "failure", message, limits.attempts


CALLS = "key string, answer string, status string, message string, attempts int"


def answered(spark, folder: str) -> DataFrame:
    """CALLS that earlier runs have finished: answered or refused."""
    paths = [f"{folder}/{n}" for n in folder_names(spark, folder) if whole_folder(spark, f"{folder}/{n}")]
    rows = spark.read.schema(CALLS).parquet(*paths) if paths else spark.createDataFrame([], CALLS)
    return rows.where("status in ('success', 'refused')").dropDuplicates(["key"])


def remote(requests: DataFrame, connect: Callable[[], Callable[[str, str], str]], limits: Limits, folder: str, options: str = "") -> DataFrame:
    """requests (id, prompt) with answer, status (success, refused or failure), message and attempts.

    Equal prompts under equal options are one call, and one that an earlier run with this folder has finished isn't made again. connect is
    called once a task and gives service(key, prompt) -> answer, which may raise Throttled or Refused. A task that is lost is run again, and its
    calls with it: a service that knows the keys answers them as before. Answers are written when their tasks end.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", F.sha2(F.concat_ws("\x00", F.lit(options), F.coalesce("prompt", F.lit(""))), 256))
    todo = keyed.groupBy("key").agg(F.first("prompt").alias("prompt")).join(answered(spark, folder).select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, pace = None, Pace(limits.rate / limits.tasks)
        with ThreadPoolExecutor(limits.at_once) as pool:
            for frame in frames:
                service = service or connect()
                got = list(pool.map(lambda r: (r.key, *call(service, r.key, r.prompt or "", pace, limits)), frame.itertuples(index=False)))
                yield pd.DataFrame(got, columns=["key", "answer", "status", "message", "attempts"])

    made = todo.select("key", "prompt").repartition(limits.tasks, "key").mapInPandas(run, CALLS)
    number = max((int(n) for n in folder_names(spark, folder) if n.isdigit()), default=0) + 1
    made.write.parquet(f"{folder}/{number}")
    new = spark.read.schema(CALLS).parquet(f"{folder}/{number}")
    every = answered(spark, folder).unionByName(new.where("status = 'failure'"))
    return keyed.join(every, "key").drop("key")
