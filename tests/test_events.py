"""Events by label against the plain rule, and metadata read once."""

import json
import os
import re
import time

import pytest

from plumbline.operators import events as E
from plumbline.plans import corpus_queries as Q

from .oracle import check

EVENTS = {1: ["Rain", "Dog bark"], 2: ["Train", "Light rain"], 3: ["Bark (dog)", "C++"], 4: ["x & y", "Übung"], 5: [], 6: ["dog-bark", "a.b", "a\\Eb"], 7: ["Dog bark"]}


def plain(label):
    exact = {k for k, ls in EVENTS.items() if any(x.lower() == label.lower() for x in ls)}
    return exact or {k for k, ls in EVENTS.items() if any(re.search(rf"\b{re.escape(label)}\b", x, re.I) for x in ls)}


def test_lookup(spark):
    asked = ["rain", "RAIN", "dog", "Dog Bark", "bark", "ark", "(dog", "dog)", "C++", "C", "+", "&", "x &", " & ", "übung", "bung", "a.b", "a\\Eb", "\\E", "a", "nothing", "k (d"]
    events = spark.createDataFrame(list(EVENTS.items()), "event int, label array<string>")
    got = {}
    for r in E.lookup(spark.createDataFrame([(a,) for a in asked], "label string"), events).collect():
        got.setdefault(r["asked"], []).append(r["event"])
    assert {a: set(es) for a, es in got.items()} == {a: plain(a) for a in asked if plain(a)} and all(len(set(es)) == len(es) for es in got.values())
    assert [r[0] for r in E.available_labels(events).collect()] == sorted({x for ls in EVENTS.values() for x in ls})
    assert E.lookup(spark.createDataFrame([("",), (" ",)], "label string"), events).count() == 0


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """A common label's pairs are dealt over as many tasks as they need, and events aren't sorted by label."""
    monkeypatch.setattr(E, "PAIRS", 100)
    events = spark.range(3000).selectExpr("id AS event", "array('rain', 'Rain', concat('dog ', id % 3)) AS label")
    found = E.lookup(spark.createDataFrame([("RAIN",), ("dog",)], "label string"), events)
    assert "SortMergeJoin [label" not in found._jdf.queryExecution().executedPlan().toString()
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 6000 and len(sizes) == 91 and max(sizes) < 150  # 9000 pairs, those of both rains among them


def test_metadata_is_read_once(spark, tmp_path):
    source, kept = str(tmp_path / "m.json"), str(tmp_path / "kept")
    write = lambda rows: (tmp_path / "m.json").write_text(json.dumps([{"file": f, "label": ls, "extra": 1} for f, ls in rows]))
    write([("a", ["Dog"]), ("b", [])])
    first = E.metadata(spark, source, kept)
    assert sorted((r["file"], r["label"]) for r in first.collect()) == [("a", ["Dog"]), ("b", [])] and first.select("event").distinct().count() == 2
    stamps = {p: os.stat(tmp_path / "kept" / p).st_mtime_ns for p in os.listdir(kept)}
    E.metadata(spark, source, kept).count()
    assert {p: os.stat(tmp_path / "kept" / p).st_mtime_ns for p in os.listdir(kept)} == stamps
    time.sleep(0.01)
    write([("c", ["Cat", "Dog"])])
    assert [r["file"] for r in E.metadata(spark, source, kept).collect()] == ["c"] and len(os.listdir(kept)) == 2


@pytest.mark.parametrize("name", ["event_lookup", "configured_tools", "tool_catalogue"])
def test_sql(spark, sf, name):
    check(spark, Q.QUERIES[name], Q.ORACLE[name], sf)
