"""Batch runs: attempts, manifests, failures at every point, files."""

import json
import os

import pytest

from plumbline.operators import batch_run as B
from plumbline.plans import corpus_queries as Q

from .oracle import check

STEPS = "id string, step int, tool string, parameters string, well_formed boolean"
ROWS = [("a", 1, "asr", "{}", True), ("a", 2, "cut", '{"n": 1}', True), ("b", 1, "cut", '{"n": 2}', True), ("b", 2, None, "{}", True), ("b", 3, "asr", None, False), ("c", 1, "boom", "{}", True), ("c", 2, "lie", "{}", True)]


def tools(calls):
    if calls[0]["tool"] == "boom":
        raise RuntimeError("boom")
    out = []
    for c in calls:
        path = c["output_path"].removeprefix("file:") + ".wav"
        if c["tool"] == "cut":
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(c["parameters"])
        out.append({"text": c["id"].upper() if c["tool"] == "asr" else None, "files": [path] if c["tool"] in ("cut", "lie") else []})
    return out


def rows(spark, folder):
    return {(r["id"], r["step"]): (r["status"], r["message"], r["attempt"]) for r in B.manifest(spark, folder).collect()}


def test_a_run_and_what_it_lacks(spark, tmp_path):
    folder, steps = str(tmp_path), spark.createDataFrame(ROWS, STEPS)
    assert B.run(steps, tools, folder, only_tool="asr") == 1
    first = rows(spark, folder)
    assert first[("a", 1)] == ("success", None, 1) and first[("a", 2)] == ("skipped", "another tool was asked for", 1) and first[("b", 2)] == ("error", "no tool", 1) and first[("b", 3)] == ("error", "malformed", 1)
    assert B.run(steps, tools, folder) == 2
    got = rows(spark, folder)
    assert got == {("a", 1): ("success", None, 1), ("a", 2): ("success", None, 2), ("b", 1): ("success", None, 2), ("b", 2): ("error", "no tool", 1), ("b", 3): ("error", "malformed", 1), ("c", 1): ("failure", "boom", 2), ("c", 2): ("failure", "a file is missing", 2)}
    assert B.run(steps, tools, folder) is None and B.run(steps, tools, folder, retry=True) == 3
    assert {k for k, v in rows(spark, folder).items() if v[2] == 3} == {("c", 1), ("c", 2)}
    found = {r["id"]: r for r in B.summary(spark.createDataFrame([*ROWS, ("d", 1, "asr", "{}", True)], STEPS), B.manifest(spark, folder)).collect()}
    assert found["b"]["tool_chain"] == ["cut", None, "asr"] and [s["status"] for s in found["b"]["results"]] == ["success", "error", "error"] and found["d"]["results"][0]["status"] == "pending"
    path = found["a"]["results"][1]["files"][0]
    assert "/attempts/2/" in path and json.loads(open(path).read()) == {"n": 1} and found["a"]["results"][0]["text"] == "A"


def test_a_failure_before_the_manifest_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    folder, steps = str(tmp_path), spark.createDataFrame(ROWS[:3], STEPS)
    whole = B.publish

    def fails(*args):
        raise RuntimeError("the driver went away")

    monkeypatch.setattr(B, "publish", fails)
    with pytest.raises(RuntimeError, match="went away"):
        B.run(steps, tools, folder)
    assert os.path.exists(f"{folder}/attempts/1/results/_SUCCESS") and rows(spark, folder) == {} and B.attempts(spark, folder) == [1]
    monkeypatch.setattr(B, "publish", whole)
    os.makedirs(f"{folder}/manifests/1")  # a manifest that was begun
    assert B.run(steps, tools, folder) == 2
    assert {v for v in rows(spark, folder).values()} == {("success", None, 2)}
    assert B.manifest(spark, f"{folder}/none").count() == 0 and B.run(steps.limit(0), tools, f"{folder}/none") is None


def test_sql(spark, sf):
    check(spark, Q.QUERIES["batch_transaction"], Q.ORACLE["batch_transaction"], sf)
