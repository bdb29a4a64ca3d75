"""Where models plug in: a callable that the caller supplies runs on batches of rows inside tasks. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    """generate(prompts, audio paths of each) -> one text each."""

    def generate(self, prompts: list[str], audios: list[list[str]]) -> list[str]: ...


def generate(requests: DataFrame, load: Callable[[], Generator], batch: int = 32) -> DataFrame:
    """requests (id, prompt, audios) with an answer and a status. The model is loaded once for a task; a batch that fails gives
    failure rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                model = model or load()
                try:
                    answers, status = model.generate(part["prompt"].tolist(), [list(a) for a in part["audios"]]), "success"
                except Exception as error:  # the model's own failure, whatever it is, becomes rows
                    answers, status = [str(error)] * len(part), "failure"
                yield pd.DataFrame({"id": part["id"], "answer": answers, "status": status})

    kind = dict(requests.dtypes)["id"]
    return requests.select("id", "prompt", "audios").mapInPandas(run, f"id {kind}, answer string, status string")


class Echo:
    """A deterministic stand-in: the prompt's last line, upper case."""

    def generate(self, prompts: list[str], audios: list[list[str]]) -> list[str]:
        return [p.rsplit("\n", 1)[-1].upper() for p in prompts]


def evaluate(items: DataFrame, done: DataFrame, load: Callable[[], Generator]) -> DataFrame:
    """Answers of items (id, prompt, audios, answer) without a result yet, with their correctness."""
    from ..functions.scalar import is_correct
    from .predictions import pending

    todo = pending(items, done)
    got = generate(todo, load).withColumnRenamed("answer", "prediction")
    return todo.select("id", "answer").join(got, "id").select("id", "answer", "prediction", "status", is_correct(F.col("answer"), F.col("prediction")).alias("correct"))
