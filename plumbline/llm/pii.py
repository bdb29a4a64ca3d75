"""Personal data in texts: fixed patterns, and spans that a conditional random field adds.

The patterns find e-mail addresses, IPv4 addresses, payment cards and international telephone numbers in their usual forms. The field (crf),
trained from a small labelled table, reads word shapes and so also finds written-out or bracketed addresses, IPv6, cards with
other separators and national telephone numbers. What the patterns found stays; a span of the field's that meets one of theirs
is left out.

Arrow batches, no shuffle. The model, some megabytes, is trained on the driver and goes to the tasks with the function.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import string_bytes
from .crf import KINDS
from .labelled_spans import labelled

#: The most labelled rows that a model is trained from; of more, so many are drawn by seed.
LABELLED_ROWS = 20_000
#: Code points whose windows are decoded at a time.
BATCH_POINTS = 1 << 21

Span = tuple[str, int, int]
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# Possessive, so that no run is read again: a match begins where a run of digits does, and no shorter run can match instead.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
#: What any span has.
_NEEDED = np.isin(np.arange(256), [ord("@"), *range(48, 58)])


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards: a run of an address's characters can end nowhere else, so none is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and not _NOT_LOCAL.match(text, start - 1):
                start -= 1
        if start < at and domain:
            yield "email", start, domain.end()
            done = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind as listed, then by start."""
    out = list(emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _NO_DIGITS.sub("", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def merged(base: list[Span], added: list[Span]) -> list[Span]:
    """base and those of added that meet none of base, by kind as listed, then by start."""
    taken = sorted((start, end) for _, start, end in base)
    free, k, reach = [], 0, 0
    for kind, start, end in sorted(added, key=lambda s: s[1]):
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= start:
            free.append((kind, start, end))
    return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@lru_cache(maxsize=1)
def _default_model() -> crf.Model:
    return crf.train(labelled())


def model_of(table: DataFrame | None = None, limit: int = LABELLED_ROWS, seed: int = 0) -> crf.Model:
    """A model from a labelled table (text string, spans array<struct<kind string, start int, end int>>); without one, from this library's
    own labelled rows. Of a larger table, `limit` rows drawn by seed are used. Rows with a null text are left out."""
    if table is None:
        return _default_model()
    rows = table.where("text is not null").select("text", "spans")
    n = rows.count()
    if n > limit:
        rows = rows.sample(fraction=min(1.0, 1.2 * limit / n), seed=seed).limit(limit)
    got = [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or []]) for r in rows.collect()]
    return crf.train(random.Random(seed).sample(got, len(got)))


def find(texts: list[str | None], model: crf.Model) -> list[tuple[list[Span], list[Span]]]:
    """(the patterns' spans, all spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    at = 0
    while at < len(texts):
        until, points = at, 0
        while until < len(texts) and (until == at or points + len(texts[until] or "") <= BATCH_POINTS):
            points += len(texts[until] or "")
            until += 1
        for i, added in enumerate(crf.spans([t or "" for t in texts[at:until]], model), at):
            out[i] = (base[i], merged(base[i], added))
        at = until
    return out


def _scan(batches: Iterator[pa.RecordBatch], model: crf.Model) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        data, offsets = string_bytes(texts)
        worth = np.add.reduceat(np.append(_may_hold(data), False), offsets[:-1]) if len(texts) else np.zeros(0)
        some = np.flatnonzero((worth > 0) & (np.diff(offsets) > 0))
        base, every = [[]] * len(texts), [[]] * len(texts)
        for i, (own, both) in zip(some.tolist(), find(texts.take(pa.array(some)).to_pylist(), model)):
            base[i], every[i] = as_rows(own), as_rows(both)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, kind), pa.array(every, kind)], names=[*batch.schema.names[:-1], "base", "spans"])


def _may_hold(data: np.ndarray) -> np.ndarray:
    """Where bytes stand without which a text has neither spans nor windows: digits, @, "at" before a bracket, and "dot"."""
    out, low = _NEEDED[data], data | 32
    if len(data) > 2:
        third = data[2:]
        out[:-2] |= (low[:-2] == ord("a")) & (low[1:-1] == ord("t")) & np.isin(third, np.frombuffer(b"])}>", np.uint8))
        out[:-2] |= (low[:-2] == ord("d")) & (low[1:-1] == ord("o")) & (low[2:] == ord("t"))
    return out


def scan(docs: DataFrame, text_col: str = "text", model: crf.Model | None = None) -> DataFrame:
    """docs with text_col replaced by base and spans, arrays of (kind, start, end) in code points, end exclusive: what the patterns
    found, and that with what the model adds, by kind and start.

    A null or empty text has none; texts of any length are read whole; repeated rows stay. Columns named base or spans are replaced. Empty input gives no rows.
    """
    keep = [c for c in docs.columns if c not in (text_col, "base", "spans")]
    kinds = dict(docs.dtypes)
    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"base {span}", f"spans {span}"])
    return docs.select(*[f"`{c}`" for c in keep], f"`{text_col}`").mapInArrow(partial(_scan, model=model or model_of()), schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(k).to_pylist()] for k in (1, 2)]
        counts = [pa.array([sum(s[0] == kind for s in row) for row in spans[0]], pa.int64()) for kind in KINDS]
        digests = pa.array([hashlib.sha256(written(row).encode()).hexdigest() for row in spans[0]], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(list(map(written, spans[1])), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every document's spans: the patterns' counted and hashed, and all of them as text."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.mapInArrow(_digest, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
