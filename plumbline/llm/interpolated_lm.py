"""Language-model scoring by deleted interpolation.

The model is a bigram model over lower-cased words with one end token a text (which also is the context of a text's first
token): maximum-likelihood estimates of bigram and unigram and a uniform one are mixed, with weights that depend on how
often the context was seen. The weights are learned by expectation-maximisation on a held-out part of the training texts
(fold 1), with counts from the other training texts (folds 2 to 9); the counts that score are those of all training texts.

How it runs. Texts are dealt into groups of bounded size. A group's distinct words and bigrams are sent, as packed arrays of
hashes with the group's counts, to hash buckets; each bucket adds up its keys over all groups and answers every group with the
corpus counts, in the order in which the group sent its keys. A group then scores its texts by lookup. Nothing is broadcast
but the mixture weights; the driver gets totals and a histogram on a fixed grid.

Words and bigrams are told apart by 64-bit hashes. EM takes held-out tokens that lie in one cell of the grid together, with the
means of their estimates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, string_bytes, word_hashes

FOLDS, TEST_FOLD, HELD_OUT_FOLD = 10, 0, 1
GROUP_BYTES = 6 << 20
#: Text whose words and bigrams one bucket counts.
BUCKET_BYTES = 16 << 20
END = np.uint64(0x5D1F3C9A7E624B80)
ADD = 0.1
#: Context-frequency buckets: 0 for an unseen context, then one for each power of two.
CONTEXTS = 32
GRID = 0.1

UNIGRAM, BIGRAM = 1, 2
_SENT = "kind int, bucket int, grp long, keys binary, train binary, held binary"
_ANSWER = "grp long, kind int, bucket int, train binary, rest binary, tokens long, types long, rest_tokens long, rest_types long"


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then all second bytes, and so on: those of small values compress to almost nothing."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts.astype("<u4"))


def unpack_counts(raw: bytes) -> np.ndarray:
    return _of_planes(raw, "<u4")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, which have fewer bytes than the keys."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(raw, "<u8"), dtype=np.uint64)


class Tokens:
    """The tokens of a group of texts and its distinct words and bigrams, sorted by bucket."""

    def __init__(self, texts: pa.ChunkedArray, buckets: int):
        data, offsets = string_bytes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        words, at = word_hashes(data, offsets)
        n = np.diff(at)
        self.starts = np.concatenate([[0], np.cumsum(n + 1)])  # of the texts' tokens, ends included
        all_tokens = np.full(self.starts[-1], END, np.uint64)
        is_word = np.ones(len(all_tokens), bool)
        is_word[self.starts[1:] - 1] = False
        all_tokens[is_word] = words
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        before = np.empty_like(all_tokens)
        before[1:] = all_tokens[:-1]
        if len(before):
            before[self.starts[:-1]] = END
        self.words, self.word_at = np.unique(all_tokens, return_inverse=True)
        self.pairs, self.pair_at = np.unique(mix64(before * np.uint64(0x9E3779B97F4A7C15) + all_tokens), return_inverse=True)
        self.buckets = buckets

    @staticmethod
    def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
        return ((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)

    def sent(self, train: np.ndarray, held: np.ndarray):
        """(kind, bucket, keys, train counts, held-out counts); train, held: weights of the texts."""
        for kind, keys, at in ((UNIGRAM, self.words, self.word_at), (BIGRAM, self.pairs, self.pair_at)):
            in_train, in_held = (np.bincount(at, w[self.doc], len(keys)).astype(np.uint32) for w in (train, held))
            bucket = self.bucket_of(keys, self.buckets).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                i, j = cuts[b], cuts[b + 1]
                yield kind, int(b), pack_keys(keys[i:j]), pack_counts(in_train[i:j]), pack_counts(in_held[i:j])


def _send(key: tuple, table: pa.Table, buckets: int) -> pa.Table:
    tokens, fold = Tokens(table.column("__text"), buckets), table.column("__fold").to_numpy()
    rows = list(tokens.sent((fold != TEST_FOLD).astype(float), (fold == HELD_OUT_FOLD).astype(float)))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    kind, bucket, keys, train, held = (pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))
    return pa.table([kind, bucket, pa.array([key[0].as_py()] * len(rows), pa.int64()), keys, train, held], names=["kind", "bucket", "grp", "keys", "train", "held"])


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    kind, bucket = key[0].as_py(), key[1].as_py()
    keys = [unpack_keys(x.as_buffer()) for x in table.column("keys")]
    stops = np.cumsum([len(k) for k in keys])
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    train, held = (np.bincount(at, np.concatenate([unpack_counts(x.as_buffer()) for x in table.column(c)]), len(unique)).astype(np.int64) for c in ("train", "held"))
    rest = train - held
    cut = lambda x: pa.array([pack_counts(y) for y in np.split(np.minimum(x, 0xFFFFFFFF)[at], stops[:-1])], pa.binary())
    n = len(keys)
    first = [1] + [0] * (n - 1)  # a bucket's totals stand in one of its rows
    totals = [pa.array([f * int(x) for f in first], pa.int64()) for x in (train.sum(), (train > 0).sum(), rest.sum(), (rest > 0).sum())]
    return pa.table([table.column("grp"), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), cut(train), cut(rest), *totals], names=_ANSWER.replace(" long", "").replace(" int", "").replace(" binary", "").split(", "))


def _looked_up(texts: pa.Table, answers: pa.Table, buckets: int, column: str) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """The group's tokens, and for each token the corpus counts of it, of its bigram and of its context."""
    tokens = Tokens(texts.column("__text"), buckets)
    counts = {}
    order = pc.sort_indices(answers, sort_keys=[("kind", "ascending"), ("bucket", "ascending")])
    answers = answers.take(order)
    kinds = answers.column("kind").to_numpy()
    for kind, keys in ((UNIGRAM, tokens.words), (BIGRAM, tokens.pairs)):
        found = [unpack_counts(answers.column(column)[int(i)].as_buffer()) for i in np.flatnonzero(kinds == kind)]
        counts[kind] = np.concatenate(found).astype(np.float64)
        if len(counts[kind]) != len(keys):
            raise RuntimeError("a group's texts changed between two reads of the input")
    own = counts[UNIGRAM][tokens.word_at]
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[tokens.starts[:-1]] = own[tokens.starts[1:] - 1]  # of the end token
    return tokens, own, counts[BIGRAM][tokens.pair_at], context


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(CONTEXTS - 1, 1 + np.floor(np.log2(np.maximum(count, 1)))), 0).astype(np.int64)


def _histogram(texts: pa.Table, answers: pa.Table, buckets: int, tokens: int) -> pa.Table:
    """Held-out tokens by context bucket and by both estimates' logarithms on a grid (0: never seen), with the estimates' sums."""
    _, own, pair, context = _looked_up(texts, answers, buckets, "rest")
    with np.errstate(divide="ignore", invalid="ignore"):
        p2, p1 = np.where((pair > 0) & (context > 0), np.minimum(1, pair / context), 0), own / tokens
        q2, q1 = (np.where(p > 0, 1 + np.round(-np.log(p) / GRID), 0).astype(np.int64) for p in (p2, p1))
    cells, at, n = np.unique((context_bucket(context) << 40) | (q2 << 20) | q1, return_inverse=True, return_counts=True)
    sums = {name: np.bincount(at, p, len(cells)) for name, p in (("p2", p2), ("p1", p1))}
    return pa.table({"cell": cells, "context": cells >> 40, "n": n.astype(np.int64), **sums})


def learn_weights(histogram: pd.DataFrame, types: int, rounds: int = 60) -> np.ndarray:
    """(CONTEXTS, 3) weights of bigram, unigram and uniform estimates, by EM over cells (context, n tokens, sums p2 and p1 of
    their estimates); a bucket without held-out tokens takes those of the next lower one."""
    out, last = np.zeros((CONTEXTS, 3)), np.array([0.0, 0.9, 0.1])
    for b in range(CONTEXTS):
        rows = histogram[histogram["context"] == b]
        if len(rows):
            n, w = rows["n"].to_numpy(float), np.array([0.4 if b else 0.0, 0.5, 0.1])
            p = np.column_stack([rows[["p2", "p1"]].to_numpy() / n[:, None], np.full(len(n), 1 / (types + 1))])
            w = w / w.sum()
            for _ in range(rounds):
                post = p * w
                w = ((post / post.sum(1, keepdims=True)) * n[:, None]).sum(0) / n.sum()
            last = np.maximum(w, [0.0, 1e-9, 1e-6])
            last = last / last.sum()
        out[b] = last
    return out


def _score(texts: pa.Table, answers: pa.Table, buckets: int, n_tokens: int, n_types: int, weights: np.ndarray) -> pa.Table:
    tokens, own, pair, context = _looked_up(texts, answers, buckets, "train")
    w = weights[context_bucket(context)]
    mixed = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * own / max(1, n_tokens) + w[:, 2] / (n_types + 1)
    per_text = lambda x: np.add.reduceat(x, tokens.starts[:-1])
    base = np.log10((own + ADD) / (n_tokens + ADD * (n_types + 1)))
    n = len(texts)
    return pa.table([
        texts.column("__id"), pa.array(texts.column("__fold").to_numpy() == TEST_FOLD), pa.array(np.diff(tokens.starts), pa.int64()), pa.array(per_text((own > 0).astype(np.int64)), pa.int64()),
        pa.array([n_tokens] * n, pa.int64()), pa.array(per_text(base)), pa.array(per_text(np.log10(mixed))),
    ], names=["__id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty and has the end token alone; repeated rows are counted and scored each; texts of any length are whole;
    empty input, or input without training texts, gives rows scored by the uniform estimate. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__fold", fold_of(F.col("__id")))
    held = F.col("__fold") == HELD_OUT_FOLD
    size = F.octet_length("__text") + 64
    rest_bytes, held_bytes = base.agg(F.sum(F.when(~held, size)), F.sum(F.when(held, size))).first()
    n_rest, n_held = (1 + (x or 0) // group_bytes for x in (rest_bytes, held_bytes))
    deal = F.xxhash64("__id", "__text")
    # Held-out training texts have groups of their own, so that learning the weights reads no other texts.
    base = base.withColumn("grp", F.when(held, F.lit(n_rest) + F.pmod(deal, F.lit(n_held))).otherwise(F.pmod(deal, F.lit(n_rest))))
    buckets = int(1 + ((rest_bytes or 0) + (held_bytes or 0)) // BUCKET_BYTES)
    sent = base.groupBy("grp").applyInArrow(lambda key, table: _send(key, table, buckets), _SENT)
    answers = materialise(sent.groupBy("kind", "bucket").applyInArrow(_answer, _ANSWER), "corpus-counts")
    tokens, types, rest_tokens, rest_types = (int(x or 0) for x in answers.where(F.col("kind") == UNIGRAM).agg(*[F.sum(c) for c in ("tokens", "types", "rest_tokens", "rest_types")]).first())
    replies = answers.select("grp", "kind", "bucket", "train", "rest")

    def beside(which: DataFrame, groups: Column, column: str, run: Callable, schema: str) -> DataFrame:
        own = replies.select("grp", "kind", "bucket", column)
        return which.groupBy("grp").cogroup(own.where(groups).groupBy("grp")).applyInArrow(lambda key, texts, answers: run(texts, answers), schema)

    cells = beside(base.where(held), F.col("grp") >= n_rest, "rest", partial(_histogram, buckets=buckets, tokens=max(1, rest_tokens)), "cell long, context long, n long, p2 double, p1 double")
    histogram = cells.groupBy("cell", "context").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p1")]).toPandas()
    weights = learn_weights(histogram, rest_types)
    kind = dict(base.dtypes)["__id"]
    schema = f"__id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    run = partial(_score, buckets=buckets, n_tokens=tokens, n_types=types, weights=weights)
    return beside(base, F.lit(True), "train", run, schema).withColumnRenamed("__id", id_col)


def op9_interpolated_lm(spark, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
