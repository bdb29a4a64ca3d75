"""The corpus operators against brute force, round trips, and their edge cases."""

import base64
import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, common, exact_dedup, html_extract, interpolated_lm, jaccard_join, line_dedup, links, packing, quality, queries, shards
from plumbline.llm.labelled_pages import LABELLED_PAGES

from ..oracle import check

MULTI, GPT = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, text_sha256 string, kept string"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, ties, repeated rows, clashing column names."""
    rows = [(1, None, None, "x", "y"), (None, "a b c d e f", "s", None, None), (2, "", "s", "x", "y"), (3, " \n\t", "s", "x", "y"), (3, " \n\t", "s", "x", "y"), (4, "A b C d e f", "s", "x", "y"), (5, "a b c d e f", None, "x", "y"), (5, "a b c d e f", None, "x", "y"), (6, "w " * 30_000, "s", "x", "y"), (7, "x" * 70_000, "t", "x", "y"), (8, "one two", "t", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], sf)


# Hashing ---------------------------------------------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="aB \n\té\x0b.", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes(texts):
    import pyarrow as pa

    hashes, at = common.word_hashes(*common.string_bytes(pa.array(texts, pa.string())))
    seen: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        assert at[i + 1] - at[i] == len(words)
        for w, h in zip(words, hashes[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# 1 -----------------------------------------------------------------------------------------------------------------------


def test_html_learns_its_labels():
    weights = html_extract.learn(LABELLED_PAGES)
    for page in LABELLED_PAGES:
        inside = "".join(re.sub("<[^>]*>", "", x.split("]]")[0]) + " " for x in page.split("[[")[1:])
        assert html_extract.main_text(page.replace("[[", "").replace("]]", ""), weights) == " ".join(inside.split())
    assert all(s < 0 for s in weights.tags.values())


TALK = "The committee met on Tuesday to review the plan, and after two hours of talk it agreed to fund the work for another year."
ITEMS = "".join(f"<li><a href='/{i}'>Go on to item {i}</a></li>" for i in range(12))


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just words", "just words"), ("<article><p>a&amp;&lt;b&nbsp;c</p><p>d<b>e</b>\n f", "a&<b c de f"),
    ("<body><nav><a>x</a></nav><article><p>one two three four<script>var a='</p>'</script></p><div class='ad'>buy this now</div><p>five six</p></article><footer>z z z</footer>", "one two three four five six"),
    ("<article><p>one two three</p><!-- <p>no</p> --><form><label>l</label></form></article><section class='comments'><p>bad</p></section>", "one two three"),
    (f"<article class='post meta'><p>{TALK}</p></article>", TALK),
    (f"<body class='search-page header-fixed'><article><p>{TALK}</p></article></body>", TALK),
    ("<ul><li>" + " " * 200 + "Home</li><li>" + " " * 200 + f"News</li></ul><article><h1>Plan</h1><p>{TALK}</p></article>", f"Plan {TALK}"),
    ("<div><p>" + "\n".join(TALK.split() * 9) + "</p></div>", " ".join([TALK] * 9)),
    (f"<div class='top-links'><a href=a>Jobs</a> <a href=b>Press</a></div><div><h1>Plan</h1><p>{TALK}</p></div><div class='bottom-strip'>Terms of use and privacy policy</div>", f"Plan {TALK}"),
    (f"<article><p>{TALK}</p><form><textarea>Your words here</textarea><button>Send</button></form></article>", TALK),
    (f"<form action='x'><div id='main'><h1>Plan</h1><p>{TALK}</p><p>{TALK}</p></div></form>", f"Plan {TALK} {TALK}"),
    (f"<main><h1>Plan</h1><p>{TALK}</p></main><div><h3>Comments</h3><div><p>I think this is a very good idea and I hope that they do it soon.</p></div><div><p>{TALK}</p></div></div>", f"Plan {TALK}"),
])
def test_html_cases(page, want):
    assert html_extract.main_text(page, html_extract.learn(LABELLED_PAGES)) == want


@pytest.mark.parametrize("page,want", [
    (f"<div><p>{TALK}</p></div><ul>{ITEMS}</ul><div><h1>Plan</h1><p>{TALK}</p><p>{TALK}</p></div>", f"Plan {TALK} {TALK}"),
    (f"<div><h1>Plan</h1><p>{TALK}</p><p>{TALK}</p></div><ul>{ITEMS}</ul><div><p>{TALK[:40]} read on.</p></div>", f"Plan {TALK} {TALK}"),
    (f"<div><p>We may be late today.</p></div><ul>{ITEMS}</ul><h1>Plan</h1><div>{TALK} {TALK}</div><ul>{ITEMS}</ul><p>{TALK}</p>", f"Plan {TALK} {TALK}"),
])
def test_html_scan_decides(page, want):
    """Blocks that look like text, beyond what lies between: only the best contiguous region tells them from the article."""
    weights = html_extract.learn(LABELLED_PAGES)
    assert html_extract.main_text(page, weights) == want
    likely = [x for kind, x, features in html_extract.items(page, weights.features, weights.boilerplate) if kind == "block" and html_extract.log_odds(features, weights) > -html_extract.INSIDE]
    assert len(" ".join(likely)) > len(want)


NOTICE = "Copyright 2024 Example Ltd. All rights reserved. No part of this site may be used without permission."
COOKIES = "We use cookies to make this site work. Read our cookie policy or accept."


@pytest.mark.parametrize("page,want", [
    ("<main><ul><li>Eggs</li><li>Milk</li><li>Flour</li></ul></main>", "Eggs Milk Flour"),
    ("<p>Buy these:</p><ul><li>Eggs</li><li>Milk</li></ul>", "Buy these: Eggs Milk"),
    (f"<p>{TALK}</p><p>{TALK}</p><div>{NOTICE}</div>", f"{TALK} {TALK}"),
    (f"<div>{COOKIES}</div><article><h1>Plan</h1><p>{TALK}</p></article>", f"Plan {TALK}"),
    (f"<article><p>{TALK}</p><p>All rights reserved.</p><p>{TALK}</p></article><div>{NOTICE}</div>", f"{TALK} All rights reserved. {TALK}"),
    (f"<p>{TALK} 3 < 4 and a<b but c > d.</p>", f"{TALK} 3 < 4 and a d."),
    (f"<p title=it's>{TALK}</p><p don't>{TALK}</p><p title='x > y'>{TALK}</p><p title=\"open>{TALK}</p>", " ".join([TALK] * 4)),
    (f"<p>{TALK}</p><script>if (a<b) '</p>'</SCRIPT ><!-- <p>x --><p>{TALK}</p><style>p", f"{TALK} {TALK}"),
])
def test_html_lists_notices_and_odd_markup(page, want):
    assert html_extract.main_text(page, html_extract.learn(LABELLED_PAGES)) == want


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a b="', "<!", "<!--", "<script>", '<a href=">" ', "<a x='\" ", "</", "<", "<div class=", "<title>", "</script    "])
def test_html_hostile_pages_take_linear_time(piece):
    weights, took = html_extract.learn(LABELLED_PAGES), []
    for size in (200_000, 800_000):
        begin = time.process_time()
        html_extract.main_text(piece * (size // len(piece)), weights)
        took.append(time.process_time() - begin)
    assert took[1] < 8 * max(took[0], 0.1) and took[1] < 8


def test_html_held_out_pages():
    """Words of pages that the weights were not learned from, in turn by thirds."""
    hits = wrong = missed = 0
    for part in range(3):
        weights = html_extract.learn([p for i, p in enumerate(LABELLED_PAGES) if i % 3 != part])
        for page in LABELLED_PAGES[part::3]:
            want = Counter("".join(re.sub("<[^>]*>", "", x.split("]]")[0]) + " " for x in page.split("[[")[1:]).split())
            got = Counter(html_extract.main_text(page.replace("[[", "").replace("]]", ""), weights).split())
            hits, wrong, missed = hits + (got & want).total(), wrong + (got - want).total(), missed + (want - got).total()
    print("held-out precision", hits / (hits + wrong), "recall", hits / (hits + missed))
    assert hits / (hits + wrong) > 0.9 and hits / (hits + missed) > 0.9


def slow_runs(scored, at=0):
    spans = [(sum(scored[i:j]), i, j) for i in range(len(scored)) for j in range(i + 1, len(scored) + 1)]
    best = max(spans, default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return slow_runs(scored[:i], at) + [(at + i, at + j)] + slow_runs(scored[j:], at + j)


@given(st.lists(st.floats(-5, 5, allow_subnormal=False).map(lambda x: round(x, 3) + 0.0001 * hash(str(x)) % 0.00007), max_size=14))
@settings(deadline=None)
def test_html_runs_are_all_maximal(scored):
    assert html_extract.runs(scored) == slow_runs(scored) or len({round(sum(scored[i:j]), 6) for i in range(len(scored)) for j in range(i + 1, len(scored) + 1)}) < len(scored) * (len(scored) + 1) // 2


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_html_region_is_the_best(scored):
    begin, end = html_extract.region(scored)
    assert sum(scored[begin:end]) == max([0] + [sum(scored[i:j]) for i in range(len(scored)) for j in range(i, len(scored) + 1)])


def test_html_frame(spark, sf):
    pages = spark.createDataFrame([(1, None, "t"), (None, f"<p>{TALK}</p>", None), (None, f"<p>{TALK}</p>", None), (2, "<p>" + TALK * 20_000, "t")], "page_id long, html string, n_chars string")
    got = sorted((r["n_chars"], r["text"]) for r in html_extract.extract(pages).collect())
    assert got[:3] == [(0, ""), (len(TALK), TALK), (len(TALK), TALK)] and got[3][0] == len(TALK) * 20_000 and html_extract.extract(pages).columns == ["page_id", "text", "n_chars"]
    assert html_extract.extract(pages.limit(0)).count() == 0
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.queries()["op1_html_extraction"](spark, sf).collect()
    assert len(rows) == len(given)
    for r in rows:  # these pages' main text is their article: its blocks by a plain cut at block tags
        inner = re.sub("<!--.*?-->", "", given[r["page_id"]].split("<article>")[1].split("</article>")[0], flags=re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|br|div|ul|ol|li)\b[^>]*>", inner)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# 2 -----------------------------------------------------------------------------------------------------------------------


def brute_lines(docs):
    """{doc: text} by exact Jaccard over all pairs of lines that share a prefix shingle."""
    occurrences = [(i, n, x) for i, t in sorted(docs.items()) for n, x in line_dedup.split_lines(t)]
    lines = list(dict.fromkeys(x for _, _, x in occurrences))
    sets = [frozenset(x[k : k + 8] for k in range(max(1, len(x) - 7))) for x in lines]
    up = brute_links(sets)
    at, kept, gone = {x: i for i, x in enumerate(lines)}, set(), defaultdict(set)
    for i, n, x in occurrences:
        (gone[i].add(n) if up[at[x]] in kept else kept.add(up[at[x]]))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in docs.items()}


def brute_links(sets):
    up, by = list(range(len(sets))), defaultdict(list)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for g in sorted(s, key=hash)[: len(s) - -(-80 * len(s) // 100) + 1]:
            by[g].append(i)
    for x, y in {(a, b) for m in by.values() for k, a in enumerate(m) for b in m[:k]}:
        both = len(sets[x] & sets[y])
        if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((root(x), root(y)))
            up[b] = a
    return [root(i) for i in range(len(sets))]


def test_lines_brute_force(spark, sf, documents):
    got = {r["doc_id"]: r["text"] for r in queries.queries()["op2_line_dedup"](spark, sf).collect()}
    assert got == brute_lines(documents)


def test_lines_cases(spark, odd, empty):
    long = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(2, f"{long}!\nother", "s"), (1, f"  {long}\n\nkeep", "s"), (3, None, "s"), (4, "other\nother", "s"), (4, "other\nother", "s")]
    got = sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=str)
    assert got == [(1, f"  {long}\n\nkeep", 0), (2, "other", 1), (3, None, 0), (4, "", 2), (4, "", 2)]
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0


def test_linkers_prune_but_connect():
    rng = random.Random(1)
    base = [rng.randrange(1 << 60) for _ in range(200)]
    sets = [np.unique(np.array(base[: 200 - rng.randrange(20)] + [rng.randrange(1 << 60) for _ in range(5)], np.uint64)) for _ in range(60)]
    sets += [np.array(sorted(rng.randrange(1 << 60) for _ in range(50)), np.uint64) for _ in range(5)]
    for linker in (line_dedup.prefix_links, jaccard_join.rtree_links):
        found = linker(sets, np.arange(len(sets)))
        forest = links.Forest(np.arange(len(sets)))
        for p, q in found:
            assert jaccard_join.similar(sets[p], sets[q])
            forest.join(p, q)
        want = brute_links([frozenset(s.tolist()) for s in sets])
        assert [len({forest.root(j) for j in range(len(sets)) if want[j] == w}) for w in set(want)] == [1] * len(set(want))
        assert len(found) == len(sets) - len(set(want))


def test_lines_of_a_family_that_are_not_linked_are_hardly_compared(monkeypatch):
    """Drawn from the same shingles, so that all have rare ones in common: pairs that are not similar must not each cost a comparison."""
    rng, calls = np.random.default_rng(5), []
    pool = np.unique(rng.integers(0, 1 << 62, 600, dtype=np.uint64))
    sets = [pool[np.sort(rng.choice(len(pool), 60 + 2 * i, replace=False))] for i in range(200)]
    sets += [np.delete(x, [3, 4]) for x in sets[::10]] + [np.unique(np.append(x[5:], np.uint64(9))) for x in sets[::20]]
    monkeypatch.setattr(line_dedup, "similar", lambda a, b: calls.append(1) or jaccard_join.similar(a, b))
    seeds = np.array([b"seed" if i in (0, 1, 2) else b"%d" % i for i in range(len(sets))], object)
    found, forest = line_dedup.prefix_links(sets, seeds), links.Forest(seeds)
    assert all(jaccard_join.similar(sets[p], sets[q]) for p, q in found)
    assert len(calls) < 2 * len(sets)
    for p, q in found:
        assert forest.root(p) != forest.root(q)
        forest.join(p, q)
    assert all(forest.root(p) == forest.root(q) for q in range(len(sets)) for p in range(q) if jaccard_join.similar(sets[p], sets[q]))


def test_clusters_of_a_task_are_linked_each_by_itself():
    long = "the quick brown fox jumps over the lazy dog and runs far away from here"
    clusters = [[f"{long}{i}a", f"{long}{i}b", *(["x", "", "short"][1:] if i % 3 == 0 else [])] for i in range(40)] + [["alone"]]
    lines = [x or "y" for c in clusters for x in c]
    starts = np.cumsum([0, *map(len, clusters[:-1])])
    texts = [np.frombuffer(x.encode(), np.uint8) for x in lines]
    found = {tuple(sorted(map(int, p))) for p in line_dedup.text_links(texts, np.arange(len(lines)), starts)}
    assert found == {(int(s), int(s) + 1) for s in starts[:-1]}


def test_shingles_are_those_of_each_line():
    lines = ["abcdefghij", "abcdefgh", "short", "zabcdefghi", "x", "abcdefg"]
    hashes, at = line_dedup.shingles(lines)
    text = [line[i : i + 8] for line in lines for i in range(max(1, len(line) - 7))]
    assert at.tolist() == [0, 3, 4, 5, 8, 9, 10] and len(hashes) == len(text)
    assert {(a, b) for a, b in zip(text, hashes.tolist())} == {(a, dict(zip(text, hashes.tolist()))[a]) for a in text} and len(set(hashes.tolist())) == len(set(text))


# 3 -----------------------------------------------------------------------------------------------------------------------


def test_quality_cases(spark, odd, empty):
    text = "a b c a b c x " + " ".join(f"w{i}" for i in range(60)) + "\nsame line\n\nsame line\n#$"
    rows = spark.createDataFrame([(1, text, "good")], "doc_id long, text string, source string")
    r = quality.judge(rows).first()
    words = text.split()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) == (len(words), sum(map(len, words)), 2, 1, 6, True)
    assert quality.judge(odd).count() == odd.count() and quality.judge(empty).count() == 0
    assert quality.accepted(odd).columns == odd.columns


def test_hosts_decide_on_the_tables(spark, sf):
    """The tables' sources fail alike, so none goes; where failing documents come from few hosts, their other documents go too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r["doc_id"]: r["base_failed"] for r in quality.judge(docs).collect()}
    host = lambda i: "bad" if judged[i] or i % 29 == 0 else f"h{i % 7}"
    moved = spark.createDataFrame([(r["doc_id"], r["text"], host(r["doc_id"])) for r in docs.collect()], "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(moved).collect()}
    dropped = {i for i in judged if not judged[i] and not kept[i]}
    assert dropped == {i for i in judged if not judged[i] and host(i) == "bad"} and dropped
    assert {r["doc_id"] for r in quality.accepted(moved).collect()} == {i for i in judged if kept[i]}
    check(spark, lambda spark, _: quality.judge(moved).drop("host_rate"), quality.ORACLE, sf, documents=moved)


def test_rejected_hosts_of_many_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOSTS", 2)
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "short" if i % 2 else good, f"bad{i % 7}") for i in range(140)] + [(1000 + i, good, f"h{i % 50}") for i in range(1000)]
    kept = {r["doc_id"] for r in quality.accepted(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {1000 + i for i in range(1000)}


def test_small_hosts_that_differ_by_chance_stay(spark):
    """20,000 hosts of 1 to 8 documents that all fail at a tenth: the prior leaves out what chance does to small hosts."""
    rng = np.random.default_rng(5)
    judged = spark.createDataFrame([(f"h{h}", bool(x)) for h in range(20_000) for x in rng.random(1 + h % 8) < 0.1], "source string, base_failed boolean")
    assert quality.host_verdicts(judged, "source").where("not host_ok").count() <= 20
    worse = judged.withColumn("base_failed", F.col("base_failed") | F.col("source").isin([f"h{8 * i + 7}" for i in range(40)]))
    bad = {r["host"] for r in quality.host_verdicts(worse, "source").where("not host_ok").collect()}
    assert len(bad & {f"h{8 * i + 7}" for i in range(40)}) == 40 and len(bad) < 400
    alike = spark.createDataFrame([(f"h{h}", h % 10 == 0) for h in range(100)], "source string, base_failed boolean")
    assert quality.host_verdicts(alike, "source").where("not host_ok").count() == 0


def test_bad_hosts_go(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(100)] + [(1000 + i, good, f"h{i % 5}") for i in range(100)] + [(5000, good, None)]
    kept = {r["doc_id"] for r in quality.accepted(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {1000 + i for i in range(100)} | {5000}


# 4 -----------------------------------------------------------------------------------------------------------------------


def check_pieces(rows, ids, sequence=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for group, key in ((by_doc, "start"), (by_sequence, "offset")):
        for pieces in group.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r[key]):
                assert r[key] == at
                at += r["length"]
    assert all(sum(r["length"] for r in p) == len(ids[d]) for d, p in by_doc.items()) and len(by_doc) == len(ids)
    sizes = sorted((sum(r["length"] for r in p) for p in by_sequence.values()), reverse=True)
    assert all(s == sequence for s in sizes[:-1])


def token_ids(documents):
    tok = Tokenizer.from_file(GPT)
    return {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t in documents.items()}


def test_packing(spark, sf, documents):
    check_pieces(queries.queries()["op4_mixture_packing"](spark, sf).collect(), token_ids(documents))


def test_packed_sequences_hold_the_tokens(spark, sf, documents, monkeypatch):
    """Pieces carry their ids, sequences are filled with them, and the query and the pipeline's last stage read them from there."""
    import corpus_pipeline

    monkeypatch.setattr(packing, "BATCH_BYTES", 5000)
    ids, docs = token_ids(documents), spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, GPT, public_tokenizers.PATTERN)
    want, kind = defaultdict(dict), packing.id_kind(GPT)
    for r in pieces.collect():
        assert bytes(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].astype(kind).tobytes()
        want[r["sequence_id"]][r["offset"]] = r
    filled = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert sorted(filled) == list(range(len(want))) and [filled[s]["n_tokens"] for s in range(len(filled) - 1)] == [1024] * (len(filled) - 1)
    for s, r in filled.items():
        assert bytes(r["ids"]) == b"".join(bytes(want[s][o]["ids"]) for o in sorted(want[s])) and len(r["ids"]) == 2 * r["n_tokens"]
    assert sum(r["n_tokens"] for r in filled.values()) == sum(map(len, ids.values()))
    last = corpus_pipeline.pack(spark, docs, sf)
    assert [c for c in last.columns if c != "ids_crc32"] == pieces.columns
    for r in last.collect():
        given = want[r["sequence_id"]].pop(r["offset"])
        assert [r[c] for c in pieces.columns if c != "ids"] == [given[c] for c in pieces.columns if c != "ids"]
        assert bytes(r["ids"]) == np.frombuffer(given["ids"], kind).astype("<u4").tobytes() and r["ids_crc32"] == zlib.crc32(r["ids"])
    assert not any(want.values())
    assert packing.sequences(packing.pack(docs.limit(0), GPT, public_tokenizers.PATTERN)).count() == 0


def packed_rows(docs, **how):
    return packing.pieces_of(packing.sequences(packing.pack(docs, GPT, public_tokenizers.PATTERN, **how))).collect()


def round_robin(shares):
    """Deficit round-robin word by word: each turn every live source earns its share, and whoever is owed most is served."""
    total, served, order = sum(shares), [0] * len(shares), []
    while len(order) < total:
        # the source whose next token is due first: its token s is due when (2 s + 1) / (2 m) of the phase is out
        k = min((k for k in range(len(shares)) if served[k] < shares[k]), key=lambda k: ((2 * served[k] + 1) / (2 * shares[k]), k))
        served[k] += 1
        order.append(k)
    return order


@given(st.lists(st.integers(1, 60), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_served_is_a_round_robin(shares):
    """The closed form serves as a literal round-robin does that carries each source's deficit from token to token."""
    order = round_robin(shares)
    for x in range(len(order) + 1):
        assert packing.served(shares, x) == [order[:x].count(k) for k in range(len(shares))]


def test_query_windows_hold_the_mixture(spark, sf, documents):
    """On the query's own output: every whole window has the corpus's proportions to within a token or two."""
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids, share = token_ids(documents), defaultdict(Counter)
    total = Counter()
    for i, x in ids.items():
        total[sources[i]] += len(x)
    for r in queries.queries()["op4_mixture_packing"](spark, sf).collect():
        share[r["sequence_id"] // packing.WINDOW_SEQUENCES][sources[r["doc_id"]]] += r["length"]
    size, whole = packing.SEQUENCE * packing.WINDOW_SEQUENCES, sum(total.values())
    full = [w for w in share.values() if sum(w.values()) == size]
    assert len(full) == whole // size and full
    assert all(abs(w[s] - size * n / whole) <= 2 for w in full for s, n in total.items())


def test_packing_mixture(spark, documents):
    docs = spark.createDataFrame([(i, t, "a" if i % 3 else "b") for i, t in documents.items()], "doc_id long, text string, source string").repartition(5)
    rows = packed_rows(docs, weights={"a": 1, "b": 1}, window_sequences=2)
    check_pieces(rows, token_ids(documents))
    total = {s: sum(r["length"] for r in rows if (r["doc_id"] % 3 > 0) == (s == "a")) for s in "ab"}
    share = defaultdict(Counter)
    for r in rows:
        share[r["sequence_id"] // 2]["a" if r["doc_id"] % 3 else "b"] += r["length"]
    whole = min(total.values()) // 1024 - 1  # windows before the smaller source runs dry
    assert whole > 5 and all(abs(share[w]["a"] - share[w]["b"]) <= 2 for w in range(whole))


def test_packing_cases(spark, odd, empty):
    rows = packed_rows(odd)
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(r["length"] for r in rows) == sum(tokens[r["doc_id"]] for r in odd.select("doc_id").collect())
    assert packing.pack(empty, GPT, public_tokenizers.PATTERN).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b", "s")], DOCS.split(", text_sha")[0])
    ids = token_ids({1: "a <|endoftext|> b"})
    check_pieces(packed_rows(special), ids)


@given(st.lists(st.integers(1, 400), min_size=1, max_size=5), st.integers(1, 50), st.integers(0, 70))
@settings(max_examples=80, deadline=None)
def test_places_tile_the_corpus(shares, window, begin):
    phase, seen = packing.Phase(shares, begin, window), []
    for k, n in enumerate(shares):
        for start, length, at in phase.place(k, 0, n):
            seen += range(at, at + length)
    assert sorted(seen) == list(range(begin, begin + sum(shares)))
    steps = [packing.served(shares, x) for x in range(sum(shares) + 1)]
    assert all(sum(b) - sum(a) == 1 and all(y >= x for x, y in zip(a, b)) for a, b in zip(steps, steps[1:])) and steps[-1] == shares


# 5 -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.PerfectHash(bpe.load_ranks(MULTI)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def engine():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(codec):
    ranks = bpe.load_ranks(MULTI)
    assert codec.whole.n == len(ranks) and all(codec.whole.get(k) == v for k, v in ranks.items())
    assert all(codec.whole.get(b"\xff\xfe" + bytes([i, i])) is None for i in range(256))


@given(st.text(max_size=80) | st.text(alphabet="  \n\t 　ab'sé1.", max_size=60))
@settings(max_examples=300, deadline=None)
def test_codec_equals_library(codec, engine, text):
    ids = codec.encode(text)
    assert ids == np.array(engine.encode_ordinary(text), np.uint32).tobytes() and codec.decode(ids) == text.encode()


@given(st.text(max_size=60) | st.text(alphabet="  \n\t ab'sé1.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_packing_encoder_equals_library(text):
    own = packing.encoder(GPT, public_tokenizers.PATTERN)
    own.learn([text])
    assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def test_bpe_frames(spark, sf, documents, engine, odd, empty):
    for r in queries.queries()["op5_byte_bpe"](spark, sf).collect():
        text = documents[r["doc_id"]]
        ids = np.array(engine.encode_ordinary(text), np.uint32)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = bpe.encode(odd, MULTI, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, MULTI, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]).decode() for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert bpe.round_trip_digests(empty, MULTI, public_tokenizers.PATTERN).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd, empty):
    rows = shards.shuffle_rows(spark.range(1003).repartition(7), 40, seed=3, block_rows=10).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [25] * 37 + [26] * 3 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r["id"] for r in rows) == list(range(1003))
    assert shards.shuffle_rows(odd, 40).count() == odd.count() and shards.shuffle_rows(empty, 40).count() == 0


def test_shards_move_whole_rows(spark):
    """Every column arrives as it was, in blocks cut by bytes, each from all parts."""
    rows = [(2**53 + i if i % 7 else None, f"{i} " * (i % 50) if i % 11 else None, [i]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more array<int>").repartition(3)
    dealt = shards.shuffle_rows(docs, 2, block_bytes=5000)
    assert dealt.rdd.getNumPartitions() > 10
    got = dealt.collect()
    assert sorted(((r["doc_id"], r["text"], r["more"]) for r in got), key=str) == sorted(rows, key=str)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(2) for i in range(250)]


def test_shards_query(spark, sf, documents, monkeypatch):
    """The texts are what is shuffled; sizes and checksums come from what arrived."""
    given, whole = [], shards.shuffle_rows
    monkeypatch.setattr(shards, "shuffle_rows", lambda rows, *a, **b: given.append(rows.columns) or whole(rows, *a, **b))
    df = queries.queries()["op6_hypergeometric_shards"](spark, sf)
    assert given == [spark.read.parquet(f"{sf}/documents.parquet").columns]
    got = df.collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in documents.items()}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == len(documents) and sorted(map(len, by.values())) == sorted(shards.shard_sizes(len(documents), 40).tolist()) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_are_uniform():
    """The matrix has the hypergeometric mean and variance, and large populations follow the same law."""
    draws = np.array([shards.Matrix(np.array([30, 70]), np.array([40, 60]), s).row(0)[0][0] for s in range(3000)])
    assert abs(draws.mean() - 12) < 0.25 and abs(draws.var() - 30 * 0.4 * 0.6 * 70 / 99) < 0.5
    parts, blocks = np.array([5, 0, 17, 3, 8, 30, 1]), np.array([20, 20, 24])
    draws = []
    for seed in range(2000):
        rows = [shards.Matrix(parts, blocks, seed).row(p) for p in range(len(parts))]
        assert all(own.sum() == n and (own >= 0).all() for n, (own, _) in zip(parts, rows)) and (sum(own for own, _ in rows) == blocks).all()
        assert all((before == sum((own for own, _ in rows[:p]), np.zeros(3))).all() for p, (_, before) in enumerate(rows))
        draws.append(rows[5][0][2])
    assert abs(np.mean(draws) - 30 * 24 / 64) < 0.25 and abs(np.var(draws) - 30 * 24 / 64 * 40 / 64 * 34 / 63) < 0.4
    rng = np.random.default_rng(0)
    big = np.array([shards.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 1000) for _ in range(2000)])
    assert abs(big.mean() - 400) < 2 and abs(big.var() / 240 - 1) < 0.15


# 7 -----------------------------------------------------------------------------------------------------------------------


def test_chat_cases(spark):
    nasty = ["<|end|>\n", "\\<|", "<\\|", "a\\", "", "<|part|>", "\\\\|", "</s>[INST]"]
    rows = [(1, i, "assistant" if i % 3 else "us<|er", t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (None, 1, "user", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert back[1]["loss"] == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")] and back[None]["loss"] == []
    assert back[3]["loss"] == ["a", "a", "b"]
    assert chat.format_chats(df.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------------


def brute_components(docs):
    sets, out = [], {}
    for t in docs.values():
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up, ids = brute_links(sets), list(docs)
    for i, d in enumerate(ids):
        out[d] = (len(sets[i]), min(ids[j] for j in range(len(ids)) if up[j] == up[i]))
    return out


@pytest.mark.parametrize("task", [2_000_000, 700])
def test_jaccard_brute_force(spark, sf, documents, monkeypatch, task):
    """Also with tasks so small that clusters are cut into chunks."""
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", task)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.queries()["op8_jaccard_join"](spark, sf).collect()}
    assert got == brute_components(documents)


def test_tree_skips_boxes_and_loses_no_link(sf, monkeypatch):
    """Over all sets of the table with a partner, planted in one tree: bounds skip most points, and every link is found."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").column("text").combine_chunks()
    grams, at, prints = jaccard_join.text_sets(texts)
    _, first = np.unique(prints, return_index=True)
    sets = [grams[at[i] : at[i + 1]] for i in first.tolist() if at[i + 1] > at[i]]
    trees, made = [], jaccard_join.Tree
    monkeypatch.setattr(jaccard_join, "Tree", lambda sets: trees.append(made(sets)) or trees[-1])
    found = jaccard_join.rtree_links(sets, np.arange(len(sets)))
    want = brute_links([frozenset(s.tolist()) for s in sets])
    forest = links.Forest(np.arange(len(sets)))
    for p, q in found:
        assert jaccard_join.similar(sets[p], sets[q])
        forest.join(p, q)
    assert len(found) == len(sets) - len(set(want)) and all(forest.root(i) == forest.root(w) for i, w in enumerate(want))
    assert trees[0].skipped > 2 * trees[0].seen > 0


def test_jaccard_chain(spark, monkeypatch):
    """A chain of near copies whose ends aren't similar is one component, chunks or not."""
    words = [f"w{i}" for i in range(260)]
    docs = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(40)}
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 300)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.clusters(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(docs).items()} and set(got.values()) == {0}


def test_jaccard_cases(spark, odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.clusters(odd).collect()), key=str)
    assert [r for r in got if r[0] == 4] == [(4, 2, 4)] and [r for r in got if r[0] == 5] == [(5, 2, 4)] * 2 and (1, 0, 1) in got and (8, 1, 8) in got and (None, 2, 4) in got
    assert jaccard_join.clusters(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_one_of_each_chooses_rows(spark):
    """Null ids, and ids that repeat with other texts, neither keep near copies nor lose documents."""
    text = lambda name, tail: " ".join([f"{name}{i}" for i in range(60)] + [tail])
    rows = [(None, text("a", "x")), (None, text("a", "y")), (None, text("n", "x")), (1, text("b", "x")), (None, text("b", "y")), (7, text("c", "x")), (3, text("c", "y")), (7, text("d", "x")), (9, text("e", "x")), (9, text("e", "y")), (None, ""), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(kept) <= set(rows)
    assert sorted((i, t and t[0]) for i, t in kept if i) == [(1, "b"), (3, "c"), (7, "d"), (9, "e")]
    assert sorted(str(t)[:1] for i, t in kept if not i) == ["", "N", "a", "n"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(0, i) for i in range(300, 400)]
    got = {r["node"]: r["label"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# 9 -----------------------------------------------------------------------------------------------------------------------


def test_scores(spark, sf, documents):
    rows = queries.queries()["op9_interpolated_lm"](spark, sf).collect()
    tokens = {i: [*t.encode().lower().split(), None] for i, t in documents.items()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    c = Counter(w for i, t in tokens.items() if fold(i) for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        mine = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (fold(r["doc_id"]) == 0, len(mine), n, sum(c[w] > 0 for w in mine))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in rows)


def test_model_brute_force(spark, monkeypatch):
    """With given weights, every probability is the mixture of the three estimates."""
    rng = random.Random(4)
    docs = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for i in range(80)}
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda h, types: np.array([[0.0, 0.75, 0.25]] + [[0.6, 0.3, 0.1]] * 31))
    got = {r["doc_id"]: r["score"] for r in interpolated_lm.score(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), group_bytes=500).collect()}
    tokens = {i: [*t.split(), None] for i, t in docs.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    for i, t in tokens.items():
        p = [(0.6 * two[u, w] / one[u] + 0.3 * one[w] / n + 0.1 / (v + 1)) if one[u] else (0.75 * one[w] / n + 0.25 / (v + 1)) for u, w in zip([None, *t], t)]
        assert got[i] == pytest.approx(sum(map(math.log10, p)))


def test_em():
    import pandas as pd

    h = pd.DataFrame({"context": [3, 3], "p2": [0, 700 * math.exp(-0.7)], "p1": [300 * math.exp(-2.9), 700 * math.exp(-8.9)], "n": [300, 700]})
    w = interpolated_lm.learn_weights(h, 1000)
    assert w.sum(1) == pytest.approx(1) and 0.65 < w[3][0] < 0.75 and (w[4] == w[3]).all()


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1))
@settings(max_examples=60, deadline=None)
def test_packed_keys(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert (interpolated_lm.unpack_keys(interpolated_lm.pack_keys(keys)) == keys).all()


def test_weights_of_exact_em(spark, sf, documents, monkeypatch):
    """The weights learned from cells are those of EM over every single held-out token."""
    seen, learn = {}, interpolated_lm.learn_weights
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda h, types: seen.setdefault("w", learn(h, types)))
    interpolated_lm.score(spark.read.parquet(f"{sf}/documents.parquet"))
    tokens = {i: [*t.encode().lower().split(), None] for i, t in documents.items()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    rest = [t for i, t in tokens.items() if fold(i) > 1]
    one, two = Counter(w for t in rest for w in t), Counter(p for t in rest for p in zip([None, *t], t))
    n = sum(one.values())
    held = [p for i, t in tokens.items() if fold(i) == 1 for p in zip([None, *t], t)]
    bucket = np.array([one[u].bit_length() for u, _ in held])
    p = np.array([(two[u, w] / one[u] if one[u] else 0, one[w] / n, 1 / (len(one) + 1)) for u, w in held])
    mixed = {"exact": 0.0, "cells": 0.0}
    for b in set(bucket):
        mine, w = p[bucket == b], np.array([0.4 if b else 0.0, 0.5, 0.1])
        w = w / w.sum()
        for _ in range(60):
            w = (mine * w / (mine @ w)[:, None]).mean(0)
        assert seen["w"][b] == pytest.approx(w, abs=2e-3)
        mixed["exact"] += np.log10(mine @ w).sum()
        mixed["cells"] += np.log10(mine @ seen["w"][b]).sum()
    assert mixed["cells"] == pytest.approx(mixed["exact"], rel=1e-5)


def test_score_cases(spark, odd, empty):
    assert interpolated_lm.score(odd).count() == odd.count() and interpolated_lm.score(empty).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------------


def test_dedup_cases(spark, odd, empty):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(odd).collect()), key=str)
    assert sum(k for *_, k in got) == 6
    assert [g for g in got if g[0] == 5] == [(5, 5, 4, False), (5, 5, 4, True)] and (4, 5, 4, False) in got and (None, 5, 4, False) in got and (1, 2, 2, False) in got
    assert exact_dedup.exact_groups(empty).count() == 0


def test_dedup_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 5000)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 15_000).cast("string").alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.where("kept").count() == 15_000 and got.where("group_size = 2").count() == 10_000


def test_survivors_are_whole_rows(spark, sf, odd, empty):
    rows = [(None, "x", "s"), (None, "X", "s"), (None, "y", "t"), (5, "z", "u"), (5, "Z", "u"), (4, "z", "v"), (5, "q", "w"), (6, None, "e"), (None, "", "f")]
    got = [(r["doc_id"], (r["text"] or "").lower(), r["source"]) for r in exact_dedup.survivors(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "x", "s"), (None, "y", "t"), (5, "z", "u"), (5, "q", "w"), (6, "", "e")], key=str)
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns and kept.count() == 6 and exact_dedup.survivors(empty).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.join(exact_dedup.exact_groups(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    assert sorted(map(tuple, exact_dedup.survivors(docs).collect())) == sorted(map(tuple, want.collect()))


def test_bloom_lets_singles_pass(spark, monkeypatch):
    """In one range and in many, with a hot digest; the digests are scanned twice whatever the number of ranges."""
    hashed = spark.range(12_000).select(F.col("id").alias("__id"), F.sha2(F.when(F.col("id") < 4000, F.lit("x")).otherwise(F.col("id").cast("string")), 256).alias("__digest"), F.col("id").alias("__row"))
    hashed, written = common.materialise(hashed, "hashed"), []
    monkeypatch.setattr(exact_dedup, "materialise", lambda df, name: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.materialise(df, name))
    for size in (1 << 24, 700):
        monkeypatch.setattr(exact_dedup, "RANGE_ROWS", size)
        written.clear()
        flagged = exact_dedup.flagged(hashed, 12_000)
        assert flagged.columns == [*hashed.columns, "__again"] and flagged.count() == 12_000
        again = {r[0] for r in flagged.where("__again").select("__id").collect()}
        assert again >= set(range(4000)) and len(again) < 4600
        path = hashed._plumbline_path.rsplit("/", 1)[-1]
        scans = sum(plan.count("Relation [__id") for plan in written)
        assert len(written) == 2 and scans == 2, (path, scans)


# Pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    after = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = common.materialise(stage(spark, current, sf), "stage")
        assert current.columns == docs.columns
        after[name] = {r["doc_id"]: r["text"] for r in current.collect()}
    assert set(after["quality rules"]) == judged
    left = brute_lines(after["quality rules"])
    emptied = {i for i, t in left.items() if not t.split() and after["quality rules"][i].split()}
    assert after["line dedup"] == {i: t for i, t in left.items() if i not in emptied} and emptied
    want = brute_components(after["line dedup"])
    assert set(after["n-gram Jaccard join"]) == {i for i, (_, c) in want.items() if c == i}
    check_pieces(corpus_pipeline.run(spark, sf).collect(), token_ids(after["n-gram Jaccard join"]))


def test_pipeline_on_odd_input(spark, tmp_path, odd):
    """Nulls, ties, repeats and clashing names, and no rows at all: the stages run, and whole documents come out once."""
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(80))
    more = spark.createDataFrame([(20, words, "s", "x", "y"), (21, words, "s", "x", "y"), (None, words + " end", None, None, None), (20, words, "s", "x", "y"), (22, " ".join(f"v{i}" for i in range(90)), None, "x", "y")], DOCS)
    for name, docs in (("odd", odd.unionByName(more)), ("empty", odd.limit(0))):
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in rows} == ({20, 22} if name == "odd" else set()) or {r["doc_id"] for r in rows} == {None, 22}
        assert len({r["doc_id"] for r in rows}) == len({(r["doc_id"], r["doc_tokens"]) for r in rows})


def test_a_line_of_two_batches_is_noted_once():
    """Not once for each of its keys; and few lines of a cluster are held against each other without an index."""
    lines = [f"line {i} of a text that two batches have, and no other one" * 2 for i in range(0, 4000, 97)]
    keys, sketches = line_dedup.signatures(lines)
    items = line_dedup.line_names(lines)[1]
    sent = pa.Table.from_batches([line_dedup._packed([keys], [sketches], [items], 5)] * 2)
    edges = [e for b in range(5) for e in zip(*links.stars(sent.filter(pc.equal(sent.column("bucket"), b))).to_pydict().values())]
    assert 0 < sum(a == b for a, b in edges) <= len(lines)
    assert {x for e in edges for x in e} == set(items.view(np.int64).tolist())
