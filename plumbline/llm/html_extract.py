"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. Tags score negative, by how much more often labelled pages have them outside their main
text. Words score by the block that they stand in: a logistic model, fitted to the same labelled pages, weighs the elements
and names around the block, whether it lies in or outside the page's article or main element, its number of words, the share
of them in links, the share of words that labelled pages have in their boilerplate alone, and its end. Words of text-like blocks
score positive, those of menus, notices and the like negative. Two linear scans then decide:

- Kadane's finds the contiguous region with the largest sum, and all outside it goes, whatever its blocks look like;
- inside the region, a scan over the negated scores finds all maximal runs of blocks that together speak against being text, such as an
  advert with its heading amid an article, and those go, whatever single blocks within such a run look like.

All weights come from labelled pages (by default LABELLED_PAGES, a fixed set of a few pages); no name or word is good or bad by itself. Tags
are read in one forward pass, so a page takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled_pages import LABELLED_PAGES

#: Elements whose content is no text of the page.
RAW = "script style noscript template iframe svg object title textarea".split()
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_TAG_START = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_TAG_MARK, _ANGLE = re.compile(r"""[<>"']"""), re.compile("[<>]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]{2,}")
_WORD = re.compile(r"[^\W\d_]{3,}")

#: Elements inside a block; any other tag ends the block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Elements that say nothing about what is inside.
NEUTRAL = frozenset("html body div table tbody tr center form".split())
#: An element of these ends an open one of its kind that it stands directly in.
UNCLOSED = frozenset("p li td th dd dt option tr".split())
#: Blocks of at least so many words are one kind of length each.
LENGTHS = (1, 2, 5, 10, 25)
BIAS = "bias"
#: Strength of the model's ridge penalty, and its fitting steps.
RIDGE, STEPS = 0.1, 50
#: The most that a word scores, that one costs, and that a tag costs. Words cost less than they score, so that an advert amid an
#: article does not cut it in two.
WORD_LIMIT, WORD_COST, TAG_LIMIT = 2.0, 1.0, 0.25
#: What being inside the region adds to a block's log odds.
INSIDE = 0.8
#: A word of boilerplate stands in so many labelled blocks outside the main text at least, and in a third as many inside at most.
OFTEN, RATIO = 2, 3


def _tag_end(page: str, at: int, unpaired: set[str]) -> int:
    """Where the tag whose name ends at `at` ends: behind its >, before the next <, or nowhere (-1). Quotes count behind an = only, and
    only where they are closed; unpaired remembers which kind is not closed any more, so that no text is searched twice for it."""
    pos = at
    while m := _TAG_MARK.search(page, pos):
        if m[0] == ">":
            return m.end()
        if m[0] == "<":
            return m.start()
        pos = m.end()
        if page[m.start() - 1] == "=" or page[max(at, m.start() - 8) : m.start()].rstrip()[-1:] == "=":
            close = -1 if m[0] in unpaired else page.find(m[0], pos)
            if close < 0:
                unpaired.add(m[0])
                m = _ANGLE.search(page, pos)
                return -1 if not m else m.end() if m[0] == ">" else m.start()
            pos = close + 1
    return -1


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order, without comments, declarations and the
    content of RAW elements. What only looks like a tag is text."""
    at = text = 0  # text: from where text has not been given out
    unpaired: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        begin, found = at, None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            m = _ANGLE.search(page, at + 1)
            end = -1 if not m else m.end() if m[0] == ">" else m.start()
        elif m := _TAG_START.match(page, at):
            name = m[1].lower()
            end = _tag_end(page, m.end(), unpaired)
            found = ("close", name, "") if page[at + 1] == "/" else ("open", name, page[m.end() : end])
            if name in _RAW_END and found[0] == "open" and end >= 0:
                m = _RAW_END[name].search(page, end)
                end, found = m.end() if m else len(page), None
        else:
            end = -1
        if end < 0:
            at += 1
            continue
        if begin > text:
            yield "text", page[text:begin], ""
        if found:
            yield found
        at = text = end
    if text < len(page):
        yield "text", page[text:], ""


class Reader:
    """The open elements of a page while it is read, as the features of what is inside them."""

    def __init__(self, known: Container[str] | None = None):
        self.known, self.stack, self.features, self.opened, self.links, self.forms = known, [], Counter(), Counter(), 0, []

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        if self.stack and (self.stack[-1][0] == tag and tag in UNCLOSED or self.stack[-1][0] == "p"):
            self.close(self.stack[-1][0])
        names = [] if tag in ("html", "body") else [w for x in _NAMES.findall(attributes) for w in _PARTS.findall("".join(x).lower())]
        mine = {f"name:{w}" for w in names} | ({f"in:{tag}"} if tag not in NEUTRAL else set())
        mine = [f for f in mine if self.known is None or f in self.known]
        self.features.update(mine)
        self.opened[tag] += 1
        if tag == "form":
            self.forms.append(len(self.stack))
        self.stack.append((tag, mine))
        self.links = 0

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE or not self.opened[tag]:
            return
        while True:  # a closing tag ends all that is open inside its element
            last, mine = self.stack.pop()
            self.opened[last] -= 1
            if last == "form":
                self.forms.pop()
            for f in mine:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
            if last == tag:
                self.links = 0
                return


def items(page: str, known: Container[str] | None = None, boilerplate: Container[str] = ()) -> list[tuple[str, str, tuple[str, ...]]]:
    """("block", text, features) and ("tag", its name, ()) in page order. Elements end blocks, inline ones aside."""
    reader, out, parts, words, linked = Reader(known), [], [], 0, 0
    has = {tag: bool(re.search(rf"<{tag}[\s>]", page, re.I)) for tag in ("article", "main")}

    def end() -> None:
        nonlocal parts, words, linked
        if words:
            raw = "".join(parts)
            features = [BIAS, *reader.features, f"own:{reader.stack[-1][0] if reader.stack else ''}", f"words:{max(k for k in LENGTHS if k <= words)}"]
            features.append("links:none" if not linked else "links:some" if 2 * linked < words else "links:most")
            features.append(f"end:{raw.rstrip()[-1:] in '.?!。？！…:;'}")
            features += [f"{tag}:{'inside' if reader.opened[tag] else 'outside'}" for tag, found in has.items() if found]
            if reader.forms:  # a form right around a block holds its fields; one further out may be around a whole page
                features.append("form:near" if len(reader.stack) - reader.forms[-1] <= 2 else "form:far")
            said = _WORD.findall(raw.lower())
            usual = sum(w in boilerplate for w in said)
            features.append("usual:none" if not usual else "usual:some" if 4 * usual < len(said) else "usual:many")
            out.append(("block", raw, tuple(features)))
        parts, words, linked = [], 0, 0

    for kind, value, attributes in pieces(page):
        if kind == "text":
            n = len(value.split())
            parts.append(value)
            words += n
            linked += n if reader.links else 0
            continue
        if value not in INLINE:
            end()
        (reader.close(value) if kind == "close" else reader.open(value, attributes))
        out.append(("tag", "/" + value if kind == "close" else value, ()))
    end()
    return out


def boilerplate_words(pages: list[str]) -> frozenset[str]:
    """Words that OFTEN labelled blocks outside main text have, and few inside."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for kind, value, _ in items(page):
            if kind == "block":
                said = set(_WORD.findall(value.lower()))
                (inside.update(said) if "[[" in value else outside.update(said))
    return frozenset(w for w, n in outside.items() if n >= OFTEN and n >= RATIO * inside[w])


@dataclass(frozen=True)
class Weights:
    """What labelled pages teach: weights of block features, scores of tags, words of boilerplate."""

    features: dict[str, float]
    tags: dict[str, float]
    boilerplate: frozenset[str]


def learn(pages: list[str]) -> Weights:
    """From pages with [[ ]] around the blocks of their main text."""
    usual = boilerplate_words(pages)
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    blocks, labels, sizes = [], [], []
    for page in pages:
        inside = ["[[" in value for _, value, _ in items(page)]
        found = items(page.replace("[[", "").replace("]]", ""), None, usual)
        first, last = inside.index(True), len(inside) - 1 - inside[::-1].index(True)
        for i, (kind, value, features) in enumerate(found):
            if kind == "tag":
                tags[first - 1 <= i <= last + 1][value] += 1  # the tags around the first and last blocks are theirs
            else:
                blocks.append(set(features))
                labels.append(inside[i])
                sizes.append(1 + math.log(len(value.split())))
    # A feature of a single block could only learn that block by heart.
    counts = Counter(f for b in blocks for f in b)
    names = sorted(f for f, n in counts.items() if n > 1 or f.startswith("name:"))
    x = np.array([[f in b for f in names] for b in blocks], float)
    y, n, w = np.array(labels, float), np.array(sizes), np.zeros(len(names))
    for _ in range(STEPS):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T * (n * p * (1 - p)) @ x + RIDGE * np.eye(len(names)), x.T @ (n * (y - p)) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    n_in, n_out = sum(tags[True].values()), sum(tags[False].values())
    scores = {t: max(-TAG_LIMIT, min(-0.05, math.log((tags[True][t] + 1) / (n_in + 1)) - math.log((tags[False][t] + 1) / (n_out + 1)))) for t in tags[True] | tags[False]}
    return Weights(dict(zip(names, w.tolist())), scores, usual)


def log_odds(features: tuple[str, ...], weights: Weights) -> float:
    """Of a block being main text."""
    return sum(weights.features.get(f, 0.0) for f in features)


def region(scored: list[float]) -> tuple[int, int]:
    """Where the largest sum of consecutive scores begins and ends (Kadane's scan); nothing if no sum is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scored):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total >= best and total > 0:  # of equal regions the longer one: it leaves out no words
            best, span = total, (begin, i + 1)
    return span


def runs(scored: list[float]) -> list[tuple[int, int]]:
    """All maximal runs of positive sum, disjoint and in order: none can be made larger or joined with its neighbour for a better one
    (the linear scan of Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum with it
    total = 0.0
    for i, score in enumerate(scored):
        before, total = total, total + score
        if score <= 0:
            continue
        begin, low, high = i, before, total
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
        found.append((begin, i + 1, low, high))
    return [(begin, end) for begin, end, _, _ in found]


def main_text(page: str | None, weights: Weights) -> str:
    """The page's main text: references decoded, white space inside a block one space, blocks joined by one space."""
    found, scored, odds = items(page or "", weights.features, weights.boilerplate), [], []
    for kind, value, features in found:
        odds.append(log_odds(features, weights) if kind == "block" else 0.0)
        scored.append(len(value.split()) * max(-WORD_COST, min(WORD_LIMIT, odds[-1])) if kind == "block" else weights.tags.get(value, -TAG_LIMIT))
    begin, end = region(scored)
    blocks = [i for i in range(begin, end) if found[i][0] == "block"]
    against = [-(odds[i] + INSIDE) * (1 + math.log(len(found[i][1].split()))) for i in blocks]
    left_out = {k for first, last in runs(against) for k in range(first, last)}
    texts = (" ".join(html.unescape(found[i][1]).split()) for k, i in enumerate(blocks) if k not in left_out)
    return " ".join(t for t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, weights) for page in batch.column(batch.num_columns - 1).to_pylist()]
        out = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """pages with html_col replaced by text and n_chars (code points); no shuffle, pages of any length whole.

    Null or empty html, and a page without a region of positive score, give an empty text. Repeated rows stay. Columns named
    text or n_chars are replaced.
    """
    weights = learn(labelled or LABELLED_PAGES)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"])
    return pages.select(*keep, html_col).mapInArrow(partial(_extract, weights=weights), schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
