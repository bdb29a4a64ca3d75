"""A linear-chain conditional random field over word-shape features, in numpy.

Texts are cut into tokens: runs of letters, runs of digits, single symbols. A token's features are its shape and length, those of its
neighbours, known words around it, and what its number looks like. Labels are O, and B and I of each kind; I follows only B or I of its kind.

Most text can't hold a span: only words within REACH words of one with a digit, an @, a bracketed "at" or "dot", or the word "dot" are
free to be anything but O, in training and in decoding alike. Between fixed tokens the chain falls apart into independent
regions, so the best labelling of a whole text is that of its regions, found by Viterbi for all regions of a batch together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)
REACH = 3
#: Around every text: words of nothing, more than REACH, so that no window meets another text's.
EDGE = " \0 \0 \0 \0 "
#: Strength of the ridge penalty, fitting steps and their size.
RIDGE, STEPS, RATE = 0.02, 90, 0.25
#: A word is known if the labelled rows have it so often.
KNOWN = 4

_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL = range(5)


def _classes() -> np.ndarray:
    out = np.full(129, _SYMBOL, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[48:58], out[65:91], out[97:123], out[128] = _DIGIT, _UPPER, _LOWER, _LOWER
    return out


_CLASS = _classes()
_LENGTH = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 6, 7])
_CHAIN = np.isin(np.arange(129), [ord(c) for c in "-./()+"])
#: Which label may follow which.
LEGAL = np.array([[b % 2 == 1 or b == 0 or (a > 0 and (a - 1) // 2 == (b - 1) // 2) for b in range(LABELS)] for a in range(LABELS)])


@dataclass
class Tokens:
    """The tokens of some texts' windows: where they stand (in the texts as one string), whether they are free, and their features."""

    start: np.ndarray
    end: np.ndarray
    free: np.ndarray
    features: np.ndarray  # tokens x templates
    words: np.ndarray  # a hash of each letter run in lower case, 0 for others
    bases: np.ndarray  # where each text begins


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def tokens(texts: list[str], known: np.ndarray) -> Tokens:
    """known: the sorted hashes of known words."""
    joined = EDGE + "".join(t + EDGE for t in texts)
    bases = len(EDGE) + np.cumsum([0, *(len(t) + len(EDGE) for t in texts[:-1])])
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(point, 128)
    kind = _CLASS[small]
    solid = kind != _SPACE
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    word = np.cumsum(opens) - 1  # of each solid character
    n_words = int(word[-1]) + 1
    first = np.flatnonzero(opens)

    active = np.zeros(n_words, bool)
    active[word[(kind == _DIGIT) | (small == 64)]] = True
    folded = np.where(kind == _UPPER, small + 32, small)
    opening = np.flatnonzero(np.isin(small[:-5], [ord(c) for c in "[({<"]))
    for said in ("at", "dot"):
        hit = opening
        for k, c in enumerate(said, 1):
            hit = hit[folded[hit + k] == ord(c)]
        active[word[hit[np.isin(small[hit + len(said) + 1], [ord(c) for c in "])}>"])]]] = True
    size = np.diff(np.append(first, len(point)))  # with the space behind; enough to find three letters
    dots = np.flatnonzero(size >= 4)
    for k, c in enumerate("dot"):
        dots = dots[folded[first[dots] + k] == ord(c)]
    active[dots[kind[first[dots] + 3] == _SPACE]] = True
    edge = point[first] == 0
    window = _widened(active, REACH) & ~edge
    taken = _widened(window, REACH)

    at = np.flatnonzero(solid & taken[word])
    group = np.where(kind[at] == _UPPER, _LOWER, kind[at])
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1]) | (group[1:] == _SYMBOL)
    heads = np.flatnonzero(new)
    start = at[heads]
    length = np.diff(np.append(heads, len(at)))
    end, group = start + length, group[heads]
    gap = np.ones(len(start), np.int64)
    gap[1:] = start[1:] != end[:-1]

    total = lambda flags: np.add.reduceat(flags[at].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    upper, hexes = total(kind == _UPPER), total(((folded >= 97) & (folded <= 102)) | (kind == _DIGIT))
    shape = np.where(upper == 0, 0, np.where((upper == length) & (length > 1), 2, np.where((upper == 1) & (kind[start] == _UPPER), 1, 3)))
    letters = 160 + shape * 16 + _LENGTH[np.minimum(length, 15)] * 2 + (hexes == length)
    own = np.where(group == _SYMBOL, small[start], np.where(group == _DIGIT, 128 + np.minimum(length, 20), letters))

    within = np.arange(len(at)) - np.repeat(heads, length)
    value = (folded[at].astype(np.uint64) + np.uint64(1)) * (mix64(within.astype(np.uint64) + np.uint64(1)) | np.uint64(1))
    words = np.where(group == _LOWER, mix64(np.add.reduceat(value, heads)) if len(heads) else 0, 0).astype(np.uint64)
    place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    spoken = np.where(known[place] == words, place + 1, 0) if len(known) else np.zeros(len(words), np.int64)

    monkey = np.full(n_words, -1)
    signs = np.flatnonzero(small == 64)
    monkey[word[signs]] = signs
    mine = monkey[word[start]]
    side = np.where(mine < 0, 0, np.where(start < mine, 1, 2))

    per = lambda flags: np.bincount(word[flags], minlength=n_words)
    hexed = per(solid & ~((small == 58) | (kind == _DIGIT) | ((folded >= 97) & (folded <= 102)))) == 0
    look = np.minimum(per(small == 58), 8) * 40 + np.minimum(per(small == 46), 4) * 8 + np.minimum(per(kind == _DIGIT), 1) * 4 + np.minimum(per(small == 64), 1) * 2 + hexed
    look = look[word[start]]

    linked = (group == _DIGIT) | ((group == _SYMBOL) & _CHAIN[small[start]])
    fresh = np.ones(len(start), bool)
    fresh[1:] = ~linked[1:] | ~linked[:-1] | (start[1:] - end[:-1] > 1)
    chain = np.cumsum(fresh) - 1
    digit = (group == _DIGIT) & linked
    count = lambda w: np.bincount(chain, weights=w, minlength=len(start)).astype(np.int64)
    n_digits, n_groups, n_dots = count(np.where(digit, length, 0)), count(digit), count(small[start] == 46)
    three = np.zeros(len(start), np.int64)
    for k in range(3):
        inside = digit & (length > k)
        three[inside] = three[inside] * 10 + small[start[inside] + k] - 48
    over = count(digit & ((length > 3) | (three > 255)))
    luhn = np.zeros(len(start), np.int64)
    where = np.flatnonzero(fresh)
    for c in np.flatnonzero((n_digits >= 13) & (n_digits <= 19)).tolist():
        last = where[c + 1] if c + 1 < len(where) else len(start)
        luhn[c] = 1 + _luhn("".join(x for x in joined[start[where[c]] : end[last - 1]] if "0" <= x <= "9"))
    figures, groups, valid = np.minimum(n_digits[chain], 21), np.minimum(n_groups[chain], 9), luhn[chain]
    quad = ((n_groups == 4) & (n_dots == 3) & (over == 0))[chain].astype(np.int64)

    def near(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if k >= 0:
            out[: len(x) - k] = x[k:]
        else:
            out[-k:] = x[:k]
        return out

    templates = [
        own, near(own, -1), near(own, 1), near(own, -2), near(own, 2), near(own, -3), near(own, 3),
        own * 256 + near(own, -1), own * 256 + near(own, 1), near(own, -2) * 256 + near(own, -1), near(own, 1) * 256 + near(own, 2), own * 4 + gap * 2 + near(gap, 1), near(own, -1) * 4 + gap * 2 + near(gap, -1),
        spoken, near(spoken, -1), near(spoken, -2), near(spoken, -3), near(spoken, 1), near(spoken, 2),
        side * 256 + own, look, look * 256 + own, np.where(linked, figures * 3 + valid, 99), np.where(linked, figures * 10 + groups, 999), np.where(linked, (figures * 3 + valid) * 256 + own, 0), quad * 256 + own, np.zeros(len(own), np.int64),
    ]
    features = np.stack([(k << 20) + t for k, t in enumerate(templates)], 1) if len(start) else np.zeros((0, len(templates)), np.int64)
    return Tokens(start, end, window[word[start]], features, words, bases)


def _widened(flags: np.ndarray, by: int) -> np.ndarray:
    out = flags.copy()
    for k in range(1, by + 1):
        out[k:] |= flags[:-k]
        out[:-k] |= flags[k:]
    return out


def _regions(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, length) of each run of free tokens, the longest first."""
    change = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
    first, length = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - np.flatnonzero(change == 1)
    order = np.argsort(-length, kind="stable")
    return first[order], length[order]


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of known words
    keys: np.ndarray  # sorted features
    weights: np.ndarray  # (features + 1) x labels; the last row, of unknown features, is zero
    moves: np.ndarray  # labels x labels, -inf where illegal

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), LABELS))
        for k in range(features.shape[1]):
            out += self.weights[_rows(self.keys, features[:, k])]
        return out


def _rows(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
    return np.where(keys[at] == features, at, len(keys))


def viterbi(emissions: np.ndarray, first: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label of each token of regions [first, first + length), the longest first; other tokens are O. Before and behind a
    region stands O."""
    labels = np.zeros(len(emissions), np.int8)
    if not len(first):
        return labels
    best = moves[0][None, :] + emissions[first]
    back, steps = [], int(length[0])
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # regions longer than t
    ended = np.empty((len(first), LABELS))
    for t in range(1, steps):
        n = live[t]
        ended[n : len(best)] = best[n:]
        scores = best[:n, :, None] + moves[None]
        back.append(scores.argmax(1).astype(np.int8))
        best = scores.max(1) + emissions[first[:n] + t]
    ended[: len(best)] = best
    now = (ended + moves[:, 0][None]).argmax(1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        labels[first[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return labels


def _gold(rows: list[tuple[str, list[tuple[str, int, int]]]], t: Tokens) -> np.ndarray:
    labels = np.zeros(len(t.start), np.int64)
    for (_, spans), base in zip(rows, t.bases.tolist()):
        for kind, start, end in spans:
            at = np.flatnonzero((t.start >= base + start) & (t.end <= base + end) & t.free)
            labels[at] = 2 + 2 * KINDS.index(kind)
            labels[at[:1]] -= 1
    return labels


def train(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Model:
    """Penalised maximum likelihood from (text, [(kind, start, end)]), by gradient steps with momentum."""
    if not rows:
        raise ValueError("labelled rows are needed")
    texts = [text for text, _ in rows]
    heard, often = np.unique(tokens(texts, np.zeros(0, np.uint64)).words, return_counts=True)
    known = heard[(often >= KNOWN) & (heard != 0)]
    t = tokens(texts, known)
    gold, (first, length) = _gold(rows, t), _regions(t.free)
    keys, index = np.unique(t.features[t.free], return_inverse=True)
    row_of = np.cumsum(t.free) - 1  # free tokens only
    index, gold, first = index.reshape(-1, t.features.shape[1]), gold[t.free], row_of[first]
    order = np.argsort(index.ravel(), kind="stable")
    starts = np.searchsorted(index.ravel()[order], np.arange(len(keys)))
    token_of = order // index.shape[1]
    live = [int(np.searchsorted(-length, -k, side="left")) for k in range(int(length[0]))]

    observed = np.zeros((LABELS, LABELS))
    last = first + length - 1
    np.add.at(observed, (np.zeros(len(first), int), gold[first]), 1)
    np.add.at(observed, (gold[last], np.zeros(len(first), int)), 1)
    for k in range(1, len(live)):
        np.add.at(observed, (gold[first[: live[k]] + k - 1], gold[first[: live[k]] + k]), 1)

    weights, moves = np.zeros((len(keys), LABELS)), np.zeros((LABELS, LABELS))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, moves)]
    for step in range(1, STEPS + 1):
        jump = np.where(LEGAL, np.exp(moves), 0.0)
        score = weights[index].sum(1)
        likely = np.exp(score - score.max(1, keepdims=True))
        forward, expected = [], np.zeros_like(moves)
        alpha = jump[0][None] * likely[first]
        alpha /= alpha.sum(1, keepdims=True)
        forward.append(alpha)
        for k in range(1, len(live)):
            at = first[: live[k]] + k
            alpha = (alpha[: live[k]] @ jump) * likely[at]
            alpha /= alpha.sum(1, keepdims=True)
            forward.append(alpha)
        chance = np.empty_like(score)
        beta = np.repeat(jump[:, 0][None], len(first), 0)
        for k in range(len(live) - 1, -1, -1):
            n, alpha = live[k], forward[k]
            both = alpha * beta[:n]
            z = both.sum(1, keepdims=True)
            at = first[:n] + k
            chance[at] = both / z
            ending = length[:n] == k + 1
            expected[:, 0] += chance[at][ending].sum(0)
            if k:
                right = likely[at] * beta[:n]
                arc = forward[k - 1][:n]
                weight = ((arc @ jump) * right).sum(1, keepdims=True)
                expected += jump * (arc.T @ (right / weight))
                beta[:n] = right @ jump.T
                beta[:n] /= beta[:n].sum(1, keepdims=True)
            else:
                expected[0] += chance[at].sum(0)
        slope = chance.copy()
        slope[np.arange(len(gold)), gold] -= 1
        gradients = (np.add.reduceat(slope[token_of], starts) + RIDGE * weights, expected - observed + RIDGE * moves)
        for x, g, (m, v) in zip((weights, moves), gradients, state):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8) * (1 - step / (STEPS + 1))
    return Model(known, keys, np.vstack([weights, np.zeros((1, LABELS))]), np.where(LEGAL, moves, -np.inf))


def spans(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text, in order, in code points."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    t = tokens(texts, model.known)
    first, length = _regions(t.free)
    free = np.flatnonzero(t.free)
    emissions = np.zeros((len(t.start), LABELS))
    emissions[free] = model.emissions(t.features[free])
    labels = viterbi(emissions, first, length, model.moves)
    for i in np.flatnonzero(labels % 2 == 1).tolist():
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        text = int(np.searchsorted(t.bases, t.start[i], side="right")) - 1
        base = int(t.bases[text])
        found[text].append((KINDS[(labels[i] - 1) // 2], int(t.start[i]) - base, int(t.end[j - 1]) - base))
    return found
