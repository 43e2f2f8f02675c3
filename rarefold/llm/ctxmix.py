"""Language-model scoring by online logistic context mixing.

A token's symbol is coded in bits along a Huffman path; rare words share one symbol and pay their smoothed
share beside. Every bit is predicted from hashed contexts: none, the last frequent word, the ending of the
word before, the word before, the two words before, and a match with an earlier place in the text. The
predictions are mixed in the logistic domain with weights chosen by a gate, and refined by an adaptive
probability map. Sums of log probabilities give a text's total, and its bits per byte.

Learned from all training texts: exact counts of every token, and bit counts of every hashed context
(additive, so tasks sum their own and only sums are shuffled), then the mixer's first weights, the map and the
match's hit rates: sums over every bit of all whole texts, with each text's own bits taken out of the counts it
sees, and Newton steps from them. All of it is additive over texts, so the model is a function of the rows alone,
however they are dealt. Scoring goes on online from there: each text has its own weights and map, updated every
``STEP`` bits from the bits before.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import blocks, checkpointed, map_stream, mix64, table, texts_of, word_hashes

#: Symbols with a path of their own, bits of a context table's slot number, counters of one shuffled row.
HEAD, TABLE_BITS, CHUNK = 1 << 16, 20, 1 << 10
FREQUENT = 255
MIX_ROUNDS, MIX_RATE, STEP, PULL = 1, 0.02, 512, 20.0
#: Bits that the fitted map counts for in every bin while a text refines it.
MAP_SURE = 256
#: Tokens whose bits are held at once.
TOKENS = 20_000
#: Tokens (or one text's, if more), bits and texts that are worked on together: few enough for a core's cache.
NEAR_TOKENS, NEAR_BITS, LANES = 4_000, 1 << 15, 32
#: Most that a half of a small counter (zeros below, ones above) can hold.
SMALL = (1 << 16) - 1
#: Highest bits of a hash that tell where to look among the head words.
HIGH = 18
TABLES, INPUTS, GATES, MAP_BINS, DEPTHS = 4, 7, 16, 33, 8
SOFT = 0.4
END = np.uint64(0x5DEECE66D1234567)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LN10 = math.log(10)


def in_training() -> Column:
    """False for the held-out rows and for those without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))


@dataclass
class Code:
    """Symbols by hash, their Huffman paths, and what order 0 says at each node."""

    hashes: np.ndarray  # sorted hashes of head words
    symbol: np.ndarray  # symbol of each: rank by count; the last symbol is the rare words'
    counts: np.ndarray  # training count of each symbol
    offset: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    order0: np.ndarray  # log-odds of a 1 at each node
    total: int  # N
    kinds: int  # V

    @cached_property
    def salt(self) -> np.ndarray:
        """What each entry of a path adds to a context's share of a slot's hash."""
        return self.node.astype(np.uint64) * _B * _A

    @cached_property
    def lead(self) -> np.ndarray:
        """``order0`` at each entry of a path."""
        return self.order0[self.node]

    @cached_property
    def near(self) -> tuple[np.ndarray, int]:
        """Where the hashes of each value of the ``HIGH`` highest bits begin, and how many the fullest one has."""
        first = np.searchsorted(self.hashes, np.arange(1 << HIGH, dtype=np.uint64) << np.uint64(64 - HIGH))
        return first.astype(np.int32), int(np.diff(first, append=len(self.hashes)).max())

    def symbols(self, h: np.ndarray) -> np.ndarray:
        rare, last = len(self.counts) - 1, len(self.hashes) - 1
        if last < 0:
            return np.full(len(h), rare)
        first, most = self.near
        at = first[(h >> np.uint64(64 - HIGH)).view(np.int64)].astype(np.int64)
        for _ in range(most):
            at += self.hashes[np.minimum(at, last)] < h
        at = np.minimum(at, last)
        return np.where(self.hashes[at] == h, self.symbol[at], rare)


def build_code(hashes: np.ndarray, counts: np.ndarray, total: int, kinds: int) -> Code:
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    freq = np.r_[counts, max(1, total - int(counts.sum()))].astype(np.int64)
    n = len(freq)
    heap = [(int(c), i) for i, c in enumerate(freq)]
    heapq.heapify(heap)
    parent, side, ones, zeros = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), np.ones(max(n, 1)), np.ones(max(n, 1))
    k = n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = k
        side[y] = 1
        zeros[k - n], ones[k - n] = a, b
        heapq.heappush(heap, (a + b, k))
        k += 1
    root = k - 1
    paths = []
    for s in range(n):
        path, x = [], s
        while x != root:
            path.append((parent[x] - n, side[x]))
            x = parent[x]
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths], np.int64)
    flat = [e for p in paths for e in p]
    by = np.argsort(hashes)
    return Code(hashes[by], np.arange(n - 1)[by], freq, np.r_[0, np.cumsum(length)[:-1]], length, np.array([e[0] for e in flat], np.int64), np.array([e[1] for e in flat], np.uint8), np.log(ones / zeros).astype(np.float32), total, kinds)


@dataclass
class Stream:
    """Tokens of some whole texts with their contexts."""

    doc: np.ndarray
    hash: np.ndarray
    symbol: np.ndarray
    context: np.ndarray  # TABLES x tokens
    match: np.ndarray  # earlier token that followed the same two words, or -1
    run: np.ndarray  # class of the match's length, 0 none


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for every n, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _last_same(key: np.ndarray) -> np.ndarray:
    """The last earlier place of the same key, or -1. Keys are sorted by their high bits with the place below them."""
    m = len(key)
    low = np.uint64(m.bit_length())
    sort = np.sort(key >> low << low | np.arange(m, dtype=np.uint64))
    order = (sort & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    same = key[order[1:]] == key[order[:-1]]
    if (same != (sort[1:] >> low == sort[:-1] >> low)).any():  # other keys of the same high bits may lie between
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
    out = np.full(m, -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def read(texts: list[bytes], code: Code, matches: bool = True) -> Stream:
    ends: list = []
    h, at = word_hashes([x.lower() for x in texts], ends)
    tail = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    words, n = np.diff(at), len(texts)
    doc = np.repeat(np.arange(n), words + 1)
    start = at[:-1] + np.arange(n)
    place = np.arange(len(h)) + np.repeat(np.arange(n), words)
    tok, suffix = np.full(len(doc), END, np.uint64), np.zeros(len(doc), np.uint64)
    tok[place], suffix[place] = h, tail
    symbol = code.symbols(tok)
    m = len(tok)

    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        for j in range(k):
            i = start[start + j < np.r_[start[1:], m]] + j
            out[i] = 0
        return out

    one = before(tok, 1)
    two = mix64(one * _A + before(tok, 2))
    common = np.where((symbol < FREQUENT) & (symbol < len(code.counts) - 1), np.arange(m), -1)
    last = np.r_[-1, np.maximum.accumulate(common)[:-1]] if m else common
    frequent = np.where(last >= start[doc], symbol[last] + 1, 0).astype(np.uint64)
    context = np.stack([mix64(frequent * _A + np.uint64(1)), mix64(before(suffix, 1) * _A + np.uint64(2)), mix64(one + np.uint64(3)), mix64(two + np.uint64(4))])
    if not matches:
        return Stream(doc, tok, symbol, context, np.full(m, -1), np.zeros(m, np.int64))
    match = _last_same(two ^ mix64(doc.astype(np.uint64) + np.uint64(77)))
    match[match >= 0] = np.where(doc[match[match >= 0]] == doc[match >= 0], match[match >= 0], -1)
    match[np.arange(m) - start[doc] < 2] = -1
    goes_on = np.r_[False, (match[1:] >= 0) & (match[1:] == match[:-1] + 1)]
    first = np.maximum.accumulate(np.where(goes_on, 0, np.arange(m))) if m else match
    length = np.arange(m) - first
    run = np.where(match < 0, 0, 1 + (length >= 2) + (length >= 8))
    return Stream(doc, tok, symbol, context, match, run)


def _get(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``x[at]`` of places that are all inside, so that numpy needn't look for others."""
    return np.take(x, at, mode="clip")


def slots(context: np.ndarray, salted: np.ndarray) -> np.ndarray:
    """Slots of bits from their context's hash and ``salted``, their node times _B."""
    return _slots(context * _A, salted * _A)


def _slots(context: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (context + salt >> np.uint64(64 - TABLE_BITS)).view(np.int64)


@dataclass
class Bits:
    """Some coded bits: which token, depth in its path, entry of the paths and value, and its slot in every table."""

    tok: np.ndarray
    depth: np.ndarray
    at: np.ndarray
    bit: np.ndarray
    slot: list[np.ndarray]


def bits(s: Stream, code: Code, lo: int, hi: int) -> Bits:
    """Every bit of some neighbouring tokens."""
    return _bits(s, code, np.arange(lo, hi), code.length[s.symbol[lo:hi]], np.zeros(hi - lo, np.int64))


def cut(s: Stream, code: Code, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Bits:
    """The bits from ``lo`` to ``hi`` of all the stream's, for each pair; ``begin`` is where each token's begin."""
    a, b = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi)
    toks = np.repeat(a, b - a) + _ranges(b - a)
    n, skip = code.length[s.symbol[toks]], np.zeros(len(toks), np.int64)
    end = np.cumsum(b - a)
    skip[end - (b - a)] = lo - begin[a]
    n -= skip
    n[end - 1] -= begin[b] - hi
    return _bits(s, code, toks, n, skip)


def _bits(s: Stream, code: Code, toks: np.ndarray, n: np.ndarray, skip: np.ndarray) -> Bits:
    """``n`` bits of every token, after the first ``skip``."""
    base = np.cumsum(n) - n - skip
    place = np.arange(int(n.sum()))
    at = place + np.repeat(code.offset[s.symbol[toks]] - base, n)
    salt = _get(code.salt, at)
    slot = [_slots(np.repeat(s.context[k, toks] * _A, n), salt) for k in range(TABLES)]
    return Bits(np.repeat(toks, n), place - np.repeat(base, n), at, _get(code.bit, at), slot)


def inputs(s: Stream, code: Code, e: Bits, odds: list[np.ndarray], sure: np.ndarray, where: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's inputs of every bit, and its gate. ``odds``: log-odds at ``where`` (None: of the bits themselves); ``sure``: confidence of the third table's."""
    x = np.empty((INPUTS, len(e.tok)), np.float32)
    np.take(code.lead, e.at, out=x[0], mode="clip")
    for k in range(TABLES):
        if where is None:
            x[1 + k] = odds[k]
        else:
            np.take(odds[k], where[k], out=x[1 + k], mode="clip")
    x[5], x[6] = 0, 0.3
    gate = (sure if where is None else _get(sure, where[2])).astype(np.int64)
    some = np.flatnonzero(_get(s.match, e.tok) >= 0)
    if len(some):  # bits of tokens with a match whose path has followed the guess so far
        tok, depth = e.tok[some], e.depth[some]
        guess = s.symbol[s.match[tok]]
        at = np.minimum(code.offset[guess] + depth, len(code.node) - 1)
        agree = (depth < code.length[guess]) & (code.node[at] == code.node[e.at[some]])
        some, at = some[agree], at[agree]
        x[5, some] = 2.0 * code.bit[at] - 1
        gate[some] += 4 * s.run[tok[agree]]
    return x, gate


@dataclass
class Model:
    code: Code
    odds: np.ndarray  # TABLES x slots, float32
    sure: np.ndarray  # TABLES x slots, 0 to 3
    weights: np.ndarray
    map: np.ndarray
    hit: np.ndarray  # probability that a match tells a rare word, by class of its length

    def rare_share(self, c: np.ndarray) -> np.ndarray:
        return (c + 1) / (self.rare_total + self.rare_kinds + 1)

    @property
    def rare_total(self) -> int:
        return self.code.total - int(self.code.counts[:-1].sum())

    @property
    def rare_kinds(self) -> int:
        return self.code.kinds - len(self.code.hashes)


def _sure(n: np.ndarray) -> np.ndarray:
    return ((n > 0).astype(np.uint8) + (n > 3) + (n > 30)).astype(np.uint8)


def _strengths(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log((n1 + SOFT) / (n0 + SOFT)).astype(np.float32), _sure(n0 + n1)


def _refine(z: np.ndarray, depth: np.ndarray, apm: np.ndarray) -> np.ndarray:
    """Probability of a 1: the mean of the mixer's and the map's, read between its bins."""
    return _read_map(z, np.minimum(depth, DEPTHS - 1) * MAP_BINS, apm.ravel())


def _read_map(z: np.ndarray, place: np.ndarray, flat: np.ndarray) -> np.ndarray:
    z = np.clip(z, -7.99, 7.99)
    at = (z + 8) * ((MAP_BINS - 1) / 16)
    low = np.floor(at)
    row = place + low.astype(np.int64)
    below = _get(flat, row)
    return 0.5 / (1 + np.exp(-z)) + 0.5 * (below + (_get(flat, row + 1) - below) * (at - low))


def score_texts(texts: list[bytes], model: Model) -> tuple[np.ndarray, Stream, np.ndarray]:
    """Natural log probability of all symbols of each text, its tokens, and which rare words a match tells."""
    code = model.code
    total = np.zeros(len(texts))
    s = read(texts, code)
    rare = len(code.counts) - 1
    guess = np.where((s.match >= 0) & (s.symbol == rare), s.match, -1)
    asked = (guess >= 0) & (s.symbol[guess] == rare)
    told = asked & (s.hash[guess] == s.hash)
    p = model.hit[s.run]
    total += np.bincount(s.doc, np.where(told, np.log(p), np.where(asked, np.log1p(-p), 0)), len(texts))
    begin = np.r_[0, np.cumsum(code.length[s.symbol])]
    count, lo, hi = _steps(np.cumsum(np.bincount(s.doc, minlength=len(texts))), begin)
    if len(lo):
        step, lane, alive = _lanes(count)
        text, fresh = np.repeat(np.arange(len(texts)), count)[step], _ranges(count)[step] == 0
        lo, hi, ends = lo[step], hi[step], np.cumsum(alive)
        own = Own(model, int(alive[0]))
        a = r = 0
        while r < len(alive):  # rounds of a step of each lane; the inputs of some rounds are made together
            q = max(r + 1, int(np.searchsorted(ends, a + NEAR_BITS // STEP, "right")))
            b = int(ends[q - 1])
            n = hi[a:b] - lo[a:b]
            e = cut(s, code, begin, lo[a:b], hi[a:b])
            x, gate = inputs(s, code, e, model.odds, model.sure[2], e.slot)
            total += np.bincount(np.repeat(text[a:b], n), own.code(lane[a:b], fresh[a:b], n, alive[r:q], x, gate, e), len(texts))
            a, r = b, q
    return total, s, told


def _steps(ends: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of steps of each text, and the first bit and the end of each step: ``STEP`` bits, fewer where a text or ``TOKENS`` of its tokens end."""
    start = np.r_[0, ends[:-1]]
    pieces = -(-(ends - start) // TOKENS)
    text = np.repeat(np.arange(len(ends)), pieces)
    first = start[text] + TOKENS * _ranges(pieces)
    lo, hi = begin[first], begin[np.minimum(first + TOKENS, ends[text])]
    n = -(-(hi - lo) // STEP)
    at = np.repeat(lo, n) + STEP * _ranges(n)
    return np.bincount(np.repeat(text, n), minlength=len(ends)), at, np.minimum(at + STEP, np.repeat(hi, n))


def _lanes(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal texts of ``count`` steps to lanes, the longest first: the steps in the order of rounds, each one's lane, and lanes in each round."""
    lanes = min(LANES, -(-int(count.sum()) // int(count.max())))
    heap = [(0, i) for i in range(lanes)]
    start, lane = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    for t in np.argsort(-count, kind="stable")[: np.count_nonzero(count)].tolist():
        start[t], lane[t] = load, i = heap[0]
        heapq.heapreplace(heap, (load + int(count[t]), i))
    name = np.zeros(lanes, np.int64)
    name[[i for _, i in sorted(heap, reverse=True)]] = np.arange(lanes)  # lanes that go on are the first ones
    when, where = np.repeat(start, count) + _ranges(count), np.repeat(name[lane], count)
    order = np.lexsort((where, when))
    return order, where[order], np.bincount(when)


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``NEAR_TOKENS`` tokens together; a longer text is alone."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + NEAR_TOKENS, side="right")))
        yield a, b
        a = b


class Own:
    """Weights and map of the text that each lane is at: the fitted ones, refined along the text. What a text's mates are does not matter."""

    def __init__(self, model: Model, lanes: int):
        self.model = model
        self.w = np.tile(model.weights, lanes)
        self.fit = np.tile(model.map.ravel(), lanes)
        self.map = self.fit.copy()
        self.n, self.ones = (np.zeros(len(self.map), np.float32) for _ in range(2))

    def code(self, lane: np.ndarray, fresh: np.ndarray, n: np.ndarray, alive: np.ndarray, x: np.ndarray, gate: np.ndarray, e: Bits) -> np.ndarray:
        """Log probability of every bit of some rounds; each has a step of ``n`` bits of each of its ``alive`` first lanes, ``fresh`` where a text begins."""
        at = np.repeat(lane, n)
        cell, place = at * GATES + gate, (at * DEPTHS + np.minimum(e.depth, DEPTHS - 1)) * MAP_BINS
        y, p = e.bit.astype(np.float32), np.empty(len(at), np.float32)
        i, ends = 0, np.r_[0, np.cumsum(n)]
        for now in alive.tolist():
            self.begin(lane[i : i + now][fresh[i : i + now]])
            part = slice(int(ends[i]), int(ends[i + now]))
            z = np.zeros(part.stop - part.start, np.float32)
            for k in range(INPUTS):
                z += _get(self.w[k], cell[part]) * x[k, part]
            p[part] = np.abs(_read_map(z, place[part], self.map) - (1 - y[part]))
            self.update(z, cell[part], place[part], x[:, part], y[part], now)
            i += now
        return np.log(p)

    def begin(self, lanes: np.ndarray) -> None:
        if len(lanes):
            self.w.reshape(INPUTS, -1, GATES)[:, lanes] = self.model.weights[:, None]
            for own, first in ((self.map, self.model.map.ravel()), (self.n, 0), (self.ones, 0)):
                own.reshape(-1, DEPTHS * MAP_BINS)[lanes] = first

    def update(self, z: np.ndarray, cell: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, now: int) -> None:
        cells, places = now * GATES, now * DEPTHS * MAP_BINS
        error = y - 1 / (1 + np.exp(-np.clip(z, -20, 20)))
        per = MIX_RATE / np.maximum(np.bincount(cell, minlength=cells), 1) ** 0.5
        for i in range(INPUTS):
            self.w[i, :cells] += np.bincount(cell, error * x[i], cells) * per
        row = place + _bin(z)
        self.n[:places] += np.bincount(row, minlength=places)
        self.ones[:places] += np.bincount(row, y, places)
        self.map[:places] = (MAP_SURE * self.fit[:places] + self.ones[:places]) / (MAP_SURE + self.n[:places])


def _bin(z: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(z, -8, 8) + 8) * ((MAP_BINS - 1) / 16)).astype(np.int64)


class Fit:
    """Sums over whole texts at the weights ``start``: slope and curvature of each gate's log probability, map and match hits.

    A text's sums depend on itself and the counts alone, so neither its task nor its mates matter.
    """

    def __init__(self, code: Code, n0: np.ndarray, n1: np.ndarray, start: np.ndarray):
        self.coding, self.w = code, start
        self.left = np.stack([n0, n1], axis=-1).astype(np.float32)  # without the bits of the text at hand
        self.pairs = [t.reshape(-1).view(np.int64) for t in self.left]
        self.small = np.zeros(len(n0[0]), np.uint32)  # goes round at 2^32: only differences are read
        self.slope, self.curve = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
        self.seen, self.hits, self.tries = np.zeros(GATES), np.zeros(4), np.zeros(4)
        self.map_n, self.map_1 = np.zeros(DEPTHS * MAP_BINS), np.zeros(DEPTHS * MAP_BINS)

    def add(self, texts: list[bytes]) -> None:
        code = self.coding
        s = read(texts, code)
        rare = len(code.counts) - 1
        guess = np.where((s.match >= 0) & (s.symbol == rare), s.match, -1)
        asked = (guess >= 0) & (s.symbol[guess] == rare)
        self.tries += np.bincount(s.run[asked], minlength=4)
        self.hits += np.bincount(s.run[asked & (s.hash[guess] == s.hash)], minlength=4)
        ends = np.cumsum(np.bincount(s.doc, minlength=len(texts)))
        begin = np.r_[0, np.cumsum(code.length[s.symbol])]
        for a, b in _groups(ends):
            cuts = begin[np.r_[ends[a - 1] if a else 0, ends[a:b]]]
            if np.diff(cuts).max() <= SMALL:
                e = bits(s, code, int(ends[a - 1]) if a else 0, int(ends[b - 1]))
                if len(e.tok):
                    self.steps(s, e, self.others(e, (cuts - cuts[0]).tolist()))
                continue
            for i in range(a, b):
                self.add_long(s, int(ends[i - 1]) if i else 0, int(ends[i]))

    def add_long(self, s: Stream, lo: int, hi: int) -> None:
        """One text of any length."""
        kept = [bits(s, self.coding, lo, hi)] if hi - lo <= TOKENS else None

        def each() -> Iterable[Bits]:
            return kept or (bits(s, self.coding, at, min(at + TOKENS, hi)) for at in range(lo, hi, TOKENS))

        for e in each():
            self.move(e, np.float32(-1))
        for e in each():
            if len(e.tok):
                self.steps(s, e, [np.maximum(self.counts(k, e.slot[k]), 0) for k in range(TABLES)])
        for e in each():
            self.move(e, np.float32(1))

    def move(self, e: Bits, by: np.float32) -> None:
        for k in range(TABLES):
            np.add.at(self.left[k].reshape(-1), 2 * e.slot[k] + e.bit, by)

    def counts(self, k: int, slot: np.ndarray) -> np.ndarray:
        return _get(self.pairs[k], slot).view(np.float32).reshape(-1, 2)

    def others(self, e: Bits, cuts: list[int]) -> list[np.ndarray]:
        """Counts at every bit's slots less those of its own text, whose bits lie between two ``cuts``, at most ``SMALL`` of them."""
        one, out, before, after = _small(e.bit), [], *np.empty((2, len(e.bit)), np.uint32)
        for slot in e.slot:
            for lo, hi in zip(cuts, cuts[1:]):
                at = slot[lo:hi]
                np.take(self.small, at, out=before[lo:hi], mode="clip")
                np.add.at(self.small, at, one[lo:hi])
                np.take(self.small, at, out=after[lo:hi], mode="clip")
            n = self.counts(len(out), slot)
            n -= (after - before).view(np.uint16).reshape(-1, 2)
            out.append(np.maximum(n, 0, out=n))
        return out

    def steps(self, s: Stream, e: Bits, counts: list[np.ndarray]) -> None:
        odds = []
        for k in range(TABLES):
            n = counts[k] + np.float32(SOFT)
            odds.append(np.log(n[:, 1] / n[:, 0]))
        sure = _sure(counts[2][:, 0] + counts[2][:, 1])
        x, gate = inputs(s, self.coding, e, odds, sure, None)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        bit, ends = _get(e.bit, order), np.cumsum(np.bincount(gate, minlength=GATES))
        sort = np.empty(x.shape)  # in double precision, so that it doesn't matter which texts are added together
        for i in range(INPUTS):
            sort[i] = _get(x[i], order)
        z = np.empty(len(order), np.float32)
        for g, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
            if lo < hi:
                xs = sort[:, lo:hi]
                z[lo:hi] = zs = (self.w[:, g].astype(float) @ xs).astype(np.float32)
                p = 1 / (1 + np.exp(-np.clip(zs, -20, 20)))
                self.slope[g] += xs @ (bit[lo:hi] - p).astype(float)
                self.curve[g] += (xs * (p * (1 - p))) @ xs.T
        self.seen += np.diff(np.r_[0, ends])
        row = np.minimum(_get(e.depth, order), DEPTHS - 1) * MAP_BINS + _bin(z)
        self.map_n += np.bincount(row, minlength=len(self.map_n))
        self.map_1 += np.bincount(row, bit, len(self.map_1))

    def sums(self) -> np.ndarray:
        """All that tasks add up, in one row."""
        return np.r_[self.slope.ravel(), self.curve.ravel(), self.seen, self.hits, self.tries, self.map_n, self.map_1]


SUMS = np.cumsum([GATES * INPUTS, GATES * INPUTS * INPUTS, GATES, 4, 4, DEPTHS * MAP_BINS, DEPTHS * MAP_BINS])


def _first_weights() -> np.ndarray:
    w = np.zeros((INPUTS, GATES), np.float32)
    w[0], w[1:5], w[5] = 0.2, 0.25, 2.0
    return w


def _next_weights(sums: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One Newton step of every gate; ``PULL`` bits hold a weight where it is, so that a gate with few bits hardly moves."""
    slope, curve = sums[: SUMS[0]].reshape(GATES, INPUTS), sums[SUMS[0] : SUMS[1]].reshape(GATES, INPUTS, INPUTS)
    step = np.linalg.solve(curve + PULL * np.eye(INPUTS), slope[..., None])[..., 0]
    return (start + np.clip(step, -1, 1).T).astype(np.float32)


def _model(code: Code, n0: np.ndarray, n1: np.ndarray, w: np.ndarray, sums: np.ndarray) -> Model:
    hits, tries, map_n, map_1 = np.split(sums, SUMS[:-1])[3:]
    centre = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, MAP_BINS))), DEPTHS)
    apm = np.clip((map_1 + 20 * centre) / (map_n + 20), 1e-4, 1 - 1e-4).reshape(DEPTHS, MAP_BINS)
    odds, sure = zip(*(_strengths(n0[k], n1[k]) for k in range(TABLES)), strict=True)
    return Model(code, np.stack(odds), np.stack(sure), w, apm.astype(np.float32), np.clip((hits + 0.5) / (tries + 1), 1e-3, 0.999))


def fit_mixer(texts: list[bytes], code: Code, n0: np.ndarray, n1: np.ndarray) -> Model:
    """The model of texts at hand."""
    w = _first_weights()
    for _ in range(MIX_ROUNDS):
        fit = Fit(code, n0, n1, w)
        fit.add(texts)
        w = _next_weights(fit.sums(), w)
    return _model(code, n0, n1, w, fit.sums())


def fit_mixers(docs: DataFrame, code: Code, n0: np.ndarray, n1: np.ndarray) -> Model:
    """The model of all rows: tasks add up their texts' sums, as decimals, so neither their number nor their order matters."""
    sent = docs.sparkSession.sparkContext.broadcast((code, n0, n1))
    w, size = _first_weights(), int(SUMS[-1])
    sums = np.zeros(size)
    for _ in range(MIX_ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            fit = Fit(*sent.value, start)
            for batch in batches:
                texts = texts_of(batch.column("text"))
                for a, b in blocks(texts, 1 << 20):
                    fit.add(texts[a:b])
            if fit.seen.any():
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "v": fit.sums()})

        sums = np.zeros(size)
        for r in map_stream(docs.select("text"), run, "i int, v double").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,6)")).cast("double").alias("v")).collect():
            sums[r.i] = r.v
        w = _next_weights(sums, w)
    sent.destroy()
    return _model(code, n0, n1, w, sums)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, c): training count of every distinct token (its hash), the end of a text being one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            parts = [np.full(len(texts), END, np.uint64)]
            parts += [word_hashes([x.lower() for x in texts[lo:hi]])[0] for lo, hi in blocks(texts)]
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.astype(np.int64)})

    return map_stream(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head_words(vocabulary: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The words of the highest count classes, at most ``most``; N and V."""
    level = F.floor(F.log2("c") * 32).cast("int")
    rows = sorted(vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True)  # 32 a doubling
    n, least = 0, None
    for r in rows:
        if n + r.n > most:
            break
        n, least = n + r.n, r.level
    total, kinds = sum(r.c for r in rows), sum(r.n for r in rows)
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), total, kinds
    got = vocabulary.where(level >= least).toArrow()
    return got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy(), total, kinds


def _small(bit: np.ndarray) -> np.ndarray:
    """What each bit adds to a small counter: its low half counts zeros, its high half ones."""
    return bit * np.uint32(SMALL) + np.uint32(1)


def count_bits(texts: list[bytes], code: Code, seen: np.ndarray, small: np.ndarray) -> None:
    """Add every bit of the texts to its slot in every table, by way of the small counters, which are zero before and after."""
    s = read(texts, code, matches=False)

    def each() -> Iterable[Bits]:
        return (bits(s, code, lo, min(lo + NEAR_TOKENS, len(s.hash))) for lo in range(0, len(s.hash), NEAR_TOKENS))

    for e in each():
        one = _small(e.bit)
        for k in range(TABLES):
            np.add.at(small[k], e.slot[k], one)
    halves, n = small.view(np.uint16), int(code.length[s.symbol].sum())
    whole = [int(h.sum(dtype=np.int64)) == n for h in halves]  # a half that ran over took 65535 or more from the sum
    for k in np.flatnonzero(whole):
        seen[k] += halves[k]
    small[:] = 0
    if not all(whole):
        for e in each():
            for k in np.flatnonzero(~np.array(whole)):
                np.add.at(seen[k], 2 * e.slot[k] + e.bit, np.int32(1))


def count_contexts(docs: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen in every slot of every table; each task shuffles its sums once, in short rows."""
    sent = docs.sparkSession.sparkContext.broadcast(code)
    size = 1 << TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen, small = sent.value, np.zeros((TABLES, 2 * size), np.int32), np.zeros((TABLES, size), np.uint32)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in blocks(texts, 1 << 20):
                count_bits(texts[a:b], code, seen, small)
        rows = seen.reshape(-1, 2 * CHUNK)
        full = np.flatnonzero(rows.any(axis=1))
        for lo in range(0, len(full), 512):
            part = full[lo : lo + 512]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "seen": [rows[i].tobytes() for i in part]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                if part != own:
                    if own is not None:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([own], pa.int32()), "seen": [total.astype(np.float32).tobytes()]})
                    own, total = part, np.zeros(2 * CHUNK, np.int64)
                total += np.frombuffer(raw, np.int32)
        if own is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([own], pa.int32()), "seen": [total.astype(np.float32).tobytes()]})

    rows = map_stream(docs.select("text"), run, "part int, seen binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((TABLES * 2 * size // (2 * CHUNK), 2 * CHUNK), np.float32)
    for batch in map_stream(rows, add, "part int, seen binary").toArrow().to_batches():  # the tables' fixed size
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            out[part] = np.frombuffer(raw, np.float32)
    sent.destroy()
    both = out.reshape(TABLES, size, 2)
    return np.ascontiguousarray(both[..., 0]), np.ascontiguousarray(both[..., 1])


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training rows of (doc_id, text), and the counts of all their tokens."""
    taught = docs.where(in_training())
    vocabulary = checkpointed(count_tokens(taught))
    code = build_code(*head_words(vocabulary))
    n0, n1 = count_contexts(taught, code)
    return fit_mixers(taught, code, n0, n1), vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    A null or empty text is the end token alone. Repeated rows are scored alike, each in its own row; a row
    without doc_id is neither held out nor learned from. With nothing learned every score is 0. Rare words are looked up by
    one join on their hash; frequent ones, which alone could be hot keys, are in the model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    code = model.code
    share = math.log10(code.total + code.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        code, rare = model.code, len(model.code.counts) - 1
        known = np.log10(code.counts + 1) - share
        for batch in batches:
            texts, rid = texts_of(batch.column("text")), batch.column("rid").to_numpy()
            for lo, hi in blocks(texts, 1 << 20):
                total, s, told = score_texts(texts[lo:hi], model)
                n = hi - lo
                tokens = np.bincount(s.doc, minlength=n)
                frequent = s.symbol < rare
                base = np.bincount(s.doc[frequent], known[s.symbol[frequent]], n)
                n_head = np.bincount(s.doc[frequent], minlength=n)
                doc, h, paid = s.doc[~frequent], s.hash[~frequent], ~told[~frequent]
                order = np.lexsort((h, doc))
                doc, h, paid = doc[order], h[order], paid[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, int)
                tf = np.diff(np.r_[first, len(doc)])
                pay = np.add.reduceat(paid.astype(np.int64), first) if len(doc) else tf
                m = len(first)
                zero, one = np.zeros(m), np.zeros(n, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "rid": np.r_[rid[lo:hi], rid[lo:hi][doc[first]]],
                    "h": np.r_[mix64(rid[lo:hi].astype(np.uint64)), h[first]].view(np.int64),
                    "tf": np.r_[one, tf], "pay": np.r_[one, pay],
                    "n_tokens": np.r_[tokens, np.zeros(m, np.int64)], "n_head": np.r_[n_head, np.zeros(m, np.int64)],
                    "bytes": np.r_[np.array([len(x) for x in texts[lo:hi]], np.int64), np.zeros(m, np.int64)],
                    "base": np.r_[base, zero], "ln": np.r_[total, zero],
                })

    marked = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    rows = map_stream(marked.select("rid", "text"), run, "rid long, h long, tf long, pay long, n_tokens long, n_head long, bytes long, base double, ln double")
    c = F.coalesce("c", F.lit(0))
    per = rows.join(vocabulary, "h", "left").groupBy("rid").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_head") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.col("tf") * (F.log10(c + 1) - F.lit(share)))).alias("base_score"),
        (F.sum("ln") / F.lit(LN10) + F.sum(F.col("pay") * (F.log10(c + 1) - F.lit(math.log10(model.rare_total + model.rare_kinds + 1))))).alias("score"),
        F.sum("bytes").alias("bytes"),
    )
    out = marked.select("rid", "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out")).join(per, "rid")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(code.total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * math.log2(10) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))


def op3_ctxmix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *learn(docs))
