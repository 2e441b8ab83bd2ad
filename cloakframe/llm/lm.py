"""LM scoring: a hierarchical Pitman-Yor model.

The model reads a text as its words (A-Z lower-cased) and one end.  Each word
before is a context, and each context a restaurant whose customers are the
words that follow it; its tables are customers of the restaurant of the empty
context, which all share as parent, and whose own tables rest on a spelling
model: again a hierarchical Pitman-Yor model, of the bytes of a word given
two, one and no bytes before.  So every text has a probability, whatever its words.

Seating is sampled by Gibbs.  All c customers of a kind (restaurant and word)
leave and sit down again at once: given all others, t tables have a chance in
proportion to S(c, t) times the product of the t weights of a new table, where
S are generalised Stirling numbers, the sums over all seatings of c customers
at t tables by the Chinese-restaurant process.  That draws the exact
conditional of all seats of a kind with work that does not depend on c, so a
sweep moves every customer.  Kinds of a level are drawn given the tables before the sweep.  S comes from a
table up to TOP customers, and beyond from the law S(c, t + 1) / S(c, t) =
f(t / c**d) / t that it tends to.  Uniforms are hashes of kind and sweep, so
samples do not depend on blocks, buckets or partitions.

All training text is used.  Documents are dealt to blocks; a block sends each
distinct pair of words and each distinct word once, with its count, to a
bucket chosen by the first word's hash.  Buckets keep what they merged, and of
each block's list only the places in it.  Contexts of very frequent words (HOT
and more occurrences) are spread over all buckets by the second word; their
numbers of tables are added up over the buckets after each run.  Buckets of
contexts and of words exchange customers and probabilities; nothing is sent to
the driver but sums, frequent words (at most 4,096) and the spelling model (at most
256**3 counts), and only these are broadcast.

A pair is known by 30 bits of the hash of its first word and 34 of the
second's: contexts that share theirs are one restaurant, which leaves the
model proper.

The word counts for the base score travel with the words.

Defined cases: a null or empty text is the end alone; without training text
every byte of a word and the end of it has probability 1/256 and the base is 0
per token; repeated rows are scored and counted as rows of their own; null ids
are as the empty text for the choice of held-out documents; ids keep their
type; white space within a text only parts words; no rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit
from cloakframe.llm.suffix import _by_bucket, _delta, _rows, _undelta

U = np.uint64
PAIR, WORD = (0.75, 1.0), (0.5, 1.0)  # discount, strength
SPELL = ((0.2, 1.0), (0.3, 1.0), (0.5, 1.0))  # of contexts of no, one and two bytes
BURN, SAMPLES = 4, 4
HOT = 1 << 20
TOP = 1024
LOOKUP = 1 << 13  # rows of 2 KB
SPACE = 0x20
END_WORD = kit.mix(np.array([0x0A], U))[0]
NONE = np.zeros(0, U)


def uniform(key: np.ndarray, draw) -> np.ndarray:
    """A number in (0, 1) for each key and draw."""
    with np.errstate(over="ignore"):
        x = kit.mix(key * U(0x9E3779B97F4A7C15) + np.asarray(draw, U) * U(0xC2B2AE3D27D4EB4F))
    return ((x >> U(11)).astype(float) + 0.5) / (1 << 53)


@lru_cache(maxsize=8)
def stirling(d: float) -> np.ndarray:
    """log of S(c, t + 1) / S(c, t) for c and t up to TOP; S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    t, row, out = np.arange(TOP + 2), np.full(TOP + 2, -np.inf), np.full((TOP + 1, TOP + 1), -np.inf)
    row[1] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, TOP + 1):
            if c > 1:
                stay = np.where(t < c, np.log(np.maximum(c - 1 - d * t, 1e-300)) + row, -np.inf)
                row = np.logaddexp(np.append(-np.inf, row[:-1]), stay)
            out[c] = np.where(np.arange(TOP + 1) < c, row[1:] - row[:-1], -np.inf)
    return out


def step(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of S(c, t + 1) / S(c, t); -inf where t is not below c."""
    table = stirling(d)
    if np.ndim(t):
        c, t = np.broadcast_arrays(c, t)
        out = table[np.minimum(c, TOP), np.minimum(t, TOP)]
    else:
        out = table[:, min(t, TOP)].take(c, mode="clip")
    large = c > TOP
    if large.any():
        t = np.broadcast_to(t, c.shape)
        c, t = c[large], t[large]
        x = t * (TOP / c) ** d
        low = np.clip(x.astype(np.int64), 1, TOP - 2)
        part = np.clip(x - low, 0.0, 1.0)
        law = (table[TOP, low] + np.log(low)) * (1 - part) + (table[TOP, low + 1] + np.log(low + 1)) * part
        out[large] = np.where(t < c, law - np.log(t), -np.inf)
    return out


def seat(c: np.ndarray, t: np.ndarray, total: np.ndarray, below: np.ndarray, d: float, theta: float, key: np.ndarray, sweep: int, parent=None) -> np.ndarray:
    """New numbers of tables of all kinds: c customers, now at t tables of the restaurant's total; below: chance of the kind's parent.

    parent: strength and customers of the parent's restaurant, where a kind's tables are customers: they leave with it, and each that comes makes the next one likelier.

    The number with the greatest log weight plus Gumbel noise is a draw from the weights; each is looked at until they have fallen by 30 from their peak.
    """
    out = np.minimum(c, 1)
    live = np.flatnonzero(c > 1)
    t, parent = t[live], None if parent is None else np.broadcast_to(parent, len(out))[live]
    c, key, below, rest = c[live], key[live], below[live], theta + d * (total[live] - t)
    if parent is not None:
        below, parent = below * parent - t, parent - t
    weight = np.zeros(len(live))
    peak, best, n = weight.copy(), -np.log(-np.log(uniform(key, sweep << 32 | 1))), 1
    while len(live):
        # Few kinds that go on for long are looked at many numbers at once; many, at one, without a second axis.
        width = min(512, 2048 // len(live))
        if width < 2:
            with np.errstate(invalid="ignore"):
                chance_ = below if parent is None else np.maximum(below + n, 1e-6) / (parent + n)
                weight = weight + (np.log(np.maximum((rest + d * n) * chance_, 1e-300)) + step(c, n, d))
                found = weight - np.log(-np.log(uniform(key, (n + 1) | sweep << 32)))
            out[live[found > best]] = n + 1
            best, peak, n = np.maximum(best, found), np.maximum(peak, weight), n + 1
        else:
            ts = np.arange(n, n + width)
            with np.errstate(invalid="ignore"):
                chance_ = below[:, None] if parent is None else np.maximum(below[:, None] + ts, 1e-6) / (parent[:, None] + ts)
                some = np.log(np.maximum((rest[:, None] + d * ts) * chance_, 1e-300)) + step(c[:, None], ts, d)
                some = weight[:, None] + np.cumsum(some, axis=1)
                found = some - np.log(-np.log(uniform(key[:, None], (ts + 1) | sweep << 32)))
            top = np.argmax(found, axis=1)
            row = np.arange(len(live))
            better = found[row, top] > best
            out[live[better]] = ts[top[better]] + 1
            best, peak, weight = np.maximum(best, found[row, top]), np.maximum(peak, some.max(axis=1)), some[:, -1]
            n = int(ts[-1]) + 1
        go = np.flatnonzero((weight > peak - 30) & (c > n))
        if len(go) < len(live):
            live, c, key, below, rest, weight, peak, best = (v[go] for v in (live, c, key, below, rest, weight, peak, best))
            parent = None if parent is None else parent[go]
    return out


def chance(c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, below: np.ndarray, d: float, theta: float) -> np.ndarray:
    """Predictive probability of a kind."""
    return (c - d * t + (theta + d * tables) * below) / (theta + customers)


class Spelling:
    """log probability of words, from how often two bytes and a third follow one another in the distinct words of the training texts.

    The bytes before a word and after it are spaces.  kinds: (two bytes, byte), sorted; n: their counts.
    """

    def __init__(self, kinds: np.ndarray, n: np.ndarray, seed: int):
        low = np.arange(1 << 16, dtype=np.int64)
        near, c2 = (kinds & 0xFFFF).astype(np.int64), n.astype(np.int64)
        rest, t2, t1 = (kinds >> 8).astype(np.int64), np.minimum(n, 1).astype(np.int64), None
        self.kinds, self.own, self.back, self.low, self.row = kinds, np.zeros(len(kinds)), np.zeros(1 << 16), np.zeros(1 << 16), None
        for sweep in range(BURN + SAMPLES):
            c1 = np.bincount(near, t2, 1 << 16).astype(np.int64)
            t1 = np.minimum(c1, 1) if t1 is None else t1
            c0 = np.bincount(low & 255, t1, 256).astype(np.int64)
            t0 = np.minimum(c0, 1) if sweep == 0 else seat(c0, t0, np.full(256, t0.sum()), np.full(256, 1 / 256), *SPELL[0], low[:256].astype(U), 3 * (seed + sweep))
            p0 = chance(c0, t0, c0.sum(), t0.sum(), 1 / 256, *SPELL[0])
            tables1 = np.bincount(low >> 8, t1, 256)[low >> 8]
            t1 = seat(c1, np.minimum(t1, c1), tables1, p0[low & 255], *SPELL[1], low.astype(U) + U(1 << 20), 3 * (seed + sweep) + 1, SPELL[0][1] + c0.sum())
            p1 = chance(c1, t1, np.bincount(low >> 8, c1, 256)[low >> 8], np.bincount(low >> 8, t1, 256)[low >> 8], p0[low & 255], *SPELL[1])
            parents = SPELL[1][1] + np.bincount(low >> 8, c1, 256)[near >> 8]
            t2 = seat(c2, t2, np.bincount(rest, t2, 1 << 16)[rest], p1[near], *SPELL[2], kinds.astype(U) + U(1 << 30), 3 * (seed + sweep) + 2, parents)
            if sweep >= BURN:
                d, theta = SPELL[2]
                customers = theta + np.bincount(rest, c2, 1 << 16)
                self.own += (c2 - d * t2) / customers[rest] / SAMPLES
                self.back += (theta + d * np.bincount(rest, t2, 1 << 16)) / customers / SAMPLES
                self.low += p1 / SAMPLES

    def log10(self, kinds: np.ndarray) -> np.ndarray:
        """Looked up by the two bytes, where a row for each two that are known (LOOKUP at most) is small, else searched."""
        if self.row is None:
            pairs = np.unique(self.kinds >> 8).astype(np.int64)
            pairs = pairs[: len(pairs) * (len(pairs) <= LOOKUP)]
            self.row = np.full(1 << 16, -1, np.int32)
            self.row[pairs] = np.arange(len(pairs))
            self.table = self.searched((pairs[:, None] << 8 | np.arange(256)).ravel())
        row = self.row[kinds >> 8]
        known = row >= 0
        if known.all() and len(self.table):
            return self.table[row.astype(np.int64) << 8 | kinds & 255]
        out = np.empty(len(kinds))
        out[known] = self.table[row[known].astype(np.int64) << 8 | kinds[known] & 255]
        out[~known] = self.searched(kinds[~known])
        return out

    def searched(self, kinds: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.kinds, kinds), max(0, len(self.kinds) - 1))
        own = np.where(self.kinds[at] == kinds, self.own[at], 0.0) if len(self.kinds) else np.zeros(len(kinds))
        return np.log10(own + self.back[kinds >> 8] * self.low[kinds & 0xFFFF])


def letters(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds (two bytes before, byte) of all bytes of words and the space that ends each, and the words' bounds."""
    ends = np.cumsum(sizes + 3)
    text = np.full(int(ends[-1]) if len(sizes) else 0, SPACE, np.int64)
    inner = np.repeat(ends - sizes - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
    text[inner] = data
    own = np.ones(len(text), bool)
    own[ends - sizes - 3] = own[ends - sizes - 2] = False
    at = np.flatnonzero(own)
    return text[at - 2] << 16 | text[at - 1] << 8 | text[at], np.concatenate([[0], np.cumsum(sizes + 1)])


# ---- texts


class Tokens:
    """Of a block's texts: the distinct words (w), plain pairs (m) and hot ones (hm), sorted, with the place of each token's (wi, mi, hi); plain, hot: the tokens of these pairs."""

    def __init__(self, docs: pa.Table, hot: np.ndarray):
        self.t = t = kit.Texts(docs.column("__text")).words()
        self.low = kit.lower_ascii(t.buf)
        h = t.hashes(self.low)
        self.bounds = t.first + np.arange(t.n + 1)
        self.inner = np.ones(int(self.bounds[-1]), bool)
        self.inner[self.bounds[1:] - 1] = False
        tokens = np.full(len(self.inner), END_WORD, U)
        tokens[self.inner] = h
        self.w, self.wi = w, wi = kit.distinct(tokens)
        before = np.append(0, wi[:-1])[: len(wi)]
        before[self.bounds[:-1]] = np.searchsorted(w, END_WORD)
        at = np.minimum(np.searchsorted(hot, w), max(0, len(hot) - 1))
        hot_word = hot[at] == w if len(hot) else np.zeros(len(w), bool)
        hot_pair = hot_word[before]
        self.plain, self.hot = np.flatnonzero(~hot_pair), np.flatnonzero(hot_pair)
        self.hot_at = at[before[self.hot]]
        # What a pair is known by is ranked among the words, and ranks are sorted, whose numbers are small.
        (first, i), (second, j) = _ranked(w >> U(34)), _ranked(w >> U(30))
        k = max(1, len(second))
        m, self.mi = kit.distinct((i * k)[before[self.plain]].astype(U) + j[wi[self.plain]].astype(U))
        self.m = first[(m // U(k)).astype(np.int64)] << U(34) | second[(m % U(k)).astype(np.int64)]
        k = max(1, len(hot))
        m, self.hi = kit.distinct((j * k)[wi[self.hot]].astype(U) + self.hot_at.astype(U))
        self.hm = second[(m // U(k)).astype(np.int64)] << U(30) | m % U(k)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted values, and the place of each value among them."""
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    return x[new], np.cumsum(new) - 1


ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("m", "n", "hm", "hn", "w", "c", "sizes", "data"))])
ASK_DDL = "bucket long, block long, m binary, n binary, hm binary, hn binary, w binary, c binary, sizes binary, data binary"
_z = kit.squeeze


def _slices(lists: list, buckets: int):
    """(bucket, slices of the three lists)."""
    cut = [dict(_by_bucket(x, buckets)) for x in lists]
    for b in sorted({k for c in cut for k in c}):
        yield b, [c.get(b, slice(0, 0)) for c in cut]


def _ask(docs: pa.Table, hot: np.ndarray, buckets: int) -> pa.Table:
    x, block = Tokens(docs, hot), docs.column("__block")[0].as_py()
    train = np.repeat(~docs.column("__held").to_numpy(), np.diff(x.bounds))
    m, hm, w, wi = x.m, x.hm, x.w, x.wi
    n, hn, c = (np.bincount(i, k, len(v)).astype(np.uint32) for v, i, k in ((m, x.mi, train[x.plain]), (hm, x.hi, train[x.hot]), (w, wi, train)))
    # Where each distinct word is first spelt.
    first, order = np.full(len(w), -1), np.flatnonzero(x.inner)
    first[wi[order][::-1]] = np.arange(len(order))[::-1]
    lo = np.where(first < 0, 0, x.t.ws[np.maximum(first, 0)] if len(order) else 0)
    sizes = np.where(first < 0, 0, (x.t.we[np.maximum(first, 0)] if len(order) else 0) - lo)
    rows, ends = [], np.concatenate([[0], np.cumsum(sizes)])
    data = x.low[np.repeat(lo - ends[:-1], sizes) + np.arange(ends[-1])]
    sizes = sizes.astype(np.uint32)
    for b, (p, h, q) in _slices([m, hm, w], buckets):
        rows.append((b, block, _delta(m[p]), _z(n[p]), _delta(hm[h]), _z(hn[h]), _delta(w[q]), _z(c[q]), _z(sizes[q]), _z(data[ends[q.start] : ends[q.stop]], 3)))
    return _rows(rows, ASK)


# ---- buckets

TYPES = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("m", "n", "hm", "hn", "w", "c", "sizes", "data")), ("blocks", pa.list_(pa.int64())), *((c, pa.list_(pa.binary())) for c in ("pm", "ph", "pw")), *((c, pa.int64()) for c in ("tokens", "known", "kinds")), ("frequent", pa.list_(pa.int64()))])
TYPES_DDL = "bucket long, m binary, n binary, hm binary, hn binary, w binary, c binary, sizes binary, data binary, blocks array<long>, pm array<binary>, ph array<binary>, pw array<binary>, tokens long, known long, kinds long, frequent array<long>"


def _sum(parts: list, counts: list) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Distinct values, their summed counts, of each part its places among them, packed, and all places."""
    values, back = kit.distinct(np.concatenate(parts))
    edges = np.cumsum([0, *map(len, parts)])
    places = [_z(np.diff(back[a:b], prepend=0).astype(np.uint32)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return values, np.bincount(back, np.concatenate(counts), len(values)).astype(np.int64), places, back


def _merge(asked: pa.Table) -> pa.Table:
    """What all blocks sent to a bucket; frequent: (place in the list of frequent words, distinct second words, occurrences), flat."""
    get = lambda c, f: [f(x.as_py()) for x in asked[c]]
    counts = lambda b: kit.unsqueeze(b, np.uint32)
    m, n, pm, _ = _sum(get("m", _undelta), get("n", counts))
    hm, hn, ph, _ = _sum(get("hm", _undelta), get("hn", counts))
    words, sizes, data = get("w", _undelta), get("sizes", counts), get("data", lambda b: kit.unsqueeze(b, np.uint8))
    w, c, pw, back = _sum(words, get("c", counts))
    # Spelling: from any block that sent the word.
    size, first = np.concatenate(sizes).astype(np.int64), np.zeros(len(w), np.int64)
    start = np.cumsum(size) - size
    first[back[::-1]] = np.arange(len(back))[::-1]
    size = size[first]
    at = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    who, seen = (hm & U((1 << 30) - 1)).astype(np.int64), hn > 0
    ids = np.unique(who[seen])
    frequent = np.stack([ids, np.bincount(who[seen], minlength=1)[ids], np.bincount(who, hn, len(np.bincount(who, minlength=1)))[ids].astype(np.int64)], 1) if len(ids) else np.zeros((0, 3), np.int64)
    row = (asked["bucket"][0].as_py(), _delta(m), _z(n), _delta(hm), _z(hn), _delta(w), _z(c), _z(size.astype(np.uint32)), _z(np.concatenate(data)[at], 3))
    return _rows([(*row, asked["block"].to_pylist(), pm, ph, pw, int(c.sum()), int((c > 0).sum()), int((n > 0).sum() + seen.sum()), frequent.ravel().tolist())], TYPES)


class Pairs:
    """Kinds of a bucket: plain ones, whose restaurants are whole, then those of frequent words."""

    def __init__(self, row: dict):
        m, hm = _undelta(row["m"]), _undelta(row["hm"])
        self.plain, self.key = len(m), np.concatenate([m, hm | U(1 << 63)])
        self.n = np.concatenate([kit.unsqueeze(row["n"], np.int64), kit.unsqueeze(row["hn"], np.int64)])
        self.second = np.concatenate([m & U((1 << 34) - 1), hm >> U(30)])
        new = np.append(True, m[1:] >> U(34) != m[:-1] >> U(34))[: len(m)]
        self.own = int(new.sum())
        self.rest = np.concatenate([np.cumsum(new) - 1, self.own + (hm & U((1 << 30) - 1)).astype(np.int64)])

    def message(self, t: np.ndarray, buckets: int, need: bool):
        """(bucket of words, second words, their tables, which of them need their probability)."""
        at = np.flatnonzero(self.n)
        second, back = kit.distinct(self.second[at])
        tables = np.bincount(back, t[at], len(second)).astype(np.uint32)
        wanted = np.bincount(back, self.n[at] > 1, len(second)) > 0
        for b, q in _by_bucket(second << U(30), buckets):
            yield b, _delta(second[q]), _z(tables[q]), _z(np.packbits(wanted[q])) if need else None

    def below(self, told: list, buckets: int) -> np.ndarray:
        """Of each kind with several customers the probability of its second word; told: (bucket of words, probabilities)."""
        (second, back), got = kit.distinct(self.second[self.n > 1]), dict(told)
        p = np.ones(len(second))
        for b, q in _by_bucket(second << U(30), buckets):
            p[q] = kit.unsqueeze(got[b], np.float32)
        return p[back]

    def sample(self, below: np.ndarray, parent: float, frequent: np.ndarray, seed: int):
        """Runs the sweeps; (averaged customers less discounts, customers and averaged tables of each restaurant, last tables).

        Only kinds with several customers move.  below: what their second words have; frequent: tables of the restaurants of frequent words in all buckets, at the start.
        """
        d, theta = PAIR
        size = self.own + len(frequent)
        customers, t = np.bincount(self.rest, self.n, size), np.minimum(self.n, 1)
        tables = start = np.bincount(self.rest, t, size)
        others = np.concatenate([np.zeros(self.own), frequent]) - np.where(np.arange(size) < self.own, 0, start)
        many = np.flatnonzero(self.n > 1)
        n, rest, key = self.n[many], self.rest[many], self.key[many]
        own, some, total, seats = self.n - d * t, np.zeros(len(many)), np.zeros(size), t[many]
        alone = start - np.bincount(rest, seats, size)
        for sweep in range(BURN + SAMPLES):
            seats = seat(n, seats, (others + tables)[rest], below, d, theta, key, (seed << 8) + sweep, parent)
            tables = alone + np.bincount(rest, seats, size)
            if sweep >= BURN:
                some += (n - d * seats) / SAMPLES
                total += tables / SAMPLES
        own[many], t[many] = some, seats
        return own, customers, total, t


class Words:
    """Words of a bucket and the customers that pairs send them."""

    def __init__(self, row: dict, spelling: Spelling, told: pa.Table):
        self.h, self.c = _undelta(row["w"]), kit.unsqueeze(row["c"], np.int64)
        kinds, bounds = letters(kit.unsqueeze(row["sizes"], np.uint32).astype(np.int64), kit.unsqueeze(row["data"], np.uint8))
        self.base = np.zeros(len(self.h))
        for i in range(0, len(self.h), 1 << 16):
            some = bounds[i : i + (1 << 16) + 1]
            self.base[i : i + len(some) - 1] = kit.per_text(some - some[0], spelling.log10(kinds[some[0] : some[-1]]))
        self.second, self.customers = self.h >> U(30), np.zeros(len(self.h), np.int64)
        self.asked = []
        for i in range(told.num_rows):
            at = np.searchsorted(self.second, _undelta(told["w"][i].as_py()))
            np.add.at(self.customers, at, kit.unsqueeze(told["t"][i].as_py(), np.uint32).astype(np.int64))
            self.asked.append((told["sender"][i].as_py(), at, told["need"][i].as_py()))

    def tables(self, start: int, sweeps: int, seed: int):
        """Numbers of tables after each sweep; start: tables of all words."""
        t, total, g = np.minimum(self.customers, 1), np.full(len(self.h), start), 10.0 ** np.maximum(self.base, -290)
        for sweep in range(sweeps):
            t = seat(self.customers, t, total, g, *WORD, self.h, (seed << 8) + sweep)
            yield t


NOTE = pa.schema([("target", pa.int64()), ("step", pa.int64()), ("sender", pa.int64()), *((c, pa.binary()) for c in ("w", "t", "need", "a")), ("totals", pa.list_(pa.float64()))])
NOTE_DDL = "target long, step long, sender long, w binary, t binary, need binary, a binary, totals array<double>"
FOR_BLOCK, FOR_WORDS, TOTALS = 1, 2, 3


def _requests(types: pa.RecordBatch, buckets: int):
    """What pairs tell the buckets of words: each kind is one customer, and some must know the word's probability."""
    for row in types.to_pylist():
        pairs = Pairs(row)
        yield [(b, FOR_WORDS, row["bucket"], w, t, need, None, None) for b, w, t, need in pairs.message(np.minimum(pairs.n, 1), buckets, True)]


def _first(words: pa.Table, asked: pa.Table, spelling: Spelling, kinds: int, known: int, seed: int) -> pa.Table:
    """Probabilities of words, from one customer for each kind of pair."""
    if not words.num_rows or not asked.num_rows:
        return NOTE.empty_table()
    row = words.to_pylist()[0]
    x = Words(row, spelling, asked)
    *_, t = x.tables(known, BURN, seed)
    d, theta = WORD
    p = chance(x.customers, t, kinds, known, 10.0 ** np.maximum(x.base, -290), d, theta)
    out = []
    for sender, at, need in x.asked:
        wanted = np.unpackbits(kit.unsqueeze(need, np.uint8), count=len(at)).astype(bool)
        out.append((sender, FOR_WORDS, row["bucket"], None, None, None, _z(p[at[wanted]].astype(np.float32)), None))
    return _rows(out, NOTE)


def _sampled(types: pa.Table, told: pa.Table, kinds: int, frequent: np.ndarray, buckets: int, seed: int) -> pa.Table:
    """Runs the sweeps of a bucket's pairs; answers to the blocks, last tables to the buckets of words, totals of frequent words."""
    if not types.num_rows:
        return NOTE.empty_table()
    row = types.to_pylist()[0]
    pairs = Pairs(row)
    below = pairs.below([(told["sender"][i].as_py(), told["a"][i].as_py()) for i in range(told.num_rows)], buckets)
    own, customers, total, t = pairs.sample(below, WORD[1] + kinds, frequent, seed)
    out = [(b, FOR_WORDS, row["bucket"], w, n, None, None, None) for b, w, n, _ in pairs.message(t, buckets, False)]
    for block, pm, ph in zip(row["blocks"], row["pm"], row["ph"]):
        at, hot = (np.cumsum(kit.unsqueeze(x, np.uint32), dtype=np.int64) for x in (pm, ph))
        rest = pairs.rest[at]
        rest = rest[np.append(True, rest[1:] != rest[:-1])[: len(rest)]]
        out.append((block, FOR_BLOCK, row["bucket"], _z(customers[rest].astype(np.uint64)), _z(total[rest].astype(np.float32)), _z(own[pairs.plain + hot].astype(np.float32)), _z(own[at].astype(np.float32)), None))
    held = np.flatnonzero(customers[pairs.own :])
    if len(held):
        out.append((-1, TOTALS, row["bucket"], None, None, None, None, np.stack([held, customers[pairs.own + held], total[pairs.own + held]], 1).ravel().tolist()))
    return _rows(out, NOTE)


SEATED = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("base", "customers", "c")), ("t", pa.list_(pa.binary())), ("tables", pa.list_(pa.int64())), ("total", pa.int64()), ("blocks", pa.list_(pa.int64())), ("pw", pa.list_(pa.binary()))])
SEATED_DDL = "bucket long, base binary, customers binary, c binary, t array<binary>, tables array<long>, total long, blocks array<long>, pw array<binary>"


def _seated(words: pa.Table, told: pa.Table, spelling: Spelling, known: int, seed: int) -> pa.Table:
    """Samples of the words' tables, given the last tables of the pairs."""
    if not words.num_rows:
        return SEATED.empty_table()
    row = words.to_pylist()[0]
    x = Words(row, spelling, told)
    t = [*x.tables(known, BURN + SAMPLES, seed)][BURN:]
    return _rows([(row["bucket"], x.base.tobytes(), _z(x.customers), row["c"], [_z(v.astype(np.uint32)) for v in t], [int(v.sum()) for v in t], int(x.customers.sum()), row["blocks"], row["pw"])], SEATED)


def _words_told(seated: pa.RecordBatch, customers: int, tables: list):
    """To each block, log10 of the averaged probability and the count of each of its words."""
    d, theta = WORD
    for row in seated.to_pylist():
        base, own, c = np.frombuffer(row["base"], np.float64), kit.unsqueeze(row["customers"], np.int64), kit.unsqueeze(row["c"], np.int64)
        less = sum(own - d * kit.unsqueeze(t, np.uint32) for t in row["t"]) / SAMPLES / (theta + customers)
        back = np.log10((theta + d * sum(tables) / SAMPLES) / (theta + customers)) + base
        p = np.where(less > 0, np.log10(np.maximum(less, 1e-300) + 10.0 ** np.maximum(back, -290)), back).astype(np.float32)
        out = []
        for block, pw in zip(row["blocks"], row["pw"]):
            at = np.cumsum(kit.unsqueeze(pw, np.uint32), dtype=np.int64)
            out.append((block, FOR_WORDS, row["bucket"], None, _z(c[at]), None, _z(p[at]), None))
        yield out


def _score(docs: pa.Table, told: pa.Table, hot: np.ndarray, frequent: np.ndarray, tokens: int, known: int, buckets: int, schema: pa.Schema) -> pa.Table:
    """frequent: customers and tables of the restaurants of frequent words."""
    if not docs.num_rows:
        return schema.empty_table()
    x = Tokens(docs, hot)
    m, hm, w, wi = x.m, x.hm, x.w, x.wi
    got = {k: i for i, k in enumerate(zip(told["step"].to_pylist(), told["sender"].to_pylist()))}
    told = {k: told[k].combine_chunks() for k in ("w", "t", "need", "a")}
    own, own_hot, c, p = np.zeros(len(m)), np.zeros(len(hm)), np.zeros(len(w), np.int64), np.zeros(len(w))
    first = np.append(True, m[1:] >> U(34) != m[:-1] >> U(34))[: len(m)]
    rest = np.cumsum(first) - 1
    customers, tables = np.zeros(int(first.sum())), np.zeros(int(first.sum()))
    for b, (q, h, v) in _slices([m, hm, w], buckets):
        get = lambda step, column, kind: kit.unsqueeze(told[column][got[step, b]].as_py(), kind)  # noqa: B023, E731
        if q.stop > q.start or h.stop > h.start:
            own[q], own_hot[h] = get(FOR_BLOCK, "a", np.float32), get(FOR_BLOCK, "need", np.float32)
            if q.stop > q.start:
                r = slice(rest[q.start], rest[q.stop - 1] + 1)
                customers[r], tables[r] = get(FOR_BLOCK, "w", np.uint64), get(FOR_BLOCK, "t", np.float32)
        if v.stop > v.start:
            c[v], p[v] = get(FOR_WORDS, "t", np.int64), get(FOR_WORDS, "a", np.float32)
    d, theta = PAIR
    # What holds for a restaurant, a pair or a word is found once for each.
    log, less = p[wi], np.empty(len(wi))
    log[x.plain] += np.log10((theta + d * tables) / (theta + customers))[rest][x.mi]
    less[x.plain] = (own / (theta + customers)[rest])[x.mi]
    if len(hm):
        log[x.hot] += np.log10((theta + d * frequent[1]) / (theta + frequent[0]))[x.hot_at]
        less[x.hot] = own_hot[x.hi] / (theta + frequent[0])[x.hot_at]
    some = np.flatnonzero(less > 0)
    log[some] = np.log10(np.maximum(less[some], 1e-300) + 10.0 ** np.maximum(log[some], -290))
    size = np.diff(x.bounds)
    score = kit.per_text(x.bounds, log)
    base = kit.per_text(x.bounds, np.log10((c + 0.5) / (tokens + 0.5 * (known + 1)))[wi])
    cols = [docs.column("doc_id"), docs.column("__held"), pa.array(size), pa.array(kit.per_text(x.bounds, (c > 0)[wi]).astype(np.int64)), pa.array(np.full(len(size), tokens)), pa.array(base), pa.array(score), pa.array(10.0 ** np.minimum(300, -score / size))]
    return pa.table(cols, schema=schema)


def _frequent(rows: DataFrame, threshold: int) -> np.ndarray:
    """Hashes of the words with at least so many occurrences, and at least a 4,096th of all: sorted, 4,096 at most.

    A word counts in a piece of text (2 MB) where it makes up 2**-14 of the tokens or more.
    """

    def run(batches):
        for batch in batches:
            for part in kit.slices(batch, "__text"):
                t = kit.Texts(part.column(0)).words()
                h, n = np.unique(t.hashes(kit.lower_ascii(t.buf)), return_counts=True)
                h, n = np.append(h, END_WORD), np.append(n, t.n)
                some = n >= n.sum() >> 14
                h, n = np.append(h[some], U(0)), np.append(n[some], n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = rows.select("__text").mapInArrow(kit.trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= threshold)
    total = counts.where("h = 0").first()
    if total is None:
        return NONE
    return np.sort(np.array([r.h for r in counts.where(f"h <> 0 and n * 4096 >= {total.n}").collect()], np.int64).view(U))


def _each(batches, f, schema):
    """f of each batch gives lists of rows; a record batch for each."""
    for batch in batches:
        for i in range(batch.num_rows):
            for rows in f(batch.slice(i, 1)):
                yield from _rows(rows, schema).to_batches()


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 0, hot_from: int = HOT) -> DataFrame:
    """Scores every row; learns from those that are not held out (crc32 of the id as text, modulo 5, is 1).

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity (per token).
    """
    spark = docs.sparkSession
    dealt = kit.Dealt(docs, text, key)
    hot, buckets = _frequent(dealt.rows, hot_from), dealt.buckets
    dealt.rows = dealt.rows.withColumn("__held", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1)
    asked = dealt.by_block().applyInArrow(kit.one(lambda t: _ask(t, hot, buckets)), ASK_DDL)
    where = kit.scratch(spark)
    types = kit.stored(dealt.by(asked, "bucket").applyInArrow(kit.one(_merge), TYPES_DDL), where)
    sums = types.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "known", "kinds"))).first()
    tokens, known, kinds = map(int, sums)

    def totals(rows: DataFrame, column: str) -> np.ndarray:
        """Sums of (place, x, y) over the buckets; a row for each frequent word."""
        of = lambda i: F.element_at(column, (3 * F.col("i") + i).cast("int"))
        flat = rows.where(F.size(column) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.size(column) / 3) - 1)))
        out = np.zeros((2, len(hot)))
        for r in flat.groupBy(of(1).cast("int").alias("k")).agg(F.sum(of(2)).alias("x"), F.sum(of(3)).alias("y")).collect():
            out[:, r.k] = r.x, r.y
        return out

    frequent = totals(types, "frequent")[0] if len(hot) else np.zeros(0)

    def spelt(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size, c = kit.unsqueeze(row["sizes"], np.uint32).astype(np.int64), kit.unsqueeze(row["c"], np.int64)
                k, bounds = letters(size, kit.unsqueeze(row["data"], np.uint8))
                k, n = np.unique(k[np.repeat(c > 0, np.diff(bounds))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["kind", "n"])

    # 256**3 kinds at most come to the driver.
    spelt_ = types.select("c", "sizes", "data").mapInArrow(kit.trimmed(spelt), "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).toArrow()
    k, n = spelt_["kind"].to_numpy(), spelt_["n"].to_numpy()
    order = np.argsort(k)
    spelling = spark.sparkContext.broadcast(Spelling(k[order], n[order], seed))

    words = types.select("bucket", "w", "c", "sizes", "data")
    asks = types.select("bucket", "m", "n", "hm", "hn").mapInArrow(kit.trimmed(lambda b: _each(b, lambda x: _requests(x, buckets), NOTE)), NOTE_DDL)
    told = words.groupBy("bucket").cogroup(dealt.by(asks, "target")).applyInArrow(kit.two(lambda a, b: _first(a, b, spelling.value, kinds, known, seed + 1)), NOTE_DDL)
    pairs = types.select("bucket", "m", "n", "hm", "hn", "blocks", "pm", "ph")
    run = kit.stored(pairs.groupBy("bucket").cogroup(dealt.by(told, "target")).applyInArrow(kit.two(lambda a, b: _sampled(a, b, kinds, frequent, buckets, seed + 2)), NOTE_DDL))
    whole = totals(run.where(F.col("step") == TOTALS), "totals") if len(hot) else np.zeros((2, 0))
    words = types.select("bucket", "w", "c", "sizes", "data", "blocks", "pw")
    seated = words.groupBy("bucket").cogroup(dealt.by(run.where(F.col("step") == FOR_WORDS), "target")).applyInArrow(kit.two(lambda a, b: _seated(a, b, spelling.value, known, seed + 3)), SEATED_DDL)
    seated = kit.stored(seated)
    kit.remove(spark, where)
    at = seated.select(F.posexplode("tables").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    tables = [int(r.x) for r in sorted(at, key=lambda r: r.i)] or [0] * SAMPLES
    customers = int(seated.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0])
    told2 = seated.mapInArrow(kit.trimmed(lambda b: _each(b, lambda x: _words_told(x, customers, tables), NOTE)), NOTE_DDL)
    notes = run.where(F.col("step") == FOR_BLOCK).unionByName(told2)
    schema = pa.schema([("doc_id", dealt.arrow), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), *((c, pa.float64()) for c in ("base_score", "score", "perplexity"))])
    ddl = f"doc_id {dealt.ddl}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return dealt.by_block().cogroup(notes.groupBy("target")).applyInArrow(kit.two(lambda a, b: _score(a, b, hot, whole, tokens, known, buckets, schema)), ddl)
