"""Suffix-array dedup: threshold-bounded interval expansion.

Every byte that lies in a string of `length` bytes which also starts anywhere
else is removed.  A Burrows-Wheeler transform is expanded backwards, breadth
first: intervals of strings of one more byte derive the common prefixes of
neighbouring suffixes in increasing order, up to the minimum length; suffixes
whose boundary is still open then share at least that many bytes.

The text is far too large for one transform, so strings are dealt out first.
Each window of `length` bytes belongs to the least hash of the K-byte strings in
it; windows in a row that share it make a stretch.  Equal windows have equal
least hashes and so meet in one bucket.  Three steps:

1. each block of documents tells the buckets its distinct stretches (hashes and
   whether there are several), and learns which are unique, which occur again
   as a whole, and which must be looked at;
2. of the latter, each distinct stretch is sent once and the bucket builds the
   transform of its stretches and finds repeated windows;
3. each block covers the repeated windows and removes the bytes.

A hash with more than HOT distinct stretches (or LOCAL in one block, which then
sends but one entry of it) would fill a task.  Its windows are dealt out again,
by more of their bytes: around the string that the hash is of, half of what is
left of the window is added, on the right where the window has as much there,
else on the left.  Windows in a row share these bytes too, so stretches are
halved, and equal windows still meet.  That is repeated while there are such
hashes, until the whole window is known, of which there is one stretch only.
Hashes that a sample shows to be such are split from the start.

Equal stretches are merged in the block before anything is sent, so a passage
or a group of copies costs each block one entry, however many rows hold it.

Defined cases: a null text is empty; a text shorter than `length` has nothing
removed; repeated rows are repeats of each other; ids keep their type, null
ones too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit

U = np.uint64
LENGTH, K = 200, 40
CHUNK = 2 << 20  # bytes of one transform, unless one hash has more
HOT, LOCAL = 4096, 1024
UNIQUE, AGAIN, SEND, SPLIT = 0, 1, 2, 4
EARLY, RANGES = 50, 100  # steps of answers: levels from 0 on, those of early hashes from 50 on, ranges
SAMPLE, SEEN = 256, 8  # one text of so many is looked at for early hashes: with so many distinct stretches there
MOST_EARLY = 1 << 16  # the others are split when they are told to be


class Stretches:
    """The stretches of a block's texts: m (least hash), a (start), n (bytes)."""

    def __init__(self, t: kit.Texts, length: int):
        k = min(K, length)
        self.t, self.length, self.w = t, length, length - k + 1
        buf, size = t.buf, len(t.buf)
        if size < length:
            self.m = np.zeros(0, U)
            self.a = self.n = np.zeros(0, np.int64)
            return
        with np.errstate(over="ignore"):
            sums = kit.prefix_sums(buf)
            h = kit.mix((sums[k:] - sums[:-k]) * kit.powers(kit._PINV, size + 1)[: size + 1 - k])
        least = self.sliding(h)
        ends = np.repeat(t.hi, t.hi - t.lo)[: len(least)]
        valid = np.arange(len(least)) + length <= ends
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
        self.a = np.flatnonzero(new)
        self.n = np.flatnonzero(last) + length - self.a
        self.m = kit.mix(least[self.a])  # least values crowd at zero; mixed ones spread over the buckets
        self.sums = sums
        # Places of least strings: those that are the least of some valid window.
        top = self.sliding(np.concatenate([np.full(self.w - 1, np.iinfo(U).max, U), ~np.where(valid, least, U(0)), np.full(self.w - 1, np.iinfo(U).max, U)]))
        self.least_at = np.flatnonzero(~top == h)
        self.least_m = kit.mix(h[self.least_at])
        self.k = k

    def sliding(self, h: np.ndarray) -> np.ndarray:
        """Least of each w successive values."""
        w, size = self.w, len(h)
        x = np.full(-(-size // w) * w, np.iinfo(U).max, U)
        x[:size] = h
        x = x.reshape(-1, w)
        ahead = np.minimum.accumulate(x, axis=1).ravel()
        back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[: size - w + 1], ahead[w - 1 : size])

    def hashes(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[a + n] - self.sums[a]) * kit.powers(kit._PINV, len(self.sums))[a]
            return kit.mix(x ^ (n.astype(U) * U(kit._Q)))

    def levels(self, told: pa.Table | None, buckets: int, early: np.ndarray) -> list["Level"]:
        """The distinct stretches, and those that hashes with too many of them were split to, with what is known of them.

        Hashes of `early` are split from the start, so two rows of levels go on side by side.
        """
        at = np.minimum(np.searchsorted(early, self.m), max(0, len(early) - 1))
        known = early[at] == self.m if len(early) else np.zeros(len(self.m), bool)
        first = Level(self, self.m[known], self.a[known], self.n[known])
        first.verdict = np.full(len(first.em), SPLIT, np.uint8)
        out = []
        for step, level in ((0, Level(self, self.m[~known], self.a[~known], self.n[~known])), (EARLY, first.split() if known.any() else None)):
            while level is not None:
                level.step = step
                out.append(level)
                level.open = told is None or not level.judge(told, step, buckets)
                level, step = (level.split() if not level.open and (level.verdict & SPLIT).any() else None), step + 1
        return out

    def anchors(self, m: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, place) of each stretch's least string, in order."""
        lo = np.searchsorted(self.least_at, a)
        size = np.searchsorted(self.least_at, a + n - self.k, "right") - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(a)), size)
        same = self.least_m[at] == m[which]
        return which[same], self.least_at[at[same]]


class Level:
    """Stretches of a block: em, ec (of distinct ones, sorted), one (a stretch of each), entry (of each stretch, its distinct one), many, inner."""

    def __init__(self, s: Stretches, m: np.ndarray, a: np.ndarray, n: np.ndarray, known: tuple | None = None):
        self.s, self.m, self.a, self.n, self.known = s, m, a, n, known
        c = s.hashes(a, n) if len(m) else np.zeros(0, U)
        order = np.lexsort((c, m))
        ms, cs = m[order], c[order]
        new = np.ones(len(m), bool)
        new[1:] = (ms[1:] != ms[:-1]) | (cs[1:] != cs[:-1])
        first = np.flatnonzero(new)
        self.entry = np.empty(len(m), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.em, self.ec, self.one = ms[first], cs[first], order[first]
        self.many = np.diff(np.append(first, len(m))) > 1
        self.inner = np.zeros(len(first), bool)
        if known is None and len(m):
            # A stretch repeats windows of its own only where its least string occurs in it twice.
            self.inner = np.bincount(s.anchors(self.em, a[self.one], n[self.one])[0], minlength=len(first)) > 1
        new = np.append(True, self.em[1:] != self.em[:-1])[: len(first)]
        lead = np.flatnonzero(new)
        size = np.diff(np.append(lead, len(first)))
        self.crowded = np.repeat(size > LOCAL, size)
        self.told = np.flatnonzero(~self.crowded | new)  # entries that are sent

    def judge(self, told: pa.Table, level: int, buckets: int) -> bool:
        """Sets the verdict of each entry, if there is one yet."""
        got = {told["bucket"][i].as_py(): told["flags"][i].as_py() for i in range(told.num_rows) if told["step"][i].as_py() == level}
        if not got:
            self.verdict = np.zeros(len(self.em), np.uint8)
            return False
        self.verdict = np.where(self.crowded, SPLIT, 0).astype(np.uint8)
        for b, q in _by_bucket(self.em[self.told], buckets):
            self.verdict[self.told[q]] = kit.unsqueeze(got[b], np.uint8)
        return True

    def split(self) -> "Level":
        s = self.s
        some = np.flatnonzero((self.verdict & SPLIT > 0)[self.entry])
        a, last = self.a[some], self.a[some] + self.n[some] - s.length
        if self.known is None:
            # Each window has its first least string.
            which, at = s.anchors(self.m[some], a, self.n[some])
            before = np.where(np.append(True, which[1:] != which[:-1])[: len(at)], -1, np.append(-1, at[:-1])[: len(at)])
            lo, hi = np.maximum(a[which], before + 1), np.minimum(last[which], at)
            left, right = at, at + s.k
        else:
            lo, hi, (left, right) = a, last, (v[some] for v in self.known)
        half = (s.length - (right - left) + 1) // 2
        turn = right + half - s.length  # the first window with so much on the right
        lo, hi = np.concatenate([np.maximum(lo, turn), lo]), np.concatenate([hi, np.minimum(hi, turn - 1)])
        left, right = np.concatenate([left, left - half]), np.concatenate([right + half, right])
        real = lo <= hi
        lo, hi, left, right = (v[real] for v in (lo, hi, left, right))
        return Level(s, kit.mix(s.hashes(left, right - left) if len(lo) else np.zeros(0, U)), lo, hi - lo + s.length, (left, right))


def _by_bucket(m: np.ndarray, buckets: int):
    """(bucket, slice) of sorted hashes, whose high bits choose the bucket."""
    if not len(m):
        return
    which = ((m >> U(32)) * U(buckets)) >> U(32)
    edges = np.flatnonzero(np.append(True, which[1:] != which[:-1])).tolist()
    for lo, hi in zip(edges, [*edges[1:], len(m)]):
        yield int(which[lo]), slice(lo, hi)


def _delta(m: np.ndarray) -> bytes:
    steps = m.copy()
    steps[1:] -= m[:-1]
    return kit.squeeze(steps)


def _undelta(b: bytes) -> np.ndarray:
    return np.cumsum(kit.unsqueeze(b, U), dtype=U)


ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("level", pa.int64()), ("m", pa.binary()), ("c", pa.binary()), ("flags", pa.binary()), ("size", pa.binary()), ("data", pa.binary())])
ASK_DDL = "bucket long, block long, level long, m binary, c binary, flags binary, size binary, data binary"
TELL = pa.schema([("block", pa.int64()), ("step", pa.int64()), ("bucket", pa.int64()), ("flags", pa.binary()), ("ranges", pa.binary()), ("split", pa.bool_())])
TELL_DDL = "block long, step long, bucket long, flags binary, ranges binary, split boolean"


def _rows(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _ask(docs: pa.Table, told: pa.Table | None, length: int, buckets: int, early: np.ndarray) -> pa.Table:
    """The entries of levels that are not judged yet."""
    if not docs.num_rows or told is not None and not any(told["split"].to_pylist()):
        return ASK.empty_table()
    block, rows = docs.column("__block")[0].as_py(), []
    for x in Stretches(kit.Texts(docs.column("__text")), length).levels(told, buckets, early):
        if x.open:
            flags = (x.many * 1 + x.inner * 2 + x.crowded * 4).astype(np.uint8)[x.told]
            m, c = x.em[x.told], x.ec[x.told]
            rows += [(b, block, x.step, _delta(m[q]), kit.squeeze(c[q]), kit.squeeze(flags[q]), None, None) for b, q in _by_bucket(m, buckets)]
    return _rows(rows, ASK)


def _answer(asked: pa.Table) -> pa.Table:
    """For each entry: UNIQUE, AGAIN (all of it is repeated), SEND (its bytes are needed from this block), SPLIT."""
    # Who sends a stretch must not depend on the order in which blocks arrive.
    asked = asked.take(np.lexsort((asked["level"].to_numpy(), asked["block"].to_numpy())))
    sizes, parts = [], []
    for i in range(asked.num_rows):
        m, c, f = _undelta(asked["m"][i].as_py()), kit.unsqueeze(asked["c"][i].as_py(), U), kit.unsqueeze(asked["flags"][i].as_py(), np.uint8)
        parts.append((m, c, f))
        sizes.append(len(m))
    m, c, f = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, m))
    m, c, f = m[order], c[order], f[order]
    new_m, new = np.ones(len(m), bool), np.ones(len(m), bool)
    new_m[1:] = m[1:] != m[:-1]
    new[1:] = new_m[1:] | (c[1:] != c[:-1])
    entry, group = np.cumsum(new) - 1, np.cumsum(new_m) - 1
    again = (np.bincount(entry) + np.bincount(entry, f & 1)) > 1
    variants = np.bincount(group[new])
    look = (variants > 1)[group] | (f & 2 > 0)
    split = ((variants > HOT) | (np.bincount(group, f & 4) > 0))[group]
    verdict = np.where(split, SPLIT, again[entry] * AGAIN | np.where(look & new, SEND, 0))
    out = np.empty(len(m), np.uint8)
    out[order] = verdict
    edges = np.cumsum([0, *sizes])
    return _rows([(asked["block"][i].as_py(), asked["level"][i].as_py(), asked["bucket"][i].as_py(), kit.squeeze(v), None, bool((v & SPLIT).any())) for i in range(asked.num_rows) for v in [out[edges[i] : edges[i + 1]]]], TELL)


def _sent(levels: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, bytes and verdict of the stretches whose bytes are sent, sorted by hash."""
    parts = []
    for x in levels:
        at = np.flatnonzero(x.verdict & SEND)
        parts.append((x.em[at], x.a[x.one[at]], x.n[x.one[at]], x.verdict[at] & AGAIN))
    m, a, n, again = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(m, kind="stable")
    return m[order], a[order], n[order], again[order]


def _send(docs: pa.Table, told: pa.Table, length: int, buckets: int, early: np.ndarray) -> pa.Table:
    if not docs.num_rows:
        return ASK.empty_table()
    s = Stretches(kit.Texts(docs.column("__text")), length)
    block, rows = docs.column("__block")[0].as_py(), []
    m, a, n, again = _sent(s.levels(told, buckets, early))
    for b, q in _by_bucket(m, buckets):
        at = np.repeat(a[q] - (np.cumsum(n[q]) - n[q]), n[q]) + np.arange(n[q].sum())
        rows.append((b, block, 0, _delta(m[q]), None, kit.squeeze(again[q]), kit.squeeze(n[q]), kit.squeeze(s.t.buf[at], 3)))
    return _rows(rows, ASK)


def suffix_order(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first `length` codes, and the first eight codes of each, packed; the last code is 0 and the only one."""
    n = len(codes)
    head, wide = np.zeros(n, U), np.concatenate([codes, np.zeros(8, np.uint8)]).astype(U)
    for j in range(8):
        head = (head << U(8)) | wide[j : j + n]
    sa = np.argsort(head, kind="stable")
    step = np.ones(n, bool)
    step[1:] = head[sa][1:] != head[sa][:-1]
    rank = np.empty(n, np.int64)
    # The rank of a class is the place of its first suffix, so resolved ones never change.
    rank[sa] = np.maximum.accumulate(np.where(step, np.arange(n), 0))
    h = 8
    while h < length:
        step = np.append(step, True)
        single = step[:-1] & step[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        some = sa[open_]
        nxt = some + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = (rank[some].astype(U) << U(32)) | second.astype(U)
        order = np.argsort(key, kind="stable")
        sa[open_], key = some[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        step = step[:-1]
        step[open_] = new
        fresh = np.maximum.accumulate(np.where(step, np.arange(n), 0))
        rank[sa[open_]] = fresh[open_]
        h *= 2
    return sa, head


def repeated(codes: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of `length` codes that starts elsewhere too (those that reach a 0 are of no meaning).

    open_[i] says that the common prefix of the suffixes at places i - 1 and i
    is not known yet, so it is at least as long as the level reached.
    """
    codes = np.append(codes + np.uint8(1), np.uint8(0))
    n = len(codes)
    sa, head = suffix_order(codes, length)
    bwt = codes[sa - 1]  # the text is read as a circle, so each suffix has a code before it
    psi = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    front = bwt[psi]
    # Levels under eight come from the packed heads.
    level = min(8, length)
    hs = head[sa]
    x = np.empty(n, U)
    x[0] = np.iinfo(U).max
    x[1:] = hs[1:] ^ hs[:-1]
    open_ = np.append((x >> U(64 - 8 * level)) == 0 if level < 8 else x == 0, False)
    exact = np.flatnonzero(~open_[:-1])
    ends = np.append(exact[1:], n)
    if level == 8:
        # Begin with the strings of eight codes whose end was settled at seven.
        known = np.append(x, U(1 << 63))[ends] < U(256)
        known |= ends == n
        lo, hi = exact[known], ends[known]
    else:
        lo, hi = exact, ends
    while level < length and len(lo):
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        low, high = np.repeat(lo, size), np.repeat(hi, size)
        q = lf[at]
        after, before = np.minimum(q + 1, n - 1), np.maximum(q - 1, 0)
        code = bwt[at]
        last = (q + 1 == n) | (front[after] != code) | (psi[after] >= high)
        first = (q == 0) | (front[before] != code) | (psi[before] < low)
        begin, end = np.sort(q[first]), np.sort(q[last]) + 1
        fresh = open_[end]
        lo, hi = begin[fresh], end[fresh]
        open_[hi] = False
        level += 1
    out = np.empty(n, bool)
    out[sa] = open_[:-1] | open_[1:]
    return out[:-1]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _search(asked: pa.Table, length: int) -> pa.Table:
    bucket = asked["bucket"][0].as_py()
    entries, m, again, size, data = [], [], [], [], []
    for i in range(asked.num_rows):
        m.append(_undelta(asked["m"][i].as_py()))
        again.append(kit.unsqueeze(asked["flags"][i].as_py(), np.uint8))
        size.append(kit.unsqueeze(asked["size"][i].as_py(), np.int64))
        data.append(kit.unsqueeze(asked["data"][i].as_py(), np.uint8))
        entries.append(np.stack([np.full(len(m[-1]), i), np.arange(len(m[-1]))], 1))
    m, again, size, data, entries = (np.concatenate(v) for v in (m, again, size, data, entries))
    start = np.cumsum(size) - size
    code = np.zeros(256, np.uint8)
    seen = np.flatnonzero(np.bincount(data, minlength=256))
    code[seen] = np.arange(1, len(seen) + 1)  # UTF-8 leaves room for the separator
    order, found = np.argsort(m, kind="stable"), [[] for _ in range(asked.num_rows)]
    new = np.flatnonzero(np.append(True, m[order][1:] != m[order][:-1]))
    total, p = np.cumsum(size[order] + 1), 0
    bounds = np.append(new, len(m))
    k = 0
    while k < len(new):
        # Whole hashes, up to CHUNK bytes.
        limit = (total[p - 1] if p else 0) + CHUNK
        k = max(k + 1, int(np.searchsorted(total[bounds[1:] - 1], limit, "right")))
        some, p = order[p : bounds[k]], int(bounds[k])
        at = np.cumsum(size[some] + 1) - size[some] - 1
        text = np.zeros(int(at[-1] + size[some[-1]] + 1), np.uint8)
        inner = np.repeat(at - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
        outer = np.repeat(start[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
        text[inner] = code[data[outer]]
        hit = repeated(text, length)
        for e, a in zip(some.tolist(), at.tolist()):
            if not again[e]:
                b, f = _runs(hit[a : a + size[e] - length + 1])
                if len(b):
                    i, j = entries[e]
                    found[i].append(np.stack([np.full(len(b), j), b, f], 1))
    rows = [(asked["block"][i].as_py(), RANGES, bucket, None, kit.squeeze(np.concatenate(x).astype(np.int64).ravel()), False) for i, x in enumerate(found) if x]
    return _rows(rows, TELL)


def _cover(docs: pa.Table, told: pa.Table, length: int, buckets: int, early: np.ndarray, schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    t = kit.Texts(docs.column("__text"))
    levels = Stretches(t, length).levels(told, buckets, early)
    step = np.zeros(len(t.buf) + 1, np.int32)

    def cover(lo, hi):
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)

    for x in levels:
        whole = np.flatnonzero((x.verdict & AGAIN > 0)[x.entry]) if len(x.verdict) else np.zeros(0, np.int64)
        cover(x.a[whole], x.a[whole] + x.n[whole])
    got = {told["bucket"][i].as_py(): i for i in range(told.num_rows) if told["step"][i].as_py() == RANGES}
    m, a, *_ = _sent(levels)
    for b, q in _by_bucket(m, buckets):
        if b in got:
            j, lo, hi = kit.unsqueeze(told["ranges"][got[b]].as_py(), np.int64).reshape(-1, 3).T
            cover(a[q][j] + lo, a[q][j] + hi - 1 + length)
    gone = np.cumsum(step[:-1]) > 0
    lead = gone.copy()
    lead[1:] &= ~gone[:-1]
    edge = t.lo[(t.hi > t.lo)]
    lead[edge] = gone[edge]
    bounds = np.append(t.lo, len(t.buf))
    kept = [t.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(t.lo.tolist(), t.hi.tolist())]
    cols = [docs.column("doc_id"), pa.array(t.hi - t.lo), pa.array(kit.per_text(bounds, gone).astype(np.int64)), pa.array(kit.per_text(bounds, lead).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
    if len(schema) > 5:
        cols.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.large_string()))
    return pa.table(cols, schema=schema)


def _early(rows: DataFrame, length: int) -> np.ndarray:
    """Hashes, sorted, that have many distinct stretches in a sample of the texts: they will have to be split.

    The sample saves a pass over the texts; which hashes are in it changes no result.
    """

    def run(batches):
        for batch in batches:
            for part in kit.slices(batch, "__text"):
                s = Stretches(kit.Texts(part.column(0)), length)
                x = Level(s, s.m, s.a, s.n)
                yield pa.RecordBatch.from_arrays([pa.array(x.em.view(np.int64)), pa.array(x.ec.view(np.int64))], names=["m", "c"])

    some = rows.where(F.pmod(F.xxhash64("__text"), F.lit(SAMPLE)) == 0).select("__text")
    many = some.mapInArrow(kit.trimmed(run), "m long, c long").distinct().groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    return np.sort(np.array([r.m for r in many.orderBy(F.desc("n"), "m").limit(MOST_EARLY).collect()], np.int64).view(U))


def dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with_text what is left (kept; a cut character shows as U+FFFD)."""
    dealt = kit.Dealt(docs, text, key)
    buckets = dealt.buckets

    early = _early(dealt.rows, length)

    def answered(asked: DataFrame) -> DataFrame:
        return kit.stored(dealt.by(asked, "bucket").applyInArrow(kit.one(_answer), TELL_DDL))

    last = told = answered(dealt.by_block().applyInArrow(kit.one(lambda t: _ask(t, None, length, buckets, early)), ASK_DDL))
    while not last.where("split").isEmpty():
        # Only blocks with something new to split are asked again.
        again = told.join(last.where("split").select("block").distinct(), "block", "left_semi")
        last = answered(dealt.by_block().cogroup(again.groupBy("block")).applyInArrow(kit.two(lambda a, b: _ask(a, b, length, buckets, early) if b.num_rows else ASK.empty_table()), ASK_DDL))
        told = told.unionByName(last)
    sent = dealt.by_block().cogroup(told.groupBy("block")).applyInArrow(kit.two(lambda a, b: _send(a, b, length, buckets, early)), ASK_DDL)
    found = dealt.by(sent, "bucket").applyInArrow(kit.one(lambda t: _search(t, length)), TELL_DDL)
    fields = [("doc_id", dealt.arrow), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.large_string())] if with_text else fields)
    out = f"doc_id {dealt.ddl}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    both = told.unionByName(found)
    return dealt.by_block().cogroup(both.groupBy("block")).applyInArrow(kit.two(lambda a, b: _cover(a, b, length, buckets, early, schema)), out)
