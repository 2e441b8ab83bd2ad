"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of at least 0.8.  Texts with equal sets form one class.  For each
class MinHash values are made; classes that agree on a band of values meet in a
bucket, where values are compared in steps and a pair is dropped once the
posterior probability of reaching the threshold is under the tolerance.  What
remains joins classes to families; in a family the pairs are pruned in the
same way and the rest is verified on the shingles themselves.

The result has one row per document, with its group (linked texts, directly or
not) and the number of documents it is linked to; pairs are counted where they
are compared and never become rows.  Large buckets and families are cut into
pieces, and every two pieces meet in a task of their own, so no task holds a
whole one; in buckets, pieces and a leader of each are joined first, and only
what is not in the largest component then meets the rest.  With 32 bands of 4 values a pair at exactly 0.8 meets in no bucket
with probability 5e-8; the tolerance adds less than 1e-7.

Defined cases: a text of one to four words has one shingle of all of them; a
text without words (or null) is linked to none and its group is its own;
null ids are kept, with a null group where all the group's ids are null;
repeated rows are copies of each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit
from cloakframe.llm.components import components

K, NUM, DEN = 5, 4, 5  # words of a shingle; similarity of at least NUM / DEN
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, 128)
TOLERANCE = 1e-9
PIECE = 512  # most classes of a bucket or family on one side of a comparison
_rng = np.random.default_rng(20240229)
FACTORS = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def least_matches(n: int, threshold: float = NUM / DEN, tolerance: float = TOLERANCE) -> int:
    """Least m of n equal values for which P(similarity >= threshold | m of n) reaches the tolerance, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


NEED = [least_matches(n) for n in STEPS]


def sets(t: kit.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and n + 1 bounds. Words count as they are written."""
    t.words()
    h = t.hashes()
    s, at = t.shingles(h, K)
    doc, counts = t.doc[at], np.diff(t.first)
    short = np.flatnonzero((counts > 0) & (counts < K))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short):
            with np.errstate(over="ignore"):
                for x in h[t.first[i] : t.first[i + 1]]:
                    own[k] = own[k] * np.uint64(0xC2B2AE3D27D4EB4F) + x
        s, doc = np.concatenate([s, kit.mix(own)]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(t.n + 1))


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The low 16 bits of each MinHash value; bounds must have no empty text."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for j, a in enumerate(FACTORS):
            out[:, j] = np.minimum.reduceat(x * a, bounds[:-1]).astype(np.uint16)
    return out


def keys(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    with np.errstate(over="ignore"):
        add = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kit.mix(s), dtype=np.uint64)])
        two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kit.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)])
        return kit.mix(add[bounds[1:]] - add[bounds[:-1]]).view(np.int64), (two[bounds[1:]] - two[bounds[:-1]]).view(np.int64)


def surviving(x: np.ndarray, y: np.ndarray, same: bool):
    """Blocks (i, j) of pairs whose values pass every step; of i < j only if x and y are the same."""
    rows = max(1, (4 << 20) // max(1, len(y) * STEPS[0]))
    for lo in range(0, len(x), rows):
        some = x[lo : lo + rows]
        hits = np.zeros((len(some), len(y)), np.uint8)
        for c in range(STEPS[0]):
            hits += some[:, c, None] == y[None, :, c]
        i, j = np.nonzero(hits >= NEED[0])
        i, got = i + lo, hits[i, j].astype(np.int16)
        if same:
            keep = i < j
            i, j, got = i[keep], j[keep], got[keep]
        for a, b, need in zip(STEPS, STEPS[1:], NEED[1:]):
            more = np.empty(len(i), np.int16)
            for p in range(0, len(i), 1 << 16):
                q = slice(p, p + (1 << 16))
                more[q] = (x[i[q], a:b] == y[j[q], a:b]).sum(1)
            got = got + more
            keep = got >= need
            i, j, got = i[keep], j[keep], got[keep]
        if len(i):
            yield i, j


def forest(i: np.ndarray, j: np.ndarray, up: np.ndarray) -> list[tuple[int, int]]:
    """Adds pairs to the union-find array `up`; the pairs that joined two trees."""
    out = []

    def top(v):
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    # Most pairs of a dense group join nothing; those are dropped in bulk.
    while len(i):
        flat = up
        while not np.array_equal(nxt := flat[flat], flat):
            flat = nxt
        up[:] = flat
        keep = flat[i] != flat[j]
        i, j = i[keep], j[keep]
        for a, b in zip(i[:256].tolist(), j[:256].tolist()):
            ra, rb = top(a), top(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        i, j = i[256:], j[256:]
    return out


def overlaps(i: np.ndarray, j: np.ndarray, bounds: np.ndarray, where: np.ndarray, vocabulary: int) -> np.ndarray:
    """Sizes of the common parts of sets; where: the shingles' numbers, of each set between its bounds."""
    out = np.zeros(len(i), np.int64)
    if len(i) <= 4 * len(bounds):
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            p, q = where[bounds[a] : bounds[a + 1]], where[bounds[b] : bounds[b + 1]]
            out[k] = len(p) + len(q) - len(np.union1d(p, q))
        return out
    owner, wide = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), 1 << 14
    for lo in range(0, vocabulary, wide):
        inside = (where >= lo) & (where < lo + wide)
        bits = np.zeros((len(bounds) - 1, wide), bool)
        bits[owner[inside], where[inside] - lo] = True
        packed = np.packbits(bits[:, : -(-min(wide, vocabulary - lo) // 64) * 64], axis=1).view(np.uint64)
        step = max(1, (1 << 22) // packed.shape[1])
        for p in range(0, len(i), step):
            q = slice(p, p + step)
            out[q] += np.bitwise_count(packed[i[q]] & packed[j[q]]).sum(1, dtype=np.int64)
    return out


def _groups_of(table: pa.Table, *names: str):
    """Row numbers of each combination of these columns."""
    cols = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(cols)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)
    edges = np.flatnonzero(new).tolist()
    return order, edges, [*edges[1:], len(order)]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in col), np.uint16).reshape(-1, HASHES)


def _small_pairs(order: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """All pairs of rows inside groups of few rows, some groups at a time."""
    size = hi - lo
    many = size * (size - 1) // 2
    ends = np.cumsum(many)
    k = 0
    while k < len(lo):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 17), "right")))
        i, j = [], []
        for n in np.unique(size[k:stop]).tolist():
            at = lo[k:stop][size[k:stop] == n]
            x, y = np.triu_indices(n, 1)
            i.append((at[:, None] + x).ravel())
            j.append((at[:, None] + y).ravel())
        yield order[np.concatenate(i)], order[np.concatenate(j)]
        k = stop


def _passing(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of given pairs those that pass every step."""
    got, start = np.zeros(len(i), np.int16), 0
    for stop, need in zip(STEPS, NEED):
        got = got + (sig[i, start:stop] == sig[j, start:stop]).sum(1).astype(np.int16)
        keep = got >= need
        i, j, got, start = i[keep], j[keep], got[keep], stop
    return i, j


SMALL = 48  # rows of a group whose pairs are listed (in memory) together with those of other groups


def _roots(up: np.ndarray, v: np.ndarray) -> np.ndarray:
    r = up[v]
    while not np.array_equal(r, n := up[r]):
        r = n
    return r


def _large_bucket(sig: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool, up: np.ndarray) -> list:
    """Edges that join what is similar between rows x and y.

    Rows that are in one tree need no comparison, so a few leaders are compared
    with all first; in a dense group that leaves few pairs.  Then every pair is
    compared but those within the largest tree.
    """
    out, every = [], x if same else np.concatenate([x, y])
    for _ in range(4):
        tree = _roots(up, node[every])
        names, size = np.unique(tree, return_counts=True)
        rest = np.flatnonzero(tree != names[np.argmax(size)]) if size.max() > 1 else np.arange(len(every))
        if not len(rest):
            return out
        lead = every[rest[:1]]
        other = every if same else y if np.any(x == lead[0]) else x
        for i, j in surviving(sig[lead], sig[other], False):
            keep = node[other[j]] != node[lead[0]]
            out += forest(np.full(int(keep.sum()), node[lead[0]]), node[other[j[keep]]], up)
    tree = _roots(up, node[every])
    names, size = np.unique(tree, return_counts=True)
    largest = names[np.argmax(size)]
    a, b = x[_roots(up, node[x]) != largest], y[_roots(up, node[y]) != largest]
    inner = x[_roots(up, node[x]) == largest]
    for left, right, own in ((a, a, True), (a, y[_roots(up, node[y]) == largest], False)) if same else ((a, y, False), (inner, b, False)):
        if len(left) and len(right):
            for i, j in surviving(sig[left], sig[right], own):
                out += forest(node[left[i]], node[right[j]], up)
    return out


def _bucket_edges(t: pa.Table) -> pa.Table:
    """Edges that join what is similar in each bucket: of every tree, its least class with each of the others."""
    sig, cid, part = _matrix(t.column("sig")), t.column("cid").to_numpy(), t.column("part").to_numpy()
    order, lo, hi = _groups_of(t, "p", "q", "bucket")
    lo, hi = np.array(lo), np.array(hi)
    # Rows of one class in several buckets count as one node.
    nodes, node = np.unique(cid, return_inverse=True)
    up, out = np.arange(len(nodes)), []
    small = (hi - lo <= SMALL) & (t.column("p").to_numpy()[order[lo]] == t.column("q").to_numpy()[order[lo]])
    for i, j in _small_pairs(order, lo[small], hi[small]):
        i, j = _passing(sig, i, j)
        out += forest(node[i], node[j], up)
    for a, b in zip(lo[~small].tolist(), hi[~small].tolist()):
        rows = order[a:b]
        p, q = t.column("p")[int(rows[0])].as_py(), t.column("q")[int(rows[0])].as_py()
        x, y = rows[part[rows] == p], rows[part[rows] == q]
        out += _large_bucket(sig, node, x, y, p == q, up)
    top = _roots(up, up)
    some = np.flatnonzero(top != np.arange(len(top)))
    return pa.table({"a": nodes[some].astype(np.int64), "b": nodes[top[some]].astype(np.int64)})


def _family_links(t: pa.Table) -> pa.Table:
    """Rows (a, b, n): n documents are linked to class a (b null), or classes a and b are linked (n 0; a forest)."""
    sig, cid = _matrix(t.column("sig")), t.column("cid").to_numpy()
    many, part = t.column("many").to_numpy(), t.column("part").to_numpy()
    shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
    order, starts, stops = _groups_of(t, "p", "q", "comp")
    a_, b_, n_ = [], [], []
    for lo, hi in zip(starts, stops):
        rows = order[lo:hi]
        raw = [shingles[k] for k in rows]
        p, q = t.column("p")[int(rows[0])].as_py(), t.column("q")[int(rows[0])].as_py()
        if len(raw) == 2 and p == q:
            x, y = raw
            common = len(x) + len(y) - len(np.union1d(x, y)) if NUM * max(len(x), len(y)) <= DEN * min(len(x), len(y)) else 0
            if DEN * common >= NUM * (len(x) + len(y) - common):
                a_ += [cid[rows[0]], cid[rows[1]], cid[rows[0]]]
                b_ += [None, None, cid[rows[1]]]
                n_ += [many[rows[1]], many[rows[0]], 0]
            continue
        own, weight = cid[rows], many[rows]
        bounds = np.cumsum([0, *map(len, raw)])
        size = np.diff(bounds)
        _, where, held = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        where = where.astype(np.int32)
        # Shingles that only one member has add to no common part.
        shared = held > 1
        keep = shared[where]
        where, bounds = (np.cumsum(shared) - 1)[where[keep]], np.concatenate([[0], np.cumsum(keep)])[bounds]
        x, y = np.flatnonzero(part[rows] == p), np.flatnonzero(part[rows] == q)
        links, up = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, j in surviving(sig[rows[x]], sig[rows[y]], p == q):
            i, j = x[i], y[j]
            # Sizes alone rule out many.
            near = NUM * np.maximum(size[i], size[j]) <= DEN * np.minimum(size[i], size[j])
            i, j = i[near], j[near]
            common = overlaps(i, j, bounds, where, int(shared.sum()))
            linked = DEN * common >= NUM * (size[i] + size[j] - common)
            i, j = i[linked], j[linked]
            links += np.bincount(i, weight[j], len(rows)).astype(np.int64) + np.bincount(j, weight[i], len(rows)).astype(np.int64)
            for a, b in forest(i, j, up):
                a_.append(own[a])
                b_.append(own[b])
                n_.append(0)
        some = np.flatnonzero(links)
        a_ += own[some].tolist()
        b_ += [None] * len(some)
        n_ += links[some].tolist()
    return pa.table({"a": pa.array(a_, pa.int64()), "b": pa.array(b_, pa.int64()), "n": pa.array(n_, pa.int64())})


LOT_BYTES = 4 << 20  # of rows that one call works on


def _lots(members: DataFrame, group: str, size) -> int:
    """How many lots hold a group's rows, with all copies that its pieces make; size: bytes of a row."""
    per = members.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("b")).where("n > 1")
    total = per.agg(F.sum(F.col("b") * F.ceil(F.col("n") / PIECE))).first()[0] or 0
    return int(total // LOT_BYTES) + 1


def _lot(lots: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(lots)).alias("lot")


def _piece(cid: str, pieces) -> F.Column:
    return F.pmod(F.xxhash64(cid, F.lit(7)), pieces).cast("int")


def _pieces(members: DataFrame, group: str, cid: str = "cid") -> DataFrame:
    """Rows of groups of two or more, with piece pairs (p, q) and part, the row's own piece.

    A group of up to PIECE rows is one piece; a larger one has as many as it needs, and its rows go to each pair that has their piece.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("__n")).where("__n > 1").withColumn("__m", F.ceil(F.col("__n") / PIECE).cast("int"))
    rows = members.join(sizes, group).withColumn("part", _piece(cid, F.col("__m"))).drop("__n")
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    return rows.withColumn("p", F.least("part", "__o")).withColumn("q", F.greatest("part", "__o")).drop("__m", "__o")


def _alone(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of buckets of two or more, each in its own piece only; and of buckets of several pieces, a leader of each piece once more, in groups of leaders."""
    sizes = sizes.withColumn("__m", F.ceil(F.col("__n") / PIECE).cast("int"))
    rows = members.join(sizes, "bucket").withColumn("part", _piece("cid", F.col("__m")))
    # Few buckets are that large; their rows are looked for among all once more.
    large = members.join(sizes.where("__m > 1"), "bucket").withColumn("part", _piece("cid", F.col("__m")))
    leaders = large.groupBy("bucket", "part", "__m").agg(F.min("cid").alias("cid"))
    leaders = leaders.withColumn("part", -1 - F.pmod(F.xxhash64("cid"), F.ceil(F.col("__m") / PIECE)).cast("int"))
    rows = rows.select("bucket", "cid", "part").unionByName(leaders.select("bucket", "cid", "part"))
    return rows.withColumn("p", F.col("part")).withColumn("q", F.col("part"))


def _rest(members: DataFrame, sizes: DataFrame, stars: DataFrame) -> DataFrame:
    """Of buckets of several pieces, the pairs of pieces that must still meet.

    Rows that are known to be in the bucket's largest tree need not meet one
    another; the others meet each other and all of those.  What is known: a
    row's least neighbour, and that one's, as leaders are the least of a piece.
    """
    up = stars.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("__b"))
    far = up.select(F.col("__a").alias("__c"), F.col("__b").alias("__d"))
    rows = members.join(sizes.where(F.col("__n") > PIECE).select("bucket"), "bucket")
    rows = rows.join(up, F.col("cid") == F.col("__a"), "left").join(far, F.col("__b") == F.col("__c"), "left")
    rows = rows.withColumn("comp", F.coalesce("__d", "__b", "cid")).drop("__a", "__b", "__c", "__d")
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("all"))
    main = main.select("bucket", F.col("x.comp").alias("__main"), F.ceil(F.col("x.n") / PIECE).cast("int").alias("__m"), F.ceil((F.col("all") - F.col("x.n")) / PIECE).cast("int").alias("__r")).where("__r > 0")
    rows = rows.join(main, "bucket").withColumn("__in", F.col("comp") == F.col("__main"))
    inner = rows.where("__in").withColumn("part", -1 - _piece("cid", F.col("__m"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("__r") - 1)))
    outer = rows.where("not __in").withColumn("part", _piece("cid", F.col("__r"))).withColumn("q", F.explode(F.sequence(-F.col("__m"), F.col("__r") - 1)))
    both = inner.unionByName(outer).select("bucket", "cid", "part", F.least("part", "q").alias("p"), F.greatest("part", "q").alias("q"))
    return both


def describe(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, two keys of the shingle set, its size and MinHash values, and a hash of the text, of every row; stored."""
    ddl, _ = kit.id_types(docs, key)
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("__text"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("tkey"))

    def run(batches):
        for batch in batches:
            for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                s, bounds = sets(kit.Texts(part.column("__text")))
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sig = np.zeros((len(n), HASHES), np.uint16)
                if len(full):
                    sig[full] = signatures(s, np.append(bounds[:-1][full], bounds[-1]))
                one, two = keys(s, bounds)
                cols = [part.column("doc_id"), pa.array(one), pa.array(two), pa.array(n.astype(np.int64)), part.column("tkey"), pa.array([sig[i].tobytes() if n[i] else None for i in range(len(n))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "cid", "cid2", "n", "tkey", "sig"])

    return kit.stored(rows.mapInArrow(kit.trimmed(run), f"doc_id {ddl}, cid long, cid2 long, n long, tkey long, sig binary"))


def _groups(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, tkey, n_shingles, class_id, n_links of every row, and the tkey of the group's first document."""
    rows = describe(docs, text, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey"))
    classes = rows.where("n > 0").groupBy("cid", "cid2").agg(F.count("*").alias("many"), first.alias("rep"), F.first("sig").alias("sig"))
    # A class is known by one number, which must be its own.
    salt, keyed = 0, kit.stored(classes.withColumnRenamed("cid", "cid1"))
    while True:
        classes = keyed.withColumn("cid", F.xxhash64("cid1", "cid2", F.lit(salt)))
        n_classes, n_keys = classes.agg(F.count("*"), F.countDistinct("cid")).first()
        if n_classes == n_keys:
            break
        salt += 1
    # Bands: four 16-bit values each.
    values = F.hex("sig")
    bands = classes.select("cid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring(values, b * 4 * ROWS + 1, F.lit(4 * ROWS)))).alias("band", "v"))
    bands = bands.select("cid", F.xxhash64("band", "v").alias("bucket"))
    signed = classes.select("cid", "sig")

    def edges(meeting: DataFrame, lots: int) -> DataFrame:
        return meeting.join(signed, "cid").groupBy(_lot(lots, "bucket", "p", "q")).applyInArrow(kit.one(_bucket_edges), "a long, b long")

    # Buckets are worked on in lots, so that small ones cost little.
    lots = n_classes * BANDS // 40_000 + 1
    sizes = kit.stored(bands.groupBy("bucket").agg(F.count("*").alias("__n")).where("__n > 1"))
    if sizes.where(F.col("__n") > PIECE).isEmpty():
        first = edges(bands.join(sizes.select("bucket"), "bucket").select("bucket", "cid", *(F.lit(0).alias(c) for c in ("part", "p", "q"))), lots)
    else:
        first = kit.stored(edges(_alone(bands, sizes), lots))
        rest = kit.stored(_rest(bands, sizes, first))
        first = first.unionByName(edges(rest, rest.count() // 40_000 + 1))
    families = kit.stored(components(first).withColumnRenamed("node", "cid").join(classes.drop("cid1", "cid2"), "cid"))

    def shingled(batches):
        for batch in batches:
            for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                s, b = sets(kit.Texts(part.column("__text")))
                packed = pa.array([s[i:j].tobytes() for i, j in zip(b[:-1].tolist(), b[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cid", "comp", "many", "sig")), packed], names=["cid", "comp", "many", "sig", "shingles"])

    texts = docs.select(docs[f"`{key}`"].alias("__id"), docs[f"`{text}`"].cast("string").alias("__text"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("__tkey"))
    wanted = families.join(texts, (F.col("rep.tkey") == F.col("__tkey")) & F.col("rep.doc_id").eqNullSafe(F.col("__id")))
    members = wanted.select("cid", "comp", "many", "sig", "__text").mapInArrow(kit.trimmed(shingled), "cid long, comp long, many long, sig binary, shingles binary").dropDuplicates(["cid"])
    members = kit.stored(members)
    lots = _lots(members, "comp", F.octet_length("shingles") + 300)
    found = kit.stored(_pieces(members, "comp").groupBy(_lot(lots, "comp", "p", "q")).applyInArrow(kit.one(_family_links), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null")).withColumnRenamed("node", "cid")
    named = groups.join(classes.select("cid", "rep"), "cid")
    named = named.join(named.groupBy("comp").agg(F.min("rep").alias("lead")), "comp").select("cid", "lead").join(links, "cid")
    info = classes.select("cid1", "cid2", "cid", "many", "rep").join(named, "cid", "left")
    info = kit.stored(info.select(F.col("cid1").alias("cid"), "cid2", F.coalesce("lead", "rep").alias("lead"), (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    full = rows.where("n > 0").join(info, ["cid", "cid2"]).select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("class_id"), "n_links", F.col("lead.tkey").alias("lead_tkey"))
    return full.unionByName(rows.where("n = 0").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("tkey").alias("lead_tkey")))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id (least id of the documents linked with it, directly or not), n_links and n_shingles of every row."""
    return _groups(docs, text, key).select("doc_id", "class_id", "n_links", "n_shingles")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each group of linked documents the one with the least id stays, with its columns; rows without words all stay.

    Rows that share id and text are copies too, and one of them stays.
    """
    stay = _groups(docs, text, key).where("class_id <=> doc_id and tkey = lead_tkey").groupBy("doc_id", "tkey").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    stay = kit.stored(stay)
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), docs[f"`{key}`"].alias("__id"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("__tkey"))
    kept = packed.join(stay.select("doc_id", "tkey"), F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__tkey") == F.col("tkey")), "left_semi")
    again = stay.where("rows > 1 and n > 0")
    if again.isEmpty():
        return kept.select("__row.*")
    on = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__tkey") == F.col("tkey"))
    return kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(["__id", "__tkey"])).select("__row.*")
