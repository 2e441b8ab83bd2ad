"""Benchmark decontamination: spaced-seed hashing.

Fixed masks choose some of a few successive words; the rest may differ.  The
hashes of the chosen words of every benchmark item are joined with those of
every text position, and around each hit the words of text and item are laid
side by side on that diagonal.  The best stretch (1 for an equal word, -2 for
another) must have enough equal words.

The benchmark is sent to the executors in blocks of at most `block_words`
words, so what is broadcast has a fixed bound; a larger benchmark takes further
passes over the texts, none of which shuffles them.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased (A-Z),
so punctuation and case do not hide a passage.

A seed that occurs at even distances (a word said over and over) counts as one
run on either side, so that equal runs cost their lengths and not the product.

Defined cases: null and empty texts or items match nothing; an item with fewer
than `least` words must match whole, and one shorter than the shortest mask is
searched by one hash of all its words; repeated rows are judged alike; ids keep
their type, null ones too; an empty benchmark leaves all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit

MASKS = ("11111", "1101101", "11010011", "1011001001")
LEAST, MISS = 12, 2


def seeds(h: np.ndarray, doc: np.ndarray):
    """For each mask: hashes of its chosen words at each position where it fits in one text, and the positions."""
    for m, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        with np.errstate(over="ignore"):
            s = np.full(n, m + 1, np.uint64)
            for j, c in enumerate(mask):
                if c == "1":
                    s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
        yield kit.mix(s[at]), at


def tokens(col: pa.Array) -> tuple[kit.Texts, np.ndarray]:
    t = kit.Texts(col).words(kit.LOOSE)
    return t, t.hashes(kit.lower_ascii(t.buf))


def short(h: np.ndarray, doc: np.ndarray, first: np.ndarray, sizes: set, whole: bool):
    """Hashes of so many words in a row, for items shorter than the shortest mask; whole: of whole texts only."""
    for n in sorted(sizes):
        if n > len(h):
            continue
        with np.errstate(over="ignore"):
            s = np.full(len(h) - n + 1, 100 + n, np.uint64)
            for j in range(n):
                s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(s)]
        at = first[:-1][np.diff(first) == n] if whole else np.flatnonzero(doc[: len(s)] == doc[n - 1 :])
        yield kit.mix(s[at]), at


def runs(seed: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple:
    """Places of each seed in each text as even runs: seed, text, first place, how many, distance; sorted by seed."""
    order = np.lexsort((at, doc, seed))
    seed, doc, at = seed[order], doc[order], at[order]
    gap = np.diff(at, prepend=0)
    new = np.ones(len(at), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
    gap[new] = 0
    # A run goes on while the distance stays the same; a second place sets it.
    cut = new.copy()
    cut[2:] |= ~new[2:] & ~new[1:-1] & (gap[2:] != gap[1:-1])
    lead = np.flatnonzero(cut)
    n = np.diff(np.append(lead, len(at)))
    apart = np.where(n > 1, gap[np.minimum(lead + 1, max(0, len(at) - 1))], 0) if len(at) else n
    return seed[lead], doc[lead], at[lead], n, apart


def index(ids: list, texts: list) -> dict:
    """A block of the benchmark, ready to be joined: runs of seeds, sorted by hash, and the items' words."""
    t, h = tokens(pa.array(texts, pa.string()))
    size = np.diff(t.first)
    sizes = {int(n) for n in size if 0 < n < min(map(len, MASKS))}
    found = [*seeds(h, t.doc), *short(h, t.doc, t.first, sizes, True)]
    s = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
    at = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
    seed, doc, at, n, gap = runs(s, t.doc[at], at)
    return {"seed": seed, "at": at, "n": n, "gap": gap, "words": h, "first": t.first, "doc": doc, "ids": ids, "sizes": sizes}


CELLS = 1 << 18  # words laid side by side, or hits looked at, at once


def promising(h: np.ndarray, words: np.ndarray, here: np.ndarray, there: np.ndarray, text: tuple, item: tuple, mask: str, need: np.ndarray) -> np.ndarray:
    """Whether a stretch around each hit may have enough equal words; here and there: its first words, text and item: (first word, end) of each.

    Both ends are followed word by word, each until what is lost there outweighs the hit and what the other end has
    brought, or the words are enough. A chance hit is given up after three words on either side.
    """
    free = np.flatnonzero(np.array(list(mask)) == "0")
    equal = mask.count("1") + (h[here[:, None] + free] == words[there[:, None] + free]).sum(1)
    ok, row = np.zeros(len(here), bool), np.arange(len(here))
    off, score, gain, ended = np.zeros((2, len(row)), np.int64), np.zeros((2, len(row)), np.int64), np.zeros((2, len(row)), np.int64), np.zeros((2, len(row)), bool)
    while len(row):
        moved = np.zeros(len(row), bool)
        for side in (0, 1):
            k = np.flatnonzero(~ended[side] & (score[side] + gain[1 - side] + mask.count("1") > 0))
            off[side, k] += 1
            step = off[side, k] + (len(mask) - 1) if side else -off[side, k]
            x, y, r = here[row[k]] + step, there[row[k]] + step, row[k]
            inside = (x >= text[0][r]) & (x < text[1][r]) & (y >= item[0][r]) & (y < item[1][r])
            ended[side, k[~inside]] = True
            k = k[inside]
            same = h[x[inside]] == words[y[inside]]
            equal[row[k]] += same
            score[side, k] += np.where(same, 1, -MISS)
            gain[side, k] = np.maximum(gain[side, k], score[side, k])
            moved[k] = True
        enough = equal[row] >= need[row]
        ok[row[enough]] = True
        stays = moved & ~enough
        row, off, score, gain, ended = row[stays], off[:, stays], score[:, stays], gain[:, stays], ended[:, stays]
    return ok


DEPTH = 8  # words on either side of a hit that are looked at for all hits alike


def chance(h: np.ndarray, words: np.ndarray, here: np.ndarray, there: np.ndarray, mask: str, need: np.ndarray) -> np.ndarray:
    """Hits that `promising` would give up within a few words of either side, found for many at once.

    Words beyond a text's or an item's bounds are compared too; at worst they let a hit stay.
    """
    size, ones = len(here), mask.count("1")
    free = [j for j, c in enumerate(mask) if c == "0"]
    equal = np.full(size, ones, np.int8)
    for j in free:
        equal += h.take(here + j, mode="clip") == words.take(there + j, mode="clip")
    sides = [[h.take(here + o, mode="clip") == words.take(there + o, mode="clip") for o in offs] for offs in (range(-1, -DEPTH - 1, -1), range(len(mask), len(mask) + DEPTH))]

    def follow(same: list, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(most that is gained, equal words passed, whether the way ended)"""
        going, score, gain, passed = np.ones(size, bool), np.zeros(size, np.int8), np.zeros(size, np.int8), np.zeros(size, np.int8)
        for x in same:
            score += np.where(x, 1, -MISS).astype(np.int8)
            passed += x & going
            gain = np.where(going, np.maximum(gain, score), gain)
            going &= score + budget > 0
        return gain, passed, ~going

    left, _, _ = follow(sides[0], np.full(size, ones, np.int8))
    right, more, ended = follow(sides[1], left + np.int8(ones))
    again, less, over = follow(sides[0], right + np.int8(ones))
    return ended & over & (again == left) & (equal + more + less < need)


def _diagonals(t: kit.Texts, h: np.ndarray, ix: dict, least: int):
    """Rows (text, item, text's word that the item's first word lies on) that share a seed and may share enough words; some rows come again."""
    doc = t.doc
    masks = [m for m in MASKS if len(m) <= len(h)] + ["1" * n for n in sorted(ix["sizes"]) if n <= len(h)]
    for mask, (s, at) in zip(masks, [*seeds(h, doc), *short(h, doc, t.first, ix["sizes"], False)], strict=True):
        lo = np.searchsorted(ix["seed"], s, "left")
        hit = lo < len(ix["seed"])
        hit[hit] = ix["seed"][lo[hit]] == s[hit]
        if not hit.any():
            continue
        seed, d, a, n, gap = runs(s[hit], doc[at[hit]], at[hit])
        lo, hi = np.searchsorted(ix["seed"], seed, "left"), np.searchsorted(ix["seed"], seed, "right")
        # Pairs of runs are made in lots too: a seed may have very many on both sides.
        pairs = np.cumsum(hi - lo)
        p = 0
        while p < len(seed):
            q = max(p + 1, int(np.searchsorted(pairs, (pairs[p - 1] if p else 0) + CELLS, "right")))
            yield from _lots(t, h, ix, least, mask, lo[p:q], hi[p:q], d[p:q], a[p:q], n[p:q], gap[p:q])
            p = q


def _good(t: kit.Texts, h: np.ndarray, ix: dict, least: int, mask: str, texts: np.ndarray, items: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which hits (first words x in a text and y in an item) may lie in a stretch with enough equal words."""
    first, last = ix["first"][items], ix["first"][items + 1]
    need = np.minimum(least, last - first)
    good = ~chance(h, ix["words"], x, y, mask, need)
    k = np.flatnonzero(good)
    good[k] = promising(h, ix["words"], x[k], y[k], (t.first[texts[k]], t.first[texts[k] + 1]), (first[k], last[k]), mask, need[k])
    return good


def _lots(t: kit.Texts, h: np.ndarray, ix: dict, least: int, mask: str, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, a: np.ndarray, n: np.ndarray, gap: np.ndarray):
    """Diagonals of some runs of a seed in the texts, each with all runs lo to hi of the items."""
    mine = np.repeat(np.arange(len(lo)), hi - lo)
    theirs = np.repeat(lo, hi - lo) + np.arange(len(mine)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    m, there = ix["n"][theirs], ix["at"][theirs]
    item = ix["doc"][theirs]
    base = a[mine] - (there - ix["first"][item])
    n, gap, other = n[mine], gap[mine], ix["gap"][theirs]
    even = (n > 1) & (m > 1) & (gap == other)
    # Differences of two even runs: as many as both have, less one; of others, each with each.
    many = np.where(even, n + m - 1, n * m)
    ones = np.flatnonzero(many == 1)
    for p in range(0, len(ones), CELLS):
        r = ones[p : p + CELLS]
        x, y = a[mine[r]], there[r]
        if "0" not in mask:  # one hit of a run of equal words is enough
            begins = (h.take(x - 1, mode="clip") != ix["words"].take(y - 1, mode="clip")) | (x == t.first[d[mine[r]]]) | (y == ix["first"][item[r]])
            r, x, y = r[begins], x[begins], y[begins]
        r = r[_good(t, h, ix, least, mask, d[mine[r]], item[r], x, y)]
        if len(r):
            yield np.unique(np.stack([d[mine[r]], item[r], base[r]], 1), axis=0)
    rest = np.flatnonzero(many > 1)
    mine, m, there, item, base, n, gap, other, even, many = (v[rest] for v in (mine, m, there, item, base, n, gap, other, even, many))
    ends = np.cumsum(many)
    k = 0
    while k < len(many):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CELLS, "right")))
        # A pair of runs that is a lot by itself may be of any size, so it is cut too.
        begin, total = (ends[k - 1] if k else 0), ends[stop - 1] - (ends[k - 1] if k else 0)
        for part in range(0, int(total), CELLS):
            at = np.arange(part, min(int(total), part + CELLS))
            row = k + np.searchsorted(ends[k:stop] - begin, at, "right")
            j = at - (ends[row] - many[row] - begin)
            step = np.where(even[row], (j - (m[row] - 1)) * gap[row], (j // m[row]) * gap[row] - (j % m[row]) * other[row])
            single = np.flatnonzero(~even[row])
            r = row[single]
            x, y = a[mine[r]] + (j[single] // m[r]) * gap[r], there[r] + (j[single] % m[r]) * other[r]
            good = even[row]
            good[single] = _good(t, h, ix, least, mask, d[mine[r]], item[r], x, y)
            row, step = row[good], step[good]
            found = np.stack([d[mine[row]], item[row], base[row] + step], 1)
            if len(found):
                yield np.unique(found, axis=0)
        k = stop


def matches(col: pa.Array, ix: dict, least: int = LEAST) -> dict[str, np.ndarray]:
    """Best stretch of every pair of text and item that has enough equal words: text, item, n_match, n_span, text_word, item_word."""
    t, h = tokens(col)
    pairs = np.concatenate([np.zeros((0, 3), np.int64), *_diagonals(t, h, ix, least)])
    pairs = np.unique(pairs, axis=0)
    # Only where both lie is looked at, so a pair costs no more than the shorter of the two.
    size = ix["first"][pairs[:, 1] + 1] - ix["first"][pairs[:, 1]]
    low = np.maximum(0, t.first[pairs[:, 0]] - pairs[:, 2])
    wide = np.minimum(size, t.first[pairs[:, 0] + 1] - pairs[:, 2]) - low
    order = np.argsort(wide, kind="stable")
    pairs, size, low, wide = pairs[order], size[order], low[order], wide[order]
    out, p = [], 0
    while p < len(pairs):
        # Rows of like width; the last is the widest.
        q = min(len(pairs), p + max(1, CELLS // int(wide[min(len(pairs) - 1, p + CELLS // int(wide[p]))])))
        (d, item, start), w = pairs[p:q].T, int(wide[q - 1])
        col_ = np.arange(w)[None, :]
        inside = col_ < wide[p:q, None]
        there = np.minimum((ix["first"][item] + low[p:q])[:, None] + col_, len(ix["words"]) - 1)
        here = np.minimum((start + low[p:q])[:, None] + col_, len(h) - 1)
        equal = inside & (ix["words"][there] == h[here])
        score = np.zeros((q - p, w + 1), np.int32)
        np.cumsum(np.where(equal, 1, np.where(inside, -MISS, 0)), axis=1, out=score[:, 1:])
        base = np.minimum.accumulate(score[:, :-1], axis=1)
        end = np.argmax(np.where(inside, score[:, 1:] - base, -(1 << 20)), axis=1)
        masked = np.where(np.arange(w + 1)[None, :] <= end[:, None], score, 1 << 30)
        begin = w - np.argmin(masked[:, ::-1], axis=1)
        sums = np.zeros((q - p, w + 1), np.int32)
        np.cumsum(equal, axis=1, out=sums[:, 1:])
        row = np.arange(q - p)
        n = sums[row, end + 1] - sums[row, begin]
        good = n >= np.minimum(least, size[p:q])
        begin_ = begin + low[p:q]
        out.append(np.stack([d, item, n, end + 1 - begin, start + begin_ - t.first[d], begin_], 1)[good])
        p = q
    rows = np.concatenate([np.zeros((0, 6), np.int64), *out])
    rows = rows[np.lexsort((rows[:, 4], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return dict(zip(("text", "item", "n_match", "n_span", "text_word", "item_word"), rows[new].T))


def blocks(bench: DataFrame, text: str, key: str, block_words: int):
    """The benchmark's items, in turn, as indexes of at most block_words words (a longer item stands alone)."""
    ids, texts, size = [], [], 0
    for i, x in bench.select(bench[f"`{key}`"], bench[f"`{text}`"].cast("string")).toLocalIterator():
        n = len(tokens(pa.array([x], pa.string()))[0].ws)
        if ids and size + n > block_words:
            yield index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(x)
        size += n
    if ids:
        yield index(ids, texts)


def find(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", bench_text: str = "text", bench_key: str = "item_id", least: int = LEAST, block_words: int = 1_000_000) -> DataFrame:
    """A row for each pair of document and item that share a passage: doc_id, item_id, n_match (equal words), n_span (words of the stretch), doc_word and item_word (where it begins)."""
    spark = docs.sparkSession
    (ddl, arrow), (item_ddl, item_arrow) = kit.id_types(docs, key), kit.id_types(bench, bench_key)
    source = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("__text"))
    schema = f"doc_id {ddl}, item_id {item_ddl}, n_match long, n_span long, doc_word long, item_word long"
    out = None
    for ix in blocks(bench, bench_text, bench_key, block_words):
        if out is not None:
            out = kit.stored(out)  # one block at a time in the executors' memory
        sent = spark.sparkContext.broadcast(ix)

        def run(batches, sent=sent):
            for batch in batches:
                for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                    m = matches(part.column("__text"), sent.value, least)
                    items = pa.array([sent.value["ids"][i] for i in m["item"].tolist()], item_arrow)
                    cols = [part.column("doc_id").take(pa.array(m["text"])), items, *(pa.array(m[c]) for c in ("n_match", "n_span", "text_word", "item_word"))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "n_match", "n_span", "doc_word", "item_word"])

        found = source.mapInArrow(kit.trimmed(run), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def report(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", bench_text: str = "text", bench_key: str = "item_id", least: int = LEAST, block_words: int = 1_000_000) -> DataFrame:
    """A row for each document that shares a passage with an item: doc_id, n_items (how many items), and the longest match: item_id, n_match, n_span, doc_word, item_word.

    However many copies of a passage documents and items hold, there is a row for a document and none for a pair.
    """
    spark = docs.sparkSession
    (ddl, arrow), (item_ddl, item_arrow) = kit.id_types(docs, key), kit.id_types(bench, bench_key)
    numbers = ("n_items", "n_match", "n_span", "doc_word", "item_word")
    names = ["doc_id", "__text", "item_id", *numbers]
    schema = f"doc_id {ddl}, __text string, item_id {item_ddl}, " + ", ".join(f"{c} long" for c in numbers)
    zero = [F.lit(0).cast("long").alias(c) for c in numbers]
    out = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("__text"), F.lit(None).cast(item_ddl).alias("item_id"), *zero)
    for k, ix in enumerate(blocks(bench, bench_text, bench_key, block_words)):
        sent = spark.sparkContext.broadcast(ix)
        if k:
            out = kit.stored(out)  # one block at a time in the executors' memory

        def run(batches, sent=sent):
            for batch in batches:
                for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                    m = matches(part.column("__text"), sent.value, least)
                    was = {c: part.column(c).to_numpy().copy() for c in numbers}
                    np.add.at(was["n_items"], m["text"], 1)
                    order = np.lexsort((m["item"], -m["n_match"], m["text"]))
                    lead = order[np.unique(m["text"][order], return_index=True)[1]]
                    lead = lead[m["n_match"][lead] > was["n_match"][m["text"][lead]]]
                    at, ids = m["text"][lead], part.column("item_id").to_pylist()
                    for i, j in zip(at.tolist(), m["item"][lead].tolist()):
                        ids[i] = sent.value["ids"][j]
                    for c, d in (("n_match", "n_match"), ("n_span", "n_span"), ("doc_word", "text_word"), ("item_word", "item_word")):
                        was[c][at] = m[d][lead]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__text"), pa.array(ids, item_arrow), *(pa.array(was[c]) for c in numbers)], names=names)

        out = out.mapInArrow(kit.trimmed(run), schema)
    return out.where("n_items > 0").drop("__text")


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", bench_key: str = "item_id", least: int = LEAST, block_words: int = 1_000_000) -> DataFrame:
    """The rows that share no passage with any item, with their columns; nothing is shuffled."""
    spark = docs.sparkSession
    out = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), docs[f"`{text}`"].cast("string").alias("__text"))
    for k, ix in enumerate(blocks(bench, bench_text, bench_key, block_words)):
        sent = spark.sparkContext.broadcast(ix)
        if k:
            out = kit.stored(out)  # one block at a time in the executors' memory

        def run(batches, sent=sent):
            for batch in batches:
                for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                    stays = np.ones(part.num_rows, bool)
                    stays[matches(part.column("__text"), sent.value, least)["text"]] = False
                    yield part.filter(pa.array(stays))

        out = out.mapInArrow(kit.trimmed(run), out.schema)
    return out.select("__row.*")
