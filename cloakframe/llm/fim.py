"""Fill-in-middle: texts cut in three and put together with the middle last.

A Split pre-tokenizer of the tokenizers library, whose expression matches any
one code point and isolates it, gives the code-point offsets of a text; nothing
is trained.  The length of the offset array is n, and the offset of a rank is
where a slice begins.  The array of a text is that of its pieces (words with
the white space behind them, of bounded length), one behind the other: a piece
is split once a batch however often it occurs, and only the two pieces that the
cuts fall in are looked up by rank.  No shuffle; memory follows the windows of
a text, not the text.

Cuts and forms are drawn from the SHA-256 of the seed and the row's key, so
they do not depend on partitions.

Defined cases: a null text is empty; an empty text, one that holds a sentinel,
and one outside the rate are plain, and their lengths are null; a null key
draws as the empty one; rows equal in key and text come out alike; all columns
of the input stay, but for those that a result column replaces, whatever their
case; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm import kit

SENTINELS = ("<P>", "<S>", "<M>")
WINDOW, KNOWN, TOGETHER = 1 << 18, 1 << 20, 256  # code points looked at at once; pieces remembered, after which it begins anew; pieces split at once
NONE = 0xFFFFFFFF  # in place of the second code point of a piece that has one


class Offsets:
    """Code-point offsets of texts by the Split pre-tokenizer. A piece is a number: its code points, the first one lowest."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self._split = pre_tokenizers.Split(Regex(r"[\s\S]"), "isolated")
        self._known: dict[int, int] = {}
        self._last: tuple[str, np.ndarray] = "", np.zeros(0, np.int64)

    def of(self, text: str) -> list[tuple[int, int]]:
        """(from, to) of each code point of a text."""
        return [at for _, at in self._split.pre_tokenize_str(text)]

    def _learn(self, pieces: list[int]) -> None:
        """Lengths of the offset arrays of pieces, many of which are split as one text."""
        if len(self._known) >= KNOWN:
            self._known.clear()
        for i in range(0, len(pieces), TOGETHER):
            some = [chr(p & NONE) + (chr(p >> 32) if p >> 32 != NONE else "") for p in pieces[i : i + TOGETHER]]
            begins = [a for a, _ in self.of("".join(some))]
            edges = [bisect_left(begins, x) for x in accumulate(map(len, some))]
            self._known.update(zip(pieces[i : i + TOGETHER], (b - a for a, b in zip([0, *edges], edges))))

    def edges(self, window: str) -> np.ndarray:
        """Of each piece of a window, the length of the offset array up to its end."""
        if window is not self._last[0]:
            points = np.frombuffer(window.encode("utf-32-le"), np.uint32)
            points = np.append(points, np.uint32(NONE)) if len(points) % 2 else points
            pieces, at = np.unique(points.view(np.uint64), return_inverse=True)
            pieces = pieces.tolist()
            new = [p for p in pieces if p not in self._known]
            if new:
                self._learn(new)
                if not all(map(self._known.__contains__, pieces)):
                    self._learn(pieces)  # it began anew
            sizes = np.array([self._known[p] for p in pieces], np.int64)
            self._last = window, np.cumsum(sizes[at.reshape(-1)])
        return self._last[1]

    def windows(self, text: str) -> list[int]:
        """Of each window of the text, the length of its offset array."""
        return [int(self.edges(text[i : i + WINDOW])[-1]) for i in range(0, len(text), WINDOW)]

    def at(self, text: str, ends: list[int], rank: int) -> int:
        """The offset of a rank, by the sums of the windows' lengths; the rank n is the end of the text.

        Every code point is isolated, so the array of what is before a piece is as long as what is before it.
        """
        if not ends or rank >= ends[-1]:
            return ends[-1] if ends else 0
        w = bisect_right(ends, rank)
        base = ends[w - 1] if w else 0
        window = text[base : ends[w]]
        edges = self.edges(window)
        k = int(np.searchsorted(edges, rank - base, "right"))
        low = int(edges[k - 1]) if k else 0
        return base + low + self.of(window[low : int(edges[k])])[rank - base - low][0]


def cut(offsets: Offsets, text: str, h: tuple, rate: int, spm: int, sentinels: tuple = SENTINELS) -> tuple:
    """(n, form, code points of prefix and of middle, output) of a text with its four draws."""
    ends = list(accumulate(offsets.windows(text)))
    n = ends[-1] if ends else 0
    if not n or h[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = offsets.at(text, ends, low), offsets.at(text, ends, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the seed and a row's key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20, sentinels: tuple = SENTINELS, keep_columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (default: all), then n (code points), form (plain, psm, spm), prefix_chars, middle_chars and output.

    rate: of 100 texts, how many are cut; spm: of 100 that are, how many have the suffix first.
    """
    results = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    taken = {c for c, _ in results}
    stays = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() not in taken]
    # The row travels as one struct, so that no column of it can clash with what is added.
    row = F.struct(*(docs[f"`{c}`"] for c in stays)) if stays else F.struct(F.lit(None).alias("__none"))
    source = docs.select(row.alias("__row"), docs[f"`{text}`"].cast("string").alias("__text"), *draws(docs[f"`{key}`"], seed))
    schema = T.StructType([source.schema["__row"], *(T.StructField(c, k) for c, k in results)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        offsets = Offsets()
        for batch in batches:
            for part in kit.slices(batch, "__text"):
                h = zip(*(part.column(f"__h{k}").to_pylist() for k in range(1, 5)))
                rows = [cut(offsets, t or "", x, rate, spm, sentinels) for t, x in zip(part.column("__text").to_pylist(), h)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("__row"), *cols], names=["__row", *(c for c, _ in results)])

    done = source.mapInArrow(kit.trimmed(run), schema)
    return done.select(*(F.col("__row")[c].alias(c) for c in stays), *(c for c, _ in results))


def restore(output: Column, form: Column, sentinels: tuple = SENTINELS) -> Column:
    """The text again: what stands between the sentinels, in order.  A text that is cut holds none, so the first of each is the one."""
    p, s, m = sentinels

    def between(begin: str, end: str | None) -> Column:
        low = F.locate(begin, output) + len(begin)
        return F.substr(output, low) if end is None else F.substr(output, low, F.locate(end, output) - low)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
