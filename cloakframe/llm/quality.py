"""Quality rules: compression bands.

zstandard ratios over the whole document and over fixed chunks reject text that
is repetitive (ratio under the band) or incompressible (over it), with limits
that depend on length, since short texts compress less.  Simple counts per
document go along.  One pass over the texts, no shuffle.

Defined cases: a null text is empty; an empty text has ratio null and only the
base rule judges it; null ids stay; repeated rows are judged alike; columns of
the input that clash with a result column, whatever their case, are replaced by
the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm import kit

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Bands:
    """(from how many bytes on, least ratio, greatest ratio); the last that applies holds."""

    whole: tuple = field(default=((0, 0.0, 9.0), (64, 0.30, 1.40), (128, 0.30, 1.10), (256, 0.30, 0.95), (512, 0.28, 0.82), (1024, 0.26, 0.74), (4096, 0.24, 0.70)))
    chunk: int = 4096
    chunk_least: float = 0.20
    chunk_most: float = 0.75
    bad_share: float = 1 / 3  # of the chunks, above which the text goes
    level: int = 3


def ratios(t: kit.Texts, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: ratio of the whole (nan if empty), share of its fixed chunks that are out of band."""
    import zstandard

    z = zstandard.ZstdCompressor(level=bands.level)
    whole, share, view = np.full(t.n, np.nan), np.zeros(t.n), memoryview(t.buf)
    for i, (lo, hi) in enumerate(zip(t.lo.tolist(), t.hi.tolist())):
        if hi > lo:
            whole[i] = len(z.compress(view[lo:hi])) / (hi - lo)
        # A last piece of less than half a chunk is left to the ratio of the whole.
        cuts = range(lo, hi - bands.chunk // 2 + 1, bands.chunk) if hi - lo > bands.chunk else ()
        if cuts:
            x = np.array([len(z.compress(view[c : min(c + bands.chunk, hi)])) / (min(c + bands.chunk, hi) - c) for c in cuts])
            share[i] = np.mean((x < bands.chunk_least) | (x > bands.chunk_most))
    return whole, share


def in_band(n_bytes: np.ndarray, whole: np.ndarray, share: np.ndarray, bands: Bands) -> np.ndarray:
    k = np.searchsorted([b[0] for b in bands.whole], n_bytes, "right") - 1
    least, most = np.array([b[1] for b in bands.whole])[k], np.array([b[2] for b in bands.whole])[k]
    return np.isnan(whole) | ((whole >= least) & (whole <= most) & (share <= bands.bad_share))


def repeat_words(t: kit.Texts, h: np.ndarray, k: int = 8) -> np.ndarray:
    """Words inside windows of k words that the same text holds twice or more, the first one included."""
    s, at = t.shingles(h, k)
    doc = t.doc[at]
    with np.errstate(over="ignore"):
        key = kit.mix(s + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice = order[same[1:] | same[:-1]]
    return kit.per_text(t.first, kit.covered(at[twice], k, len(h)))


def dup_lines(t: kit.Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    out, data = np.zeros(t.n, np.int64), t.buf.tobytes()
    blank = bytes([32, *range(9, 14)])
    for i, (lo, hi) in enumerate(zip(t.lo.tolist(), t.hi.tolist())):
        lines = data[lo:hi].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            lines = [x for x in lines if x.strip(blank)]
            out[i] = len(lines) - len(set(lines))
    return out


def measure(col: pa.Array, bands: Bands, min_words: int, repeat_percent: int) -> dict[str, np.ndarray]:
    t = kit.Texts(col).words()
    h = t.hashes()
    lead = t.black & ((t.buf & 0xC0) != 0x80)
    edges = np.append(t.lo, len(t.buf))
    out = dict(zip(STATS, (np.diff(t.first), kit.per_text(edges, lead), kit.per_text(edges, SYMBOLS[t.buf]), dup_lines(t), repeat_words(t, h))))
    whole, share = ratios(t, bands)
    failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > repeat_percent * out["n_words"])
    return out | {"base_failed": failed, "ratio": whole, "bad_chunks": share, "kept": ~failed & in_band(t.hi - t.lo, whole, share, bands)}


def judge(docs: DataFrame, text: str = "text", bands: Bands = Bands(), min_words: int = 20, repeat_percent: int = 30, keep_columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (default: all), then STATS, base_failed, ratio, bad_chunks and kept for every row."""
    results = [*((c, T.LongType()) for c in STATS), ("base_failed", T.BooleanType()), ("ratio", T.DoubleType()), ("bad_chunks", T.DoubleType()), ("kept", T.BooleanType())]
    taken = {c.lower() for c, _ in results}
    names = [c for c in (docs.columns if keep_columns is None else keep_columns) if c.lower() not in taken]
    # The row travels as one struct, so that no column of it can clash with what is added.
    row = F.struct(*(docs[f"`{c}`"] for c in names)) if names else F.struct(F.lit(None).alias("__none"))
    source = docs.select(row.alias("__row"), docs[f"`{text}`"].cast("string").alias("__text"))
    schema = T.StructType([source.schema["__row"], *(T.StructField(c, k) for c, k in results)])

    def run(batches):
        for batch in batches:
            for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                m = measure(part.column("__text"), bands, min_words, repeat_percent)
                cols = [pa.array(m[c], from_pandas=c == "ratio") for c, _ in results]
                yield pa.RecordBatch.from_arrays([part.column("__row"), *cols], names=["__row", *(c for c, _ in results)])

    done = source.mapInArrow(kit.trimmed(run), schema)
    return done.select(*(F.col("__row")[c].alias(c) for c in names), *(c for c, _ in results))


def keep(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text passes, with the columns they had."""
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), docs[f"`{text}`"].alias("__passes"))
    return judge(packed, "__passes", keep_columns=["__row"], **options).where("kept").select("__row.*")
