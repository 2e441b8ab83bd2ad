"""Token ids in fixed-width, bit-packed files.

Every id takes the least number of bits that the vocabulary needs.  A file is:

    8 bytes  b"CFTOK\\x01" + width in bits + 0
    8 bytes  number of ids, 8 bytes number of documents, 8 bytes ids per block
    documents + 1 x 8 bytes: first id of each document, then the end
    blocks + 1 x 8 bytes: byte offset of each block in the payload
    payload: blocks, each padded to whole bytes, bits in little-endian order

All integers are little-endian unsigned.  A block can be unpacked alone, so any
range of ids is read by unpacking the blocks that it touches, with numpy only.

On a cluster the files lie as rows (shard, doc_ids, file) of a Parquet table in
the shared folder, since executors can write there only through Spark;
export() puts them out as plain files.

Defined cases: null and empty texts give only the end id; documents with a null
id come first; rows that share an id stay separate, in the order of the hashes of
id and text; an empty table gives no file.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit

MAGIC = b"CFTOK\x01"
BLOCK = 4096


def width_of(vocabulary: int) -> int:
    return max(1, math.ceil(math.log2(max(2, vocabulary))))


def pack_block(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_block(data, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width in (8, 16, 32):
        return raw.view(f"<u{width // 8}")[:n].astype(np.uint32)
    bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return bits @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


def pack(ids: np.ndarray, bounds: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """A file of these ids; bounds: first id of each document, then the end."""
    width = width_of(vocabulary)
    if len(ids) and int(ids.max()) >= 1 << width:
        raise ValueError("an id lies outside the vocabulary")
    parts = [pack_block(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)])
    head = MAGIC + bytes([width, 0]) + np.array([len(ids), len(bounds) - 1, block], "<u8").tobytes()
    return b"".join([head, np.asarray(bounds).astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class Reader:
    """Random access to a packed file (bytes, or anything with the buffer protocol, such as an mmap)."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:6]) != MAGIC:
            raise ValueError("not a token file")
        self.width = self.data[6]
        self.n, self.docs, self.block = (int(x) for x in np.frombuffer(self.data[8:32], "<u8"))
        blocks, at = -(-self.n // self.block), 32
        self.bounds = np.frombuffer(self.data[at : (at := at + 8 * (self.docs + 1))], "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.data[at : (at := at + 8 * (blocks + 1))], "<u8").astype(np.int64)
        self.payload = at

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1 of the file."""
        lo, hi = max(lo, 0), min(hi, self.n)
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, out = lo // self.block, []
        for b in range(first, -(-hi // self.block)):
            piece = self.data[self.payload + self.offsets[b] : self.payload + self.offsets[b + 1]]
            out.append(unpack_block(piece, min(self.block, self.n - b * self.block), self.width))
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


class Encoder:
    """Token ids of pieces of text, by the hash of their bytes; kept in flat arrays, so that a known piece makes no Python object."""

    def __init__(self, path: str, entries: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.entries = Tokenizer.from_file(path), entries
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        # Byte-level vocabularies write the space as U+0120.
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for w, i in vocabulary.items() if w[:1] == "\u0120"]] = True
        self.small = np.uint16 if self.size <= 1 << 16 else np.uint32
        pre, line = self.tok.pre_tokenizer, self.tok.encode("\n", add_special_tokens=False).ids
        # The byte-level expression keeps letters, digits and other signs apart and looks at nothing before a token.
        self.apart = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tok.normalizer is None and len(line) == 1
        self.line = line[0] if self.apart else -1
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, self.small)

    def learn(self, key: np.ndarray, pieces: list[bytes], plain: np.ndarray, bare: np.ndarray) -> None:
        """Encodes pieces of unknown, sorted keys. Plain ones (a space, then no white space) are joined to one text: each begins with the only token that opens with a space. Bare ones (no white space) are joined by line breaks."""
        n, at = np.zeros(len(pieces), np.uint32), np.zeros(len(pieces), np.uint32)
        if len(self.key) + len(key) > self.entries:
            self.forget()
        flat, size, rest = [self.flat], len(self.flat), np.flatnonzero(~plain & ~bare)
        some = np.flatnonzero(plain)
        for lo in range(0, len(some), 10_000):
            part = some[lo : lo + 10_000]
            got = np.array(self.tok.encode_batch_fast([b"".join(pieces[i] for i in part.tolist()).decode()], add_special_tokens=False)[0].ids, self.small)
            cut = np.flatnonzero(self.opens[got])
            if len(cut) == len(part) and cut[0] == 0:
                at[part], n[part] = size + cut, np.diff(np.append(cut, len(got)))
                flat.append(got)
                size += len(got)
            else:
                rest = np.concatenate([rest, part])
        some = np.flatnonzero(bare)
        for lo in range(0, len(some), 10_000):
            part = some[lo : lo + 10_000]
            got = np.array(self.tok.encode_batch_fast([b"\n".join(pieces[i] for i in part.tolist()).decode()], add_special_tokens=False)[0].ids, self.small)
            cut = np.flatnonzero(got == self.line)
            if len(cut) == len(part) - 1:
                first = np.concatenate([[0], cut + 1])
                at[part], n[part] = size + first, np.append(cut, len(got)) - first
                flat.append(got)
                size += len(got)
            else:
                rest = np.concatenate([rest, part])
        for lo in range(0, len(rest), 10_000):
            part = rest[lo : lo + 10_000].tolist()
            for i, e in zip(part, self.tok.encode_batch_fast([pieces[i].decode() for i in part], add_special_tokens=False)):
                got = np.array(e.ids, self.small)
                at[i], n[i] = size, len(got)
                flat.append(got)
                size += len(got)
        where = np.searchsorted(self.key, key)
        self.key, self.at, self.n = np.insert(self.key, where, key), np.insert(self.at, where, at), np.insert(self.n, where, n)
        self.flat = np.concatenate(flat)

    def place(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is unknown."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


#: First bytes, in UTF-8, of white space beyond ASCII.
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_BLANK = _LEAD | (np.arange(256) <= 0x20) | (np.arange(256) == 0x7F)
#: ASCII letters and digits, and ASCII punctuation.
_WORD = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_SIGN = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    encoder.cache_clear()
    _added.cache_clear()


kit.CACHES.append(forget)


def encode(col: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with its end id, and their bounds.

    The byte-level pre-tokenizer always starts a token at a space between two
    characters that are no white space, at a sign behind a letter or digit, and
    at and behind a lone line break, so text is cut there and every distinct
    piece is encoded once: a word is one piece, whatever sign follows it.
    """
    enc = encoder(path)
    t = kit.Texts(col)
    buf, n = t.buf, len(t.buf)
    # Neither control characters nor anything with a lead byte that Unicode's spaces have may border a cut.
    solid = ~_BLANK[buf]
    lead = np.flatnonzero(_LEAD[buf])
    for j in (1, 2):
        solid[np.minimum(lead + j, n - 1)] = False
    head = np.zeros(n + 1, bool)
    if n > 2:
        head[1 : n - 1] = (buf[1:-1] == 0x20) & solid[:-2] & solid[2:]
    added = [w.encode() for w in _added(enc.tok)]
    added = [w for w in added if w in buf.tobytes()] if added else added
    if enc.apart and not added and n > 2:
        word = _WORD[buf]
        # Two bytes from 0xC3 are a letter, but for the signs of multiplication and division.
        far = np.flatnonzero(buf[:-1] == 0xC3) + 1
        word[far] = (buf[far] != 0x97) & (buf[far] != 0xB7)
        head[1:n] |= word[:-1] & _SIGN[buf[1:]]
        line = np.flatnonzero((buf[1:-1] == 0x0A) & solid[:-2] & solid[2:]) + 1
        head[line] = head[line + 1] = True
    cut = head.copy()
    edges = np.append(t.lo, n)
    head[edges] = True
    head[n] = False
    t.ws = np.flatnonzero(head)
    t.we = np.append(t.ws[1:], n) if len(t.ws) else t.ws
    key, where, back = np.unique(t.hashes(), return_index=True, return_inverse=True)
    lo, hi = t.ws[where], t.we[where]
    place = enc.place(key)
    new = np.flatnonzero(place < 0)
    if len(new):
        if len(enc.key) + len(new) > enc.entries:
            enc.forget()
            new = np.arange(len(key))
        # Plain: opens with a space at a cut, and holds no white space after it; an added token may stand in none of them.
        odd = np.concatenate([[0], np.cumsum(~solid)])
        odd = odd[hi[new]] - odd[lo[new]]
        plain, bare = cut[lo[new]] & (buf[lo[new]] == 0x20) & (odd == 1), (odd == 0) & (enc.apart and not added)
        whole = buf.tobytes()
        pieces = [whole[a:b] for a, b in zip(lo[new].tolist(), hi[new].tolist())]
        plain &= np.array([not any(w in x for w in added) for x in pieces]) if added else True
        enc.learn(key[new], pieces, plain, bare)
        place = enc.place(key)
    sizes = enc.n[place][back].astype(np.int64)
    per = kit.per_text(np.searchsorted(t.ws, edges), sizes)
    ends = np.cumsum(sizes)
    body = enc.flat[np.repeat(enc.at[place][back].astype(np.int64) - (ends - sizes), sizes) + np.arange(ends[-1])] if len(sizes) else enc.flat[:0]
    bounds = np.concatenate([[0], np.cumsum(per + 1)])
    ids = np.full(bounds[-1], end_id, np.uint32)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    ids[inner] = body
    return ids, bounds


@lru_cache(maxsize=2)
def _added(tok) -> tuple:
    return tuple(x.content for x in tok.get_added_tokens_decoder().values())


def write(docs: DataFrame, path: str, end_id: int, where: str, text: str = "text", key: str = "doc_id", block: int = BLOCK, shard_ids: int = 1 << 22) -> DataFrame:
    """Writes packed files of all texts in ascending order of the key (nulls first) and returns their table.

    Texts are encoded where they lie; only ids are dealt out and sorted, by ranges
    of (key, hash of the text), so that a key that many rows share does not
    gather in one task.  Shards hold about shard_ids ids each.
    """
    spark = docs.sparkSession
    ddl, arrow = kit.id_types(docs, key)
    vocabulary = max(encoder(path).size, end_id + 1)
    small = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    tie = F.xxhash64("__key", "__text")
    source = docs.select(docs[f"`{key}`"].alias("__key"), docs[f"`{text}`"].cast("string").alias("__text"))
    # Ranges are cut at some 64 keys for each, from a hash sample, so that texts are encoded once; every row is dealt by the cuts.
    # Equal rows have one hash, so they come as one row and its number; one that is hot stands for as many cuts as it needs, all of the same place.
    rows, size = source.agg(F.count("*"), F.sum(F.octet_length("__text"))).first()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) >> 26)
    every = max(1, rows // (64 * parts))
    some = source.select("__key", tie.alias("h")).where(F.pmod("h", F.lit(every)) == 0).groupBy("__key", "h").agg(F.count("*").alias("n"))
    sample = sorted((k is not None, k, h) for k, h, n in some.collect() for _ in range(max(1, min(n, 64 * parts * n // max(1, rows)))))
    cuts = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    def encoded(batches):
        for batch in batches:
            for part in kit.slices(batch, "__text", kit.PIECE_BYTES):
                ids, b = encode(part.column("__text"), path, end_id)
                ids = ids.astype(small)
                where = [bisect_right(cuts, (k is not None, k, h)) for k, h in zip(part.column("__key").to_pylist(), part.column("__tie").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("__key"), part.column("__tie"), pa.array([ids[i:j].tobytes() for i, j in zip(b[:-1].tolist(), b[1:].tolist())], pa.binary()), pa.array(where, pa.int32())], names=["__key", "__tie", "__ids", "__part"])

    rows = source.withColumn("__tie", tie).mapInArrow(kit.trimmed(encoded, forget), f"__key {ddl}, __tie long, __ids binary, __part int")
    rows = rows.repartitionById(len(cuts) + 1, F.col("__part")).sortWithinPartitions(F.col("__key").asc_nulls_first(), "__tie").select("__key", "__ids", F.col("__part").cast("long"))

    def shards(batches):
        part, n, before, held, size = 0, 0, 0, [], 0

        def out():
            ids = [np.frombuffer(x, small) for _, x in held]
            bounds = np.cumsum([0, *map(len, ids)])
            data = pack(np.concatenate(ids), bounds, vocabulary, block)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([before], pa.int64()), pa.array([int(bounds[-1])], pa.int64()), pa.array([[k for k, _ in held]], pa.list_(arrow)), pa.array([data], pa.binary())], names=["part", "shard", "before", "n_ids", "doc_ids", "file"])

        for batch in batches:
            for k, x, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                part = p
                held.append((k, x := x.as_buffer()))
                size += x.size // small().itemsize
                if size >= shard_ids:
                    yield out()
                    n, before, held, size = n + 1, before + size, [], 0
        if held:
            yield out()

    files = rows.mapInArrow(kit.trimmed(shards), f"part long, shard long, before long, n_ids long, doc_ids array<{ddl}>, file binary")
    return kit.stored(files, where)


def read(files: DataFrame) -> DataFrame:
    """Reads packed files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # A number for each partition of the sort comes to the driver; shards know what lies before them in theirs.
    totals = sorted((r.part, int(r.n)) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist()))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = files.schema["doc_ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def unpacked(batches):
        for batch in batches:
            for part, before, keys, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                r = Reader(data.as_buffer())
                ids, b = r.ids(0, r.n).astype("<u4"), r.bounds
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(b[:-1].tolist(), b[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(base[part] + before + b[:-1]), pa.array(np.diff(b)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "doc_ids", "file").mapInArrow(kit.trimmed(unpacked), f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> list[str]:
    """Puts the packed files out as plain ones in a folder of the driver, one at a time; their names in order."""
    import os

    os.makedirs(folder, exist_ok=True)
    names = []
    for r in files.orderBy("part", "shard").toLocalIterator():
        names.append(os.path.join(folder, f"tokens-{r.part:06d}-{r.shard:06d}.bin"))
        with open(names[-1], "wb") as f:
            f.write(r.file)
    return names
