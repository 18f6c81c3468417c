"""Token-id files: Simple-8b words with escapes in blocks, written and read back through Spark."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.shared import arrow_map, batch_of, materialize, text_slices
from folioforge.llm.tokens import TOKEN_SLICE, tokenizer

# Fixed values of the format: ids of a word and bits of each, by selector; selector 15 is the escape, one id of 32 bits.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 32)
MAGIC = b"TIDS8B1\n"
BLOCK = 65_536  # ids of a block
_WIDTHS = np.frexp(np.arange(65536, dtype=np.float64))[1].astype(np.uint8)  # bits of a number
SMALL_FILES = 200_000  # files whose places are broadcast


def encode_block(ids: np.ndarray) -> bytes:
    """64-bit words, little-endian: a 4-bit selector in the low bits, then the ids from low bits to high.

    Selectors 0 and 1 are runs of 240 and 120 zeros. Greedy: each word takes the selector that holds most ids
    among those whose width fits all of them; an id of over 30 bits takes an escape word. The last word may be
    short of ids; its rest is zero and the block's count cuts it.
    """
    n = ids.size
    if not n:
        return b""
    width = np.where(ids < 65536, _WIDTHS[ids & np.uint32(65535)], _WIDTHS[ids >> np.uint32(16)] + np.uint8(16))
    wide = {1: np.concatenate([width, np.zeros(256, np.uint8)])}  # by length of a run from an id on: the widest of it
    for size in (2, 4, 8, 16, 32, 64, 128):
        half = wide[size // 2]
        wide[size] = np.maximum(half[: half.size - size // 2], half[size // 2 :])
    best = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):  # the last selector that fits is the one that holds most
        part = 1 << (COUNTS[s].bit_length() - 1)
        fits = np.maximum(wide[part][:n], wide[part][COUNTS[s] - part :][:n]) <= BITS[s]
        if s < 2:
            fits[max(0, n - COUNTS[s] + 1) :] = False
        best[fits] = s
    ids, best = ids.astype(np.uint64), best.astype(np.int64)
    takes = np.minimum(np.array(COUNTS)[best], n - np.arange(n))
    starts, at, hop = [], 0, takes.tolist()
    while at < n:
        starts.append(at)
        at += hop[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words = chosen.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if rows.size:
            k = np.arange(COUNTS[s])
            values = padded[starts[rows][:, None] + k]
            values[k[None] >= takes[starts[rows]][:, None]] = 0
            words[rows] |= np.bitwise_or.reduce(values << (np.uint64(4) + k.astype(np.uint64) * np.uint64(BITS[s])), axis=1)
    return words.astype("<u8").tobytes()


def decode_block(raw: bytes, count: int) -> np.ndarray:
    """The `count` ids of a block, all words of a selector at a time."""
    words = np.frombuffer(raw, "<u8").astype(np.uint64)
    chosen = (words & np.uint64(15)).astype(np.int64)
    sizes = np.array(COUNTS)[chosen]
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if rows.size:
            k = np.arange(COUNTS[s])
            values = (words[rows][:, None] >> (np.uint64(4) + k.astype(np.uint64) * np.uint64(BITS[s]))) & np.uint64((1 << BITS[s]) - 1)
            out[begin[rows][:, None] + k] = values
    return out[:count]


def _blocks(values: np.ndarray) -> list[bytes]:
    return [encode_block(values[a : a + BLOCK]) for a in range(0, values.size, BLOCK)]


def encode_shard(ids: np.ndarray, lengths: np.ndarray, names: np.ndarray | None = None, named: np.ndarray | None = None) -> bytes:
    """A file body: MAGIC and counts, byte offsets of all blocks, documents' ids (64 bits each, and a byte that is 0 for null), then blocks: documents' lengths, token ids."""
    names = np.arange(lengths.size) if names is None else names
    named = np.ones(lengths.size, bool) if named is None else named
    heads, blocks = _blocks(lengths.astype(np.uint32)), _blocks(ids)
    table = struct.pack("<8sQQQQ", MAGIC, ids.size, lengths.size, len(heads), len(blocks))
    offsets = np.cumsum([0, *map(len, heads), *map(len, blocks)]).astype("<u8").tobytes()
    return b"".join([table, offsets, names.astype("<i8").tobytes(), named.astype(np.uint8).tobytes(), *heads, *blocks])


class Shard:
    """A file body. Blocks are decoded alone, by their byte offsets."""

    def __init__(self, raw: bytes):
        magic, self.n_ids, self.n_docs, self.heads, blocks = struct.unpack_from("<8sQQQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.offsets = np.frombuffer(raw, "<u8", self.heads + blocks + 1, 40).astype(np.int64)
        at = 40 + self.offsets.size * 8
        self.names = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.named = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.raw, self.body = raw, at + 9 * self.n_docs

    def _block(self, k: int, count: int) -> np.ndarray:
        return decode_block(self.raw[self.body + self.offsets[k] : self.body + self.offsets[k + 1]], count)

    def lengths(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *(self._block(k, min(BLOCK, self.n_docs - k * BLOCK)).astype(np.int64) for k in range(self.heads))])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop-1; only the blocks that hold them are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        first = start // BLOCK
        some = [self._block(self.heads + k, min(BLOCK, self.n_ids - k * BLOCK)) for k in range(first, -(-stop // BLOCK))] if start < stop else []
        return np.concatenate([np.empty(0, np.uint32), *some])[start - first * BLOCK : stop - first * BLOCK]


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a whole file body."""
    shard = Shard(raw)
    return shard.ids(), shard.lengths()


def write_ids(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", joined: bool = True, end: int = 2) -> DataFrame:
    """Encode docs in ascending id order into file bodies and write them; returns the written table.

    Columns: shard (task of the ordered input), part (file of the shard, from 0), n_ids, payload (a body as
    encode_shard() makes it, documents' ids and the token ids of a few megabytes of text). The bodies are binary values
    that go through Spark's committing writer, so any store works and a task that is run again leaves no half-written
    file. Null texts are empty (`end` alone); null ids sort first; equal ids are ordered by text, and rows of one id may
    lie in several shards; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, words = TaskContext.get().partitionId(), 0, tokenizer(vocabulary, joined)
        for batch in batches:
            for rows, bodies in text_slices(batch, "body", TOKEN_SLICE):
                ids, lengths = words.encode(bodies, end)
                names = rows.column("doc_id")
                payload = encode_shard(ids, lengths, pc.fill_null(names, 0).to_numpy(), names.is_valid().to_numpy(zero_copy_only=False))
                yield batch_of(shard=pa.array([shard], pa.int32()), part=pa.array([part], pa.int32()), n_ids=pa.array([ids.size], pa.int64()), payload=pa.array([payload], pa.binary()))
                part += 1

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    source = source.withColumn("tie", F.xxhash64("body"))  # splits the rows of one id over tasks
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "body").drop("tie")
    return materialize(arrow_map(ordered, encode, "shard int, part int, n_ids long, payload binary"), "token-ids")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of written files: start counts the ids of all documents before, ids are little-endian unsigned 32-bit numbers."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inner = files.select("shard", "part", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")).alias("inner"))
    places = inner.join(base, "shard").select("shard", "part", (F.col("base") + F.col("inner")).alias("place"))
    if files.count() <= SMALL_FILES:  # 16 bytes a file; beyond, the join shuffles
        places = F.broadcast(places)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, place in zip(batch.column("payload"), batch.column("place").to_pylist(), strict=True):
                shard = Shard(payload.as_py())
                lengths = shard.lengths()
                stop = np.concatenate([[0], np.cumsum(lengths)])
                a = 0
                while a < lengths.size:  # about a megabyte of ids at a time
                    b = max(a + 1, int(np.searchsorted(stop, stop[a] + 4 * BLOCK, "right")) - 1)
                    raw, offsets = shard.ids(int(stop[a]), int(stop[b])).astype("<u4").tobytes(), (4 * (stop[a : b + 1] - stop[a])).astype(np.int32)
                    yield batch_of(
                        doc_id=pa.array(shard.names[a:b], mask=~shard.named[a:b]), start=place + stop[a:b], n_tokens=lengths[a:b], ids=pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                    )
                    a = b

    return arrow_map(files.join(places, ["shard", "part"]).select("payload", "place"), decode, "doc_id long, start long, n_tokens long, ids binary")
