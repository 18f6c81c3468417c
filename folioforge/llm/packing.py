"""Packing into fixed windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.shared import arrow_map, batch_of, materialize, text_slices
from folioforge.llm.tokens import tokenizer

PIECE_SLICE = 6_000_000  # bytes of the texts that are encoded together: a worker takes 292 MB, 339 with 12 million, in the same time
SMALL_COUNTS = 200_000  # rows of counts per task and bin that are broadcast


def combinations_of(slots: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All falling tuples of up to `depth` positive numbers that sum to `slots`."""

    def parts(left: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if deep > 1:
            for first in range(min(most, left - 1), 0, -1):
                if first * deep < left:
                    break
                for rest in parts(left - first, first, deep - 1):
                    yield (first, *rest)

    return sorted({tuple(sorted(c, reverse=True)) for c in parts(slots, slots, depth)}, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares of a x = b over x >= 0, by the active-set method of Lawson and Hanson.

    Products of columns are formed for the passive ones only, no more than a has rows, as those of all pairs would fill
    250 MB for the combinations of 256 bins.
    """
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    right = a.T @ b
    slack = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(rounds):
        gradient = right - a.T @ (a @ x)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= slack:
            break
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, on].T @ a[:, on], right[on], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            now = x[on]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, now / np.maximum(now - s, 1e-300), np.inf).min()
            x[on] = now + step * (s - now)
            x[on[bad & (x[on] <= 1e-12)]] = 0
            passive[on[x[on] <= 1e-12]] = False
            if not passive.any():
                break
    return x


@dataclass(frozen=True)
class Plan:
    """deals: (slot, low, high, per, first): pieces low..high-1 of a slot go `per` to a sequence, from sequence `first` on."""

    deals: list[tuple[int, int, int, int, int]]
    sequences: int


def plan(histogram: np.ndarray, depth: int = 3) -> Plan:
    """histogram[s]: pieces that need s slots; its last index is the window. Every piece is dealt exactly once.

    Repeat counts of the combinations that fill the window are solved by NNLS with long pieces weighted more, as
    short ones fill gaps later, and rounded down. The rest is packed greedily, on counts: the longest piece
    left takes the longest pieces that still fit, as often as the counts allow.
    """
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(window + 1, np.int64)
    deals, sequences = [], 0

    def take(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        for slot in set(combo):
            per = combo.count(slot)
            deals.append((slot, int(used[slot]), int(used[slot]) + per * times, per, sequences))
            used[slot] += per * times
            left[slot] -= per * times
        sequences += times

    if left[window]:
        take((window,), int(left[window]))
    combos = [c for c in combinations_of(window, depth) if len(c) > 1 and all(left[s] for s in c)]
    if combos:
        weight = np.sqrt(np.arange(window + 1) / window + 0.05)
        a = np.zeros((window + 1, len(combos)))
        for k, c in enumerate(combos):
            for s in c:
                a[s, k] += weight[s]
        repeats = nnls(a, left * weight)
        for k in np.argsort(-repeats, kind="stable"):
            c = combos[k]
            times = min(int(repeats[k] + 1e-6), *(int(left[s] // c.count(s)) for s in set(c)))
            if times > 0:
                take(c, times)
    while left.any():
        combo, room, counts = [], window, left.copy()
        while True:
            fits = np.flatnonzero(counts[: room + 1])
            if not fits.size:
                break
            s = int(fits[-1])
            n = min(int(counts[s]), room // s) if s * 2 <= room and len(combo) else 1
            combo += [s] * n
            counts[s] -= n
            room -= s * n
        take(tuple(combo), min(int(left[s] // combo.count(s)) for s in set(combo)))
    return Plan(deals, sequences)


def cut_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", joined: bool = False, end: int = 2, window: int = 4096, slot: int = 16) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, task, bin, nth), written: one row per piece of `window` ids and per rest.

    A document's ids are those of the whole text by the tokenizer in `vocabulary`, then `end`. ids is a piece's ids as
    little-endian unsigned 32-bit numbers, bin its length in slots of `slot` ids, nth its number among those of its
    bin that the task made.
    """
    slots = window // slot

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        words, seen = tokenizer(vocabulary, joined), np.zeros(slots + 1, np.int64)
        for batch in batches:
            for rows, bodies in text_slices(batch, "body", PIECE_SLICE):
                ids, lengths = words.encode(bodies, end)
                pieces = -(-lengths // window)
                owner = np.repeat(np.arange(len(bodies)), pieces)
                start = (np.arange(owner.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(lengths[owner] - start, window)
                bins = -(-length // slot)
                order = np.argsort(bins, kind="stable")
                run = np.bincount(bins, minlength=slots + 1)
                nth = np.empty(owner.size, np.int64)
                nth[order] = np.arange(owner.size) - np.repeat(np.cumsum(run) - run, run)
                nth += seen[bins]
                seen += run
                whole = np.concatenate([[0], np.cumsum(length)]) * 4
                for at in range(0, owner.size, 5000):
                    end_at = min(at + 5000, owner.size)
                    raw = ids[whole[at] // 4 : whole[end_at] // 4].astype("<u4").tobytes()
                    offsets = (whole[at : end_at + 1] - whole[at]).astype(np.int32)
                    some = slice(at, end_at)
                    yield batch_of(
                        doc_id=rows.column("doc_id").take(pa.array(owner[some])), start=start[some], length=length[some], ids=pa.Array.from_buffers(pa.binary(), end_at - at, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]),
                        doc_tokens=lengths[owner[some]], task=pa.array(np.full(end_at - at, task, np.int32)), bin=bins[some].astype(np.int32), nth=nth[some],
                    )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return materialize(arrow_map(source, cut, "doc_id long, start long, length long, ids binary, doc_tokens long, task int, bin int, nth long"), "pieces")


def place(pieces: DataFrame, *, window: int = 4096, slot: int = 16, depth: int = 3) -> DataFrame:
    """pieces (task, bin, nth, length and any other columns) without task, bin and nth, with sequence_id and offset.

    The histogram has window / slot bins whatever the data, and the plan a bounded number of deals, so only these
    reach the driver. Pieces are numbered within their bin by counts per task. The counts are taken twice from two
    columns of the pieces, as a table of them would be a file of a few rows for each partition of a shuffle.
    """
    spark, slots = pieces.sparkSession, window // slot
    counts = pieces.groupBy("task", "bin").agg(F.count("*").alias("n"))
    histogram, rows = np.zeros(slots + 1, np.int64), 0
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect():  # at most window / slot rows
        histogram[r["bin"]] = r["n"]
        rows += r["tasks"]
    deals = spark.createDataFrame(plan(histogram, depth).deals, "d_bin int, low long, high long, per long, first long")
    before = counts.select("task", "bin", (F.sum("n").over(Window.partitionBy("bin").orderBy("task")) - F.col("n")).alias("before"))
    if rows <= SMALL_COUNTS:  # 24 bytes a row; beyond, the join shuffles
        before = F.broadcast(before)
    kept = [c for c in pieces.columns if c not in ("task", "bin", "nth")]
    numbered = pieces.join(before, ["task", "bin"]).withColumn("_rank", F.col("before") + F.col("nth"))
    dealt = numbered.join(F.broadcast(deals), (F.col("bin") == F.col("d_bin")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))  # deals: bounded by the bins
    placed = dealt.select(*kept, (F.col("first") + F.floor((F.col("_rank") - F.col("low")) / F.col("per"))).cast("long").alias("sequence_id"), "_rank", "bin")
    return placed.withColumn("offset", (F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "_rank")) - F.col("length")).cast("long")).drop("_rank", "bin")


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", joined: bool = False, end: int = 2, window: int = 4096, slot: int = 16, depth: int = 3) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece.

    Documents are cut as cut_pieces() says, and sequences of `window` ids are formed from histogram and plan().
    offset is the piece's place in its sequence, gapless from 0, longer pieces first. Null and empty texts are `end`
    alone; null ids are kept; repeated rows are packed once each; an empty table gives no rows; a text of any length
    is cut as a whole; other columns are not read.
    """
    pieces = cut_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, joined=joined, end=end, window=window, slot=slot)
    return place(pieces, window=window, slot=slot, depth=depth)
