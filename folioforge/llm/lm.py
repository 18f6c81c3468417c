"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by scaled forward steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import chain
from folioforge.llm.quality import held_out
from folioforge.llm.shared import SLICE_CHARS, arrow_map, batch_of, counted_words, lowest, materialize, slices, text_slices

COUNTED = 1_500_000  # distinct words whose counts a task gathers before it writes them
FIRST_WORDS = 400  # words of a text that the starting point learns from, in a row from a random place on


@dataclass(frozen=True)
class Hmm:
    """start, move: of the states; emit: states x (buckets + 1), the last column for the end of a text."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def buckets(self) -> int:
        return self.emit.shape[1] - 1


def _numbered(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the texts' words, one after another, -1 for each end; hashes of the words by number; tokens of each text)."""
    words, distinct, lengths = counted_words(bodies)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
    numbers = np.full(words.size + lengths.size, -1, np.int64)
    numbers[np.arange(words.size) + np.repeat(np.arange(lengths.size), lengths)] = words
    return numbers, hashes, lengths + 1


def _bucket(numbers: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    of = np.append((hashes % np.uint64(buckets)).astype(np.int64), buckets)  # -1 reads the last
    return of[numbers]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, their counts) of parts of both."""
    h, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.empty(0, np.int64)
    return h[first], np.add.reduceat(c, first) if h.size else c


def _read_words(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts, written: rows (h, c) with counts of training words by their 64-bit hash, summed in the task, and rows (tokens) with a training text's buckets, the end's included, as unsigned 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []

        def out() -> pa.RecordBatch:
            h, c = parts[0]
            return batch_of(h=h.view(np.int64), c=c, tokens=pa.nulls(c.size, pa.binary()))

        for batch in batches:
            for _, bodies in text_slices(batch.filter(batch.column("train")), "body"):
                numbers, hashes, lengths = _numbered(bodies)
                raw, end = _bucket(numbers, hashes, buckets).astype("<u2").tobytes(), 2 * np.cumsum(lengths)
                none = pa.nulls(lengths.size, pa.int64())
                yield batch_of(h=none, c=none, tokens=pa.Array.from_buffers(pa.binary(), lengths.size, [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(raw)]))
                parts = [_summed([*parts, (hashes, np.bincount(numbers[numbers >= 0], minlength=hashes.size))])]
                if parts[0][0].size > COUNTED:
                    yield out()
                    parts = []
        if parts:
            yield out()

    return materialize(arrow_map(docs.select("train", "body"), run, "h long, c long, tokens binary"), "words")


def _expectations(tokens: DataFrame, model: Hmm) -> Hmm:
    """Sums over all training texts of the expected counts under `model`, in the shape of a model."""
    k, width = model.move.shape[0], model.emit.shape[1]
    shared = tokens.sparkSession.sparkContext.broadcast(model)  # states x buckets, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        by_bucket = np.ascontiguousarray(m.emit.T)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, width))
        for batch in batches:
            texts = batch.column("tokens")
            size = pc.binary_length(texts).to_numpy() // 2
            for a, b in slices(size.tolist(), SLICE_CHARS // 6):
                token = np.frombuffer(b"".join(texts[a:b].to_pylist()), "<u2").astype(np.int64)
                got = chain.run(by_bucket[token], size[a:b].astype(np.int64), m.start, m.move, posteriors=True)
                start += got.starts
                move += got.moves
                for s in range(k):
                    emit[s] += np.bincount(token, got.gamma[:, s], width)
        yield batch_of(task=pa.array([TaskContext.get().partitionId()], pa.int32()), sums=pa.array([np.concatenate([start, move.ravel(), emit.ravel()]).tobytes()], pa.binary()))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [0], "sums": [sum(np.frombuffer(s, float) for s in pdf["sums"]).tobytes()]})

    rows = arrow_map(tokens, run, "task int, sums binary")
    groups = max(1, int(tokens.rdd.getNumPartitions() ** 0.5))
    summed = rows.groupBy((F.col("task") % groups).alias("g")).applyInPandas(add, "task int, sums binary").collect()  # the root of the tasks' number, each of a fixed size
    shared.unpersist()
    total = sum((np.frombuffer(r["sums"], float) for r in summed), np.zeros(k + k * k + k * width))
    return Hmm(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, width))


def _normalised(sums: Hmm) -> Hmm:
    start = sums.start + 0.1
    move = sums.move + 0.1
    emit = sums.emit + 0.01
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _first_model(docs: DataFrame, states: int, buckets: int, texts: int, rounds: int, seed: int) -> Hmm:
    """A starting point: rounds over runs of FIRST_WORDS words of the `texts` training texts whose ids hash lowest, from random weights."""
    chosen = lowest(docs.filter("train").select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id"), texts, ["h", "doc_id"]).distinct()
    words = F.split(F.trim(F.regexp_replace("body", r"[\x09-\x0D ]+", " ")), " ")
    some = docs.filter("train").join(F.broadcast(chosen), "doc_id").withColumn("w", words)  # chosen: at most `texts` rows
    begin = F.pmod(F.col("h"), F.greatest(F.size("w") - FIRST_WORDS, F.lit(0)) + 1).cast("int") + 1
    rows = some.select("h", F.array_join(F.slice("w", begin, F.lit(FIRST_WORDS)), " ").alias("body")).orderBy("h", "body").limit(texts).collect()
    sample = [r["body"] for r in rows]
    rng = np.random.default_rng(seed)
    numbers, hashes, lengths = _numbered(pa.array(sample, pa.string()))
    token = _bucket(numbers, hashes, buckets)
    base = np.bincount(token, minlength=buckets + 1) + 0.01
    emit = base * np.exp(rng.normal(0, 1, (states, buckets + 1)))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1)), emit / emit.sum(axis=1, keepdims=True))
    for _ in range(rounds if lengths.size else 0):
        got = chain.run(model.emit.T[token], lengths, model.start, model.move, posteriors=True)
        model = _normalised(Hmm(got.starts, got.moves, np.array([np.bincount(token, got.gamma[:, s], buckets + 1) for s in range(states)])))
    return model


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = 4, buckets: int = 4096, rounds: int = 2, first_texts: int = 300, first_rounds: int = 15, broadcast_words: int = 6_000_000, seed: int = 3,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs, whole texts.

    The model: a word belongs to the bucket of its hash; hidden states move from word to word and emit buckets;
    a bucket emits its words by their counts, with 0.1 added to each and to one unknown word. After a start from
    `first_texts` texts, `rounds` of Baum-Welch run over all training texts; their expected counts are summed in
    the tasks and then by groups of tasks. score is the base-10 logarithm of the text's probability, by exact
    forward recursion over the whole text. base_score is the add-0.1 unigram's.

    Word counts (16 bytes a distinct word) are broadcast where there are at most `broadcast_words`; beyond that
    the texts' distinct words are joined with them. Null texts are empty; rows with a null id are scored, not
    trained on; an empty training set gives every token the unknown word's share; other columns are not read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    given = given.withColumn("held_out", held_out(F.col("doc_id"), 10, 0)).withColumn("train", ~F.col("held_out") & F.col("doc_id").isNotNull())
    read = _read_words(given, buckets)
    tokens = read.filter("tokens is not null").select("tokens")
    counts = materialize(read.filter("h is not null").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    texts = tokens.count()
    per_bucket = counts.groupBy(F.expr(f"cast(pmod(pmod(h, {buckets}) + IF(h < 0, {2**64 % buckets}, 0), {buckets}) as int)").alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow().to_pandas()
    mass, kinds = np.zeros(buckets + 1), np.zeros(buckets + 1)
    mass[per_bucket["b"]], kinds[per_bucket["b"]] = per_bucket["c"], per_bucket["v"]
    n = int(mass.sum()) + texts
    distinct = int(kinds.sum()) + (texts > 0)
    model = _first_model(given, states, buckets, first_texts, first_rounds, seed)
    for _ in range(rounds if texts else 0):
        model = _normalised(_expectations(tokens, model))
    small = distinct <= broadcast_words
    table = None
    if small:
        rows = counts.toArrow()
        h = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        table = (h[order], rows["c"].to_numpy()[order].astype(np.uint32 if n < 2**32 else np.int64))
        del rows, h, order
    shared = spark.sparkContext.broadcast((model, mass, kinds, table))
    unigram = np.log10(n + 0.1 * (distinct + 1))

    def lookup(h: np.ndarray) -> np.ndarray:
        keys, values = shared.value[3]
        if not keys.size:
            return np.zeros(h.size, np.int64)
        at = np.minimum(np.searchsorted(keys, h), keys.size - 1)
        return np.where(keys[at] == h, values[at], 0).astype(np.int64)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mass, kinds, table = shared.value
        by_bucket = np.ascontiguousarray(m.emit.T)
        spread = np.log10(mass + 0.1 * (kinds + 1))
        for batch in batches:
            for rows, bodies in text_slices(batch, "body"):
                numbers, hashes, lengths = _numbered(bodies)
                token = _bucket(numbers, hashes, m.buckets)
                got = chain.run(by_bucket[token], lengths, m.start, m.move)
                out = {"row": rows.column("row"), "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": lengths, "hidden": got.loglik / np.log(10)}
                begin = np.cumsum(lengths) - lengths
                if table is not None:
                    c = np.append(lookup(hashes), texts)[numbers]
                    log = np.log10(c + 0.1)
                    out["n_known"] = np.add.reduceat((c > 0).astype(np.int64), begin)
                    out["base_score"] = np.add.reduceat(log - unigram, begin)
                    out["words"] = np.add.reduceat(np.where(numbers >= 0, log - spread[token], 0.0), begin)
                else:
                    end = np.cumsum(lengths)
                    distinct_words = [np.unique(numbers[x : y - 1], return_counts=True) for x, y in zip(begin, end, strict=True)]
                    out["h"] = pa.array([hashes[u].view(np.int64) for u, _ in distinct_words], pa.list_(pa.int64()))
                    out["tf"] = pa.array([f for _, f in distinct_words], pa.list_(pa.int64()))
                yield batch_of(**out)

    numbered = given.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "body")
    head = "row long, doc_id long, held_out boolean, n_tokens long, hidden double"
    if small:
        out = arrow_map(numbered, forward, f"{head}, n_known long, base_score double, words double")
        return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (F.col("hidden") + F.col("words")).alias("score"))
    wide = materialize(arrow_map(numbered, forward, f"{head}, h array<long>, tf array<long>"), "word-frequencies")
    of_end = float(np.log10(texts + 0.1) - unigram)
    spreads = spark.createDataFrame(pd.DataFrame({"b": np.arange(buckets), "spread": np.log10(mass + 0.1 * (kinds + 1))[:-1]}))
    each = wide.select("row", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("row", "x.h", "x.tf").join(counts, "h", "left")
    each = each.withColumn("c", F.coalesce("c", F.lit(0))).withColumn("b", F.expr(f"pmod(pmod(h, {buckets}) + IF(h < 0, {2**64 % buckets}, 0), {buckets})")).join(spreads, "b")
    sums = each.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - F.lit(unigram))).alias("base"),
        F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - F.col("spread"))).alias("words"),
    )
    return wide.drop("h", "tf").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.coalesce("known", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + F.lit(of_end)).alias("base_score"), (F.col("hidden") + F.coalesce("words", F.lit(0.0))).alias("score"),
    )
