"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import chain
from folioforge.llm.quality import held_out
from folioforge.llm.shared import arrow_map, batch_of, counted_words, lowest, text_slices

SLOTS = 1 << 16  # hashed features
SPAN, SPANS = 24, 8  # words of a run, and runs of a text, that are learned from


@dataclass(frozen=True)
class Crf:
    langs: tuple[str, ...]
    weights: np.ndarray  # SLOTS x languages
    move: np.ndarray
    start: np.ndarray


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the words, one after another, and how many each has.

    The letters of a word, lower-cased and between marks of its ends, give runs of 2, 3 and 4 bytes (those that
    hold a mark are its affixes) and the whole word (its lexicon entry). A word without letters has none.
    """
    letters = ["".join(filter(str.isalpha, w)) for w in words]
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" if w else b"" for w in letters]
    size = np.array([len(r) for r in raw], np.int64)
    if not size.sum():
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    slots, owners = [], []
    h = np.zeros(x.size, np.uint64)
    for n in range(1, 5):
        h = h[: x.size - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
        if n > 1:
            inside = owner[: h.size] == owner[n - 1 :]
            mixed = (h[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            slots.append(mixed >> np.uint64(48))
            owners.append(owner[: h.size][inside])
    spot = np.arange(x.size) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.concatenate(([1], np.full(int(size.max()), 0x1F3D5B79))).astype(np.uint64))
    whole = np.zeros(len(raw), np.uint64)
    np.add.at(whole, owner, (x + np.uint64(7)) * power[spot])
    some = size > 0
    slots.append((whole[some] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    owners.append(np.flatnonzero(some))
    slots, owners = np.concatenate(slots).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.bincount(owners, minlength=len(raw))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Row sums of consecutive runs of `counts` rows; runs may be empty."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def fit(texts: list[str], langs: list[str], *, sequences: int = 3000, epochs: int = 5, seed: int = 9) -> Crf:
    """Weights by stochastic gradients of the conditional likelihood.

    Training sequences are spliced from 1 to 3 spans of 8 to 24 words of random texts, languages drawn evenly, so
    that the transitions see switches of language as well as none.
    """
    names = tuple(sorted(set(langs)))
    count = len(names)
    weights, move, start = np.zeros((SLOTS, count)), np.eye(count) * 2.0, np.zeros(count)
    pools = [[w for t, g in zip(texts, langs, strict=True) if g == name for w in [t.lower().split()] if any(c.isalpha() for c in t)] for name in names]
    pools = {k: p for k, p in enumerate(pools) if p}
    if count < 2 or not pools:
        return Crf(names, weights, move, start)
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(sequences):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.choice(list(pools)))
            source = pools[k][int(rng.integers(len(pools[k])))]
            n = int(rng.integers(8, 25))
            a = int(rng.integers(0, max(1, len(source) - n)))
            words += source[a : a + n]
            labels += [k] * len(source[a : a + n])
        made.append((words, np.array(labels)))
    prepared = [(*word_features(w), y) for w, y in made]
    grown, g_move, g_start = np.full((SLOTS, count), 1e-3), np.full((count, count), 1e-3), np.full(count, 1e-3)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(prepared)), max(1, len(prepared) // 100)):
            slots = np.concatenate([prepared[k][0] for k in batch])
            per = np.concatenate([prepared[k][1] for k in batch])
            y = np.concatenate([prepared[k][2] for k in batch])
            lengths = np.array([len(prepared[k][2]) for k in batch])
            emit = _sums(weights[slots], per)
            got = chain.run(np.exp(emit - emit.max(axis=1, keepdims=True)), lengths, np.exp(start), np.exp(move), posteriors=True)
            error = np.eye(count)[y] - got.gamma
            error_slots = np.repeat(error, per, axis=0)
            gradient = np.stack([np.bincount(slots, error_slots[:, k], SLOTS) for k in range(count)], axis=1) / len(batch) - 1e-6 * weights
            begin = np.cumsum(lengths) - lengths
            inner = np.ones(y.size, bool)
            inner[begin] = False
            pairs = np.zeros((count, count))
            np.add.at(pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            d_move = (pairs - got.moves) / len(batch)
            d_start = (np.bincount(y[begin], minlength=count) - got.starts) / len(batch)
            for value, total, d in ((weights, grown, gradient), (move, g_move, d_move), (start, g_start, d_start)):
                total += d * d
                value += 0.3 * d / np.sqrt(total)
    return Crf(names, weights.astype(np.float32), move, start)


def label_words(texts: pa.Array, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each language for every white-space word of the texts, one after another; words of each text."""
    numbers, distinct, lengths = counted_words(texts, ascii_only=False)
    if not numbers.size:
        return np.empty((0, len(model.langs))), lengths
    table = np.empty((len(distinct), len(model.langs)))
    for at in range(0, len(distinct), 20_000):
        slots, per = word_features(distinct[at : at + 20_000].to_pylist())
        emit = _sums(model.weights[slots].astype(float), per)
        table[at : at + 20_000] = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -300))
    got = chain.run(table[numbers], lengths[lengths > 0], np.exp(model.start), np.exp(model.move), posteriors=True)
    return got.gamma, lengths


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 600) -> Crf:
    """Fit on the `sample` labelled texts of each language whose ids hash lowest: the bound of the training set.

    Of each of them up to SPANS runs of SPAN words, from all over the text, reach the driver. Rows whose crc32(id) mod 4 is
    2, and null labels or texts, are never used.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang")).filter("doc_id is not null and body is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    chosen = lowest(given.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang"), sample, ["h", "doc_id"], by="lang").distinct()
    words = F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " ")
    runs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n")), F.greatest(F.lit(SPAN), F.ceil(F.col("n") / SPANS)).cast("int"))
    some = given.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("w", words).withColumn("n", F.size("w"))  # chosen: `sample` rows a language
    rows = some.select("h", "lang", F.explode(F.transform(runs, lambda i: F.array_join(F.slice("w", i, F.lit(SPAN)), " "))).alias("span")).orderBy("h", "lang", "span").toArrow()
    return fit(rows["span"].to_pylist(), rows["lang"].to_pylist())


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 600) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of docs, whole texts.

    Words are labelled by forward-backward; lang_pred is the language with the largest mean posterior over the
    words that have letters, score that mean; of equal ones the first by name. Null texts and texts without letters
    are `und` with score 0, and so is every text where nothing could be learned. Rows with a null id are predicted,
    not learned from; repeated rows each get their row; columns besides id, text and language are not read.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, bodies in text_slices(batch, "body"):
                texts = pa.array([t if any(map(str.isalpha, t)) else "" for t in bodies.to_pylist()], pa.string())
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if model.langs:
                    gamma, lengths = label_words(texts, model)
                    some = np.flatnonzero(lengths)
                    if some.size:
                        end = np.cumsum(lengths[some])
                        sums = np.add.reduceat(gamma, end - lengths[some], axis=0)
                        share = sums / sums.sum(axis=1, keepdims=True)
                        best = share.argmax(axis=1)
                        lang[some], score[some] = np.array(model.langs, object)[best], np.clip(share[np.arange(some.size), best], 0, 1)
                yield batch_of(doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), lang_pred=pa.array(lang, pa.string()), score=score)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return arrow_map(given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "body"), run, "doc_id long, held_out boolean, lang_pred string, score double")
