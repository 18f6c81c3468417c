"""Quality classifier: a sparse ensemble of rules from trees over text statistics, compiled into Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.shared import arrow_map, free_name, lowest, text_slices
from folioforge.llm.trees import cut_points, grow, predict, rules_of

STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "marks", "space", "distinct_words", "top_word", "short_words", "lines", "distinct_lines", "stops", "ended_lines", "mixed_words", "distinct_pairs",
)
_UPPER, _DIGIT, _SPACE = (np.array([chr(b).isascii() and getattr(chr(b), f)() for b in range(256)]) for f in ("isupper", "isdigit", "isspace"))
_STOP, _COMMA = ord("."), ord(",")
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def statistics(text: str | None) -> tuple[float, ...]:
    """STATISTICS of a whole text, in order; all 0 for null, empty and blank texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = len(raw), len(words)
    often: dict[bytes, int] = {}
    for x in words:
        often[x] = often.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = int(counts[_PUNCT].sum())
    plain = int(counts[_STOP] + counts[_COMMA])
    return (
        float(n), float(w), n / w, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, (marks - plain) / n, marks / w, counts[_SPACE].sum() / n,
        len(often) / w, max(often.values()) / w, sum(len(x) <= 3 for x in words) / w, float(len(lines)), len(set(lines)) / len(lines), float(counts[_STOP]) / w,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(not x.strip(b".,;:!?\"'()").isalnum() for x in words if x.isascii()) / w,
        len(set(zip(words, words[1:], strict=False))) / max(1, w - 1),
    )


def with_statistics(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs, all columns as they are, and a column `into`: array of the text's STATISTICS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bodies in text_slices(batch, "_body"):
                values = np.array([statistics(t) for t in bodies.to_pylist()], float).reshape(-1, len(STATISTICS))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(bodies) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values.ravel()))
                kept = [rows.column(k) for k, name in enumerate(rows.schema.names) if name != "_body"]
                yield pa.RecordBatch.from_arrays([*kept, listed], [f"c{k}" for k in range(len(kept))] + ["stats"])

    given = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col(f"`{text_col}`").alias("_body"))
    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    out = arrow_map(given, run, f"{fields}, stats array<double>")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("stats").alias(into))


@dataclass(frozen=True)
class RuleEnsemble:
    """bias and (weight, rule) pairs; a rule is a conjunction of (statistic, is_low, cut)."""

    bias: float
    rules: tuple

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as an expression over the array of statistics."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for f, is_low, cut in rule:
                c = F.element_at(stats, f + 1)
                holds = holds & ((c <= cut) if is_low else (c > cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _lasso(a: np.ndarray, y: np.ndarray, strength: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / n + 1.0)
    w, bias = np.zeros(a.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w, bias, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(a @ v + vb))) - y) / n
        nw = v - step * (a.T @ error)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * strength, 0)
        nb = vb - step * error.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        if np.abs(nw - w).max(initial=0) < 1e-7 and abs(nb - bias) < 1e-7:
            w, bias = nw, nb
            break
        w, bias, t = nw, nb, nt
    return bias, w


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, strength: float = 5e-4, seed: int = 5) -> RuleEnsemble:
    """Boosted shallow trees on bootstrap samples give the rules, the lasso their weights. One class or no rows: no rules."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(float(4 * y.mean() - 2) if len(y) else 0.0, ())
    rng = np.random.default_rng(seed)
    cuts = cut_points(x)
    memory, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), max(1, len(y) // 2))
        pull = y - 1 / (1 + np.exp(-memory))
        tree = grow(x[rows], pull[rows], np.ones(len(rows)), cuts, depth, max(2, len(y) // 400), rng, max(4, x.shape[1] // 2))
        memory = memory + 0.5 * predict(tree, x)
        rules |= dict.fromkeys(rules_of(tree))
    columns, kept, seen = [], [], set()
    for rule in rules:
        holds = np.ones(len(y), bool)
        for f, is_low, cut in rule:
            holds &= (x[:, f] <= cut) == is_low
        mark = holds.tobytes()
        if 0 < holds.sum() < len(y) and mark not in seen:
            seen.add(mark)
            columns.append(holds)
            kept.append(rule)
    if not kept:
        return RuleEnsemble(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), ())
    bias, weights = _lasso(np.array(columns, float).T, y.astype(float), strength)
    return RuleEnsemble(float(bias), tuple((float(w), r) for w, r in zip(weights, kept, strict=True) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> RuleEnsemble:
    """Fit on the `sample` labelled rows whose ids hash lowest: the one bound of the training set. Rows whose crc32(id) mod 4 is 2 are never used.

    The rows are chosen by ids alone; only their texts are read, and only their statistics reach the driver.
    """
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null")
    chosen = lowest(given.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "y"), sample, ["h", "doc_id", "y"]).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "doc_id")  # chosen: at most `sample` rows
    rows = with_statistics(texts, "body", "stats").select("h", "doc_id", "y", "stats").toArrow()
    x = rows["stats"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y, rows["doc_id"].to_numpy(), rows["h"].to_numpy()))[:sample]
    return fit(x[order], y[order])


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `threshold` or more; each row by its own text.

    Null, empty and blank texts score as texts whose statistics are all 0, rows without an id like any other;
    columns of any name and repeated rows are kept.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    free = free_name(docs, "statistics")
    return with_statistics(docs, text_col, free).filter(model.score(F.col(free)) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs, whole texts of any length.

    score is the probability of label 1, predicted 1 where it is `threshold` or more. Null, empty and blank texts
    are scored as texts whose statistics are all 0. A null doc_id is never trained on and not held out. Labels other
    than 0 and 1 and repeated rows are allowed (each repeated labelled row counts, equal ones once); other columns are
    not read; without labels every score is one half.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    stats = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), "body", "stats")
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
