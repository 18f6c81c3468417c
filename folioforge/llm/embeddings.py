"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.linking import spanning_labels
from folioforge.llm.shared import arrow_map, batch_of, connected_components, discard, give_back, materialize, salted_join

TILE = 2048  # vectors of one component that a task compares with as many others at a time
DENSE_TILE = 4096  # the same for vectors of a dense run
MISSED = 0.001  # share of pairs at the threshold that all passes together may miss
SCREEN = 1e-5  # single-precision cosines of unit vectors are closer than this to the exact ones

NO_LINKS = pd.DataFrame({"a": [], "b": []}, dtype=np.int64)


def _unit(raw: list[bytes], wide: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64 if wide else np.float32).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor sums leave the range of doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows of x and y have a cosine of `threshold` or more, in doubles; single precision where that is beyond doubt."""
    cos = x.astype(np.float32) @ y.astype(np.float32).T
    near = cos >= np.float32(threshold + SCREEN)
    i, j = np.nonzero(~near & (cos >= np.float32(threshold - SCREEN)))
    for at in range(0, i.size, 200_000):
        some = slice(at, at + 200_000)
        near[i[some], j[some]] = np.einsum("ij,ij->i", x[i[some]], y[j[some]]) >= threshold
    return near


def _plan(total: int, window: int, threshold: float) -> tuple[int, int]:
    """(passes, bits) for `total` vectors: bits of a key that leave a quarter of a window of spread vectors, and the passes that leave MISSED.

    Two vectors at the threshold agree on a bit with 1 - acos(threshold) / pi, however the others lie.
    """
    bits = min(62, max(0, int(np.ceil(np.log2(max(1, 4 * total) / window)))))
    agree = (1 - np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi) ** bits
    return (int(np.ceil(np.log(MISSED) / np.log1p(-agree))) if agree < 1 else 1), bits


def _tiles(chunks: Column, c: Column) -> Column:
    """The pairs of chunks that a row of chunk c takes part in: (ci, cj, role), role 2 where both are its own."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(c, x).alias("ci"), F.greatest(c, x).alias("cj"), F.when(x == c, 2).when(c < x, 0).otherwise(1).alias("role")))


def _links_of(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """Spanning links of the pairs that `near` marks between two lists of ids."""
    i, j = np.nonzero(near)
    if not i.size:
        return NO_LINKS
    ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    labels = spanning_labels(at[i], at[left.size + j], ids.size)
    moved = np.flatnonzero(labels != np.arange(ids.size))
    return pd.DataFrame({"a": ids[moved], "b": ids[labels[moved]]})


def _dense_links(reps: DataFrame, heads: DataFrame, window: int, threshold: float, wide: bool) -> DataFrame:
    """Spanning links (a, b) within the runs of over `window` rows that share a head in a pass.

    All rows of a run are compared with each other: a run is dealt into chunks, and each pair of chunks is a task's work.
    """
    dense = heads.groupBy("run").agg(F.count("*").alias("m")).filter(F.col("m") > window).withColumn("chunks", F.ceil(F.col("m") / DENSE_TILE).cast("int"))
    dense = materialize(dense, "dense-runs")
    total = dense.agg(F.sum("m")).first()[0] or 0
    dealt = salted_join(heads, dense, "run", "m", total).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    work = dealt.join(reps.select("rep", "raw"), "rep").select("run", "rep", "raw", F.explode(_tiles(F.col("chunks"), F.col("c"))).alias("p")).select("run", "p.ci", "p.cj", "p.role", "rep", "raw")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, role, rep = _unit(list(pdf["raw"]), wide), pdf["role"].to_numpy(), pdf["rep"].to_numpy()
        parts = (np.flatnonzero(role == 2),) * 2 if role[0] == 2 else (np.flatnonzero(role == 0), np.flatnonzero(role == 1))
        out = [NO_LINKS, *(_links_of(_near(x[parts[0][a : a + 512]], x[parts[1]], threshold), rep[parts[0][a : a + 512]], rep[parts[1]]) for a in range(0, parts[0].size, 512))]
        give_back()
        return pd.concat(out)

    return work.groupBy("run", "ci", "cj").applyInPandas(compare, "a long, b long")


def _passes(reps: DataFrame, window: int, threshold: float, seed: int, wide: bool) -> DataFrame:
    """Spanning links (a, b) that the passes find, written.

    In a pass every vector gets 64 random hyperplane bits, concatenated; rows are range-partitioned and sorted by
    them, and each is compared with the `window` rows before it. Rows of earlier partitions are compared in a
    second step, and where over a window of rows share the leading bits all of them
    are compared, so that dense places cost time and not links.
    """
    count = reps.count()
    passes, bits = _plan(count, window, threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                x = _unit(some.column("raw").to_pylist(), wide)
                planes = np.random.default_rng([seed, dim]).standard_normal((passes, 64, dim))
                for k in range(passes):
                    yield some, k, np.packbits(x @ planes[k].T >= 0, axis=1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, k, keys in keyed(batches):
            order = np.ascontiguousarray(keys).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)  # as signed numbers in the order of the bits
            yield batch_of(dim=some.column("dim"), **{"pass": pa.array(np.full(len(some), k, np.int32))}, key=order.view(np.int64), rep=some.column("rep"), raw=some.column("raw"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, k, keys in keyed(batches):
            head = np.ascontiguousarray(keys).view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(some), np.uint64)
            dim = some.column("dim").to_numpy().astype(np.uint64)
            yield batch_of(run=pa.StructArray.from_arrays([pa.array(dim.astype(np.int32)), pa.array(np.full(len(some), k, np.int32)), pa.array(head.astype(np.int64))], ["dim", "pass", "head"]), rep=some.column("rep"))

    def linked(x: np.ndarray, rep: np.ndarray, old: int) -> pd.DataFrame:
        """x: `old` rows seen before, then new ones; links of new rows with the `window` rows before each."""
        out = [NO_LINKS]
        for at in range(old, len(x), 512):
            low, end = max(0, at - window), min(len(x), at + 512)
            near = _near(x[at:end], x[low:end], threshold)
            back = np.arange(at, end)[:, None] - np.arange(low, end)
            out.append(_links_of(near & (back > 0) & (back <= window), rep[at:end], rep[low:end]))
        return pd.concat(out)

    def edge_rows(rows: pd.DataFrame, task: int, side: int) -> pd.DataFrame:
        return pd.DataFrame({"a": rows["rep"], "b": 0, "dim": rows["dim"], "pass": rows["pass"], "task": task, "side": side, "at": np.arange(len(rows)), "raw": rows["raw"]})

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held, head, seen = None, 0, 0

        def close() -> Iterator[pd.DataFrame]:
            yield edge_rows(held, task, 0)
            yield pd.DataFrame({"a": [seen], "b": 0, "dim": held["dim"].iloc[:1].to_numpy(), "pass": held["pass"].iloc[:1].to_numpy(), "task": task, "side": 2, "at": 0, "raw": b""})

        for pdf in batches:
            for (dim, k), part in pdf.groupby(["dim", "pass"], sort=True):
                keep = held is not None and held["dim"].iloc[0] == dim and held["pass"].iloc[0] == k
                if not keep:
                    if held is not None:
                        yield from close()
                    held, head, seen = None, 0, 0
                if head < window:  # the head of a pass's rows here goes with what lies before
                    yield edge_rows(part.iloc[: window - head], task, 1).assign(at=lambda rows, h=head: rows["at"] + h)
                    head += min(len(part), window - head)
                rows = pd.concat([held, part]) if keep else part
                found = linked(_unit(list(rows["raw"]), wide), rows["rep"].to_numpy(), len(held) if keep else 0)
                if len(found):
                    yield found.assign(dim=dim, task=task, side=3, at=0, raw=b"", **{"pass": k})[["a", "b", "dim", "pass", "task", "side", "at", "raw"]]
                held, seen = rows.iloc[-window:], seen + len(part)
        if held is not None:
            yield from close()
        give_back()

    parts = max(1, min(count * passes // (4 * window), 100_000))
    ordered = arrow_map(reps, spread, "dim int, pass int, key long, rep long, raw binary").repartitionByRange(parts, "dim", "pass", "key", "rep").sortWithinPartitions("dim", "pass", "key", "rep")
    found = materialize(ordered.mapInPandas(slide, "a long, b long, dim int, pass int, task int, side int, at int, raw binary"), "passes")
    spans = sorted((r["dim"], r["pass"], r["task"], r["a"]) for r in found.filter("side = 2").select("dim", "pass", "task", "a").collect())  # a row per pass and task
    goes = []
    for at, (dim, k, task, _) in enumerate(spans):  # the rows that end a task's part precede those of the next tasks, until a window of rows lies between
        between = 0
        for later in range(at + 1, len(spans)):
            dim2, k2, task2, n = spans[later]
            if (dim2, k2) != (dim, k) or between >= window:
                break
            goes.append((dim, k, task, task2))
            between += n
    route = reps.sparkSession.createDataFrame(goes, "dim int, pass int, task int, edge int")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "side", "at"])
        new = pdf["side"].to_numpy() == 1
        if new.all() or not new.any():
            return NO_LINKS
        pdf = pd.concat([pdf[~new].iloc[-window:], pdf[new]])
        out = linked(_unit(list(pdf["raw"]), wide), pdf["a"].to_numpy(), len(pdf) - int(new.sum()))
        give_back()
        return out

    before = found.filter("side = 0").join(F.broadcast(route), ["dim", "pass", "task"])  # route: a few rows a task
    after = found.filter("side = 1").withColumn("edge", F.col("task"))
    across = before.unionByName(after).groupBy("edge", "dim", "pass").applyInPandas(meet, "a long, b long")
    heads = materialize(arrow_map(reps, prefixes, "run struct<dim: int, pass: int, head: bigint>, rep long"), "pass-heads")
    links = found.filter("side = 3").select("a", "b").unionByName(across).unionByName(_dense_links(reps, heads, window, threshold, wide))
    out = materialize(links.distinct(), "pass-links")
    discard(found, heads)
    return out


def _count_links(members: DataFrame, total: int, threshold: float, wide: bool) -> DataFrame:
    """(rep, links): vectors of the same component that link with each rep, by comparing all of them in tiles.

    members: component, rep, n, raw. A component of over TILE vectors is dealt into chunks, and each pair of
    chunks is compared on its own; only sums leave a task.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m")).withColumn("chunks", F.ceil(F.col("m") / TILE).cast("int"))
    dealt = salted_join(members, sizes, "component", "m", total).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    work = dealt.select("component", "rep", "n", "raw", F.explode(_tiles(F.col("chunks"), F.col("c"))).alias("p")).select("component", "p.ci", "p.cj", "p.role", "rep", "n", "raw")
    work = work.repartition("component", "ci", "cj").sortWithinPartitions("component", "ci", "cj")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, role = _unit(list(pdf["raw"]), wide), pdf["n"].to_numpy(), pdf["role"].to_numpy()
        if role[0] == 2:
            near = _near(x, x, threshold)
            np.fill_diagonal(near, False)
            return pd.DataFrame({"rep": pdf["rep"], "links": near @ n})
        left, right = role == 0, role == 1
        near = _near(x[left], x[right], threshold)
        return pd.DataFrame({"rep": np.concatenate([pdf["rep"][left], pdf["rep"][right]]), "links": np.concatenate([near @ n[right], near.T @ n[left]])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            rows = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
            ids = rows[["component", "ci", "cj"]].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tile(rows.iloc[a:b])
            held = rows.iloc[cuts[-1] :]
        if held is not None and len(held):
            yield tile(held)
        give_back()

    return work.mapInPandas(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, window: int = 2048, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vec_id; vectors link at cosine >= threshold, in doubles.

    Equal vectors are one class. Passes find links between classes, components are their closure, and n_links
    counts exactly within components. The number of passes follows from the table's size (_plan). The
    search is approximate: two vectors that share the leading bits in no pass, and that no chain of found links
    joins, are missed: at the threshold at most MISSED of such pairs, whatever the table; the README has measured recall.
    Null vectors, and those that are zero, empty or hold null, NaN or infinite components, link with nothing;
    vectors of different length do not link; rows with a null id are left out; of rows that share an id the
    smallest vector counts; an empty table gives no rows; other columns are not read.
    """
    wide = "float" not in vectors.select(vec_col).schema[0].dataType.simpleString()  # single precision is carried as it is
    given = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    one = given.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("sound", sound)
    rows = materialize(one.withColumn("twin", F.struct(F.xxhash64("vec").alias("x"), F.xxhash64(F.lit(1), "vec").alias("y"))), "vectors")  # 128 bits stand for a vector

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, np.float64 if wide else np.float32).tobytes() for v in batch.column("vec").to_numpy(zero_copy_only=False)]
            yield batch_of(twin=batch.column("twin"), rep=batch.column("rep"), n=batch.column("n"), dim=pa.array([len(r) // (8 if wide else 4) for r in raw], pa.int32()), raw=pa.array(raw, pa.binary()))

    grouped = rows.filter("sound").groupBy("twin").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = materialize(arrow_map(grouped, packed, "twin struct<x: bigint, y: bigint>, rep long, n long, dim int, raw binary"), "vector-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = _passes(classes.drop("twin"), window, threshold, seed, wide)
    reached = materialize(connected_components(found), "vector-components")
    joined = classes.join(reached, classes["rep"] == reached["node"]).select("component", "rep", "n", "raw")
    counted = _count_links(joined, total, threshold, wide)
    per_class = (
        classes.select("twin", "rep", "n")
        .join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(counted, "rep", "left")
        .select("twin", "n", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    named = salted_join(rows.filter("sound").select("vec_id", "twin"), per_class, "twin", "n", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
