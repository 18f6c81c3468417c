"""Tables in the cluster's shared folder, Arrow tasks, joins on hot keys, bounded samples, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 20_000  # keys that salted_join() deals over several tasks, and broadcasts, at most
SLICE_CHARS = 4_000_000  # characters of the texts that are worked on together

_live: list[str] = []  # tables of materialize() that nobody discarded


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, even where the optimiser inlines it into a lambda or a pushed filter."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not: longer than all of its names."""
    return name + "_" * (1 + max(map(len, df.columns)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="folioforge-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by materialize() that nothing reads any longer."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path in _live:
            _live.remove(path)
            _delete(df.sparkSession, path)


def mark() -> int:
    """The place in the list of live tables, for sweep()."""
    return len(_live)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since mark(), but for those of `keep`. For callers that have written an operator's result, whose plan reads such tables."""
    kept = {getattr(df, "_table_path", None) for df in keep}
    for path in [p for p in _live[since:] if p not in kept]:
        _live.remove(path)
        _delete(spark, path)


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers outlive tasks and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it keeps its free pages
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run) with batches as they come: integers beside nulls stay integers, and a task leaves no memory behind."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def slices(lengths, most: int = 0) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `most` (SLICE_CHARS) in sum; what is longer is a range of its own."""
    begin = total = 0
    most = most or SLICE_CHARS
    for k, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def text_slices(batch: pa.RecordBatch, name: str, most: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts) in slices of about `most` bytes."""
    body = texts_of(batch, name)
    for a, b in slices(pc.binary_length(body).to_numpy(zero_copy_only=False).tolist(), most):
        yield batch.slice(a, b - a), body.slice(a, b - a)


def counted_words(bodies: pa.Array, *, ascii_only: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word, the distinct words, words of each text): lower-cased words between white space.

    ascii_only: A-Z are lower-cased and words stand between the ASCII white space, else all letters and all white space.
    """
    low, split = (pc.ascii_lower, pc.ascii_split_whitespace) if ascii_only else (pc.utf8_lower, pc.utf8_split_whitespace)
    parts = split(low(bodies))
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    bounds = np.concatenate([[0], np.cumsum(some)])[bounds - bounds[0]]
    coded = (flat if some.all() else flat.filter(pa.array(some))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.diff(bounds)


def batch_of(**columns) -> pa.RecordBatch:
    """A record batch of arrays (numpy or Arrow), by name."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right on `key`, wherever a key holds a large share of left's rows.

    right: one row per key; its column `rows` counts the key's rows in left, at most `total` in sum. Keys with more
    than a HOT_KEYS-th of the total are dealt over several tasks; there are fewer than HOT_KEYS of them, so the
    list of them is broadcast whatever the data. `rows` is dropped.
    """
    per = max(1000, total // HOT_KEYS)
    salts = F.ceil(F.col(rows) / F.lit(per)).cast("int")
    hot = right.filter(F.col(rows) > per).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"), F.lit(0))).drop("_hot", "_salts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(rows)
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def lowest(rows: DataFrame, sample: int, order: list[str], *, by: str | None = None) -> DataFrame:
    """The `sample` rows (of each value of `by`) whose `order` columns come first; order[0] must be an evenly spread 64-bit hash.

    Rows are first cut off at a hash that leaves a little over `sample` of them, so tasks sort and send few rows
    however large the table. Where the cut leaves too few, it is moved; the result is that of a full sort.
    """
    h = F.col(order[0])

    def counts(df: DataFrame) -> dict:
        return {r["g"]: r["count"] for r in df.select((F.col(by) if by else F.lit("")).alias("g")).groupBy("g").count().collect()}  # one row per value of `by`

    groups = counts(rows)
    share = {g: min(1.0, (sample + 6 * sample**0.5 + 20) / n) for g, n in groups.items()}
    while True:
        cut = F.lit(False)
        for g, s in share.items():
            below = F.lit(True) if s >= 1 else h < F.lit(int(s * 2.0**64) - 2**63)
            cut = cut | ((F.col(by).eqNullSafe(F.lit(g)) & below) if by else below)
        some = rows.filter(cut)
        left = counts(some)
        short = [g for g in groups if share[g] < 1 and left.get(g, 0) < sample]
        if not short:
            break
        share |= {g: min(1.0, share[g] * 2) for g in short}
    if by is None:
        return some.orderBy(*order).limit(sample)
    from pyspark.sql import Window

    return some.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_nth") <= sample).drop("_nth")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every linked node.

    edges: columns a, b (long), any direction, repeats and loops allowed. Returns (node, component) for each node
    that has a link to another node, the smallest id of its component included. Alternates the large-star and
    small-star operations (Kiveris et al., 2014) until nothing changes; every round is written to the shared
    folder, and a round moves at most as many rows as there are links. Nodes with many links are dealt over tasks.
    """
    tree = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = digest(tree)
    while before[0]:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("rows"))
        large = salted_join(both, least, "u", "rows", 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        small = (
            salted_join(large, least, "u", "rows", 2 * before[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        new = materialize(small, "links")
        discard(tree)
        tree, after = new, digest(new)
        if after == before:
            break
        before = after
    members = tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = members.unionByName(tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._table_path = tree._table_path
    return out
