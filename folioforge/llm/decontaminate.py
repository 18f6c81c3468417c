"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.shared import free_name, let, materialize

FEW_PAIRS = 500_000  # candidate pairs that are broadcast, about 16 bytes each


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: Column, widths: list[int]) -> Column:
    """xxhash64 of every run of words of the widths, once each."""
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))
    made = [F.when(F.size(words) >= k, runs(k)).otherwise(F.array().cast("array<bigint>")) for k in widths]
    return F.array_distinct(F.concat(*made) if len(made) > 1 else made[0])


def _shingles(words: Column, widths: list[int]) -> Column:
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    made = [F.when(F.size(words) >= k, runs(k)).otherwise(F.array().cast("array<string>")) for k in widths]
    return F.array_distinct(F.concat(*made) if len(made) > 1 else made[0])


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that holds `threshold` or more of an item's distinct shingles.

    Shingles are runs of k words; an item of fewer words is one shingle, and documents are shingled at the lengths of
    such items as well, so short items are found inside long documents. Items fall into partitions by the power of two
    of their shingle count q. An item's sketch is its MinHash values in hash order, the q - ceil(threshold * q) + 1
    lowest: a document that holds ceil(threshold * q) of the shingles must hold one of them, so the search loses
    nothing. A document probes only partitions whose smallest item could fit into it. Candidates are verified on the
    shingle strings. Null, empty and wordless texts match nothing; texts of any length count whole; null ids of documents or
    items are left out; repeated rows of one id count once, with the largest share; an empty table gives no rows;
    other columns are not read.
    """
    wanted = F.ceil(F.lit(threshold) * F.col("q") - F.lit(1e-9))
    worded = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    short = sorted(r[0] for r in worded.filter(F.size("w") < k).select(F.size("w")).distinct().collect())  # fewer than k numbers
    own = lambda make, w: F.when(F.size(w) >= k, make(w, [k])).otherwise(_one_run(make, w, short))
    tests = (
        worded.select("item_id", let(F.col("w"), lambda w: own(_shingles, w)).alias("item_shingles"), let(F.col("w"), lambda w: own(_hashes, w)).alias("h"))
        .withColumn("q", F.size("item_shingles"))
        .withColumn("part", F.floor(F.log2(F.col("q") + 0.5)).cast("int"))
    )
    sketch = tests.select("item_id", "part", F.explode(F.slice(F.array_sort("h"), F.lit(1), (F.col("q") - wanted + 1).cast("int"))).alias("h"))
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    widths = [*short, k]
    probes = (
        source.select("doc_id", let(words_of(F.col("body")), lambda w: _hashes(w, widths)).alias("hs"))
        .select("doc_id", let(F.col("hs"), lambda h: F.struct(F.size(h).alias("n"), h.alias("hs"))).alias("x"))
        .select("doc_id", F.col("x.n").alias("n"), F.explode_outer("x.hs").alias("h"))  # outer: an inner explode would have its size tested, and all hashed, a second time
    )
    hits = probes.join(sketch, "h").filter(F.col("n") >= F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), F.col("part")) - F.lit(1e-9)))
    pairs = materialize(hits.select("doc_id", "item_id").distinct(), "leak-candidates")
    per_doc = pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids"))
    if pairs.count() <= FEW_PAIRS:  # else the texts are shuffled to their candidates
        per_doc = F.broadcast(per_doc)
    asked = source.join(per_doc, "doc_id").select("doc_id", "item_ids", let(words_of(F.col("body")), lambda w: _shingles(w, widths)).alias("s"))
    judged = asked.select("doc_id", "s", F.explode("item_ids").alias("item_id")).join(tests.select("item_id", "item_shingles", "q"), "item_id")
    return (
        judged.select("doc_id", "item_id", F.col("q").alias("n_shingles"), F.size(F.array_intersect("item_shingles", "s")).alias("n_shared"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
        .filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)))
        .select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


def _one_run(make, words: Column, short: list[int]) -> Column:
    """The one shingle of a text of fewer than k words."""
    empty = F.array().cast("array<string>" if make is _shingles else "array<bigint>")
    made = empty
    for n in short:
        made = F.when(F.size(words) == n, make(words, [n])).otherwise(made)
    return made


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no item as find_leaks() says; ids play no part, null texts stay."""
    digest = F.md5(F.col(text_col).cast("binary"))
    name = free_name(docs, "digest")
    leaks = find_leaks(docs.select(digest.alias("digest"), F.col(text_col).alias("body")), items, id_col="digest", text_col="body", k=k, threshold=threshold)
    bad = materialize(leaks.select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(bad, digest == F.col(name), "left_anti")
