"""SimHash near-duplicates: fingerprints of word shingles linked through BK-trees of shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.linking import BKForest, spanning_edges
from folioforge.llm.shared import arrow_map, batch_of, connected_components, counted_words, discard, free_name, materialize, salted_join, slices, text_slices

SHARD_ROWS = 8192  # fingerprints of one shard that one task holds; larger shards are split into pairs of chunks
FRONTIER = 4_000_000  # query-member pairs that a batch of queries could reach at most


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII white space, `width`-word shingles with repeats.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fewer words than `width`: the whole
    sequence is the one shingle. No words, or null: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    return int(majority(hashes.reshape(-1, 1))[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of the bits that are set in over half of the rows of hashes (rows x words)."""
    octets = hashes.view(np.uint8).reshape(len(hashes), -1)
    width = octets.shape[1]
    ones = np.zeros((width, 8), np.int64)
    for at in range(0, len(hashes), 65536):
        counts = np.bincount((octets[at : at + 65536] + 256 * np.arange(width)).ravel(), minlength=256 * width)
        ones += counts.reshape(width, 256) @ _BITS
    return np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bodies in text_slices(batch, "body"):
                fps = np.array([fingerprint(t, width) for t in bodies.to_pylist()], np.uint64).view(np.int64)
                yield batch_of(doc_id=rows.column("doc_id"), fp=fps)

    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return arrow_map(source, run, "doc_id long, fp long")


def _masks(radius: int) -> list[int]:
    """Bit masks of which one at least is free of differences wherever two fingerprints differ in `radius` bits or fewer."""
    blocks = radius + 2
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    each = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(each, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints at distance `radius` or less.

    prints: fp, rep, distinct fp. A shard holds the fingerprints that agree on one of the masks, so two linked ones
    meet in a shard.
    """
    masks = [_signed(m) for m in _masks(radius)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    return _shard_links(prints, keys, ["fp"], radius, len(masks) * prints.count()).select("a", "b").distinct()


def _shard_links(prints: DataFrame, keys: Column, words: list[str], radius: int, total: int) -> DataFrame:
    """Links (a, b) of rep that span, in each shard, what lies at distance `radius` or less; the nearest pairs first.

    keys: the shards of a row, an array of structs (t, key); `total` rows of shards in all. Each shard's BK-tree is built and searched in the task that holds the shard, as trees
    of all fingerprints would grow with the data and not fit a broadcast. Shards of over SHARD_ROWS are dealt
    into chunks, and each pair of chunks is a task's work, so no shard needs one machine. A task returns a spanning
    forest of the links it finds, never more rows than it holds.
    """
    shards = prints.select(*words, "rep", F.explode(keys).alias("s"))
    hot = shards.groupBy("s").agg(F.count("*").alias("m")).filter(F.col("m") > SHARD_ROWS).withColumn("chunks", F.ceil(F.col("m") / SHARD_ROWS).cast("int"))
    dealt = salted_join(shards, hot, "s", "m", total, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda x: F.struct(F.least("c", x).alias("ci"), F.greatest("c", x).alias("cj"), F.when(x == F.col("c"), 2).when(F.col("c") < x, 0).otherwise(1).alias("role")),
    )
    work = dealt.select("s.t", "s.key", *words, "rep", F.explode(pairs).alias("p")).select("t", "key", "p.ci", "p.cj", "p.role", *words, "rep")
    work = work.repartition("t", "key", "ci", "cj").sortWithinPartitions("t", "key", "ci", "cj", "rep")

    def search(group: np.ndarray, role: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = np.flatnonzero(role != 1)
        ask = np.flatnonzero(role != 0)
        forest = BKForest(group[tree], fp[tree])
        size = np.bincount(group[tree], minlength=int(group.max()) + 1)
        ask = ask[size[group[ask]] > (role[ask] == 2)]
        cost = np.cumsum(size[group[ask]])
        at = 0
        held = [np.empty(0, np.int64)] * 3
        while at < ask.size:
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER // len(words), "right")))
            some = ask[at:end]
            q, m, d = forest.within(group[some], fp[some], radius)
            i, j = some[q], tree[m]
            low, high = np.minimum(i, j), np.maximum(i, j)
            apart = low != high
            found = [np.concatenate([h, x[apart]]) for h, x in zip(held, (low, high, d), strict=True)]
            keep = spanning_edges(*found, group.size)  # a forest of the links so far: no more rows than the task holds
            held = [x[keep] for x in found]
            at = end
        if held[0].size:
            yield batch_of(a=rep[held[0]], b=rep[held[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            if several.any():
                group = np.unique(group[several], return_inverse=True)[1]
                column = lambda c: rows.column(c).to_numpy()[several]
                yield from search(group, column("role"), np.stack([column(w).view(np.uint64) for w in words], axis=1), column("rep"))

        def starts(rows: pa.Table) -> np.ndarray:
            ids = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "ci", "cj")], axis=1)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
            return new

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= 50_000:  # search what is complete; the last shard may go on
                whole = pa.concat_tables(held).combine_chunks()
                new = starts(whole)
                cut = int(np.flatnonzero(new)[-1])
                if cut:
                    yield from flush(whole.slice(0, cut), new[:cut])
                held = [whole.slice(cut)]
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            if len(whole):
                yield from flush(whole, starts(whole))

    return arrow_map(work, run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs; documents link at `radius` or fewer differing bits.

    component_id is the smallest doc_id reachable by links. Equal fingerprints are one class, so copies meet no
    tree and are never paired. Null, empty and wordless texts have fingerprint zero and link like any other; texts of
    any length count whole; rows with a null id are left out; repeated rows each get their row; an empty table gives
    no rows; other columns are not read.
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    reached = connected_components(links(classes, radius))
    named = classes.join(reached, classes["rep"] == reached["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return salted_join(prints, named, "fp", "n", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WIDE = 256  # bits of the fingerprints that similar texts are searched by
UNSEEN = 0.005  # share of pairs at the least similarity that agree on no mask, or differ in more bits than the radius; the prefixes find these
ORDER_TEXTS = 8000  # rows, about, whose shingles tell which ones are common
SKETCH = 256  # bins that a set's shingles are counted in, up to 255 each
TASK_SHINGLES = 500_000  # shingles of prefixes that are searched together
DEALT_TEXTS = 4000  # texts whose prefixes are dealt together
SIGNED_CHARS = 1_000_000  # characters of the texts that are signed together: a worker takes 177 MB, 271 with 4 million
FEW = 20  # texts of a shingle that are compared before their sketches are read
SKETCH_PAIRS = 20_000  # pairs whose sketches are compared together
ORDER_SHINGLES = 200_000  # common shingles that are broadcast, 16 bytes each


def shingle_hashes(bodies: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of each text's distinct `width`-word shingles, sorted, and two 64-bit hashes of each text's word sequence.

    Words are lower-cased (A-Z) and stand between ASCII white space; a text of fewer words is one shingle.
    """
    numbers, distinct, lengths = counted_words(bodies)
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[numbers]
    owner = np.repeat(np.arange(lengths.size), lengths)
    place = np.arange(numbers.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(numbers.size, np.uint64)
    for k in range(width):
        inside = place + k < lengths[owner]
        h[inside] = _mixed(h[inside] * odd + of_word[np.flatnonzero(inside) + k])
    keep = place <= np.maximum(lengths[owner] - width, 0)
    sequence = np.zeros((2, lengths.size), np.uint64)
    for k, salt in enumerate((np.uint64(0x632BE59BD9B4E019), np.uint64(0xD6E8FEB86659FD93))):
        np.add.at(sequence[k], owner, _mixed(of_word + _mixed(place.astype(np.uint64) * salt + salt)))
        sequence[k] = _mixed(sequence[k] + lengths.astype(np.uint64))
    owner, h = owner[keep], h[keep]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(h.size, bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], h[first], sequence[0], sequence[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wide_plan(total: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a mask, masks, radius) that leave UNSEEN of the pairs at `similarity`, for `total` different texts.

    Sets of shingles of one size and that Jaccard similarity have a cosine of 2 J / (1 + J), and a bit differs with
    acos / pi. Masks grow with the table, so that shards of unlike texts stay small, and their number with their bits.
    """
    differ = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    bits = max(8, int(np.ceil(np.log2(max(1, total) / 256))))
    agree = (1 - differ) ** bits
    masks = int(np.ceil(np.log(UNSEEN) / np.log1p(-agree))) if agree < 1 else 1
    return bits, masks, int(np.ceil(WIDE * differ + 3 * np.sqrt(WIDE * differ * (1 - differ))))


def similar_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(classes, components): classes of equal word sequences, linked where shingle sets have a Jaccard similarity of `similarity` or more.

    classes, written: rep (a number), first (of the class's row with the smallest id: no_id, doc_id, th the xxhash64 of the text, copies
    the rows that are equal in both). components: node (a rep), component, for classes with links.

    Fingerprints of WIDE bits, a bit set in over half of a text's distinct shingles' hashes, find candidates: texts
    that agree on one of a number of random bit masks meet in a shard, whose BK-tree is searched. Of the candidates
    of a shard the cheapest spanning forest is verified on the whole shingle sets, so groups of many like texts never
    give all their pairs. What this leaves apart is searched exactly: similar sets share a shingle of their prefixes
    (_prefixes), and every pair of texts of different groups that does, and whose sizes, places and sketches allow it, is verified
    as well. So no link is lost, and groups are the components of all links. Null, empty and wordless texts are one
    class; texts of any length count whole; rows without id take part; repeated rows are one class.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, text_col, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, bodies in text_slices(batch, "body", SIGNED_CHARS):
                owner, h, s0, s1 = shingle_hashes(bodies, width)
                prefix, size = _prefixes(owner, h, len(bodies), similarity, *common.value)
                row = np.arange(seen, seen + len(bodies))
                seen += len(bodies)
                wide = np.stack([_mixed(h + np.uint64((k + 1) * 0xA0761D6478BD642F % 2**64)) for k in range(WIDE // 64)], axis=1)
                cut = np.searchsorted(owner, np.arange(len(bodies) + 1))
                prints = np.array([majority(wide[a:b]) if b > a else np.zeros(WIDE // 64, np.uint64) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.uint64).reshape(-1, WIDE // 64)
                yield batch_of(doc_id=rows.column("doc_id"), th=rows.column("th"), row=row, size=size, prefix=prefix, sketch=_sketches(owner, h, len(bodies)), s0=s0.view(np.int64), s1=s1.view(np.int64), **{w: np.ascontiguousarray(prints[:, k]).view(np.int64) for k, w in enumerate(words)})

    words = [f"f{k}" for k in range(WIDE // 64)]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("body"))
    signed = materialize(arrow_map(source, sign, "doc_id long, th long, row long, size long, prefix array<long>, sketch binary, s0 long, s1 long, " + ", ".join(f"{w} long" for w in words)), "signatures")
    rows = signed.groupBy("s0", "s1", "doc_id", "th").agg(F.count("*").alias("copies"), F.min("row").alias("rep"), *[F.first(w).alias(w) for w in words])
    grouped = rows.groupBy("s0", "s1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "copies")).alias("first"), F.min("rep").alias("rep"), *[F.first(w).alias(w) for w in words])
    classes = materialize(grouped.select("first", *words, "rep"), "text-classes")
    total = classes.count()
    bits, masks, radius = _wide_plan(total, similarity)
    rng = np.random.default_rng(seed)
    keys = []
    for t in range(masks):
        on = np.zeros(WIDE, np.uint8)
        on[rng.choice(WIDE, bits, replace=False)] = 1
        parts = np.packbits(on, bitorder="little").view(np.uint64)
        keys.append(F.struct(F.lit(t).alias("t"), F.xxhash64(*[F.col(w).bitwiseAND(F.lit(_signed(int(m)))) for w, m in zip(words, parts, strict=True) if m]).alias("key")))
    found = materialize(_shard_links(classes, F.array(*keys), words, radius, masks * total).distinct(), "similar-pairs")
    linked = materialize(connected_components(_verified(found, classes, docs, id_col, text_col, width, similarity)), "similar-components")
    apart = materialize(_prefix_pairs(signed, classes, linked, similarity), "apart-pairs")
    if apart.head(1):
        more = _verified(apart, classes, docs, id_col, text_col, width, similarity)
        before, linked = linked, materialize(connected_components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "similar-components")
        discard(before)
    discard(signed, found, apart)
    return classes.select("rep", "first"), linked


def _common_shingles(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and counts) of shingles that 3 or more of about ORDER_TEXTS rows hold, ORDER_SHINGLES of them at most. They order prefixes; any list gives the same links."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bodies in text_slices(batch, "body"):
                h, c = np.unique(shingle_hashes(bodies, width)[1], return_counts=True)
                yield batch_of(h=h.view(np.int64), c=c.astype(np.int64))

    share = min(1.0, ORDER_TEXTS / max(1, docs.count()))
    some = docs.select(F.col(text_col).alias("body")).filter(F.rand(17) < share)
    counts = arrow_map(some, shingles, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c >= 3")
    rows = counts.orderBy(F.desc("c"), "h").limit(ORDER_SHINGLES).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy()[order]


def _prefixes(owner: np.ndarray, h: np.ndarray, texts: int, similarity: float, keys: np.ndarray, counts: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """(prefixes, sizes) of the texts' sorted shingle sets (owner, h): the first size - ceil(similarity * size) + 1, by their count in (keys, counts), then by hash.

    Two sets of that Jaccard similarity share ceil(similarity * size) of the larger one's shingles or more, so their
    prefixes in one order have a shingle in common.
    """
    size = np.bincount(owner, minlength=texts).astype(np.int64)
    if keys.size and h.size:
        at = np.minimum(np.searchsorted(keys, h), keys.size - 1)
        often = np.where(keys[at] == h, counts[at], 0)
        if often.any():
            h = h[np.lexsort((often, owner))]  # stable: equal counts stay in the order of their hashes
    most = np.where(size > 0, size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1, 0)
    place = np.arange(h.size) - np.repeat(np.cumsum(size) - size, size)
    kept = h[place < most[owner]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]).astype(np.int32)), pa.array(kept.view(np.int64))), size


def _prefix_pairs(signed: DataFrame, classes: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of classes of different groups in `linked` that share a shingle of their prefixes and may be similar by their sizes, its places and their sketches.

    Texts of one group are never paired, so the many shingles that like texts share cost no pairs. Shingles are dealt by
    hash to groups of about TASK_SHINGLES, as binary columns: 21 million rows of 0.5 GB of texts filled 3 GB of disk. Of
    each group the texts that may have a partner, a row each, get their sketches and meet again. Pairs leave a task only
    where the sketches allow the similarity: texts of like sizes that share some lines gave pairs by the square of their number.
    """

    def meetings(h: np.ndarray, group: np.ndarray, size: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of rows, sorted by shingle and group, that share a shingle h, not a group, and may be similar."""
        bucket = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        run = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (group[1:] != group[:-1])])) - 1
        begin = np.cumsum(np.bincount(run))[run]  # after the row's own group, to the end of its shingle
        n = np.cumsum(np.bincount(bucket))[bucket] - begin
        for a, b in slices(n.tolist(), FRONTIER):
            i = np.repeat(np.arange(a, b), n[a:b])
            j = np.arange(i.size) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + np.repeat(begin[a:b], n[a:b])
            x, y = size[i], size[j]
            most = np.minimum(pos[i], pos[j]) + 1 + np.minimum(x - pos[i], y - pos[j]) - 1  # shingles before and after this one that both may hold
            may = np.minimum(most, np.minimum(x, y)) >= similarity / (1 + similarity) * (x + y) - 1e-6
            yield i[may], j[may]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(a, DEALT_TEXTS) for a in range(0, batch.num_rows, DEALT_TEXTS)):
                prefix = rows.column("prefix")
                bounds = prefix.offsets.to_numpy().astype(np.int64)
                if bounds[0] == bounds[-1]:  # texts without words
                    continue
                many = np.diff(bounds)
                text = np.repeat(np.arange(many.size), many)
                h = prefix.values.to_numpy()[bounds[0] : bounds[-1]]
                place = np.arange(h.size) - np.repeat(bounds[:-1] - bounds[0], many)
                task = (_mixed(h.view(np.uint64)) % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(task, kind="stable")
                to, cut = np.unique(task[order], return_index=True)
                rep, grp, size = (rows.column(c).to_numpy() for c in ("rep", "grp", "size"))
                whole = {"h": h, "rep": rep[text], "grp": (grp ^ rep)[text], "size": size[text].astype(np.int32), "pos": place.astype(np.int32)}  # shuffled compressed: texts without a group give zeros
                sorted_ = {c: x[order] for c, x in whole.items()}
                ends = np.append(cut[1:], h.size)
                yield batch_of(task=to.astype(np.int32), **{c: pa.array([x[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()) for c, x in sorted_.items()})

    def by_task(search: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], None
            for batch in batches:
                task = batch.column("task").to_numpy()
                cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), task.size] if task.size else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and at != task[a]:
                        yield from search(at, held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    at = task[a]
            if held:
                yield from search(at, held)

        return run

    def met(task: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text that shares a shingle with another group: the numbers of such shingles and its places."""
        read = lambda c, kind: np.concatenate([np.frombuffer(b"".join(x.column(c).to_pylist()), kind) for x in held])
        h = read("h", np.int64)
        order = np.argsort(h)
        h, rep = h[order], read("rep", np.int64)[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        some = ~(new & np.append(new[1:], True))  # what one text alone holds goes first
        order, h, rep = order[some], h[some], rep[some]
        if not h.size:
            return
        group = rep ^ read("grp", np.int64)[order]
        place = np.lexsort((group, h))
        h, rep, group, order = h[place], rep[place], group[place], order[place]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        rows = np.diff(np.append(first, h.size))
        some = np.repeat(group[first] != group[first + rows - 1], rows)
        if not some.any():
            return
        few = np.repeat(rows <= FEW, rows)[some]
        h, rep, group, order = h[some], rep[some], group[some], order[some]
        size, pos = (read(c, np.int32)[order].astype(np.int64) for c in ("size", "pos"))
        keep = ~few  # all texts of a shingle of many, so that the time of this pass follows the shingles
        if few.any():
            own = np.flatnonzero(few)
            for i, j in meetings(h[few], group[few], size[few], pos[few]):
                keep[own[i]] = keep[own[j]] = True
        if not keep.any():
            return
        bucket = np.unique(h, return_inverse=True)[1][keep]
        rep, group, size, pos = rep[keep], group[keep], size[keep], pos[keep]
        order = np.lexsort((bucket, rep))
        start = np.flatnonzero(np.concatenate([[True], rep[order][1:] != rep[order][:-1]]))
        listed = lambda x: pa.ListArray.from_arrays(pa.array(np.append(start, order.size).astype(np.int32)), pa.array(x[order].astype(np.int32)))
        one = order[start]
        yield batch_of(task=pa.array(np.full(one.size, task, np.int32)), rep=rep[one], grp=group[one], size=size[one], buckets=listed(bucket), places=listed(pos))

    def paired(_: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, group, size = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("rep", "grp", "size"))
        sketch = np.concatenate([np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8) for x in held]).reshape(-1, SKETCH)
        bucket, pos = (np.concatenate([x.column(c).flatten().to_numpy() for x in held]).astype(np.int64) for c in ("buckets", "places"))
        text = np.repeat(np.arange(rep.size), np.concatenate([pc.list_value_length(x.column("buckets")).to_numpy() for x in held]))
        order = np.lexsort((group[text], bucket))
        text = text[order]
        for i, j in meetings(bucket[order], group[text], size[text], pos[order]):
            both = np.unique(np.minimum(text[i], text[j]) * rep.size + np.maximum(text[i], text[j]))
            for at in range(0, both.size, SKETCH_PAIRS):
                i, j = np.divmod(both[at : at + SKETCH_PAIRS], rep.size)
                may = _sketches_allow(sketch[i], sketch[j], size[i] + size[j], similarity)
                if may.any():
                    a, b = rep[i[may]], rep[j[may]]
                    yield batch_of(a=np.minimum(a, b), b=np.maximum(a, b))

    groups = classes.join(linked, classes["rep"] == linked["node"], "left").select("rep", F.coalesce("component", "rep").alias("grp"))
    rows = signed.select("row", "size", "prefix").join(groups, F.col("row") == F.col("rep")).select("rep", "grp", "size", "prefix")
    total = signed.agg(F.sum(F.size("prefix"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_SHINGLES))
    parts = "h binary, rep binary, grp binary, size binary, pos binary"
    work = arrow_map(rows, deal, f"task int, {parts}").repartition(tasks, "task").sortWithinPartitions("task")
    texts = arrow_map(work, by_task(met), "task int, rep long, grp long, size long, buckets array<int>, places array<int>")
    known = texts.join(signed.select(F.col("row").alias("rep"), "sketch"), "rep").repartition(tasks, "task").sortWithinPartitions("task")
    return arrow_map(known, by_task(paired), "a long, b long").distinct()


def _sketches(owner: np.ndarray, h: np.ndarray, texts: int) -> pa.Array:
    """Of each text, how many of its shingles fall into each of SKETCH bins, a byte each, 255 for more."""
    bins = owner * SKETCH + (_mixed(h) % np.uint64(SKETCH)).astype(np.int64)
    raw = np.minimum(np.bincount(bins, minlength=texts * SKETCH), 255).astype(np.uint8).tobytes()
    return pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(np.arange(0, SKETCH * (texts + 1), SKETCH, dtype=np.int32)), pa.py_buffer(raw)])


def _sketches_allow(x: np.ndarray, y: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of `both` shingles in sum may be similar by their sketches, rows of x and y: they differ in as many shingles as their bins' counts do, or more."""
    apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    return (both - apart) / 2 >= similarity / (1 + similarity) * both - 1e-6


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts' shingle sets are similar. One row of each class is read again, by its id and text."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bodies in text_slices(batch, "body"):
                owner, h, _, _ = shingle_hashes(bodies, width)
                cut = np.searchsorted(owner, np.arange(len(bodies) + 1)).astype(np.int32)
                yield batch_of(rep=rows.column("rep"), uses=rows.column("uses"), shingles=pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64))))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("uses"))
    wanted = classes.join(asked, "rep").select("rep", "uses", F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.no_id").alias("no_id"), F.col("first.th").alias("th"))
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("body"))
    one = given.join(wanted, ["id", "no_id", "th"]).groupBy("id", "no_id", "th").agg(F.first("body").alias("body"), F.first("rep").alias("rep"), F.first("uses").alias("uses"))
    sets = materialize(arrow_map(one.select("rep", "uses", "body"), listed, "rep long, uses long, shingles array<long>"), "shingle-sets")
    total = 2 * pairs.count()
    left = salted_join(pairs.withColumnRenamed("a", "rep"), sets.withColumnRenamed("shingles", "x"), "rep", "uses", total).withColumnRenamed("rep", "a")
    both = salted_join(left.withColumnRenamed("b", "rep"), sets.withColumnRenamed("shingles", "y"), "rep", "uses", total).withColumnRenamed("rep", "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - F.lit(1e-9)).select("a", "b")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, of which no similar text with a smaller id is in docs: one row of each group of similar_texts().

    Of a group the row with the smallest id stays, rows without an id last; of rows of one id and different texts in a
    group the text with the lowest hash; of rows equal in id and text any one.
    """
    classes, linked = similar_texts(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity)
    grouped = classes.join(linked, classes["rep"] == linked["node"], "left").select(F.coalesce("component", "rep").alias("group"), "first")
    i, n, t, c = (free_name(docs, x) for x in ("i", "n", "t", "c"))
    first = grouped.groupBy("group").agg(F.min("first").alias("x"))
    stay = materialize(first.select(F.coalesce("x.doc_id", F.lit(0)).alias(i), F.col("x.no_id").alias(n), F.col("x.th").alias(t), F.col("x.copies").alias(c)), "survivors")
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col(i)) & (F.col(id_col).isNull() == F.col(n)) & (F.xxhash64(text_col) == F.col(t))
    single = docs.join(stay.filter(F.col(c) == 1), same, "left_semi")
    if not stay.filter(F.col(c) > 1).head(1):
        return single
    several = docs.join(stay.filter(F.col(c) > 1), same).dropDuplicates([i, n, t]).drop(i, n, t, c)
    return single.unionByName(several)
