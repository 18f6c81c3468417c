"""Token ids, packing and id files against the tokenizers library and round trips."""

import tracemalloc
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import packing, queries, simple8b
from folioforge.llm.tokens import WordTokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTES, WORDS = WordTokenizer(BYTE, True), WordTokenizer(WORD, False)
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="ab .,\n\t'é́ 　\x1c!19ſΣ<|>", max_size=40))


def plain(words, text):
    return words.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_words_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for words in (BYTES, WORDS):
        ids, lengths = words.encode([*texts, None, "a <|endoftext|> b"], 2)
        want = [[*plain(words, t), 2] for t in [*texts, None, "a <|endoftext|> b"]]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.just(0)), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert simple8b.decode_block(simple8b.encode_block(ids), ids.size).tolist() == ids.tolist()


def test_shards_round_trip_and_runs_of_zeros_are_short():
    ids, lengths = np.concatenate([np.zeros(100_000), np.arange(70_000)]).astype(np.uint32), np.array([0, 100_000, 70_000])
    got = simple8b.read_shard(simple8b.encode_shard(ids, lengths))
    assert (got[0] == ids).all() and got[1].tolist() == lengths.tolist()
    assert len(simple8b.encode_block(np.zeros(60_000, np.uint32))) == 60_000 // 240 * 8
    assert len(simple8b.encode_block(np.full(4, 2**32 - 1, np.uint32))) == 32
    assert simple8b.read_shard(simple8b.encode_shard(ids[:0], lengths[:0]))[0].size == 0
    with pytest.raises(ValueError):
        simple8b.read_shard(b"x" * 60)


def test_combinations_fill_the_window():
    assert packing.combinations_of(5) == [(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1)]


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-7).all() and abs(gradient @ x) < 1e-7


def test_plan_of_all_bins_is_small():
    """All combinations of 256 bins: 16 MB a copy of the matrix; products of all their pairs would fill 250 MB of the driver."""
    tracemalloc.start()
    made = packing.plan(np.array([0, *np.random.default_rng(3).integers(1, 2000, 256)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.sequences > 0 and peak < 60e6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=17, max_size=17))
def test_plan_deals_every_piece_once(counts):
    counts = np.array([0, *counts[1:]])
    made = packing.plan(counts)
    room = np.zeros(made.sequences, int)
    for slot in range(1, 17):
        spans = sorted((lo, hi) for s, lo, hi, _, _ in made.deals if s == slot)
        assert [x for lo, hi in spans for x in range(lo, hi)] == list(range(counts[slot]))
    for s, lo, hi, per, first in made.deals:
        for r in range(lo, hi):
            room[first + (r - lo) // per] += s
    assert (room <= 16).all() and (room > 0).all()


def test_packing(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_pack(spark, sf).collect()
    ids = {i: np.array([*plain(WORDS, t), 2], "<u4") for i, t in texts.items()}
    seen, sequences = {i: 0 for i in texts}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[i] == len(ids[i]) for i in ids)
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert total / (4096 * len(sequences)) > 0.97


def test_pieces_are_all_that_packing_writes(spark, monkeypatch):
    """A table of counts would be a file of a few rows for each partition of their shuffle; on file systems without a native library each starts processes."""
    written, write = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, label: written.append(label) or write(df, label))
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(1, 40)], "doc_id long, text string").repartition(5)
    pieces = packing.pack(docs, WORD).collect()
    assert written == ["pieces"] and sum(r.length for r in pieces) == sum(3 * i + 1 for i in range(1, 40))


def test_id_files(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_ids(spark, sf).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array([*plain(BYTES, texts[i]), 2], "<u4")
        assert got[i] == (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)


def test_edges(spark):
    rows = [(3, None, "x", 1), (1, "", "x", 1), (2, "b c " * 3000, "x", 1), (2, "b c " * 3000, "x", 1), (None, "q", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, bin int")
    pieces = packing.pack(docs, WORD).collect()
    assert sum(r.length for r in pieces) == 1 + 1 + 2 * 6001 + 2
    back = simple8b.read_ids(simple8b.write_ids(docs, BYTE)).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, 1, 2, 2, 3] and back[-1].n_tokens == 1
    assert packing.pack(docs.limit(0), WORD).count() == 0 and simple8b.read_ids(simple8b.write_ids(docs.limit(0), BYTE)).count() == 0


LETTERS = ["İ,", "ALİ, VELİ.", "\u0958,", "\u09dc.", "\ufb2a!", "H\u0331, h E\u0301. x", "ΟΔΟΣ. ΟΔΟΣ, ς", "хорошо. Й! й", "don't. we'll, x's.", "a  b", " lead", "end \n", "a\n b", "a\nb.\nC", "a\n\nb", "\x01a \x02b", "ß. ẞ, ﬁ! ½ ２，", "ﬁn. ŉ, ǰ!"]


@pytest.mark.parametrize("path, joined", [(WORD, False), (BYTE, True)])
def test_the_library_gets_few_characters_at_once(path, joined):
    """It holds 100 bytes for each id it returns: 6 MB of texts without spaces took 600 MB of a worker."""
    words, given = WordTokenizer(path, joined), []

    class Told:
        def encode_batch_fast(self, strings, **options):
            given.append(sum(map(len, strings)))
            return library.encode_batch_fast(strings, **options)

        def encode(self, text, **options):
            return library.encode(text, **options)

    library, words.tokenizer = words.tokenizer, Told()
    random = np.random.default_rng(5)
    texts = ["".join(map(chr, random.integers(low, low + 16 * (1 + k % 900), 1000))) for low in (0x4E00, 0x30) for k in range(300)]
    texts += ["a few words", "", *(f"{k}-{k * k}" for k in range(30_000))]
    words.encode(texts[:1])
    ids, lengths = words.encode(texts)
    assert sum(given) > 600_000 and max(given) <= 200_000
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_letters_that_do_not_stay_letters():
    for words in (BYTES, WORDS):
        for texts in (LETTERS, [t + " " + u for t in LETTERS for u in LETTERS]):
            ids, lengths = words.encode(texts, 2)
            want = [[*plain(words, t), 2] for t in texts]
            assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_blocks_are_read_alone():
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 5000, 90)
    ids = rng.integers(0, 50_000, lengths.sum()).astype(np.uint32)
    names = np.arange(90) - 2**62
    shard = simple8b.Shard(simple8b.encode_shard(ids, lengths, names, names % 2 == 0))
    for a, b in ((0, 10), (65_530, 65_540), (70_000, 140_000), (ids.size - 3, ids.size), (5, 5)):
        assert (shard.ids(a, b) == ids[a:b]).all()
    assert (shard.names == names).all() and (shard.named == (names % 2 == 0)).all() and (shard.lengths() == lengths).all()


def test_both_sides_of_the_size_checks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(60)], "doc_id long, text string").repartition(7)
    packed, back = sorted(packing.pack(docs, WORD).collect()), sorted(simple8b.read_ids(simple8b.write_ids(docs, BYTE)).collect())
    monkeypatch.setattr(packing, "SMALL_COUNTS", 0)
    monkeypatch.setattr(simple8b, "SMALL_FILES", 0)
    assert sorted(packing.pack(docs, WORD).select("doc_id", "start", "length", "ids").collect()) == [r[:4] for r in packed]
    assert sorted(simple8b.read_ids(simple8b.write_ids(docs, BYTE)).collect()) == back
