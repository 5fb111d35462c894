import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import entries, packing, sstable, token_counts
from riskloom.llm.common import shared_path
from riskloom.llm.tokenizing import word_encoder

WORDS = entries.tokenizer_file("word_bpe_49k.json")
PIECES = entries.tokenizer_file("piece_bpe_32k.model")


def greedy(word, starts, within):
    """Longest match, piece by piece."""
    n, at, pool, first = 0, 0, starts, True
    while first or at < len(word):
        size = next((k for k in range(len(word) - at, -1 if first else 0, -1) if word[at : at + k] in pool), None)
        if size is None:
            return -1
        n, at, pool, first = n + 1, at + size, within, False
    return n


def split_pieces(pieces):
    return {p[1:] for p in pieces if p[0] == "▁" and "▁" not in p[1:]}, {p for p in pieces if "▁" not in p}


def test_automaton_equals_greedy_on_small_vocabularies():
    rng = random.Random(3)
    for _ in range(300):
        pool = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        pieces = [("▁" if rng.random() < 0.5 else "") + p for p in pool] + (["▁"] if rng.random() < 0.5 else [])
        automaton, (starts, within) = token_counts.LongestMatch(pieces), split_pieces(pieces)
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert automaton.count(word.encode()) == greedy(word, starts, within), (pieces, word)


def test_counts_equal_greedy_on_documents(small, awkward, nothing):
    pieces = token_counts.load_pieces(PIECES)
    starts, within = split_pieces(pieces)
    known = functools.cache(lambda word: greedy(word.decode(), starts, within))
    for df in (small.limit(40), awkward):  # awkward holds a text of 40,000 words
        for r, got in zip(df.collect(), token_counts.count_tokens(df, PIECES).collect()):
            each = [known(w) for w in (r.text or "").encode().split()]
            assert (got.n_words, got.n_tokens, got.n_unknown) == (len(each), sum(1 if x < 0 else x for x in each), each.count(-1))
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


def test_clashing_names_stay(small):
    df = small.limit(5).selectExpr("doc_id", "text", "1 as _text", "2 as __text", "3 as n_words")
    out = token_counts.count_tokens(df, PIECES)
    assert out.columns == ["doc_id", "_text", "__text", "n_words", "n_tokens", "n_unknown"] and {tuple(r)[1:3] for r in out.collect()} == {(1, 2)}


@pytest.fixture(scope="module")
def expected(small, awkward):
    tokenizer = word_encoder(WORDS).tokenizer

    def ids(text):
        return tokenizer.encode(text or "", add_special_tokens=False).ids

    return {name: [(r.doc_id, ids(r.text)) for r in df.collect()] for name, df in (("small", small), ("awkward", awkward))}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["small", "awkward"])
def test_shards_equal_the_library(spark, request, expected, name):
    path = shared_path(spark, "test-shards")
    sstable.write_shards(request.getfixturevalue(name), path, WORDS, 2, shards=3, block_bytes=2000)
    rows = sstable.read_shards(spark, path, with_ids=True).orderBy("start").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in rows) == sorted(((d is not None, d or 0), [*x, 2]) for d, x in expected[name])
    at = 0
    for before, r in zip([None, *rows], rows):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        assert before is None or before.doc_id is None or before.doc_id <= r.doc_id
        at += r.n_tokens
    wanted = [r.doc_id for r in rows[::7]] + [-5, 10**9]
    found = sorted(map(tuple, ((r.doc_id is not None, r.doc_id or 0, r.ids) for r in sstable.lookup(spark, path, wanted).collect())))
    assert found == sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows if r.doc_id in wanted)


def test_whole_files_give_the_same(spark, small):
    path = shared_path(spark, "test-shards")
    sstable.write_shards(small, path, WORDS, 2, shards=2)
    assert sorted(sstable.read_shards(spark, path).collect()) == sorted(sstable.read_shards(spark, path, ranges=False).collect())


def test_shards_follow_the_bytes(spark, small):
    texts = sum(len((r.text or "").encode()) for r in small.collect())
    path = shared_path(spark, "test-shards")
    sstable.write_shards(small, path, WORDS, 2, shard_bytes=texts // 9)
    sizes = [r.size for r in sstable._shards(spark, path).collect()]
    assert len(sizes) in (9, 10) and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_lookup_reads_what_it_needs():
    """Footer, filter, index and the blocks of the identifier; the filter alone for identifiers that are not there."""
    writer = sstable.ShardWriter(0, 2, 2000)
    parts = [x for i in range(3000) for x in writer.add(i * 2, np.arange(50) + i)] + list(writer.finish())
    data, taken = b"".join(x + b"\n" for x in parts), []

    def read(at, n):
        taken.append(n)
        return data[at : at + n]

    shard = sstable.Shard(read, len(data))
    assert [x.tolist() for x in shard.find(2000)] == [(np.arange(50) + 1000).tolist()]
    index, bloom = shard.filter_at - shard.index_at, len(data) - shard.filter_at
    assert sum(taken) < index + bloom + 2 * 2200 < len(data) / 20
    taken.clear()
    absent = [i for i in range(1, 6000, 2) if not shard.may_hold(i)]
    assert len(absent) > 2900 and not any(shard.find(i) for i in absent) and not taken
    assert [d for d, _ in shard.records(stretch=5000)] == list(range(0, 6000, 2)) and max(taken) <= 5000


def test_no_shards_of_nothing(spark, nothing):
    path = shared_path(spark, "test-shards")
    sstable.write_shards(nothing, path, WORDS, 2)
    assert sstable.read_shards(spark, path).count() == 0


def test_damaged_shard():
    writer = sstable.ShardWriter(0, 2, 100)
    data = b"".join(x + b"\n" for x in [*writer.add(1, np.arange(9)), *writer.finish()])
    assert [ids.tolist() for _, ids in sstable.Shard.of_bytes(data).records()] == [list(range(9))]
    with pytest.raises(sstable.BadShard):
        sstable.Shard.of_bytes(data[:-2])


@pytest.mark.parametrize("name", ["small", "awkward"])
def test_packing_keeps_every_id(request, expected, name):
    rows = packing.pack(request.getfixturevalue(name), WORDS, 1, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == crc(r.ids)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    wanted = defaultdict(list)
    for doc_id, ids in expected[name]:
        wanted[doc_id].append([*ids, 1])
    for doc_id, texts in wanted.items():
        got = sorted((r.start, r.ids) for r in pieces[doc_id])
        assert sorted(x for _, ids in got for x in ids) == sorted(x for ids in texts for x in ids)
        if len(texts) == 1:
            assert [x for _, ids in got for x in ids] == texts[0]
            assert {r.doc_tokens for r in pieces[doc_id]} == {len(texts[0])}
    total = sum(r.length for r in rows)
    partitions = len({k >> 40 for k in sequences})
    assert 2048 * len(sequences) <= total * 1.01 + 2048 * (partitions + 1)


def test_packing_nothing(nothing):
    assert packing.pack(nothing, WORDS, 1).count() == 0


def test_differencing_is_near_equal_and_count_rises():
    rng = random.Random(5)
    sizes = [rng.randint(1, 384) for _ in range(500)]
    dealt = packing.difference(sizes, 40)
    assert sorted(i for w in dealt for i in w) == list(range(500))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) - min(sums) <= 8
    assert len(packing.deal([6, 6, 6], 10)) == 3 and [sorted(w) for w in packing.deal([5, 5], 10)] == [[0, 1]]


def test_ids_that_do_not_fit_are_refused():
    writer = sstable.ShardWriter(0, 2, 1000)
    list(writer.add(1, np.array([65_535], np.uint32)))
    with pytest.raises(ValueError):
        list(writer.add(2, np.array([65_536], np.uint32)))
