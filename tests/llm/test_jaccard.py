import hashlib
import random

import numpy as np
import pytest

from riskloom.llm import graph, jaccard


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted(((doc_id is not None, doc_id or 0), len(sets[i]), smallest.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def found(df, *how, **more):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, *how, **more).collect())


@pytest.fixture(scope="module")
def copies():
    """Chains of near copies of texts of many sizes, around the threshold, and a family of many."""
    rng, rows = random.Random(7), []
    for size in [4, 9, 10, 11, 12, 15, 20, 30, 60, 120, 400, 1500]:
        for _ in range(3):
            words = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
            for _ in range(5):
                rows.append((len(rows), " ".join(words)))
                for _ in range(rng.choice([1, 1, 2, max(1, size // 60), max(1, size // 40)])):
                    words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"y{rng.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 8, 10), (1, 7, 10)])
def test_equals_brute_force(spark, copies, width, num, den):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    assert found(df, width, num, den) == brute(copies, width, num, den)


def test_one_key_in_a_third_of_all_sets(spark, copies):
    """Near copies of one text, each of its own words besides, over many tasks and tiny parts: hot keys and a large star."""
    base = " ".join(f"h{i}" for i in range(200))
    rows = copies + [(20_000 + i, f"{base} z{i}") for i in range(len(copies) // 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(df, 3, 90, 100, sets_at_once=40) == brute(rows, 3, 90, 100)


def test_words_of_many_texts_are_hashed_together(copies, monkeypatch):
    """In a few array operations, whatever the number of words; as each text alone, and however texts are cut."""
    texts = [t.encode() for _, t in copies] + [None, b"", b" \t\n\x0b\x0c\r", b"a", b"A", b"a b c d", b"a b  c\td", b"b a c d", b"x" * 9000 + b" y", "\u00a0é\x1c 日本".encode()]
    passes, plain = [], jaccard.word_hashes
    monkeypatch.setattr(jaccard, "word_hashes", lambda data: passes.append(data) or plain(data))
    whole = jaccard.Shingler(5).all_hashes(texts)
    assert len(passes) <= 1 + sum(len(t or b"") + 1 for t in texts) // 100_000
    assert [len(x) for x in whole] == [len({*shingles((t or b"").decode(), 5)}) for t in texts]
    monkeypatch.setattr(jaccard, "TOGETHER", 300)
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(whole, jaccard.Shingler(5).all_hashes(texts), map(jaccard.Shingler(5).hashes, texts)))
    sets = {x.tobytes() for x in whole[-10:]}
    assert len(sets) == 6 and whole[-7] == whole[-6] and whole[-5] == whole[-4] != whole[-3]
    words = sorted({w for t in texts for w in (t or b"").split()})
    assert len(np.unique(plain(b" ".join(words))[1])) == len(words)


def test_stars_lose_no_key():
    rng = np.random.default_rng(4)
    keys, nodes = rng.integers(0, 40, 500), rng.integers(0, 60, 500)
    k, n, u, v = jaccard._stars(keys, nodes)
    assert sorted(k) == sorted(set(keys)) and len(set(zip(u, v))) == len(u)
    center = dict(zip(k, n))
    assert {(b, center[a]) for a, b in zip(keys, nodes) if b != center[a]} == set(zip(u, v))
    assert all(len(x) == 0 for x in jaccard._stars(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def one_each(rows, width, num, den):
    """By brute force: rows (doc_id, text, extra); the first of each component by doc_id, null last, then by md5 of the text."""
    numbered = [(i, r[1]) for i, r in enumerate(rows)]
    groups, kept = {}, []
    for (_, i), n, component in brute(numbered, width, num, den):
        if n:
            groups.setdefault(component, []).append(rows[i])
        else:
            kept.append(rows[i])
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    return kept, {min(map(order, g)) for g in groups.values()}, order


def test_keep_one_each_whatever_the_order(spark, copies):
    base = "a b c d e f g h i j k l"
    rows = [(3, base, "x"), (5, base, "x"), (5, "quite another text of seven words here", "x"), (None, base, "y"), (None, base, "y"), (None, "nobody else says this sentence of mine", "z")]
    rows += [(None, "nobody else says this sentence of mine", "z")] * 40 + [(7, "many equal rows of one identifier and text", "q")] * 50 + [(8, "", None), (8, "", None), (9, None, None), (None, None, None)]
    rows += [(i, t, "c") for i, t in copies[:60]]
    expected = one_each(rows, 5, 80, 100)
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, _mark string").repartition(2 + seed)
        out = jaccard.keep_one_each(df, 5, 80, 100)
        assert out.columns == df.columns
        results.append(sorted(map(tuple, out.collect()), key=repr))
    wordless, firsts, order = expected
    assert results[0] == results[1] == results[2]
    assert sorted((r for r in results[0] if not (r[1] or "").split()), key=repr) == sorted(wordless, key=repr)
    assert sorted(order(r) for r in results[0] if (r[1] or "").split()) == sorted(firsts)


def test_keep_one_each_awkward(awkward, nothing):
    assert sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one_each(awkward).collect() if (r.text or "").split()) == sorted({(r.doc_id or 0, r.text) for r in awkward.collect() if (r.text or "").split() and r.doc_id != 8})
    assert jaccard.keep_one_each(nothing).count() == 0 and jaccard.keep_one_each(nothing).columns == nothing.columns


def test_small_blocks_lose_nothing(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    assert found(df, 3, 90, 100, sets_at_once=15) == brute(copies, 3, 90, 100)


def test_awkward_rows(awkward, nothing, small):
    for df, width in ((awkward, 3), (small, 5)):
        assert found(df, width, 8, 10) == brute([(r.doc_id, r.text) for r in df.collect()], width, 8, 10)
    assert jaccard.jaccard_components(nothing).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    times = rng.integers(8, 40, 5000)
    for num, den in ((9, 10), (8, 10), (5, 10)):
        similarity = jaccard.Similarity(num, den)
        signatures = jaccard.Signatures(similarity)
        for n in [9, 10, 11, 13, 17, 25, 40, 77, 150, 600, 3000]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                cut = rng.integers(0, n * (den - num) // den + 1)
                b = np.unique(np.r_[a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, rng.integers(0, 2 + n // 20)).astype(np.uint64) * np.uint64(2)])
                overlap = len(np.intersect1d(a, b))
                if similarity.similar(overlap, len(a), len(b)) and overlap < max(len(a), len(b)):
                    for share in (0, 0.1, 0.5, 0.95, 1):
                        common = np.sort(rng.permutation(a)[: int(share * len(a))])
                        keys = [signatures.keys(x, jaccard.times_of(x, (common, times[: len(common)]))) for x in (a, b)]
                        assert np.intersect1d(*keys).size, (num, n, share)


def test_frequent_shingles_change_no_result(spark, copies):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = copies + [(10_000 + i, f"{text} {passage}") for i, text in copies[::3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows, 3, 80, 100)
    for least, kept in ((2, 10**6), (3, 50), (10**9, 1)):
        assert found(df, 3, 80, 100, common_least=least, common_kept=kept) == expected


def test_tree_keeps_every_similar_set():
    rng = np.random.default_rng(6)
    similarity = jaccard.Similarity(8, 10)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(200, 300)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(400)]
    counts = np.stack([np.bincount((x >> np.uint64(7)).astype(np.int64) & 63, minlength=64) for x in sets])
    tree = jaccard.RTree(np.array([len(x) for x in sets]), counts)
    for x, c in zip(sets[::9], counts[::9]):
        near = set(tree.candidates(similarity, len(x), c).tolist())
        exact = {j for j, y in enumerate(sets) if similarity.similar(len(np.intersect1d(x, y)), len(x), len(y))}
        assert exact <= near


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(500, 500), (700, 600), (700, 650)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
