import hashlib

import numpy as np
import pytest

from riskloom.llm import repeats
from riskloom.llm.run_index import RunIndex

SPAN = repeats.SPAN


def brute(docs):
    """docs: (doc_id, text). Every string of SPAN bytes in a dictionary with its least doc_id."""
    data = [(float("inf") if i is None else i, (x or "").encode()) for i, x in docs]
    least = {}
    for i, x in data:
        for a in range(len(x) - SPAN + 1):
            s = x[a : a + SPAN]
            least[s] = min(i, least.get(s, i))
    rows = []
    for (doc_id, _), (i, x) in zip(docs, data):
        gone = np.zeros(len(x) + 1, bool)
        for a in range(len(x) - SPAN + 1):
            if least[x[a : a + SPAN]] < i:
                gone[a : a + SPAN] = True
        gone = gone[: len(x)]
        kept = bytes(b for b, g in zip(x, gone) if not g)
        rows.append((doc_id, len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed=0, n=120):
    """Random words with passages, lines and whole texts in common, periodic text, many documents around one short line."""
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(300)] + ["é", "日本", "🙂"]
    text = lambda k: " ".join(words[i] for i in rng.integers(0, len(words), k))
    passages, line, docs = [text(60) for _ in range(4)], "x" + text(12)[:51], []
    for i in range(n):
        body = text(int(rng.integers(0, 80)))
        kind = i % 8
        if kind == 1:
            body += passages[int(rng.integers(4))] + text(10)
        elif kind == 2:
            p = passages[int(rng.integers(4))]
            a = int(rng.integers(0, 100))
            body = body + p[a : a + int(rng.integers(45, 60))] + text(3)
        elif kind == 3 and docs:
            body = docs[int(rng.integers(len(docs)))][1] or ""
        elif kind == 4:
            body = "ab" * int(rng.integers(0, 200)) + body
        elif kind == 5:
            body += "\n" + line + "\n" + text(20)
        elif kind == 6:
            body = "=" * int(rng.integers(40, 200))
        docs.append((int(rng.integers(0, 60)), body))
    return docs


@pytest.mark.parametrize("how", [{}, {"hot": 2, "bundle_bytes": 500, "part_bytes": 2000, "index_bytes": 1000}, {"hot": 10, "bucket_bytes": 1000, "block_bytes": 1000}])
def test_equals_brute_force(spark, how):
    docs = corpus()
    df = spark.createDataFrame([(i, x, 1, b"d") for i, x in docs], "doc_id long, text string, part int, data binary").repartition(3)
    assert got(repeats.remove_repeats(df, **how)) == brute(docs)


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    long_text = docs[0][1] if docs[0][1] and len(docs[0][1]) > 1000 else max((x or "" for _, x in docs), key=len)
    more = docs + [(9, long_text[1000:3000]), (4, long_text[:49]), (3, "y" * 50), (9, "y" * 50), (None, "y" * 51)]
    df = spark.createDataFrame([(i, x, 1) for i, x in more], "doc_id long, text string, size int")
    assert got(repeats.remove_repeats(df)) == brute(more)
    assert repeats.remove_repeats(nothing).count() == 0


def test_kept_text_and_folders(spark):
    docs = corpus(1, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = repeats.remove_repeats(df, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("riskloom_bundles")]


def test_test_table(spark):
    from riskloom.llm import entries

    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(entries.op13_run_index_repeats(spark, sf_dir))
    assert found == brute(docs) and sum(r[2] for r in found) > 1000


def test_segments_cover_each_window_once_and_equal_windows_share_keys():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 97 + k, n).tolist()) for k, n in ((2, 300), (1, 200), (26, 49), (26, 50), (26, 0), (3, 1000))]
    texts.append(texts[0][20:200])
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts])
    expected = {int(e - n + a) for e, n in zip(np.cumsum(lengths), lengths) for a in range(n - SPAN + 1)}
    for block in (1 << 19, 64, 101):
        start, size, key = repeats.segments(data, lengths, block)
        covered = [s + i for s, n in zip(start.tolist(), size.tolist()) for i in range(n)]
        assert sorted(covered) == sorted(expected) and size.max() <= repeats.WINDOWS
        keys = {}
        for s, n, k in zip(start.tolist(), size.tolist(), key.tolist()):
            for i in range(n):
                assert keys.setdefault(bytes(data[s + i : s + i + SPAN]), k) == k


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(15):
        base = bytes(rng.integers(97, 97 + rng.integers(2, 5), 60).tolist())
        strings = []
        for _ in range(rng.integers(1, 15)):
            a = int(rng.integers(0, 40))
            x = bytearray(base[a : a + rng.integers(1, 80)])
            if rng.random() < 0.5:
                x[rng.integers(0, len(x))] = rng.choice([0, 255, 97])
            strings.append(bytes(x))
        index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]))
        patterns = [*strings[:2], bytes(rng.integers(95, 101, 30).tolist()), base[3:50] + b"zz" + base[:9]]
        length, row = index.match(np.frombuffer(b"".join(patterns), np.uint8), np.array([len(x) for x in patterns]))
        at = 0
        for p in patterns:
            for i in range(len(p)):
                best = max((k for k in range(len(p) - i, 0, -1) if any(p[i : i + k] in s for s in strings)), default=0)
                assert length[at] == best
                place = index.rows[row[at]]
                string = strings[index.string[place]]
                off = len(string) - (index.end[place] - place)
                assert string[off : off + best] == p[i : i + best]
                at += 1
    assert index.runs < index.n
