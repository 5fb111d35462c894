import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from riskloom.llm import entries, resampling
from tests.compare import rows_of, run_sql


def brute(docs, target, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        runs = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(x.encode()) % buckets for x in runs]

    found = [(i, features(x)) for i, x in docs]
    s, t = collections.Counter(b for _, x in found for b in x), collections.Counter(b for x in target for b in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for i, x in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x)) // len(x) if x else 0
        rows.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = enough[: len(enough) * percent // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in enough[len(drawn) :] + [r for r in rows if r[1] < least]], key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"order": 2, "buckets": 50, "percent": 50, "min_words": 3}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_awkward_rows(spark, awkward, how):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    target = ["one two THREE four", None, "", "deich boxkämpfer 日本語"]
    aims = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in enumerate(target)], "item_id long, text string, score int, _none int, _text int")
    kept = {"least" if k == "min_words" else k: v for k, v in how.items()}
    assert got(resampling.resample(awkward, aims, **how)) == brute(docs, target, **kept)


def test_hot_row(spark, awkward):
    """A third of all rows are one row: all tie, each is drawn for itself."""
    docs = [(i, f"word{i % 7} " * 30) for i in range(100)] + [(5, "word0 " * 30)] * 50
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    aims = spark.createDataFrame([("word0 word1",)], "text string")
    assert got(resampling.resample(rows, aims, percent=60)) == brute(docs, ["word0 word1"], percent=60)


def test_nothing(spark, nothing, awkward):
    assert resampling.resample(nothing, awkward).count() == 0
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(resampling.resample(awkward, nothing.select("text"), percent=50, min_words=1)) == brute(docs, [], percent=50, least=1)


def test_run_lengths():
    values = np.random.default_rng(0).integers(0, 300, 5000).astype("<u2")
    found, counts = resampling.run_lengths(values)
    assert dict(zip(found.tolist(), counts.tolist())) == collections.Counter(values.tolist())


def test_against_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        found = entries.op12_sort_count_resampling(spark, sf_dir).toPandas()
        assert rows_of(found) == rows_of(run_sql(sf_dir, entries.oracle_sql()["op12_sort_count_resampling"]))
        assert found["rank"].notna().sum() > 10
