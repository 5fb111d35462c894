"""Repeated passages: removes bytes covered by a string of `span` bytes that also starts in a document with a smaller doc_id.

The index is a run-compressed Burrows-Wheeler transform with sampled run ends (`run_index.py`). One index of all texts would not
fit a machine and one index a block would meet every text, so texts are cut where their content says so, and equal strings meet
in one block:

1. bundles   documents are packed into rows of some megabytes, bucketed by `part` (one part: a task's texts up to `part_bytes`),
             so that later steps meet a part's texts without shuffling them.
2. keys      a window of `span` bytes is named by the least hash of its 20-byte grams, which equal windows share. Windows in a row
             with one key are a segment (at most 31 windows). Each part sends its segments' keys, 5 bytes each, to buckets by hash;
             a bucket tells which keys occur once only (no string there can repeat), more often, or very often.
3. blocks    segments of repeated keys, one of each content a part with its least and largest doc_id, meet by key. A key of more
             than `hot` segments (a line in every third document, say) is split: its windows go by their own content, which no
             document-specific neighbour can make different. A block of segments builds its index; matching statistics of its
             segments stream through it; rows whose suffixes share `span` bytes form a family, and a family's least doc_id
             is what its windows learn. Blocks are cut to `index_bytes`, so memory is bounded.
4. marks     each part learns the least doc_id of its segments' windows, marks those below a document's own and removes them.

Only keys (5 of each 16 bytes) and repeated segments are shuffled, each content once a part. All tables are written to the shared
folder, bundles as a table of the catalog that is dropped at the end. Results are exact: hashes only decide where segments meet.

Cases: a null text is empty. Texts below `span` bytes keep everything. Very long texts are a bundle of their own and are cut into
segments like others. Rows of one doc_id do not remove one another's strings, repeated rows get equal results; a null doc_id is
larger than all others. Only doc_id and text are read, so extra columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import named, removed, shared_path, slices, written
from riskloom.llm.run_index import RunIndex

SPAN, GRAM = 50, 20
WINDOWS = SPAN - GRAM + 1  # grams in a window, and the most windows of a segment
LONGEST = SPAN + WINDOWS - 1
LAST = 2**63 - 1
LONE, REPEATED, HOT = 0, 1, 2
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on: polynomials of 1, 2, 4, ... bytes, joined and mixed."""
    n, cur, width, power = len(data) - GRAM + 1, (data.astype(np.uint64) + np.uint64(1)), 1, int(_MUL)
    found, at, left = None, 0, GRAM
    while left:
        if left & 1:
            piece = cur[at : at + n]
            found = piece if found is None else found * np.uint64(power) + piece
            at += width
        left >>= 1
        if left:
            cur = cur[:-width] * np.uint64(power) + cur[width:]
            width, power = 2 * width, power * power % 2**64
    return _mixed(found)


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    n, cur, have = len(h) - width + 1, h, 1
    while 2 * have <= width:
        cur, have = np.minimum(cur[:-have], cur[have:]), 2 * have
    return np.minimum(cur[:n], cur[width - have : width - have + n])


def segments(data: np.ndarray, lengths: np.ndarray, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and key of each segment of the texts that `data` holds in a row."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    found = []
    for a in range(0, len(data) - SPAN + 1, block):
        part = data[a : a + block + SPAN - 1]
        least = _least_of(gram_hashes(part), WINDOWS)
        n = len(least)
        # windows that cross the end of a text are none
        crossing = np.zeros(n + 1, np.int64)
        low, high = np.maximum(starts, ends - SPAN + 1) - a, ends - a
        near = (high > 0) & (low < n)
        np.add.at(crossing, np.clip(low[near], 0, n), 1)
        np.add.at(crossing, np.clip(high[near], 0, n), -1)
        whole = np.cumsum(crossing[:n]) == 0
        first = np.zeros(n, bool)
        first[0] = True
        first[1:] = (least[1:] != least[:-1]) | (whole[1:] & ~whole[:-1])
        inner = starts[(starts > a) & (starts < a + n)] - a
        first[inner] = True
        first &= whole
        at = np.flatnonzero(first)
        if not len(at):
            continue
        # a segment ends where the next begins, or where windows stop
        stop = np.flatnonzero(np.r_[whole[:-1] & ~whole[1:], whole[-1]]) + 1
        size = np.minimum(np.r_[at[1:], n], stop[np.searchsorted(stop, at, "right")]) - at
        pieces = -(-size // WINDOWS)
        which = np.repeat(np.arange(len(at)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = at[which] + nth * WINDOWS
        found.append((begin + a, np.minimum(WINDOWS, size[which] - nth * WINDOWS), least[begin]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


class Part:
    """The bundles of a part, in order, with their segments."""

    def __init__(self, rows: pa.Table):
        pa.default_memory_pool().release_unused()
        rows = rows.sort_by("bundle")
        self.ids = [x for ids in rows.column("ids").to_pylist() for x in ids]
        self.lengths = np.array([n for row in rows.column("lengths").to_pylist() for n in row], np.int64)
        self.data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8)
        self.start, self.size, self.key = segments(self.data, self.lengths)
        self.order = np.array([LAST if x is None else x for x in self.ids], np.int64)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments ordered by their bucket, the buckets met, and where each begins."""
        bucket = (self.key >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        met, begins = np.unique(bucket[order], return_index=True)
        return order, met.astype(np.int64), begins

    def flags(self, notes: dict[int, bytes], buckets: int) -> np.ndarray:
        order, met, begins = self.by_bucket(buckets)
        flags = np.zeros(len(order), np.uint8)
        for b, at in zip(met.tolist(), begins.tolist()):
            said = np.frombuffer(notes[b], np.uint8)
            flags[order[at : at + len(said)]] = said
        return flags

    def contents(self, flags: np.ndarray):
        """Segments of repeated keys, hot ones as single windows: start, number of windows, key and number of content of each, and one place of each content."""
        plain, hot = np.flatnonzero(flags == REPEATED), np.flatnonzero(flags == HOT)
        windows = np.repeat(self.start[hot], self.size[hot])
        windows += np.arange(len(windows)) - np.repeat(np.cumsum(self.size[hot]) - self.size[hot], self.size[hot])
        start, size = np.concatenate([self.start[plain], windows]), np.concatenate([self.size[plain], np.ones(len(windows), np.int64)])
        first, number, key = _distinct(self.data, start, size + SPAN - 1)
        key[: len(plain)] = self.key[plain]
        return start, size, key, number, first


def _distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings in `data`: the first of each content, each one's number of content, and a hash of each, which equal contents share. Exact: contents of one hash are compared."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = -(-LONGEST // 8)
    held = np.zeros((n, words), np.uint64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    for w in range(words):
        rest = np.clip(length - 8 * w, 0, 8)
        some = rest > 0
        held[some, w] = view[start[some] + 8 * w].copy().view("<u8").ravel() & masks[rest[some]]
    key = _mixed(length.astype(np.uint64))
    for w in range(words):
        key = _mixed(key * _MUL + held[:, w])
    order = np.argsort(key, kind="stable")
    differ = lambda: (held[order][1:] != held[order][:-1]).any(axis=1) | (length[order][1:] != length[order][:-1])
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    if (differ() & ~new[1:]).any():  # two contents of one hash: order by content as well
        order = np.lexsort((*held.T, length, key))
        new = np.r_[True, differ()]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, key


def _by(number: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each number."""
    low, high = np.full(n, LAST), np.full(n, -LAST - 1)
    np.minimum.at(low, number, values)
    np.maximum.at(high, number, values)
    return low, high


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return data[at]


def _bundles(documents: DataFrame, text: str, bundle_bytes: int, part_bytes: int) -> DataFrame:
    def work(batches):
        task, part, bundle, held = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in slices(batches, rows=20_000, size=bundle_bytes):
            texts = [x or b"" for x in batch.column("_text").to_pylist()]
            size = sum(map(len, texts))
            if held and held + size > part_bytes:
                part, held = part + 1, 0
            held, bundle = held + size, bundle + 1
            arrays = [[task + part], [bundle], [size], [batch.column("doc_id").to_pylist()], [[len(x) for x in texts]], [b"".join(texts)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, kinds)], names=["part", "bundle", "size", "ids", "lengths", "data"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), named(text).cast("binary").alias("_text"))
    return rows.mapInArrow(work, "part long, bundle long, size long, ids array<long>, lengths array<long>, data binary")


def _key_rows(part: pa.Table, buckets: int) -> pa.Table:
    name, own = part.column("part")[0].as_py(), Part(part)
    order, met, begins = own.by_bucket(buckets)
    # the low 40 bits; a bucket's own bits are above
    low = own.key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    data = [low[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(order)])]
    return pa.table({"bucket": pa.array(met), "part": pa.array([name] * len(met), pa.int64()), "keys": pa.array(data, pa.binary())})


def _flag_rows(rows: pa.Table, hot: int) -> pa.Table:
    """One bucket's keys; per part, what each of its segments is told."""
    blobs = rows.column("keys").to_pylist()
    wide = np.zeros((sum(map(len, blobs)) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    keys = wide.view("<u8").ravel()
    order = np.argsort(keys)
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    flags = np.empty(len(keys), np.uint8)
    flags[order] = np.repeat(np.where(counts > hot, HOT, np.where(counts > 1, REPEATED, LONE)).astype(np.uint8), counts)
    ends = np.cumsum([len(x) // 5 for x in blobs])
    return pa.table({"bucket": rows.column("bucket"), "part": rows.column("part"), "flags": pa.array([flags[b - len(x) // 5 : b].tobytes() for b, x in zip(ends, blobs)], pa.binary())})


SEGMENT_TYPES = {"numbers": "<u4", "subs": "<u4", "lengths": "u1", "low": "<i8", "high": "<i8"}


def _segment_rows(bundles: pa.Table, notes: pa.Table, buckets: int, blocks: int) -> pa.Table:
    """A part's repeated contents, by the block where they meet."""
    part = Part(bundles)
    flags = part.flags(dict(zip(notes.column("bucket").to_pylist(), notes.column("flags").to_pylist())), buckets)
    start, size, key, number, first = part.contents(flags)
    low, high = _by(number, part.order[np.searchsorted(np.cumsum(part.lengths), start, "right")], len(first))
    length = size[first] + SPAN - 1
    block = (key[first] >> np.uint64(8)) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    met, begins = np.unique(block[order], return_index=True)
    columns = {"numbers": order, "subs": key[first][order] & np.uint64(0xFFFFFFFF), "lengths": length[order], "low": low[order], "high": high[order]}
    cuts = list(zip(begins, [*begins[1:], len(order)]))
    out = {"block": pa.array(met.astype(np.int64)), "part": pa.array([bundles.column("part")[0].as_py()] * len(met), pa.int64())}
    out |= {c: pa.array([columns[c][a:b].astype(t).tobytes() for a, b in cuts], pa.binary()) for c, t in SEGMENT_TYPES.items()}
    out["data"] = pa.array([_gathered(part.data, start[first][order[a:b]], length[order[a:b]]).tobytes() for a, b in cuts], pa.binary())
    return pa.table(out)


def least_of_windows(data: np.ndarray, start: np.ndarray, length: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The least `low` of all strings that hold each window of these strings (distinct ones), by matching statistics over their index."""
    own = _gathered(data, start, length)
    index = RunIndex(own, length)
    matched, row = index.match(own, length)
    family, whole = index.families(SPAN)
    least = np.full(int(family[-1]) + 1, LAST)
    np.minimum.at(least, family[whole], low[index.string[index.rows[whole]]])
    windows = _gathered(np.arange(len(own)), np.cumsum(length) - length, length - SPAN + 1)
    assert (matched[windows] >= SPAN).all()
    return least[family[row[windows]]]


def _window_rows(rows: pa.Table, index_bytes: int) -> pa.Table:
    """One block's segments; per part, runs of windows that occur below the largest doc_id it asked for."""
    columns = {c: np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in SEGMENT_TYPES.items()}
    sizes = [len(x) for x in rows.column("lengths").to_pylist()]
    asked = np.repeat(np.arange(len(sizes)), sizes)
    data, length = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8), columns["lengths"].astype(np.int64)
    start = np.cumsum(length) - length
    first, number, _ = _distinct(data, start, length)
    low, _ = _by(number, columns["low"], len(first))
    # equal windows have equal keys, so a block can be cut by keys
    sub = columns["subs"][first]
    windows = length[first] - SPAN + 1
    offset = np.cumsum(windows) - windows
    least = np.repeat(low, windows)
    # a content that stands alone under its key has nothing to meet: its windows are in no other
    _, key, holds = np.unique(sub, return_inverse=True, return_counts=True)
    met = holds[key] > 1
    pieces = max(1, -(-int(length[first[met]].sum()) // index_bytes))
    piece = np.where(met, sub % pieces, pieces)
    for i in range(pieces):
        own = np.flatnonzero(piece == i)
        if len(own):
            least[_gathered(np.arange(len(least)), offset[own], windows[own])] = least_of_windows(data, start[first[own]], length[first[own]], low[own])
    # runs of windows with one least doc_id, of each content
    new = np.zeros(len(least), bool)
    new[offset] = True
    new[1:] |= least[1:] != least[:-1]
    run = np.flatnonzero(new)
    content = np.searchsorted(offset, run, "right") - 1
    run_size = np.diff(np.r_[run, len(least)])
    counts = np.bincount(content, minlength=len(first))
    begin = np.cumsum(counts) - counts
    # runs of the content of each segment that was asked for
    n = counts[number]
    which = np.repeat(np.arange(len(number)), n)
    at = np.repeat(begin[number], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    keep = least[run[at]] < columns["high"][which]
    which, at = which[keep], at[keep]
    out = {"numbers": columns["numbers"][which], "offsets": (run[at] - offset[content[at]]).astype("u1"), "sizes": run_size[at].astype("u1"), "low": least[run[at]]}
    cuts = np.searchsorted(asked[which], np.arange(len(sizes) + 1))
    pairs = [(p, a, b) for p, a, b in zip(rows.column("part").to_pylist(), cuts[:-1], cuts[1:]) if b > a]
    table = {"part": pa.array([p for p, _, _ in pairs], pa.int64())}
    table |= {c: pa.array([out[c][a:b].tobytes() for _, a, b in pairs], pa.binary()) for c in out}
    return pa.table(table)


def _kept_rows(bundles: pa.Table, notes: pa.Table, buckets: int, keep_text: bool) -> pa.Table:
    """A part's documents without what they repeat."""
    part = Part(bundles)
    said = list(zip(*(notes.column(c).to_pylist() for c in ("bucket", "flags", "numbers", "offsets", "sizes", "low"))))
    flags = part.flags({b: f for b, f, *_ in said if f is not None}, buckets)
    start, size, _, number, first = part.contents(flags)
    runs = [x[2:] for x in said if x[1] is None]
    kinds = ("<u4", "u1", "u1", "<i8")
    of, offset, windows, low = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x[i], t) for x in runs)]).astype(np.int64) for i, t in enumerate(kinds))
    order = np.argsort(of, kind="stable")
    of, offset, windows, low = of[order], offset[order], windows[order], low[order]
    begin, stop = np.searchsorted(of, np.arange(len(first))), np.searchsorted(of, np.arange(len(first)), "right")
    n = (stop - begin)[number]
    which = np.repeat(np.arange(len(number)), n)
    at = np.repeat(begin[number], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    ends = np.cumsum(part.lengths)
    below = low[at] < part.order[np.searchsorted(ends, start[which], "right")]
    which, at = which[below], at[below]
    covered = start[which] + offset[at]
    order = np.argsort(covered)
    covered, upto = covered[order], covered[order] + windows[at][order] - 1 + SPAN
    rows: list[tuple] = []
    for doc_id, end, n_bytes in zip(part.ids, ends.tolist(), part.lengths.tolist()):
        low_at, high_at = np.searchsorted(covered, (end - n_bytes, end))
        text, spans, removed_bytes = part.data[end - n_bytes : end], 0, 0
        if high_at > low_at:
            # runs of bytes: those that begin beyond all before them
            from_, to = covered[low_at:high_at] - (end - n_bytes), np.maximum.accumulate(upto[low_at:high_at]) - (end - n_bytes)
            new = np.r_[True, from_[1:] > to[:-1]]
            from_, to = from_[new], to[np.r_[new[1:], True]]
            spans, removed_bytes = len(from_), int((to - from_).sum())
            kept = b"".join(text[x:y].tobytes() for x, y in zip([0, *to.tolist()], [*from_.tolist(), n_bytes]))
        else:
            kept = text.tobytes()
        rows.append((doc_id, n_bytes, removed_bytes, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return pa.table({name: pa.array(x, kind) for name, x, kind in zip(names, zip(*rows), kinds) if keep_text or name != "kept"})


def remove_repeats(
    documents: DataFrame,
    text: str = "text",
    keep_text: bool = False,
    hot: int = 50_000,
    bundle_bytes: int = 1 << 21,
    part_bytes: int = 1 << 24,
    bucket_bytes: int = 1 << 28,
    block_bytes: int = 1 << 26,
    index_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; keep_text adds `kept binary`, the bytes that stay."""
    spark = documents.sparkSession
    name, paths = f"riskloom_bundles_{uuid.uuid4().hex}", [shared_path(spark, x) for x in ("bundles", "flags", "windows", "kept")]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # with fewer buckets, Spark would deal out the bundles again
    packed = _bundles(documents, text, bundle_bytes, part_bytes).write.option("path", paths[0]).option("compression", "zstd")
    packed.bucketBy(least, "part").saveAsTable(name)
    try:
        bundles = spark.table(name)
        total = bundles.agg(F.sum("size")).first()[0] or 0
        buckets, blocks = max(least, -(-total // bucket_bytes)), max(least, -(-total // block_bytes))
        columns = bundles.select("part", "bundle", "ids", "lengths", "data")
        keys = columns.groupBy("part").applyInArrow(lambda t: _key_rows(t, buckets), "bucket long, part long, keys binary")
        flags = written(keys.groupBy("bucket").applyInArrow(lambda t: _flag_rows(t, hot), "bucket long, part long, flags binary"), paths[1])
        blobs = ", ".join(f"{c} binary" for c in SEGMENT_TYPES)
        met = columns.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(lambda a, b: _segment_rows(a, b, buckets, blocks), f"block long, part long, {blobs}, data binary")
        windows = written(met.groupBy("block").applyInArrow(lambda t: _window_rows(t, index_bytes), "part long, numbers binary, offsets binary, sizes binary, low binary"), paths[2])
        notes = flags.unionByName(windows, allowMissingColumns=True)
        out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
        kept = columns.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(lambda a, b: _kept_rows(a, b, buckets, keep_text), out)
        return written(kept, paths[3])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in paths[:3]:
            removed(spark, path)
