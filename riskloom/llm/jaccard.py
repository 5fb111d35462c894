"""N-gram Jaccard join: tokens hashed to groups, group counts as points of an R-tree, summed coordinate minima as bound.

A text's set holds its shingles of `width` words. Sets that are equal are one set from the start.

1. Blocking, without loss. A set of n shingles is hashed to groups. If two sets reach the similarity num/den, at most
   (den-num)/num of the smaller set's size differ; each difference touches one group; so of sufficiently many groups one
   is left untouched, equal in both. Each set emits the contents' hash of just so many groups, per size class; sets that
   share one form a family. The most frequent shingles (at most `common_kept`, counted over all texts) are left out of the
   groups of every set, which adds no difference, so that a common passage makes no family. Empty groups say nothing and
   are not emitted; `spare` more groups make up for them. If that can fail for two similar sets, both have more empty
   groups than that; such a set also emits its prefix: its first shingles in a fixed order, rarest first, as many as two
   similar sets need to share one. What is counted as frequent changes the work, never the result.
2. In a family (a connected component over shared groups), sets fall into blocks of bounded size by size band and hash;
   each pair of blocks of equal or adjacent bands is one task, so a family with a third of all sets is spread.
3. In a task, the sets' group counts are points in an R-tree. Summed minima of a set's counts and a node's upper corner,
   then a point's, bound the overlap. Only sets that keep a partner go on, with their hashes, to a second task for the pair
   of blocks, where what survives is verified on the whole sets. Pairs that are linked through others already are not
   verified again, and only links that connect are given: no link between components is lost, and a group of copies never
   expands into all pairs.
4. Links connect sets to components; every document gets the smallest doc_id of its component.

Hot keys: a task gives a key once for each million keys, and what else has it as an edge, so a group content that a third of
all sets share is never gathered; a family's blocks are of bounded size; large stars and components are split by Spark.

Cases: words are lower-cased in A-Z only and parted by ASCII blanks; with fewer words than `width` the whole sequence is
the one shingle; null, empty and blank texts have an empty set, and are linked with nothing (their component is their own
doc_id). Texts are read whole, however long. Repeated rows get equal results, as do rows of one doc_id with different texts,
each by its own text. A null doc_id takes part, but names a component only if no other does. Extra columns are ignored,
whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Remembered, named, settled, slices, unused
from riskloom.llm.graph import components

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _N
    return (x ^ (x >> np.uint64(32))) * _M


#: Bytes of texts whose words are hashed together.
TOGETHER = 1 << 19
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]").search
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A random number for each byte, and (as far as words are long) for each place in a word.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _M)
_PLACES = _mix((np.arange(1, 4097, dtype=np.uint64) << np.uint64(9)) * _M)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes begin, and a 64-bit hash of each: the sum over its bytes of the byte's number times its place's, mixed."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.flatnonzero(~_BLANK[codes])
    if not len(inside):
        return inside, np.zeros(0, np.uint64)
    heads = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1] + 1])
    starts, lengths = inside[heads], np.diff(np.r_[heads, len(inside)])
    place, longest = inside - np.repeat(starts, lengths), int(lengths.max())
    places = _PLACES if longest <= len(_PLACES) else _mix((np.arange(1, longest + 1, dtype=np.uint64) << np.uint64(9)) * _M)
    sums = np.add.reduceat(_BYTES[codes[inside]] * places[place], heads)
    return starts, _mix(_mix(sums) + lengths.astype(np.uint64))


class Shingler:
    """Sorted, distinct 64-bit hashes of a text's shingles."""

    def __init__(self, width: int):
        self.width = width

    def hashes(self, data: bytes | None) -> np.ndarray:
        return self.all_hashes([data])[0]

    def all_hashes(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Of many texts: their words are hashed together, some TOGETHER bytes at a time."""
        found, held, size = [], [], 0
        for data in texts:
            if size and size + len(data or b"") > TOGETHER:
                found += self._hashes(held)
                held, size = [], 0
            held.append((data or b"").lower())
            size += len(held[-1]) + 1
        return found + self._hashes(held)

    def _hashes(self, texts: list[bytes]) -> list[np.ndarray]:
        data, at, parts = b"\n".join(texts), 0, []
        while at < len(data):  # a long text in parts, cut between words
            cut = _NEXT_BLANK(data, at + TOGETHER)
            starts, each = word_hashes(data[at : cut.start() if cut else len(data)])
            parts.append((starts + at, each))
            at = cut.start() if cut else len(data)
        starts, each = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))  # words up to the end of each text
        x = each
        for k in range(1, self.width):
            x = _mix(x[: max(0, len(each) - k)]) + each[k:]
        x, found, first = _mix(x), [], 0
        for end in ends.tolist():
            if end - first >= self.width:
                own = np.sort(x[first : end - self.width + 1])
                found.append(own[np.r_[True, own[1:] != own[:-1]]])
            elif end > first:
                found.append(self._few(each[first:end]))
            else:
                found.append(np.zeros(0, np.uint64))
            first = end
        return found

    def _few(self, words: np.ndarray) -> np.ndarray:
        """The whole sequence as one shingle, unlike that of any other number of words."""
        x = np.array([len(words)], np.uint64) * _N
        for k in range(len(words)):
            x = _mix(x) + words[k : k + 1]
        return _mix(x)


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def node_of(identity: bytes) -> int:
    return int.from_bytes(identity[:8], "big", signed=True)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num/den (one half or more), by size classes of ratio 2."""

    num: int
    den: int

    def bounds(self) -> np.ndarray:
        return 2 ** np.arange(41)

    def differences(self, n: int) -> int:
        """At most so many shingles are in one only of two similar sets, the smaller of n."""
        return (self.den - self.num) * n // self.num

    def prefix(self, n: int) -> int:
        """Of the first so many shingles in any fixed order, two similar sets share one."""
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a: int, b):
        """The overlap that sizes a and b need."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def similar(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)


class Signatures:
    def __init__(self, similarity: Similarity):
        self.similarity, self.firsts = similarity, similarity.bounds()
        self.plans: dict[int, tuple[int, int]] = {}

    def classes(self, n: int) -> range:
        s = self.similarity
        low, high = np.searchsorted(self.firsts, [n, n * s.den // s.num], "right")
        return range(int(low) - 1, int(high))

    def plan(self, c: int) -> tuple[int, int]:
        """Number of groups and spare groups of a size class."""
        if c not in self.plans:
            most = self.similarity.differences(int(self.firsts[c + 1]) - 1)
            usual, spare = 0.7 * float(self.firsts[c + 1]), 1
            for _ in range(3):
                empty = (most + 1 + spare) * np.exp(-usual / (most + 1 + spare))
                spare = 1 + int(np.ceil(empty + 2 * np.sqrt(empty)))
            self.plans[c] = most + 1 + spare, spare
        return self.plans[c]

    def keys(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """hashes: sorted; times: how often the frequent ones occur, which the groups leave out, and 0 for the others."""
        n, found, enough, frequent = len(hashes), [], True, times > 0
        if self.similarity.differences(n) == 0:
            return np.zeros(0, np.uint64)  # only equal to what is similar
        rest = hashes[~frequent]
        for c in self.classes(n):
            groups, spare = self.plan(c)
            emitted = min(groups, self.similarity.differences(n) + 1 + spare)
            group = ((rest >> np.uint64(33)) * np.uint64(groups)) >> np.uint64(31)  # rises with the sorted hashes
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(rest)])
            contents = np.add.reduceat(_mix(rest), starts) if len(rest) else rest
            group = group[starts]
            own = group < emitted
            found.append(_mix(_mix(contents[own]) + np.uint64(c + 1) * np.uint64(1 << 40) + group[own]))
            enough &= emitted - int(own.sum()) <= spare
        if not enough:
            first = hashes[np.argsort(times, kind="stable")[: self.similarity.prefix(n)]]  # rarest first, ties by hash
            found += [_mix(first + np.uint64(c + 1)) for c in self.classes(n)]
        return np.concatenate(found)


def times_of(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """frequent: sorted hashes and how often they occur. 0 for hashes not among them."""
    known, times = frequent
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, times[place], 0)


class RTree:
    """Points (counts per group) packed into leaves and nodes by size, each with its upper corner and sizes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, fan: int = 16):
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), fan * fan):  # within a node, leaves by the first coordinate that varies most
            part = order[a : a + fan * fan]
            widest = int(np.argmax(counts[part].max(axis=0) - counts[part].min(axis=0)))
            order[a : a + fan * fan] = part[np.argsort(counts[part, widest], kind="stable")]
        self.order, self.sizes, self.counts = order, sizes[order], counts[order]
        starts = np.arange(0, len(order), fan)
        self.fan, self.starts = fan, starts
        self.corner = np.maximum.reduceat(self.counts, starts)
        self.least, self.most = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        tops = np.arange(0, len(starts), fan)
        self.tops = tops
        self.top_corner, self.top_least, self.top_most = np.maximum.reduceat(self.corner, tops), np.minimum.reduceat(self.least, tops), np.maximum.reduceat(self.most, tops)

    def _alive(self, similarity, n, counts, corner, least, most):
        fits = (most * similarity.den >= n * similarity.num) & (n * similarity.den >= least * similarity.num)
        bound = np.minimum(corner[fits], counts).sum(axis=1)
        fits[fits] = bound >= similarity.overlap(n, np.maximum(least[fits], -(-n * similarity.num // similarity.den)))
        return np.flatnonzero(fits)

    def _below(self, found: np.ndarray, total: int) -> np.ndarray:
        below = (found[:, None] * self.fan + np.arange(self.fan)).ravel()
        return below[below < total]

    def candidates(self, similarity: Similarity, n: int, counts: np.ndarray) -> np.ndarray:
        """Positions of the points whose overlap with (n, counts) may suffice."""
        at = self._below(self._alive(similarity, n, counts, self.top_corner, self.top_least, self.top_most), len(self.starts))
        at = self._below(at[self._alive(similarity, n, counts, self.corner[at], self.least[at], self.most[at])], len(self.order))
        at = at[self._alive(similarity, n, counts, self.counts[at], self.sizes[at], self.sizes[at])]
        return self.order[at]


def resolution(size: int) -> int:
    """Number of coordinates for sets of about that size: some 4 to 8 shingles each."""
    return max(64, 1 << max(0, int(size).bit_length() - 3))


def point_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)


def involved(similarity: Similarity, sizes: np.ndarray, points: np.ndarray, n_left: int | None) -> np.ndarray:
    """Which sets the R-tree's bound leaves a partner: between the first n_left and the rest, or (None) among all."""
    first, found = n_left or 0, np.zeros(len(sizes), bool)
    tree = RTree(sizes[first:], points[first:])
    for i in range(n_left or len(sizes)):
        near = tree.candidates(similarity, int(sizes[i]), points[i]) + first
        near = near[near != i]
        found[near] = True
        found[i] |= len(near) > 0
    return found


def links(similarity: Similarity, left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Positions of similar sets in left and right (None: within left), as many as connect all that are similar. Right's positions follow left's."""
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets])
    groups = min(4096, resolution(sizes.max()))
    counts = np.stack([point_of(x, groups) for x in sets]).astype(np.int32)
    first = len(left) if right else 0
    tree, label, found = RTree(sizes[first:], counts[first:]), np.arange(len(sets)), []
    for i in range(len(left)):
        near = tree.candidates(similarity, int(sizes[i]), counts[i]) + first
        near = near[near > i]
        while len(near := near[label[near] != label[i]]):
            j = int(near[0])
            place = np.minimum(np.searchsorted(sets[i], sets[j]), len(sets[i]) - 1)
            overlap = int((sets[i][place] == sets[j]).sum())
            if similarity.similar(overlap, len(sets[i]), len(sets[j])):
                label[label == label[j]] = label[i]
                found.append((i, j))
            near = near[1:]
    return found


class Repeats:
    """Counts shingles over the sets of a task, a bounded number at a time; gives those that occur in more than one."""

    def __init__(self, at_once: int = 1_000_000):
        self.at_once, self.held, self.parts = at_once, 0, []

    def add(self, hashes: np.ndarray) -> bool:
        self.parts.append(hashes)
        self.held += len(hashes)
        return self.held >= self.at_once

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        values, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.parts]), return_counts=True)
        self.held, self.parts = 0, []
        return values[times > 1], times[times > 1]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows: docs without _text, with n_shingles and set_id, for every row; and shingle, times of shingles that are repeated in a task (set_id null)."""

    def work(batches):
        shingler, repeats, fresh, kinds = Shingler(width), Repeats(), Remembered(lambda identity: True), []

        def counted():
            values, times = repeats.take()
            nulls = [pa.nulls(len(values), kind) for kind in kinds]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], names=names)

        for batch in slices(batches):
            own = [batch.column(c) for c in kept]
            kinds = [*(x.type for x in own), pa.int64(), pa.binary()]
            found = shingler.all_hashes(batch.column("_text").to_pylist())
            identities = [set_id(x) for x in found]
            nulls = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for x in found], pa.int64()), pa.array(identities, pa.binary()), nulls, nulls], names=names)
            for identity, hashes in zip(identities, found):
                if identity not in fresh and fresh[identity] and repeats.add(hashes):
                    yield counted()
        if kinds:
            yield counted()

    kept = [c for c in docs.columns if c != "_text"]
    names = [*kept, "n_shingles", "set_id", "shingle", "times"]
    kinds_of = [*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "n_shingles long", "set_id binary", "shingle long", "times long"]
    return docs.mapInArrow(work, ", ".join(kinds_of))


def _frequent(sets: DataFrame, least: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and how often they occur: at most `kept`, 16 bytes each."""
    counts = sets.where("set_id IS NULL").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    table = counts.orderBy(F.desc("times"), "shingle").limit(kept).toArrow()
    known, times = (table.column(c).to_numpy().astype(np.int64) for c in ("shingle", "times"))
    order = np.argsort(known.view(np.uint64))
    return known.view(np.uint64)[order], times[order]


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each with one node that has it (its center), and the distinct edges from other nodes with a key to its center."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    first = np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]
    centers = nodes[first][np.cumsum(first) - 1]
    other = nodes != centers
    u, v = nodes[other], centers[other]
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[np.ones(min(1, len(u)), bool), (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
    return keys[first], nodes[first], u[new], v[new]


def _signatures(docs: DataFrame, width: int, similarity: Similarity, frequent: tuple[np.ndarray, np.ndarray], keys_at_once: int = 1 << 20) -> DataFrame:
    """key, node (half of a set's identity), center. Equal keys may mean similar sets. Where a task meets a key again, center is a node that had it before (and key, of no meaning, is node)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by common_kept

    def work(batches):
        shingler, signatures = Shingler(width), Signatures(similarity)
        fresh, keys, nodes, held = Remembered(lambda identity: True), [], [], 0

        def found():
            k, n, u, v = _stars(np.concatenate(keys).view(np.int64), np.concatenate(nodes))
            return pa.RecordBatch.from_arrays([pa.array(np.r_[k, u]), pa.array(np.r_[n, u]), pa.concat_arrays([pa.nulls(len(k), pa.int64()), pa.array(v)])], names=["key", "node", "center"])

        for batch in slices(batches):
            for hashes in shingler.all_hashes(batch.column("_text").to_pylist()):
                identity = set_id(hashes)
                if len(hashes) and identity not in fresh and fresh[identity]:
                    keys.append(signatures.keys(hashes, times_of(hashes, shared.value)))
                    nodes.append(np.full(len(keys[-1]), node_of(identity)))
                    held += len(keys[-1])
            if held >= keys_at_once:
                yield found()
                keys, nodes, held = [], [], 0
        if keys:
            yield found()

    return docs.select("_text").mapInArrow(work, "key long, node long, center long")


def _maybe_among(rows: DataFrame, chosen: DataFrame, key: str, bits: int = 1 << 25) -> DataFrame:
    """rows without most of those whose key is not among chosen's, so that they are not shuffled: a filter of one hash and `bits` bits, whatever the corpus."""
    place = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("_place")
    maps = chosen.select(place).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket")  # bits / 8 bytes at most
    return kept.where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).drop("_bucket", "_map")


def _members(docs: DataFrame, width: int, similarity: Similarity) -> DataFrame:
    """docs: _wanted (set_id), family, _text. Gives set_id, family, band, n, point (R-tree coordinates), hashes of the texts that have the wanted set, mostly once for each set."""

    def work(batches):
        shingler, firsts, fresh = Shingler(width), similarity.bounds(), Remembered(lambda identity: True)
        for batch in slices(batches):
            found = shingler.all_hashes(batch.column("_text").to_pylist())
            own = []
            for i, (x, y) in enumerate(zip(found, batch.column("_wanted").to_pylist())):
                if set_id(x) == y and y not in fresh and fresh[y]:
                    own.append(i)
            sizes = np.array([len(found[i]) for i in own], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_wanted").take(pa.array(own, pa.int64())), batch.column("family").take(pa.array(own, pa.int64())), pa.array(np.searchsorted(firsts, sizes, "right").astype(np.int32)), pa.array(sizes), pa.array([point_of(found[i], resolution(len(found[i]))).astype("<u2").tobytes() for i in own], pa.binary()), pa.array([found[i].tobytes() for i in own], pa.binary())],
                names=["set_id", "family", "band", "n", "point", "hashes"],
            )

    return docs.mapInArrow(work, "set_id binary, family long, band int, n long, point binary, hashes binary")


def _block_pairs(members: DataFrame, similarity: Similarity, sets_at_once: int, shingles_at_once: int) -> DataFrame:
    """Members once for each pair of blocks they belong to: low band, low block, high band, high block, is_low. Only sets of a size that may be similar to one beyond a band's end meet the next band."""
    blocks = members.groupBy("family", "band").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / sets_at_once), F.ceil(F.sum("n") / shingles_at_once)).cast("int").alias("blocks"))
    near = [blocks.select("family", (F.col("band") + d).alias("band"), F.col("blocks").alias(name)) for d, name in ((-1, "above"), (1, "below"))]
    sizes = blocks
    for df in near:
        sizes = sizes.join(df, ["family", "band"], "left")
    # one join with a plain table, so that a large family's side of it can be split
    placed = members.join(settled(sizes), ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    band, block = F.col("band"), F.col("block")

    def pair(low_band, low, high_band, high, is_low):
        return F.struct(low_band.alias("low_band"), low.alias("low"), high_band.alias("high_band"), high.alias("high"), F.lit(is_low).alias("is_low"))

    def each(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<low_band:int,low:int,high_band:int,high:int,is_low:boolean>>"))

    first = F.pow(F.lit(2), band - 1)  # a band's least size; its end is twice that
    up = F.when(F.col("n") * similarity.den >= 2 * first * similarity.num, F.col("above"))
    down = F.when(F.col("n") * similarity.num < first * similarity.den, F.col("below"))
    none = F.lit(0)
    pairs = F.concat(
        each(F.col("blocks") - block, lambda i: pair(band, block, band, block + i, True)),
        each(block, lambda i: pair(band, i, band, block, False)),
        each(F.coalesce(up, none), lambda i: pair(band, block, band + 1, i, True)),
        each(F.coalesce(down, none), lambda i: pair(band - 1, i, band, block, False)),
    )
    return placed.select("set_id", "family", "n", "point", F.explode(pairs).alias("p")).select("set_id", "family", "n", "point", "p.*")


_PAIR = ["family", "low_band", "low", "high_band", "high"]


def _in_order(table: pa.Table) -> tuple[pa.Table, int | None]:
    """A pair of blocks, the low one first, and its number of sets; None if the blocks are one."""
    is_low = table.column("is_low").to_numpy()
    same = table.column("low_band")[0].as_py() == table.column("high_band")[0].as_py() and table.column("low")[0].as_py() == table.column("high")[0].as_py()
    return table.take(np.argsort(~is_low, kind="stable")), None if same else int(is_low.sum())


def _involved(pairs: DataFrame, similarity: Similarity) -> DataFrame:
    """Of pairs of blocks, the sets that the R-tree leaves a partner in the other block. Only points are shuffled, no hashes."""

    def work(table: pa.Table) -> pa.Table:
        table, n_left = _in_order(table)
        kept = np.zeros(table.num_rows, bool)
        if n_left is None or 0 < n_left < table.num_rows:
            points = [np.frombuffer(x, "<u2").astype(np.int32) for x in table.column("point").to_pylist()]
            groups = min(map(len, points))
            folded = np.stack([x.reshape(-1, groups).sum(axis=0, dtype=np.int32) for x in points])
            kept = involved(similarity, table.column("n").to_numpy(), folded, n_left)
        return table.select(["set_id", *_PAIR, "is_low"]).filter(pa.array(kept))

    return pairs.groupBy(*_PAIR).applyInArrow(work, "set_id binary, family long, low_band int, low int, high_band int, high int, is_low boolean")


def _linked(pairs: DataFrame, similarity: Similarity) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        table, n = _in_order(table)
        ids, sets = table.column("set_id").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        found = links(similarity, sets, None) if n is None else links(similarity, sets[:n], sets[n:]) if 0 < n < len(sets) else []
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.binary()), "v": pa.array([ids[j] for _, j in found], pa.binary())})

    return pairs.groupBy(*_PAIR).applyInArrow(work, "u binary, v binary")


def _rows_with_root(docs: DataFrame, width: int, num: int, den: int, sets_at_once: int, shingles_at_once: int, common_least: int, common_kept: int) -> DataFrame:
    """docs (doc_id, _text, and what else tells its rows apart) without _text, with n_shingles and root, the identity of its component (null: no words)."""
    similarity = Similarity(num, den)
    docs = docs.withColumn("_h", F.xxhash64("_text"))
    rows = settled(_sets(docs, width))
    frequent = _frequent(rows, common_least, common_kept)
    sets = rows.where("set_id IS NOT NULL").drop("shingle", "times")
    least_node = F.min(F.when(F.col("center").isNull(), F.col("node"))).over(Window.partitionBy("key", F.col("center").isNull()))
    shared = _signatures(docs, width, similarity, frequent).withColumn("_least", least_node).select("node", F.coalesce("center", "_least").alias("center"))
    families = settled(components(shared.where("node != center").select(F.col("node").alias("u"), F.col("center").alias("v"))).withColumnRenamed("root", "family"))

    # one row for each set of a family, found again by its identifier and its text's hash
    lowest = F.lit(-(2**63))
    node = F.conv(F.hex(F.substring("set_id", 1, 8)), 16, -10).cast("long")
    at = F.struct(F.coalesce("doc_id", lowest).alias("_k"), "_h")
    chosen = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min(at).alias("at")).withColumn("node", node).join(families, "node")
    chosen = settled(chosen.select(F.col("set_id").alias("_wanted"), "family", "at._k", "at._h"))
    possible = _maybe_among(docs.select(F.coalesce("doc_id", lowest).alias("_k"), "_h", "_text"), chosen, "_k")
    members = settled(_members(possible.join(chosen, ["_k", "_h"]).select("_wanted", "family", "_text"), width, similarity))
    near = settled(_involved(_block_pairs(members.drop("hashes"), similarity, sets_at_once, shingles_at_once), similarity))
    hashes = _maybe_among(members.select("set_id", "hashes"), near.select("set_id").distinct(), "set_id")
    linked = components(settled(_linked(near.join(hashes, "set_id"), similarity)))

    known = sets.where("n_shingles > 0").join(linked.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names = [c for c in docs.columns if c not in ("_text", "_h")]
    return known.select(*names, "n_shingles", "root").unionByName(sets.where("n_shingles = 0").select(*names, "n_shingles", F.lit(None).cast("binary").alias("root")))


_WORK = {"sets_at_once": 512, "shingles_at_once": 1_000_000, "common_least": 8, "common_kept": 500_000}


def jaccard_components(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, text: str = "text", **work) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links are similarities of num/den or more. `work` (see _WORK) sets how much a task takes at once, never the result."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), named(text).cast("binary").alias("_text"))
    rows = _rows_with_root(docs, width, num, den, **_WORK | work)
    known = rows.where("root IS NOT NULL")
    smallest = settled(known.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # a plain table, so that a large component's side of the join can be split
    linked_docs = known.join(smallest, "root").select("doc_id", "n_shingles", "component_id")
    return linked_docs.union(rows.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_each(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, text: str = "text", **work) -> DataFrame:
    """The rows of `documents`, one for each component: of the smallest doc_id (null last), then of the smallest text (by its hash), then of the
    smallest hash of the whole row. Rows without any word stay. What stays does not depend on the order of rows."""
    columns = list(map(named, documents.columns))
    doc, mark, rest, whole, times = (unused(x, documents.columns) for x in ("_doc", "_mark", "_rest", "_whole", "_times"))
    keys = [named("doc_id").cast("long").alias(doc), F.unhex(F.md5(named(text).cast("binary"))).alias(mark), F.xxhash64(*columns).alias(rest)]
    docs = documents.select(*(k.alias(c) for k, c in zip(keys, ("doc_id", "_mark", "_rest"))), named(text).cast("binary").alias("_text"))
    rows = _rows_with_root(docs, width, num, den, **_WORK | work)
    of = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_mark", "_rest")
    equal = rows.where("root IS NOT NULL").groupBy("root", "doc_id", "_mark", "_rest").agg(F.count("*").alias("times"))
    first = equal.groupBy("root").agg(F.min(F.struct(of.alias("of"), "times")).alias("first")).select("first.of.doc_id", "first.of._mark", "first.of._rest", "first.times")
    wordless = rows.where("root IS NULL").select("doc_id", "_mark", "_rest", F.lit(1).cast("long").alias("times")).distinct()
    kept = settled(first.union(wordless).toDF("_k_doc", "_k_mark", "_k_rest", "_k_times"))
    kept = kept.select(F.struct("_k_doc", "_k_mark", "_k_rest").alias(whole), F.col("_k_times").alias(times))
    found = documents.withColumn(whole, F.struct(*(k.alias(f"_k{c}") for k, c in zip(keys, ("_doc", "_mark", "_rest"))))).join(kept, whole)
    once = found.where(F.col(times) == 1).select(*columns)
    # of wholly equal rows one stays; they are combined before this shuffle, whatever their number
    again = found.where(F.col(times) > 1).withColumn(whole, F.struct(whole)).dropDuplicates([whole]).select(*columns)
    return once.union(again)
