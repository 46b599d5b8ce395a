"""N-gram Jaccard self-join with a count-vector R-tree.

A text's set holds its distinct word shingles as 64-bit hashes. The hashes are dealt into groups, and the counts per group are a point; the groups of a
finer resolution nest in those of a coarser one, so that long texts have finer points and two points are compared at the coarser of theirs. The overlap
of two sets is at most the sum of the coordinate minima of their points, and that of a set and all sets below an R-tree node at most the sum of
minima with the node's upper corner: what can't reach the threshold is cut off. Pairs that remain are verified on the exact sets.

Documents meet in buckets: two sets of a similarity of ``T`` or more share a hash among the first n - ceil(T n) + 1 of each, in any common order. The order
puts hashes that are frequent in a sample of documents last, by how often they occur, so that common passages make no buckets; the sample grows with the
table, so that buckets don't, and affects cost only. Behind the first hash that
two sets share, each must have enough hashes left for the overlap that their sizes ask for: in buckets of up to ``SMALL`` sets, sets without a partner by
this test go. Larger buckets are split by size: sets whose sizes differ by more than ``T`` can't be similar, so each lies in a band of sizes and meets its own
and the next, and buckets go in which no set has the hash so early as the smaller of two similar sets must. Equal sets are one class from
the start; buckets with the same classes are one bucket. Each bucket is joined through an R-tree over its points, twice: first every class
is paired with its best candidate in two of its buckets, which links groups of copies with as many pairs as members; then, for buckets that
still hold several components, all pairs of classes of different components that the bounds admit. Nodes whose classes all are in one component are
skipped against it. So no pair that could join two components is lost, and no group of copies is expanded to all its pairs. Buckets over
``CHUNK`` classes are dealt to cells, so that each pair of chunks meets in one; chunks of a component that fills several never meet each other.

Texts are read into sets once to make points and keys, which go to their buckets in one exchange, and those of candidate pairs once more in each pass.

Defined results: null or empty text has an empty set and links with nothing; fewer than ``K`` words make one shingle; null doc_ids take part but are never
the name of a component that has another (a component of null ids alone has a null name); repeated rows are linked to each other; an empty table gives no
rows; other columns are not read. Hashes of 64 bits stand for shingles and classes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 5
#: Similarity threshold as a fraction.
T = (75, 100)
#: The sample for the order of hashes: one of so many documents, or so many documents in small tables (as expected by a hash of ids); documents of it that make
#: a hash frequent, and those that make it hot; the most hashes that are told to all tasks, the most frequent ones.
ORDER_SHARE, ORDER_LEAST, FREQUENT, HOT, MOST_FREQUENT = 20, 3000, 3, 12, 500_000
LEAF, CHUNK, SMALL = 16, 4096, 48
#: Words and classes that a task remembers, texts, keys and pairs that it works on at once, and bytes of text whose keys meet in one place.
_WORDS, _MEMO, _ROWS, _KEYS, _PAIRS, _PART = 150_000, 400_000, 1000, 500_000, 200_000, 96 << 20
#: Steps of an octave in the sizes that travel with keys, and the steps of a band: a little over log2(1 / T).
_STEPS, _BAND = 2048, 852


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the ``K``-word shingles of ``text``, A-Z in lower case."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < K:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - K + 1
    h = w[:n].copy()
    for i in range(1, K):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def point(s: np.ndarray) -> np.ndarray:
    """Counts of ``s`` per group, a power of two of groups: four times as many as hashes at least, so that what two sets don't share seldom falls together,
    but 2,048 and a quarter of the hashes are enough for long sets, as the sums of their minima hardly vary."""
    d = 16
    while d < max(min(4 * len(s), 2048), len(s) // 4):
        d *= 2
    while (c := np.bincount((s & np.uint64(d - 1)).astype(np.int64), minlength=d)).max(initial=0) > 255:
        d *= 2
    return c.astype(np.uint8)


_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(p: np.ndarray) -> bytes:
    """A point for the way: most counts are 0 to 2, so a fifth of its bytes is enough."""
    return _pack.compress(p.tobytes())


def unpacked(b: bytes) -> bytes:
    return _unpack.decompress(b)


def _slices(batches):
    for b in batches:
        yield from (b.slice(i, _ROWS) for i in range(0, b.num_rows, _ROWS))


def steps(n: int) -> int:
    """The size of a set on the scale that travels with keys, rounded down."""
    return int(math.log2(max(n, 1)) * _STEPS)


def band(n: int) -> int:
    """Sets of a similarity of ``T`` or more are of one band or of neighbouring ones."""
    return steps(n) // _BAND


def left_over(n: int, size: int) -> np.ndarray:
    """For the first ``size`` places of a set of ``n``: the share of the set from there on, in 255 steps from T to 1, rounded up."""
    share = (n - np.arange(size)) / max(n, 1)
    return np.clip(np.ceil((share - T[0] / T[1]) * (255 * T[1] / (T[1] - T[0])) - 1e-9), 0, 255).astype(np.uint8)


def prefix(s: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(T n) + 1 of ``s``, and how often each is in the sample: rare hashes, by value, before those in ``frequent`` (sorted), by how often
    they are in the sample (``often``) and by value."""
    n = len(s)
    size = n - -(-T[0] * n // T[1]) + 1 if n else 0
    if not len(frequent):
        return s[:size], np.zeros(size, np.int64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    count = np.where(frequent[at] == s, often[at], 0)
    order = np.argsort(count, kind="stable")[:size]
    return s[order], count[order]


def coded(points: np.ndarray) -> np.ndarray:
    """Rows of bits: whether each count is 1 or more, 2 or more, and so on. The minimum of two counts is the number of ones that both have, so that a sum of
    minima is a count of bits, and an upper corner is the bits that any row has."""
    levels = [np.packbits(points >= t, axis=1) for t in range(1, int(points.max(initial=1)) + 1)]
    bits = np.concatenate(levels, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


class RTree:
    """Over points of one resolution, bulk-loaded in the order of their sizes and coordinates. Points and corners are kept as rows of bits."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((*points[:, :8].T, sizes))
        self.points, self.sizes, self.component = coded(points[self.order]), sizes[self.order], component[self.order]
        # Levels from the leaves up: (first row, end row, upper corner, least and largest size, component or mixed)
        bounds = np.append(np.arange(0, len(points), LEAF), len(points))
        self.levels = []
        while True:
            a, b = bounds[:-1], bounds[1:]
            first = np.array([self.component[i] for i in a])
            same = np.array([bool((self.component[i:j] == c).all()) for i, j, c in zip(a, b, first)])
            self.levels.append((a, b, np.bitwise_or.reduceat(self.points, a, axis=0), np.minimum.reduceat(self.sizes, a), np.maximum.reduceat(self.sizes, a), first, same))
            if len(a) == 1:
                break
            bounds = np.append(bounds[:-1][::LEAF], len(points))

    def _reach(self, u, v, least):
        """Whether sets of at least ``least`` shingles in all can overlap enough, and the bound on their overlap."""
        bound = np.bitwise_count(u & v).sum(-1, dtype=np.int64)
        return bound * (T[0] + T[1]) >= T[0] * least, bound

    def neighbours(self) -> list[tuple[int, int]]:
        """For every row, its best candidate by the bound on similarity, out of the leaves that can hold one, and those two of the rows that are best for
        most others, as far as the bound admits them."""
        a, b, upper, low, high, _, _ = self.levels[0]
        out = []
        for i in range(len(a)):
            # Leaves in the order of sizes: those near enough lie together.
            near = np.flatnonzero((high * T[1] >= T[0] * low[i]) & (high[i] * T[1] >= T[0] * low))
            near = near[self._reach(upper[near], upper[i], low[near] + low[i])[0]]
            rows = np.concatenate([np.arange(a[j], b[j]) for j in near])
            best, at = np.zeros(b[i] - a[i]), np.full(b[i] - a[i], -1)
            for r in np.array_split(rows, -(-len(rows) // 512)):
                own = np.arange(a[i], b[i])
                ok, bound = self._reach(self.points[own][:, None], self.points[r][None], self.sizes[own][:, None] + self.sizes[r][None])
                score = np.where(ok & (own[:, None] != r[None]), bound / (self.sizes[own][:, None] + self.sizes[r][None] - bound), 0)
                top = score.argmax(1)
                value = score[np.arange(len(own)), top]
                at, best = np.where(value > best, r[top], at), np.maximum(best, value)
            out += [(int(a[i]) + x, int(y)) for x, y in enumerate(at) if y >= 0]
        for hub in np.argsort(-np.bincount([y for _, y in out], minlength=1), kind="stable")[:2].tolist() if len(a) > 1 else []:
            ok, _ = self._reach(self.points, self.points[hub], self.sizes + self.sizes[hub])
            out += [(int(x), hub) for x in np.flatnonzero(ok) if x != hub]
        return [(int(self.order[x]), int(self.order[y])) for x, y in set(out)]

    def cross(self):
        """All pairs of rows of different components that the bounds admit, in arrays."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            a, b, upper, low, high, first, same = self.levels[level]
            if same[i] and same[j] and first[i] == first[j]:
                continue
            if high[i] * T[1] < T[0] * low[j] or high[j] * T[1] < T[0] * low[i]:
                continue
            if not self._reach(upper[i], upper[j], low[i] + low[j])[0]:
                continue
            if level:
                ca, cb = self.levels[level - 1][:2]
                below = lambda k: range(int(np.searchsorted(ca, a[k])), int(np.searchsorted(ca, b[k])))
                todo += [(level - 1, x, y) for x in below(i) for y in below(j) if i != j or x <= y]
                continue
            p, q = np.arange(a[i], b[i]), np.arange(a[j], b[j])
            ok, _ = self._reach(self.points[p][:, None], self.points[q][None], self.sizes[p][:, None] + self.sizes[q][None])
            ok &= self.component[p][:, None] != self.component[q][None]
            if i == j:
                ok &= p[:, None] < q[None]
            x, y = np.nonzero(ok)
            if len(x):
                yield self.order[p[x]], self.order[q[y]]


def bucket_pairs(classes: list[int], points: list[bytes], sizes: list[int], components: list[int], everything: bool):
    """Pairs of classes (smaller first) of one bucket that may be similar enough, in arrays."""
    d = min(map(len, points))
    folded = np.stack([np.frombuffer(p, np.uint8).astype(np.uint16).reshape(-1, d).sum(0, dtype=np.uint16) for p in points])
    tree = RTree(folded, np.array(sizes, np.int64), np.array(components, np.int64))
    c = np.array(classes, np.int64)
    for i, j in tree.cross() if everything else [np.array(tree.neighbours() or np.zeros((0, 2)), np.int64).T]:
        yield np.minimum(c[i], c[j]), np.maximum(c[i], c[j])


def _frequent(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that are frequent in the sample, and how many of its documents have each."""
    share = min(1.0, max(1 / ORDER_SHARE, ORDER_LEAST / max(n_docs, 1)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")

    def count(batches):
        for b in _slices(batches):
            s = [shingles(t) for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(s) if s else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT).toArrow()  # bounded by its limit
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


_SCAN = "doc_id long, text_hash long, n long, class long, band int, point binary, hot array<long>, home int, packed binary"


def _scan(docs: DataFrame, frequent: np.ndarray, often: np.ndarray, parts: int) -> DataFrame:
    """Rows of three kinds from ``docs`` (doc_id, text, text_hash), each with the place where it is to go (home): documents (doc_id, text_hash, n, class);
    points (class, n, band, point, hot keys), once a task for equal sets; and packed keys, of one part: 32 bits of the hash, the class, its size in steps
    and what it has left behind the key."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, often))
    names = [c.split()[0] for c in _SCAN.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=names)

    def run(batches):
        frequent, often = shared.value
        seen: set[int] = set()
        keys, classes, sizes, lefts = [], [], [], []
        turn = 0

        def sent():
            k, c, q, v = (np.concatenate(x) for x in (keys, classes, sizes, lefts))
            for x in (keys, classes, sizes, lefts):
                x.clear()
            part = ((k >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(part[order]) > 0)) if len(part) else np.zeros(0, int)
            ends = np.append(at, len(part))
            short = k.astype(np.uint32)
            return batch([(None, None, None, None, None, None, None, int(part[o[0]]), short[o].tobytes() + c[o].tobytes() + q[o].tobytes() + v[o].tobytes()) for i in range(len(at)) for o in [order[ends[i] : ends[i + 1]]]])

        for b in _slices(batches):
            rows = []
            for doc_id, text, th in zip(*(c.to_pylist() for c in b.columns)):
                s = shingles(text)
                turn += 1
                if not len(s):
                    rows.append((doc_id, th, 0, None, None, None, None, turn, None))
                    continue
                c, n = class_of(s), len(s)
                rows.append((doc_id, th, n, c, None, None, None, turn, None))
                if c in seen:  # a class that this task has sent already
                    continue
                if len(seen) < _MEMO:
                    seen.add(c)
                k, count = prefix(s, frequent, often)
                known = count >= HOT
                rows.append((None, None, n, c, band(n), packed(point(s)), k[known].view(np.int64).tolist(), c & 0x7FFFFFFF, None))
                keys.append(k[~known])
                classes.append(np.full(len(keys[-1]), c, np.int64))
                sizes.append(np.full(len(keys[-1]), steps(n), np.uint16))
                lefts.append(left_over(n, len(k))[~known])
            yield batch(rows)
            if sum(map(len, keys)) >= _KEYS:
                yield sent()
        if keys:
            yield sent()

    return docs.mapInArrow(run, _SCAN)


def _runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that are sorted by columns: the starts of runs of equal rows, each row's run and its size."""
    if not len(sorted_columns[0]):
        return (np.zeros(0, np.int64),) * 3
    new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    run = np.cumsum(new) - 1
    return starts, run, sizes[run]


def _partnered(run: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of the sets of small buckets, sorted by bucket (``run``): whether any other of the bucket may be similar by sizes and what both have left."""
    low = np.exp2(q / _STEPS) * (1 - 1e-9)
    left = (T[0] / T[1] + v * ((T[1] - T[0]) / (255 * T[1]))) * np.exp2((q + 1.0) / _STEPS) * (1 + 1e-9)
    out = np.zeros(len(run), bool)
    for d in range(1, SMALL):
        i = np.flatnonzero(run[d:] == run[:-d])
        if not len(i):
            break
        j = i + d
        ok = np.minimum(left[i], left[j]) * (T[0] + T[1]) >= T[0] * (low[i] + low[j])
        out[i[ok]] = out[j[ok]] = True
    return out


def shared_keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the packed keys of one part: bucket, class and bucket size, for keys of several classes; the bucket is named by its classes."""
    n = [len(x) // 15 for x in blobs]
    k, c, q, v = (np.concatenate([np.frombuffer(x, t, i, a * i) for x, i in zip(blobs, n)]) for t, a in ((np.uint32, 0), (np.int64, 4), (np.uint16, 12), (np.uint8, 14)))
    order = np.argsort(k, kind="stable")
    order = order[_runs(k[order])[2] > 1]  # most keys are one class's
    order = order[np.lexsort((c[order], k[order]))]
    order = order[_runs(k[order], c[order])[0]]  # a class that several tasks sent
    k, c, q, v = k[order], c[order], q[order].astype(np.int64), v[order]
    _, run, size = _runs(k)
    small = (size > 1) & (size <= SMALL)
    some = np.flatnonzero(small)
    some = some[_partnered(run[some], q[some], v[some])]
    many = np.flatnonzero(size > SMALL)
    # Large buckets by band: every set in its own and the next.
    k, c, cell = (np.concatenate(x) for x in ((k[some], k[many], k[many]), (c[some], c[many], c[many]), (np.full(len(some), -1), q[many] // _BAND, q[many] // _BAND + 1)))
    early = np.concatenate([np.ones(len(some), bool), v[many] >= 109, v[many] >= 109])  # 109 steps of 255 are under 2 T / (1 + T)
    order = np.lexsort((c, cell, k))
    k, c, cell, early = k[order], c[order], cell[order], early[order]
    starts, run, size = _runs(k, cell)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    mixed = c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    name = np.add.reduceat(mixed * np.uint64(0xD6E8FEB86659FD93), starts).view(np.int64)[run]
    keep = (size > 1) & np.logical_or.reduceat(early, starts)[run]
    name, c, size = name[keep], c[keep], size[keep]
    order = np.lexsort((c, name))
    order = order[_runs(name[order], c[order])[0]]
    return name[order], c[order], size[order]


_MET = "doc_id long, text_hash long, n long, class long, band int, point binary, hot array<long>, bucket long, size long"


def _met(batches):
    """Of the rows of ``_SCAN``, which come sorted by home and class: documents, each point once, and buckets (bucket, class, size)."""
    names = [c.split()[0] for c in _MET.split(", ")]
    now, blobs, last = None, [], None

    def buckets():
        found = shared_keys(blobs)
        none = [pa.nulls(len(found[0]), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))]
        return pa.record_batch([*none[:3], pa.array(found[1]), *none[3:], pa.array(found[0]), pa.array(found[2])], names=names)

    for b in batches:
        for home, blob in ((h, x) for h, x in zip(b.column("home").to_pylist(), b.column("packed").to_pylist()) if x is not None):
            if home != now and blobs:
                yield buckets()
                blobs = []
            now = home
            blobs.append(blob)
        band, c = b.column("band").to_pylist(), b.column("class").to_pylist()
        keep = []
        for i, blob in enumerate(b.column("packed").is_valid().to_pylist()):
            fresh = band[i] is None or c[i] != last
            keep.append(not blob and fresh)
            if band[i] is not None:
                last = c[i]
        rows = b.filter(pa.array(keep, pa.bool_()))
        none = pa.nulls(len(rows), pa.int64())
        yield pa.record_batch([*(rows.column(x) for x in names[:7]), none, none], names=names)
    if blobs:
        yield buckets()


def _joiner(everything: bool):
    def run(batches):
        found, held = [], 0

        def batch():
            both = np.unique(np.concatenate([np.stack(x) for x in found], axis=1), axis=1)
            return pa.record_batch([pa.array(x) for x in both], names=["a", "b"])

        def buckets():
            now, rows = None, []
            for b in batches:
                for key, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if key != now and rows:
                        yield rows
                        rows = []
                    now = key
                    rows.append(row)
            if rows:
                yield rows

        for rows in buckets():
            if len(rows) > 1:
                for pairs in bucket_pairs([r[0] for r in rows], [unpacked(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], everything):
                    found.append(pairs)
                    held += len(pairs[0])
                    if held > _PAIRS:
                        yield batch()
                        found, held = [], 0
        if held:
            yield batch()

    return run


def _cells(members: DataFrame, everything: bool) -> DataFrame:
    """``members`` (bucket, size, class, component) as (key, class, component), where rows of one key are to be joined with each other. Buckets over ``CHUNK``
    classes are cut into chunks; if everything is to be joined, each pair of chunks meets in a key, but for chunks of one component: those with more
    than ``CHUNK`` classes have chunks of their own."""
    of = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    if not everything:
        return members.select(F.xxhash64("bucket", F.pmod(F.xxhash64("class"), of(F.col("size")))).alias("key"), "class", "component")
    large = members.where(F.col("size") > CHUNK)
    counts = large.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    lone = F.col("c") > CHUNK
    # At most size / CHUNK components of a bucket fill chunks of their own.
    plan = counts.groupBy("bucket").agg(F.collect_list(F.when(lone, F.struct("component", of(F.col("c")).alias("k")))).alias("lone"), of(F.coalesce(F.sum(F.when(~lone, F.col("c"))), F.lit(0))).alias("m"))
    rows = large.join(plan, "bucket").withColumn("k", F.get(F.filter("lone", lambda x: x["component"] == F.col("component")), F.lit(0))["k"])
    chunk = lambda component, j: F.struct(component.cast("long").alias("component"), j.cast("long").alias("j"))
    upto = lambda n: F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n)
    own = F.when(F.col("k").isNotNull(), chunk(F.col("component"), F.pmod(F.xxhash64("class"), "k"))).otherwise(chunk(F.lit(None), F.pmod(F.xxhash64("class"), "m")))
    others = F.concat(F.flatten(F.transform("lone", lambda x: F.transform(upto(x["k"]), lambda j: chunk(x["component"], j)))), F.transform(upto(F.col("m")), lambda j: chunk(F.lit(None), j)))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.filter(others, lambda x: F.col("k").isNull() | ~x["component"].eqNullSafe(F.col("component")))))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    small = members.where(F.col("size") <= CHUNK).select(F.col("bucket").alias("key"), "class", "component")
    return small.unionByName(rows.select(cell.alias("key"), "class", "component"))


def _in_cells(members: DataFrame, points: DataFrame, everything: bool) -> DataFrame:
    """``members``, with their ``points`` (class, point, n), joined by R-trees: (a, b)."""
    dealt = _cells(members, everything).join(points.select("class", "point", "n"), "class").select("key", "class", "point", "n", "component")
    dealt = dealt.repartition(common.n_shuffle(members.sparkSession), "key").sortWithinPartitions("key", "class")
    return dealt.mapInArrow(_joiner(everything), "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs whose exact sets are similar enough. Sets are made again from the texts of ``holders`` (class, doc_id), one document a class; a field of
    bits over their ids keeps most others from being read into sets, and a join drops what it lets through."""
    needed = common.written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(holders, "class"), "needed")
    shared = docs.sparkSession.sparkContext.broadcast(common.IdField(needed.where("doc_id is not null").select("doc_id")))

    def sets(batches):
        seen: set[int] = set()
        for b in _slices(batches):
            maybe = shared.value.maybe(b.column(0).fill_null(0).to_numpy()) | b.column(0).is_null().to_numpy(zero_copy_only=False)
            out = []
            for text in b.column(1).filter(pa.array(maybe)).to_pylist():
                s = shingles(text)
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < _MEMO:
                    seen.add(c)
                out.append((c, s.view(np.int64)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["class", "set"])

    found = docs.mapInArrow(sets, "class long, set array<long>").join(needed.select("class"), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"))
    left = pairs.join(found.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a").join(found.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return left.where(both * (T[0] + T[1]) >= T[0] * (F.size("sa") + F.size("sb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(class, component) of all classes in ``links`` (a, b): the least class that can be reached, by spreading least labels and doubling the steps."""
    edges = common.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = common.written(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.min("component").alias("near"))
        step = labels.join(near, "class").select("class", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("class").alias("component"), F.col("component").alias("far"))
        step = step.join(jump, "component", "left").select("class", "was", F.least("component", F.coalesce("far", "component")).alias("component"))
        step = common.written(step, "labels")
        labels = step.select("class", "component")
        if step.where("was <> component").limit(1).count() == 0:
            return labels


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, class and ``least`` of every row of ``docs`` (doc_id, text): the least document of its component, a struct of no_id,
    doc_id, text_hash, in this order; null for an empty set."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()  # two numbers
    frequent, often = _frequent(docs, size.rows)
    parts = max(common.n_shuffle(spark), -(-size.bytes // _PART))
    scan = _scan(docs.withColumn("text_hash", F.xxhash64("text")), frequent, often, parts)
    met = common.written(scan.repartition(common.n_shuffle(spark), "home").sortWithinPartitions("home", "class").mapInArrow(_met, _MET), "met")
    points = met.where("band is not null").select("class", "n", "band", "point", "hot")
    rows = met.where("band is null and bucket is null").select("doc_id", "text_hash", "n", "class")
    often = points.select(F.explode("hot").alias("key"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("cell"), "class").select(F.xxhash64("key", "cell").alias("bucket"), "class").distinct()
    sizes = often.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = common.written(met.where("bucket is not null").select("bucket", "class", "size").distinct().unionByName(often.join(sizes, "bucket").select("bucket", "class", "size")), "members")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = common.written(rows.where("class is not null").groupBy("class").agg(F.min(own).alias("least")), "least")
    holders = least.select("class", "least.doc_id")
    # First pass: a class looks for a neighbour in two of its buckets, the largest and one by its name.
    both = F.array(F.max(F.struct("size", "bucket"))["bucket"], F.min("bucket"))
    two = members.groupBy("class").agg(both.alias("b")).select("class", F.explode(F.array_distinct("b")).alias("bucket"))
    first = members.join(two, ["class", "bucket"], "left_semi").withColumn("component", F.col("class"))
    tested = common.written(_in_cells(first, points, False), "pairs")
    links = common.written(_verified(docs, tested, holders), "links")
    labels = components(links)
    # What is left: buckets that hold several components.
    rest = members.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    more = common.written(_in_cells(rest.join(open_, "bucket", "left_semi"), points, True).join(tested, ["a", "b"], "left_anti"), "pairs")
    found = common.written(_verified(docs, more, holders), "links")
    if found.limit(1).count():
        labels = components(links.unionByName(found))
    named = least.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    best = named.groupBy("component").agg(F.min("least").alias("best"))
    named = named.join(best, "component").select("class", F.col("best").alias("least"))
    return rows.withColumnRenamed("n", "n_shingles").join(named, "class", "left").select("doc_id", "text_hash", "n_shingles", "class", "least")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class and component_id of every row of ``docs`` (doc_id, text)."""
    return linked(docs).select("doc_id", "n_shingles", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of ``docs`` one document: that with the least doc_id (rows without one last), of several the least by a hash of the text; of rows
    equal in doc_id and text one. Rows without words are copies of nothing and stay. All columns stay as they were.

    Which documents go, and which come twice, is found on rows without texts. A field of bits over them parts the rows of ``docs``: most pass as they
    are, and only those that it may name are exchanged."""
    at = common.free_name(docs, "folio_copy")
    key = lambda c: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(f"{at}_d"), F.col("doc_id").isNull().alias(f"{at}_z"), c.alias(f"{at}_t")]
    keys = [f"{at}_{x}" for x in "dzt"]
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    rows = linked(docs).select(*key(F.col("text_hash")), (F.col("least") != own).alias("copy")).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.max("copy"), F.lit(False)).alias("copy"))
    named = common.written(rows.where("copy or n > 1").select(*keys, "copy", F.xxhash64(*keys).alias("h")), "copies")
    shared = docs.sparkSession.sparkContext.broadcast(common.IdField(named.select("h")))
    keyed = docs.select(*common.own(docs), *key(F.xxhash64("text"))).select("*", F.xxhash64(*keys).alias(f"{at}_h"))

    def part(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(shared.value.maybe(b.column(b.num_columns - 1).to_numpy()) == wanted))

        return common.map_rows(keyed, run)

    some = part(True).dropDuplicates(keys).join(named.where("copy").select(*keys), keys, "left_anti")
    return part(False).select(*common.own(docs)).unionByName(some.select(*common.own(docs)))


def op10_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
