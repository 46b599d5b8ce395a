"""Local image descriptors that find cropped or edited copies.

Corners are taken at several scales (structure-tensor response, largest in their neighbourhood), the best few of each cell of a grid, so that their number grows
with the picture; each has the direction of its patch's centre of brightness, and a string of comparisons between pairs of points, turned by that direction. Strings are entered in tables under several fixed choices of
their bits, and images meet where such a choice is equal or differs in one bit. Pairs with two close matches are compared corner by corner: matches within a wider Hamming
distance vote for a turn, a scale and a shift; an image is a copy when enough different corners agree. Only keys that some query has are entered, by a field of bits of fixed size. Equal pictures are one class: a task
describes a class once, and results name classes by their least ids, with each row's class beside them.

Defined results: a null, undecodable or flat image has no corners and matches nothing; null pictures of one width are one class; repeated rows are members
of one class; null ids are members, and name no class that has another id; an empty table gives no rows. Images are gray, row-major bytes with a width.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALES, RADIUS, BITS = (1.0, 0.75, 0.55), 7, 128
#: Sides of the cells of a grid in pixels of the scale, and the corners that each may have.
CELL, CORNERS = 16, 4
#: Tables and the bits that each takes; the largest Hamming distance of a match; corners that must agree. A query is entered under the keys that differ in
#: one bit, too: with equal keys only, or within 12, few copies that are turned or resized are found; within 24, pictures match by chance (README).
TABLES, TABLE_BITS, NEAR, AGREE = 6, 20, 20, 5
#: Matches within SEED_NEAR that pairs need to be compared corner by corner: far fewer matches by chance are made rows than within NEAR.
SEED_NEAR, SEEDS = 16, 2
_rng = np.random.default_rng(7)
#: Pairs of points of which the tests are chosen, and the tables' bits (no bit in two tables).
_CANDIDATES = np.clip(_rng.normal(0, RADIUS / 2.2, (1000, 4)), -RADIUS, RADIUS)
_CHOICES = _rng.permutation(BITS)[: TABLES * TABLE_BITS].reshape(TABLES, TABLE_BITS)
#: Bits of each table in the two words of a string, and the number of keys that all tables have.
_MASKS = [tuple(int(w) for w in np.packbits(np.isin(np.arange(BITS), c)).view(">i8")) for c in _CHOICES]
KEYS = 1 << (TABLES - 1).bit_length() + TABLE_BITS
_MEMO = 400_000
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_X**2 + _Y**2 <= RADIUS**2).astype(np.float32)


def _smooth(a: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        b = np.take(a, np.r_[0, 0, np.arange(a.shape[axis]), [-1, -1]], axis)
        n = a.shape[axis]
        a = sum(np.take(b, np.arange(k, k + n), axis) * w for k, w in enumerate((1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)))
    return a


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear samples of ``a`` at ``scale``."""
    h, w = (max(1, int(round(n * scale))) for n in a.shape)
    y, x = np.minimum(np.arange(h) / scale, a.shape[0] - 1), np.minimum(np.arange(w) / scale, a.shape[1] - 1)
    i, j = y.astype(int), x.astype(int)
    i1, j1 = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    u, v = (y - i)[:, None].astype(np.float32), (x - j)[None].astype(np.float32)
    return a[i][:, j] * (1 - u) * (1 - v) + a[i1][:, j] * u * (1 - v) + a[i][:, j1] * (1 - u) * v + a[i1][:, j1] * u * v


def _corners(image: np.ndarray):
    """For each scale: the scale, the smoothed picture, its best corners' x and y and the direction of each."""
    base = np.asarray(image, np.float32)
    for scale in SCALES:
        a = _smooth(base if scale == 1 else resized(_smooth(base), scale))
        h, w = a.shape
        if min(h, w) < 2 * RADIUS + 6:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = (_smooth(p) for p in (gx * gx, gy * gy, gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 2
        inner = r[m:-m, m:-m]
        top = np.maximum.reduce([r[m + dy : h - m + dy, m + dx : w - m + dx] for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2)])
        y, x = np.nonzero((inner == top) & (inner > 1.0))
        if not len(y):
            continue
        # The best corners of each cell.
        cell = y // CELL * (w // CELL + 1) + x // CELL
        order = np.lexsort((-inner[y, x], cell))
        starts = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        best = np.sort(order[place < CORNERS])
        y, x = y[best] + m, x[best] + m
        patch = a[y[:, None, None] + _Y, x[:, None, None] + _X] * _DISC
        yield scale, a, x, y, np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))


def _compared(a: np.ndarray, x: np.ndarray, y: np.ndarray, turn: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """(corner, test): whether the first point, turned with the corner, is darker than the second."""
    h, w = a.shape
    c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
    px, py, qx, qy = tests.T
    at = lambda u, v: a[np.clip(np.rint(y[:, None] + s * u + c * v), 0, h - 1).astype(int), np.clip(np.rint(x[:, None] + c * u - s * v), 0, w - 1).astype(int)]
    return at(px, py) < at(qx, qy)


@functools.lru_cache(1)
def chosen_tests() -> np.ndarray:
    """The tests: those candidates that come out even most often and agree least with each other, on textures drawn from a fixed seed."""
    rng = np.random.default_rng(11)
    bits = []
    for k in range(40):
        side = (8, 12, 16, 24)[k % 4]
        a = resized(rng.normal(0, 1, (side, side)).astype(np.float32), 96 / side) * 40 + resized(rng.normal(0, 1, (4, 4)).astype(np.float32), 24.0) * 50 + 128
        bits += [_compared(p, x, y, turn, _CANDIDATES) for _, p, x, y, turn in _corners(a)]
    b = np.concatenate(bits).astype(np.float32)
    alike = np.abs(np.nan_to_num(np.corrcoef(b.T), nan=1.0))
    order = np.argsort(np.abs(b.mean(0) - 0.5), kind="stable")
    for most in np.arange(0.2, 1.05, 0.05):
        taken: list[int] = []
        for i in order:
            if len(taken) < BITS and (not taken or alike[i, taken].max() < most):
                taken.append(int(i))
        if len(taken) == BITS:
            break
    return _CANDIDATES[taken]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y in the image, scale, direction) and their strings as packed bytes."""
    frames, strings = [], []
    for scale, a, x, y, turn in _corners(image):
        strings.append(np.packbits(_compared(a, x, y, turn, chosen_tests()), axis=1))
        frames.append(np.stack([x / scale, y / scale, np.full(len(x), scale), turn], 1))
    if not frames:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(frames), np.concatenate(strings)


def table_keys(strings: np.ndarray) -> np.ndarray:
    """(corner, table): the chosen bits with the number of the table above them."""
    bits = np.unpackbits(strings, axis=1)
    return np.stack([(bits[:, c] << np.arange(TABLE_BITS, dtype=np.int64)).sum(1) + (t << TABLE_BITS) for t, c in enumerate(_CHOICES)], 1)


def described(images: DataFrame, wanted=None) -> DataFrame:
    """Of ``images`` (image_id, width, pixels) a row (image_id, class) for each, and a row (class, key, corner, x, y, scale, turn, b0, b1, lead) for each corner
    and table of a picture, once a task for equal pictures; ``lead`` marks the first of a corner's rows. The class is a hash of width and pixels. ``wanted`` is a broadcast field of bits, one for each
    possible key (a fixed size); keys that it lacks are left out."""
    names = ["image_id", "class", "key", "corner", "x", "y", "scale", "turn", "b0", "b1", "lead"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 4, pa.int64(), pa.int64(), pa.bool_()]

    def corners(out):
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.record_batch([pa.nulls(len(columns[0]), pa.int64()), *[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds[1:])]], names=names)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, named, out, held = [], [], [], 0
            for ident, width, pixels in zip(*(c.to_pylist() for c in b.columns)):
                c = int.from_bytes(hashlib.blake2b(pixels or b"", digest_size=8, salt=(width or 0).to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                ids.append(ident)
                named.append(c)
                if c in seen or not pixels or not width or width < 0 or len(pixels) % width:
                    continue
                if len(seen) < _MEMO:
                    seen.add(c)
                frames, strings = describe(np.frombuffer(pixels, np.uint8).reshape(-1, width))
                if not len(frames):
                    continue
                keys = table_keys(strings).reshape(-1)
                at = np.arange(len(keys)) if wanted is None else np.flatnonzero(wanted.value[keys >> 3] >> (keys & 7).astype(np.uint8) & 1)
                corner = at // TABLES
                words = strings.view(">i8")[corner]
                out.append((np.full(len(at), c), keys[at], corner, *frames[corner].T, words[:, 0], words[:, 1], np.diff(corner, prepend=-1) > 0))
                held += len(at)
                if held > 50_000:
                    yield corners(out)
                    out, held = [], 0
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(named, pa.int64()), *[pa.nulls(len(ids), k) for k in kinds[2:]]], names=names)
            if out:
                yield corners(out)

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), "pixels").mapInArrow(run, "image_id long, class long, key long, corner int, x double, y double, scale double, turn double, b0 long, b1 long, lead boolean")


def key_field(rows: DataFrame) -> np.ndarray:
    """A bit for each key of ``rows`` (key); of a fixed size, whatever the number of rows."""

    def bits(batches):
        field = np.zeros(KEYS // 8, np.uint8)
        for b in batches:
            k = b.column(0).to_numpy()
            np.bitwise_or.at(field, k >> 3, (1 << (k & 7)).astype(np.uint8))
        at = np.flatnonzero(field)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(field[at].astype(np.int32))], names=["at", "bits"])

    found = rows.select("key").mapInArrow(bits, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # KEYS / 8 rows at most
    field = np.zeros(KEYS // 8, np.uint8)
    field[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return field


def near_keys(rows: DataFrame) -> DataFrame:
    """``rows`` under their key and the keys of its table that differ from it in one bit."""
    flips = F.explode(F.array(*[F.lit(f).cast("long") for f in (0, *(1 << b for b in range(TABLE_BITS)))]))
    return rows.withColumn("flip", flips).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")


def poll(pair: np.ndarray, match: np.ndarray, n: int, corner: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` pairs the most corners (``corner``; the lowest 8 bits of a match if None) that agree on a turn, scale and shift, 0 if under ``AGREE``. Bins overlap by half, so that agreeing
    matches share one. What finds too few others for its turn and scale, or for its shift along one side, goes before the next is looked at."""
    best = np.zeros(n, np.int64)
    corner = match & 255 if corner is None else corner

    def agreed(of):
        kinds, of = np.unique(of, return_inverse=True)
        count = np.bincount(np.unique(of.astype(np.int64) << 32 | corner[at]) >> 32, minlength=len(kinds))
        return count[of]

    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                at = np.arange(len(match))
                of = (pair << 5 | ((match >> 8 & 31) + i) // 2 % 12) << 4 | match >> 13 & 15
                for shift in ((match >> 17 & 65535) + j >> 1, (match >> 33 & 65535) + k >> 1, None):
                    count = agreed(of)
                    keep = count >= AGREE
                    at, of, count = at[keep], of[keep], count[keep]
                    if shift is not None:
                        of = of << 17 | shift[at]
                np.maximum.at(best, pair[at], count)
    return best


def _matches(query: tuple, image: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the query of all matches with corners of the image (both: words of strings, corners and frames), and how the query then lies in the image: turn,
    scale and shift in half steps of the bins, in one number. Corners match within ``NEAR`` if some table's bits are equal or differ in one."""
    (qw, qc, qf), (iw, _, f) = query, image
    q, i = np.nonzero(np.bitwise_count(qw[:, None] ^ iw[None]).sum(2) <= NEAR)
    x = qw[q] ^ iw[i]
    meets = np.zeros(len(q), bool)
    for m in _MASKS:
        meets |= np.bitwise_count(x & np.array(m, np.int64).view(np.uint64)).sum(1) <= 1
    q, f = q[meets], f[i[meets]]
    qf = qf[q]
    turn, scale = np.mod(f[:, 3] - qf[:, 3], 2 * np.pi), qf[:, 2] / f[:, 2]
    dx = f[:, 0] - scale * (np.cos(turn) * qf[:, 0] - np.sin(turn) * qf[:, 1])
    dy = f[:, 1] - scale * (np.sin(turn) * qf[:, 0] + np.cos(turn) * qf[:, 1])
    part = lambda v, low, n, at: np.clip(np.floor(v).astype(np.int64) + low, 0, n - 1) << at
    return qc[q], part(turn / (np.pi / 12), 0, 24, 8) + part(np.log2(scale) / 0.6 + 0.5, 8, 16, 13) + part(dx / 8, 32767, 65535, 17) + part(dy / 8, 32767, 65535, 33)


def _described_lists(column) -> list[tuple]:
    """Of a column of lists of corners a tuple (words of strings, corners, frames) for each row."""
    ends, parts = column.offsets.to_numpy(), column.values
    take = lambda n: parts.field(n).to_numpy(zero_copy_only=False)
    words, frames, corner = np.stack([take("b0"), take("b1")], 1).view(np.uint64), np.stack([take(n) for n in ("x", "y", "scale", "turn")], 1), take("corner").astype(np.int64)
    return [(words[a:z], corner[a:z], frames[a:z]) for a, z in zip(ends[:-1], ends[1:])]


def _votes(batches):
    """Rows (query_class, image_class, query's corners, image's corners) as (query_class, image_class, votes) of the pairs that agree."""
    for b in batches:
        votes, of, corners, ways, held = [], [], [], [], 0

        def flush():
            votes.append(poll(np.repeat(np.arange(len(of)), of), np.concatenate(ways), len(of), np.concatenate(corners)))

        for query, image in zip(_described_lists(b.column(2)), _described_lists(b.column(3))):
            corner, way = _matches(query, image)
            of.append(len(corner))
            corners.append(corner)
            ways.append(way)
            held += len(corner)
            if held > 200_000:
                flush()
                of, corners, ways, held = [], [], [], 0
        if of:
            flush()
        votes = np.concatenate(votes) if votes else np.zeros(0, np.int64)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(votes)], names=["query_class", "image_class", "votes"]).filter(pa.array(votes >= AGREE))


def seeded(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_class, image_class of the pairs in which at least ``SEEDS`` corners of the query have a match within ``SEED_NEAR``."""
    some = lambda d, *names: d.where("key is not null").select("key", *[F.col(c).alias(n) for c, n in zip(("class", "corner", "b0", "b1"), names)])
    left, right = near_keys(some(left, "query_class", "qc", "q_b0", "q_b1")), some(right, "image_class", "corner", "b0", "b1").drop("corner")
    x0, x1 = F.col("b0").bitwiseXOR(F.col("q_b0")), F.col("b1").bitwiseXOR(F.col("q_b1"))
    # Two corners that meet in several tables match in the first of them.
    first = F
    for t, (m0, m1) in enumerate(_MASKS):
        first = first.when(F.bit_count(x0.bitwiseAND(F.lit(m0))) + F.bit_count(x1.bitwiseAND(F.lit(m1))) <= 1, F.lit(t))
    both = left.join(right, "key").where((F.bit_count(x0) + F.bit_count(x1) <= SEED_NEAR) & (first == F.shiftright("key", TABLE_BITS)))
    return both.groupBy("query_class", "image_class").agg(F.size(F.collect_set("qc")).alias("n")).where(F.col("n") >= SEEDS).drop("n")


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_class, image_class, votes of the pairs of described pictures that agree. Only pairs with seeds are compared corner by corner."""
    pairs = common.written(seeded(left, right), "seeds")
    corner = F.collect_set(F.struct("corner", "x", "y", "scale", "turn", "b0", "b1"))
    listed = lambda d, of, name: d.where("lead").join(pairs.select(F.col(of).alias("class")).distinct(), "class", "left_semi").groupBy(F.col("class").alias(of)).agg(corner.alias(name))
    both = pairs.join(listed(left, "query_class", "qs"), "query_class").join(listed(right, "image_class", "cs"), "image_class")
    return both.select("query_class", "image_class", "qs", "cs").mapInArrow(_votes, "query_class long, image_class long, votes long")


def copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Where an image of ``images`` shows a picture of ``queries`` or a part of it (both image_id, width, pixels): rows of three kinds. ``copy``: query_id,
    image_id, votes, of the least ids of two classes of equal pictures; ``query`` and ``image``: each row's id and the least id of its class (class_id)."""
    spark = images.sparkSession
    left = common.written(described(queries), "queries")
    wanted = spark.sparkContext.broadcast(key_field(near_keys(left.where("key is not null"))))  # KEYS / 8 bytes
    right = common.written(described(images, wanted), "images")
    member = lambda d: d.where("key is null").select("image_id", "class")
    least = lambda d: member(d).groupBy("class").agg(F.min("image_id").alias("least"))
    found = matched(left, right).join(least(left).select(F.col("class").alias("query_class"), F.col("least").alias("query_id")), "query_class").join(least(right).select(F.col("class").alias("image_class"), F.col("least").alias("image_id")), "image_class")
    none = F.lit(None).cast("long")
    out = found.select(F.lit("copy").alias("kind"), "query_id", "image_id", "votes", none.alias("class_id"))
    own = lambda d: member(d).join(least(d), "class")
    out = out.union(own(left).select(F.lit("query"), "image_id", none, none, "least"))
    return out.union(own(right).select(F.lit("image"), none, "image_id", none, "least"))


SIDE = 64


def rendered(vector, side: int = SIDE) -> np.ndarray:
    """A gray picture of a vector: its values as a coarse relief, and a fine texture drawn from them."""
    v = np.asarray(vector, np.float64)
    rng = np.random.default_rng(np.frombuffer(np.round(v * 64).astype(np.int16).tobytes(), np.uint16).astype(np.uint64))
    n = int(np.ceil(np.sqrt(max(len(v), 1))))
    coarse = np.resize(v, (n, n))
    a = resized(coarse.astype(np.float32), side / n)[:side, :side] * 200
    spots = rng.normal(0, 1, (side // 4, side // 4)).astype(np.float32)
    a = a + resized(spots, 4.0) * 45 + 128
    return np.clip(a, 0, 255).astype(np.uint8)


def edited(a: np.ndarray, kind: int = 0) -> np.ndarray:
    """Brighter, with noise; of kind 0 a part of three quarters of each side, of kind 1 such a part turned by 20 degrees, of kind 2 the whole at four fifths of its size, of kind
    3 the part at four fifths."""
    n, degrees, part, scale, middle = a.shape[0], (0, 20, 0, 0)[kind], (0.75, 0.75, 1.0, 0.75)[kind], (1.0, 1.0, 0.8, 0.8)[kind], (0.55, 0.55, 0.5, 0.55)[kind]
    side, t = int(part * n * scale), np.deg2rad(degrees)
    y, x = (np.mgrid[:side, :side] - (side - 1) / 2) / scale
    u, v = np.cos(t) * x - np.sin(t) * y + n * middle, np.sin(t) * x + np.cos(t) * y + n * 0.5
    u, v = np.clip(u, 0, n - 1.001), np.clip(v, 0, n - 1.001)
    i, j = v.astype(int), u.astype(int)
    p, q, f = v - i, u - j, a.astype(float)
    b = f[i, j] * (1 - p) * (1 - q) + f[i + 1, j] * p * (1 - q) + f[i, j + 1] * (1 - p) * q + f[i + 1, j + 1] * p * q
    return np.clip(b * 0.9 + 20 + np.random.default_rng(int(a.sum())).normal(0, 2, b.shape), 0, 255).astype(np.uint8)


def pictures(vectors: DataFrame, change: bool) -> DataFrame:
    """Pictures (image_id, width, pixels) of ``vectors`` (vec_id, embedding), null ones of null vectors; edited copies if ``change``, of four kinds by the hundreds
    of their ids."""

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = None if v is None else rendered([x or 0.0 for x in v])
                out.append((i, p if p is None or not change else edited(p, (i or 0) // 100 % 4)))
            yield pa.record_batch([pa.array([i for i, _ in out], pa.int64()), pa.array([None if p is None else p.shape[1] for _, p in out], pa.int32()), pa.array([None if p is None else p.tobytes() for _, p in out], pa.binary())], names=["image_id", "width", "pixels"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "image_id long, width int, pixels binary")


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of the pictures whose id is divisible by 100, searched in the pictures of all vectors (the tables have no images of their own)."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return copies(pictures(vectors.where("vec_id % 100 = 0"), True), pictures(vectors, False))
