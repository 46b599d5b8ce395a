"""Language identification by prediction by partial matching.

Every language has a variable-order tree of byte contexts (up to ``MAX_ORDER`` bytes), learned from a bounded sample of its documents and then
frozen. In a context with total T and D distinct successors, a byte seen n times costs log2((T + D) / n) bits; any other byte pays the escape,
log2((T + D) / D) bits, and is coded in the next shorter context; an unseen context passes on for free; below order 0 a byte costs 8 bits. There is
no exclusion. The code length of a whole text under each language is the sum of its bytes' bits in double precision; the shortest wins.

All paths of the trees that occur are flattened, for every language at once, to one table per order of (last bytes -> bits under each language),
which numpy looks up with a multiplicative hash; bytes in paths that no language has seen walk down the orders.

Defined results: ``und`` with score 0 where text is null, empty or has no letter, or nothing could be learned; ties go to the first language in
byte order; repeated and null doc_ids are scored row by row; rows equal in doc_id, text and language are learned from once; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_ORDER = 3
#: Documents a language is learned from, as expected by a hash of their ids: the bound of the training sample.
SAMPLE_DOCS = 400
_CHUNK = 1 << 20


class _Lookup:
    """Positions of 64-bit keys in a sorted array by open addressing; -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, left = self._home(self.keys), np.arange(len(keys), dtype=np.int32)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def _home(self, k: np.ndarray) -> np.ndarray:
        return (k * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def find(self, k: np.ndarray) -> np.ndarray:
        at = self._home(k)
        found = self.slots[at]
        if not len(self.keys):
            return found
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != k))
        for _ in range(self.probes):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & np.uint32((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != k[wrong])]
        found[wrong] = -1
        return found


class ContextTrees:
    """Frozen statistics of all languages. ``counts``: for each language, sorted (MAX_ORDER + 1)-byte keys and how often they occur."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n = len(self.langs)
        bits = [np.full((1, n), 8.0)]  # by order + 1: bits[0] is order -1
        keys = [np.zeros(1, np.uint32)]
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []  # by order: contexts, escape bits
        grams = [counts[x] for x in self.langs]
        for order in range(MAX_ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            own = []
            for k, c in grams:
                u, back = np.unique(k & mask, return_inverse=True)
                own.append((u, np.bincount(back, weights=c, minlength=len(u))))
            all_keys = np.unique(np.concatenate([u for u, _ in own])) if n else np.zeros(0, np.uint32)
            contexts = np.unique(all_keys >> np.uint32(8)) if order else np.zeros(1, np.uint32)
            escape = np.zeros((len(contexts), n))
            below = self._below(all_keys, keys, bits)
            cost = below + 0.0
            for j, (u, c) in enumerate(own):
                context = np.searchsorted(contexts, u >> np.uint32(8)) if order else np.zeros(len(u), int)
                total = np.bincount(context, weights=c, minlength=len(contexts))
                distinct = np.bincount(context, minlength=len(contexts))
                seen = distinct > 0
                escape[seen, j] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
                cost[:, j] += escape[np.searchsorted(contexts, all_keys >> np.uint32(8)) if order else 0, j]
                cost[np.searchsorted(all_keys, u), j] = np.log2((total[context] + distinct[context]) / c)
            self.escapes.append((contexts, escape))
            keys.append(all_keys)
            bits.append(cost)
        self.keys, self.bits = keys, bits
        self._lookups = None

    def _below(self, k: np.ndarray, keys, bits) -> np.ndarray:
        """Bits of the last bytes of ``k`` at the orders made so far; ``keys[-1]`` may lack some."""
        order = len(keys) - 2
        if order < 0:
            return np.repeat(bits[0], len(k), 0)
        short = k & np.uint32((1 << 8 * (order + 1)) - 1)
        at = np.searchsorted(keys[-1], short)
        at[at == len(keys[-1])] = 0
        have = keys[-1][at] == short if len(keys[-1]) else np.zeros(len(k), bool)
        out = np.empty((len(k), len(self.langs)))
        out[have] = bits[-1][at[have]]
        if not have.all():
            out[~have] = self._escape(order, short[~have]) + self._below(short[~have], keys[:-1], bits[:-1])
        return out

    def _escape(self, order: int, k: np.ndarray) -> np.ndarray:
        contexts, escape = self.escapes[order]
        c = k >> np.uint32(8) if order else np.zeros(len(k), np.uint32)
        at = np.minimum(np.searchsorted(contexts, c), max(len(contexts) - 1, 0))
        return escape[at] * (contexts[at] == c)[:, None] if len(contexts) else np.zeros((len(k), len(self.langs)))

    def code_lengths(self, blobs: list[bytes]) -> np.ndarray:
        """Bits of each blob under each language."""
        out = np.zeros((len(blobs), len(self.langs)))
        group: list[int] = []
        size = 0
        for i, b in enumerate(blobs):
            if len(b) > _CHUNK:
                for at in range(0, len(b), _CHUNK):
                    head = b[max(0, at - MAX_ORDER) : at]
                    out[i] += self._lengths([b[at : at + _CHUNK]], [b"\0" * (MAX_ORDER - len(head)) + head])[0]
                continue
            group.append(i)
            size += len(b)
            if size >= _CHUNK:
                out[group] = self._lengths([blobs[j] for j in group])
                group, size = [], 0
        if group:
            out[group] = self._lengths([blobs[j] for j in group])
        return out

    def _lengths(self, blobs: list[bytes], heads: list[bytes] | None = None) -> np.ndarray:
        if self._lookups is None:
            self._lookups = _Lookup(self.keys[-1]), np.vstack([self.bits[-1], np.zeros((1, len(self.langs)))])
        lookup, bits = self._lookups
        pad = b"\0" * MAX_ORDER
        a = np.frombuffer(b"".join(x for i, b in enumerate(blobs) for x in (heads[i] if heads else pad, b)), np.uint8).astype(np.uint32)
        k = a[MAX_ORDER:].copy()
        for j in range(1, MAX_ORDER + 1):
            k |= a[MAX_ORDER - j : len(a) - j] << np.uint32(8 * j)
        at = lookup.find(k)
        cost = bits[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            cost[missing] = self._escape(MAX_ORDER, k[missing]) + self._below(k[missing], self.keys[:-1], self.bits[:-1])
        sizes = np.array([len(b) for b in blobs])
        starts = np.cumsum(sizes + MAX_ORDER) - sizes - MAX_ORDER
        total = np.zeros((len(blobs), len(self.langs)))
        full = np.flatnonzero(sizes)
        # Positions between two texts belong to the padding of the next one and are left out.
        edges = np.stack([starts[full], starts[full] + sizes[full]], 1).reshape(-1)
        if len(full):
            sums = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]))]), edges, axis=0)
            total[full] = sums[::2]
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lengths = self.code_lengths([(t or "").encode() for t in texts])
        best = lengths.argmin(1) if self.langs else np.zeros(len(texts), int)
        odds = np.exp2(-np.minimum(lengths - lengths.min(1, keepdims=True), 1000)).sum(1) if self.langs else np.ones(len(texts))
        known = [bool(self.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], [float(1 / o) if k else 0.0 for o, k in zip(odds, known)]


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ContextTrees:
    """Learn from ``labelled`` (doc_id, text, lang): a hash of doc_id and text picks about ``sample_docs`` whole texts of each language, fewer if rows repeat."""
    scale = 1 << 20
    usable = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).withColumn("u", F.pmod("h", F.lit(scale)))
    counts = {r.lang: r.n for r in labelled.where("text is not null and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, sample_docs / n) * scale))]) if counts else F.lit(None)
    sample = (usable.where(F.col("u") < share[F.col("lang")]) if counts else usable.limit(0)).dropDuplicates(["lang", "h"])

    def grams(batches):
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(b"\0" * MAX_ORDER + text.encode())
            for lang, blobs in by.items():
                a = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint32)
                k = a[MAX_ORDER:].copy()
                for j in range(1, MAX_ORDER + 1):
                    k |= a[MAX_ORDER - j : len(a) - j] << np.uint32(8 * j)
                inside = np.ones(len(k), bool)
                ends = np.cumsum([len(x) for x in blobs])[:-1]
                inside[(ends[:, None] - MAX_ORDER + np.arange(MAX_ORDER)).reshape(-1)] = False
                u, n = np.unique(k[inside], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(u)), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    # Bounded by the sample: distinct byte sequences of about sample_docs texts of each language.
    rows = sample.select("lang", "text").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = rows["lang"].to_numpy(zero_copy_only=False), rows["gram"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(gram, kind="stable")
    return ContextTrees({x: (gram[i].astype(np.uint32), n[i]) for x in counts for i in [order[lang[order] == x]] if len(i)})


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # of bounded size, as its sample is

    def score(batches):
        for b in batches:
            lang, sure = shared.value.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = (common.doc_crc(F.col("doc_id")) % 4 == 2).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(common.doc_crc(F.col("doc_id")) % 4 != 2)))
