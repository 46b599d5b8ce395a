"""Toxicity by a counterfactually regularised linear classifier.

Features of a text are its distinct words and their prefixes of four and five letters; a text's margin is a bias plus the weights of all of them. The
loss is the logistic loss over a bounded sample of labelled documents, an L2 term, and a counterfactual term: each sentence of the sample that mentions an
identity term is copied with every other term of its group in its place, and with the neutral placeholder, and the squared change of the
margin is penalised. All pairs of terms of a group are penalised as well, so that terms the sample lacks behave alike. A group mention by itself
then moves no score, whatever company it keeps in the labels. What a swap changes depends on the two terms alone and on whether the sentence has the other one
already, so all swaps of the sample are counted by these, and no sentence is left out.

Words that speak for either label get weights: those that documents of the label have more often than by chance.

Defined results: null and empty texts get the score of the bias alone; rows with null or repeated doc_ids are scored row by row; repeated labels of a
doc_id count as the largest; of several texts of one doc_id that with the least hash is learned from; null labels and ids teach nothing; with labels of fewer
than two classes the score is the share of label 1 (0 without any); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that are learned from, at most: those with the least hash of doc_id.
SAMPLE_ROWS = {1: 4000, 0: 8000}
#: Features with weights that speak for each label, at most; how many documents of that label in the sample must have one, and by how many standard
#: deviations more than by chance.
MAX_FEATURES, LEAST, SURPLUS = {1: 6000, 0: 300}, 3, 4.0
L2, COUNTERFACTUAL = 1e-4, 10.0
#: Groups of interchangeable identity terms.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "african", "european", "american", "mexican"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einheimische"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)
PLACEHOLDER = "people"
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "-" for n in (4, 5) if len(word) > n))


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        if (x := self._memo.get(w)) is None:
            if len(self._memo) >= 500_000:
                self._memo.clear()
            x = self._memo[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return x

    def score(self, text: str | None) -> float:
        m = self.bias + math.fsum(map(self.word, words(text)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, m))))


def swaps(text: str, groups=IDENTITY) -> Counter:
    """How often a sentence of ``text`` loses an identity term and gains another word: (term, other), where other is empty if the sentence has it already."""
    out: Counter = Counter()
    for s in _SENTENCE.findall(text.lower()):
        have = words(s)
        for group in groups:
            for term in have.intersection(group):
                out.update((term, "" if other in have else other) for other in (*group, PLACEHOLDER) if other != term)
    return out


class Objective:
    """The loss over (features of a document, label), with swaps (term, other, weight) of which the weights add up to 1."""

    def __init__(self, rows: list[tuple[list[str], int]], pairs: list[tuple[str, str, float]], groups=IDENTITY, l2: float = L2, counterfactual: float = COUNTERFACTUAL):
        self.l2, self.counterfactual = l2, counterfactual
        self.y = np.array([r[1] for r in rows], float)
        terms = {f for group in groups for t in (*group, PLACEHOLDER) for f in features(t)}
        self.names = sorted({f for r in rows for f in r[0]} | terms)
        at = {f: i for i, f in enumerate(self.names)}
        self.row = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
        self.column = np.array([at[f] for x in rows for f in x[0]], int)
        template = [(a, b) for group in groups for a in group for b in (*group, PLACEHOLDER) if a < b]
        deltas, weights = [], []
        for a, b, weight in [*pairs, *((a, b, 1 / len(template)) for a, b in template)]:
            d: Counter = Counter({at[f]: 1 for f in features(a)})
            d.subtract([at[f] for f in features(b)] if b else [])
            deltas.append({k: v for k, v in d.items() if v})
            weights.append(weight)
        self.pair = np.repeat(np.arange(len(deltas)), [len(d) for d in deltas])
        self.place = np.array([k for d in deltas for k in d], int)
        self.sign = np.array([v for d in deltas for v in d.values()], float)
        self.weight = np.array(weights, float)

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """The loss and its gradients by the weights and the bias."""
        n = len(self.y)
        margin = bias + np.bincount(self.row, weights=w[self.column], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - self.y) / n
        change = np.bincount(self.pair, weights=self.sign * w[self.place], minlength=len(self.weight))
        loss = float((np.logaddexp(0, margin) - self.y * margin).mean() + self.l2 / 2 * w @ w + self.counterfactual / 2 * self.weight @ change**2)
        g = np.bincount(self.column, weights=e[self.row], minlength=len(w)) + self.l2 * w
        g += self.counterfactual * np.bincount(self.place, weights=self.sign * (change * self.weight)[self.pair], minlength=len(w))
        return loss, g, float(e.sum())


def fit(rows: list[tuple[list[str], int]], pairs: list[tuple[str, str, float]], groups=IDENTITY, l2: float = L2, counterfactual: float = COUNTERFACTUAL, rounds: int = 400) -> Model:
    """Fit on (features of a document, label) and swaps (term, other, weight)."""
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(math.log(share / (1 - share)), {})
    loss = Objective(rows, pairs, groups, l2, counterfactual)
    w, bias = np.zeros(len(loss.names)), math.log(y.mean() / (1 - y.mean()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on all rows
        _, g, gb = loss(w, bias)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9**t) * math.sqrt(1 - 0.999**t)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        bias -= rate * mb / (math.sqrt(vb) + 1e-9)
    return Model(float(bias), {f: float(x) for f, x in zip(loss.names, w) if abs(x) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, groups=IDENTITY, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Learn from ``labels`` (doc_id, toxic) that the caller allows and the texts of ``docs`` (doc_id, text)."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label, most in SAMPLE_ROWS.items():
        rows = one.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = rows if picked is None else picked.unionByName(rows)
    picked = common.written(picked, "picked")
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # at most sum(SAMPLE_ROWS) ids
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def unpack(batches):
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [("\t".join(k), n) for k, n in swaps(text, groups).items()]
                yield pa.record_batch([pa.array([label], pa.int32()), pa.array([sorted({f for w in words(text) for f in features(w)})], pa.list_(pa.string())), pa.array([found], pa.map_(pa.string(), pa.int64()))], names=["toxic", "features", "swaps"])

    sample = common.written(sample.select(F.col("toxic").cast("int"), "text").mapInArrow(unpack, "toxic int, features array<string>, swaps map<string,long>"), "sample")
    seen = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    size = sample.agg(F.avg("toxic").alias("share"), F.count("*").alias("n")).first()
    share = min(max(size.share or 0.0, 1e-6), 1 - 1e-6)
    surplus = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    speaks = {1: ("bad", surplus), 0: ("good", -surplus)}
    seen = common.written(seen.withColumn("good", F.col("n") - F.col("bad")), "features")
    best = [r.f for label, most in MAX_FEATURES.items() for has, s in [speaks[label]] for r in seen.where((F.col(has) >= LEAST) & (s >= SURPLUS)).orderBy(s.desc(), "f").limit(most).select("f").collect()]
    keep = F.array() if not best else F.array_intersect("features", F.lit(best))
    rows = [(list(r.f), r.toxic) for r in sample.select("toxic", keep.cast("array<string>").alias("f")).collect()]
    # At most twice as many rows as there are pairs of terms of a group.
    counts = sample.select(F.explode("swaps").alias("swap", "n")).groupBy("swap").agg(F.sum("n").alias("n")).orderBy("swap").collect()
    total = sum(r.n for r in counts)
    return fit(rows, [(*r.swap.split("\t"), r.n / total) for r in counts], groups, counterfactual=counterfactual)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES and the identity terms

    def score(batches):
        for b in batches:
            s = np.array([shared.value.score(t) for t in b.column(2).to_pylist()], float)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = (common.doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return common.map_rows(docs, run)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of the documents that may be learned from."""
    return labels.where(common.doc_crc(F.col("doc_id")) % 5 != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs, learnable(common.table(spark, sf_dir, "labels"))))
