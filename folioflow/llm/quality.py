"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates, in DataFrame operations only.

Statistics of each text (words, their code points, symbols, repeated lines, words in repeated 3-word windows) are made row-local with array functions.
Documents that pass the base rules give a transformed vector (log of the mean word length, and square roots of symbols per word and of the shares of
repeated lines and of repeated words), rounded to a fixed grid. Equal vectors of a language and source are counted first, so all iterations run
over cells with weights, whose sums are exact integers: results do not depend on the order of tasks.

For each (language, source), each language and all documents, concentration steps start from three robust estimates: medians with scales from absolute
deviations alone; with the correlations of hyperbolic tangents; and with the shape of spatial signs; and from ``RANDOM`` small subsets of its cells, picked by
seeded hashes. A step takes the mean and covariance of the ``COVERED`` nearest share of the weight, the cells at its edge in part, and measures distances
anew. After two steps the ``BEST`` starts of least determinants go on until no determinant falls by a thousandth any more, at most ``MOST_STEPS`` steps;
that with the least determinant is the group's estimate. Most texts have no symbol or repetition at all, so variances have a
floor, as regularised estimates have: what a coordinate lacks to it is added.

One rule serves groups of all sizes: an estimate counts as many documents as its group has, and ``PRIOR`` documents more that are spread as the language's
estimate says; the language's, likewise, takes ``PRIOR`` documents from that of all. A document is rejected when its squared Mahalanobis distance
from its group's estimate exceeds ``CUTOFF``.

Defined results: null text has no words and fails the base rules; null lang or source is a value of its own; null and repeated doc_ids are judged row by
row; an empty table gives no rows; columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BASE_WORDS, BASE_REPEAT = 50, 50
COVERED, MOST_STEPS, PRIOR = 0.75, 25, 100
#: Random starts and the cells of each, as expected; starts that go on after two steps.
RANDOM, SUBSET, BEST = 5, 8, 3
#: The 0.9999 quantile of chi-squared with four degrees of freedom, and the consistency factor for a covered share of 0.75.
CUTOFF, CONSISTENCY = 23.5127, 1.486
#: Steps of the grid in each coordinate, and the least standard deviation in steps. Where a group has no spread of its own and lies at 0, a text goes by
#: symbols alone from 0.1 a word, and by repeated lines or repeated words alone from a share of 0.4.
GRID, FLOOR = (100, 50, 50, 50), (6.0, 3.25, 7.5, 7.5)
#: The correlation of repeated lines with repeated words in the floor: a repeated line also repeats its words, and counts less than both apart.
TOGETHER = 0.5
#: Distances are told apart in so many steps of an octave.
_OCTAVE = 64
P = len(GRID)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_AT = [f"x{i}" for i in range(P)]
_GROUP = ["level", "lang", "source"]
_EACH = [*_GROUP, "start"]


def with_stats(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` and a struct ``into`` of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the column ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Every step is a projection of its own, as a lambda that holds an expression would evaluate it again for each element.
    w, h, s, p = (f"{into}_{x}" for x in "whsp")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(w, F.regexp_extract_all(t, F.lit(common.WORD), F.lit(0))).withColumn(f"{into}_l", lines)
    windows = F.transform(F.slice(F.col(w), 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    out = out.withColumn(h, windows)
    # Only where some window comes twice are windows sorted, with their places, to find equal neighbours.
    found = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    out = out.withColumn(s, found)
    near = lambda e, i: (e["h"] == F.get(F.col(s), i - 1)["h"]) | (e["h"] == F.get(F.col(s), i + 1)["h"])
    out = out.withColumn(p, F.array_sort(F.transform(F.filter(s, near), lambda e: e["p"])))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(p, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    stats = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(f"{into}_l") - F.size(F.array_distinct(f"{into}_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(f"{into}_l").cast("long").alias("n_lines"),
    )
    # A generator of one row: filters on the statistics are not pushed below it, where they would evaluate all steps in one expression.
    return out.withColumn(into, F.explode(F.array(stats))).drop(w, f"{into}_l", h, s, p)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < BASE_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * BASE_REPEAT)


def vector(s: Column) -> list[Column]:
    """The grid coordinates of a text that passes the base rules."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    values = (F.log(F.greatest(s["word_chars"], F.lit(1)) / n), F.sqrt(s["n_symbols"] / n), F.sqrt(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))), F.sqrt(s["n_repeat_words"] / n))
    return [F.round(v * g).cast("int") for v, g in zip(values, GRID)]


def distance(x: list[Column], m: Column) -> Column:
    """Squared Mahalanobis distance of ``x`` from the estimate ``m``, by forward substitution in its Cholesky factor."""
    y: list[Column] = []
    for i in range(P):
        d = x[i] - m[f"m{i}"]
        for j in range(i):
            d = d - m[f"l{i}{j}"] * y[j]
        y.append(d / m[f"l{i}{i}"])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factored(df: DataFrame) -> DataFrame:
    """``df`` with covariances s<i><j>: with what they lack to the floor put on, the Cholesky factor l<i><j> and the logarithm of the determinant."""
    out = df.select("*", *[F.greatest(F.lit(FLOOR[i] ** 2) - F.col(f"s{i}{i}"), F.lit(0.0)).alias(f"f{i}") for i in range(P)])
    for i, j in _PAIRS:
        c = F.col(f"s{i}{j}") + (F.col(f"f{i}") if i == j else TOGETHER * F.sqrt(F.col("f2") * F.col("f3")) if (i, j) == (3, 2) else F.lit(0.0))
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))).drop(*[f"f{i}" for i in range(P)])


def _joined(rows: DataFrame, model: DataFrame, keys: list[str] = _GROUP) -> DataFrame:
    """``rows`` with the struct m of the other columns of ``model``, whose keys may be null."""
    a, b = rows.alias("a"), model.select(*keys, F.struct(*[c for c in model.columns if c not in keys]).alias("m")).alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select("a.*", *[f"b.{k}" for k in model.columns if k in keys and k not in rows.columns], "b.m")


def _products(x: list[Column], c: Column, tail: str) -> list[Column]:
    return [F.sum(c * v).alias(f"s{i}{tail}") for i, v in enumerate(x)] + [F.sum(c * x[i] * x[j]).alias(f"q{i}{j}{tail}") for i, j in _PAIRS]


def starts(cells: DataFrame) -> DataFrame:
    """Three rows (group, start, w, m<i>, s<i><j>) for each group of ``cells`` (group, x<i>, c). Medians are exact, weighted ones: the grid bounds the
    distinct values of a coordinate."""
    median = cells.groupBy(*_GROUP).agg(F.sum("c").alias("w"), *[F.percentile(a, 0.5, F.col("c")).alias(f"m{i}") for i, a in enumerate(_AT)])
    off = _joined(cells, common.written(median, "medians"))
    spread = [F.greatest(1.4826 * F.percentile(F.abs(F.col(a) - F.col(f"m.m{i}")), 0.5, F.col("c")), F.lit(FLOOR[i])).alias(f"d{i}") for i, a in enumerate(_AT)]
    scaled = _joined(cells, common.written(off.groupBy(*_GROUP).agg(F.max("m.w").alias("w"), *[F.max(f"m.m{i}").alias(f"m{i}") for i in range(P)], *spread), "scales"))
    scaled = scaled.select(*_GROUP, "c", "m", *[((F.col(a) - F.col(f"m.m{i}")) / F.col(f"m.d{i}")).alias(f"z{i}") for i, a in enumerate(_AT)])
    z = [F.col(f"z{i}") for i in range(P)]
    length = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    # Thousandths, so that sums are exact.
    tangents = [F.round(1000 * F.tanh(v)).cast("long").alias(f"t{i}") for i, v in enumerate(z)]
    signs = [F.when(length > 0, F.round(1000 * v / length)).otherwise(0).cast("long").alias(f"u{i}") for i, v in enumerate(z)]
    scaled = scaled.select(*_GROUP, "c", "m", *tangents, *signs)
    sums = scaled.groupBy(*_GROUP).agg(F.first("m").alias("m"), *_products([F.col(f"t{i}") for i in range(P)], F.col("c"), "t"), *_products([F.col(f"u{i}") for i in range(P)], F.col("c"), "u"))
    w = F.col("m.w").cast("double")
    cov = lambda i, j: F.col(f"q{max(i, j)}{min(i, j)}t") / w - F.col(f"s{i}t") / w * F.col(f"s{j}t") / w
    unit = lambda i, j: F.lit(1.0 if i == j else 0.0)
    alike = lambda i, j: F.lit(1.0) if i == j else F.coalesce(F.try_divide(cov(i, j), F.sqrt(cov(i, i) * cov(j, j))), F.lit(0.0))
    shape = lambda i, j: F.col(f"q{i}{j}u") / w * (P / 1e6)
    each = F.array(*[F.struct(F.lit(k).alias("start"), *[(f(i, j) * F.col(f"m.d{i}") * F.col(f"m.d{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]) for k, f in enumerate((unit, alike, shape))])
    return sums.select(*_GROUP, "m", F.explode(each).alias("e")).select(*_GROUP, "e.start", "m.w", *[f"m.m{i}" for i in range(P)], *[f"e.s{i}{j}" for i, j in _PAIRS])


def random_starts(cells: DataFrame) -> DataFrame:
    """As ``starts``, from about ``SUBSET`` cells of each group, each group ``RANDOM`` times."""
    sizes = common.written(cells.groupBy(*_GROUP).agg(F.sum("c").alias("w"), F.count("*").alias("n")), "sizes")
    part = 1 << 30
    picked = _joined(cells, sizes).withColumn("start", F.explode(F.array(*[F.lit(3 + k) for k in range(RANDOM)])))
    picked = picked.where(F.pmod(F.xxhash64(*_AT, "start"), F.lit(part)) * F.col("m.n") < part * SUBSET)
    n = F.col("n").cast("double")
    sums = picked.groupBy(*_EACH).agg(F.max("m.w").alias("w"), F.count("*").alias("n"), *_products([F.col(a) for a in _AT], F.lit(1), ""))
    return sums.select(*_EACH, "w", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)], *[(F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n).alias(f"s{i}{j}") for i, j in _PAIRS])


def _concentrated(cells: DataFrame, model: DataFrame) -> DataFrame:
    """One step: from factored estimates the means and covariances of the cells that are nearest by them."""
    near = _joined(cells, model.select(*_EACH, "w", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS]))
    near = near.select(*_GROUP, F.col("m.start").alias("start"), F.col("m.w").alias("w"), *_AT, "c", F.floor(_OCTAVE * F.log2(distance([F.col(a) for a in _AT], F.col("m")) + F.lit(1.0))).cast("long").alias("b"))
    rings = near.groupBy(*_EACH, "b").agg(F.sum("c").alias("n"), F.max("w").alias("w"))
    order = Window.partitionBy(*_EACH).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.ceil(F.col("w") * COVERED)
    rings = rings.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < goal)
    # Of the cells at the edge as large a share counts as is needed.
    edge = rings.groupBy(*_EACH).agg(F.max_by(F.struct("b", goal.alias("h"), ((goal - F.col("before")) / F.col("n")).alias("share")), "b").alias("e")).select(*_EACH, "e.*")
    x = [F.col(a) for a in _AT]
    near = _joined(near, edge, _EACH)
    inner, ring = F.when(F.col("b") < F.col("m.b"), F.col("c")).otherwise(0), F.when(F.col("b") == F.col("m.b"), F.col("c")).otherwise(0)
    sums = near.where(F.col("b") <= F.col("m.b")).groupBy(*_EACH).agg(F.max("w").alias("w"), F.max("m.h").alias("h"), F.max("m.share").alias("share"), *_products(x, inner, "a"), *_products(x, ring, "b"))
    part = lambda name: (F.col(f"{name}a") + F.col("share") * F.col(f"{name}b")) / F.col("h")
    sums = sums.select(*_EACH, "w", *[part(f"s{i}").alias(f"m{i}") for i in range(P)], *[part(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS])
    return sums.select(*_EACH, "w", *[f"m{i}" for i in range(P)], *[(CONSISTENCY * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"s{i}{j}") for i, j in _PAIRS])


def minimum(cells: DataFrame) -> DataFrame:
    """For each group of ``cells`` (level, lang, source, x<i>, c) the estimate (w, m<i>, s<i><j>, logdet) of the least determinant: a written table."""
    model = common.written(_factored(starts(cells).unionByName(random_starts(cells))), "starts")
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.round("logdet", 6), "start"))
    last = None
    for step in range(MOST_STEPS):
        model = _factored(_concentrated(cells, model))
        if step == 1:
            model = model.withColumn("rank", rank).where(F.col("rank") <= BEST).drop("rank")
        model = common.written(model, "model")
        now = model.select(*_EACH, "logdet")
        if last is not None and _joined(now, last, _EACH).where(F.col("m.logdet") - F.col("logdet") > 1e-3).limit(1).count() == 0:
            break
        last = now
    values = F.struct("w", *[f"m{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS], "logdet")
    return common.written(model.groupBy(*_GROUP).agg(F.min_by(values, F.struct(F.round("logdet", 6), "start")).alias("v")).select(*_GROUP, "v.*"), "model")


def _with_prior(own: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """The mean and covariance of w documents spread as ``own`` says and of ``PRIOR`` spread as its ``parent`` says."""
    both = _joined(own, parent.select(*keys, *[f"m{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]), keys) if keys else own.crossJoin(parent.select(F.struct(*[f"m{i}" for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]).alias("m")))  # one row
    a = F.col("w") / (F.col("w") + PRIOR)
    mixed = lambda c: a * F.col(c) + (1 - a) * F.col(f"m.{c}")
    gap = lambda i: F.col(f"m{i}") - F.col(f"m.m{i}")
    return both.select("lang", "source", "w", *[mixed(f"m{i}").alias(f"m{i}") for i in range(P)], *[(mixed(f"s{i}{j}") + a * (1 - a) * gap(i) * gap(j)).alias(f"s{i}{j}") for i, j in _PAIRS])


def estimates(docs: DataFrame, stats: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row (lang, source, w, m<i>, l<i><j>) for each group of ``docs`` that has a document which passes the base rules: a written table."""
    s = F.col(stats)
    x = [v.alias(a) for a, v in zip(_AT, vector(s))]
    cells = docs.where(~base_failed(s)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *x).groupBy("lang", "source", *_AT).agg(F.count("*").alias("c"))
    none = F.lit(None).cast("string")
    level = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.cast("string").alias("lang"), b.cast("string").alias("source"))
    levels = F.explode(F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none))).alias("g")
    cells = common.written(cells.select(levels, *_AT, "c").groupBy("g.level", "g.lang", "g.source", *_AT).agg(F.sum("c").alias("c")), "cells")
    found = minimum(cells)
    of = lambda n: found.where(F.col("level") == n)
    langs = _with_prior(of(1), of(2), [])
    return common.written(_factored(_with_prior(of(0), langs, ["lang"])), "model")


def with_verdict(docs: DataFrame, stats: str, model: DataFrame, into: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` and a boolean ``into``: base rules passed and near enough to its group's estimate."""
    # One row a group; Spark broadcasts the written table if it is small enough, else joins by sorting, where AQE splits hot groups.
    fields = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _PAIRS]]
    m = model.select(F.col("lang").alias(f"{into}_k1"), F.col("source").alias(f"{into}_k2"), F.struct(*fields).alias(f"{into}_m"))
    on = [F.col(lang).cast("string").eqNullSafe(F.col(f"{into}_k1")), F.col(source).cast("string").eqNullSafe(F.col(f"{into}_k2"))]
    out = docs.join(m, on, "left")
    s = F.col(stats)
    verdict = ~base_failed(s) & F.coalesce(distance(vector(s), F.col(f"{into}_m")) <= CUTOFF, F.lit(False))
    return out.withColumn(into, verdict).drop(f"{into}_m", f"{into}_k1", f"{into}_k2")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source)."""
    rows = common.written(with_stats(docs.select("doc_id", "text", "lang", "source"), "text", "stats").drop("text"), "stats")
    out = with_verdict(rows, "stats", estimates(rows, "stats"), "kept")
    return out.select(F.col("doc_id").cast("long"), *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(F.col("stats")).alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. The rows are written once with their statistics, which take most of the time; what follows
    reads the statistics alone, and the texts at the end."""
    stats, kept = common.free_name(docs, "folio_stats"), common.free_name(docs, "folio_kept")
    rows = common.written(with_stats(docs, "text", stats), "stats")
    return with_verdict(rows, stats, estimates(rows, stats), kept).where(F.col(kept)).select(*common.own(docs))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
