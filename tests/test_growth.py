"""Work that must not grow with the square of a note, and patterns that aren't tried at every character."""

import os
import random
import time

from pyspark.sql import functions as F

from folioflow import functions as js
from folioflow.operators import cleanup, edits, footnotes, reflow


def test_cascade_of_a_note_with_many_headings(spark):
    n = 5000
    df = spark.createDataFrame([("# a\n" * n, 4, "# b\n" * n)], "text string, cursor int, input string")
    began = time.time()
    got = df.select(cleanup.cascaded(F.col("text"), F.col("cursor"), F.col("input")).alias("x"), cleanup.cascade(F.col("text"), F.col("cursor"), F.col("input")).alias("p")).first()
    assert got.x == "## b\n" * n and got.p[0].insert == got.x
    assert time.time() - began < 10


def test_ends_of_lines_without_patterns(spark):
    df = spark.createDataFrame([(i, c + "a" + c + "b" + c) for i, c in enumerate(js.BLANKS)], "doc_id long, text string")
    assert all(r.one == r.two for r in df.select(reflow._stripped("text").alias("one"), F.regexp_replace("text", f"^{js.WS}+|{js.WS}+\\z", "").alias("two")).collect())
    plan = reflow.reflow(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_diff_of_long_texts_and_characters_of_several_bytes(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("aéèα€₭😀😁", k=rng.randint(0, 9))), "".join(rng.choices("aéèα€₭😀😁", k=rng.randint(0, 9)))) for _ in range(400)]
    pairs += [(x, x[:i] + y + x[j:]) for x, y in pairs for i in (0, 2, 5) for j in (i, i + 1)]
    rows = edits.diff_plan(spark.createDataFrame(pairs, "a string, b string"), "a", "b").select("a", "b", "plan", edits.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        p = len(os.path.commonprefix([r.a, r.b]))
        s = len(os.path.commonprefix([r.a[p:][::-1], r.b[p:][::-1]]))
        assert r.n == p and [tuple(e) for e in r.plan] == ([] if r.a == r.b else [(p, len(r.a) - s, r.b[p : len(r.b) - s])]), r
    # 20 million characters, whose number used to be counted again at each step.
    n = 10_000_000
    long = spark.range(1).select(F.concat(F.repeat(F.lit("é"), n), F.lit("x"), F.repeat(F.lit("è"), n)).alias("a"), F.concat(F.repeat(F.lit("é"), n), F.lit("y"), F.repeat(F.lit("è"), n)).alias("b"))
    began = time.time()
    assert [tuple(e) for e in edits.diff_plan(long, "a", "b").first().plan] == [(n, n + 1, "y")]
    assert time.time() - began < 10


def test_references_of_a_long_line(spark):
    n = 10000
    df = spark.createDataFrame([("[^1] [^2]: [^x] " * n,)], "line string")
    began = time.time()
    ids = F.create_map(F.lit("1"), F.lit(7), F.lit("2"), F.lit(8))
    assert df.select(footnotes._renamed(F.col("line"), ids).alias("x")).first().x == "[^7] [^2]: [^x] " * n
    assert time.time() - began < 10
