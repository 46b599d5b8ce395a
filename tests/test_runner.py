"""Scripts on rows: every outcome, and rows that don't touch each other."""

import time

from pyspark.sql import functions as F

from folioflow.operators import runner


def written():
    """A function inside, as workers don't have this module."""

    def script(text, cursor, given):
        if given == "boom":
            raise ValueError("no such thing")
        if given == "mute":
            raise KeyError
        if given == "exit":
            raise SystemExit("leaving")
        if given == "sleep":
            try:
                time.sleep(30)
            except Exception:
                return [(0, 0, "caught")]
        if given == "loop":
            while True:
                pass
        if given == "far":
            return [(0, 1, "x"), (0, len(text) + 1, "x")]
        if given == "odd":
            return ["abc", "no edit"]
        if given == "none":
            return None
        if given == "empty":
            return []
        return [(cursor, cursor, given), (0, 1, "T")]

    return script


def test_outcomes_by_row(spark):
    given = ["boom", "mute", "exit", "sleep", "loop", "far", "odd", "none", "empty", "ok", None]
    rows = spark.createDataFrame([(i, "text", 2, g, "kept", None) for i, g in enumerate(given)], "doc_id long, text string, cursor int, input string, other string, _x string")
    got = {g: r for g, r in zip(given, runner.run(rows, written(), seconds=0.5).orderBy("doc_id").collect())}
    failed = {"boom": "no such thing", "mute": "KeyError", "exit": "leaving", "sleep": "timed out after 0.5 s", "loop": "timed out after 0.5 s"}
    for g, why in failed.items():
        assert (got[g].kind, got[g].reason, got[g].text, got[g].plan) == ("failed", why, f"te{g}xt", [])
    assert got["far"].kind == "failed" and got["far"].text == "tefarxt" and got["odd"].kind == "failed"
    assert [(got[g].kind, got[g].text) for g in ("none", "empty", "ok", None)] == [("noop", "text"), ("noop", "text"), ("applied", "Teokxt"), ("applied", "Text")]
    assert all(r.other == "kept" for r in got.values())


def test_policies(spark):
    cases = [("enabled", None, "applied"), ("disabled", "enable-once", "blocked"), ("ask", None, "blocked"), ("ask", "disable", "blocked"), ("ask", "enable-once", "applied"), ("ask", "enable-session", "applied"), (None, None, "blocked"), ("other", None, "blocked")]
    rows = spark.createDataFrame([(i, "text", 0, "ok", p, d) for i, (p, d, _) in enumerate(cases)], "doc_id long, text string, cursor int, input string, policy string, decision string")
    got = runner.run(rows, written(), F.col("policy"), F.col("decision")).orderBy("doc_id").collect()
    assert [r.kind for r in got] == [k for *_, k in cases] and all(r.text == "text" for r in got if r.kind == "blocked")


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, "a", 99, "boom"), (1, "a", -5, "boom")], "doc_id long, text string, cursor int, input string")
    got = runner.run(rows, written()).collect()
    assert sorted((r.kind, r.text) for r in got) == [("failed", ""), ("failed", "aboom"), ("failed", "booma")]
    assert runner.run(rows.limit(0), written()).count() == 0
