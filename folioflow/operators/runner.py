"""Scripts that users write, run on rows so that one row's failure stays its own.

A script is a Python function of (text, cursor, input) that gives a plan, a list of edits (from, to, insert), or nothing. It runs in Arrow batches, row by row,
behind a guard for errors and for time; what the row becomes is then a matter of columns.
"""

from __future__ import annotations

import signal
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import edits

#: Seconds after which a script is given up.
TIMEOUT = 30.0
PLAN = "array<struct<from:int,to:int,insert:string>>"


class Overrun(BaseException):
    """Not an ordinary exception, so that a script's own handlers let it pass."""


@contextmanager
def _limited(seconds: float):
    """Raise ``Overrun`` in what runs inside once ``seconds`` are over. Python workers run their tasks in the main thread, to which alarms go."""

    def ring(*_):
        raise Overrun(f"timed out after {seconds:g} s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def outcome(script: Callable, text: str, cursor: int, given: str, seconds: float = TIMEOUT) -> tuple[str | None, list[dict]]:
    """Why a script failed on a row (null if it didn't), and its plan. A plan that isn't one, or that reaches out of the text, is a failure, too."""
    try:
        with _limited(seconds):
            plan = []
            for start, end, insert in script(text, cursor, given) or []:
                if not (isinstance(start, int) and isinstance(end, int) and isinstance(insert, str) and 0 <= start <= end <= len(text)):
                    raise ValueError(f"not an edit of this text: {(start, end, insert)!r}")
                plan.append({"from": start, "to": end, "insert": insert})
    except (Exception, SystemExit, Overrun) as e:
        return str(e) or type(e).__name__, []
    return None, plan


def may_run(policy: Column, decision: Column | None = None) -> Column:
    """Whether a script with ``policy`` runs: enabled ones do, disabled ones don't, and those that ask do if the ``decision`` is there and isn't to disable it."""
    asked = F.lit(False) if decision is None else F.coalesce(decision != "disable", F.lit(False))
    return F.coalesce(F.when(policy == "enabled", True).when(policy == "ask", asked), F.lit(False))


def run(rows: DataFrame, script: Callable, policy: Column | None = None, decision: Column | None = None, seconds: float = TIMEOUT) -> DataFrame:
    """``rows`` (text, cursor, input and any others, which stay) with kind, reason, plan and ``text`` as it is afterwards.

    kind is ``applied`` (a plan of one edit or more), ``noop`` (none), ``blocked`` (it may not run; the script isn't called) or ``failed`` (an error, an overrun or a
    plan that is none: the input is put in at the cursor as it is, and nothing of the plan). Null texts and inputs are empty, a null cursor is 0, one behind the
    end is the end."""

    @F.pandas_udf(f"reason string, plan {PLAN}")
    def tried(text: pd.Series, cursor: pd.Series, given: pd.Series, goes: pd.Series) -> pd.DataFrame:
        done = [outcome(script, t, int(c), g, seconds) if go else (None, []) for t, c, g, go in zip(text, cursor, given, goes, strict=True)]
        return pd.DataFrame({"reason": [r for r, _ in done], "plan": [p for _, p in done]})

    goes = F.lit(True) if policy is None else may_run(policy, decision)
    text = F.coalesce("text", F.lit(""))
    cursor = F.least(F.greatest(F.coalesce(F.col("cursor").cast("int"), F.lit(0)), F.lit(0)), F.length(text))
    out = rows.withColumns({"text": text, "_cursor": cursor, "_input": F.coalesce("input", F.lit("")), "_goes": goes})
    out = out.withColumn("_done", tried("text", "_cursor", "_input", "_goes"))
    kind = F.when(~F.col("_goes"), "blocked").when(F.col("_done.reason").isNotNull(), "failed").when(F.size("_done.plan") > 0, "applied").otherwise("noop")
    out = out.withColumns({"kind": kind, "reason": F.col("_done.reason"), "plan": F.col("_done.plan")})
    raw = F.array(F.struct(F.col("_cursor").alias("from"), F.col("_cursor").alias("to"), F.col("_input").alias("insert"))).cast(PLAN)
    put = edits.apply_edits(F.col("text"), F.when(F.col("kind") == "failed", raw).otherwise(F.col("plan")))
    return out.withColumn("text", put).drop("_cursor", "_input", "_goes", "_done")


def notice(kind: Column, reason: Column) -> Column:
    """What to say of an outcome: only failures are told."""
    return F.when(kind == "failed", F.concat(F.lit("script failed: "), reason))
