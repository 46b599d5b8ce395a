"""Edit plans: arrays of (from, to, insert) against the original text, in code points; and places counted in UTF-16 units, as editors count them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are two UTF-16 units.
_WIDE = r"[\x{10000}-\x{10FFFF}]"


def apply_edits(text: Column, plan: Column) -> Column:
    """The text after a plan of disjoint edits: gaps and inserts from left to right; of edits at one place the first in the plan comes first."""
    ordered = F.array_sort(F.transform(plan, lambda e, i: F.struct(e["from"].alias("from"), i.alias("i"), e["to"].alias("to"), e["insert"].alias("insert"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, e: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(e["from"].cast("int") - a["at"], F.lit(0)))
        return F.struct(F.greatest(e["to"].cast("int"), a["at"]).alias("at"), F.concat(a["out"], gap, e["insert"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often, or in whatever loops, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _equal_bytes(a: Column, b: Column, most: Column, end: bool = False) -> Column:
    """The number of equal bytes at the front, or the end, of two binaries, ``most`` at most. Bisection: each step compares only bytes that no step before it has
    found equal, so that all of them together read a text about twice."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    piece = lambda x, k, s: F.substr(x, F.length(x) - k - s + 1 if end else k + 1, s)
    return bound(most, lambda n: F.aggregate(steps, F.lit(0), lambda k, s: F.when((s <= n - k) & (piece(a, k, s) == piece(b, k, s)), k + s).otherwise(k)))


def _tails(x: Column, at: Column) -> Column:
    """How many bytes of ``x`` from ``at`` (from 1) on, three at most, go on with a character that begins before them."""
    return F.length(F.regexp_extract(F.hex(F.substr(x, at, F.lit(3))), "^([89AB].)*", 0)) / 2


def _front(a: Column, b: Column) -> Column:
    """The bytes of the equal characters at the front of two binaries. Of a character of which only the first bytes are equal these don't count."""
    same = _equal_bytes(a, b, F.least(F.length(a), F.length(b)))
    inside = lambda p: F.hex(F.substr(a, p + 1, F.lit(1))).rlike("^[89AB]")
    # The last byte before the place that isn't one that goes on: of the last four, as no character has more.
    begun = lambda p: F.length(F.regexp_extract(F.hex(F.substr(a, F.greatest(p - 3, F.lit(1)), F.least(p, F.lit(4)))), "([C-F].)([89AB].)*$", 0)) / 2
    return bound(same, lambda p: (p - F.when(inside(p), begun(p)).otherwise(0)).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of equal characters at the front."""
    both = F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b"))
    return bound(both, lambda x: F.length(F.substr(x["a"], F.lit(1), _front(x["a"], x["b"])).cast("string")))


def diff_plan(rows: DataFrame, old: str, new: str, into: str = "plan") -> DataFrame:
    """``rows`` with the plan ``into``: none or one edit between the longest common prefix and the longest common suffix that does not overlap it.

    The texts are compared as bytes, whose places cost nothing to find, and only what the edit needs is counted in characters."""
    both = F.struct(F.col(old).cast("binary").alias("a"), F.col(new).cast("binary").alias("b"))
    text = lambda x, p, n: F.substr(x, p + 1, n).cast("string")

    def edit(x: Column, p: Column, s: Column) -> Column:
        start = F.length(text(x["a"], F.lit(0), p))
        end = start + F.length(text(x["a"], p, F.length(x["a"]) - p - s))
        return F.struct(start.alias("from"), end.alias("to"), text(x["b"], p, F.length(x["b"]) - p - s).alias("insert"))

    def back(x: Column, p: Column) -> Column:
        same = _equal_bytes(x["a"], x["b"], F.least(F.length(x["a"]), F.length(x["b"])) - p, end=True)
        return bound(same, lambda s: (s - F.least(s, _tails(x["a"], F.length(x["a"]) - s + 1))).cast("int"))

    found = bound(both, lambda x: bound(_front(x["a"], x["b"]), lambda p: bound(back(x, p), lambda s: edit(x, p, s))))
    none = F.array().cast("array<struct<from:int,to:int,insert:string>>")
    return rows.withColumn(into, F.when(F.col(old) == F.col(new), none).otherwise(F.array(found)))


def n_units(text: Column) -> Column:
    """The length of a text in UTF-16 units: a character beyond the basic plane is two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def in_units(text: Column, at: Column) -> Column:
    """The place ``at`` of a text, in code points, counted in units."""
    return F.when(text.rlike(_WIDE), n_units(F.substr(text, F.lit(1), at.cast("int")))).otherwise(at.cast("int"))


def in_points(text: Column, at: Column) -> Column:
    """The place ``at`` of a text, in units, counted in code points; a place within a pair of units counts as the one before it."""
    units = F.encode(text, "UTF-16BE")
    # The units up to the place, without a first half of a pair at their end.
    half = F.hex(F.substr(units, (2 * at - 1).cast("int"), F.lit(1))).rlike("^D[89AB]") & (at > 0)
    front = F.substr(units, F.lit(1), (2 * (at - half.cast("int"))).cast("int"))
    return F.when(text.rlike(_WIDE), F.length(F.decode(front, "UTF-16BE"))).otherwise(at.cast("int"))


def plan_in_units(text: Column, plan: Column) -> Column:
    """A plan with its places in units. Notes without a character beyond the basic plane keep their plan as it is; each place of others costs a pass over the text before it."""
    return _moved(text, plan, in_units)


def plan_in_points(text: Column, plan: Column) -> Column:
    """A plan whose places are in units, for ``apply_edits``."""
    return _moved(text, plan, in_points)


def _moved(text: Column, plan: Column, place) -> Column:
    moved = F.transform(plan, lambda e: F.struct(place(text, e["from"]).alias("from"), place(text, e["to"]).alias("to"), e["insert"].alias("insert")))
    same = F.transform(plan, lambda e: F.struct(e["from"].cast("int").alias("from"), e["to"].cast("int").alias("to"), e["insert"].alias("insert")))
    return F.when(text.rlike(_WIDE), moved).otherwise(same)
