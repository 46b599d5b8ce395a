"""Code-like tokens of notes put in backticks.

Which tokens count depends on where earlier, more certain patterns have matched; matches with their places are not to be had from SQL functions, so this is
one Arrow function over batches of texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as js

#: What is code or a link already, and what is to be code, the most certain first: fixed values.
DONE = [r"```[\s\S]*?```", r"`[^`\n]+`", r"!?\[[^\]\n]*\]\([^)\n]*\)"]
TOKENS = [
    r"(?<![\w`])[\w./+-]*\.[A-Za-z]{1,8}:\d+(?:-\d+)?(?![\w`])",
    rf"(?<![\w`])\w+::{js.WS}*\[\[[^\]\n]+\]\](?![`])",
    rf"(?<![\w`])\w+(?:\.\w+)+:{js.WS}*\[\](?![\w`])",
    r"(?<![`\[])\[\[[^\]\n]+\]\](?![`\]])",
    r"(?<![\w`.])[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+(?![\w`(])",
]
_done, _tokens = ([re.compile(p, re.ASCII) for p in ps] for ps in (DONE, TOKENS))


def quoted(text: str | None) -> str | None:
    """``text`` with its tokens in backticks; each character belongs to the first pattern that took it."""
    if not text:
        return text
    taken = bytearray(len(text))
    for p in _done:
        for a, b in (m.span() for m in p.finditer(text)):
            taken[a:b] = b"\x01" * (b - a)
    ticks: dict[int, int] = {}
    for p in _tokens:
        for a, b in (m.span() for m in p.finditer(text)):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                ticks[a], ticks[b] = ticks.get(a, 0) + 1, ticks.get(b, 0) + 1
    at, out = 0, []
    for i in sorted(ticks):
        out += [text[at:i], "`" * ticks[i]]
        at = i
    return "".join([*out, text[at:]])


def _quoted(texts: pd.Series) -> pd.Series:
    return texts.map(quoted, na_action="ignore")


def quote_code(text: Column) -> Column:
    """``text`` with its code-like tokens in backticks; null stays null."""
    return F.pandas_udf(_quoted, "string")(text)
