"""Pasted answers: which of three grammars a text has, and the sources it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as js

SOURCES_LINE = rf"^(Sources|Citations:|Quellen){js.WS}*\z"
SOURCE = rf"^\[([0-9]+)\]{js.WS}+({js.DOT}+?){js.WS}+(https?://[^\s]+){js.WS}*\z"
DOWNLOAD_DEF = rf"^\[\^([A-Za-z0-9_]+)_([A-Za-z0-9_]+)\]:{js.WS}+([^\s]+)\z"
LINK = r"(?<!!)\[([^\]]+)\]\(([^)]+)\)"
NO_WEB = r"^(Sources(?![A-Za-z0-9_])|Citations:|Quellen(?![A-Za-z0-9_])|\[\^[^\]]+\]:)"


def _any(text: Column, pattern: str) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda x: x.rlike(pattern))


def is_app(text: Column) -> Column:
    return _any(text, SOURCES_LINE) & _any(text, SOURCE)


def is_download(text: Column) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda x: F.trim(x).rlike(DOWNLOAD_DEF))


def is_web(text: Column) -> Column:
    return ~_any(text, NO_WEB) & text.rlike(LINK)


def handler(text: Column) -> Column:
    """The first handler, by priority, that takes the text; ``raw`` if none does."""
    return F.when(is_app(text), "app").when(is_download(text), "web-download").when(is_web(text), "web").otherwise("raw")


def web_sources(pastes: DataFrame) -> DataFrame:
    """doc_id, id (from 1), title, url of the links of a text, images aside."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)).alias("title"), F.regexp_extract_all("text", F.lit(LINK), F.lit(2)).alias("url"))
    return pastes.select("doc_id", F.posexplode(both).alias("p", "s")).select("doc_id", (F.col("p") + 1).cast("long").alias("id"), F.col("s.title").alias("title"), F.col("s.url").alias("url"))
