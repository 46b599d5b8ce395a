"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, for the start of a word and for its continuation. Every node has a failure link, the node that has read what
remains after the greedy pieces at its front are taken off, and the number of those pieces. A word is read once, letter by letter; where no edge fits, the
counts along failure links are added. That gives the number of greedy longest-match pieces without building them, in time linear in the word. A word
that can't be cut into pieces counts as one unknown token, as usual.

Defined results: words are runs of anything but ASCII white space; null and empty text have none; null and repeated doc_ids are counted row by row; an
empty table gives no rows; other columns are not read; a word may have any length.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

#: Words that a worker remembers before it starts anew, and the longest of them.
MEMO_WORDS, MEMO_LENGTH = 500_000, 64


class Automaton:
    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0: start of a word, node 1: continuation
        ends = {}
        for root, pieces in ((0, starts), (1, continuations)):
            for p in pieces:
                if not p:
                    continue
                at = root
                for c in p:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                    at = self.edges[at][c]
                ends[at] = True
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.edges[u].items():
                todo.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                n, z = self.pops[u], self.fail[u]
                while z >= 0 and c not in self.edges[z]:
                    n, z = n + self.pops[z], self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.edges[z][c], n
        self.memo: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """The number of greedy pieces of ``word``; 0 if it can't be cut into pieces."""
        edges, fail, pops = self.edges, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := edges[u].get(c)) is None:
                n, u = n + pops[u], fail[u]
                if u < 0:
                    return 0
            u = v
        while u > 1:
            n, u = n + pops[u], fail[u]
            if u < 0:
                return 0
        return n

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        found = [self.word(w.decode()) for w in (text or "").encode().split()]  # of bytes: ASCII white space only
        unknown = found.count(0)
        return len(found), sum(found) + unknown, unknown

    def word(self, w: str) -> int:
        n = self.memo.get(w)
        if n is None:
            n = self.pieces(w)
            if len(w) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[w] = n
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Starts and continuations from a byte-level vocabulary file: tokens with a space before them start words, others go on; those may start one, too."""
    byte = {c: b for b, c in enumerate(tokens._BYTE_SIGNS)}
    starts, rest = set(), set()
    for t in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        try:
            text = bytes(byte[c] for c in t).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text.strip() and not any(map(str.isspace, text.lstrip(" "))):
            (starts if text[0] == " " else rest).add(text.lstrip(" "))
    return sorted(starts | rest), sorted(rest)


_automata: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row of ``docs`` (doc_id, text). The automaton is built once in each worker from the local file."""

    def run(batches):
        if path not in _automata:
            _automata[path] = Automaton(*vocabulary(path))
        a = _automata[path]
        for b in batches:
            rows = [a.count(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op3_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"))
