"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fills best. If it fits in none, the fullest
window is emitted, after it took the head of the piece if its gap is larger than ``max_padding``. Documents longer than a window give full windows and
a rest. What is open at the end of a partition is merged there by cutting freely, so that a partition hands on less than one window; these
leftovers are merged in rounds, ``FAN_IN`` partitions at a time, and the last window is cut into powers of two.

Defined results: null text is empty (one id, the end id); rows with null or equal doc_ids are packed as separate documents; an empty table gives no
rows; other columns are not read. Windows hold whole ids only, each id exactly once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Leftovers of so many partitions meet in one task of a merging round.
FAN_IN = 64
_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")] + ["ids"]


class Packer:
    """Best-fit packing into ``open_windows`` windows; emitted windows are lists of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, max_padding: int):
        self.window, self.most, self.slack = window, open_windows, max_padding
        self.gaps: list[tuple[int, int]] = []  # sorted (gap, slot)
        self.slots: dict[int, list] = {}
        self.next = 0

    def add(self, doc_id, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> Iterator[list]:
        total = len(ids) if doc_tokens is None else doc_tokens
        at = 0
        while len(ids) - at >= self.window:
            yield [(doc_id, start + at, ids[at : at + self.window], total)]
            at += self.window
        while at < len(ids):
            n = len(ids) - at
            i = bisect.bisect_left(self.gaps, (n, -1))
            if i < len(self.gaps):
                gap, slot = self.gaps.pop(i)
            elif len(self.gaps) < self.most:
                gap, slot, self.next = self.window, self.next, self.next + 1
                self.slots[slot] = []
            else:
                gap, slot = self.gaps.pop(0)  # the fullest
                if gap > self.slack:
                    self.slots[slot].append((doc_id, start + at, ids[at : at + gap], total))
                    at += gap
                yield self.slots.pop(slot)
                continue
            self.slots[slot].append((doc_id, start + at, ids[at:], total))
            if gap == n:
                yield self.slots.pop(slot)
            else:
                bisect.insort(self.gaps, (gap - n, slot))
            return

    def finish(self) -> tuple[list[list], list]:
        """Full windows made of the open ones by cutting freely, and the pieces of the one that stays partly filled."""
        full, now, room = [], [], self.window
        for _, slot in self.gaps:
            if len(self.slots[slot]) and self.window - sum(len(p[2]) for p in self.slots[slot]) <= self.slack:
                full.append(self.slots[slot])
                continue
            for doc_id, start, ids, total in self.slots[slot]:
                while len(ids):
                    now.append((doc_id, start, ids[:room], total))
                    start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                    if not room:
                        full.append(now)
                        now, room = [], self.window
        return full, now


def _split_by_powers(pieces: list) -> list[list]:
    """Sequences whose lengths are the powers of two that add up to the whole length, largest first."""
    left = sum(len(p[2]) for p in pieces)
    out: list[list] = []
    room = 0
    for doc_id, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            out[-1].append((doc_id, start, ids[:room], total))
            start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
    return out


class _Rows:
    """Collects pieces as rows of ``_COLUMNS`` and ids; ids only of leftovers."""

    def __init__(self, base: int):
        self.base, self.rows = base, []

    def window(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), tokens.crc_u32(ids), total, self.base, offset, None))
            offset += len(ids)
        self.base += 1

    def left(self, pieces: list) -> None:
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), None, total, self.base, None, ids.astype("<u4").tobytes()))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        return pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(_NAMES, columns)], names=_NAMES)


def _merger(window: int, open_windows: int, max_padding: int, high: int, last: bool):
    """Packs the leftovers of each ``part``, which come together; the last round leaves nothing."""

    def close(packer: Packer, rows: _Rows, part: int) -> pa.RecordBatch:
        full, rest = packer.finish()
        for w in full + (_split_by_powers(rest) if last else []):
            rows.window(w)
        if not last:
            rows.left(rest)
        b = rows.batch()
        return pa.record_batch([*b.columns, pa.array([part] * len(b), pa.int32())], names=[*_NAMES, "part"])

    def merge(batches):
        packer, rows, now = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != now:
                    if packer is not None:
                        yield close(packer, rows, now)
                    now = r["part"]
                    packer, rows = Packer(window, open_windows, max_padding), _Rows(high | now << 24)
                for w in packer.add(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"]):
                    rows.window(w)
        if packer is not None:
            yield close(packer, rows, now)

    return merge


def pack_documents(docs: DataFrame, path: str, end: int = 2, window: int = 4096, open_windows: int = 32, max_padding: int = 16) -> DataFrame:
    """Pack ``docs`` (doc_id, text), encoded with the tokenizer file ``path`` and ended by ``end``: a row for each piece.

    No shuffle of documents: windows are filled where the texts are read. Sequence ids are unique, not dense: the partition and a counter.
    """

    def pack(batches):
        from pyspark import TaskContext

        packer, rows = Packer(window, open_windows, max_padding), _Rows(TaskContext.get().partitionId() << 32)
        for doc_ids, ids, limits in tokens.encoded_batches(batches, path, end):
            for i, doc_id in enumerate(doc_ids.to_pylist()):
                for w in packer.add(doc_id, ids[limits[i] : limits[i + 1]]):
                    rows.window(w)
            yield rows.batch()
        full, left = packer.finish()
        for w in full:
            rows.window(w)
        rows.left(left)
        yield rows.batch()

    both = _COLUMNS + ", ids binary"
    out = common.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, f"{both}"), "pieces")
    parts, rounds = [out.where("ids is null").drop("ids")], 1
    # Leftover rows carry their partition in the high half of sequence_id.
    left = out.where("ids is not null").withColumn("part", F.shiftright("sequence_id", 32).cast("int"))
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // FAN_IN)
        merge = _merger(window, open_windows, max_padding, rounds << 56, groups == 1)
        grouped = left.withColumn("part", (F.col("part") / FAN_IN).cast("int")).repartition(groups, "part").sortWithinPartitions("part", "doc_id", "start", "doc_tokens")
        merged = common.written(grouped.mapInArrow(merge, both + ", part int"), "merged")
        parts.append(merged.where("ids is null").drop("ids", "part"))
        if groups == 1:
            break
        left, rounds = merged.where("ids is not null"), rounds + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"), end=2, window=4096)
