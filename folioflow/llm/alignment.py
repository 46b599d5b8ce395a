"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how usual each pair of ids is in the corpus.

Every byte of a text gets a sign: whether a token of A ends there, one of B, both or none. A regular expression scans the signs for spans up to each place
where both end: these spans are the groups, and the signs in them count their tokens. Between two such places no ends meet, so the tokens of a group
overlap like a chain: each end but the last begins a new overlapping pair.

A text is cut where tokens of both tokenizers end whatever stands around it (before a lone space or line feed between other signs); each piece is encoded
and aligned once and kept in a bounded memo of the worker.

How many documents hold a pair of ids linked is counted over the whole corpus: each chunk (some megabytes of texts of one task) counts the documents of
its own pairs, so what is shuffled has one row a pair and chunk, not one a link; the sums go back to the chunks that have the pair, and each chunk
finishes its own documents.

Defined results: a null, empty or not reproduced text (its joined token bytes differ from space and text, as with U+2581) has no tokens: zeros and an
empty string. Equal rows and equal or null doc_ids stay separate rows, each a document of its own; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Signs of text of a chunk, one document at least.
CHUNK_SIGNS = 8 << 20
#: Pieces that a worker remembers, in two halves of which it forgets the older one, and the longest piece it remembers.
MEMO_PIECES, MEMO_LENGTH = 400_000, 48
#: Signs of text that are cut before their unknown pieces are encoded.
SLICE_SIGNS = 1 << 20
#: Signs of a byte: no end, an end of A, of B, of both, whose code is the two ends' codes put together by "or".
NONE, A_END, B_END, BOTH = b"`abc"
_GROUP = re.compile(rb"[`ab]*c")
#: A space in byte-level vocabularies.
_SPACE = tokens._BYTE_SIGNS[32]
_LONE = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def token_signs(size: int, end: int) -> bytes:
    """The signs of the bytes of a token."""
    return bytes([NONE]) * (size - 1) + bytes([end])


def label_string(of_a: list[bytes], of_b: list[bytes]) -> bytes:
    """A sign for each byte of a text, from the signs of its tokens of A and of B."""
    a, b = b"".join(of_a), b"".join(of_b)
    return (int.from_bytes(a) | int.from_bytes(b)).to_bytes(len(a))


class _Sizes(dict):
    """The numbers of tokens of A and of B in a group, by its signs."""

    def __missing__(self, signs: bytes) -> tuple[int, int]:
        found = signs.count(b"a") + 1, signs.count(b"b") + 1
        if len(signs) <= 16:
            self[signs] = found
        return found


_SIZES = _Sizes()


def group_sizes(signs: bytes) -> list[tuple[int, int]]:
    """The numbers of tokens of A and of B in each group."""
    return [_SIZES[s] for s in _GROUP.findall(signs)]


def group_links(signs: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs of ids whose byte ranges overlap, in order, as unsigned 32-bit numbers: one for each end, which is a pair of the tokens that are open there."""
    ends = np.frombuffer(signs.replace(b"`", b""), np.uint8)
    of_a, of_b = ends & 1, ends >> 1 & 1
    open_a, open_b = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
    return a.astype("<u4")[open_a] << 16 | b.astype("<u4")[open_b]


class Aligned(NamedTuple):
    """A text's tokens of both kinds, its groups, its links as unsigned 32-bit numbers (A's id in the upper half) and its groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    links: bytes
    groups: str


class Aligner:
    """Aligns texts with a space before them. A is a file for ``tokenizers`` with a byte-level vocabulary, B a model for ``sentencepiece`` that adds the space
    itself; strings of special tokens are plain text for both."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        sizes = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(sizes) > 1 << 16:
            raise ValueError(f"ids of 16 bits are needed, not vocabularies of {sizes}")
        byte_of = {sign: bytes([i]) for i, sign in enumerate(tokens._BYTE_SIGNS)}
        self.bytes_a = [b"".join([byte_of.get(c, c.encode()) for c in self.a.id_to_token(i) or ""]) for i in range(sizes[0])]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.match(p := self.b.id_to_piece(i))) else p.replace("\u2581", " ").encode() for i in range(sizes[1])]
        self.signs_a, self.signs_b = ([token_signs(len(x), end) for x in known] for known, end in ((self.bytes_a, A_END), (self.bytes_b, B_END)))
        self.names = [str(i) for i in range(max(sizes))]
        self.space = self.b.piece_to_id("\u2581")
        self.memo: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def _ids(self, spaced: list[str], texts: list[str], led: bool) -> tuple[list[list[int]], list[list[int]]]:
        of_a: list = [None] * len(spaced)
        apart = []
        for i, text in enumerate(texts):
            # A word of Latin letters is left whole by the splitter, so the merging model takes it at once.
            if led and text.isascii() and text.isalpha():
                of_a[i] = [t.id for t in self.a.model.tokenize(_SPACE + text)]
            else:
                apart.append(i)
        for i, e in zip(apart, self.a.encode_batch_fast([spaced[i] for i in apart], add_special_tokens=False), strict=True):
            of_a[i] = e.ids
        of_b = self.b.encode(texts, num_threads=1)
        # No piece of B holds a line feed, so nothing joins it; the space that B adds before it is a token of its own.
        return of_a, of_b if led else [b[1:] if b[:1] == [self.space] else [] for b in of_b]

    def _same(self, a: list[int], b: list[int], text: str) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == text.encode()

    def whole(self, texts: list[str], led: bool = True) -> list[Aligned | None]:
        """``texts`` without cutting them, with a space before each or (pieces that begin with a line feed) none; None where bytes are not reproduced. All
        texts are scanned as one, as both end where a text ends."""
        if not texts:
            return []
        spaced = [" " + t for t in texts] if led else texts
        of_a, of_b = self._ids(spaced, texts, led)
        good = list(map(self._same, of_a, of_b, spaced))
        of_a, of_b = [x for x, ok in zip(of_a, good) if ok], [x for x, ok in zip(of_b, good) if ok]
        a, b = [i for x in of_a for i in x], [i for x in of_b for i in x]
        signs = label_string([self.signs_a[i] for i in a], [self.signs_b[i] for i in b])
        names_a, names_b = [self.names[i] for i in a], [self.names[i] for i in b]
        groups, ends, at_a, at_b = [], {}, 0, 0
        for n, m in group_sizes(signs):
            groups.append(f"{names_a[at_a] if n == 1 else ','.join(names_a[at_a : at_a + n])}|{names_b[at_b] if m == 1 else ','.join(names_b[at_b : at_b + m])}")
            at_a, at_b = at_a + n, at_b + m
            ends[at_a] = len(groups)
        links = group_links(signs, np.array(a, np.int64), np.array(b, np.int64)).tobytes()
        done, at_a, at_g, at_l = [], 0, 0, 0
        for x, y in zip(of_a, of_b):
            at_a += len(x)
            g = ends[at_a]
            to = at_l + 4 * (len(x) + len(y) - g + at_g)
            done.append(Aligned(len(x), len(y), g - at_g, links[at_l:to], ";".join(groups[at_g:g])))
            at_g, at_l = g, to
        left = iter(done)
        return [next(left) if ok else None for ok in good]

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """The pieces of a text, and whether the first one must be taken by itself."""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or tokens._RARE.search(text):
            # A first piece that begins with a line feed still has the space of the text before it.
            return _LONE.split(text), True
        return text.replace("\n", " \n").split(" "), False

    def align(self, texts: list[str | None]) -> list[Aligned | None]:
        """The texts aligned; unknown pieces of all of them are encoded at once."""
        cut = [self._cut(t) if t else ([], False) for t in texts]
        if len(self.memo) > MEMO_PIECES // 2:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, []
        for p in {p for pieces, apart in cut for p in (pieces[1:] if apart else pieces)}:
            if p not in memo:
                if p in older:
                    memo[p] = older[p]
                else:
                    new.append(p)
        for led in (True, False):
            own = [p for p in new if p.startswith("\n") != led]
            memo.update(zip(own, self.whole(own, led), strict=True))
        firsts = iter(self.whole([pieces[0] for pieces, apart in cut if apart]))
        out = []
        for text, (pieces, apart) in zip(texts, cut, strict=True):
            got = [next(firsts), *map(memo.__getitem__, pieces[1:])] if apart else list(map(memo.__getitem__, pieces))
            if not got:
                out.append(None)
            elif None in got:
                out += self.whole([text])
            else:
                n_a, n_b, n, links, groups = zip(*got)
                out.append(Aligned(sum(n_a), sum(n_b), sum(n), b"".join(links), ";".join(groups)))
        for p in new:
            if len(p) > MEMO_LENGTH:
                del memo[p]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two files, kept over tasks."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _chunks(batches, most: int):
    """Lists of (doc_id, text) of about ``most`` signs of text."""
    rows, size = [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            rows.append((doc_id, text))
            size += len(text or "")
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _slices(texts: list[str | None]):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_SIGNS:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
_FIRST = f"chunk long, {_DOCS}, pair array<long>, docs array<long>"


def _align_chunks(path_a: str, path_b: str, most: int):
    """Of documents: a row each with its distinct pairs (places in the chunk's list of pairs, and how often, as unsigned 32-bit numbers), and a row for each
    chunk with its pairs and the number of documents that hold each."""

    def run(batches):
        from pyspark import TaskContext

        tool, first = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for no, rows in enumerate(_chunks(batches, most)):
            done = [d for texts in _slices([text for _, text in rows]) for d in tool.align(texts)]
            sizes = [len(d.links) // 4 if d else 0 for d in done]
            links = np.frombuffer(b"".join([d.links for d in done if d]), "<u4")
            pairs, at = np.unique(links, return_inverse=True)
            keys, times = np.unique(np.repeat(np.arange(len(rows), dtype=np.int64), sizes) << 32 | at, return_counts=True)
            places, limits = keys & 0xFFFFFFFF, np.searchsorted(keys >> 32, np.arange(len(rows) + 1))
            # The first place and then the steps between places, which are small.
            steps = np.diff(places, prepend=0)
            starts = limits[:-1][limits[:-1] < limits[1:]]
            steps[starts] = places[starts]
            blobs = [b"".join([steps[i:j].astype("<u4").tobytes(), times[i:j].astype("<u4").tobytes()]) for i, j in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
            of = lambda name: pa.array([getattr(d, name) if d else 0 for d in done] + [None], pa.int64())
            digests = [hashlib.sha256(d.groups.encode()).hexdigest() if d else "" for d in done]
            n, lists = len(rows), pa.list_(pa.int64())
            docs_of = np.bincount(places, minlength=len(pairs))
            yield pa.record_batch(
                [
                    pa.array([first + no] * (n + 1), pa.int64()), pa.array([i for i, _ in rows] + [None], pa.int64()), of("n_a"), of("n_b"), of("n_groups"), pa.array([*sizes, None], pa.int64()),
                    pa.array([*digests, None], pa.string()), pa.array([*blobs, None], pa.binary()), pa.array([None] * n + [pairs.astype(np.int64)], lists), pa.array([None] * n + [docs_of], lists),
                ],
                names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "pair", "docs"],
            )

    return run


def _finish(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links; ``counts`` has a row for each pair of the chunk."""
    at = counts["place"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
    blobs = docs["pairs"].to_pylist()
    sums, bests = [], []
    for blob in blobs:
        steps, times = np.frombuffer(blob, "<u4").reshape(2, -1).astype(np.int64)
        places = np.cumsum(steps)
        sums.append(int((count[places] * times).sum()))
        bests.append(int((best[places] * times).sum()))
    return pa.table([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_links"], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (1 if no pair of its id of A has more), from the chunks' own counts. An id of A has a pair for each id of
    B at most, so a group of the window is bounded by B's vocabulary."""
    counts = chunks.groupBy("pair").agg(F.sum("docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 16)))
    return counts.select("pair", "n", (F.col("n") == most).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of ``docs`` (doc_id, text)."""
    both = common.written(docs.select("doc_id", "text").mapInArrow(_align_chunks(path_a, path_b, CHUNK_SIGNS), _FIRST), "aligned")
    own = both.where("pair is not null").select("chunk", F.posexplode(F.arrays_zip("pair", "docs")).alias("place", "x")).select("chunk", F.col("place").cast("long").alias("place"), "x.pair", "x.docs")
    counts = common.written(pair_counts(own.select("pair", "docs")), "pairs")
    known = own.select("chunk", "place", "pair").join(counts, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    rows = both.where("pairs is not null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
    return rows.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(common.table(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"), tokens.public_path("piece_bpe_32k.model"))
