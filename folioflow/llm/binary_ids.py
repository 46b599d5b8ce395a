"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

The ids of the corpus are ranked by how often they occur, so that the frequent ones take one byte. A file holds blocks; a block has a header,
the document ids, their token counts, two-bit length codes packed four to a control byte, and then all data bytes. The reader looks each
control byte up in a table of four lengths and gathers the data bytes with numpy.

Files are written where executors share a folder, under a name of their own, and become visible by a rename; the manifest names the
ones that count, so a task that runs twice leaves a spare file and no wrong row.

Defined results: null text is empty (one id, the end id); null doc_ids sort first; equal doc_ids stay separate rows, in any order; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

MAGIC = b"FVB1"
_HEAD = struct.Struct("<4sIQQQ")  # magic, 0, documents, values, data bytes
#: Values of a block, at least one document; memory of a task is a small multiple.
BLOCK_VALUES = 1 << 19
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= n[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The reverse of ``encode_values``: lengths by table lookup, values by four gathers."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24) & _MASKS[lengths] if n else np.zeros(0, np.uint32)


def pack_block(doc_ids: list, lengths: list[int], values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, 0, len(doc_ids), len(values), len(data)), known.tobytes(), ids.tobytes(), np.array(lengths, "<u8").tobytes(), control, data])


def unpack_blocks(stream):
    """Of an open file: (doc_ids, lengths, values) of each block."""
    while head := stream.read(_HEAD.size):
        magic, _, docs, n, size = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        known = np.frombuffer(stream.read(docs), np.uint8)
        ids = np.frombuffer(stream.read(8 * docs), "<i8")
        lengths = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        control = stream.read(-(-n // 4))
        yield [int(i) if k else None for i, k in zip(ids, known)], lengths, decode_values(control, stream.read(size), n)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class TokenFiles:
    """Written token files: their folder and the manifest (part, path, n_docs, n_tokens), parts in ascending doc_id order."""

    folder: str
    manifest: DataFrame

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each document, from the files."""
        return self._scan(_decode_ids, "doc_id long, start long, n_tokens long, ids binary")

    def digest(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
        return self._scan(_decode_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def _scan(self, decode, schema: str) -> DataFrame:
        # One row for each file, so a window without keys is small: it grows with the number of files only.
        before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = self.manifest.select("path", before.alias("base"))
        return starts.repartition(max(common.n_shuffle(starts.sparkSession), 1), "path").mapInArrow(decode(self.folder), schema)


def _decode(folder: str, row):
    def run(batches):
        inverse = None
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = _fs(path)
                if inverse is None:
                    with fs.open_input_stream(_fs(f"{folder}/ranks.bin")[1]) as f:
                        inverse = np.frombuffer(f.read(), "<u4")
                with fs.open_input_stream(at) as f:
                    for doc_ids, lengths, ranks in unpack_blocks(f):
                        ids = inverse[ranks].astype("<u4")
                        ends = np.cumsum(lengths)
                        starts = ends - lengths
                        out = [row(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                        kind = pa.binary() if out and isinstance(out[0], bytes) else pa.int64()
                        yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(lengths), pa.array(out, kind)], names=["doc_id", "start", "n_tokens", "ids" if kind == pa.binary() else "ids_crc32"])
                        base += int(ends[-1])

    return run


def _decode_ids(folder: str):
    return _decode(folder, lambda a: a.tobytes())


def _decode_crc(folder: str):
    return _decode(folder, tokens.crc_u32)


def write_token_files(docs: DataFrame, path: str, end: int = 0) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) with the tokenizer file ``path``, put ``end`` after each, and write token files in ascending doc_id order."""
    spark = docs.sparkSession
    vocab = max(tokens.Encoder(path).vocab_size, end + 1)
    wide = vocab > 1 << 16
    counted = pa.map_(pa.int32(), pa.int64())

    def tokenise(batches):
        """Rows of documents, and one row a task of how often each id occurs."""
        total = np.zeros(vocab, np.int64)
        for doc_ids, ids, limits in tokens.encoded_batches(batches, path, end):
            total += np.bincount(ids, minlength=vocab)
            n, width = len(doc_ids), ids.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((limits * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.record_batch([doc_ids.cast(pa.int64()), blobs, pa.nulls(n, counted)], names=["doc_id", "ids", "counts"])
        seen = np.flatnonzero(total)
        counts = pa.MapArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pa.array(seen.astype(np.int32)), pa.array(total[seen]))
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), counts.cast(counted)], names=["doc_id", "ids", "counts"])

    both = common.written(docs.select("doc_id", "text").mapInArrow(tokenise, "doc_id long, ids binary, counts map<int,long>"), "ids")
    encoded = both.where("ids is not null").select("doc_id", "ids")
    # At most one row for each id of the vocabulary comes to the driver.
    counts = both.where("counts is not null").select(F.explode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(vocab, np.int64)
    for r in counts:
        weight[r.id] = r.n
    inverse = np.lexsort((np.arange(vocab), -weight)).astype("<u4")
    rank = np.empty(vocab, np.uint32)
    rank[inverse] = np.arange(vocab, dtype=np.uint32)
    folder = common.scratch_path(spark, "tokens")
    fs, at = _fs(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/ranks.bin") as f:
        f.write(inverse.tobytes())

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = _fs(folder)
        name, temp = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.fvb", f"{at}/.{uuid.uuid4().hex}"
        docs_n = tokens_n = 0
        keys: list = []
        parts: list[bytes] = []
        size = 0
        with fs.open_output_stream(temp) as f:

            def flush():
                nonlocal keys, parts, size, docs_n, tokens_n
                ids = np.frombuffer(b"".join(parts), "<u4" if wide else "<u2")
                width = 4 if wide else 2
                f.write(pack_block(keys, [len(p) // width for p in parts], rank[ids]))
                docs_n, tokens_n = docs_n + len(keys), tokens_n + len(ids)
                keys, parts, size = [], [], 0

            for b in batches:
                for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    keys.append(k)
                    parts.append(p)
                    size += len(p)
                    if size >= BLOCK_VALUES * 2:
                        flush()
            if keys:
                flush()
        if not docs_n:
            fs.delete_file(temp)
            return
        fs.move(temp, f"{at}/{name}")
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs_n]), pa.array([tokens_n])], names=["part", "path", "n_docs", "n_tokens"])

    ordered = encoded.repartitionByRange(common.n_shuffle(spark), "doc_id").sortWithinPartitions("doc_id")
    manifest = common.written(ordered.mapInArrow(write, "part int, path string, n_docs long, n_tokens long"), "manifest")
    return TokenFiles(folder, manifest)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(common.table(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"), end=0)
    return files.digest()


SCHEMA = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
